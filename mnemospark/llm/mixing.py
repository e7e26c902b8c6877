"""Mixing sources to target weights by hierarchical budgeting, in DataFrame functions only.

The tree is domain -> language -> source.  A budget of tokens flows down it: each node divides
what it gets among its children by weight, a child takes no more than it can supply (its tokens
times the largest number of epochs), and what it leaves is divided among its siblings.  A node
supplies what its children supply, so a shortage reaches the siblings of an ancestor only after
the node's own children are exhausted.

At one level this is water-filling: with children sorted by supply over weight, those whose
fair share exceeds the supply form a prefix.  Window sums give it in closed form, in integers.

A leaf with budget b and t tokens passes through its documents floor(b / t) times, and takes of
one more epoch, in seeded order, the prefix of b mod t tokens.  The prefix is found from sums
over hash ranges of the order and then within one range, so no task sorts a whole leaf.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

#: Leaves that are broadcast at most.
LEAVES = 20_000
WORDS = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class MixPlan:
    """Integer weights; what isn't listed weighs ``other``.  Domains are lists of sources."""

    domains: dict[str, tuple[int, tuple[str, ...]]]
    languages: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 1
    max_epochs: int = 3
    #: Percentage of all tokens that the mixture shall have.
    budget_percent: int = 100
    seed: str = "mix-1"


def _weight(column: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for name, w in weights.items():
        out = F.when(column == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def _domain(source: Column, plan: MixPlan) -> Column:
    out = F.lit("other")
    for name, (_, sources) in plan.domains.items():
        out = F.when(source.isin(*sources), F.lit(name)).otherwise(out)
    return out


def fill(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``share``: of the parent's ``budget``, by ``weight``, at most ``supply``."""
    order = Window.partitionBy(*parent).orderBy(F.col("supply").cast("double") / F.col("weight"), name)
    whole = Window.partitionBy(*parent)
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    out = nodes.select("*", F.coalesce(F.sum("supply").over(before), F.lit(0)).alias("_c"), F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("_w"))
    out = out.select("*", (F.col("supply") * F.col("_w") <= F.col("weight") * (F.col("budget") - F.col("_c"))).alias("_full"))
    open_weight = F.when(F.col("_full"), F.lit(0)).otherwise(F.col("weight"))
    out = out.select(
        "*",
        (F.col("budget") - F.coalesce(F.sum(F.when(F.col("_full"), F.col("supply"))).over(whole), F.lit(0))).alias("_rest"),
        F.sum(open_weight).over(whole).alias("_open"),
        F.sum(open_weight).over(upto).alias("_upto"),
    )
    cut = lambda w: F.expr(f"({w}) * _rest div nullif(_open, 0)")
    return out.select(*nodes.columns, F.when(F.col("_full"), F.col("supply")).otherwise(cut("_upto") - cut("_upto - weight")).alias("share"))


def leaf_budgets(leaves: DataFrame, plan: MixPlan) -> DataFrame:
    """``domain, lang, source, rows, tokens`` -> the same with ``budget`` in tokens."""
    leaves = leaves.withColumn("supply", F.col("tokens") * plan.max_epochs)
    total = leaves.agg(F.coalesce(F.expr(f"sum(tokens) * {plan.budget_percent} div 100"), F.lit(0)).alias("budget"))
    domains = leaves.groupBy("domain").agg(F.sum("supply").alias("supply")).withColumn("weight", _weight(F.col("domain"), {k: w for k, (w, _) in plan.domains.items()}, plan.other))
    # One row of totals and a domain for each name in the plan: a join of bounded sides.
    domains = fill(domains.withColumn("root", F.lit(0)).join(total.withColumn("root", F.lit(0)), "root"), ["root"], "domain")
    langs = leaves.groupBy("domain", "lang").agg(F.sum("supply").alias("supply")).withColumn("weight", _weight(F.col("lang"), plan.languages, plan.other))
    langs = fill(langs.join(domains.select("domain", F.col("share").alias("budget")), "domain"), ["domain"], "lang")
    out = leaves.withColumn("weight", _weight(F.col("source"), plan.sources, plan.other))
    out = fill(out.join(langs.select("domain", "lang", F.col("share").alias("budget")), ["domain", "lang"]), ["domain", "lang"], "source")
    return out.select("domain", "lang", "source", "rows", "tokens", F.col("share").alias("budget"))


def order_key(plan: MixPlan, *columns: Column) -> Column:
    """A seeded number from 0 to 2^32 - 1, the same in any engine with md5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(plan.seed), *columns)), 1, 8), 16, 10).cast("long")


def mix(df: DataFrame, plan: MixPlan, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows of the mixture: ``doc_id, domain, lang, source, n_tokens, epochs, taken``.

    ``epochs`` says how often the document is passed whole; ``taken`` how many of its tokens the
    last, unfinished epoch takes (all, for a document inside the prefix; fewer for the one in
    which it ends).  Documents of which nothing is taken have no row.

    Tokens are words ``[^\\x20\\x09-\\x0D]+``; a null text has none, and documents without tokens are
    never taken.  Null languages and sources count as ``''``; repeated rows count each for itself;
    an empty table gives no rows.  Columns other than the four are not read.
    """
    d = _counted(df, plan, id_col, text_col, lang_col, source_col)
    return select_prefix(d, plan).drop("row")


def _counted(df: DataFrame, plan: MixPlan, id_col: str, text_col: str, lang_col: str, source_col: str, row: Column | None = None) -> DataFrame:
    """Leaf and tokens of every row that has tokens, written: the texts are read once.  ``row`` tells rows apart."""
    d = df.select(
        F.col(id_col).alias("doc_id"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens"),
        (F.lit(None).cast("long") if row is None else row).alias("row"),
    )
    return materialise(d.filter("n_tokens > 0").withColumn("domain", _domain(F.col("source"), plan)), "counted")


def select_prefix(d: DataFrame, plan: MixPlan) -> DataFrame:
    leaf = ["domain", "lang", "source"]
    stats = d.groupBy(*leaf).agg(F.count(F.lit(1)).alias("rows"), F.sum("n_tokens").alias("tokens"))
    leaves = leaf_budgets(stats, plan).select(
        *leaf,
        F.expr("budget div tokens").alias("epochs"),
        F.expr("budget % tokens").alias("part"),
        F.ceil(F.sqrt("rows")).cast("long").alias("cells"),
    )
    leaves = materialise(leaves, "leaves")
    # Broadcast behind a check; more leaves than that are met by a join of two plain sides, whose hot keys Spark splits.
    d = d.join(F.broadcast(leaves) if leaves.limit(LEAVES + 1).count() <= LEAVES else leaves, leaf)
    d = d.withColumn("h", order_key(plan, F.col("epochs").cast("string"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    d = d.withColumn("cell", F.expr("h * cells div 4294967296"))
    cells = d.groupBy(*leaf, "cell").agg(F.sum("n_tokens").alias("n"))
    cells = cells.select(*leaf, "cell", F.coalesce(F.sum("n").over(Window.partitionBy(*leaf).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    d = d.join(cells, [*leaf, "cell"])
    within = Window.partitionBy(*leaf, "cell").orderBy("h", "doc_id", "n_tokens", "row").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("before", F.col("base") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    taken = F.greatest(F.least(F.col("n_tokens"), F.col("part") - F.col("before")), F.lit(0))
    return d.select("doc_id", *leaf, "n_tokens", "epochs", taken.alias("taken"), "row").filter("epochs > 0 or taken > 0")


def mixed_rows(df: DataFrame, plan: MixPlan, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Rows of ``df`` as often as the mixture passes them; the document in which a leaf's prefix ends stays whole.

    Every row counts for itself: rows of one id, of a null id and repeated rows are taken or left one by one.  Rows without tokens (null, empty, blank
    texts) are never taken.  An empty table gives no rows.  All columns stay, whatever their names.

    Rows are written with a number each, so that those chosen are met again by it.
    """
    names = [f"_c{i}" for i in range(len(df.columns))]
    of = dict(zip(df.columns, names, strict=True))
    rows = materialise(df.toDF(*names).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    chosen = select_prefix(_counted(rows, plan, of[id_col], of[text_col], of[lang_col], of[source_col], F.col("_row")), plan)
    chosen = chosen.select(F.col("row").alias("_row"), (F.col("epochs") + (F.col("taken") > 0).cast("long")).alias("_times"))
    out = rows.join(chosen, "_row")
    if plan.max_epochs > 1:
        out = out.withColumn("_pass", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times"))))
    return out.select(*(F.col(x).alias(c) for c, x in of.items()))
