"""A training corpus from raw documents: quality, near duplicates, decontamination, mixture, shards.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns the
columns of ``documents`` (and any others that the table has, whatever their names); the last adds ``shard`` and ``slot``, in place of columns of these names.

Null texts count as empty, and rows count each for itself, whatever their ids, but where a stage says otherwise.  An empty table passes through every stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.llm import decontam, minhash, mixing, rule_quality, sharding
from mnemospark.llm.common import materialise, table

QUALITY_FLOOR = 0.7
SHARDS = 16
#: No document twice: leaves short of their share leave it to their siblings, and a fifth of all tokens stays out.
MIX = mixing.MixPlan(
    domains={
        "web": (5, tuple(f"src{i}" for i in range(8))),
        "books": (3, tuple(f"src{i}" for i in range(8, 14))),
        "code": (2, tuple(f"src{i}" for i in range(14, 20))),
    },
    languages={"en": 4, "de": 2, "fr": 2, "es": 2},
    max_epochs=1,
    budget_percent=80,
)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go.

    Null and empty texts have the score of an empty text; repeated rows go or stay together.  Labels that are null or of no document aren't
    learnt from; without labels of both kinds every document has the same score, that of the share of good ones.
    """
    model = rule_quality.train(docs, table(spark, sf_dir, "labels"))
    return rule_quality.keep_good(docs, model, QUALITY_FLOOR)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: the one of the smallest id.

    Of rows of one id one stays.  Rows of a null id all stay, and texts without words are in no group.
    """
    return minhash.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages go out of texts; texts that are mostly passages go.

    ``n_chars`` follows the text, null for a null one.  Clean rows, null and empty texts stay as they are; items without words match nothing.
    """
    out = decontam.remove_contamination(docs, table(spark, sf_dir, "benchmark"))
    return out.withColumn("n_chars", F.char_length("text").cast(dict(docs.dtypes)["n_chars"])).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents beyond their leaf's budget go, and those without words.

    Null languages and sources are leaves like others; the document in which a leaf's budget ends stays whole; ties in the seeded order go by id, then by row.
    """
    return mixing.mixed_rows(docs, MIX)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row gets its shard and its place there, null and repeated ones too; sizes of shards differ by one at most."""
    return sharding.sharded_rows(docs, "doc_id", "text", SHARDS)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shard", shard),
]

#: The classifier's training and the seeded matrix of shards are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order on ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
