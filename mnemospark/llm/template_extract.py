"""Main-text extraction by deducing the template of each host from equivalence classes of tokens.

A page is read as tokens: tags (name, class and id) and text nodes.  Tokens of a host that have the same
occurrence vector (how often each page of the host has them) form an equivalence class.  A vector is
known by two sums over pages of hashes of (page, count), so classes are found by aggregation, without gathering a host's pages.
Pages of a host with equal sets of text nodes are copies, and count as one page: what only copies share is no template.

Classes of at least two tokens that nearly all pages have are tried in a second pass.  Tokens that occur once a page make up the frame of the
template if they keep their order: those that stand out of order on more than a few pages are invalid and leave it.  The gaps between the
frame's tokens are slots.  A class that recurs in a page (the items of a list) is nested in the slot that holds nearly all its occurrences, else it is none.

The template decides for the host which slots are content.  Where the frame's gaps reach into an article or main element on most pages, these are; else
every slot whose text varies between pages, isn't mostly that of elements which are no article text, and isn't mostly links (links of a nested class, the items of a menu,
weigh more).  Text nodes of the frame are part of the template, and no content, unless an article would be left empty.  Of a page the content slots are extracted, without
elements that are no article text wherever they stand: navigation, forms, notices, adverts, comments of readers.  A page that differs from its host's template, or of a host of
few pages, is read by its elements alone.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import html
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialise

#: A token belongs to a template if this share of the host's pages has it, and so many pages at least.
SHARE, PAGES = 0.8, 4

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!/?A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*>|<[!/?A-Za-z][^>]*(?:>|\Z)|[^<]+|<", re.S)
_TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)(.*)>?\Z", re.S)
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split())
_RAW = frozenset("script style textarea title noscript iframe template svg math".split())
#: Of these, a slash at the end closes nothing.
_RAW_ALWAYS = frozenset("script style textarea title noscript iframe template".split())
_OUT = frozenset("head nav header footer aside form script style title noscript iframe template svg math button select textarea dialog menu object".split())
#: Words of class, id or role names that mark what is no article text.
_OUT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments contentinfo cookie cookies consent disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice popup promo promoted related replies share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
#: Names with these say how something is laid out, not what it is: content-with-sidebar, share-buttons-on.
_STATES = frozenset("with without has no on off enabled disabled".split())
#: An article's own header holds its title.
_OWN_HEADER = frozenset("article post entry content story".split())
_REPLIES = frozenset("comment comments disqus replies reply".split())
_MAIN = frozenset(("article", "main"))

Token = tuple[str, str, str]  # kind (start, end, text), name or text, marks


def _marks(attributes: str) -> str:
    found = (v.strip("\"'").lower() for k, v in _ATTR.findall(attributes) if v and k.lower() in ("class", "id", "role"))
    return " ".join(x for x in found if x)


def _names(marks: str) -> Iterator[list[str]]:
    for name in marks.split():
        parts = re.split(r"[-_]+", name)
        if not _STATES.intersection(parts):
            yield parts


@functools.lru_cache(4096)
def is_out(name: str, marks: str) -> bool:
    """Whether an element is no article text, by its kind or its names."""
    if name in _OUT:
        return True
    if name in ("html", "body"):
        return False
    if name in _MAIN:  # an article of readers
        return any(_REPLIES.intersection(parts) for parts in _names(marks))
    return any(_OUT_NAMES.intersection(parts) and not (parts[-1] == "header" and _OWN_HEADER.intersection(parts)) for parts in _names(marks))


#: Tags are parsed and digested once a worker if they are no longer than this, as most recur.
_SHORT = 256


def _parse(t: str) -> tuple[tuple[Token, ...], str]:
    """The tokens of a tag, none of a declaration; the element's name if its content is raw."""
    if t.startswith(("<!", "<?")) or not (tag := _TAG.match(t)):
        return (), ""
    name = tag[2].lower()
    if tag[1]:
        return (("end", name, ""),), ""
    start = ("start", name, _marks(tag[3]) if "=" in tag[3] else "")
    if name in _VOID:
        return (start,), ""
    if tag[3].rstrip("> ").endswith("/") and name not in _RAW_ALWAYS:
        return (start, ("end", name, "")), ""
    return (start,), name if name in _RAW else ""


_parse_short = functools.lru_cache(1 << 14)(_parse)


def tokens(page: str) -> Iterator[Token]:
    """Start and end tags and raw text nodes, without comments and what scripts, styles and the like hold."""
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at, t = m.end(), m.group()
        if t[0] != "<" or t == "<":
            yield "text", t, ""
            continue
        found, raw = _parse_short(t) if len(t) <= _SHORT else _parse(t)
        yield from found
        if raw:
            close = re.compile(rf"</{raw}(?=[\s>/]|\Z)", re.I).search(page, at)
            at = close.start() if close else n


def _digest(token: Token) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(token).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


_digest_short = functools.lru_cache(1 << 14)(_digest)


def digest(token: Token) -> int:
    return _digest_short(token) if token[0] != "text" and len(token[1]) + len(token[2]) <= _SHORT else _digest(token)


def _identity(token: Token) -> Token | None:
    if token[0] != "text":
        return token
    text = " ".join(token[1].split())
    return ("text", text, "") if text else None


def host_of(url: str | None) -> str:
    m = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_COUNTED = "host string, token long, page long, total long, f1 long, f2 long, at double"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens of each distinct page; token 0 stands for the page itself, which is known by its set of text nodes."""
    for batch in batches:
        rows: dict[tuple[str, int, int], tuple] = {}
        for _, url, page in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            host = host_of(url)
            seen: Counter = Counter()
            first: dict[int, int] = {}
            texts: set[int] = set()
            k = 0
            for token in tokens(page or ""):
                if (identity := _identity(token)) is not None:
                    d = digest(identity) or 1
                    first.setdefault(d, k)
                    seen[d] += 1
                    k += 1
                    if identity[0] == "text":
                        texts.add(d)
            seen[0] = 1
            first[0] = 0
            own = hashlib.blake2b(repr(sorted(texts)).encode(), digest_size=8).digest()
            which = int.from_bytes(own, "big", signed=True)
            hashes = {n: int.from_bytes(hashlib.blake2b(own + b"|%d" % n, digest_size=8).digest(), "big") for n in set(seen.values())}
            for d, n in seen.items():
                h = hashes[n]
                row = (n, h & 0x3FFFFFFF, h >> 34, first[d] / max(k, 1))
                rows[host, d, which] = max(row, rows.get((host, d, which), row))
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in rows], pa.string()), *(pa.array([k[i] for k in rows], pa.int64()) for i in (1, 2)), *(pa.array([r[i] for r in rows.values()], pa.int64()) for i in range(3)), pa.array([r[3] for r in rows.values()], pa.float64())],
            names=[x.split()[0] for x in _COUNTED.split(", ")],
        )


def candidates(pages: DataFrame) -> DataFrame:
    """``host, frame, lists``: tokens of classes that occur once a page, by their mean place, and (token, class) of classes that recur.

    ``pages`` has id, url and html.  A host of fewer than ``PAGES`` distinct pages has no row.
    """
    # Copies in several tasks meet here, each token once a page content.
    once = arrow_map(pages, _count, _COUNTED).groupBy("host", "token", "page").agg(F.max(F.struct("total", "f1", "f2", "at")).alias("x")).select("host", "token", "x.*")
    counted = once.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), *(F.sum(c).alias(c) for c in ("total", "f1", "f2", "at"))).filter(f"token = 0 or pages >= {PAGES}")
    counted = materialise(counted, "tokens")
    hosts = counted.filter(f"token = 0 and pages >= {PAGES}").select("host", F.col("pages").alias("n"))
    valid = counted.filter("token <> 0").join(hosts, "host").filter(F.col("pages") >= F.col("n") * SHARE)
    # The tokens of one vector: a class.  A single token is none.
    classes = valid.groupBy("host", "f1", "f2").agg(
        F.count(F.lit(1)).alias("size"), F.max(F.col("total") == F.col("pages")).alias("once"), F.sort_array(F.collect_list(F.struct((F.col("at") / F.col("pages")).alias("at"), "token"))).alias("tokens")
    ).filter("size > 1")
    frame = F.sort_array(F.flatten(F.collect_list(F.when(F.col("once"), F.col("tokens")))))
    lists = F.flatten(F.collect_list(F.when(~F.col("once"), F.transform("tokens", lambda t: F.struct(t["token"].alias("token"), F.xxhash64("f1", "f2").alias("class"))))))
    return classes.groupBy("host").agg(F.transform(frame, lambda t: t["token"]).alias("frame"), lists.alias("lists"))


class _Block:
    __slots__ = ("links", "main", "out", "slot", "text")

    def __init__(self, slot: int, main: bool, out: bool = False):
        self.slot, self.text, self.links, self.main, self.out = slot, [], 0, main, out

    @property
    def size(self) -> int:
        return sum(map(len, self.text))


@dataclass
class _Page:
    #: Blocks of text; those of elements that are no article text have ``out``.
    blocks: list[_Block]
    #: Text nodes of the frame.
    fixed: list[_Block]
    #: The token of the frame before each slot, 0 before the first.
    labels: list[int]
    #: Tokens of the frame that stand out of order here.
    astray: list[int]
    #: By slot, how many tokens of each recurring class it has, and how many of them are links.
    lists: dict[tuple[int, int], list[int]]


def read_page(page: str | None, frame: list[int] | None, lists: dict[int, int]) -> _Page:
    read = list(tokens(page or ""))
    digests = [(digest(i) or 1) if (i := _identity(t)) is not None else 0 for t in read] if frame else [0] * len(read)
    times = Counter(digests)
    # Of the frame, what stands once in this page and in order: the longest run of growing places.
    place = {d: k for k, d in enumerate(digests) if times[d] == 1}
    once = [(d, place[d]) for d in frame or () if d in place]
    framed = {k: d for d, k in _in_order(once)}
    astray = [d for d, k in once if k not in framed]

    stack: list[tuple[str, bool, bool, bool]] = []  # name, no content, main, link
    blocks: list[_Block] = []
    fixed: list[_Block] = []
    labels = [0]
    slot, opened = 0, True
    found: dict[tuple[int, int], list[int]] = {}

    def close(name: str) -> None:
        """Ends the nearest open element of the name; paragraphs and inline elements are not ended across a block."""
        narrow = name == "p" or name in _INLINE
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                del stack[i:]
                return
            if narrow and stack[i][0] != "p" and stack[i][0] not in _INLINE:
                return

    for k, (kind, name, marks) in enumerate(read):
        if k in framed:
            slot += 1
            labels.append(framed[k])
            opened = True
        if digests[k] in lists:
            x = found.setdefault((slot, lists[digests[k]]), [0, 0])
            x[0] += 1
            x[1] += kind == "start" and name == "a"
        if kind == "start":
            if name not in _INLINE:
                opened = True
                if name not in _VOID:
                    close("p")
            if name == "li" and stack and stack[-1][0] == "li":
                close("li")
            if name not in _VOID:
                inside = stack[-1] if stack else ("", False, False, False)
                out = inside[1] or is_out(name, marks)
                stack.append((name, out, inside[2] or name in _MAIN or "main" in marks.split(), inside[3] or name == "a"))
        elif kind == "end":
            if name not in _INLINE:
                opened = True
            close(name)
        else:
            _, out, main, link = stack[-1] if stack else ("", False, False, False)
            if k in framed:  # a text that every page has: the template's own
                fixed.append(_Block(slot, main, out))
                fixed[-1].text.append(name)
                opened = True
                continue
            if opened or blocks[-1].out != out:
                blocks.append(_Block(slot, main, out))
                opened = False
            blocks[-1].text.append(name)
            if link:
                blocks[-1].links += len(name)
    return _Page(blocks, fixed, labels, astray, found)


def extract(page: str | None, template: Template | None) -> str:
    """Text of a page's content slots."""
    read = read_page(page, template.frame if template else None, {})
    own = [b for b in read.blocks if not b.out and "".join(b.text).strip()]
    marked = [b for b in own if b.main]
    chosen = marked or own
    if template and template.content:
        inside = [b for b in own if read.labels[b.slot] in template.content]
        if template.marked:
            # An article that stands elsewhere than on the host's other pages is one as well.
            chosen = [b for b in inside if b.main] or marked or inside or own
        else:
            chosen = inside or marked or own
    found = _joined(chosen)
    if not marked and any(b.main and not b.out for b in read.fixed) and not (template and template.content and not template.marked):
        # All that an article holds is the frame's: rather the article of every page than none.
        found = _joined(b for b in read.fixed if b.main and not b.out) or found
    return found


def _joined(blocks: Iterable[_Block]) -> str:
    out = (" ".join(html.unescape("".join(b.text)).split()) for b in blocks)
    return " ".join(x for x in out if x)


def _in_order(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence of (token, place) with growing places."""
    ends: list[int] = []
    back: list[int] = []
    for i, (_, at) in enumerate(found):
        lo = bisect.bisect_left(ends, at, key=lambda e: found[e][1])
        back.append(ends[lo - 1] if lo else -1)
        ends[lo:] = [i] if lo == len(ends) else [i, *ends[lo + 1 :]]
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(found[i])
        i = back[i]
    return out[::-1]


#: What a host's pages say: 0 how many they are; 1 in how many a token of the frame is astray; 2 of a slot (by its label) pages, characters, those in links, in an article, in
#: elements that are no article text, the least and greatest digest of its text; 3 of a recurring class in a slot tokens and links.
_EVIDENCE = "host string, kind int, key long, other long, pages long, chars long, links long, main long, out long, low long, high long"


def _evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sums: dict[tuple[str, int, int, int], list[int]] = {}

        def add(host: str, kind: int, key: int, other: int, *n: int, low: int = 0, high: int = 0) -> None:
            x = sums.get((host, kind, key, other))
            if x is None:
                sums[host, kind, key, other] = [*n, *([0] * (5 - len(n))), low, high]
            else:
                for i, y in enumerate(n):
                    x[i] += y
                x[5], x[6] = min(x[5], low), max(x[6], high)

        for page, frame, lists, host in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
            read = read_page(page, frame, {x["token"]: x["class"] for x in lists or ()})
            add(host, 0, 0, 0, 1)
            for d in read.astray:
                add(host, 1, d, 0, 1)
            for (slot, c), (n, links) in read.lists.items():
                add(host, 3, c, read.labels[slot], n, 0, links)
            texts: dict[int, list] = {}
            for b in read.blocks:
                text = " ".join("".join(b.text).split())
                if text:
                    x = texts.setdefault(read.labels[b.slot], [[], 0, 0, 0, 0])
                    x[0].append(text)
                    for i, n in enumerate((b.size, b.links, b.size * (b.main and not b.out), b.size * b.out)):
                        x[i + 1] += n
            for b in read.fixed:
                # An article of which all is the frame's is one none the less.
                if b.main and not b.out:
                    texts.setdefault(read.labels[b.slot], [[], 0, 0, 0, 0])[3] += b.size
            for label, (parts, *n) in texts.items():
                d = digest(("text", " ".join(parts), ""))
                add(host, 2, label, 0, int(bool(parts)), *n, low=d, high=d)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in sums], pa.string()), pa.array([k[1] for k in sums], pa.int32()), *(pa.array([k[i] for k in sums], pa.int64()) for i in (2, 3)), *(pa.array([x[i] for x in sums.values()], pa.int64()) for i in range(7))],
            names=[x.split()[0] for x in _EVIDENCE.split(", ")],
        )


@dataclass
class Template:
    frame: list[int]
    #: Nested classes, and the label of the slot that holds each.
    nested: dict[int, int]
    #: Labels of the slots that are content; whether these are of an article or main element.
    content: set[int]
    marked: bool


def deduce(frame: list[int], evidence: list[dict]) -> Template:
    """A host's template: the valid tokens of the frame in order, nested classes, and its content slots."""
    pages = max([0, *(e["pages"] for e in evidence if e["kind"] == 0)])
    astray = {e["key"]: e["pages"] for e in evidence if e["kind"] == 1}
    valid = [d for d in frame if astray.get(d, 0) <= pages * (1 - SHARE)]
    # Slots after an invalid token are one with the slot before it.
    merged, last, kept = {0: 0}, 0, set(valid)
    for d in frame:
        last = d if d in kept else last
        merged[d] = last
    slots: dict[int, list[int]] = {}
    classes: dict[int, Counter] = {}
    menus: Counter = Counter()
    for e in evidence:
        if e["kind"] == 2:
            x = slots.setdefault(merged[e["key"]], [0, 0, 0, 0, 0, e["low"], e["high"]])
            for i, name in enumerate(("pages", "chars", "links", "main", "out")):
                x[i] += e[name]
            x[5], x[6] = min(x[5], e["low"]), max(x[6], e["high"])
        elif e["kind"] == 3:
            classes.setdefault(e["key"], Counter())[merged[e["other"]]] += e["pages"]
            menus[e["key"]] += e["links"]
    nested = {}
    for c, by in classes.items():
        label, n = max(by.items(), key=lambda x: (x[1], -x[0]))
        if n >= SHARE * by.total():
            nested[c] = label
    listed = {label for c, label in nested.items() if menus[c] >= 3 * pages}
    article = {label for label, (_, chars, _, main, out, *_) in slots.items() if main > 0 and 2 * main >= chars - out}
    if article:
        return Template(valid, nested, article, True)
    content = set()
    for label, (n, chars, links, _, out, low, high) in slots.items():
        varies = low < high or n < SHARE * pages
        if varies and 2 * out < chars and chars - out > links * (3 if label in listed else 2):
            content.add(label)
    return Template(valid, nested, content, False)


def _deduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        made = [deduce(frame, evidence) for frame, evidence in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        longs = pa.list_(pa.int64())
        pairs = pa.array([[{"class": c, "slot": s} for c, s in t.nested.items()] for t in made], pa.list_(pa.struct([("class", pa.int64()), ("slot", pa.int64())])))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([t.frame for t in made], longs), pairs, pa.array([sorted(t.content) for t in made], longs), pa.array([t.marked for t in made])], names=["host", "frame", "nested", "content", "marked"]
        )


def templates(pages: DataFrame) -> DataFrame:
    """``host, frame, nested, content, marked`` of every host of ``PAGES`` distinct pages or more; ``pages`` has id, url, page and host."""
    known = materialise(candidates(pages.select("id", "url", "page")), "candidates")
    both = pages.join(known, "host").select("id", "url", "page", "frame", "lists", "host")
    found = arrow_map(both, _evidence, _EVIDENCE).groupBy("host", "kind", "key", "other").agg(*(F.sum(c).alias(c) for c in ("pages", "chars", "links", "main", "out")), F.min("low").alias("low"), F.max("high").alias("high"))
    # As many rows a host as its candidates have tokens and slots: the length of a page.
    by_host = found.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("kind", "key", "other", "pages", "chars", "links", "main", "out", "low", "high"))).alias("evidence"))
    rows = by_host.join(known, "host").select("host", F.coalesce("frame", F.array().cast("array<long>")).alias("frame"), "evidence")
    return arrow_map(rows, _deduce, "host string, frame array<long>, nested array<struct<class:long,slot:long>>, content array<long>, marked boolean")


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        for page, frame, content, marked in zip(*(batch.column(i).to_pylist() for i in range(2, 6)), strict=True):
            texts.append(extract(page, Template(frame, {}, set(content), marked) if frame else None))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["id", "url", "text"])


def extract_main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id, url, text`` of every page: its main text, an empty string if there is none.

    Character references are decoded, white space in a block becomes one blank, blocks are joined in page
    order by one blank; nothing is capped.  A null or empty page has an empty text; a page whose url is
    null or no url is of the host ``''``; a host of few pages has no template, and its pages are read by their
    elements alone.  Repeated rows have a text each, but count once in the template's classes; an empty table gives no rows; other columns aren't read.

    Pages meet their host's template by a join; a host with a third of all pages is a skewed key there, which
    Spark splits, as nothing needs its pages together.
    """
    pages = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("page"))
    host = F.coalesce(F.lower(F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    pages = pages.withColumn("host", host)
    known = materialise(templates(pages), "templates")
    both = pages.join(known, "host", "left").select("id", "url", "page", "frame", "content", "marked")
    out = arrow_map(both, _extract, f"id {dict(pages.dtypes)['id']}, url string, text string")
    return out.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")
