"""Main text of web pages: differencing against the page of the nearest URL, checked by markup rules.

Every page is split in lines (text blocks), less those that markup rules condemn: menus,
headers, footers, sidebars, notices, adverts, forms and comments.  The page is paired with
a neighbour in the order of (host, path), the one whose path shares the longer prefix; both
texts are aligned by longest common subsequence, and shared lines are to be deleted.  A
check by the markup follows: on a page with an article or main element, the lines inside it
are restored, as neighbouring articles do quote one another, and those outside go; on others
the differencing stands.  Pages of one host with the same lines are no neighbours of one
another.  Neighbours are found on keys alone, in ranges of that order whose ends are carried
over, so a host of any size is spread over tasks and the result does not depend on where
ranges are cut; lines are compared by 64-bit hashes, and only the texts themselves meet what
differencing found.
"""

from __future__ import annotations

import hashlib
import html
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from fusegrid.llm.urlfilter import host_of, path_of
from fusegrid.plans.scratch import discard, materialize

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
RAW = frozenset("script style textarea title noscript template xmp iframe noembed noframes".split())
CHROME = frozenset("nav header footer aside form menu dialog button select fieldset svg canvas object audio video head".split())
CHROME_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
CHROME_WORDS = frozenset("ad ads adbox adslot advert adverts advertisement advertising advertorial banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices notification alert sidebar side rail menu nav navbar navigation topbar toolbar breadcrumb breadcrumbs masthead header footer comment comments commentlist reply replies discussion disqus respond share sharing social related recommended newsletter subscribe subscription signup popup modal overlay widget form search pagination pager skip".split())
OWN_WORDS = frozenset("article entry post story content body main text".split())
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attr>(?:[^>"']|"[^"]*+"|'[^']*+')*+)>|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attr2>[^>]*)>""", re.S)
#: One attribute with its value, so that nothing is found inside values.
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")


def _is_chrome(name: str, attrs: dict[str, str]) -> bool:
    if name in CHROME or attrs.get("role", "").lower() in CHROME_ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return True
    for named in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        words = set(re.split(r"[-_]+", named))
        if words & CHROME_WORDS and not (words & OWN_WORDS and not words & {"comment", "comments", "ad", "ads", "footer", "sidebar"}):
            return True
    return False


def lines_of(page: str) -> list[tuple[str, bool, bool]]:
    """(text, inside an article, chrome) of every text block, in page order."""
    out: list[tuple[str, bool, bool]] = []
    held: list[str] = []
    skip, depth, article = "", 0, 0

    def flush():
        text = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append((text, article > 0 and not skip, bool(skip)))

    at = 0
    while m := _TOKEN.search(page, at):
        held.append(page[at : m.start()])
        at = m.end()
        name = (m["name"] or m["name2"] or "").lower()
        if not name:
            held.append(m["cdata"] or "")
            continue
        ends, attr = bool(m["end"] or m["end2"]), m["attr"] or m["attr2"] or ""
        if name in RAW and not ends:
            close = re.compile(rf"</{re.escape(name)}\b[^>]*>|\Z", re.I).search(page, at)
            at = close.end()
            held.append(" ")
            continue
        if name == "br":
            held.append(" ")
        if name in BLOCKS:
            flush()
        if skip:
            if name in ("article", "main") and not ends and name != skip and skip not in ("article", "main", "div", "section", "aside"):
                skip, depth = "", 0  # an unclosed menu or head does not hide the article
            elif name == skip:
                depth += -1 if ends else 1
                if depth <= 0:
                    flush()
                    skip = ""
                continue
            else:
                continue
        attrs = {a[0].lower(): a[1] or a[2] or a[3] for a in _ATTR.findall(attr)} if attr and not ends else {}
        if not ends and not attr.rstrip().endswith("/") and _is_chrome(name, attrs) and name not in ("html", "body", "img", "input", "link", "meta", "br", "hr"):
            flush()
            skip, depth = name, 1
        elif name in ("article", "main") or attrs.get("itemprop", "").lower() == "articlebody" and name in ("article", "main"):
            article = max(0, article + (-1 if ends else 1))
    held.append(page[at:])
    flush()
    return out


def _prefix_lengths(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of ``a`` and b[:j], for j from 0 to len(b); bit-parallel over b."""
    at: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        at.setdefault(x, []).append(j)
    every = (1 << len(b)) - 1
    v = every
    for x in a:
        u = v & sum(1 << j for j in at.get(x, ()))
        v = ((v + u) | (v - u)) & every
    bits = np.unpackbits(np.frombuffer(v.to_bytes(len(b) // 8 + 1, "little"), np.uint8), bitorder="little", count=len(b))
    return np.concatenate(([0], np.cumsum(1 - bits.astype(np.int64))))


def shared(a: list[str], b: list[str]) -> set[int]:
    """Positions in ``a`` on a longest common subsequence with ``b``, by division, in memory linear in the lines."""
    both = set(a) & set(b)
    place = [i for i, x in enumerate(a) if x in both]
    out: set[int] = set()
    todo = [(0, len(place), [a[i] for i in place], [x for x in b if x in both])]
    while todo:
        low, high, x, y = todo.pop()
        least, head, tail = min(len(x), len(y)), 0, 0
        while head < least and x[head] == y[head]:
            head += 1
        while tail < least - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        out.update(place[low : low + head])
        out.update(place[high - tail : high])
        low, x, y = low + head, x[head : len(x) - tail], y[head : len(y) - tail]
        if not x or not y:
            continue
        if len(x) == 1:
            if x[0] in y:
                out.add(place[low])
            continue
        mid = len(x) // 2
        cut = int(np.argmax(_prefix_lengths(x[:mid], y) + _prefix_lengths(x[: mid - 1 : -1], y[::-1])[::-1]))
        todo += [(low, low + mid, x[:mid], y[:cut]), (low + mid, low + len(x), x[mid:], y[cut:])]
    return out


def outside(page: list[tuple[str, bool, bool]]) -> list[str]:
    """The lines outside any article that the markup does not condemn."""
    return [x[0] for x in page if not x[1] and not x[2]]


def deleted(own: list, inside: bytes | list[bool], other: list, other_inside: bytes | list[bool]) -> set[int]:
    """Places of the lines of a page that differencing deletes; those of a page without an article are held against lines outside articles."""
    return shared(own, other if any(inside) else [x for x, i in zip(other, other_inside, strict=True) if not i])


def checked(inside: bytes | list[bool], gone: set[int]) -> list[int]:
    """Places of the lines of the main text: what the markup leaves of the differencing, and restores."""
    if any(inside):
        return [i for i, x in enumerate(inside) if x]
    return [i for i in range(len(inside)) if i not in gone]


def main_text(page: list[tuple[str, bool, bool]], neighbour: list[str] | None) -> str:
    """The lines that differencing against the neighbour's leaves, after the check by the markup."""
    own, inside = [x[0] for x in page if not x[2]], [x[1] for x in page if not x[2]]
    gone = deleted(own, inside, neighbour, [False] * len(neighbour)) if neighbour else set()
    return "\n".join(own[i] for i in checked(inside, gone))


@F.pandas_udf(IntegerType())
def _common(a: pd.Series, b: pd.Series) -> pd.Series:
    """Length of the common prefix of two paths; -1 without the second."""
    return pd.Series([-1 if y is None else len(os.path.commonprefix((x, y))) for x, y in zip(a, b, strict=True)], dtype="int32")


def neighbours(keys: DataFrame) -> DataFrame:
    """(host, content, near): for each content of a host, the content of its nearest neighbour, null if it has none.

    keys: host, path, page_id, content.  A content stands at its least (path, page_id).
    """
    order = ["host", "path", "page_id", "content"]
    first = keys.groupBy("host", "content").agg(F.min(F.struct("path", "page_id")).alias("v")).select("host", "v.path", "v.page_id", "content")
    ranged = first.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    ranged = materialize(ranged, "places")
    # the ends of each range are carried over to the next ones; there are two rows a range
    ends = ranged.groupBy("part").agg(F.min(F.struct(*order)).alias("low"), F.max(F.struct(*order)).alias("high")).orderBy("part").collect()
    carried = [(*x.high, y.part) for x, y in zip(ends, ends[1:], strict=False)] + [(*y.low, x.part) for x, y in zip(ends, ends[1:], strict=False)]
    both = ranged.withColumn("own", F.lit(True)).union(ranged.sparkSession.createDataFrame(carried, ranged.schema).withColumn("own", F.lit(False)))
    w = W.partitionBy("part").orderBy(*order)
    for name, shift in (("before", F.lag), ("after", F.lead)):
        there = F.when(shift("host").over(w) == F.col("host"), F.struct(shift("path").over(w).alias("path"), shift("content").over(w).alias("content")))
        both = both.withColumn(name, there)
    both = both.where("own").select("host", "content", "before", "after", _common("path", "before.path").alias("b"), _common("path", "after.path").alias("a"))
    return both.select("host", "content", F.when(F.col("a") > F.col("b"), F.col("after.content")).otherwise(F.col("before.content")).alias("near"))


def _named(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _parsed(pages: DataFrame, schema: str) -> DataFrame:
    """Of every page the columns of ``schema``: page_id, url, host, path; lines and inside: those that the markup leaves and whether an article holds each; content and hashes: the names of all and of each."""
    names = [c.split()[0] for c in schema.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            left = [[x[:2] for x in lines_of(page) if not x[2]] for page in b.column(4).to_pylist()]
            of = dict(zip(("page_id", "url", "host", "path"), b.columns, strict=False))
            of["inside"] = pa.array([bytes(x[1] for x in u) for u in left], pa.binary())
            of["content"] = pa.array([_named(repr(u)) for u in left], pa.int64())
            if "lines" in names:  # white space inside a line is one space, so no line has a line feed
                of["lines"] = pa.array(["\n".join(x[0] for x in u) for u in left], pa.string())
            if "hashes" in names:
                of["hashes"] = pa.array([np.array([_named(x[0]) for x in u], np.int64).tobytes() for u in left], pa.binary())
            yield pa.RecordBatch.from_arrays([of[n] for n in names], names)

    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return p.mapInArrow(parse, schema)


def differences(pages: DataFrame) -> DataFrame:
    """(host, content, gone): the places of the lines that each content of a host shares with its nearest neighbour, if it shares any."""
    keys = materialize(_parsed(pages, "page_id long, host string, path string, content long, hashes binary, inside binary").where("length(inside) > 0"), "lines")
    near = materialize(neighbours(keys.select("host", "path", "page_id", "content")).where("near is not null"), "neighbours")
    # pages of one content have the same lines, so any of them will do
    of = keys.groupBy("host", "content").agg(F.first(F.struct("hashes", "inside")).alias("own"))
    pairs = near.join(of, ["host", "content"]).join(of.select("host", F.col("content").alias("near"), F.col("own").alias("other")), ["host", "near"])

    def difference(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = [c.to_pylist() for c in b.columns[2:]]
            of = [(np.frombuffer(u, np.int64).tolist(), v) for u, v in ((x, y) for k in (0, 2) for x, y in zip(columns[k], columns[k + 1], strict=True))]
            gone = [sorted(deleted(*own, *other)) for own, other in zip(of[: b.num_rows], of[b.num_rows :], strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(gone, pa.list_(pa.int32()))], ["host", "content", "gone"])

    pairs = pairs.select("host", "content", "own.hashes", "own.inside", F.col("other.hashes").alias("other_hashes"), F.col("other.inside").alias("other_inside"))
    out = materialize(pairs.mapInArrow(difference, "host string, content long, gone array<int>").where("size(gone) > 0"), "differences")
    discard(keys, near)
    return out


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_restored of every page.

    ``n_restored``: lines of the text that the nearest page has too, and that only the
    markup keeps, as they are an article's.  A null html is an empty page and has an empty
    text; a null url stands with the empty host; a page without a neighbour of its host loses
    only what its own markup condemns; repeated rows are pages of their own, and tell nothing
    about one another; an empty table gives an empty result; other columns are not read.
    """

    def text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out, restored = [], []
            for lines, inside, gone in zip(*(c.to_pylist() for c in b.columns[2:]), strict=True):
                own, gone = lines.split("\n"), set(gone or ())
                keep = checked(inside, gone)
                out.append("\n".join(own[i] for i in keep))
                restored.append(len(gone.intersection(keep)))
            yield pa.RecordBatch.from_arrays([*b.columns[:2], pa.array(out, pa.string()), pa.array(restored, pa.int64())], ["page_id", "url", "text", "n_restored"])

    whole = _parsed(pages, "page_id long, url string, host string, content long, lines string, inside binary").join(differences(pages), ["host", "content"], "left")
    whole = whole.select("page_id", "url", "lines", "inside", "gone").mapInArrow(text, "page_id long, url string, text string, n_restored long")
    return whole.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"), "n_restored")
