"""Mixing sources to target weights, with DataFrame functions alone.

The words of each source form streams (one for each bucket of documents, so that no
window holds more than about the square root of a source's documents), streams are
cut into blocks of ``BLOCK`` words, and blocks are numbered through within a source.
The output is shards of ``SHARD`` slots.  Each shard draws its slots' sources from
the multinomial distribution of the target shares; a source's draws beyond its share
are given to sources short of theirs.  A source's k-th slot is mapped through a
pseudorandom permutation of its block numbers (once round for each full use), and
blocks are joined by (source, number).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fusegrid.plans.scratch import materialize

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0
BLOCK, SHARD = 128, 16384
#: Documents of one stream: the square root of the source's, and this many at least.
STREAM_DOCS = 256
ROUNDS, CELLS = 8, 1024
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """The number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _below(n: Column, *of: Column | str) -> Column:
    """A pseudorandom number in [0, n)."""
    return F.pmod(F.xxhash64(*[F.lit(x) if isinstance(x, str) else x for x in of]), n)


def sources_table(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: sid, source, source_size, n_docs, target.

    ``sid`` numbers sources by code point, null last; weights repeat in that order.
    Targets are ``min(most * size, level * weight)`` with the level at which they sum to
    ``share`` of all words: what is left when the excess over the caps has been
    reshared by weight until none is above.
    """
    by_name = W.orderBy(F.col("source").isNull(), "source")
    t = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    t = t.withColumn("sid", F.row_number().over(by_name) - 1)
    t = t.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.col("sid") % len(weights) + 1).cast("int")))
    t = t.withColumn("cap", F.col("source_size") * most).withColumn("ratio", F.col("cap") / F.col("w"))
    line = W.orderBy("ratio", "sid")
    capped = F.coalesce(F.sum("cap").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    free = F.sum("w").over(line.rowsBetween(0, W.unboundedFollowing))
    every = W.partitionBy(F.lit(0))
    t = t.withColumn("level", (F.sum("source_size").over(every) * share - capped) / free)
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio") * (1 + 1e-12), F.struct("ratio", "sid", "level"))).over(every)["level"])
    return t.select("sid", "source", "source_size", "n_docs", F.least("cap", F.col("level") * F.col("w")).alias("target"))


def permuted(k: Column, n: Column, sid: Column, seed: int) -> Column:
    """A keyed pseudorandom permutation of [0, n) at k, by ROUNDS swap-or-not steps.

    The steps are a fold, so the expression does not grow with their number.
    """

    def step(x: Column, r: Column) -> Column:
        y = F.pmod(_below(n, F.lit(seed), r, sid, "key") - x, n)
        return F.when(F.pmod(F.xxhash64(F.lit(seed), r, sid, F.greatest(x, y)), F.lit(2)) == 1, y).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), k, step)


def _streams(sized: DataFrame, sources: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents with their stream and first word there; streams with their first block number."""
    per = F.greatest(F.lit(float(STREAM_DOCS)), F.sqrt(F.col("n_docs").cast("double")))
    d = sized.join(sources.select("sid", "source", F.ceil(F.col("n_docs") / per).alias("streams")).alias("s"), sized["source"].eqNullSafe(F.col("s.source")))
    d = d.select("uid", "sid", sized["size"], _below(F.col("streams"), F.col("draw"), F.col("size"), "stream").alias("stream"), F.xxhash64("draw", "size").alias("h"), "draw")
    w = W.partitionBy("sid", "stream").orderBy("h", "draw", "size", "uid")
    d = d.withColumn("first", F.sum("size").over(w) - F.col("size")).drop("h", "draw")
    s = d.groupBy("sid", "stream").agg(F.ceil(F.sum("size") / BLOCK).alias("n"))
    return d, s.withColumn("base", F.sum("n").over(W.partitionBy("sid").orderBy("stream")) - F.col("n"))


def slots_table(quotas: DataFrame, seed: int) -> DataFrame:
    """(shard, sid, block): one row per output slot.  quotas: sid, quota (its slots), blocks (its blocks)."""
    spark = quotas.sparkSession
    q = quotas.where("quota > 0").withColumn("hi", F.sum("quota").over(W.orderBy("sid"))).withColumn("lo", F.col("hi") - F.col("quota"))
    total = q.agg(F.coalesce(F.max("hi"), F.lit(0)).cast("long")).first()[0]
    shards = max(1, -(-total // SHARD))
    draws = spark.range(total).select(F.floor(F.col("id") / SHARD).alias("shard"), _below(F.lit(max(total, 1)), F.lit(seed), F.col("id"), "draw").alias("v"))
    cell = lambda v: F.floor(v * float(CELLS) / max(total, 1))
    grid = q.select("sid", "lo", "hi", F.explode(F.sequence(cell(F.col("lo")), cell(F.col("hi") - 1))).alias("cell"))
    counts = draws.withColumn("cell", cell(F.col("v"))).join(grid, "cell").where("v >= lo and v < hi").groupBy("shard", "sid").agg(F.count(F.lit(1)).alias("m"))
    by_shard = counts.withColumn("c0", F.sum("m").over(W.partitionBy("sid").orderBy("shard")) - F.col("m")).join(quotas.select("sid", "quota"), "sid")
    kept = by_shard.where("c0 < quota").select("sid", "shard", "c0", F.least("m", F.col("quota") - F.col("c0")).alias("n"))
    # a source's shards are dealt out again before their slots are written out one by one
    # (a stated number of partitions is not merged again, few as the shards' rows are)
    kept = kept.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sid", "shard").select("sid", "shard", F.explode(F.sequence(F.col("c0"), F.col("c0") + F.col("n") - 1)).alias("k"))
    drawn = quotas.where("quota > 0").join(counts.groupBy("sid").agg(F.sum("m").alias("drawn")), "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    short = drawn.where("drawn < quota").select("sid", F.explode(F.sequence(F.col("drawn"), F.col("quota") - 1)).alias("k"))
    short = short.select("sid", _below(F.lit(shards), F.lit(seed), F.col("sid"), F.col("k"), "shard").alias("shard"), "k")
    slots = kept.union(short).join(quotas.select("sid", "blocks"), "sid")
    return slots.select("shard", "sid", permuted(F.pmod("k", "blocks"), F.col("blocks"), F.col("sid"), seed).alias("block"))


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: int = 17, spans: bool = False, draw_column: str | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words in the mix, repeats counted).

    ``spans`` also returns uid-ordered ``spans``: structs (first word, words, times) of the
    document's blocks.  Null texts have size 0 and are never taken; null sources are
    one source; rows that repeat an id are separate documents; an empty table gives an
    empty result; columns with other names are not read.  The same rows give the same mix
    in every run: order and draws come from hashes of ids (or of ``draw_column``) and of the seed.
    """
    rows = docs.select(F.col(id_column).alias("doc_id"), F.col(draw_column or id_column).alias("draw"), F.col(source_column).cast("string").alias("source"), size_of(F.col(text_column)).alias("size"))
    sized = materialize(rows.withColumn("uid", F.monotonically_increasing_id()), "sizes")
    sources = materialize(sources_table(sized, weights, share, most), "sources")
    streams, numbered = _streams(sized, sources)
    streams, numbered = materialize(streams, "streams"), materialize(numbered, "blocks")
    blocks = numbered.groupBy("sid").agg(F.sum("n").cast("long").alias("blocks"))
    quotas = sources.join(blocks, "sid").select("sid", "blocks", F.when(F.col("source_size") > 0, F.round(F.col("target") * F.col("blocks") / F.col("source_size"))).otherwise(0).cast("long").alias("quota"))
    slots = slots_table(materialize(quotas, "quotas"), seed)
    used = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    d = streams.join(numbered.select("sid", "stream", "base"), ["sid", "stream"]).where("size > 0")
    d = d.withColumn("piece", F.explode(F.sequence(F.floor(F.col("first") / BLOCK), F.floor((F.col("first") + F.col("size") - 1) / BLOCK))))
    d = d.select("uid", "sid", (F.col("base") + F.col("piece")).alias("block"), F.greatest(F.col("piece") * BLOCK - F.col("first"), F.lit(0)).alias("at"), F.least((F.col("piece") + 1) * BLOCK - F.col("first"), F.col("size")).alias("to"))
    hit = d.join(used, ["sid", "block"])
    what = [F.sum((F.col("to") - F.col("at")) * F.col("times")).alias("taken")]
    if spans:
        what.append(F.sort_array(F.collect_list(F.struct("at", (F.col("to") - F.col("at")).alias("n"), "times"))).alias("spans"))
    taken = hit.groupBy("uid").agg(*what)
    s = sources.select(F.col("source").alias("_source"), "source_size", "target")
    out = sized.join(taken, "uid", "left").join(s, F.col("source").eqNullSafe(F.col("_source")))
    return out.select("uid", "doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *["spans"] * spans)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents with the columns doc_id, text, lang, source, n_chars.

    A document is there once for each time it is used; the k-th copy holds the words of
    all its blocks that are used k times or more, with the white space after each word.
    """
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    held = materialize(docs.select(*columns, F.xxhash64(*columns).alias("_draw"), F.monotonically_increasing_id().alias("_row")), "mixdocs")
    # the row number keeps rows with equal ids apart; draws go by the rows' contents, so they do not depend on the partitions
    plan = mix(held, id_column="_row", draw_column="_draw", spans=True, **options).where("taken > 0").select(F.col("doc_id").alias("_row"), "size", "spans")
    d = held.join(plan, "_row")
    d = d.withColumn("copy", F.explode(F.sequence(F.lit(1), F.array_max(F.col("spans.times")))))
    d = d.withColumn("part", F.filter("spans", lambda s: s["times"] >= F.col("copy")))
    d = d.withColumn("n", F.aggregate("part", F.lit(0).cast("long"), lambda a, s: a + s["n"]))
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+[\x20\x09-\x0D]*)"), 1)
    cut = F.aggregate(F.transform("part", lambda s: F.array_join(F.slice(F.col("words"), (s["at"] + 1).cast("int"), s["n"].cast("int")), "")), F.lit(""), lambda a, x: F.concat(a, x))
    d = d.withColumn("words", F.when(F.col("n") < F.col("size"), words))
    d = d.withColumn("text", F.when(F.col("n") < F.col("size"), cut).otherwise(F.col("text")))
    return d.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))
