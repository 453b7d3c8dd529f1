"""The registered queries of the operators and, where SQL can express them, their DuckDB oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fusegrid.llm import ann, chat, html, langid, lexical, linededup, media, metric, mixing, ngramjoin, packing, urlfilter
from fusegrid.llm.setjoin import Threshold


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


CONFLICT = "\\### Assistant: </turn> ok"


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONFLICT).alias("text"))
    return chat.read_back(chat.format_turns(turns.unionByName(own)))


def op4_urlfilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(_table(spark, sf_dir, "pages"))


def op5_ngramjoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngramjoin.join(_table(spark, sf_dir, "documents"), width=3, threshold=Threshold(90, 100))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings")
    return ann.search(v, v.where("vec_id % 100 = 0"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(_table(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.copies(media.drawn_from(_table(spark, sf_dir, "embeddings")))


def op10_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op11_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _table(spark, sf_dir, "embeddings").select("vec_id", metric.fixed_point("embedding").alias("vector"))
    return metric.search(v, v.where("vec_id % 50 = 0"))


QUERIES = {"op1_packing": op1_packing, "op2_mixing": op2_mixing, "op3_chat": op3_chat, "op4_urlfilter": op4_urlfilter, "op5_ngramjoin": op5_ngramjoin, "op6_html": op6_html, "op7_ann": op7_ann, "op8_langid": op8_langid, "op9_media": op9_media, "op10_linededup": op10_linededup, "op11_lexical": op11_lexical, "op12_metric": op12_metric}

_OP3 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, contains(text, '\') OR contains(text, '###') OR contains(text, '</turn>') AS odd FROM t),
f AS (
  SELECT *, length(text) + CASE WHEN NOT odd THEN 0 ELSE
      length(text) - length(replace(text, '\', ''))
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '###+'), lambda x: length(x))), 0)
    + (length(text) - length(replace(text, '</turn>', ''))) / 7
    + (length(text) - length(replace(text, ': ', ''))) / 2 END AS body FROM e)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(4 + length(role) + 2 + body + 8) AS BIGINT) AS formatted_chars
FROM f GROUP BY conv_id
"""

_OP4 = """
WITH u AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule FROM h)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN list_has_any(string_split(host, '.'), ['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) THEN 'block'
  ELSE 'allow' END AS verdict FROM r
"""

_TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_OP11 = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}') AS terms FROM documents),
c AS (SELECT count(*) FILTER (len(terms) > 0) AS nd, sum(len(terms))::BIGINT AS nt FROM d),
i AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM}')) AS term FROM benchmark) GROUP BY ALL),
f AS (SELECT doc_id, row, n, term, count(*) AS tf FROM (SELECT doc_id, row, len(terms) AS n, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nd) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM f, c GROUP BY term),
p AS (SELECT doc_id, row, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt))) AS impact FROM f JOIN w USING (term), c),
s AS (SELECT item_id, row, doc_id, sum(times * impact)::BIGINT AS score FROM i JOIN p USING (term) GROUP BY ALL HAVING sum(times * impact) > 0),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

_OP12 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
r AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score,
  CAST(row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.v, c.v) DESC, c.vec_id) AS INTEGER) AS rank
  FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

ORACLES = {"op3_chat": _OP3, "op4_urlfilter": _OP4, "op11_lexical": _OP11, "op12_metric": _OP12}
