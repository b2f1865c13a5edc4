"""The registered query of each operator, with production parameters, over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.llm.common import table
from quaylark.llm.hilbert_packing import pack
from quaylark.llm.kdtree_topk import top_k
from quaylark.llm.licenses import scan_licenses
from quaylark.llm.line_dedup import duplicate_lines
from quaylark.llm.piecewise_hash import fingerprints
from quaylark.llm.quality import score_quality
from quaylark.llm.sentencepiece_sampling import decode, sample_segmentations
from quaylark.llm.signature_join import jaccard_components
from quaylark.llm.toxicity import score_toxicity, train
from quaylark.llm.url_reputation import judge_urls

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

#: Percent of distinct words that near lines share: a line of nine words with one replaced still matches.
NEAR_LINES = 80


def held_out(col: str = "doc_id"):
    return F.crc32(F.col(col).cast("string").cast("binary")) % 5 == 0


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op2_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document and sample: crc32 of the ids, and whether decoding gives the text back."""
    back = decode(sample_segmentations(table(spark, sf_dir, "documents"), k=2, crc=True))
    decoded = F.crc32(F.col("text").cast("binary"))
    return back.select("doc_id", "sample", "n_pieces", F.crc32("ids").alias("ids_crc32"), F.round("log_prob", 6).alias("log_prob"), F.round("log_inclusion", 6).alias("log_inclusion"), decoded.alias("decoded_crc32"), (decoded == F.col("text_crc32")).alias("round_trip"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A labelled page's outcome is good if its quality is 1 and it isn't toxic."""
    labels = table(spark, sf_dir, "labels").select("doc_id", ((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int").alias("good"))
    return judge_urls(table(spark, sf_dir, "pages"), labels, RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicate_lines(table(spark, sf_dir, "documents"), percent=NEAR_LINES).select(F.col("id").alias("doc_id"), "line_no")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    return score_toxicity(docs, grammar).withColumn("held_out", held_out()).select("doc_id", "held_out", "score", "predicted")


def op7_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "class_id")


def op9_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_sentencepiece_sampling, op3_url_filter, op4_line_dedup, op5_quality_classifier, op6_toxicity, op7_topk_search, op8_ngram_jaccard_join, op9_document_fingerprints, op10_hilbert_packing)}

_FITS = "(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
_RULES = sorted(RULES, key=lambda r: (-len(r[1]), r[1]))


def _rule_case(result) -> str:
    return "CASE " + " ".join("WHEN " + _FITS.format(host=r.partition("/")[0], path="/" + r.partition("/")[2]) + f" THEN '{result(v, r)}'" for v, r in _RULES) + " END"


_WEIGHT = """(SELECT CASE WHEN more IS NULL OR more = 0 THEN 10.0 WHEN s > noise THEN least(greatest(more / (s - noise) - 1, 1.0), 1000.0) ELSE 1000.0 END
  FROM (SELECT sum(pow(good / n - p, 2) * n) AS s, sum(p * (1 - p)) AS noise, sum(p * (1 - p) * (n - 1)) AS more FROM {level} WHERE n >= 2))"""

ORACLE_SQL = {
    "op3_url_filter": f"""
WITH base AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path FROM pages),
known AS (SELECT host, CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS good FROM base JOIN labels ON page_id = doc_id WHERE host <> ''),
parts AS (SELECT host, string_split(host, '.') AS a, good FROM known),
named AS (SELECT host, good, a[-1] AS suffix, array_to_string(a[-2:], '.') AS domain FROM parts),
total AS (SELECT (coalesce(sum(good), 0) + 1.0) / (count(*) + 2.0) AS p FROM named),
l1 AS (SELECT suffix, count(*)::DOUBLE AS n, sum(good) AS good, any_value(total.p) AS p FROM named, total GROUP BY suffix),
w1 AS (SELECT {_WEIGHT.format(level="l1")} AS w),
m1 AS (SELECT suffix, (good + w * p) / (n + w) AS mean FROM l1, w1),
l2 AS (SELECT domain, named.suffix, count(*)::DOUBLE AS n, sum(good) AS good, any_value(mean) AS p FROM named JOIN m1 ON m1.suffix = named.suffix GROUP BY domain, named.suffix),
w2 AS (SELECT {_WEIGHT.format(level="l2")} AS w),
m2 AS (SELECT domain, (good + w * p) / (n + w) AS mean FROM l2, w2),
l3 AS (SELECT host, count(*)::DOUBLE AS n, sum(good) AS good, any_value(mean) AS p FROM named JOIN m2 ON m2.domain = named.domain GROUP BY host),
w3 AS (SELECT {_WEIGHT.format(level="l3")} AS w),
m3 AS (SELECT host, n, w, (good + w * p) / (n + w) AS mean FROM l3, w3),
high AS (SELECT host, mean + 2.0 * sqrt(mean * (1 - mean) / (n + w + 1)) AS high FROM m3)
SELECT page_id, base.host, path, {_rule_case(lambda v, r: r)} AS rule,
  coalesce({_rule_case(lambda v, r: v)}, CASE WHEN high.high < 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM (SELECT page_id, host, path FROM base) AS base LEFT JOIN (SELECT host AS h, high FROM high) AS high ON base.host = high.h""",
    "op7_topk_search": """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.r <> q.r AND len(c.v) = len(q.v))
SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
QUALIFY row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) <= 10""",
    "op8_ngram_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 75 * (any_value(na.n) + any_value(nb.n) - count(*))),
r AS (SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, links.b FROM r JOIN links ON r.y = links.a),
c AS (SELECT x AS doc_id, min(y) AS component_id FROM r GROUP BY x),
sig AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS m FROM sh GROUP BY doc_id),
cls AS (SELECT m, min(doc_id) AS class_id FROM sig GROUP BY m)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, coalesce(cls.class_id, d.doc_id) AS class_id
FROM documents d JOIN c ON c.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN sig ON sig.doc_id = d.doc_id LEFT JOIN cls ON cls.m = sig.m""",
}
