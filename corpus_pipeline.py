"""A corpus pipeline: quality, toxicity, line dedup, near duplicates, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last
return the columns of documents. Rows with a null doc_id pass the filters; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quaylark.llm.common import fresh, released, staged, table
from quaylark.llm.hilbert_packing import pack
from quaylark.llm.line_dedup import without_duplicate_lines
from quaylark.llm.quality import score_quality
from quaylark.llm.queries import NEAR_LINES, held_out
from quaylark.llm.signature_join import jaccard_components
from quaylark.llm.toxicity import train, without_toxic


def plain(docs: DataFrame) -> list:
    """The columns of docs, whatever their names hold."""
    return [F.col(f"`{c}`") for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Rows that repeat a doc_id are judged each by its own text."""
    found = keyed(docs)
    rows, key = found or (docs, "doc_id")
    labels = table(spark, sf_dir, "labels")
    if found:
        # a label is for the id, so for each of its rows
        labels = labels.join(rows.select("doc_id", key), "doc_id").drop("doc_id")
    scores = score_quality(rows, labels, id_col=key)
    bad = scores.where("good = 0").select(F.col("doc_id").alias(key)).distinct()
    return rows.join(bad, key, "left_anti").select(*plain(docs))


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    return without_toxic(docs, train(docs, table(spark, sf_dir, "labels").where(~held_out())))


def keyed(docs: DataFrame) -> tuple[DataFrame, str] | None:
    """Where a doc_id repeats: docs with a long column that tells its rows apart, in the order of (doc_id,
    text), and that column's name; null doc_ids keep a null. None where no doc_id repeats."""
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count():
        return None
    key = fresh(docs, "row")
    # ids rise along the sorted partitions; written, as they are not drawn twice alike
    rows = docs.orderBy("doc_id", "text").withColumn(key, F.monotonically_increasing_id())
    return staged(rows.withColumn(key, F.when(F.col("doc_id").isNotNull(), F.col(key)))), key


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines with an earlier match go, and documents of which nothing is left. Rows that repeat a doc_id
    are documents of their own, earlier by text."""
    if found := keyed(docs):
        rows, key = found
        return without_duplicate_lines(rows, id_col=key, percent=NEAR_LINES).select(*plain(docs))
    return without_duplicate_lines(docs, percent=NEAR_LINES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component stays. Rows that repeat a doc_id are documents
    of their own, the smallest text first; of rows with the same id and text, one stays."""
    found = keyed(docs)
    rows, key = found or (docs, "doc_id")
    gone = jaccard_components(rows, id_col=key).where("component_id <> id").select(F.col("id").alias(key)).distinct()
    out = rows.join(gone, key, "left_anti")
    if found:
        # of rows with an id and text, the first by key; blank ones too, which link with nothing
        first = out.where("doc_id is not null").groupBy("doc_id", "text").agg(F.min(key).alias(key)).select(key)
        out = out.where("doc_id is null").unionByName(out.join(first, key, "left_semi"))
    return out.select(*plain(docs))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 2048 tokens."""
    return pack(docs)


STAGES = [("quality", quality), ("toxicity", toxicity), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("packing", packing)]
#: Trained classifiers and the tokenizer aren't SQL. Tests hold the rows of toxicity, line_dedup, near_duplicates and
#: packing against brute force, and those of quality against the scores of its operator.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to documents; each stage's rows are written and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir))
        # what a stage has read goes
        released(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
