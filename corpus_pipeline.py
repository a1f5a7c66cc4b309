"""From raw documents to token ids in five stages, each one of the operators of driftlens.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet in the shared folder and
reads it again as the next stage's docs. All but the last return the columns of documents. Rows are told apart by a 64-bit
digest of what their verdict depends on, not by doc_id: a row whose doc_id is null or repeated is judged like any other. Two
different rows share a digest once in 1.8e19 pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlens.llm import bpe, decontamination, near_duplicates, pii, quality_classifier
from driftlens.llm.cluster import small, stored, table

#: No SQL expresses the fitted stages; tests hold them against brute force instead.
ORACLE_SQL = None


#: Column of a row's digest.
ROW = "_row"


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """docs with the digest of some columns, nulls told from empty strings."""
    return docs.withColumn(ROW, F.xxhash64(*(x for c in columns for x in (F.col(c).isNull(), F.coalesce(F.col(c).cast("string"), F.lit(""))))))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs, keyed, less those whose digest is in the one column of rows."""
    gone = small(stored(rows.toDF("gone").distinct(), "gone"))
    return docs.join(gone, docs[ROW] == gone.gone, "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps; its verdict depends on text, source and lang."""
    rows = keyed(docs, "text", "source", "lang")
    verdicts = quality_classifier.classify(rows, table(spark, sf_dir, "labels"), also=[ROW])
    return without(rows, verdicts.where("not kept").select(ROW)).drop(ROW)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, that with the least doc_id, null being the last.

    Texts without words are no copies of each other; of rows with the same doc_id and such a text one stays.
    """
    rows = keyed(docs, "doc_id", "text")
    classes = stored(near_duplicates.near_duplicates(rows.withColumn("doc_id", F.col(ROW))).withColumnRenamed("doc_id", ROW), "classes")
    linked = classes.where("n_links > 0").select(ROW, "class_id").distinct()
    named = linked.join(rows.select(ROW, "doc_id").distinct(), ROW)
    least = named.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", ROW)).alias("least"))
    left = without(rows, linked.join(least.select(F.col(f"least.{ROW}").alias(ROW)), ROW, "left_anti").select(ROW))
    repeated = stored(classes.groupBy(ROW).count().where("count > 1").select(ROW), "repeated")
    if repeated.isEmpty():
        return left.drop(ROW)
    again = left.join(small(repeated), ROW, "left_semi").select(left.columns)
    copies = F.col("doc_id").isNotNull() | F.coalesce("text", F.lit("")).rlike(r"\S")
    return without(left, repeated).unionByName(again.where(copies).dropDuplicates([ROW])).unionByName(again.where(~copies)).drop(ROW)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; the verdict depends on the text."""
    rows = keyed(docs, "text")
    found = decontamination.decontaminate(rows.withColumn("doc_id", F.col(ROW)), table(spark, sf_dir, "benchmark"))
    return without(rows, found.where("contaminated").select("doc_id")).drop(ROW)


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts replaced."""
    return pii.sanitise(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and of the decoded text."""
    return bpe.encode_decode(docs)


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", deduplicate),
    ("benchmark decontamination", decontaminate),
    ("PII", sanitise),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
