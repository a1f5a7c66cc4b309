"""LM scoring (operator 6): log10 probability and perplexity of whole texts under a Kneser-Ney model of the training rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import prepare, table, text_bytes
from .kneser_ney import Model, fit, reader
from .words import bounded, tokens

FOLDS, HELD_OUT = 7, 2


def held_out(doc_id: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo FOLDS, is HELD_OUT; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS == HELD_OUT


def score(docs: DataFrame, model: Model, text: str = "t", keep: tuple[str, ...] = ("doc_id", "held_out")) -> DataFrame:
    """Adds n_tokens, n_known, base_score, score and perplexity to the kept columns of docs; text is a binary column.

    A null or empty text has one token, its end. Repeated rows are scored alike, ties can't arise.
    """
    prepare(docs.sparkSession)
    told = model.json()
    frame = docs.select(*keep, F.col(text).alias("t"))
    fields = {f.name: f.dataType.simpleString() for f in frame.schema if f.name in keep}
    schema = ", ".join([*(f"`{k}` {v}" for k, v in fields.items()), "n_tokens long, n_known long, base_score double, score double, perplexity double"])

    def run(batches):
        for b in bounded(batches, "t"):
            tok, counts = tokens(b.column("t").to_pylist())
            got = reader(told).score(tok, counts)
            cols = [b.column(k) for k in fields] + [pa.array(counts), pa.array(got["n_known"]), pa.array(got["base_score"]), pa.array(got["score"]), pa.array(10 ** (-got["score"] / counts))]
            yield pa.RecordBatch.from_arrays(cols, names=[*fields, "n_tokens", "n_known", "base_score", "score", "perplexity"])

    return frame.mapInArrow(run, schema)


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", held_out().alias("held_out"), text_bytes().alias("t"))
    model = fit(docs.where("not held_out"))
    return score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", "perplexity")
