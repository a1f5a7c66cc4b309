"""op3 finds and hashes the words of a text twice, not in each of its passes: once for the features that it stores, once for the search."""

import random

import numpy as np
from pyspark.sql import functions as F

from driftlens.llm import decontamination
from driftlens.llm.cluster import prepare

TEXTS = ["", "one", " \t two\x0bTHREE \n", "\u00abVier\u00bb \u2026 (f\u00fcnf)!", "!!! " * 40, "x" * 40_000 + " " + "y" * 600_000 + " z", "Z" * 16_384 + " a", " ".join(f"w{k % 977}." for k in range(70_000))]


def test_texts_are_read_twice(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    rows = [(k, " ".join(random.Random(k).choices("abcdefghij", k=70))) for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", F.udf(seen)("text").alias("text"))
    found = decontamination.decontaminate(docs, spark.createDataFrame([(1, rows[7][1])], "item_id long, text string")).collect()
    assert len(found) == 50 and [r.item_ids for r in found if r.doc_id == 7] == [[1]]
    assert read.value == 100


def test_stored_features_are_those_of_the_texts(spark):
    prepare(spark)
    docs = spark.createDataFrame([(t.encode(),) for t in TEXTS], "t binary").coalesce(1)
    rows = decontamination.featured(docs)
    got = sorted(bytes(r.f) for r in rows.collect())
    assert got == sorted(decontamination.features([t.encode()])[0].astype("<u2").tobytes() for t in TEXTS)
    counts = np.bincount(decontamination.features([t.encode() for t in TEXTS])[0], minlength=decontamination.FEATURES)
    assert (decontamination.occurrences(rows) == counts).all()
