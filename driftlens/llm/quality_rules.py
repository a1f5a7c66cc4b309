"""Quality rules (operator 9): repetition and length rules, then language-specific perplexity bands under a Kneser-Ney model.

The model's n-grams are of bytes: those of words are nearly as many as words, and their counts overran the disk. It counts
all documents. A band of a language spans its passing documents' median log10 perplexity of a byte, less
BAND times the distance to the TENTH quantile below and plus BAND times the distance to the one above; a language with fewer
than MIN_DOCS passing documents takes the band of all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import prepare, small, stored, table, text_bytes
from .char_model import fit, reader
from .words import bounded, hashed, mix, sums

#: Fixed values of the rules.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 50, 50, 3
#: Width of a band, the quantile that sets it, and documents that a language needs for its own.
BAND, TENTH, MIN_DOCS = 4.0, 0.1, 30

_IS_SYMBOL = np.zeros(256, dtype=np.int64)
_IS_SYMBOL[list(SYMBOLS)] = 1
#: First bytes of code points.
_IS_FIRST = np.array([(b & 0xC0) != 0x80 for b in range(256)], dtype=np.int64)
_IS_SPACE = np.array([b == 32 or 9 <= b <= 13 for b in range(256)], dtype=np.int64)


def repeated_words(tok: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """For each text, its words that lie in a WINDOW-word run found twice or more in that text."""
    n = len(tok) - WINDOW + 1
    if n <= 0:
        return np.zeros(len(starts), dtype=np.int64)
    doc = np.repeat(np.arange(len(starts), dtype=np.uint64), lengths)
    run = mix(mix(mix(tok[:n]) + tok[1 : n + 1]) + tok[2 : n + 2]) + mix(doc[:n] + np.uint64(1))
    inside = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    run = run[inside]
    order = np.argsort(run)
    ranked = run[order]
    same = ranked[1:] == ranked[:-1]
    hit = np.zeros(len(run), dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    cover = np.zeros(len(tok) + 1, dtype=np.int64)
    found = inside[hit]
    np.add.at(cover, found, 1)
    np.add.at(cover, found + WINDOW, -1)
    return sums((np.cumsum(cover[:-1]) > 0).astype(np.int64), starts, starts + lengths)


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return len(lines) - len(set(lines))


def features(docs: DataFrame, model_json: str | None = None) -> DataFrame:
    """doc_id, lang and a binary column t to the rule columns, and log10 perplexity of a byte when a model is given."""
    fields = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    schema = "doc_id long, lang string, " + ", ".join(f"{f} long" for f in fields) + ", log_ppl double"

    def run(batches):
        for b in bounded(batches, "t"):
            texts = b.column("t").to_pylist()
            raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
            sizes = np.array([len(t) for t in texts], dtype=np.int64)
            ends = np.cumsum(sizes)
            begins = ends - sizes
            exact, lengths = hashed(texts)
            starts = np.cumsum(lengths) - lengths
            if model_json:
                score, counts = reader(model_json).score(texts)
                ppl = -score / counts
            else:
                ppl = np.zeros(len(texts))
            cols = [
                b.column("doc_id"), b.column("lang"), pa.array(lengths),
                pa.array(sums(_IS_FIRST[raw] - _IS_SPACE[raw], begins, ends)), pa.array(sums(_IS_SYMBOL[raw], begins, ends)),
                pa.array(np.array([duplicate_lines(t) for t in texts], dtype=np.int64)), pa.array(repeated_words(exact, starts, lengths)), pa.array(ppl),
            ]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang", *fields, "log_ppl"])

    return docs.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), "t").mapInArrow(run, schema)


def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang to the rule columns, base_failed, log_ppl and kept; other columns of docs are not read.

    A null text counts as empty and fails as too short; a null lang forms a language of its own; a null doc_id stays null;
    repeated rows give repeated results.
    """
    prepare(docs.sparkSession)
    docs = docs.select("doc_id", "lang", text_bytes().alias("t"))
    model = fit(docs)
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    scored = stored(features(docs, model.json()).withColumn("base_failed", failed).withColumn("lang_key", F.coalesce("lang", F.lit(""))), "quality-rules")
    passing = scored.where("not base_failed")
    quantiles = F.percentile_approx("log_ppl", [TENTH, 0.5, 1 - TENTH], 1000).alias("q")
    overall = passing.agg(quantiles).first().q  # three numbers
    bands = passing.groupBy("lang_key").agg(quantiles, F.count("*").alias("n"))
    joined = scored.join(small(stored(bands, "quality-bands")), "lang_key", "left")  # a row for each language
    default = F.array(*(F.lit(float(x)) for x in overall)) if overall else F.lit(None).cast("array<double>")
    q = F.when(F.col("n") >= MIN_DOCS, F.col("q")).otherwise(default)
    low, mid, high = (F.element_at(q, i) for i in (1, 2, 3))
    inside = F.col("log_ppl").between(mid - BAND * (mid - low), mid + BAND * (high - mid))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"), "log_ppl", "lang")


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))
