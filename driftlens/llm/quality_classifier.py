"""Quality classifier (operator 8): document evidence combined with host and path posteriors by hierarchical empirical Bayes.

1. Evidence. Two logistic regressions (quality; toxic) over shape features and the words that tell classes apart, fitted on
   at most SAMPLE labelled documents, those with the least hash of doc_id; every document is then scored whole.
2. Sites. Labels, and the classifier's probabilities where there are none, are summed over all documents by path (source and
   lang) and by host (source). A host's rate is drawn toward the global rate, and a path's toward its host's, by a
   strength (a number of pseudo-documents) estimated from how much sites differ beyond chance; sparse sites follow what is above.
3. Posterior. A document's log odds are the classifier's, with the global prior's log odds replaced by its path's.
A document is kept if its posterior of quality is at least 1/2 and that of toxic is at most 1/2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import prepare, stored, table, text_bytes
from .words import bounded, hashed, sums

#: Labelled documents to fit on, words in the model, least documents of the sample with such a word, and L2 penalty.
SAMPLE, WORDS, LEAST, PENALTY = 12_000, 4096, 3, 0.2
#: Bounds of the strength of shrinkage, in pseudo-documents, and of probabilities.
WEAKEST, STRONGEST, EDGE = 2.0, 10_000.0, 1e-6
SHAPE = ["upper", "symbols", "pipes", "bangs", "digits", "repeats", "variety", "word_length", "log_words", "dup_lines"]


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int32)
    out[list(chars)] = 1
    return out


UPPER, LOWER, SYMBOL, PIPE, BANG, DIGIT = (_class(c) for c in (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"#*$%&<>", b"|", b"!", b"0123456789"))


def shape(texts: list[bytes], tok: np.ndarray, counts: np.ndarray, distinct: np.ndarray) -> np.ndarray:
    """A row of SHAPE features for each text; shares lie between 0 and 1."""
    raw = np.frombuffer(b"".join(texts), dtype=np.uint8)
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    share = lambda cls, of: sums(cls[raw], begins, ends) / np.maximum(of, 1)
    letters = sums(UPPER[raw], begins, ends) + sums(LOWER[raw], begins, ends)
    word_ends = np.cumsum(counts)
    word_begins = word_ends - counts
    same = np.zeros(len(tok), dtype=np.int64)
    same[1:] = tok[1:] == tok[:-1]
    same[word_begins[counts > 0]] = 0
    n = np.maximum(counts, 1)
    lines = np.array([(len(x), len(set(x))) for x in (t.split(b"\n") for t in texts)], dtype=np.int64).reshape(-1, 2)
    return np.stack([share(UPPER, letters), np.minimum(share(SYMBOL, n), 3) / 3, np.minimum(share(PIPE, n), 1), np.minimum(share(BANG, n), 2) / 2, share(DIGIT, sizes), sums(same, word_begins, word_ends) / n, distinct / n, np.minimum(sizes / n, 40) / 40, np.log1p(counts) / 12, (lines[:, 0] - lines[:, 1]) / np.maximum(lines[:, 0], 1)], axis=1)


def distinct_words(tok: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct words of each text, text by text, and their numbers."""
    parts = [np.unique(tok[e - n : e]) for e, n in zip(np.cumsum(counts).tolist(), counts.tolist(), strict=True)]
    return (np.concatenate(parts) if parts else tok[:0]), np.array([len(p) for p in parts], dtype=np.int64)


@dataclass
class Head:
    """Weights of the bias, the shape features and the words; rate is the class's share in the sample."""

    weights: np.ndarray
    rate: float


def regression(x: np.ndarray, rows: np.ndarray, cols: np.ndarray, y: np.ndarray, width: int) -> np.ndarray:
    """L2-penalised logistic regression on dense columns x and binary entries (rows, cols): damped Newton steps, each by conjugate gradients."""
    n, dense = x.shape
    into = lambda v: x @ v[:dense] + np.bincount(rows, weights=v[dense:][cols], minlength=n)
    back = lambda e: np.concatenate([x.T @ e, np.bincount(cols, weights=e[rows], minlength=width)])
    penalty = np.concatenate([np.full(dense, PENALTY / 100), np.full(width, PENALTY)])
    loss = lambda z, w: np.logaddexp(0, z).sum() - y @ z + 0.5 * penalty @ (w * w)
    w = np.zeros(dense + width)
    z = into(w)
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        g = back(p - y) + penalty * w
        if np.abs(g).max() < 1e-3:
            break
        s = np.maximum(p * (1 - p), 1e-6)
        step, r = np.zeros_like(w), -g
        d, rr = r.copy(), r @ r
        for _ in range(40):
            hd = back(s * into(d)) + penalty * d
            a = rr / (d @ hd)
            step, r = step + a * d, r - a * hd
            if (new := r @ r) < 1e-4 * (g @ g):
                break
            d, rr = r + new / rr * d, new
        dz, t, now = into(step), 1.0, loss(z, w)
        while t > 1e-3 and loss(z + t * dz, w + t * step) > now:
            t /= 2
        w, z = w + t * step, z + t * dz
    return w


def fit(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, dict[str, Head]]:
    """Words of the model (ascending hashes) and a head for quality and for toxic, from the bounded sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic")).where("doc_id is not null and quality in (0, 1) and toxic in (0, 1)")
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)

    def features(batches):
        for b in bounded(batches, "t"):
            texts = b.column("t").to_pylist()
            tok, counts = hashed(texts, lower=True)
            words, n = distinct_words(tok, counts)
            dense = shape(texts, tok, counts, n)
            cuts = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in dense], type=pa.binary()), pa.array([words[e - k : e].tobytes() for e, k in zip(cuts, n, strict=True)], type=pa.binary()), b.column("quality"), b.column("toxic")], names=["dense", "words", "quality", "toxic"])

    once = docs.select("doc_id", "t").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality", "toxic").agg(F.min("t").alias("t"))  # of repeated ids one text
    rows = once.select("t", "quality", "toxic").mapInArrow(features, "dense binary, words binary, quality int, toxic int")
    dense, lists, marks = [], [], []
    for r in rows.toLocalIterator():  # SAMPLE rows at most, a partition's at a time in the driver's JVM
        dense.append(np.frombuffer(r.dense))
        lists.append(np.frombuffer(r.words, dtype=np.uint64))
        marks.append((r.quality, r.toxic))
    if not marks:
        return np.zeros(0, dtype=np.uint64), {}
    x = np.concatenate([np.ones((len(dense), 1)), np.stack(dense)], axis=1)
    row = np.repeat(np.arange(len(lists), dtype=np.int32), [len(w) for w in lists])
    every = np.concatenate(lists)
    del dense, lists
    words, df = np.unique(every, return_counts=True)
    words, df = words[df >= LEAST], df[df >= LEAST]
    which = np.searchsorted(words, every)
    known = which < len(words)
    known[known] = words[which[known]] == every[known]
    row, which = row[known], which[known].astype(np.int32)
    del every, known
    strength = np.zeros(len(words))
    ys = {h: np.array([m[k] for m in marks], dtype=float) for k, h in enumerate(("quality", "toxic"))}
    for y in ys.values():  # how far a word's share of a class is from the class's share, in standard deviations
        mean = y.mean()
        z = np.abs(np.bincount(which, weights=y[row], minlength=len(words)) - df * mean) / np.sqrt(df * max(mean * (1 - mean), EDGE) + 1)
        strength = np.maximum(strength, z)
    chosen = np.sort(np.argsort(-strength, kind="stable")[:WORDS])
    chosen = chosen[strength[chosen] > 0]
    place = np.full(len(words), -1)
    place[chosen] = np.arange(len(chosen))
    inside = place[which] >= 0
    row, which = row[inside], place[which[inside]]
    heads = {h: Head(regression(x, row, which, y, len(chosen)), float(np.clip(y.mean(), EDGE, 1 - EDGE))) for h, y in ys.items()}
    return words[chosen], heads


def score(docs: DataFrame, words: np.ndarray, heads: dict[str, Head], keep: list[str]) -> DataFrame:
    """Adds quality and toxic, the classifier's log odds, to the kept columns of docs."""
    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keep), "quality double, toxic double"])
    models = [(heads[h].weights if h in heads else np.zeros(1 + len(SHAPE))) for h in ("quality", "toxic")]

    def run(batches):
        for b in bounded(batches, "t"):
            texts = b.column("t").to_pylist()
            tok, counts = hashed(texts, lower=True)
            ends = np.cumsum(counts)
            doc = np.repeat(np.arange(len(texts)), counts)
            order = np.argsort(tok)
            ranked = tok[order]
            # distinct words of each text: by word, then text
            pair = np.lexsort((doc[order], ranked)) if len(tok) else order
            w, d = ranked[pair], doc[order][pair]
            new = np.ones(len(w), dtype=bool)
            new[1:] = (w[1:] != w[:-1]) | (d[1:] != d[:-1])
            w, d = w[new], d[new]
            dense = np.concatenate([np.ones((len(texts), 1)), shape(texts, tok, counts, np.bincount(d, minlength=len(texts)))], axis=1)
            at = np.searchsorted(words, w)
            at[at == len(words)] = 0
            hit = words[at] == w if len(words) else np.zeros(len(w), dtype=bool)
            d, at = d[hit], at[hit]
            logits = [dense @ m[: dense.shape[1]] + np.bincount(d, weights=m[dense.shape[1] :][at], minlength=len(texts)) if len(d) else dense @ m[: dense.shape[1]] for m in models]
            assert len(ends) == len(texts)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keep), *(pa.array(z) for z in logits)], names=[*keep, "quality", "toxic"])

    return docs.select(*keep, "t").mapInArrow(run, schema)


def logit(p: Column) -> Column:
    p = F.greatest(F.least(p, F.lit(1 - EDGE)), F.lit(EDGE))
    return F.log(p / (1 - p))


def strength(sites: DataFrame, mean: float) -> float:
    """Moment estimate of the beta prior's strength from the spread of the sites' rates about the mean; one row of sums to the driver."""
    m = F.lit(mean)
    got = sites.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("nn"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - m, 2)).alias("ss"), F.count("*").alias("k")).first()
    spread = mean * (1 - mean)
    if not got.n or got.k < 2 or spread <= 0:
        return STRONGEST
    between = (got.ss - (got.k - 1) * spread) / (got.n - got.nn / got.n) if got.n > got.nn / got.n else 0.0
    return float(min(max(spread / between - 1, WEAKEST), STRONGEST)) if between > 0 else STRONGEST


def classify(docs: DataFrame, labels: DataFrame, also: list[str] | None = None) -> DataFrame:
    """doc_id, text, lang and source, with labels (doc_id, quality, toxic), to the posteriors; a row for each row of docs.

    A null text counts as empty; null lang or source are a site of their own; a null doc_id has no label; labels with nulls
    don't count, and of repeated ones the larger does. Without labels every document has the prior 1/2 and is kept. Of other
    columns of docs those of also (longs) come back with the rows; the rest are not read.
    """
    prepare(docs.sparkSession)
    also = also or []
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("source", F.lit("")).alias("host"), F.coalesce("lang", F.lit("")).alias("path"), text_bytes().alias("t"), *also)
    words, heads = fit(docs, labels)
    scored = stored(score(docs, words, heads, ["doc_id", "host", "path", *also]), "quality")
    known = labels.where("quality in (0, 1) and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("q"), F.max("toxic").alias("x"))
    out = scored
    marked = scored.join(known, "doc_id", "left")
    for head, label in (("quality", "q"), ("toxic", "x")):
        rate = heads[head].rate if head in heads else 0.5
        chance = 1 / (1 + F.exp(-F.col(head)))
        paths = stored(marked.groupBy("host", "path").agg(F.sum(F.coalesce(F.col(label).cast("double"), chance)).alias("good"), F.count("*").alias("n")), "sites")
        hosts = paths.groupBy("host").agg(F.sum("good").alias("good"), F.sum("n").alias("n"))
        total = hosts.agg(F.sum("good") / F.sum("n")).first()[0]
        mean = float(min(max(total if total is not None else 0.5, EDGE), 1 - EDGE))
        k_host, k_path = strength(hosts, mean), strength(paths, mean)
        hosts = hosts.select("host", ((F.col("good") + k_host * mean) / (F.col("n") + k_host)).alias("host_rate"))
        rates = paths.join(hosts, "host").select("host", "path", ((F.col("good") + k_path * F.col("host_rate")) / (F.col("n") + k_path)).alias(f"{head}_site"))
        out = out.join(rates, ["host", "path"], "left").withColumn(f"p_{head}", 1 / (1 + F.exp(-(F.col(head) - logit(F.lit(rate)) + logit(F.col(f"{head}_site"))))))
    return out.select("doc_id", "p_quality", "p_toxic", ((F.col("p_quality") >= 0.5) & (F.col("p_toxic") <= 0.5)).alias("kept"), "quality_site", "toxic_site", *also)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
