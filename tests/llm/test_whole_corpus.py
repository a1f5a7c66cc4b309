"""The shared directions of op3 come from the passages of all documents, held against a dense eigendecomposition."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.llm import decontamination

R = random.Random(23)
WORDS = ["".join(R.choice("abcdefghijklmno") for _ in range(8)) for _ in range(260)]
prose = lambda n, seed, words: " ".join(random.Random(seed).choices(words, [1 / (k + 2) for k in range(len(words))], k=n))


def exact(texts):
    """Of all windows of LONG blocks, one beginning at every block: their features, and their first right singular vectors and values."""
    own = [decontamination.features([t.encode()])[0] for t in texts]
    counts = np.bincount(np.concatenate(own), minlength=decontamination.FEATURES)
    weight = np.log((counts.sum() + 1) / (counts + 1)) + 0.1
    used = np.flatnonzero(counts)
    place = dict(zip(used.tolist(), range(len(used)), strict=True))
    gram = np.zeros((len(used), len(used)))
    for f in own:
        for at in range(0, len(f), decontamination.BLOCK):
            part = f[at : at + decontamination.LONG * decontamination.BLOCK]
            x = np.bincount([place[k] for k in part.tolist()], minlength=len(used)) * weight[used]
            x /= np.sqrt((weight[part] ** 2).sum())
            seen = np.flatnonzero(x)
            gram[np.ix_(seen, seen)] += np.outer(x[seen], x[seen])
    values, vectors = np.linalg.eigh(gram)
    return used, vectors[:, ::-1], values[::-1], gram


def holds(shared, texts, within=0.02):
    """Each direction holds as much of the passages as the exact one does, but for a small share, and none of them lies in other features."""
    used, _, values, gram = exact(texts)
    assert shared.shape == (decontamination.FEATURES, decontamination.COMMON)
    assert np.allclose(shared.T @ shared, np.eye(decontamination.COMMON), atol=1e-3)
    assert np.abs(np.delete(shared, used, axis=0)).max() < 1e-4
    got = np.diag(shared[used].T @ gram @ shared[used])
    assert np.allclose(got, values[: decontamination.COMMON], rtol=within), (got, values[: decontamination.COMMON])


def captured(monkeypatch):
    """The shared directions that the search gets."""
    seen = []
    search = decontamination.search
    monkeypatch.setattr(decontamination, "search", lambda docs, files, space: seen.append(space.value[1]) or search(docs, files, space))
    return seen


def corpus(spark):
    """3,100 short documents, then 60 longer ones of other words whose ids come last by hash, one without an id and one that is a text of several steps."""
    ids = [r.id for r in spark.range(3160).orderBy(F.xxhash64("id"), "id").collect()]
    rows = [(i, prose(13, i, WORDS[:130])) for i in ids[:3100]]
    rows += [(i, prose(300, i, WORDS[130:200])) for i in ids[3100:]]
    return [*rows, (None, prose(2500, 1, WORDS[200:230])), (ids[5], prose(30_000, 2, WORDS[230:])), (4000, None), (4001, "")]


def test_all_documents_tell_the_shared_directions(spark, monkeypatch):
    rows, seen = corpus(spark), captured(monkeypatch)
    item = prose(40, 99, WORDS[:200])
    docs = spark.createDataFrame([*rows, (5000, prose(20, 98, WORDS) + " " + item)], "doc_id long, text string").repartition(5)
    found = decontamination.decontaminate(docs, spark.createDataFrame([(1, item)], "item_id long, text string"))
    holds(seen[0], [t for _, t in rows if t] + [prose(20, 98, WORDS) + " " + item])
    assert found.where("contaminated").select("doc_id").collect() == [(5000,)] and found.count() == len(rows) + 1


def test_all_rows_of_the_stage_tell_the_shared_directions(spark, tmp_path, monkeypatch):
    """The pipeline's stage, with rows without an id and repeated rows, dealt out in two ways."""
    pipeline = pytest.importorskip("corpus_pipeline")
    seen = captured(monkeypatch)
    item = prose(40, 97, WORDS[:200])
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(k if k % 3 else None, prose(13, k, WORDS[:130])) for k in range(3200)] + [(None, prose(400, k % 40, WORDS[130:230])) for k in range(60)] + [(7, prose(90, 5, WORDS) + " " + item)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (1, 7):
        kept = pipeline.decontaminate(spark, docs.repartition(n), str(tmp_path))
        assert kept.count() == len(rows) - 1
        holds(seen[-1], [t for _, t in rows], 0.05)
    assert np.allclose(seen[0] @ (seen[0].T @ seen[1]), seen[1], atol=1e-3)
