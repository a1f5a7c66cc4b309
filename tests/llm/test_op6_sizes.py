"""Runs and models of op6 take few bytes, and hold counts of any size."""

import glob
import math
import os

import numpy as np
import pytest

from driftlens.llm import kneser_ney, lm_scoring
from driftlens.llm.cluster import text_bytes
from driftlens.llm.words import tokens

R = np.random.default_rng(3)


def test_runs_are_small_and_whole():
    keys = np.unique(R.integers(0, 1 << 64, 40_000, dtype=np.uint64))
    vals = np.where(R.random(len(keys)) < 0.01, 1 << 40, 1).astype(np.int64)
    got = list(kneser_ney._runs("bi", 4, keys, vals))
    assert sum(len(k) for _, _, k, _ in got) < 7.1 * len(keys)
    back = [kneser_ney._merged("bi", [(k, v), (k, v)]) for _, _, k, v in got]
    assert (np.concatenate([k for k, _ in back]) == keys).all() and (np.concatenate([v for _, v in back])[:, 0] == 2 * vals).all()
    ones = list(kneser_ney._runs("bi", 4, keys, np.ones(len(keys), dtype=np.int64)))
    assert sum(len(k) + len(v) for _, _, k, v in ones) < 8.1 * len(keys)
    edge = np.array([0, 1, (1 << 32) - 1], dtype=np.uint32)
    for shards in (1, 2, 64):
        wide = np.array([[0, 255, 256, 1 << 33], [1, 2, 3, 4], [254, 0, 0, 65_536]])
        parts = [kneser_ney._merged("ctx", [(k, v)]) for _, _, k, v in kneser_ney._runs("ctx", shards, edge, wide)]
        assert (np.concatenate([k for k, _ in parts]) == edge).all() and (np.concatenate([v for _, v in parts]) == wide).all()


def test_models_are_small_and_whole(spark):
    often = [(k, "ab cd " * n + f"x{n}") for k, n in enumerate((1, 2, 126, 127, 128, 253, 70_000))]
    docs = spark.createDataFrame([*often, *((k, f"u{k} v{k} " * 3) for k in range(100, 4100))], "doc_id long, text string").select("doc_id", text_bytes().alias("t"))
    model = kneser_ney.fit(docs)
    words = [r.t.split() for r in docs.collect()]
    bigrams = {(a, b) for w in words for a, b in zip([b"<s>", *w], [*w, b"</s>"], strict=True)}
    size = lambda kind: sum(os.path.getsize(f) for f in glob.glob(f"{model.path}/{kind}-*"))
    assert size("bi") < 9.2 * len(bigrams)
    n = sum(k.count(b"ab") for k in words)
    ids = np.unique(tokens([b"ab cd"])[0])
    assert n > 70_000 and sorted(kneser_ney.Reader(model.json()).find("uni", ids)[:, 0].tolist()) == sorted([n, n, len(words)])
    v = len({x for w in words for x in w}) + 1
    total = sum(len(w) + 1 for w in words)
    got = lm_scoring.score(spark.createDataFrame([(1, "ab")], "doc_id long, text string").select("doc_id", text_bytes().alias("t")), model, keep=("doc_id",)).first()
    assert got.base_score == pytest.approx(math.log10((n + 1) / (total + v + 1)) + math.log10((len(words) + 1) / (total + v + 1)))
