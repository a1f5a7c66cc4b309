"""Kneser-Ney models against plain recounts."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftlens.llm import char_model, kneser_ney, lm_scoring, quality_rules
from driftlens.llm.cluster import text_bytes
from driftlens.llm.words import mix, unmix

DOCS = [(0, "The cat sat on the mat.\nThe cat ran"), (1, "the dog sat on the log"), (2, None), (3, ""), (4, "a b a b a b É é"), (5, "the cat sat on the mat and the dog ran to the log " * 5), (5, "the dog"), (None, "a cat\x0bsat")]
SCHEMA = "doc_id long, text string"


def words(text):
    return re.findall("[^\\x20\\x09-\\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def test_mix_is_a_bijection():
    x = np.random.default_rng(1).integers(0, 1 << 63, 1000, dtype=np.uint64)
    assert (unmix(mix(x)) == x).all()
    y = x.astype(np.uint32)
    assert (char_model.unmixed(char_model.mixed(y)) == y).all()


def brute(train, texts):
    big, uni = Counter(), Counter()
    for t in train:
        w = [*words(t), "</s>"]
        uni.update(w)
        big.update(zip(["<s>", *w], w, strict=False))
    d2 = [0, *kneser_ney.discounts(*(sum(c == k for c in big.values()) for k in (1, 2, 3, 4)))]
    before = Counter(w for _, w in big)
    d1 = [0, *kneser_ney.discounts(*(sum(c == k for c in before.values()) for k in (1, 2, 3, 4)))]
    total, n, v = len(big), sum(uni.values()), len(uni)
    after = defaultdict(list)
    for (a, _), c in big.items():
        after[a].append(c)
    left = sum(d1[min(c, 3)] for c in before.values()) / total
    low = lambda w: (before[w] - d1[min(before[w], 3)]) / total + left / (v + 1)

    def p(a, w):
        if a not in after:
            return low(w)
        s = sum(after[a])
        return (big[a, w] - d2[min(big[a, w], 3)]) / s + sum(d2[min(c, 3)] for c in after[a]) / s * low(w)

    out = []
    for t in texts:
        w = [*words(t), "</s>"]
        out.append((len(w), sum(uni[x] > 0 for x in w), sum(math.log10((uni[x] + 1) / (n + v + 1)) for x in w), sum(math.log10(p(a, x)) for a, x in zip(["<s>", *w], w, strict=False))))
    return n, out


def test_scores_equal_recount(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA).withColumn("score", F.lit("clash")).select("doc_id", lm_scoring.held_out().alias("held_out"), text_bytes().alias("t"))
    model = kneser_ney.fit(docs.where("not held_out"))
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.base_score, r.score) for r in lm_scoring.score(docs, model).collect()))
    train = [t for i, t in DOCS if zlib.crc32(str("" if i is None else i).encode()) % 7 != 2]
    n, out = brute(train, [t for _, t in DOCS])
    assert model.train_tokens == n
    want = sorted((-1 if i is None else i, *o) for (i, _), o in zip(DOCS, out, strict=True))
    for g, w in zip(got, want, strict=True):
        assert g[:3] == w[:3] and g[3:] == pytest.approx(w[3:], rel=1e-9)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(DOCS, SCHEMA).select(text_bytes().alias("t"))
    reader = char_model.CharReader(char_model.fit(docs).json())
    for context in (b"the", b"cat", b"zzz"):
        p = reader.probabilities(char_model.mixed(np.array([int.from_bytes(context + bytes([b]), "big") for b in range(256)], dtype=np.uint32)))
        assert 0.98 < p.sum() <= 1.0001  # one more symbol stands for those never seen


def test_empty_corpus(spark):
    docs = spark.createDataFrame([], SCHEMA).select("doc_id", text_bytes().alias("t"))
    model = kneser_ney.fit(docs)
    new = spark.createDataFrame([(1, "x y")], SCHEMA).select("doc_id", text_bytes().alias("t"))
    assert lm_scoring.score(new, model, keep=("doc_id",)).first().n_known == 0
    assert quality_rules.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


def rule(text):
    text = text or ""
    w = re.findall("[^\\x20\\x09-\\x0D]+", text)
    seen = defaultdict(list)
    for i in range(len(w) - 2):
        seen[tuple(w[i : i + 3])].append(i)
    cover = {j for v in seen.values() if len(v) > 1 for i in v for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search("[^\\x20\\x09-\\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover)


def test_quality_rules(spark):
    texts = ["a b c a b c", "a a a a", "x\n\ny\nx\n \n ", "é# *b|\x0bc", "", None, "one two three " * 40, "w " * 60, " ".join(f"v{i}" for i in range(80))]
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None) for i, t in enumerate(texts)], "doc_id long, text string, lang string").withColumn("n_words", F.lit(0))
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs).collect()}
    for i, t in enumerate(texts):
        r, want = got[i], rule(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.base_failed and r.kept)
