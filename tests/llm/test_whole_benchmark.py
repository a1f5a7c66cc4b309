"""Benchmarks of many more items than the latent space has dimensions, and in several portions, against brute force."""

import random

from driftlens.llm import decontamination

R = random.Random(17)
VOCABULARY = ["".join(R.choice("abcdefghijklmno") for _ in range(R.randint(3, 8))) for _ in range(3000)]
WEIGHTS = [1 / (k + 5) for k in range(3000)]
prose = lambda n, seed: " ".join(random.Random(seed).choices(VOCABULARY, WEIGHTS, k=n))
ITEMS = [(k, prose(15 + k % 45, 10_000 + k)) for k in range(900)]


def edited(text, share, seed):
    w, r = text.split(), random.Random(seed)
    for k in r.sample(range(len(w)), int(len(w) * share)):
        w[k] = r.choice(VOCABULARY)
    return " ".join(w)


def test_recall_does_not_fall_with_the_benchmark(spark):
    plants = [(k, share, edited(ITEMS[k][1], share, k)) for k, share in zip(range(0, 900, 6), [0, 0.15, 0.25, 0.35, 0.39] * 30, strict=True)]
    rows = [(k, prose(70, 20_000 + k) + " " + t + " " + prose(90, 30_000 + k)) for k, _, t in plants] + [(5000 + k, prose(150, 40_000 + k)) for k in range(100)]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string").repartition(4), spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: r.item_ids for r in decontamination.decontaminate(docs, bench).collect()}
    items = [decontamination.Item(k, t) for k, t in ITEMS]
    for k, _, t in plants:
        assert items[k].found(t.split()) > 0
        assert k in got[k]
    assert not any(got[5000 + k] for k in range(100))


def test_portions_judge_each_row(spark, monkeypatch):
    """Rows without doc_id, and rows that share one, keep their own verdict when the benchmark comes in portions."""
    monkeypatch.setattr(decontamination, "PORTION", 4)
    leak = lambda k: prose(50, 50 + k) + " " + ITEMS[k][1] + " " + prose(50, 60 + k)
    rows = [(None, leak(0)), (None, prose(90, 1)), (7, leak(1) + " " + ITEMS[2][1]), (7, prose(90, 2)), (8, None), (9, leak(3)), (9, leak(3))]
    got = decontamination.decontaminate(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS[:20], "item_id long, text string"))
    assert sorted((str(r.doc_id), r.contaminated, r.item_ids) for r in got.collect()) == [("7", False, []), ("7", True, [1, 2]), ("8", False, []), ("9", True, [3]), ("9", True, [3]), ("None", False, []), ("None", True, [0])]
