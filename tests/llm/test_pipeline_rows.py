"""Rows without doc_id, and rows that share one, in the pipeline's filter stages."""

import random

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
R = random.Random(3)
VOCABULARY = ["".join(R.choice("abcdefghijklmno") for _ in range(R.randint(2, 9))) for _ in range(1500)]
prose = lambda n, seed: " ".join(random.Random(seed).choices(VOCABULARY, k=n))
junk = lambda seed: " | ".join(prose(50, seed).upper().split()) + "!!"
toxic = lambda seed: prose(40, seed) + " idiot moron idiot moron " + prose(9, seed + 1)


def documents(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s1", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def left(docs):
    return sorted(((r.doc_id, r.text) for r in docs.collect()), key=str)


def test_quality_judges_each_row(spark, tmp_path):
    known = [(k, prose(80 + k % 40, k)) for k in range(120)] + [(1000 + k, junk(5000 + k)) for k in range(60)] + [(2000 + k, toxic(7000 + 2 * k)) for k in range(60)]
    labels = [(i, int(i < 1000 or i >= 2000), int(i >= 2000)) for i, _ in known]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    clean = [(None, prose(90, 9001)), (None, prose(90, 9002)), (50_000, prose(90, 9003))]
    poor = [(None, junk(9004)), (None, toxic(9006)), (50_000, junk(9005))]
    got = left(pipeline.quality(spark, documents(spark, known + clean + poor), str(tmp_path)))
    assert all(r in got for r in clean) and not any(r in got for r in poor)


def test_decontamination_judges_each_row(spark, tmp_path):
    item = prose(30, 1)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    clean = [(None, prose(90, 2)), (None, prose(90, 3)), (None, None), (5, prose(90, 4))]
    leaked = [(None, prose(50, 5) + " " + item), (5, item + " " + prose(50, 6))]
    assert left(pipeline.decontaminate(spark, documents(spark, clean + leaked), str(tmp_path))) == sorted(clean, key=str)


def test_one_of_each_group_stays(spark, tmp_path):
    a, b, c, d = (prose(80, 100 + k) for k in range(4))
    near = c + " " + VOCABULARY[0]
    rows = [(5, a), (5, b), (7, a), (3, b)]  # ids repeated with different texts
    rows += [(None, c), (None, c), (None, near), (None, d), (20, d), (None, prose(80, 200))]  # without id
    rows += [(30, prose(80, 300))] * 3 + [(31, ""), (31, ""), (32, ""), (None, None), (None, None)]
    got = left(pipeline.deduplicate(spark, documents(spark, rows), str(tmp_path)))
    of_c = [r for r in got if r[1] in (c, near)]
    assert len(of_c) == 1
    whole = [(5, a), (3, b), (20, d), (None, prose(80, 200)), (30, prose(80, 300)), (31, ""), (32, ""), (None, None), (None, None)]
    assert [r for r in got if r not in of_c] == sorted(whole, key=str)
