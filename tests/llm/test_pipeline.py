"""The pipeline's stages on planted rows."""

import random

import pytest

from driftlens.llm.cluster import stored

pipeline = pytest.importorskip("corpus_pipeline")
R = random.Random(2)
VOCABULARY = ["".join(R.choice("abcdefghijklmno") for _ in range(R.randint(2, 9))) for _ in range(1500)]
prose = lambda n, seed: " ".join(random.Random(seed).choices(VOCABULARY, k=n))


def test_stages(spark, tmp_path):
    item = prose(30, 9077)
    clean = [(k, prose(80 + k % 40, k)) for k in range(120)]
    junk = [(1000 + k, " | ".join(prose(50, 5000 + k).upper().split()) + "!!") for k in range(40)]
    copies = [(2000 + k, clean[k][1]) for k in range(10)] + [(2100, clean[3][1] + " " + VOCABULARY[0])]
    leaked = [(3000, prose(60, 31) + " " + item + " " + prose(60, 32))]
    private = [(4000, prose(40, 41) + " write to some.body@mail.example.com or +49 30 1234567 " + prose(40, 42))]
    rows = [(i, t, "en", f"s{i % 4}", len(t)) for i, t in clean + junk + copies + leaked + private] + [(5000, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i, _ in clean[::2]] + [(i, 0, 0) for i, _ in junk[::2]]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, prose(25, 9099))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, str(tmp_path)), "test-stage")
        seen.append(docs)
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in seen]
    assert all(d.columns == ["doc_id", "text", "lang", "source", "n_chars"] for d in seen[:-1])
    assert not ids[0] & {i for i, _ in junk} and len({i for i, _ in clean} - ids[0]) <= 1
    assert not ids[1] & {i for i, _ in copies} and ids[0] - ids[1] <= {i for i, _ in copies}
    assert ids[1] - ids[2] == {3000}
    text = {r.doc_id: r for r in seen[3].collect()}
    assert "[EMAIL]" in text[4000].text and "[PHONE]" in text[4000].text and "mail.example.com" not in text[4000].text and text[4000].n_chars == len(text[4000].text)
    assert text[5].text == clean[5][1]
    assert ids[3] == ids[2] == ids[4] and seen[4].where("n_tokens > 0").count() >= 100
