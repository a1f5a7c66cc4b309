"""Encoding, decoding and the token store against the library."""

import hashlib
import json
import random
import zlib

import numpy as np
import pytest

from driftlens.llm import bpe, token_store

ODD = ["", "  ", "İstanbul ΣΑΣ <|endoftext|>x <|start", "a\x1cb c", "don't I'LL 'S x's", "１2 ½ ﬁ é é ́x", " a\u0085b　c", "日本語。", "x" * 300, "the'sa''s" * 20, "\x00\x01ab \x7f", "Plain words, and more words."]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.tokenizer_path())


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def encoded(enc, texts):
    flat, counts = enc.encode([t.encode() for t in texts])
    return [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])]


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    enc, whole = bpe.Encoder(path("byte_bpe_50k.json")), Tokenizer.from_file(path("byte_bpe_50k.json"))
    assert not enc.by_words
    assert encoded(enc, ODD) == [ids(whole, t) for t in ODD]


def test_encoder(library):
    enc = bpe.Encoder(bpe.tokenizer_path())
    for _ in range(2):  # from the library, then from the cache
        for t, x in zip(ODD, encoded(enc, ODD), strict=True):
            assert x == ids(library, t)
    for t in ODD:
        assert enc.decode(ids(library, t)) == library.decode(ids(library, t), skip_special_tokens=False)


def test_caches_may_overflow(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    monkeypatch.setattr(bpe, "CACHE_PIECES", 3)
    enc = bpe.Encoder(bpe.tokenizer_path())
    for t in ODD:
        assert encoded(enc, [t, t])[1] == ids(library, t)


def test_concatenation_at_any_cut(library):
    enc, r = bpe.Encoder(bpe.tokenizer_path()), random.Random(7)
    texts = ODD + ["".join(r.choice("abcdeé's<|.1 ") for _ in range(800)) for _ in range(10)] + ["thntionblereinger" * 60, "a" * 1500, "<|endoftext|>" * 30]
    for t in texts:
        for n in (2, 5):
            cuts = sorted([0, len(t), *(r.randrange(len(t) + 1) for _ in range(n - 1))])
            assert concatenated(enc, t, cuts) == ids(library, t)


def concatenated(enc, t, cuts):
    own = [(a, t[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    pieces = [bpe.leaf(enc, x, a, np.array(enc.tokenizer.encode(x, add_special_tokens=False).ids, dtype=np.uint32), *bpe.edge_tokens(enc, x)) for a, x in own]
    return bpe.concatenate(enc, t, pieces).tolist()


def test_unsplit_text_is_encoded_again_in_windows_alone(library, monkeypatch):
    enc, r = bpe.Encoder(bpe.tokenizer_path()), random.Random(5)
    text = "".join(r.choice(["the", "er", "ing", "1", "é", "-", "xq"]) for _ in range(60_000))
    cuts = [i * len(text) // 8 for i in range(9)]
    own = [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    pieces = [bpe.leaf(enc, x, a, np.array(ids(library, x), dtype=np.uint32), *bpe.edge_tokens(enc, x)) for a, x in own]
    seen, places = [], enc.places
    monkeypatch.setattr(enc, "places", lambda run, at=0: seen.append(len(run)) or places(run, at))
    assert bpe.concatenate(enc, text, pieces).tolist() == ids(library, text)
    assert sum(seen) < 7 * 2000


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_op5(spark, library):
    rows = [(1, "Short text."), (1, "Short text."), (2, None), (None, "no id"), (5, "unsplit" * 20_000), (6, "日本語" * 15_000), (3, "long words, here " * 2500), (3, "long words, here " * 2500), (4, "x" * 40_000)]
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in bpe.encode_decode(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    want = []
    for i, t in rows:
        x = ids(library, t or "")
        want.append((i or -1, len(x), sha(" ".join(map(str, x))), sha(library.decode(x, skip_special_tokens=False))))
    assert got == sorted(want)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.encode_decode(empty).count() == 0
    assert token_store.read(spark, token_store.write(empty)).count() == 0


def test_token_store(spark, library):
    rows = [(5, "The same passage again and again, " * 80), (2, "The same passage again and again, " * 80), (9, None), (7, "tail"), (7, "tail")]
    store = token_store.write(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, start int"))
    got = sorted((r.doc_id, r.start, r.n_tokens, zlib.crc32(bytes(r.ids))) for r in token_store.read(spark, store).collect())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        x = [*ids(library, t or ""), token_store.END_ID]
        want.append((i, at, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes())))
        at += len(x)
    assert got == want
    manifest = json.load(open(f"{store.path}/manifest.json"))
    chunks = token_store.recipes(spark, store.path).selectExpr("sum(length(digests)) / 16 as n").first().n
    assert manifest["chunks"] < chunks  # copies share chunks
    assert manifest["ids"] == at


def test_damage_is_noticed(spark):
    store = token_store.write(spark.createDataFrame([(1, "some words to keep " * 30)], "doc_id long, text string"))
    import glob

    for f in glob.glob(f"{store.path}/pack-*"):
        data = bytearray(open(f, "rb").read())
        data[-1] ^= 1
        open(f, "wb").write(data)
    with pytest.raises(Exception, match="damaged"):
        token_store.read(spark, store).collect()


def test_lost_repeated_and_swapped_recipes_are_noticed(spark):
    import shutil

    store = token_store.write(spark.createDataFrame([(k, f"document {k} " * (20 + k)) for k in range(6)], "doc_id long, text string"))
    assert token_store.read(spark, store).count() == 6
    told = token_store.recipes(spark, store.path).toPandas().sort_values("doc_id")
    swapped = told.copy()
    swapped.loc[:, "doc_id"] = told.doc_id.map({0: 1, 1: 0}).fillna(told.doc_id).astype("int64")
    for frame in (told.iloc[1:], told.iloc[[0, *range(6)]], swapped, told.assign(start=told.start + 1)):
        shutil.rmtree(f"{store.path}/recipes")
        spark.createDataFrame(frame, token_store.RECIPE).write.parquet(f"file://{store.path}/recipes")
        with pytest.raises(Exception, match="damaged"):
            token_store.read(spark, store).collect()


def test_root_does_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(k % 50, f"document {k} says so and so, " * (1 + k % 40)) for k in range(200)], "doc_id long, text string")
    chunks = lambda store: sorted(tuple(r) for r in token_store.recipes(spark, store.path).select("doc_id", "n_tokens", "digests").collect())
    one, other = token_store.write(docs.repartition(1)), token_store.write(docs.repartition(7, "text"))
    assert chunks(one) == chunks(other)
    assert one.root == other.root


def test_cut_points_bound_chunks():
    ids_ = np.random.default_rng(3).integers(0, 40_000, 20_000).astype(np.uint32)
    ends = np.array([5_000, 5_001, 20_000])
    cuts = token_store.cut_points(ids_, ends)
    assert set(ends) <= set(cuts.tolist()) and np.diff(np.concatenate([[0], cuts])).max() <= token_store.MOST
    own = [token_store.cut_points(x, np.array([len(x)])) for x in (ids_[:5000], ids_[5000:5001], ids_[5001:])]
    assert np.concatenate([own[0], own[1] + 5000, own[2] + 5001]).tolist() == cuts.tolist()  # documents are cut alone
