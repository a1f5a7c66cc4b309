"""A worker that has encoded texts gives up the tokenizer and its words when it runs a task of another operator."""

import pyarrow as pa

from driftlens.llm import bpe, words


def test_other_operators_drop_the_encoder(monkeypatch):
    monkeypatch.setattr(bpe, "Encoder", lambda path: [path])
    bpe.encoder.cache_clear()
    batch = pa.RecordBatch.from_arrays([pa.array([b"a b", b"c"])], names=["t"])
    first = bpe.encoder("x")
    assert len(list(words.bounded(iter([batch]), "t", keep=True))) == 1 and bpe.encoder("x") is first
    assert list(words.bounded(iter([batch]), "t")) == [batch] and bpe.encoder.cache_info().currsize == 0
    bpe.encoder.cache_clear()
