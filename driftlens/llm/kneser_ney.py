"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays.

Counting: each task reduces a slice of texts to sorted (key, count) runs, cut into shards by the leading bits of the key.
Spark deals the runs out by shard; a task merges the runs of a shard and writes two flat arrays, keys ascending. A bigram's
key is a bijective mix of the leading 32 bits of both words' hashes, so shards are even however common a word is, and the
contexts and continuations are read back from the keys. Scoring maps the arrays into memory and searches them in bulk.

Bigrams, contexts and continuations tell words by 32 bits of their hashes: of V distinct words about V * V / 2 ** 33 pairs share
them (1 in 4,000 words of a vocabulary of a million) and are one word to the model's higher order; n_known and the base score
use all 64 bits. Wider keys weren't tried: by the sizes of the keys, 16 bytes for a bigram would need an estimated 5.8 times
the input on disk, as runs and counts were before they were packed.

Files of a model: uni (64-bit word hash, count), bi (mixed bigram, count), ctx (context: sum of counts; numbers of words
seen once, twice, more often after it), con (word: number of different words before it); one of each for each shard. Values
take a byte each; those of MUCH or more stand in a third file with their places.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import atomic_write, mounted, prepare, scratch, stored
from .cluster import shards as spread
from .words import START, bounded, mix, tokens, unmix

RUNS = "shard int, kind string, keys binary, vals binary"
SUMS = "kind string, entries long, total long, n1 long, n2 long, n3 long, n4 long"
#: Type of a key, and number of the values beside it.
KINDS = {"uni": (np.uint64, 1), "bi": (np.uint64, 1), "ctx": (np.uint32, 4), "con": (np.uint32, 1)}
#: A value from here on stands beside the others in a model's file.
MUCH = 255
HALF = np.uint64(32)
#: Bytes of input for a shard.
SHARD = 64 << 20


@dataclass
class Model:
    """Where the arrays are and the numbers that hold for the whole model."""

    path: str
    shards: int
    train_tokens: int = 0
    vocabulary: int = 0
    bigram_discounts: list[float] = field(default_factory=list)
    unigram_discounts: list[float] = field(default_factory=list)
    continuations: int = 0
    words_seen: list[int] = field(default_factory=list)

    def json(self) -> str:
        return json.dumps(asdict(self))


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """Chen and Goodman's three discounts; where counts of counts are missing, k - 1/2 for count k, never over k."""
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    out = []
    for k, (a, b) in enumerate(((n1, n2), (n2, n3), (n3, n4)), 1):
        d = k - (k + 1) * y * b / a if a and b else k - 0.5
        out.append(float(min(max(d, 0.0), k)))
    return out


def _packed(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes each as the largest needs, all first bytes, then all second ones: leading zeros cost nothing."""
    x = x.astype("<u8")
    width = max(1, -(-int(x.max(initial=0)).bit_length() // 8))
    return bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, dtype=np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), dtype=np.uint8)
    out[:, : data[0]] = planes.T
    return out.view("<u8")[:, 0]


def _runs(kind: str, shards: int, keys: np.ndarray, vals: np.ndarray) -> Iterator[tuple[int, str, bytes, bytes]]:
    """Sorted keys cut at the shards' borders: the first, then each one's distance to the one before; values a column at a time."""
    bits = keys.dtype.itemsize * 8 - (shards.bit_length() - 1)
    cuts = np.searchsorted(keys, (np.arange(1, shards, dtype=np.uint64) << np.uint64(bits)).astype(keys.dtype))
    edges = [0, *cuts.tolist(), len(keys)]
    for s in range(shards):
        a, b = edges[s], edges[s + 1]
        if a < b:
            yield s, kind, int(keys[a]).to_bytes(8, "little") + _packed(np.diff(keys[a:b], prepend=keys[a])), _packed(vals[a:b].T.reshape(-1))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=f.type) for i, f in enumerate(schema)], schema=schema)


RUN_SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.string()), ("keys", pa.binary()), ("vals", pa.binary())])


def bigrams(tok: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Mixed key of each token and the one before it; START stands before the first of a text."""
    high = tok >> HALF
    before = np.empty_like(high)
    before[1:] = high[:-1]
    before[np.cumsum(counts) - counts] = START >> HALF
    return mix((before << HALF) | high)


def _count(shards: int):
    def count(batches):
        for b in bounded(batches, "t", 16_000_000):
            tok, counts = tokens(b.column("t").to_pylist())
            rows = []
            for kind, keys in (("uni", tok), ("bi", bigrams(tok, counts))):
                k, c = np.unique(keys, return_counts=True)
                rows += _runs(kind, shards, k, c)
            yield _batch(rows, RUN_SCHEMA)

    return count


def _merged(kind: str, runs: list[tuple[bytes, bytes]]) -> tuple[np.ndarray, np.ndarray]:
    key_type, width = KINDS[kind]
    keys = np.concatenate([(np.cumsum(_unpacked(k[8:])) + np.uint64(int.from_bytes(k[:8], "little"))).astype(key_type) for k, _ in runs])
    vals = np.concatenate([_unpacked(v).reshape(width, -1).T for _, v in runs]).astype(np.int64)
    order = np.argsort(keys, kind="stable")  # the runs are sorted, so this merges them
    keys, vals = keys[order], vals[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(vals, first, axis=0)


def _seen(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each distinct key: sum of counts, and how many are 1, 2 and more."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    table = np.stack([counts, counts == 1, counts == 2, counts > 2], axis=1).astype(np.int64)
    return keys[first], np.add.reduceat(table, first, axis=0)


def _summary(kind: str, counts: np.ndarray) -> tuple:
    return (kind, len(counts), int(counts.sum()), *(int((counts == k).sum()) for k in (1, 2, 3, 4)))


def _merge(path: str, shards: int):
    """Writes the arrays of whole shards; passes on contexts and continuations as runs, and a summary as a run of kind 'sum'."""

    def merge(batches):
        runs: dict[tuple[int, str], list] = {}
        for b in batches:
            for s, kind, k, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                runs.setdefault((s, kind), []).append((k, v))
        for s, kind in sorted(runs):
            keys, vals = _merged(kind, runs.pop((s, kind)))
            atomic_write(f"{path}/{kind}-{s}.k", keys.tobytes())
            atomic_write(f"{path}/{kind}-{s}.v", np.minimum(vals, MUCH).astype(np.uint8).tobytes())
            much = np.flatnonzero(vals >= MUCH)
            atomic_write(f"{path}/{kind}-{s}.x", np.stack([much, vals.reshape(-1)[much]]).tobytes())
            counts = vals[:, 0]
            rows = [(s, "sum", json.dumps(_summary(kind, counts)).encode(), b"")]
            if kind == "bi":
                pair = unmix(keys)
                rows += _runs("ctx", shards, *_seen((pair >> HALF).astype(np.uint32), counts))
                after, n = np.unique(pair.astype(np.uint32), return_counts=True)
                rows += _runs("con", shards, after, n)
            yield _batch(rows, RUN_SCHEMA)

    return merge


def fit(docs: DataFrame, text: str = "t") -> Model:
    """Counts the texts (a binary column of UTF-8) and writes the model. No rows: an empty model, which scores every word alike.

    The number of shards follows the plan's estimate of the input, SHARD bytes for each, so that a task's runs fit in memory.
    """
    spark = docs.sparkSession
    prepare(spark)
    shards = spread(docs, 64, SHARD)
    path = mounted(scratch(spark, "kneser-ney"))
    os.makedirs(path, exist_ok=True)
    counted = docs.select(F.col(text).alias("t")).mapInArrow(_count(shards), RUNS)
    first = stored(counted.repartitionById(shards, F.col("shard")).mapInArrow(_merge(path, shards), RUNS), "kn-runs")
    second = first.where("kind in ('ctx', 'con')").repartitionById(shards, F.col("shard")).mapInArrow(_merge(path, shards), RUNS)
    told = [json.loads(r.keys) for df in (first.where("kind = 'sum'"), second) for r in df.select("keys").collect()]  # a row for each shard and kind
    by = {kind: np.array([t[1:] for t in told if t[0] == kind] or [[0] * 6]).sum(axis=0).tolist() for kind in KINDS}
    seen = by["con"]
    return Model(path, shards, by["uni"][1], by["uni"][0], discounts(*by["bi"][2:]), discounts(*seen[2:]), seen[1], [seen[2], seen[3], seen[0] - seen[2] - seen[3]])


class Reader:
    """The model's arrays, mapped into memory."""

    def __init__(self, model: str):
        self.model = m = Model(**json.loads(model))
        self.arrays: dict[str, list] = {}
        for kind, (key_type, width) in KINDS.items():
            out = []
            for s in range(m.shards):
                f = f"{m.path}/{kind}-{s}"
                if os.path.exists(f"{f}.k") and os.path.getsize(f"{f}.k"):
                    k = np.memmap(f"{f}.k", dtype=key_type, mode="r")
                    v = np.memmap(f"{f}.v", dtype=np.uint8, mode="r").reshape(-1, width)
                    x = np.memmap(f"{f}.x", dtype=np.int64, mode="r").reshape(2, -1) if os.path.getsize(f"{f}.x") else np.zeros((2, 0), dtype=np.int64)
                    out.append((k, v, x))
                else:
                    out.append(None)
            self.arrays[kind] = out

    def find(self, kind: str, keys: np.ndarray) -> np.ndarray:
        """Values of ascending keys; zeros for those that the model lacks."""
        key_type, width = KINDS[kind]
        out = np.zeros((len(keys), width), dtype=np.float64)
        bits = key_type().itemsize * 8 - (self.model.shards.bit_length() - 1)
        cuts = np.searchsorted(keys, (np.arange(1, self.model.shards, dtype=np.uint64) << np.uint64(bits)).astype(key_type))
        edges = [0, *cuts.tolist(), len(keys)]
        for s, own in enumerate(self.arrays[kind]):
            a, b = edges[s], edges[s + 1]
            if a < b and own is not None:
                at = np.searchsorted(own[0], keys[a:b])
                at[at == len(own[0])] = 0
                hit = own[0][at] == keys[a:b]
                at = at[hit]
                got = own[1][at].astype(np.float64)
                row, col = np.nonzero(got == MUCH)
                got[row, col] = own[2][1, np.searchsorted(own[2][0], at[row] * width + col)]
                out[a:b][hit] = got
        return out

    def score(self, tok: np.ndarray, counts: np.ndarray) -> dict[str, np.ndarray]:
        """For each text: log10 probability, base score and number of known tokens."""
        m = self.model
        starts = np.cumsum(counts) - counts
        words, which = np.unique(tok, return_inverse=True)
        raw = self.find("uni", words)[:, 0]
        halves = (words >> HALF).astype(np.uint32)  # ascending, as the words are
        n = self.find("con", halves)[:, 0]
        if m.continuations:
            d = np.array([0.0, *m.unigram_discounts])[np.minimum(n, 3).astype(int)]
            left = sum(x * k for x, k in zip(m.unigram_discounts, m.words_seen, strict=True)) / m.continuations
            low = (n - d) / m.continuations + left / (m.vocabulary + 1)
        else:
            low = np.full(len(words), 1.0 / (m.vocabulary + 1))
        seen = self.find("ctx", np.concatenate([halves, [np.uint32(START >> HALF)]])[order := np.argsort(np.concatenate([halves, [np.uint32(START >> HALF)]]), kind="stable")])
        contexts = np.empty_like(seen)
        contexts[order] = seen
        total = contexts[:, 0]
        share = np.where(total > 0, contexts[:, 1:] @ np.array(m.bigram_discounts) / np.maximum(total, 1), 1.0)
        before = np.empty(len(tok), dtype=np.int64)
        before[1:] = which[:-1]
        before[starts] = len(words)
        keys = bigrams(tok, counts)
        order = np.argsort(keys)
        c = np.empty(len(tok))
        c[order] = self.find("bi", keys[order])[:, 0]
        d = np.array([0.0, *m.bigram_discounts])[np.minimum(c, 3).astype(int)]
        p = (c - d) / np.maximum(total[before], 1) + share[before] * low[which]
        base = np.log10((raw + 1) / (m.train_tokens + m.vocabulary + 1))
        return {"score": np.add.reduceat(np.log10(p), starts), "base_score": np.add.reduceat(base[which], starts), "n_known": np.add.reduceat((raw > 0).astype(np.int64)[which], starts)}


_readers: dict[str, Reader] = {}


def reader(model: str) -> Reader:
    """One for each worker and model; the last few stay."""
    if model not in _readers:
        while len(_readers) >= 2:
            _readers.pop(next(iter(_readers)))
        _readers[model] = Reader(model)
    return _readers[model]
