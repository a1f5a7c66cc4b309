"""Interpolated modified Kneser-Ney model of byte n-grams, counted in Spark, kept as sorted hash arrays in mapped files.

A gram is ORDER bytes as one number, the last one the symbol. Tasks reduce slices of texts to distinct grams and counts; the
lower orders count the different bytes before each gram and are, like the probabilities, DataFrame aggregations and joins
over distinct grams, which are few beside the text. Each order's probabilities and each context's weight of the order below
lie in files of keys, ascending by a bijective mix, and values. The leading bits of a mixed key point to where it lies.
"""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import atomic_write, mounted, partitions, prepare, scratch, stored
from .kneser_ney import RUN_SCHEMA, RUNS, _batch, _merged, _runs, discounts
from .words import bounded

ORDER, START, END, SYMBOLS = 4, 2, 3, 257
ODD = 0x5E3779B1  # under 2 ** 31: times 32 bits it fits a signed long
INVERSE = pow(ODD, -1, 1 << 32)


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Mixed grams of all texts, one for each byte and one for the end, and the number of each text's."""
    pad, close = bytes([START] * (ORDER - 1)), bytes([END])
    raw = np.frombuffer(b"".join(x for t in texts for x in (pad, t, close)), dtype=np.uint8).astype(np.uint32)
    counts = np.array([len(t) + 1 for t in texts], dtype=np.int64)
    gram = raw[: len(raw) - ORDER + 1].copy() if len(raw) else raw
    for k in range(1, ORDER):
        gram <<= np.uint32(8)
        gram |= raw[k : len(raw) - ORDER + 1 + k]
    inside = np.ones(len(gram) + ORDER - 1, dtype=bool)
    ends = np.cumsum(counts + ORDER - 1)
    for k in range(1, ORDER):
        inside[ends - k] = False
    return mixed(gram[inside[: len(gram)]]), counts


def mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint32(15))) * np.uint32(ODD)


def unmixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint32(INVERSE)
    return x ^ (x >> np.uint32(15)) ^ (x >> np.uint32(30))


def _count(shards: int):
    def count(batches):
        for b in bounded(batches, "t", 16_000_000):
            keys, n = np.unique(grams(b.column("t").to_pylist())[0], return_counts=True)
            yield _batch(list(_runs("con", shards, keys, n.astype(np.int64))), RUN_SCHEMA)

    return count


def _merge(batches):
    runs: dict[int, list] = {}
    for b in batches:
        for s, k, v in zip(*(b.column(c).to_pylist() for c in ("shard", "keys", "vals")), strict=True):
            runs.setdefault(s, []).append((k, v))
    for s in sorted(runs):
        keys, n = _merged("con", runs.pop(s))
        yield pa.RecordBatch.from_arrays([pa.array(unmixed(keys).astype(np.int64)), pa.array(n[:, 0])], names=["gram", "n"])


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _level(grams: DataFrame, lower: DataFrame | None, mask: int) -> tuple[DataFrame, DataFrame]:
    """Probabilities (gram, p) of one order and weights (gram: the context, p) of the order below."""
    n = F.col("n")
    of = grams.agg(*(F.count_if(n == k).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    d = discounts(*of)
    context = F.shiftright("gram", 8)
    seen = grams.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), (F.sum(_discount(n, d)) / F.sum("n")).alias("weight"))
    joined = grams.withColumn("context", context).join(seen, "context").withColumn("tail", F.col("gram").bitwiseAND(F.lit(mask)))
    if lower is None:
        below = F.lit(1.0 / SYMBOLS)
    else:
        joined = joined.join(lower.select(F.col("gram").alias("tail"), F.col("p").alias("below")), "tail")
        below = F.col("below")
    p = (n - _discount(n, d)) / F.col("total") + F.col("weight") * below
    return joined.select("gram", p.alias("p")), seen.select(F.col("context").alias("gram"), F.col("weight").alias("p"))


@dataclass
class CharModel:
    path: str
    sizes: dict[str, int] = field(default_factory=dict)

    def json(self) -> str:
        return json.dumps(asdict(self))


def fit(docs: DataFrame, text: str = "t") -> CharModel:
    """Counts the texts (a binary column of UTF-8) and writes the model. No rows: a model that gives every symbol the same."""
    spark = docs.sparkSession
    prepare(spark)
    shards = 1 << (max(16, partitions(spark)) - 1).bit_length()
    path = mounted(scratch(spark, "char-model"))
    os.makedirs(path, exist_ok=True)
    counted = docs.select(F.col(text).alias("t")).mapInArrow(_count(shards), RUNS)
    tables = {ORDER: stored(counted.repartitionById(shards, F.col("shard")).mapInArrow(_merge, "gram long, n long"), "grams")}
    for k in range(ORDER - 1, 0, -1):
        tail = F.col("gram").bitwiseAND(F.lit((1 << 8 * k) - 1))
        tables[k] = stored(tables[k + 1].groupBy(tail.alias("gram")).agg(F.count("*").alias("n")), "grams")
    lower, parts = None, []
    for k in range(1, ORDER + 1):
        p, w = _level(tables[k], lower, (1 << 8 * (k - 1)) - 1)
        lower = stored(p, "gram-p")
        parts += [lower.select(F.lit(f"p{k}").alias("kind"), "gram", "p"), w.select(F.lit(f"w{k}").alias("kind"), "gram", "p")]
    entries = parts[0]
    for x in parts[1:]:
        entries = entries.unionByName(x)
    entries = stored(entries, "gram-entries")
    model = CharModel(path, {f"{x}{k}": 0 for x in "pw" for k in range(1, ORDER + 1)} | {r.kind: r.n for r in entries.groupBy("kind").agg(F.count("*").alias("n")).collect()})

    def write(batches):
        """Each shard's entries of each kind, ascending; a shard is a range of mixed keys."""
        found: dict[tuple[int, str], list] = {}
        for b in batches:
            shard, kind, gram, p = (b.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "kind", "gram", "p"))
            for s in np.unique(shard):
                for k in np.unique(kind[shard == s]):
                    at = (shard == s) & (kind == k)
                    found.setdefault((int(s), str(k)), []).append((mixed(gram[at].astype(np.uint32)), p[at]))
        for (s, k), own in found.items():
            keys, p = np.concatenate([x for x, _ in own]), np.concatenate([x for _, x in own])
            order = np.argsort(keys)
            atomic_write(f"{path}/{k}-{s}.k", keys[order].tobytes())
            atomic_write(f"{path}/{k}-{s}.v", p[order].astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([s], type=pa.int32())], names=["shard"])

    bits = 32 - (shards.bit_length() - 1)
    g = F.col("gram").bitwiseXOR(F.shiftright("gram", 15))
    shard = F.shiftright((g * F.lit(ODD)).bitwiseAND(F.lit(0xFFFFFFFF)), bits).cast("int")
    entries.withColumn("shard", shard).repartitionById(shards, F.col("shard")).mapInArrow(write, "shard int").agg(F.count("*")).first()
    for k, size in model.sizes.items():  # shards are ranges, so their files in order are one sorted array
        for end in ("k", "v"):
            with open(f"{path}/{k}.{end}", "wb") as out:
                for s in range(shards if size else 0):
                    part = f"{path}/{k}-{s}.{end}"
                    if os.path.exists(part):
                        with open(part, "rb") as f:
                            while block := f.read(1 << 24):
                                out.write(block)
                        os.remove(part)
    return model


class Table:
    """Keys and values of one kind, mapped into memory, with the places where keys with given leading bits begin."""

    def __init__(self, path: str, kind: str, size: int):
        self.size = size
        if size:
            self.keys = np.memmap(f"{path}/{kind}.k", dtype=np.uint32, mode="r")
            self.values = np.memmap(f"{path}/{kind}.v", dtype=np.float32, mode="r")
            bits = min(24, max(8, size.bit_length() + 1))
            self.shift = np.uint32(32 - bits)
            self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(32 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of mixed keys; NaN for those that aren't there."""
        out = np.full(len(keys), np.nan, dtype=np.float32)
        if not self.size:
            return out
        left = np.arange(len(keys))
        at = self.first[keys >> self.shift]
        while len(left):
            ok = at < self.size
            left, at = left[ok], at[ok]
            there = self.keys[at]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[hit]]
            go = there < keys[left]
            left, at = left[go], at[go] + 1
        return out


class CharReader:
    def __init__(self, model: str):
        m = CharModel(**json.loads(model))
        self.tables = {k: Table(m.path, k, n) for k, n in m.sizes.items()}

    def probabilities(self, keys: np.ndarray) -> np.ndarray:
        p = self.tables[f"p{ORDER}"].find(keys)
        lost = np.flatnonzero(np.isnan(p))
        if len(lost):
            p[lost] = self._lower(unmixed(keys[lost]), ORDER)
        return p

    def _lower(self, gram: np.ndarray, k: int) -> np.ndarray:
        """Probabilities of grams of order k that the model lacks: their context's weight times those of the order below."""
        if k == 1:
            w = self.tables["w1"].find(mixed(np.zeros(len(gram), dtype=np.uint32)))
            return np.where(np.isnan(w), 1.0, w) / SYMBOLS
        w = self.tables[f"w{k}"].find(mixed(gram >> np.uint32(8)))
        tail = gram & np.uint32((1 << 8 * (k - 1)) - 1)
        p = self.tables[f"p{k - 1}"].find(mixed(tail))
        lost = np.flatnonzero(np.isnan(p))
        if len(lost):
            p[lost] = self._lower(tail[lost], k - 1)
        return np.where(np.isnan(w), 1.0, w) * p

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each text, and its symbols with the end."""
        keys, counts = grams(texts)
        return np.add.reduceat(np.log10(self.probabilities(keys)).astype(np.float64), np.cumsum(counts) - counts), counts


_readers: dict[str, CharReader] = {}


def reader(model: str) -> CharReader:
    if model not in _readers:
        _readers.clear()
        _readers[model] = CharReader(model)
    return _readers[model]
