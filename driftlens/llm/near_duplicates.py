"""N-gram Jaccard join (operator 1) with Bayesian candidate pruning.

Texts are sets of five-word shingles; two texts are linked if their sets' Jaccard similarity is THRESHOLD or more.

1. Each distinct text (rows with equal words are copies of one) gets HASHES MinHash values, of which a byte each is kept for
   estimates, and BANDS hashes of ROWS values each. Texts that share a band's hash are candidates of each other: all but
   (1 - J ** ROWS) ** BANDS of the pairs of similarity J, which is 3e-6 at the threshold.
2. In each bucket every text is compared with one of them, the pivot. The MinHash values are compared CHUNK by CHUNK, and a pair
   is dropped once the posterior probability (uniform prior) that its similarity reaches the threshold is below TOLERANCE.
   Texts of the surviving pairs form groups. In a bucket that still holds several groups, texts of different groups are
   compared with each other, and a spanning set of what survives joins the groups.
3. Within each group, pairs outlast first the Bayesian pruning and then the exact comparison of shingle sets.
4. Connected texts form a class, named by its least doc_id.

A text is one row at every step, however large its group: groups of up to BLOCK texts are a task's matter, and larger ones are
cut into blocks of BLOCK texts and BYTES at most, which tasks write to the shared folder. One task for each block compares it
with the group's other blocks, read one by one, and gives a row for each of its own texts and a spanning set of new links.
1 - J is a metric, so a group's distances to one of its texts, its centre, settle most blocks unread: blocks are cut by
distance, in steps of 1 / STEPS, and texts whose distances add up to at most 1 - THRESHOLD are linked, while texts whose
distances differ by more are not. What is left undecided is compared pair by pair, as exact numbers of links need.
"""

from __future__ import annotations

import functools
import io
import math
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import atomic_write, mounted, partitions, prepare, scratch, small, stored, table, text_bytes
from .words import M1, bounded, hashed, mix, ragged, windows

SHINGLE, THRESHOLD = 5, 0.8
ROWS, BANDS, CHUNK, TOLERANCE = 5, 32, 16, 1e-5
HASHES = ROWS * BANDS
#: Texts and bytes of shingles of a block, rows compared at once, and steps of the distance to a group's centre.
BLOCK, BYTES, TILE, STEPS = 1024, 16_000_000, 32, 200
#: Steps in 1 - THRESHOLD.
REACH = round((1 - THRESHOLD) * STEPS)

_seeds = np.random.default_rng(20240501)
MULTIPLY = (_seeds.integers(1, 1 << 31, HASHES, dtype=np.uint64) * 2 + 1).astype(np.uint32)
FLIP = _seeds.integers(0, 1 << 32, HASHES, dtype=np.uint64).astype(np.uint32)
_WORD_BASE = np.uint64(M1)


def read_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each text's words in order, all texts' shingles, text by text, and their numbers; a text without words has none."""
    words, counts = hashed(texts)
    parts, numbers = windows(words, counts, SHINGLE)
    nodes = np.zeros(len(texts), dtype=np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        starts = (np.cumsum(counts) - counts)[some]
        place = ragged(np.zeros(len(some), dtype=np.int64), counts[some])
        spread = mix(words + mix(place.astype(np.uint64) * _WORD_BASE + np.uint64(1)))
        nodes[some] = mix(np.add.reduceat(spread, starts) + counts[some].astype(np.uint64))
    return nodes, parts, numbers


def minhash(parts: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """HASHES values for each text that has shingles."""
    values = (parts >> np.uint64(32)).astype(np.uint32)
    full = numbers[numbers > 0]
    starts = np.cumsum(full) - full
    least = np.empty((HASHES, len(full)), dtype=np.uint32)
    for k in range(HASHES if len(full) else 0):
        least[k] = np.minimum.reduceat((values ^ FLIP[k]) * MULTIPLY[k], starts)
    return np.ascontiguousarray(least.T)


def estimates(least: np.ndarray) -> np.ndarray:
    """The byte of each MinHash value that estimates compare."""
    return (least >> np.uint32(8)).astype(np.uint8)


def band_hashes(least: np.ndarray) -> np.ndarray:
    grouped = least.reshape(len(least), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(least), BANDS)).copy()
    for k in range(ROWS):
        out = mix(out * np.uint64(M1) + grouped[:, :, k])
    return out


@functools.cache
def least_matches() -> np.ndarray:
    """For each number n of compared values, the least number of matches with which P(J >= THRESHOLD) >= TOLERANCE.

    With a uniform prior the posterior is Beta(m + 1, n - m + 1), so that probability is P(Binomial(n + 1, THRESHOLD) <= m).
    Bytes also match by chance, once in 256, which raises the threshold's rate of matches.
    """
    rate = THRESHOLD + (1 - THRESHOLD) / 256
    out = np.zeros(HASHES + 1, dtype=np.int64)
    for n in range(1, HASHES + 1):
        total = 0.0
        for m in range(n + 1):
            total += math.comb(n + 1, m) * rate**m * (1 - rate) ** (n + 1 - m)
            if total >= TOLERANCE:
                out[n] = m
                break
    return out


def survivors(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of two arrays of MinHash bytes outlast the pruning."""
    alive, matches = np.arange(len(a)), np.zeros(len(a), dtype=np.int64)
    for n in range(CHUNK, HASHES + 1, CHUNK):
        matches = matches + (a[alive, n - CHUNK : n] == b[alive, n - CHUNK : n]).sum(axis=1)
        go = matches >= least_matches()[n]
        alive, matches = alive[go], matches[go]
    return alive


def nullable(nodes: np.ndarray, numbers: np.ndarray) -> pa.Array:
    return pa.array(nodes.view(np.int64), mask=numbers == 0)


def sign(docs: DataFrame) -> DataFrame:
    """doc_id and binary t to: doc_id, node (of the text; null without words), size (shingles), MinHash bytes and band hashes."""

    def run(batches):
        for b in bounded(batches, "t"):
            nodes, parts, numbers = read_texts(b.column("t").to_pylist())
            least = minhash(parts, numbers)
            full = numbers > 0
            sig = np.full(len(numbers), None, dtype=object)
            bands = np.full(len(numbers), None, dtype=object)
            sig[full] = [x.tobytes() for x in estimates(least)]
            for row, x in zip(np.flatnonzero(full).tolist(), band_hashes(least).view(np.int64), strict=True):
                bands[row] = x
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), nullable(nodes, numbers), pa.array(numbers, type=pa.int64()), pa.array(sig, type=pa.binary()), pa.array(bands, type=pa.list_(pa.int64()))], names=["doc_id", "node", "size", "sig", "bands"])

    return docs.mapInArrow(run, "doc_id long, node long, size long, sig binary, bands array<long>")


def connect(edges: DataFrame, what: str) -> DataFrame:
    """node and label, the least node that it is connected to, for the nodes of the edges (a, b); labels jump to labels until none changes."""
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{what}-edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), f"{what}-labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        moved = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "near").alias("new"))
        far = labels.select(F.col("node").alias("new"), F.col("label").alias("far"))
        new = stored(moved.join(far, "new", "left").select("node", F.least("new", F.coalesce("far", "new")).alias("label"), "label", "new").toDF("node", "label", "old", "_"), f"{what}-labels")
        labels = new.select("node", "label")
        if new.where("label < old").isEmpty():
            return labels


@dataclass
class Block:
    """Texts of a group, or of a bucket: ids, copies, MinHash bytes, shingle sets one after the other (none in a bucket), and labels."""

    node: np.ndarray
    copies: np.ndarray
    sig: np.ndarray
    sizes: np.ndarray
    flat: np.ndarray
    label: np.ndarray

    @property
    def starts(self) -> np.ndarray:
        return np.cumsum(self.sizes) - self.sizes

    def save(self, path: str) -> None:
        out = io.BytesIO()
        np.savez(out, node=self.node, copies=self.copies, sig=self.sig, sizes=self.sizes, flat=self.flat, label=self.label)
        atomic_write(path, out.getbuffer())

    @staticmethod
    def load(path: str) -> Block:
        with np.load(path) as f:
            return Block(*(f[k] for k in ("node", "copies", "sig", "sizes", "flat", "label")))

    @staticmethod
    def of(t: pa.Table) -> Block:
        """From rows with node and sig, and copies and shingles or label; equal nodes once, in order."""
        node, first = np.unique(t["node"].to_numpy(), return_index=True)
        column = lambda k: t[k].to_numpy()[first]
        sig = np.frombuffer(b"".join(t["sig"].to_pylist()), dtype=np.uint8).reshape(-1, HASHES)[first]
        if "shingles" not in t.column_names:
            return Block(node, np.ones(len(node), dtype=np.int64), sig, np.zeros(len(node), dtype=np.int64), np.zeros(0, dtype=np.uint64), column("label"))
        data = t["shingles"].take(pa.array(first)).to_pylist()
        return Block(node, column("copies"), sig, np.array([len(x) // 8 for x in data], dtype=np.int64), np.frombuffer(b"".join(data), dtype=np.uint64), node.copy())


def candidates(a: Block, b: Block, same: bool, differ: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each text of a that has any, the texts of b that outlast the pruning: later ones if a and b are the same, of other labels if labels must differ."""
    most = least_matches()[CHUNK]
    for at in range(0, len(a.node), TILE):
        rows = np.arange(at, min(at + TILE, len(a.node)))
        go = (a.sig[rows, None, :CHUNK] == b.sig[None, :, :CHUNK]).sum(axis=2) >= most
        if same:
            go &= np.arange(len(b.node))[None, :] > rows[:, None]
        if differ:
            go &= a.label[rows, None] != b.label[None, :]
        else:  # sets whose sizes differ too much
            x, y = a.sizes[rows, None], b.sizes[None, :]
            go &= np.minimum(x, y) >= THRESHOLD * np.maximum(x, y) - 1e-9
        x, y = np.nonzero(go)
        alive = survivors(a.sig[rows[x]], b.sig[y])
        x, y = rows[x[alive]], y[alive]
        edges = [*np.flatnonzero(np.diff(x, prepend=-1)).tolist(), len(x)]
        for begin, end in zip(edges, edges[1:], strict=False):
            yield int(x[begin]), y[begin:end]


def links(a: Block, b: Block, same: bool) -> Iterator[tuple[int, np.ndarray]]:
    """Exact links between texts of two blocks, text by text of the first."""
    _, ids = np.unique(np.concatenate([a.flat, b.flat]) if not same else a.flat, return_inverse=True)  # shingles numbered
    own, other = (ids, ids) if same else (ids[: len(a.flat)], ids[len(a.flat) :])
    mark = np.zeros(int(ids.max()) + 1 if len(ids) else 0, dtype=np.int32)
    a_starts, b_starts = a.starts, b.starts
    for x, ys in candidates(a, b, same, differ=False):
        mine = own[a_starts[x] : a_starts[x] + a.sizes[x]]
        mark[mine] = 1
        if 4 * len(ys) > len(b.node):
            shared = np.add.reduceat(mark[other], b_starts)[ys]
        else:
            sizes = b.sizes[ys]
            shared = np.add.reduceat(mark[other[ragged(b_starts[ys], sizes)]], np.cumsum(sizes) - sizes)
        mark[mine] = 0
        ys = ys[shared >= THRESHOLD * (a.sizes[x] + b.sizes[ys] - shared) - 1e-9]
        if len(ys):
            yield x, ys


def merged(label: np.ndarray, x: int, ys: np.ndarray) -> None:
    """Gives x, ys and all of their labels the least of these."""
    found = np.unique(label[np.append(ys, x)])
    if len(found) > 1:
        label[np.isin(label, found)] = found[0]


class Forest:
    """Which labels a task has joined; only links that join two new ones are told."""

    def __init__(self):
        self.parent: dict[int, int] = {}
        self.told: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        while (p := self.parent.get(x, x)) != x:
            self.parent[x] = self.parent.get(p, p)
            x = p
        return x

    def join(self, a: int, b: int) -> None:
        p, q = self.root(a), self.root(b)
        if p != q:
            self.parent[max(p, q)] = min(p, q)
            self.told.append((a, b))


def groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of rows with equal keys, which may cross batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(k).to_numpy() for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0)) + 1
        edges = [0, *change.tolist(), b.num_rows]
        for x, y in zip(edges, edges[1:], strict=False):
            key = tuple(c[x] for c in cols)
            if key != last and held:
                yield pa.Table.from_batches(held)
                held = []
            last = key
            held.append(b.slice(x, y - x))
    if held:
        yield pa.Table.from_batches(held)


EDGES = "a long, b long"
FOUND = "node long, links long, label long, other long"


def _edges(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], type=pa.int64()) for k in (0, 1)], names=["a", "b"])


def _found(node: np.ndarray, count: np.ndarray, label: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, type=pa.int64()) for x in (node, count, label, other)], names=["node", "links", "label", "other"])


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)


def pieces(sizes: DataFrame, *keys: str) -> DataFrame:
    """Keys, and the number k of blocks, from the number n of texts and, if there, of their bytes."""
    k = F.ceil(F.col("n") / BLOCK)
    if "bytes" in sizes.columns:
        k = F.greatest(k, F.ceil(F.col("bytes") / BYTES))
    return sizes.select(*keys, k.cast("int").alias("k"))


def own_block() -> Column:
    return F.pmod(F.xxhash64("node"), F.col("k")).cast("int").alias("own")


def join_labels(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Edges (a, b) of labels that estimates link, from rows (bucket, node, label, sig) and sizes (bucket, n): a spanning set from each task."""
    folder = mounted(scratch(rows.sparkSession, "near-buckets"))
    os.makedirs(folder, exist_ok=True)
    counted = stored(pieces(sizes, "bucket"), "near-bucket-sizes")

    def compare(forest: Forest, a: Block, b: Block, same: bool) -> None:
        for x, ys in candidates(a, b, same, differ=True):
            for other in np.unique(b.label[ys]).tolist():
                forest.join(int(a.label[x]), other)

    def within(batches):
        for t in groups(batches, ["bucket", "own"]):
            block, forest = Block.of(t), Forest()
            compare(forest, block, block, True)
            if t["k"][0].as_py() > 1:
                block.save(f"{folder}/{t['bucket'][0].as_py()}-{t['own'][0].as_py()}")
            yield _edges(forest.told)

    def across(batches):
        for b in batches:
            for bucket, k, own in zip(*(b.column(c).to_pylist() for c in ("bucket", "k", "own")), strict=True):
                forest, block = Forest(), _loaded(f"{folder}/{bucket}-{own}")
                for j in range(own + 1, k):
                    if block and (other := _loaded(f"{folder}/{bucket}-{j}")):
                        compare(forest, block, other, False)
                yield _edges(forest.told)

    cut = rows.join(counted, "bucket").select("bucket", "k", own_block(), "node", "label", "sig")
    first = stored(dealt(cut, "bucket", "own").mapInArrow(within, EDGES), "near-mixed")
    wide = counted.where("k > 1").select("bucket", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("own"))
    return first.union(stored(wide.repartition(partitions(rows.sparkSession), "bucket", "own").mapInArrow(across, EDGES), "near-mixed-wide"))


def _loaded(path: str) -> Block | None:
    """None for a block that got no text."""
    return Block.load(path) if os.path.exists(path) else None


def count_links(sets: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """node and its number of linked rows; edges that connect the classes. From rows (node, grp, copies, sig, shingles) and sizes (grp, n, bytes)."""
    spark = sets.sparkSession
    folder = mounted(scratch(spark, "near-blocks"))
    os.makedirs(folder, exist_ok=True)
    counted = stored(pieces(sizes, "grp"), "near-group-sizes")

    def centres(batches):
        """Writes each group's centre: of its texts given here, the one with most copies; the tasks' choices compete in the last step."""
        for t in groups(batches, ["grp"]):
            block = Block.of(t)
            block.save(f"{folder}/{t['grp'][0].as_py()}-centre")
            yield pa.RecordBatch.from_arrays([pa.array([t["grp"][0].as_py()], type=pa.int64())], names=["grp"])

    def distances(batches):
        name, centre = None, np.zeros(0, dtype=np.uint64)
        for b in batches:
            out = []
            for grp, data in zip(b.column("grp").to_pylist(), b.column("shingles").to_pylist(), strict=True):
                if grp != name:
                    name, centre = grp, Block.load(f"{folder}/{grp}-centre").flat
                own = np.frombuffer(data, dtype=np.uint64)
                at = np.searchsorted(centre, own)
                at[at == len(centre)] = 0
                shared = int((centre[at] == own).sum())
                out.append(math.ceil((1 - shared / (len(own) + len(centre) - shared)) * STEPS - 1e-9))
            yield b.append_column("bin", pa.array(out, type=pa.int32()))

    def within(batches):
        for t in groups(batches, ["grp", "bin", "own"]):
            block = Block.of(t)
            grp, step, own, k = (t[c][0].as_py() for c in ("grp", "bin", "own", "k"))
            count, label = np.zeros(len(block.node), dtype=np.int64), np.arange(len(block.node))
            if 0 <= 2 * step <= REACH:
                count += block.copies.sum() - block.copies
                label[:] = 0
            else:
                for x, ys in links(block, block, True):
                    count[x] += block.copies[ys].sum()
                    count[ys] += block.copies[x]
                    merged(label, x, ys)
            block.label = block.node[label]
            if step >= 0:
                block.save(f"{folder}/{grp}-{step}-{own}")
            yield _found(block.node, count, block.node, block.label)

    def across(batches):
        for b in batches:
            for grp, step, own, bins in zip(*(b.column(c).to_pylist() for c in ("grp", "bin", "own", "bins")), strict=True):
                if (block := _loaded(f"{folder}/{grp}-{step}-{own}")) is None:
                    continue
                count, forest = np.zeros(len(block.node), dtype=np.int64), Forest()
                for other in bins:
                    if abs(other["bin"] - step) - 1 > REACH:  # too far apart
                        continue
                    all_linked = other["bin"] + step <= REACH
                    if all_linked:
                        count += other["copies"] - (block.copies.sum() if other["bin"] == step else 0)
                        for x in np.unique(block.label).tolist():
                            forest.join(x, other["least"])
                        continue
                    for j in range(other["k"]):
                        if (other["bin"], j) == (step, own) or (far := _loaded(f"{folder}/{grp}-{other['bin']}-{j}")) is None:
                            continue
                        for x, ys in links(block, far, False):
                            count[x] += far.copies[ys].sum()
                            for label in np.unique(far.label[ys]).tolist():
                                forest.join(int(block.label[x]), label)
                empty = np.zeros(len(forest.told), dtype=np.int64)
                yield _found(block.node, count, block.node, block.node)
                yield _found(np.array([x for x, _ in forest.told], dtype=np.int64), empty, np.array([x for x, _ in forest.told], dtype=np.int64), np.array([y for _, y in forest.told], dtype=np.int64))

    spread = sets.join(counted, "grp")
    few = spread.where("k = 1").select("grp", F.lit(-1).alias("bin"), F.lit(0).alias("own"), "k", "node", "copies", "sig", "shingles")
    found = [stored(dealt(few, "grp").mapInArrow(within, FOUND), "near-links")]
    many = stored(spread.where("k > 1").drop("k"), "near-large")
    if not many.isEmpty():
        best = many.groupBy("grp").agg(F.max_by("node", F.struct("copies", "node")).alias("node"))
        chosen = many.join(best, ["grp", "node"], "left_semi").select("grp", "node", "copies", "sig", "shingles")
        stored(dealt(chosen, "grp").mapInArrow(centres, "grp long"), "near-centres")
        binned = stored(many.select("grp", "node", "copies", "sig", "shingles").mapInArrow(distances, "grp long, node long, copies long, sig binary, shingles binary, bin int"), "near-binned")
        each = binned.groupBy("grp", "bin").agg(F.count_distinct("node").alias("n"), F.sum(F.length("shingles")).alias("bytes"), F.sum("copies").alias("copies"), F.min("node").alias("least"))
        bins = stored(each.join(pieces(each, "grp", "bin"), ["grp", "bin"]).drop("n", "bytes"), "near-bins")
        rows = binned.join(bins.select("grp", "bin", "k"), ["grp", "bin"]).select("grp", "bin", own_block(), "k", "node", "copies", "sig", "shingles")
        found.append(stored(dealt(rows, "grp", "bin", "own").mapInArrow(within, FOUND), "near-links"))
        listed = bins.groupBy("grp").agg(F.collect_list(F.struct("bin", "k", "copies", "least")).alias("bins"))  # STEPS + 1 at most
        blocks = bins.select("grp", "bin", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("own")).join(listed, "grp")
        found.append(stored(blocks.repartition(partitions(spark), "grp", "bin", "own").select("grp", "bin", "own", "bins").mapInArrow(across, FOUND), "near-links"))
    rows = functools.reduce(DataFrame.union, found)
    return rows.groupBy("node").agg(F.sum("links").alias("links")), rows.where("label != other").select(F.col("label").alias("a"), F.col("other").alias("b"))


def candidate_groups(signed: DataFrame) -> DataFrame:
    """node and label of the texts that the estimates link to others."""
    texts = stored(signed.where("node is not null").select("node", "sig", "bands").dropDuplicates(["node"]), "near-texts")
    bands = texts.select("node", F.explode("bands").alias("bucket"))
    pivots = bands.groupBy("bucket").agg(F.min("node").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = stored(bands.join(pivots.select("bucket", "pivot"), "bucket"), "near-members")
    pairs = members.where("node != pivot").select("node", "pivot").distinct()
    sig = texts.select("node", "sig")
    with_sig = pairs.join(sig, "node").join(sig.select(F.col("node").alias("pivot"), F.col("sig").alias("other")), "pivot")

    def prune(batches):
        for b in batches:
            if b.num_rows:
                a, o = (np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(-1, HASHES) for c in ("sig", "other"))
                alive = pa.array(survivors(a, o))
                yield pa.RecordBatch.from_arrays([b.column("node").take(alive), b.column("pivot").take(alive)], names=["a", "b"])

    edges = stored(with_sig.select("node", "pivot", "sig", "other").mapInArrow(prune, EDGES), "near-pivots")
    labels = connect(edges, "near-pivots")
    named = members.join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    mixed = named.groupBy("bucket").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("members")).where("x != y")
    mixed = stored(mixed.groupBy("n", "members").agg(F.min("bucket").alias("bucket")).select("bucket", "n"), "near-mixed-buckets")  # one of the buckets with the same texts
    rest = named.join(mixed.select("bucket"), "bucket").join(sig, "node")
    more = join_labels(rest, mixed)
    return labels if more.isEmpty() else connect(edges.union(more), "near-all")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id and n_links (linked rows, copies counted) for each row of docs (doc_id, text; nothing else is read).

    A text without words, or null, has no shingles: no links, a class of its own. A text of fewer than five words has one
    shingle, all its words. Rows with a null doc_id get null and 0 and link nothing; rows with the same doc_id and text are
    copies. Case and punctuation count.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"))
    signed = stored(sign(rows.where("doc_id is not null")), "near-signed")
    labels = stored(candidate_groups(signed), "near-groups")
    copies = signed.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"), F.min("size").alias("size"))
    chosen = stored(labels.join(copies, "node"), "near-chosen")  # texts in groups, with the document to read each from

    def cut(batches):
        """Shingle sets and estimates of the texts that are the wanted ones; equal doc_ids may hold others."""
        for b in bounded(batches, "t"):
            nodes, parts, numbers = read_texts(b.column("t").to_pylist())
            keep = np.flatnonzero((numbers > 0) & (nodes.view(np.int64) == b.column("node").to_numpy()))
            starts = np.cumsum(numbers) - numbers
            sig = estimates(minhash(parts[ragged(starts[keep], numbers[keep])], numbers[keep]))
            sets = [np.unique(parts[s : s + n]).tobytes() for s, n in zip(starts[keep].tolist(), numbers[keep].tolist(), strict=True)]
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in ("node", "grp", "copies")), pa.array([x.tobytes() for x in sig], type=pa.binary()), pa.array(sets, type=pa.binary())], names=["node", "grp", "copies", "sig", "shingles"])

    wanted = chosen.select(F.col("first").alias("doc_id"), "node", F.col("label").alias("grp"), "copies")
    sets = rows.join(small(wanted), "doc_id").select("t", "node", "grp", "copies").mapInArrow(cut, "node long, grp long, copies long, sig binary, shingles binary")
    sizes = chosen.groupBy(F.col("label").alias("grp")).agg(F.count("*").alias("n"), F.sum(8 * F.col("size")).alias("bytes"))
    found, edges = count_links(stored(sets, "near-sets"), sizes)
    classes = connect(edges, "near-classes")
    nodes = copies.join(classes, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = nodes.groupBy("label").agg(F.min("first").alias("class_id"))
    told = stored(nodes.join(least, "label").join(found, "node", "left").select("node", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "near-told")
    out = signed.select("doc_id", "node").join(told, "node", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    return out.unionByName(rows.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("class_id"), F.lit(0).cast("long").alias("n_links")))


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
