"""Benchmark decontamination (operator 3) by latent semantic retrieval.

1. Every word of every document is counted; a passage is a bag of hashed words (FEATURES), each weighted by the logarithm of
   all occurrences over its own.
2. A randomised SVD of the passages of all documents, one beginning at every block, gives the corpus' first COMMON latent
   directions, what passages of a language share: tasks add up their passages, each times its products with the same random
   vectors, the driver orthonormalises that matrix of fixed size, and tasks then add up the small Gram matrix in that basis.
   Both passes read the features of all words, which are found and stored once.
   Each passage of the benchmark, less its part in those directions, is a direction of the search space of its own, so that the
   space grows with the benchmark and holds every item whole.
3. All documents are cut into blocks of BLOCK words. Windows of SHORT and LONG blocks, one beginning at every block, are
   compared with the benchmark's passages (those of up to SHORT_ITEM words with the short windows), COLUMNS of them at a time,
   read from files of PORTION items, so that one pass over the documents serves any benchmark. Pairs of cosine NEAR or more are
   candidates; a window counts with its whole length.
4. The longest common subsequence of an item and the words about the window decides: STRONG of the item's words in order, or
   WEAK of them and all of the answer, the item's last sentence.
"""

from __future__ import annotations

import json
import os
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import atomic_write, estimate, mounted, prepare, scratch, stored, table, text_bytes
from .words import bounded, hashes, joined, lowered, ragged, release, spans

FEATURES, RANK, OVERSAMPLE, COMMON, PORTION = 1 << 15, 96, 12, 8, 1024
BLOCK, SHORT, LONG, SHORT_ITEM, LONGEST = 12, 2, 5, 30, 60
NEAR, STRONG, WEAK = 0.2, 0.6, 0.45
FAR_EDGES = "«»“”‘’„…–—¿¡"
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + FAR_EDGES
IS_EDGE = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])
#: Words whose plain forms a worker remembers.
CACHE_WORDS = 100_000
#: Passages that windows are compared with at once, and blocks of a step: these bound the memory of a task.
COLUMNS, STEP = 256, 2048
#: A passage with less than this share of its length outside the shared directions is compared whole.
OWN = 0.5
#: Windows that begin in so many blocks in a row are checked together, and words looked up at once.
TOGETHER, LOOKUPS = 4, 1_000_000
#: A feature with more words than that among the blocks of a step is added up by a product of matrices.
OFTEN = 32
#: Features to a row when sums of tasks are dealt out, and bytes of stored features to a task whose sums have RANK + OVERSAMPLE columns.
ROWS, SHARE = 1024, 1 << 26


class Plain(dict):
    """word -> the word in lower case without punctuation about it, remembered."""

    def __missing__(self, word: bytes) -> str:
        if len(self) >= CACHE_WORDS:
            self.clear()
        w = word.decode("utf-8", "replace").lower()
        p = self[word] = w.strip(EDGES) or w
        return p


_plain = Plain()


def plain(word: bytes) -> str:
    return _plain[word]


def folded(text: bytes) -> bytes:
    """In lower case but for A-Z, which features() folds; EDGES beyond ASCII turned into an ASCII one."""
    if text.isascii():
        return text
    t = text.decode("utf-8", "replace").lower()
    for c in FAR_EDGES:
        if c in t:
            t = t.replace(c, '"')
    return t.encode()


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all texts' words, and the number of words of each text. Words with the same plain() have the same feature."""
    raw, borders = joined([folded(t) for t in texts])
    raw = lowered(raw)
    starts, ends = spans(raw)
    counts = np.diff(np.searchsorted(starts, borders), prepend=0)
    begin, end = starts.copy(), ends.copy()
    for at, place, step in ((begin, 0, 1), (end, -1, -1)):
        left = np.flatnonzero(IS_EDGE[raw[at + place]])
        for _ in range(16):
            at[left] += step
            left = left[begin[left] < end[left]]
            left = left[IS_EDGE[raw[at[left] + place]]]
        for k in left.tolist():  # longer runs of punctuation
            inner = np.flatnonzero(~IS_EDGE[raw[begin[k] : end[k]]])
            at[k] = end[k] if not len(inner) else begin[k] + inner[0] if step > 0 else begin[k] + inner[-1] + 1
    bare = begin < end  # a word of punctuation alone stays whole
    return (hashes(raw, np.where(bare, begin, starts), np.where(bare, end, ends)) & np.uint64(FEATURES - 1)).astype(np.int32), counts


def blocks(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all texts in rows of BLOCK, FEATURES where there is no word, LONG - 1 empty rows after each; first row of each text; numbers of words."""
    return dealt(*features(texts))


def dealt(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The blocks of texts whose features are given."""
    rows = -(-sizes // BLOCK) + LONG - 1
    first = np.cumsum(rows) - rows
    out = np.full(int(rows.sum()) * BLOCK, FEATURES, dtype=np.int32)
    out[ragged(first * BLOCK, sizes)] = flat
    return out.reshape(-1, BLOCK), first, sizes


def window_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of n rows from each row on; rows past the end count as zero."""
    out = x.copy()
    for k in range(1, n):
        out[:-k] += x[k:]
    return out


def _dealt(frame: DataFrame, width: int, kind: str) -> np.ndarray:
    """Adds up arrays of FEATURES rows that tasks give in pieces (piece int, data binary); what comes to the driver has a fixed size."""

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for p, d in zip(b.column("piece").to_pylist(), b.column("data").to_pylist(), strict=True):
                x = np.frombuffer(d, dtype=kind)
                total[p] = total[p] + x if p in total else x
        yield pa.RecordBatch.from_arrays([pa.array(list(total), type=pa.int32()), pa.array([x.tobytes() for x in total.values()], type=pa.binary())], names=["piece", "data"])

    out = np.zeros((FEATURES, width), dtype=kind)
    pieces = FEATURES // ROWS
    for r in frame.repartitionById(pieces, F.col("piece")).mapInArrow(add, "piece int, data binary").collect():
        out[r.piece * ROWS : (r.piece + 1) * ROWS] = np.frombuffer(r.data, dtype=kind).reshape(-1, width)
    return out


def _pieces(x: np.ndarray) -> pa.RecordBatch:
    cut = [x[k : k + ROWS].tobytes() for k in range(0, FEATURES, ROWS)]
    return pa.RecordBatch.from_arrays([pa.array(range(len(cut)), type=pa.int32()), pa.array(cut, type=pa.binary())], names=["piece", "data"])


def featured(texts: DataFrame) -> DataFrame:
    """The features of each text (binary t) as binary f, two bytes each, stored: words are found and hashed once for all that asks no more."""

    def run(batches):
        for b in bounded(batches, "t"):
            flat, sizes = features(b.column("t").to_pylist())
            ends = np.concatenate([[0], 2 * np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(flat.astype("<u2"))])], names=["f"])

    return stored(texts.mapInArrow(run, "f binary"), "features")


def read(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Features and numbers of words, as features() gives them, of a column f."""
    texts = column.to_pylist()
    return np.frombuffer(b"".join(texts), dtype="<u2").astype(np.int32), np.array([len(t) // 2 for t in texts], dtype=np.int64)


def occurrences(rows: DataFrame) -> np.ndarray:
    """Occurrences of each feature in all rows of featured()."""

    def count(batches):
        total = np.zeros(FEATURES, dtype=np.int64)
        for b in bounded(batches, "f"):
            total += np.bincount(read(b.column("f"))[0], minlength=FEATURES)
        yield _pieces(total)

    return _dealt(rows.mapInArrow(count, "piece int, data binary"), 1, "int64")[:, 0]


def row_sums(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of the rows of a table that each row of at names, BLOCK of them."""
    out = table[at[:, 0]]
    more = np.empty_like(out)
    for k in range(1, BLOCK):
        np.take(table, at[:, k], axis=0, out=more, mode="clip")
        out += more
    return out


def projected(grid: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the passages of length 1 that begin in the grid but for its last rows: which rows begin one, products with the table, 1 / length before.

    A passage is a long window that begins at a block of a text. The table has a row for each feature, times its weight, and the squared weight last.
    """
    n = len(grid) - LONG + 1
    x = window_sums(row_sums(table, grid), LONG)[:n]
    begins = grid[:n, 0] < FEATURES
    scale = np.where(begins, 1 / np.sqrt(np.maximum(x[:, -1], 1e-9)), 0).astype(np.float32)
    return begins, x[:, :-1] * scale[:, None], scale


def add_rows(total: np.ndarray, grid: np.ndarray, rows: np.ndarray) -> None:
    """Adds to the total of each feature the row of each of its words."""
    feature = grid.reshape(-1).astype(np.uint16)  # sorted by radix
    order = np.argsort(feature, kind="stable")
    feature = feature[order]
    n = int(np.searchsorted(feature, FEATURES))
    feature, row = feature[:n], order[:n] // BLOCK
    first = np.flatnonzero(np.diff(feature.astype(np.int32), prepend=-1))
    times = np.diff(first, append=n)
    by = np.argsort(-times, kind="stable")
    first, times = first[by], times[by]
    often = int(np.count_nonzero(times > OFTEN))
    if often:  # as a product of matrices
        at = np.repeat(np.arange(often), times[:often]) * len(grid) + row[ragged(first[:often], times[:often])]
        total[feature[first[:often]]] += np.bincount(at, minlength=often * len(grid)).reshape(often, -1).astype(np.float32) @ rows
    first, times = first[often:], times[often:]
    if len(first):  # the k-th words of all others at once
        own = rows[row[first]]
        for k in range(1, int(times[0])):
            m = int(np.count_nonzero(times > k))
            own[:m] += rows[row[first[:m] + k]]
        total[feature[first]] += own


def steps(column: pa.Array) -> Iterator[np.ndarray]:
    """The blocks of all texts of a column f, STEP rows and the LONG - 1 after them at a time: each passage begins in one of the former."""
    grid, _, _ = dealt(*read(column))
    return (grid[at : at + STEP + LONG - 1] for at in range(0, len(grid) - LONG + 1, STEP))


def weighted(columns: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The table of projected(); FEATURES stands for no word."""
    table = np.zeros((FEATURES + 1, columns.shape[1] + 1), dtype=np.float32)
    table[:-1, :-1] = columns * weight[:, None]
    table[:-1, -1] = weight * weight
    return table


def basis_of(y: np.ndarray) -> np.ndarray:
    """An orthonormal basis of the columns' space, by their products with each other; y is tall, and copied once at most."""
    products = np.zeros((y.shape[1], y.shape[1]))
    for k in range(0, len(y), ROWS):
        own = y[k : k + ROWS].astype(np.float64)
        products += own.T @ own
    values, vectors = np.linalg.eigh(products)
    real = values > max(1e-10 * values[-1], 1e-30)
    return y @ (vectors[:, real] / np.sqrt(values[real])).astype(np.float32)


def shared_directions(rows: DataFrame, weight: np.ndarray) -> np.ndarray:
    """FEATURES x COMMON at most: the first right singular vectors of the passages of all rows of featured(), however they are dealt out.

    Tasks are few, as what each gives is as large as the space, whatever it has read.
    """
    spark = rows.sparkSession
    width = RANK + OVERSAMPLE
    w = spark.sparkContext.broadcast(weight.astype(np.float32))

    def project(batches):
        table = weighted(np.random.default_rng(RANK).standard_normal((FEATURES, width), dtype=np.float32), w.value)
        total = np.zeros((FEATURES, width), dtype=np.float32)
        for b in bounded(batches, "f"):
            for grid in steps(b.column("f")):
                _, x, scale = projected(grid, table)
                x *= scale[:, None]
                about = np.zeros((len(grid), width), dtype=np.float32)  # of each block, the sum over its passages
                for k in range(LONG):
                    about[k : k + len(x)] += x
                add_rows(total, grid, about)
        total *= w.value[:, None]
        yield _pieces(total)

    few = rows.coalesce(max(spark.sparkContext.defaultParallelism, estimate(rows) // SHARE))
    q = basis_of(_dealt(few.mapInArrow(project, "piece int, data binary"), width, "float32"))
    basis, width = spark.sparkContext.broadcast(q), q.shape[1]

    def gram(batches):
        table, total = weighted(basis.value, w.value), np.zeros((width, width))
        for b in bounded(batches, "f"):
            for grid in steps(b.column("f")):
                begins, x, _ = projected(grid, table)
                x = x[begins]
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], type=pa.binary())], names=["data"])

    corpus = sum((np.frombuffer(r.data).reshape(width, width) for r in few.mapInArrow(gram, "data binary").collect()), np.zeros((width, width)))
    basis.destroy()
    values, vectors = np.linalg.eigh(corpus)
    return q @ vectors[:, ::-1][:, :COMMON][:, values[::-1][:COMMON] > 1e-9].astype(np.float32)


class Passages:
    """COLUMNS passages at most, as columns over their own features: they turn sums of words into cosines with windows."""

    def __init__(self, parts: list[tuple[int, np.ndarray]], whole: list[np.ndarray], weight: np.ndarray, shared: np.ndarray):
        self.owner = np.array([k for k, _ in parts], dtype=np.int64)
        items = sorted({k for k, _ in parts})
        self.item = dict(zip(items, range(len(items)), strict=True))
        self.place = np.zeros((len(items), FEATURES + 1), dtype=np.uint16)  # of an item's distinct features, from 1
        distinct = [np.unique(whole[k], return_counts=True) for k in items]
        self.times = np.zeros((len(items), max(len(f) for f, _ in distinct) + 1), dtype=np.int64)
        for i, (f, n) in enumerate(distinct):
            self.place[i, f] = np.arange(1, len(f) + 1)
            self.times[i, 1 : len(f) + 1] = n
        col = np.repeat(np.arange(len(parts)), [len(f) for _, f in parts])
        feature = np.concatenate([f for _, f in parts])
        own, at = np.unique(feature, return_inverse=True)
        columns = np.zeros((len(own), len(parts)), dtype=np.float32)
        np.add.at(columns, (at, col), weight[feature])
        whole = np.maximum(np.linalg.norm(columns, axis=0), 1e-9)
        self.common = shared[own].T @ columns
        length = np.sqrt(np.maximum(whole**2 - (self.common**2).sum(axis=0), 0))
        mostly = length < OWN * whole
        self.common[:, mostly] = 0
        length = np.where(mostly, whole, length)
        self.common /= length
        self.table = np.concatenate([columns / length * weight[own][:, None], np.zeros((1, len(parts)), dtype=np.float32)]).astype(np.float32)
        self.at = np.full(FEATURES + 1, len(own), dtype=np.int32)
        self.at[own] = np.arange(len(own))

    def sums(self, grid: np.ndarray) -> np.ndarray:
        """Products of each row of the grid with the passages, shared directions counted."""
        return row_sums(self.table, self.at[grid])

    def shared_words(self, flat: np.ndarray, item: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """For each span of words and its item, how many words they share at most, in any order."""
        out = np.zeros(len(item), dtype=np.int64)
        width, sizes = self.times.shape[1], end - begin
        cuts = np.searchsorted(np.cumsum(sizes), np.arange(LOOKUPS, int(sizes.sum()), LOOKUPS)).tolist()
        for a, b in zip([0, *cuts], [*cuts, len(item)], strict=True):
            if a < b:
                who = np.repeat(np.arange(b - a), sizes[a:b])
                place = self.place[item[a:b][who], flat[ragged(begin[a:b], sizes[a:b])]]
                seen = np.bincount(who * width + place, minlength=(b - a) * width).reshape(-1, width)
                out[a:b] = np.minimum(seen, self.times[item[a:b]]).sum(axis=1)
        return out


class Words:
    """The words of a batch's texts, those of one text at a time."""

    def __init__(self, texts: list[bytes]):
        self.texts, self.last, self.words = texts, -1, []

    def of(self, d: int) -> list[bytes]:
        if d != self.last:
            self.last, self.words = d, self.texts[d].split()
        return self.words


def common(m: dict, n: int, other: list) -> int:
    """Length of the longest common subsequence of n words, whose places m has as bits, and other words (Hyyro)."""
    full = v = (1 << n) - 1
    for w in other:
        if u := v & m.get(w, 0):
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def places(words: list) -> dict:
    m: dict = defaultdict(int)
    for k, w in enumerate(words):
        m[w] |= 1 << k
    return dict(m)


class Item:
    """A benchmark item: its words, its answer's words, and its passages for the search."""

    def __init__(self, item_id: int, text: str):
        self.id = item_id
        self.words = [plain(w) for w in text.encode().split()]
        last = [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if s.strip()]
        self.answer = [plain(w) for w in last[-1].encode().split()] if len(last) > 1 else []
        self.at, self.answer_at, self.times = places(self.words), places(self.answer), Counter(self.words)

    def found(self, region: list[str]) -> float:
        """Share of the words found in order, negative if that is too little. Fewer words than WEAK asks for need no ordering."""
        region = [w for w in region if w in self.at]
        shared = sum(min(n, self.times[w]) for w, n in Counter(region).items())
        if shared < WEAK * len(self.words):
            return -shared / len(self.words)
        share = common(self.at, len(self.words), region) / len(self.words)
        if share >= STRONG or share >= WEAK and self.answer and common(self.answer_at, len(self.answer), region) == len(self.answer):
            return share
        return -share


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (ascending) and best_share for each row of docs (doc_id, text; nothing else is read).

    A null text counts as empty and is clean; benchmark items without words, or null, find nothing; null ids stay null;
    repeated rows are judged alike. An empty benchmark finds nothing.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("t"))
    rows = featured(docs.select("t"))
    counts = occurrences(rows)
    weight = np.log((counts.sum() + 1) / (counts + 1)) + 0.1
    shared = shared_directions(rows, weight)
    release()
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("trim(text) != ''")
    return search(docs, portions(items), spark.sparkContext.broadcast((weight.astype(np.float32), shared)))


def portions(items: DataFrame) -> list[str]:
    """Files in the shared folder with about PORTION items each, which hold item_id and text."""
    folder = mounted(scratch(items.sparkSession, "benchmark"))
    os.makedirs(folder, exist_ok=True)
    n = max(1, -(-items.count() // PORTION))

    def write(batches):
        own: dict[int, list] = {}
        for b in batches:
            for k, i, t in zip(*(b.column(c).to_pylist() for c in ("portion", "item_id", "text")), strict=True):
                own.setdefault(k, []).append((i, t))
        for k, entries in own.items():
            atomic_write(f"{folder}/{k}", json.dumps(sorted(entries, key=lambda e: (e[0] is None, e))).encode())
        yield pa.RecordBatch.from_arrays([pa.array(list(own), type=pa.int32())], names=["portion"])

    dealt = items.withColumn("portion", F.pmod(F.xxhash64("item_id", "text"), F.lit(n)).cast("int")).repartitionById(n, F.col("portion"))
    stored(dealt.select("portion", "item_id", "text").mapInArrow(write, "portion int"), "benchmark-portions")
    return [f"{folder}/{k}" for k in range(n)]


class Portion:
    """Items of a file, their passages for short and for long windows in groups of COLUMNS."""

    def __init__(self, path: str, weight: np.ndarray, shared: np.ndarray):
        entries = json.loads(open(path, "rb").read()) if os.path.exists(path) else []
        self.items = [Item(i, t) for i, t in entries]
        whole = [features([t.encode()])[0] for _, t in entries]
        parts: dict[int, list[tuple[int, np.ndarray]]] = {SHORT: [], LONG: []}
        for k, own in enumerate(whole):
            for at in range(0, max(1, len(own) - LONGEST // 2), LONGEST // 2):
                part = own[at : at + LONGEST]
                parts[SHORT if len(part) <= SHORT_ITEM else LONG].append((k, part))
        self.groups = [(n, Passages(own[x : x + COLUMNS], whole, weight, shared)) for n, own in parts.items() for x in range(0, len(own), COLUMNS)]


def search(docs: DataFrame, files: list[str], space) -> DataFrame:
    """The verdict of each row, from all files of items; a task holds one of them at a time."""

    def run(batches):
        weight, shared = space.value
        base = np.concatenate([np.concatenate([shared * weight[:, None], (weight * weight)[:, None]], axis=1), np.zeros((1, shared.shape[1] + 1), dtype=np.float32)])
        last: Portion | None = None
        for b in bounded(batches, "t"):
            texts = b.column("t").to_pylist()
            grid, first, sizes = blocks(texts)
            flat, words = grid.reshape(-1), Words(texts)
            alone = np.concatenate([row_sums(base, grid[at : at + STEP]) for at in range(0, len(grid), STEP)])
            rest = {n: window_sums(alone, n) for n in (SHORT, LONG)}
            found: list[dict] = [{} for _ in texts]
            for path in files:
                portion = last = last if last and len(files) == 1 else Portion(path, weight, shared)
                hits: list[dict[int, float]] = [{} for _ in texts]
                for n, compared in portion.groups:
                    for at in range(0, len(grid), STEP):
                        other = rest[n][at : at + STEP]
                        near = window_sums(compared.sums(grid[at : at + STEP + LONG - 1]), n)[:STEP] - other[:, :-1] @ compared.common
                        row, col = np.divmod(np.flatnonzero(near >= NEAR * np.sqrt(np.maximum(other[:, -1:], 1e-9))), near.shape[1])
                        if len(row):
                            check(portion.items, compared, col, row + at, n, first, sizes, flat, words, hits)
                for of_all, own in zip(found, hits, strict=True):
                    for k, share in own.items():
                        of_all[portion.items[k].id] = max(share, of_all.get(portion.items[k].id, 0.0))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([bool(f) for f in found]), pa.array([sorted(i for i in f if i is not None) for f in found], type=pa.list_(pa.int64())), pa.array([max(f.values(), default=0.0) for f in found], type=pa.float64())], names=["doc_id", "contaminated", "item_ids", "best_share"])

    return docs.mapInArrow(run, "doc_id long, contaminated boolean, item_ids array<long>, best_share double")


def check(items: list[Item], compared: Passages, col: np.ndarray, row: np.ndarray, n: int, first: np.ndarray, sizes: np.ndarray, flat: np.ndarray, words: Words, found: list[dict[int, float]]) -> None:
    """Adds to found, for each text, the items that are about their candidate windows of n blocks, which begin at ascending rows.

    Candidates of TOGETHER rows are one; those whose words are too few for WEAK in any order need no subsequence.
    """
    owner = compared.owner[col]
    doc = np.searchsorted(first, row, side="right") - 1
    at = row - first[doc]
    order = np.lexsort((at, at // TOGETHER, owner, doc))
    doc, owner, at = doc[order], owner[order], at[order]
    new = np.flatnonzero(np.diff(doc, prepend=-1) | np.diff(owner, prepend=-1) | np.diff(at // TOGETHER, prepend=-1))
    last = np.append(new[1:], len(at)) - 1
    doc, owner, begin, end = doc[new], owner[new], at[new], at[last]
    length = np.array([len(i.words) for i in items], dtype=np.int64)[owner]
    begin, end = np.maximum(0, begin * BLOCK - length), np.minimum(sizes[doc], (end + n) * BLOCK + length)
    inside = begin < end
    doc, owner, begin, end, length = (x[inside] for x in (doc, owner, begin, end, length))
    item = np.fromiter(map(compared.item.__getitem__, owner.tolist()), dtype=np.int64, count=len(owner))
    shared = compared.shared_words(flat, item, first[doc] * BLOCK + begin, first[doc] * BLOCK + end)
    for k in np.flatnonzero(shared >= WEAK * length).tolist():
        d, i = int(doc[k]), int(owner[k])
        if i not in found[d]:
            share = items[i].found(list(map(_plain.__getitem__, words.of(d)[begin[k] : end[k]])))
            if share > 0:
                found[d][i] = share


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
