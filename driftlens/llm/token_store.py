"""Token-ID output (operator 7): a content-addressed store of token ids.

A hash rolling over ROLL ids, begun anew in each document, cuts its ids into chunks, so that equal passages give equal chunks
and equal documents the same ones. Each distinct chunk is stored once, in the pack that its digest's leading bits name. A
document's recipe lists its chunks' digests; recipes lie in files of ascending doc_id. Over them stands a Merkle tree: a leaf
for each recipe (doc_id, start, tokens and chunks) in order, and level by level a digest of PAGE neighbours, up to the root in
the manifest, which does not depend on how the recipes are dealt over files. Reading back first computes the tree anew, so that
a lost, repeated, moved or changed recipe is noticed, and then maps the packs into memory and checks every chunk and leaf.

A pack: magic, number of chunks, digests ascending, end offsets in ids, then the ids as little-endian unsigned 16-bit
numbers (32-bit if the vocabulary needs them).
"""

from __future__ import annotations

import hashlib
import json
import mmap
import os
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import SLICE, encoder, tokenizer_path
from .cluster import atomic_write, mounted, partitions, prepare, scratch, shards, stored, table
from .words import bounded, mix

#: Id after each document; ids that the rolling hash sees; mean and greatest ids of a chunk.
END_ID, ROLL, MEAN, MOST = 2, 16, 256, 1024
#: Digests under one of the next level, and bytes of input for a pack.
PAGE, PACK = 1024, 128 << 20
MAGIC, DIGEST = b"IDPACK01", 16
RECIPE = "part int, place long, doc_id long, start long, n_tokens long, digests binary, leaf string"


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


def cut_points(ids: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Ends of chunks, those of a document being its own: where the rolling hash is 0 modulo MEAN, at each document's end (ascending), and every MOST ids between."""
    spread = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(mix(ids.astype(np.uint64) + np.uint64(1)))])
    rolled = spread[ROLL:] - spread[:-ROLL] if len(ids) >= ROLL else np.zeros(0, dtype=np.uint64)
    cuts = np.flatnonzero((mix(rolled) & np.uint64(MEAN - 1)) == 0) + ROLL
    document = np.searchsorted(ends, cuts)  # a cut lies in (end before, end]
    cuts = cuts[cuts - np.concatenate([[0], ends[:-1]])[document] >= ROLL] if len(ends) else cuts
    cuts = np.union1d(cuts, ends)
    begins = np.concatenate([[0], cuts[:-1]])
    more = [np.arange(b + MOST, e, MOST) for b, e in zip(begins[cuts - begins > MOST], cuts[cuts - begins > MOST], strict=True)]
    return np.union1d(cuts, np.concatenate(more)) if more else cuts


def leaf(doc_id: int | None, n: int, digests: bytes) -> str:
    return digest(f"{doc_id}:{n}:".encode() + digests).hex()


def files_of(told: DataFrame) -> list[dict]:
    """For each file of recipes its documents and ids, and how many come before it; a row for each file comes to the driver."""
    files, docs, ids = [], 0, 0
    for r in told.groupBy("part").agg(F.count("*").alias("docs"), F.sum("n_tokens").alias("ids")).orderBy("part").collect():
        files.append({"part": r.part, "docs": r.docs, "ids": r.ids, "docs_before": docs, "ids_before": ids})
        docs, ids = docs + r.docs, ids + r.ids
    return files


def root_of(told: DataFrame, files: list[dict]) -> str:
    """Root of the Merkle tree of all recipes in order: PAGE neighbours are one digest of the next level, until one is left."""
    if not files:
        return digest(b"").hex()
    before = told.sparkSession.createDataFrame([(f["part"], f["docs_before"], f["ids_before"]) for f in files], "part int, docs_before long, ids_before long")
    level = told.join(F.broadcast(before), "part").select((F.col("docs_before") + F.col("place")).alias("place"), F.concat_ws(":", (F.col("ids_before") + F.col("start")).cast("string"), "leaf").alias("digest"))
    entry = lambda s: F.concat_ws(":", s.place.cast("string"), s.digest)
    left = sum(f["docs"] for f in files)
    while True:
        page = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "digest"))), entry), ",")
        level = level.groupBy(F.floor(F.col("place") / PAGE).cast("long").alias("place")).agg(F.sha2(page, 256).alias("digest"))
        left = -(-left // PAGE)
        if left <= 1:
            rows = level.limit(2).collect()
            return rows[0].digest if len(rows) == 1 else "more than one"


#: A chunk (pack, digest, ids) or a document's recipe (pack: any; doc_id, n_tokens, digests).
STAGED = "pack int, doc_id long, n_tokens long, digests binary, ids binary"
STAGED_SCHEMA = pa.schema([("pack", pa.int32()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("digests", pa.binary()), ("ids", pa.binary())])


@dataclass
class Store:
    path: str
    packs: int
    width: int
    root: str


def write(docs: DataFrame, tokenizer: str | None = None) -> Store:
    """Encodes every whole text of docs (doc_id, text; null text: empty), appends END_ID and writes the store.

    Rows with equal doc_ids are ordered by their digests; null doc_ids come first. Nothing else of docs is read.
    """
    spark = docs.sparkSession
    prepare(spark)
    token_path = tokenizer or tokenizer_path()
    width = 2 if len(encoder(token_path).token) <= 1 << 16 else 4
    packs = shards(docs, 64, PACK)
    shift = 32 - (packs.bit_length() - 1)
    path = mounted(scratch(spark, "token-store"))
    os.makedirs(path, exist_ok=True)

    def stage(batches):
        enc = encoder(token_path)
        for b in bounded(batches, "text", SLICE, keep=True):
            encoded, counts = enc.encode(b.column("text").cast(pa.binary()).to_pylist())
            ids = np.full(len(encoded) + len(counts), END_ID, dtype=np.uint32)  # END_ID after each document
            ids[np.arange(len(encoded)) + np.repeat(np.arange(len(counts)), counts)] = encoded
            counts = counts + 1
            ends = np.cumsum(counts)
            cuts = cut_points(ids, ends)
            data, seen = ids.astype(f"<u{width}").tobytes(), set()
            rows, begin, k = [], 0, 0
            for r, (doc_id, n, end) in enumerate(zip(b.column("doc_id").to_pylist(), counts.tolist(), ends.tolist(), strict=True)):
                own = []
                while begin < end:
                    stop = int(cuts[k])
                    piece = data[begin * width : stop * width]
                    d = digest(piece)
                    own.append(d)
                    if d not in seen:
                        seen.add(d)
                        rows.append((int.from_bytes(d[:4], "big") >> shift, None, None, d, piece))
                    begin, k = stop, k + 1
                rows.append((r % packs, doc_id, n, b"".join(own), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), STAGED_SCHEMA, strict=True)], schema=STAGED_SCHEMA)

    def pack(batches):
        """Writes the packs; passes the recipes on, and the number of chunks as a row without tokens."""
        found: dict[int, dict[bytes, bytes]] = {}
        for b in batches:
            of_docs = b.filter(pc.is_valid(b.column("n_tokens")))
            yield of_docs.select(["doc_id", "n_tokens", "digests"])
            chunks = b.filter(pc.is_null(b.column("n_tokens")))
            for p, d, i in zip(*(chunks.column(c).to_pylist() for c in ("pack", "digests", "ids")), strict=True):
                found.setdefault(p, {}).setdefault(d, i)
        for p, chunks in found.items():
            order = sorted(chunks)
            ends = np.cumsum([len(chunks[d]) // width for d in order]).astype("<u8")
            atomic_write(f"{path}/pack-{p}", b"".join([MAGIC, np.array([len(order)], dtype="<u8").tobytes(), *order, ends.tobytes(), *(chunks[d] for d in order)]))
            yield pa.RecordBatch.from_arrays([pa.array([len(order)], type=pa.int64()), pa.array([None], type=pa.int64()), pa.array([None], type=pa.binary())], names=["doc_id", "n_tokens", "digests"])

    def recipe(batches):
        """In a file's order: each document's place in it, and the leaf of the tree."""
        part, at, place = TaskContext.get().partitionId(), 0, 0
        for b in batches:
            n = b.column("n_tokens").to_numpy()
            lists = b.column("digests").to_pylist()
            starts = at + np.cumsum(n) - n
            places = np.arange(place, place + len(n))
            at, place = at + int(n.sum()), place + len(n)
            leaves = [leaf(*x) for x in zip(b.column("doc_id").to_pylist(), n.tolist(), lists, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(n), type=pa.int32()), pa.array(places), b.column("doc_id"), pa.array(starts), pa.array(n), pa.array(lists, type=pa.binary()), pa.array(leaves, type=pa.string())], names=["part", "place", "doc_id", "start", "n_tokens", "digests", "leaf"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    staged = rows.mapInArrow(stage, STAGED).repartitionById(packs, F.col("pack"))
    told = stored(staged.mapInArrow(pack, "doc_id long, n_tokens long, digests binary"), "token-recipes")
    n_chunks = told.where("n_tokens is null").agg(F.sum("doc_id")).first()[0]
    ordered = told.where("n_tokens is not null").withColumn("tie", F.xxhash64("digests")).repartitionByRange(partitions(spark), "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "digests")
    ordered.drop("tie").mapInArrow(recipe, RECIPE).write.parquet(f"file://{path}/recipes")
    told = recipes(spark, path)
    files = files_of(told)
    manifest = {"version": 2, "width": width, "packs": packs, "chunks": n_chunks or 0, "ids": sum(f["ids"] for f in files), "files": files, "root": root_of(told, files)}
    atomic_write(f"{path}/manifest.json", json.dumps(manifest).encode())
    return Store(path, packs, width, manifest["root"])


def recipes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECIPE).parquet(f"file://{path}/recipes")


class Packs:
    """The packs of a store, mapped into memory as they are needed."""

    def __init__(self, path: str, packs: int, width: int):
        self.path, self.shift, self.width, self.open = path, 32 - (packs.bit_length() - 1), width, {}

    def chunk(self, d: bytes) -> bytes:
        p = int.from_bytes(d[:4], "big") >> self.shift
        if p not in self.open:
            with open(f"{self.path}/pack-{p}", "rb") as f:
                data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
            if data[:8] != MAGIC:
                raise ValueError(f"pack {p} is damaged")
            n = int(np.frombuffer(data, dtype="<u8", count=1, offset=8)[0])
            ends = np.frombuffer(data, dtype="<u8", count=n, offset=16 + n * DIGEST)
            index = {data[16 + k * DIGEST : 16 + (k + 1) * DIGEST]: k for k in range(n)}
            self.open[p] = (data, 16 + n * (DIGEST + 8), ends, index)
        data, first, ends, index = self.open[p]
        k = index[d]
        begin = int(ends[k - 1]) if k else 0
        ids = data[first + begin * self.width : first + int(ends[k]) * self.width]
        if digest(ids) != d:
            raise ValueError(f"chunk {d.hex()} is damaged")
        return ids


def read(spark: SparkSession, store: Store) -> DataFrame:
    """doc_id, start, n_tokens and ids (little-endian unsigned 32-bit) of each document, rebuilt from the files and verified; ValueError if damaged."""
    prepare(spark)
    manifest = json.loads(open(f"{store.path}/manifest.json").read())
    told = recipes(spark, store.path)
    if manifest["root"] != store.root or files_of(told) != manifest["files"] or root_of(told, manifest["files"]) != store.root:
        raise ValueError("the store's manifest or recipes are damaged")
    first = {f["part"]: f["ids_before"] for f in manifest["files"]}
    path, packs, width = store.path, manifest["packs"], manifest["width"]

    def rebuild(batches):
        reader = Packs(path, packs, width)
        for b in batches:
            for at in range(0, b.num_rows, 200):
                c = b.slice(at, 200)
                out = []
                for doc_id, n, lists, told in zip(*(c.column(x).to_pylist() for x in ("doc_id", "n_tokens", "digests", "leaf")), strict=True):
                    if leaf(doc_id, n, lists) != told:
                        raise ValueError("a recipe is damaged")
                    ids = b"".join(reader.chunk(lists[k : k + DIGEST]) for k in range(0, len(lists), DIGEST))
                    if len(ids) != n * width:
                        raise ValueError("a document is damaged")
                    out.append(np.frombuffer(ids, dtype=f"<u{width}").astype("<u4").tobytes())
                starts = [first[p] + s for p, s in zip(c.column("part").to_pylist(), c.column("start").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([c.column("doc_id"), pa.array(starts, type=pa.int64()), c.column("n_tokens"), pa.array(out, type=pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return recipes(spark, path).mapInArrow(rebuild, "doc_id long, start long, n_tokens long, ids binary")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, write(table(spark, sf_dir, "documents")))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
