"""BPE encoding and decoding (operator 5) by tree concatenation, and the worker-side encoder that operator 7 shares.

White space never gets into a token of a word tokenizer and resets its splitting, so a text's ids are those of its words in
turn: words are found and hashed as arrays, the library encodes each distinct word that a worker doesn't remember, and the
ids are gathered by array. Other tokenizers encode whole texts. A text longer than LEAF is cut into halves again and again;
the pieces are rows, which the tasks of a stage encode in parallel. Neighbours are joined by re-encoding a window around the
cut. It grows until, on either side, AGREE tokens in a row have the same place and id as that side's own (or it reaches white
space or the end of the text), and only then is it spliced in. Nothing but windows is encoded again, white space or not.

Two different words of a worker's memory share a hash about once in 1e8 slices of text.
"""

from __future__ import annotations

import functools
import hashlib
import json
import os
import re
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import partitions, prepare, table
from .words import bounded, drops, hashes, joined, ragged, spans, sums

TOKENIZER = "word_bpe_49k.json"
#: Characters of a leaf of a long text, of the first window on either side of a cut, and tokens that must agree.
LEAF, WINDOW, AGREE = 16_384, 64, 4
#: Words that a worker remembers (the less used half goes when full), pieces of words (emptied when full), words to a call of the library, and bytes of text at a time.
CACHE_WORDS, CACHE_PIECES, CALL, SLICE = 600_000, 300_000, 64, 4_000_000
#: What a word tokenizer's file says, for which words are encoded one by one.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SUFFIX = "</w>"
#: How that pattern splits lower-case printable ASCII.
ASCII_PIECES = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
#: A word of one run of letters, with closing ASCII punctuation perhaps, of which the pattern makes one and two pieces.
LETTERS_THEN_POINT = re.compile(r"[^\W\d_]+[!-&(-/:;=?@\[-`{-~]+")
SPACE = re.compile("[ \t-\r]")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def by_words(told: dict) -> bool:
    """Whether a tokenizer's file is that of a word tokenizer whose splitting is known here."""
    split = (told.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    return told.get("normalizer") == NORMALIZER and split[0].get("pattern") == {"Regex": PATTERN} and told["model"].get("end_of_word_suffix") == SUFFIX


class Encoder:
    """Ids of whole texts; equal to the library's encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.by_words = by_words(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab()
        self.token = [""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.token[i] = t
        if self.by_words:
            #: The same model for words that are split, lower-case and printable ASCII already.
            self.bare = Tokenizer.from_str(self.tokenizer.to_str())
            self.bare.normalizer = None
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.closes = np.array([t.endswith(SUFFIX) for t in self.token])
            self.pieces: dict[str, bytes] = {}
            # hashes of the words remembered, ascending; where their ids begin, how many they are, how often they were met
            self.keys, self.at, self.size, self.met = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            self.ids = np.zeros(0, dtype=np.uint32)

    def _learn_joined(self, tokenizer, into: dict[str, bytes], words: list[str], pieces: list[int]) -> list[str]:
        """Encodes many words in one text; every piece of a word ends in one closing token. Returns words that didn't come apart so."""
        left = []
        calls = range(0, len(words), CALL)
        for at, e in zip(calls, tokenizer.encode_batch_fast([" ".join(words[a : a + CALL]) for a in calls], add_special_tokens=False), strict=True):
            own = words[at : at + CALL]
            ids = np.array(e.ids, dtype=np.uint32)
            ends = np.flatnonzero(self.closes[ids]) + 1
            last = np.cumsum(pieces[at : at + CALL])
            if len(ends) != last[-1] or ends[-1] != len(ids):
                left += own
                continue
            data, begin = ids.tobytes(), 0
            for w, end in zip(own, (ends[last - 1] * 4).tolist(), strict=True):
                into[w] = data[begin:end]
                begin = end
        return left

    def words(self, new: list[str]) -> list[bytes]:
        """Ids of words without ASCII white space."""
        known: dict[str, bytes] = {}
        letters, rest, split = [], [], {}
        for w in new:
            if w.isascii() and w.isprintable() and "<" not in w:
                split[w] = [p] if (p := w.lower()).isalpha() else ASCII_PIECES.findall(p)
            elif w.isalpha() or LETTERS_THEN_POINT.fullmatch(w):
                letters.append(w)
            else:
                rest.append(w)
        wanted = {p for own in split.values() for p in own}
        fresh = [p for p in wanted if p not in self.pieces]
        if len(self.pieces) + len(fresh) > CACHE_PIECES:
            self.pieces.clear()
            fresh = list(wanted)
        for p in self._learn_joined(self.bare, self.pieces, fresh, [1] * len(fresh)):
            self.pieces[p] = np.array(self.bare.encode(p, add_special_tokens=False).ids, dtype=np.uint32).tobytes()
        get = self.pieces.__getitem__
        for w, own in split.items():
            known[w] = get(own[0]) if len(own) == 1 else b"".join(map(get, own))
        rest += self._learn_joined(self.tokenizer, known, letters, [1 if w.isalpha() else 2 for w in letters])
        for at in range(0, len(rest), 512):
            part = rest[at : at + 512]
            for w, e in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[w] = np.array(e.ids, dtype=np.uint32).tobytes()
        return [known[w] for w in new]

    def find(self, h: np.ndarray, count: np.ndarray, word) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of words begin and how many they are, by their ascending hashes; word(k) is the k-th word's text."""
        at = np.searchsorted(self.keys, h)
        known = np.append(self.keys, np.uint64(0))[at] == h if len(self.keys) else np.zeros(len(h), dtype=bool)
        new = np.flatnonzero(~known)
        if len(new):
            self.met[at[known]] += count[known]
            learnt = self.words([word(k) for k in new.tolist()])
            size = np.array([len(x) // 4 for x in learnt], dtype=np.int64)
            if len(self.keys) + len(new) > CACHE_WORDS:
                self._forget(h[known])
            begin = len(self.ids) + np.cumsum(size) - size
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(learnt), dtype=np.uint32)])
            place = np.searchsorted(self.keys, h[new])
            self.keys, self.at, self.size, self.met = (np.insert(a, place, b) for a, b in ((self.keys, h[new]), (self.at, begin), (self.size, size), (self.met, count[new])))
            at = np.searchsorted(self.keys, h)
        return self.at[at], self.size[at]

    def _forget(self, needed: np.ndarray) -> None:
        """Keeps the half of the words that was met most, and those needed now."""
        keep = np.zeros(len(self.keys), dtype=bool)
        keep[np.argsort(-self.met, kind="stable")[: CACHE_WORDS // 2]] = True
        keep[np.searchsorted(self.keys, needed)] = True
        size = self.size[keep]
        self.ids = self.ids[ragged(self.at[keep], size)]
        self.keys, self.at, self.size, self.met = self.keys[keep], np.cumsum(size) - size, size, self.met[keep] // 2

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8), one text after the other, and the number of each text's."""
        if not self.by_words:
            own = [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            return np.concatenate([np.zeros(0, dtype=np.uint32), *own]), np.array([len(x) for x in own], dtype=np.int64)
        raw, borders = joined(texts)
        starts, ends = spans(raw)
        counts = np.diff(np.searchsorted(starts, borders), prepend=0)
        distinct, first, which, n = np.unique(hashes(raw, starts, ends), return_index=True, return_inverse=True, return_counts=True)
        data = raw.data
        at, size = self.find(distinct, n, lambda k: str(data[starts[first[k]] : ends[first[k]]], "utf-8"))
        sizes = size[which]
        last = np.cumsum(counts)
        return self.ids[ragged(at[which], sizes)], sums(sizes, last - counts, last)

    def decode(self, ids: list[int]) -> str:
        """The library's decode(ids, skip_special_tokens=False); without a decoder that is the tokens, a space between."""
        if self.tokenizer.decoder is None:
            return " ".join(map(self.token.__getitem__, ids))
        return self.tokenizer.decode(ids, skip_special_tokens=False)

    def places(self, run: str, at: int = 0) -> np.ndarray:
        """Start, end and id (rows) of the tokens of a run without ASCII white space."""
        e = self.tokenizer.encode(run, add_special_tokens=False)
        out = np.empty((3, len(e.ids)), dtype=np.int64)
        if len(e.ids):
            out[:2] = np.array(e.offsets, dtype=np.int64).T + at
            out[2] = e.ids
        return out


@dataclass
class Piece:
    """text[lo:hi] of a document: its ids; the runs without white space that it begins and ends with (their lengths and placed tokens)."""

    lo: int
    hi: int
    ids: np.ndarray
    head: int
    head_tokens: np.ndarray
    tail: int
    tail_tokens: np.ndarray

    @property
    def unsplit(self) -> bool:
        return self.head == self.hi - self.lo


def edges(text: str) -> tuple[int, int]:
    """Lengths of the runs without white space at a text's beginning and end."""
    first = SPACE.search(text)
    if first is None:
        return len(text), len(text)
    at = len(text)
    while at and not SPACE.match(text, at - 1):
        at -= 1
    return first.start(), len(text) - at


def leaf(enc: Encoder, text: str, lo: int, ids: np.ndarray, head: np.ndarray, tail: np.ndarray) -> Piece:
    """A piece from its ids and the tokens of its edges, placed from its own beginning."""
    n_head, n_tail = edges(text)
    shift = np.array([[lo], [lo], [0]])
    return Piece(lo, lo + len(text), ids, n_head, head + shift, n_tail, tail + shift)


def join(enc: Encoder, text: str, a: Piece, b: Piece, window: int = WINDOW) -> Piece:
    """Two neighbours as one piece."""
    if a.lo == a.hi or b.lo == b.hi:
        return b if a.lo == a.hi else a
    if not a.tail or not b.head:  # white space at the cut
        return Piece(a.lo, b.hi, np.concatenate([a.ids, b.ids]), a.head, a.head_tokens, b.tail, b.tail_tokens)
    cut, begin, end = a.hi, a.hi - a.tail, b.lo + b.head
    while True:
        lo, hi = max(begin, cut - window), min(end, cut + window)
        middle = enc.places(text[lo:hi], lo)
        first = 0 if lo == begin else agreed(middle, a.tail_tokens, last=False)
        last = middle.shape[1] if hi == end else agreed(middle, b.head_tokens, last=True)
        if first is not None and last is not None and first <= last:
            break
        window *= 2
    # tokens of a up to the first that the window repeats, the window's from there, then those of b from the last on
    n_a = 0 if lo == begin else int(np.searchsorted(a.tail_tokens[0], middle[0, first]))
    n_b = b.head_tokens.shape[1] if hi == end else int(np.searchsorted(b.head_tokens[0], middle[0, last]))
    left, right, new = a.tail_tokens[:, :n_a], b.head_tokens[:, n_b:], middle[:, first:last]
    ids = np.concatenate([a.ids[: len(a.ids) - a.tail_tokens.shape[1] + n_a], new[2].astype(np.uint32), b.ids[n_b:]])
    run = np.concatenate([left, new, right], axis=1) if a.unsplit or b.unsplit else None
    head = (a.head + b.head, run) if a.unsplit else (a.head, a.head_tokens)
    tail = (a.tail + b.tail, run) if b.unsplit else (b.tail, b.tail_tokens)
    return Piece(a.lo, b.hi, ids, *head, *tail)


def agreed(middle: np.ndarray, side: np.ndarray, last: bool) -> int | None:
    """Index in the window of the first (or last) token of AGREE in a row that the side has too; the window's outermost tokens don't count."""
    at = np.searchsorted(side[0], middle[0])
    same = np.zeros(middle.shape[1], dtype=bool)
    inside = at < side.shape[1]
    same[inside] = (side[:, at[inside]] == middle[:, inside]).all(axis=0)
    same[:1] = same[-1:] = False
    if len(same) < AGREE:
        return None
    runs = np.flatnonzero(np.convolve(same, np.ones(AGREE, dtype=np.int64), mode="valid") == AGREE)
    if not len(runs):
        return None
    return int(runs[-1] if last else runs[0])


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


drops.append(encoder.cache_clear)


def halves(text: str) -> list[str]:
    """The leaves of the tree: 2**k pieces of LEAF characters at most."""
    n = 1
    while n * LEAF < len(text):
        n *= 2
    cuts = [i * len(text) // n for i in range(n + 1)]
    return [text[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]


def edge_tokens(enc: Encoder, text: str) -> tuple[np.ndarray, np.ndarray]:
    """Placed tokens of the runs at a leaf's edges."""
    head, tail = edges(text)
    first = enc.places(text[:head])
    return first, first if head == len(text) else enc.places(text[len(text) - tail :], len(text) - tail)


def concatenate(enc: Encoder, text: str, pieces: list[Piece]) -> np.ndarray:
    """Ids of a text from its leaves: neighbours are joined level by level."""
    while len(pieces) > 1:
        pieces = [join(enc, text, pieces[i], pieces[i + 1]) if i + 1 < len(pieces) else pieces[i] for i in range(0, len(pieces), 2)]
    return pieces[0].ids


def _result(doc_ids: list, encoded: list[list[int]], enc: Encoder) -> pa.RecordBatch:
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return pa.RecordBatch.from_arrays(
        [pa.array(doc_ids, type=pa.int64()), pa.array([len(i) for i in encoded], type=pa.int64()), pa.array([sha(" ".join(map(str, i))) for i in encoded], type=pa.string()), pa.array([sha(enc.decode(i)) for i in encoded], type=pa.string())],
        names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    )


RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
PIECE = "doc_id long, text_key binary, n_leaves int, leaf int, text string, ids binary, head binary, tail binary"
PIECE_SCHEMA = pa.schema([("doc_id", pa.int64()), ("text_key", pa.binary()), ("n_leaves", pa.int32()), ("leaf", pa.int32()), ("text", pa.string()), ("ids", pa.binary()), ("head", pa.binary()), ("tail", pa.binary())])


def _pieces(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=f.type) for k, f in enumerate(PIECE_SCHEMA)], schema=PIECE_SCHEMA)


def encode_decode(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """doc_id and text to n_tokens and digests of the ids and of the decoded text, a row for each row of docs.

    A null text counts as empty: no tokens, digests of the empty string. Null and repeated doc_ids are kept as they are; other
    columns of docs are not read. A tokenizer that isn't a word tokenizer encodes texts whole, in one go.
    """
    spark = docs.sparkSession
    prepare(spark)
    path = tokenizer or tokenizer_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))

    def encoded(b: pa.RecordBatch) -> list[np.ndarray]:
        ids, counts = encoder(path).encode(b.column("text").cast(pa.binary()).to_pylist())
        return np.split(ids, np.cumsum(counts)[:-1])

    def whole(batches):
        for b in bounded(batches, "text", SLICE, keep=True):
            yield _result(b.column("doc_id").to_pylist(), [x.tolist() for x in encoded(b)], encoder(path))

    def cut(batches):
        for b in bounded(batches, "text", SLICE, keep=True):
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                leaves = halves(t)
                key = hashlib.blake2b(t.encode(), digest_size=16).digest()
                yield _pieces([(i, key, len(leaves), k, x, None, None, None) for k, x in enumerate(leaves)])

    def leaves(batches):
        enc = encoder(path)
        for b in bounded(batches, "text", SLICE, keep=True):
            sides = [edge_tokens(enc, t) for t in b.column("text").to_pylist()]
            new = [[x.tobytes() for x in encoded(b)], [h.tobytes() for h, _ in sides], [t.tobytes() for _, t in sides]]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *(pa.array(x, type=pa.binary()) for x in new)], schema=PIECE_SCHEMA)

    def joins(batches):
        enc = encoder(path)
        rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
        for (doc_id, _), own in groupby(rows, key=lambda r: (r[0], r[1])):
            parts: dict[int, list] = {}
            for _, _, _, k, *data in own:
                parts.setdefault(k, [data, 0])[1] += 1
            at, pieces = 0, []
            for k in sorted(parts):
                t, ids, head, tail = parts[k][0]
                pieces.append(leaf(enc, t, at, np.frombuffer(ids, dtype=np.uint32), *(np.frombuffer(x, dtype=np.int64).reshape(3, -1) for x in (head, tail))))
                at += len(t)
            times = parts[0][1]
            ids = concatenate(enc, "".join(parts[k][0][0] for k in sorted(parts)), pieces).tolist()
            yield _result([doc_id] * times, [ids] * times, enc)  # repeated rows stay repeated

    if not encoder(path).by_words:
        return docs.mapInArrow(whole, RESULT)
    size = F.length("text")
    short = docs.where(size <= LEAF).mapInArrow(whole, RESULT)
    pieces = docs.where(size > LEAF).mapInArrow(cut, PIECE).repartition(partitions(spark)).mapInArrow(leaves, PIECE)
    keys = ["doc_id", "text_key"]
    long = pieces.repartition(partitions(spark), *keys).sortWithinPartitions(*keys, "leaf").mapInArrow(joins, RESULT)
    return short.unionByName(long)


def op5_bpe_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(table(spark, sf_dir, "documents"))
