"""Byte-level BPE encoding and decoding.

Texts are cut into pre-tokens by array operations over their code points. A pre-token is then resolved in two tiers: a minimal
perfect hash over the vocabulary answers those that are tokens themselves; the others are merged with a heap over linked bytes.
Both tiers see each distinct pre-token of a slice once. No shuffle: a row depends on its own text and the vocabulary alone.

Defined cases: a null or empty text has no ids and decodes to no bytes; a null id list decodes to null; ids outside the vocabulary raise;
repeated rows are encoded alike; very long texts are encoded whole. Other columns are passed through; one called like the column added is an error.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.jobs import giving_back, numbered, refuse_columns, widened
from tilewright.llm.textkit import mix, slices, utf8, word_hashes

U64 = np.uint64
LETTER, NUMBER, SPACE, OTHER = 0, 1, 2, 3
MEMO_ENTRIES = 50_000

#: The code points with the property White_Space, and the endings that the pattern splits off after an apostrophe.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]

_classes: np.ndarray | None = None


def char_classes() -> np.ndarray:
    global _classes
    if _classes is None:
        first = [unicodedata.category(chr(c))[0] for c in range(0x110000)]
        table = np.full(0x110000, OTHER, np.uint8)
        letters = np.array(first)
        table[letters == "L"], table[letters == "N"] = LETTER, NUMBER
        table[WHITE_SPACE] = SPACE
        _classes = table
    return _classes


def pretoken_starts(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The bytes at which pre-tokens start, in order; each row starts with one, if it isn't empty.

    A run of letters, numbers or other characters is a pre-token and takes one blank before it along. White space before something else
    keeps its last character apart. After an apostrophe that no blank or other character precedes, a known ending is split off.
    """
    if not len(text):
        return np.zeros(0, np.int64)
    chars = np.frombuffer(text.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at_byte = np.flatnonzero((text & 0xC0) != 0x80)
    rows = np.searchsorted(at_byte, offsets)
    kind = char_classes()[chars]
    n = len(chars)
    row_start = np.zeros(n + 1, bool)
    row_start[rows] = True
    changes = np.ones(n, bool)
    changes[1:] = kind[1:] != kind[:-1]
    changes |= row_start[:-1]
    blank_before = np.zeros(n, bool)
    blank_before[1:] = chars[:-1] == 0x20
    blank_before &= ~row_start[:-1]
    space = kind == SPACE
    starts = changes & (space | ~blank_before)
    last_of_space = np.zeros(n, bool)
    last_of_space[:-1] = space[:-1] & ~space[1:] & ~row_start[1:-1]
    starts |= last_of_space
    quotes = np.flatnonzero((chars == 0x27) & changes & ~blank_before)
    if len(quotes):
        padded = np.concatenate([chars, np.zeros(3, np.uint32)])
        inside = [np.ones(len(quotes), bool)]
        for j in (1, 2):
            inside.append(inside[-1] & ~row_start[np.minimum(quotes + j, n)])
        for ending in ENDINGS:
            hit = inside[len(ending)].copy()
            for j, letter in enumerate(ending, 1):
                hit &= padded[quotes + j] == ord(letter)
            found = quotes[hit]
            starts[found + 1] = False
            behind = found + 1 + len(ending)
            starts[behind[behind < n]] = True
    return at_byte[starts]


class PerfectHash:
    """Minimal perfect hash: n keys in n slots. Keys fall into small buckets; each bucket keeps the seed under which its keys hit free slots."""

    def __init__(self, hashes: np.ndarray):
        n = self.n = len(hashes)
        self.buckets = n // 3 + 1
        home = (hashes % U64(self.buckets)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        sizes = np.bincount(home, minlength=self.buckets)
        ends = np.cumsum(sizes)
        self.seed = np.zeros(self.buckets, np.int64)
        self.key = np.zeros(n, U64)
        self.value = np.full(n, -1, np.int64)
        for b in np.argsort(-sizes, kind="stable"):
            if not sizes[b]:
                break
            keys = order[ends[b] - sizes[b] : ends[b]]
            if sizes[b] == 1:  # what is left takes the slots that are left
                continue
            seed, good = 0, np.zeros(0, np.int64)
            while not len(good):  # many seeds at once
                salts = np.arange(seed, seed + 64, dtype=U64) * U64(2654435761) + U64(1)
                slots = (mix(hashes[keys][None, :] ^ salts[:, None]) % U64(n)).astype(np.int64)
                free = (self.value[slots] < 0).all(1)
                if len(keys) > 1:
                    free &= (np.diff(np.sort(slots, 1), axis=1) > 0).all(1)
                good, seed = np.flatnonzero(free), seed + 64
            self.seed[b] = seed - 64 + good[0]
            self.value[slots[good[0]]], self.key[slots[good[0]]] = keys, hashes[keys]
        free = np.flatnonzero(self.value < 0)
        alone = np.flatnonzero(sizes[home] == 1)
        self.seed[home[alone]] = -1 - free
        self.value[free], self.key[free] = alone, hashes[alone]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The index of each key, or -1."""
        seed = self.seed[(hashes % U64(self.buckets)).astype(np.int64)]
        slot = (mix(hashes ^ (np.maximum(seed, 0).astype(U64) * U64(2654435761) + U64(1))) % U64(self.n)).astype(np.int64)
        slot = np.where(seed < 0, -1 - seed, slot)
        return np.where(self.key[slot] == hashes, self.value[slot], -1)


class Vocabulary:
    """The tokens of a rank file: one line for each, its bytes in base64 and its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        self.tokens = list(self.ranks)
        self.ids = np.fromiter(self.ranks.values(), np.int32, len(self.ranks))
        lengths = np.fromiter(map(len, self.tokens), np.int64, len(self.tokens))
        blob = np.frombuffer(b"".join(self.tokens), np.uint8)
        ends = np.cumsum(lengths)
        self.perfect = PerfectHash(word_hashes(blob, ends - lengths, ends))
        size = int(self.ids.max()) + 1
        self.length_of, self.start_of = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        self.length_of[self.ids], self.start_of[self.ids], self.blob = lengths, ends - lengths, blob
        self.pairs = [-1] * 65536
        for token, rank in self.ranks.items():
            if len(token) == 2:
                self.pairs[token[0] * 256 + token[1]] = rank
        # merged pre-tokens, for all tasks of a worker, as theirs are much the same; they go with the vocabulary when the worker takes up other work
        self.memo: dict[int, tuple[bytes, list[int]]] = {}
        self.older: dict[int, tuple[bytes, list[int]]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The ids of a pre-token: the pair of neighbours of least rank is joined first, the leftmost of equals, until none is left."""
        n, ranks, pairs = len(piece), self.ranks, self.pairs
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i, r in enumerate([pairs[a * 256 + b] for a, b in zip(piece, piece[1:])]) if r >= 0]
        heapq.heapify(heap)
        while heap:
            _, i, to = heapq.heappop(heap)
            if not alive[i] or (j := end[i]) >= n or end[j] != to:
                continue
            alive[j], end[i] = False, to
            if to < n:
                before[to] = i
                if (r := ranks.get(piece[i : end[to]])) is not None:
                    heapq.heappush(heap, (r, i, end[to]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the ranges [start, start + length), one range behind the other."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Encoder:
    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary

    @staticmethod
    def _by_bytes(whole: bytes, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Kinds of pre-tokens told apart by their bytes: the hash and first place of each kind, and the kind of each place."""
        kinds: dict[bytes, int] = {}
        where = np.array([kinds.setdefault(whole[a:b], len(kinds)) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        first = np.unique(where, return_index=True)[1]
        return word_hashes(np.frombuffer(whole, np.uint8), starts[first], ends[first]), first, where

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a slice of texts, and the number of ids in each."""
        text, offsets = utf8(column)
        starts = pretoken_starts(text, offsets)
        ends = np.append(starts[1:], len(text)) if len(starts) else starts
        hashes, first, where = np.unique(word_hashes(text, starts, ends), return_index=True, return_inverse=True)
        sizes = ends - starts
        stand_in = first[where]
        # pre-tokens lie one behind the other, so what stands in for them, put together, is the text
        if not np.array_equal(sizes[stand_in], sizes) or not np.array_equal(text[gather(starts[stand_in], sizes)], text):  # pre-tokens that only share a hash are kinds of their own
            hashes, first, where = self._by_bytes(text.tobytes(), starts, ends)
        found = self.vocabulary.perfect.find(hashes)
        whole, v = text.tobytes(), self.vocabulary
        memo = v.memo
        pieces: list = [None] * len(hashes)
        for k, (h, a, b, at) in enumerate(zip(hashes.tolist(), starts[first].tolist(), ends[first].tolist(), found.tolist(), strict=True)):
            if at >= 0 and v.tokens[at] == whole[a:b]:
                pieces[k] = (int(v.ids[at]),)
                continue
            known = memo.get(h)
            if known is None or known[0] != whole[a:b]:
                known = v.older.get(h)
                if known is None or known[0] != whole[a:b]:
                    known = (whole[a:b], v.merge(whole[a:b]))
                if b - a <= 64:
                    memo[h] = known
            pieces[k] = known[1]
        if len(memo) >= MEMO_ENTRIES:
            v.older, v.memo = memo, {}
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        flat = np.fromiter((x for p in pieces for x in p), np.int32, int(lengths.sum()))
        at = np.cumsum(lengths) - lengths
        each = lengths[where]
        total = np.concatenate([[0], np.cumsum(each)])
        return flat[gather(at[where], each)], np.diff(total[np.searchsorted(starts, offsets)])


def load(spark: SparkSession, path: str):
    """The vocabulary, read and indexed once on the driver and sent to the executors; its size is that of the rank file."""
    return spark.sparkContext.broadcast(Vocabulary(path))


def encode(df: DataFrame, vocabulary, text_col: str = "text", out: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all but the text, if None) and ``out``, the ids of the whole text as array<int>."""
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    refuse_columns(df.select(*[F.col(f"`{c}`") for c in keep]), out)
    narrow, names = numbered(df, keep, F.col(f"`{text_col}`").cast("string").alias("__text"))
    schema = widened(narrow.drop("__text"), **{out: "array<int>"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary.value)
        for batch in batches:
            text = batch.column("__text")
            for a, b in slices(text):
                ids, counts = encoder.encode(text.slice(a, b - a))
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                rest = [batch.column(c).slice(a, b - a) for c in names]
                yield pa.RecordBatch.from_arrays([*rest, pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32()))], [*names, out])

    return narrow.mapInArrow(giving_back(run), schema).toDF(*keep, out)


def decode(df: DataFrame, vocabulary, ids_col: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``out``, the bytes that the ids stand for."""
    keep = list(df.columns) if keep is None else keep
    refuse_columns(df.select(*[F.col(f"`{c}`") for c in keep]), out)
    narrow, names = numbered(df, keep, F.col(f"`{ids_col}`").alias("__ids"))
    schema = widened(narrow.drop("__ids"), **{out: "binary"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        for batch in batches:
            ids = batch.column("__ids")
            rows = max(1, batch.num_rows * (1 << 20) // max(1, len(ids.flatten())))
            for a in range(0, batch.num_rows, rows):
                part = ids.slice(a, rows)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= len(v.length_of) or (v.length_of[flat] < 0).any()):
                    raise ValueError("an id isn't in the vocabulary")
                lengths = v.length_of[flat]
                data = v.blob[gather(v.start_of[flat], lengths)] if len(flat) else np.zeros(0, np.uint8)
                ends = np.concatenate([[0], np.cumsum(lengths)])
                counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                bounds = ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int32)
                nulls = part.is_null() if part.null_count else None
                valid = None if nulls is None else pa.py_buffer(np.packbits(~nulls.to_numpy(zero_copy_only=False), bitorder="little").tobytes())
                made = pa.BinaryArray.from_buffers(pa.binary(), len(part), [valid, pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes())])
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, rows) for c in names], made], [*names, out])

    return narrow.mapInArrow(giving_back(run), schema).toDF(*keep, out)
