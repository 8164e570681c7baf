"""Word-level BPE encoding and decoding through a table of distinct words.

Encoding is three steps. (1) Texts are normalised (NFC, lower case) and split into words in Spark tasks. About ``chunk_bytes`` of neighbouring texts make a chunk,
which lists its distinct words once; a text becomes the numbers of its words in that list, in order: its positions. Frequent words come first there, so most numbers are small. Both are written. (2) The chunks'
words meet by word: they are dealt to buckets by a hash, as many as keep about ``BUCKET_WORDS`` listed words in each, and there each distinct word of the corpus
is encoded once; its ids go back with the chunk and number of every listing. (3) They are joined back by chunk, and a text's numbers become ids by position. A frequent word
is listed once a chunk, so no word gathers rows; a task of step 2 keeps the distinct words of one bucket, one of step 3 a chunk.

What is shuffled is distinct words, not texts, once by bucket and once by chunk, packed in blocks (what one chunk lists in one bucket), and the texts' numbers, packed, once by chunk.

Decoding joins ids with pieces: the table of (id, piece) has the size of the vocabulary, whatever the input's, so it goes to every task, and a batch's ids
are looked up at once. Pieces are joined by one blank, as the tokenizers library does for this vocabulary, which names no decoder.

Defined cases: a null or empty text has no ids and decodes to the empty string; a null id list decodes to null; ids outside the vocabulary raise; special tokens
are found in the text as it stands, before it is normalised, and have their ids; repeated rows are encoded alike; very long texts are encoded whole. Other columns
are passed through; one called like the column added is an error. Letters and numbers are those of Python's Unicode tables (15.1); a character assigned since then
is split as any other sign.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tilewright.llm.bpe import LETTER, NUMBER, WHITE_SPACE, char_classes, gather
from tilewright.llm.jobs import numbered, refuse_columns, widened, written

CHUNK_BYTES = 1 << 24
BUCKET_WORDS = 1 << 16
#: Texts whose numbers are packed at once.
PACK_WORDS = 1 << 18
#: Up to this length pairs are searched one by one, beyond it they are kept in a heap.
SHORT = 200
#: In front of a special token's name where words are listed; no word begins with this byte.
SPECIAL = b"\xff"


def _ranges(points: np.ndarray) -> str:
    """Code points as the inside of a character class."""
    cuts = np.flatnonzero(np.diff(points) > 1)
    starts, ends = np.append(points[:1], points[cuts + 1]), np.append(points[cuts], points[-1:])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(starts.tolist(), ends.tolist(), strict=True))


_words: list = []


def word_patterns() -> tuple[re.Pattern, re.Pattern, re.Pattern]:
    """Words of normalised text in ASCII, in the basic plane, and of any: endings after an apostrophe, runs of letters, single numbers, runs of what else isn't blank."""
    if not _words:
        letters, numbers = (np.flatnonzero(char_classes() == kind) for kind in (LETTER, NUMBER))
        endings, space = "'(?:s|t|re|ve|m|ll|d)", _ranges(np.array(WHITE_SPACE))
        _words.append(re.compile(endings + r"|[a-z]+|[0-9]|[^ \t-\ra-z0-9]+"))
        for top in (0x10000, 0x110000):  # a character class with members beyond the basic plane is slow to leave
            letter, number = _ranges(letters[letters < top]), _ranges(numbers[numbers < top])
            _words.append(re.compile(f"{endings}|[{letter}]+|[{number}]|[^{space}{letter}{number}]+"))
    return tuple(_words)


def words_of(text: str) -> list[str]:
    """The words of a text without special tokens. Capital sigma has one lower form here, whatever stands beside it."""
    ascii_only, basic, any_text = word_patterns()
    if text.isascii():
        return ascii_only.findall(text.lower())
    if not unicodedata.is_normalized("NFC", text):
        text = unicodedata.normalize("NFC", text)
    text = text.replace("Σ", "σ").lower()
    return (basic if max(text) < "\U00010000" else any_text).findall(text)


class Vocabulary:
    """Pieces, merges and special tokens of a tokenizer file with end-of-word marks."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        ids, self.end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        shown = self._shown_bytes()
        self.inner = [ids[c] for c in shown]
        self.last = [ids[c + self.end] for c in shown]
        self.rank_of = {ids[a] << 20 | ids[b]: rank for rank, (a, b) in enumerate(model["merges"])}
        self.made_by = [ids[a + b] for a, b in model["merges"]]
        pieces = {i: piece for piece, i in ids.items()} | {i: piece for piece, i in self.special.items()}
        self.pieces = [(i, pieces[i]) for i in sorted(pieces)]
        self.at_special = re.compile("(" + "|".join(sorted(map(re.escape, self.special), key=len, reverse=True)) + ")") if self.special else None

    @staticmethod
    def _shown_bytes() -> list[str]:
        """The character that stands for each byte: itself if it is printable Latin-1, else one from U+0100 on."""
        printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
        out, spare = [], 0x100
        for b in range(256):
            out.append(chr(b) if b in printable else chr(spare))
            spare += b not in printable
        return out

    def encode_word(self, word: bytes) -> list[int]:
        """The ids of a word: of neighbours, the pair of least rank is joined first, the leftmost of equals, until none is left."""
        if word[:1] == SPECIAL:
            return [self.special[word[1:].decode()]]
        inner = self.inner
        ids = [inner[b] for b in word[:-1]]
        ids.append(self.last[word[-1]])
        return self._join_short(ids) if len(ids) <= SHORT else self._join_long(ids)

    def _join_short(self, ids: list[int]) -> list[int]:
        rank_of, made_by, none = self.rank_of, self.made_by, len(self.made_by)
        ranks = [rank_of.get(a << 20 | b, none) for a, b in zip(ids, ids[1:])]
        while ranks and (least := min(ranks)) < none:
            k = ranks.index(least)
            ids[k] = made_by[least]
            del ids[k + 1], ranks[k]
            if k:
                ranks[k - 1] = rank_of.get(ids[k - 1] << 20 | ids[k], none)
            if k < len(ranks):
                ranks[k] = rank_of.get(ids[k] << 20 | ids[k + 1], none)
        return ids

    def _join_long(self, ids: list[int]) -> list[int]:
        n, rank_of, made_by = len(ids), self.rank_of, self.made_by
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, k, a, b) for k, (a, b) in enumerate(zip(ids, ids[1:])) if (r := rank_of.get(a << 20 | b)) is not None]
        heapq.heapify(heap)
        while heap:
            rank, k, a, b = heapq.heappop(heap)
            right = after[k]
            if ids[k] != a or right >= n or ids[right] != b:
                continue
            ids[k], ids[right] = made_by[rank], -1
            after[k] = beyond = after[right]
            if beyond < n:
                before[beyond] = k
            for left, to in ((before[k], k), (k, beyond)):
                if left >= 0 and to < n and (r := rank_of.get(ids[left] << 20 | ids[to])) is not None:
                    heapq.heappush(heap, (r, left, ids[left], ids[to]))
        return [i for i in ids if i >= 0]


def load(spark: SparkSession, path: str):
    """The vocabulary, read once on the driver and sent to the executors; its size is that of the file."""
    return spark.sparkContext.broadcast(Vocabulary(path))


def _seven_bits(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers under 2^35 in bytes of 7 bits, the last byte of each without the high bit; and where each ends."""
    sizes = 1 + sum((numbers >= 1 << (7 * k)).astype(np.int64) for k in range(1, 5))
    ends = np.cumsum(sizes)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(5):
        here = sizes > k
        out[ends[here] - 1 - k] = (numbers[here] >> (7 * k)) & 127 | (128 if k else 0)
    return out, ends


def zipped(data: bytes) -> bytes:
    return len(data).to_bytes(4, "little") + pa.Codec("zstd", 3).compress(data, asbytes=True)


def unzipped(data: bytes) -> bytes:
    size = int.from_bytes(data[:4], "little")
    return pa.Codec("zstd").decompress(data[4:], size, asbytes=True) if size else b""


def pack(numbers: np.ndarray) -> bytes:
    return zipped(_seven_bits(numbers)[0].tobytes())


def pack_each(numbers: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """The numbers of each text by itself; small ones take a byte."""
    data, ends = _seven_bits(numbers)
    bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(lengths)])].tolist()
    flat = data.tobytes()
    return [zipped(flat[a:b]) for a, b in zip(bounds, bounds[1:])]


def unpack(part: bytes) -> np.ndarray:
    data = np.frombuffer(unzipped(part), np.uint8)
    ends = np.flatnonzero(data < 128)
    starts = np.append(0, ends[:-1] + 1)[: len(ends)]
    out, sizes = np.zeros(len(ends), np.int64), ends - starts
    for k in range(int(sizes.max()) + 1 if len(ends) else 0):
        here = sizes >= k
        out[here] |= (data[ends[here] - k] & 127).astype(np.int64) << (7 * k)
    return out


def pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return pack(np.fromiter(map(len, words), np.int64, len(words))), zipped(b"".join(words))


def unpack_words(sizes: bytes, words: bytes) -> list[bytes]:
    ends = np.cumsum(unpack(sizes)).tolist()
    flat = unzipped(words)
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


class _Numbers(dict):
    """Words to numbers, a new word the next one."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Chunk:
    """Neighbouring texts: the numbers of their words, and the columns of the rows they came from."""

    def __init__(self, at: int):
        self.at, self.number, self.size = at, _Numbers(), 0
        self.rows: list[pa.RecordBatch] = []
        self.texts: list[np.ndarray] = []

    def add(self, text: str | None, vocabulary: Vocabulary) -> None:
        number = self.number.__getitem__
        if text and vocabulary.at_special is not None and vocabulary.at_special.search(text):
            words = []
            for k, part in enumerate(vocabulary.at_special.split(text)):
                words += [SPECIAL + part.encode()] if k % 2 else words_of(part)
        else:
            words = words_of(text) if text else []
        self.texts.append(np.fromiter(map(number, words), np.int32, len(words)))
        self.size += len(text or "")

    def keep(self, batch: pa.RecordBatch, start: int, end: int) -> None:
        if end > start:
            self.rows.append(batch.take(pa.array(np.arange(start, end))))  # a copy, as a slice would hold the texts of its batch

    def batches(self, names: list[str]) -> Iterator[pa.RecordBatch]:
        """The texts with their numbers, then one row that lists the words, the most frequent first."""
        counts = np.bincount(np.concatenate(self.texts), minlength=len(self.number))
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        lengths = np.array([len(t) for t in self.texts], np.int64)
        cuts = np.flatnonzero(np.diff(np.cumsum(lengths) // PACK_WORDS)) + 1
        packed = []
        for some in np.split(np.arange(len(lengths)), cuts):
            if len(some):
                packed += pack_each(rank[np.concatenate(self.texts[some[0] : some[-1] + 1])], lengths[some])
        n = len(packed)
        columns = [c.combine_chunks() for c in pa.Table.from_batches(self.rows).select(names).columns]
        none = pa.nulls(n, pa.binary())
        yield pa.RecordBatch.from_arrays([*columns, pa.array([self.at] * n, pa.int64()), pa.array(packed, pa.binary()), pa.nulls(n, pa.int64()), none, none], [*names, *STEP_1])
        if self.number:
            met = list(self.number)
            sizes, words = pack_words([w if isinstance(w, bytes) else w.encode() for w in (met[k] for k in order.tolist())])
            listed = [pa.array([self.at], pa.int64()), pa.nulls(1, pa.binary()), pa.array([len(self.number)], pa.int64()), pa.array([sizes], pa.binary()), pa.array([words], pa.binary())]
            yield pa.RecordBatch.from_arrays([*[pa.nulls(1, c.type) for c in columns], *listed], [*names, *STEP_1])


STEP_1 = {"chunk": "long", "numbers": "binary", "n_words": "long", "sizes": "binary", "words": "binary"}


def split(narrow: DataFrame, names: list[str], vocabulary, chunk_bytes: int) -> DataFrame:
    """Step 1, written: a row for each text (names, chunk, numbers), and one for each chunk (chunk, n_words, sizes, words)."""
    schema = widened(narrow.select(*names), **STEP_1)
    for field in schema.fields:
        field.nullable = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, task, seen = vocabulary.value, TaskContext.get().partitionId(), 0
        chunk = _Chunk(task << 32)
        for batch in batches:
            start = 0
            for k, text in enumerate(batch.column("__text")):
                chunk.add(text.as_py(), v)
                if chunk.size >= chunk_bytes:
                    chunk.keep(batch.select(names), start, k + 1)
                    yield from chunk.batches(names)
                    start, seen = k + 1, seen + 1
                    chunk = _Chunk(task << 32 | seen)
            chunk.keep(batch.select(names), start, batch.num_rows)
        if chunk.rows:
            yield from chunk.batches(names)

    return written(narrow.mapInArrow(run, schema))


def encode_words(listed: DataFrame, vocabulary, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Step 2: of (chunk, n_words, sizes, words), the blocks (chunk, numbers, sizes, ids): a word's number in its chunk, how many ids it has, and those."""
    buckets = max(16, -(-(listed.agg(F.sum("n_words")).first()[0] or 0) // bucket_words))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, sizes, words in zip(*(batch.column(c).to_pylist() for c in ("chunk", "sizes", "words")), strict=True):
                own = unpack_words(sizes, words)
                home = np.fromiter(map(zlib.crc32, own), np.int64, len(own)) % buckets
                order = np.argsort(home, kind="stable")
                cuts = np.flatnonzero(np.diff(home[order])) + 1
                parts = np.split(order, cuts)
                packed = [pack_words([own[k] for k in part.tolist()]) for part in parts]
                rows = [home[order[np.append(0, cuts)]].tolist(), [chunk] * len(parts), [pack(np.diff(part, prepend=0)) for part in parts], *zip(*packed, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(r), t) for r, t in zip(rows, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["bucket", "chunk", "numbers", "sizes", "words"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, bucket, known = vocabulary.value, None, {}
        for batch in batches:
            counts, ids = [], []
            for home, sizes, words in zip(*(batch.column(c).to_pylist() for c in ("bucket", "sizes", "words")), strict=True):
                if home != bucket:
                    bucket, known = home, {}
                made = []
                for word in unpack_words(sizes, words):
                    if (found := known.get(word)) is None:
                        known[word] = found = v.encode_word(word)
                    made.append(found)
                counts.append(pack(np.fromiter(map(len, made), np.int64, len(made))))
                ids.append(zipped(np.array([i for own in made for i in own], np.int32).tobytes()))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("numbers"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())], ["chunk", "numbers", "sizes", "ids"])

    dealt = listed.select("chunk", "sizes", "words").mapInArrow(deal, "bucket long, chunk long, numbers binary, sizes binary, words binary")
    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "chunk long, numbers binary, sizes binary, ids binary")


def encode(df: DataFrame, vocabulary, text_col: str = "text", out: str = "ids", keep: list[str] | None = None, chunk_bytes: int = CHUNK_BYTES, digest: bool = False) -> DataFrame:
    """The columns ``keep`` (all but the text, if None) and ``out``, the ids of the whole text as array<int>.

    With ``digest`` also n_tokens and ids_sha256, in hex, of the ids as little-endian unsigned 32-bit integers.
    """
    keep = [c for c in df.columns if c != text_col] if keep is None else keep
    added = [out, "n_tokens", "ids_sha256"] if digest else [out]
    refuse_columns(df.select(*[F.col(f"`{c}`") for c in keep]), *added)
    narrow, names = numbered(df, keep, F.col(f"`{text_col}`").cast("string").alias("__text"))
    pieces = split(narrow, names, vocabulary, chunk_bytes)
    known = encode_words(pieces.filter("words IS NOT NULL").select("chunk", "n_words", "sizes", "words"), vocabulary)
    texts = pieces.filter("words IS NULL").select(*names, "chunk", "numbers")
    schema = StructType([*texts.select(*names).schema.fields, *widened(narrow.limit(0).select(), **dict(zip(added, ["array<int>", "long", "string"]))).fields])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        blocks = [[unpack(x) for x in right.column(c).to_pylist()] for c in ("numbers", "sizes")]
        at = np.concatenate([np.zeros(0, np.int64), *map(np.cumsum, blocks[0])])
        each = np.concatenate([np.zeros(0, np.int64), *blocks[1]])
        flat = np.frombuffer(b"".join(map(unzipped, right.column("ids").to_pylist())), np.int32)
        sizes, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        sizes[at], starts[at] = each, np.cumsum(each) - each
        ids, counts = [np.zeros(0, np.int32)], [0]
        for part in left.column("numbers").to_pylist():
            numbers = unpack(part)
            made = flat[gather(starts[numbers], sizes[numbers])] if len(numbers) else ids[0]
            ids.append(made)
            counts.append(len(made))
        made = pa.ListArray.from_arrays(pa.array(np.cumsum(counts), pa.int32()), pa.array(np.concatenate(ids)))
        columns = [*[left.column(c) for c in names], made]
        if digest:
            columns += [pa.array(counts[1:], pa.int64()), pa.array([hashlib.sha256(own.astype("<u4").tobytes()).hexdigest() for own in ids[1:]], pa.string())]
        return pa.table(columns, [*names, *added])

    return texts.groupBy("chunk").cogroup(known.groupBy("chunk")).applyInArrow(run, schema).toDF(*keep, *added)


def decode(df: DataFrame, vocabulary, ids_col: str = "ids", out: str = "decoded", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` (all, if None) and ``out``, the pieces of the ids with a blank between them."""
    keep = list(df.columns) if keep is None else keep
    refuse_columns(df.select(*[F.col(f"`{c}`") for c in keep]), out)
    narrow, names = numbered(df, keep, F.col(f"`{ids_col}`").alias("__ids"))
    schema = widened(narrow.drop("__ids"), **{out: "string"})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = vocabulary.value.pieces
        size = table[-1][0] + 1
        length_of, start_of = np.full(size, -1, np.int64), np.zeros(size, np.int64)
        shown = [piece.encode() + b" " for _, piece in table]
        at = np.array([i for i, _ in table])
        length_of[at] = [len(s) for s in shown]
        start_of[at] = np.cumsum(length_of[at]) - length_of[at]
        blob = np.frombuffer(b"".join(shown), np.uint8)
        for batch in batches:
            ids = batch.column("__ids")
            rows = max(1, batch.num_rows * (1 << 20) // max(1, len(ids.flatten())))
            for a in range(0, batch.num_rows, rows):
                part = ids.slice(a, rows)
                flat = part.flatten().to_numpy(zero_copy_only=False)
                if len(flat) and (flat.min() < 0 or flat.max() >= size or (length_of[flat] < 0).any()):
                    raise ValueError("an id isn't in the vocabulary")
                lengths = length_of[flat]
                counts = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(counts)
                lengths[ends[counts > 0] - 1] -= 1  # no blank behind the last piece of a row
                data = blob[gather(start_of[flat], lengths)] if len(flat) else np.zeros(0, np.uint8)
                bounds = np.concatenate([[0], np.cumsum(lengths)])[np.concatenate([[0], ends])].astype(np.int32)
                nulls = part.is_null() if part.null_count else None
                valid = None if nulls is None else pa.py_buffer(np.packbits(~nulls.to_numpy(zero_copy_only=False), bitorder="little").tobytes())
                made = pa.StringArray.from_buffers(len(part), pa.py_buffer(bounds.tobytes()), pa.py_buffer(data.tobytes()), valid)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, rows) for c in names], made], [*names, out])

    return narrow.mapInArrow(run, schema).toDF(*keep, out)
