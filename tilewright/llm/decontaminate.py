"""Benchmark decontamination by winnowing.

Of every window of consecutive k-grams of words the least hash is kept, in documents and items alike, so a shared window has a kept hash in
common. Each kept hash carries the windows it was least in. First documents' kept hashes are looked up among the items' (each row stays or
goes, nothing multiplies), then those left meet the items' windows on the kept hash and the hash of the whole window: a gram that very many
documents and items have, but no window, joins to nothing. At last the match is extended from the gram over its window on the words
themselves, in the document's text, so a chance meeting of hashes is no hit; windows that overlap are one run.

An item of fewer words than a window is one window itself, looked up by windows of its own length.

Defined cases: null and empty texts have no words, hit nothing and are hit by nothing; repeated rows are judged alike; an empty table on
either side hits nothing; rows whose doc_id is null are judged as well; an item without an id hits, but is not named; equal items hit once; very
long texts are judged whole. Other columns are passed through; columns called like those added are an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.jobs import giving_back, refuse_columns
from tilewright.llm.textkit import ALNUM, gram_hashes, mix, rows_of, slices, utf8, word_hashes, word_spans

U64 = np.uint64
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _kept(words: np.ndarray, first: np.ndarray, size: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, fps, spans): where each window of ``size`` words begins, the least hash of its k-grams, and the hash of the whole window."""
    k = min(k, size)
    grams, _ = gram_hashes(words, first, k)
    whole, inside = gram_hashes(words, first, size)
    at = np.flatnonzero(inside)
    least = grams[at]
    for j in range(1, size - k + 1):
        least = np.minimum(least, grams[at + j])
    return at, mix(least + U64(size)).view(np.int64), whole[at].view(np.int64)


def _lengths(items: DataFrame, text_col: str, window: int) -> list[int]:
    """The lengths of windows that the items call for: ``window`` numbers at most."""
    length = F.least(F.lit(window), F.regexp_count(F.col(text_col), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")))
    return sorted(r[0] for r in items.select(length.alias("n")).filter("n > 0").distinct().collect())


def fingerprints(docs: DataFrame, lengths: list[int], k: int) -> DataFrame:
    """(key, n, fp, start, spans): a row for each run of neighbouring windows with one kept hash; the windows begin at words start, start + 1, ... docs: (key long, text string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                text, offsets = utf8(batch.column("text").slice(a, b - a), lower=True)
                starts, ends, first = word_spans(text, offsets, ALNUM)
                words, rows = word_hashes(text, starts, ends), rows_of(first)
                for n in lengths:
                    at, fps, spans = _kept(words, first, n, k)
                    if not len(at):
                        continue
                    head = np.flatnonzero(np.concatenate([[True], (fps[1:] != fps[:-1]) | (rows[at[1:]] != rows[at[:-1]])]))
                    row = rows[at[head]]
                    lists = pa.ListArray.from_arrays(pa.array(np.append(head, len(at)).astype(np.int32)), pa.array(spans))
                    keys = batch.column("key").slice(a, b - a).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(head), n, np.int32)), pa.array(fps[head]), pa.array((at[head] - first[row]).astype(np.int32)), lists], ["key", "n", "fp", "start", "spans"])

    return docs.mapInArrow(giving_back(run), "key long, n int, fp long, start int, spans array<long>")


def item_windows(items: DataFrame, lengths: list[int], window: int, k: int) -> DataFrame:
    """(n, fp, span, words, items): each window of the items once, with its words and the ids of the items that have it. items: (item string, text string)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                text, offsets = utf8(batch.column("text").slice(a, b - a), lower=True)
                starts, ends, first = word_spans(text, offsets, ALNUM)
                hashes, rows, counts = word_hashes(text, starts, ends), rows_of(first), np.diff(first)
                words = [text[s:e].tobytes() for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                for n in lengths:
                    at, fps, spans = _kept(hashes, first, n, k)
                    own = np.flatnonzero((counts[rows[at]] == n) | (n == window))
                    said = pa.array([b" ".join(words[p : p + n]) for p in at[own].tolist()], pa.binary()).cast(pa.string())
                    ids = batch.column("item").slice(a, b - a).take(pa.array(rows[at[own]]))
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), n, np.int32)), pa.array(fps[own]), pa.array(spans[own]), said, ids], ["n", "fp", "span", "words", "item"])

    return items.mapInArrow(giving_back(run), "n int, fp long, span long, words string, item string").groupBy("n", "fp", "span", "words").agg(F.collect_set("item").alias("items"))


def matches(docs: DataFrame, items: DataFrame, lengths: list[int], window: int = 10, k: int = 5) -> DataFrame:
    """(key, start, n, words, items): where a window of a document and one of an item have the same kept hash and the same hash as a whole.

    Rows are windows in common, never pairs of a document and an item that share less. The items' windows are not broadcast: they are many times
    the size of the items that Spark's estimate knows.
    """
    windows = item_windows(items, lengths, window, k)
    left = fingerprints(docs, lengths, k).join(windows.select("n", "fp").distinct(), ["n", "fp"], "left_semi")
    each = left.select("key", "n", "fp", "start", F.posexplode("spans").alias("turn", "span"))
    return each.join(windows.hint("merge"), ["n", "fp", "span"]).select("key", (F.col("start") + F.col("turn")).alias("start"), "n", "words", "items")


def _extend(words: list[bytes], met: list[dict]) -> tuple[list[tuple[int, int]], set[str]]:
    """The runs of the document's words under windows that are there word by word, and the ids of the items that have one."""
    runs, found = [], set()
    for m in sorted(met, key=lambda m: m["start"]):
        low, high = m["start"], m["start"] + m["n"]
        if b" ".join(words[low:high]) != m["words"].encode():
            continue
        found.update(m["items"])
        if runs and low <= runs[-1][1]:
            runs[-1] = (runs[-1][0], max(high, runs[-1][1]))
        else:
            runs.append((low, high))
    return runs, found


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, k: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """All columns of docs and n_words long, n_hit long, hit_items array<string> (sorted), hit_runs array<struct<start, end>> in words.

    Words are lower-cased (A-Z) runs [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+; a window is ``window`` consecutive words of an item.
    """
    refuse_columns(docs, "n_words", "n_hit", "hit_items", "hit_runs")
    texts = items.select(F.col(item_col).cast("string").alias("item"), F.col(item_text_col).cast("string").alias("text")).filter("text IS NOT NULL")
    lengths = _lengths(texts, "text", window)
    inner = [c for c in docs.columns if c not in (id_col, text_col)]
    docs = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"), F.struct(*[F.col(f"`{c}`") for c in inner]).alias("__rest") if inner else F.lit(None).cast("string").alias("__rest"))
    # rows with one id and one text share their matches; should two others get one key, the words part them again
    docs = docs.withColumn("__key", F.xxhash64("__id", "__text"))
    if lengths:
        found = matches(docs.select(F.col("__key").alias("key"), F.col("__text").alias("text")), texts, lengths, window, k)
        met = found.groupBy(F.col("key").alias("__key")).agg(F.collect_set(F.struct("start", "n", "words", "items")).alias("__met"))
        docs = docs.join(met, "__key", "left")
    else:
        docs = docs.withColumn("__met", F.lit(None).cast("array<struct<start:int,n:int,words:string,items:array<string>>>"))
    docs = docs.drop("__key")
    schema = docs.drop("__met").withColumns({"n_words": F.lit(0).cast("long"), "n_hit": F.lit(0).cast("long"), "hit_items": F.array().cast("array<string>"), "hit_runs": F.array().cast("array<struct<start:int,end:int>>")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("__text")):
                part = batch.slice(a, b - a)
                text, offsets = utf8(part.column("__text"), lower=True)
                _, _, first = word_spans(text, offsets, ALNUM)
                hits, names, spans = np.zeros(b - a, np.int64), [[] for _ in range(b - a)], [[] for _ in range(b - a)]
                met = part.column("__met")
                for row in np.flatnonzero(met.is_valid().to_numpy(zero_copy_only=False)):
                    runs, ids = _extend(WORD.findall(text[offsets[row] : offsets[row + 1]].tobytes()), met[int(row)].as_py())
                    hits[row], names[row] = sum(high - low for low, high in runs), sorted(ids)
                    spans[row] = [{"start": low, "end": high} for low, high in runs]
                yield pa.RecordBatch.from_arrays(
                    [part.column("__id"), part.column("__text"), part.column("__rest"), pa.array(np.diff(first).astype(np.int64)), pa.array(hits), pa.array(names, pa.list_(pa.string())), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))],
                    schema.names,
                )

    out = docs.mapInArrow(giving_back(run), schema)
    return out.select(F.col("__id").alias(id_col), F.col("__text").alias(text_col), *[F.col(f"__rest.`{c}`") for c in inner], "n_words", "n_hit", "hit_items", "hit_runs")
