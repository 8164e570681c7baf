"""Substring dedup: the words of windows of ``window`` words whose sequence starts earlier in the corpus are removed.

The suffixes indexed are those at anchors: of the grams of ``k`` words in a window the least one (by hash, the leftmost of equals) is its anchor,
so equal windows have equal anchors at the same place. A suffix carries the words that its windows have before it. Suffixes are split
by prefixes of variable length: first the ``k`` words of the anchor. Prefixes that only one place has are counted out before any suffix is
moved, and exact copies of a text are settled by its hash, the first copy standing for all. Where a prefix leads at most ``group`` windows, its
suffixes go to one task, with many other such prefixes, and become a suffix tree, as the array of the sorted suffixes with the lengths of
their common prefixes; the words before the anchors make a second one, read backwards. A window with o words before its anchor lies below the internal node at
depth ``window`` - o of the first tree and at depth o of the second; the windows below the same pair of nodes, the maximal repeats around the
anchor, are equal, and all but the earliest go. Where a prefix leads more windows than that, it is lengthened to the whole window: these meet by
its hash through the earliest of each, found with partial sums, so a passage of any number of copies is one row.

Words are compared by 48 bits of their hashes in trees, lengthened prefixes by 64 bits of the window.

Defined cases: null and empty texts have no words and stay as they are (null as null); texts under a window lose nothing; documents are ordered
by id, of any type, null first, and those of one id by a hash; rows with the same id and text are one document and all get its result; very long texts
are worked on whole, one at a time. Other columns are passed through whatever their names; n_words, n_removed, removed among them are an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegralType, StructField, StructType

from tilewright.llm.bpe import gather
from tilewright.llm.jobs import checkpoint, refuse_columns
from tilewright.llm.textkit import NON_SPACE, gram_hashes, mix, rows_of, slices, utf8, word_hashes, word_spans

U64 = np.uint64
TREE_WINDOWS = 60_000
CODE = 6  # bytes of a word's code
NAMES = ["lead", "row", "id", "at", "back", "count", "codes", "key", "windows"]


def squeezed(text: bytes) -> bytes:
    """The length and the compressed text."""
    return len(text).to_bytes(8, "little") + pa.Codec("zstd", 1).compress(text, asbytes=True)


def _grams(column: pa.Array, k: int):
    text, offsets = utf8(column)
    starts, ends, first = word_spans(text, offsets, NON_SPACE)
    words = word_hashes(text, starts, ends)
    return text, offsets, words, first, *gram_hashes(words, first, k)


def _anchors(grams: np.ndarray, inside: np.ndarray, window: int, k: int) -> np.ndarray:
    """For each place that a window could start at, where the least of its grams is, the leftmost of equals."""
    n, steps = len(grams), window - k + 1
    g = np.where(inside, grams, ~U64(0))
    least, place = g[: n - window + 1].copy(), np.arange(n - window + 1)
    for j in range(1, steps):
        less = np.flatnonzero(g[j : j + n - window + 1] < least)
        least[less] = g[less + j]
        place[less] = less + j
    return place


def _fits(first: np.ndarray, n: int, window: int) -> np.ndarray:
    """Whether the window from each word on stays inside the row of the word."""
    return np.arange(n - window + 1) + window <= np.repeat(first[1:], np.diff(first))[: n - window + 1]


def leads(texts: DataFrame, window: int, k: int) -> DataFrame:
    """(lead, row, own, places, windows): each gram of k words that leads windows, once for a text, with a hash of the text, at how many places and how many windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                text, offsets, words, first, grams, inside = _grams(batch.column("text").slice(a, b - a), k)
                n = len(words)
                if n < window:
                    continue
                fits = _fits(first, n, window)
                place = _anchors(grams, inside, window, k)[fits]
                new = np.ones(len(place), bool)
                new[1:] = place[1:] != place[:-1]
                count = np.diff(np.append(np.flatnonzero(new), len(place)))
                place = place[new]
                rows, lead = rows_of(first)[place], grams[place]
                order = np.lexsort((lead, rows))
                rows, lead, count = rows[order], lead[order], count[order]
                new = np.ones(len(rows), bool)
                new[1:] = (lead[1:] != lead[:-1]) | (rows[1:] != rows[:-1])
                at = np.flatnonzero(new)
                own = word_hashes(text, offsets[:-1], offsets[1:])
                places, windows = np.diff(np.append(at, len(rows))), np.add.reduceat(count, at) if len(at) else count
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lead[at].view(np.int64)), batch.column("row").slice(a, b - a).take(pa.array(rows[at])), pa.array(own[rows[at]].view(np.int64)), pa.array(places.astype(np.int32)), pa.array(windows.astype(np.int32))],
                    ["lead", "row", "own", "places", "windows"],
                )

    return texts.select("row", "text").mapInArrow(run, "lead long, row long, own long, places int, windows int")


def packed(texts: DataFrame, *keep: str) -> DataFrame:
    """(row, id, packed) and columns to keep: the text compressed, as it is to be moved."""
    schema = StructType([*texts.select("row", "id").schema, StructField("packed", BinaryType()), *texts.select(*keep).schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text"), 1 << 20):
                data = [None if t is None else squeezed(t) for t in batch.column("text").slice(a, b - a).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("row").slice(a, b - a), batch.column("id").slice(a, b - a), pa.array(data, pa.binary()), *[batch.column(c).slice(a, b - a) for c in keep]], schema.names)

    return texts.select("row", "id", "text", *keep).mapInArrow(run, schema)


def unpacked(column: pa.Array) -> list[bytes | None]:
    return [None if t is None else pa.Codec("zstd").decompress(t[8:], int.from_bytes(t[:8], "little"), asbytes=True) for t in column.to_pylist()]


def _pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Few rows at a time with their texts, of about half a megabyte."""
    sizes = [0 if t is None else int.from_bytes(t[:8], "little") for t in batch.column("packed").to_pylist()]
    at = 0
    while at < batch.num_rows:
        to, total = at, 0
        while to < batch.num_rows and to - at < rows and (to == at or total + sizes[to] <= 1 << 19):
            total += sizes[to]
            to += 1
        part = batch.slice(at, to - at)
        yield part, unpacked(part.column("packed"))
        at = to


def _suffix_runs(found: DataFrame, window: int, k: int) -> DataFrame:
    """Suffixes at anchors with a shared prefix: (lead, row, id, at, back, count, codes) with ``back`` words before them for ``count`` windows; with a lengthened prefix: (row, id, at, count, key of the run, its windows that are new in their text, by step and hash); and (row, id, at, back) of words covered by the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _pieces(batch):
                _, _, words, first, grams, inside = _grams(pa.array(texts, pa.binary()).cast(pa.string()), k)
                n = len(words)
                if n < window:
                    continue
                marks = part.column("leads")
                counts = marks.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                flat = marks.flatten()
                known = mix(flat.field("lead").to_numpy(zero_copy_only=False).view(U64)) + np.repeat(np.arange(len(counts)), counts).astype(U64)
                by_key = np.argsort(known)
                known, weight = known[by_key], 1 + flat.field("heavy").to_numpy(zero_copy_only=False).astype(np.int8)[by_key]
                place = _anchors(grams, inside, window, k)
                rows = rows_of(first)[: n - window + 1]
                asked = mix(grams[place]) + rows.astype(U64)
                hit = np.minimum(np.searchsorted(known, asked), len(known) - 1)
                kind = np.where(_fits(first, n, window) & (known[hit] == asked), weight[hit], 0)
                for weight_ in (1, 2):
                    own = np.flatnonzero(kind == weight_)
                    if not len(own):
                        continue
                    new = np.ones(len(own), bool)
                    parts = place[own] if weight_ == 1 else grams[place[own]]
                    new[1:] = (np.diff(own) > 1) | (parts[1:] != parts[:-1]) | (np.diff(rows[own]) > 0)
                    begin, count = own[new], np.diff(np.append(np.flatnonzero(new), len(own)))
                    r, length = rows[begin], count + window - 1
                    inside_run = gather(begin, length)
                    named = [part.column("row").take(pa.array(r)), part.column("id").take(pa.array(r))]
                    none = lambda kind, m=len(begin): pa.nulls(m, kind)
                    if weight_ == 1:
                        codes = np.ascontiguousarray(words[inside_run].view(np.uint8).reshape(-1, 8)[:, :CODE])
                        bounds = np.concatenate([[0], np.cumsum(length * CODE)]).astype(np.int32)
                        data = pa.BinaryArray.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(codes.tobytes())])
                        anchor = place[begin]
                        columns = [pa.array(grams[anchor].view(np.int64)), *named, pa.array((anchor - first[r]).astype(np.int32)), pa.array((anchor - begin).astype(np.int32)), pa.array(count.astype(np.int32)), data, none(pa.int64()), none(pa.list_(pa.struct([("step", pa.int32()), ("window", pa.int64())])))]
                    else:
                        turn = inside_run - np.repeat(begin, length)
                        key = mix(np.add.reduceat(mix(words[inside_run] + turn.astype(U64)), np.cumsum(length) - length) + length.astype(U64))
                        # a window that its text has had before repeats it, however often a text says the same
                        whole = gram_hashes(words, first, window)[0][own]
                        order = np.lexsort((own, whole, rows[own]))
                        fresh = np.ones(len(own), bool)
                        fresh[order[1:]] = (whole[order][1:] != whole[order][:-1]) | (rows[own][order][1:] != rows[own][order][:-1])
                        of = np.repeat(np.arange(len(begin)), count)
                        bounds = np.concatenate([[0], np.cumsum(np.bincount(of[fresh], minlength=len(begin)))])
                        each = pa.StructArray.from_arrays([pa.array((own - begin[of])[fresh].astype(np.int32)), pa.array(whole[fresh].view(np.int64))], ["step", "window"])
                        columns = [none(pa.int64()), *named, pa.array((begin - first[r]).astype(np.int32)), none(pa.int32()), pa.array(count.astype(np.int32)), none(pa.binary()), pa.array(key.view(np.int64)), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), each)]
                        if not fresh.all():
                            again = own[~fresh]
                            new = np.ones(len(again), bool)
                            new[1:] = (np.diff(again) > 1) | (np.diff(rows[again]) > 0)
                            low, high = again[new], again[np.append(np.flatnonzero(new)[1:] - 1, len(again) - 1)] + window
                            r = rows[low]
                            none = lambda kind, m=len(low): pa.nulls(m, kind)
                            known_ = [none(pa.int64()), part.column("row").take(pa.array(r)), part.column("id").take(pa.array(r)), pa.array((low - first[r]).astype(np.int32)), pa.array((high - first[r]).astype(np.int32))]
                            yield pa.RecordBatch.from_arrays([*known_, none(pa.int32()), none(pa.binary()), none(pa.int64()), none(columns[-1].type)], NAMES)
                    yield pa.RecordBatch.from_arrays(columns, NAMES)

    return found.mapInArrow(run, "lead long, row long, id long, at int, back int, count int, codes binary, key long, windows array<struct<step:int,window:long>>")


class SuffixTree:
    """The suffixes of some prefixes in order, and how long a prefix each shares with the one before: the nodes at any depth."""

    def __init__(self, lead: np.ndarray, words: np.ndarray):
        self.order = np.lexsort([*words.T[::-1], lead])
        ordered, led = words[self.order], lead[self.order]
        same = np.logical_and.accumulate(ordered[1:] == ordered[:-1], axis=1).sum(1)
        self.common = np.where(led[1:] == led[:-1], same, -1)

    def nodes(self, depth: int) -> np.ndarray:
        """The number of the node at this depth above each suffix."""
        out = np.zeros(len(self.order), np.int64)
        out[self.order[1:]] = np.cumsum(self.common < depth)
        return out


def repeated_windows(lead: np.ndarray, row: np.ndarray, id_: np.ndarray, at: np.ndarray, back: np.ndarray, count: np.ndarray, codes: list[bytes], window: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and start of each window, of the suffixes of some prefixes, that an earlier one equals."""
    lengths = count + window - 1
    flat = np.zeros((int(lengths.sum()), 8), np.uint8)
    flat[:, :CODE] = np.frombuffer(b"".join(codes), np.uint8).reshape(-1, CODE)
    flat = flat.view(np.int64).ravel()
    anchor = np.cumsum(lengths) - lengths + back
    ahead, behind = np.arange(window), np.arange(window - k)
    # what a suffix doesn't carry is a word of its own, and none of its windows reaches that far
    right = np.where(ahead < (lengths - back)[:, None], flat[np.minimum(anchor[:, None] + ahead, len(flat) - 1)], -1)
    left = np.where(behind < back[:, None], flat[np.maximum(anchor[:, None] - 1 - behind, 0)], -1)
    after, before = SuffixTree(lead, right), SuffixTree(lead, left)
    rank = np.empty(len(row), np.int64)
    rank[np.lexsort((at, row, id_))] = np.arange(len(row))
    rows, starts = [], []
    for o in range(window - k + 1):
        own = np.flatnonzero((back >= o) & (back - o < count))
        if len(own) < 2:
            continue
        pair = after.nodes(window - o)[own] * len(row) + before.nodes(o)[own]
        order = np.lexsort((rank[own], pair))
        own, pair = own[order], pair[order]
        new = np.ones(len(own), bool)
        new[1:] = pair[1:] != pair[:-1]
        earliest = own[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
        again = own[(row[own] != row[earliest]) | (at[own] != at[earliest])]  # rows that are one document hold a window twice
        rows.append(row[again])
        starts.append(at[again] - o)
    return (np.concatenate(rows), np.concatenate(starts)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _intervals(row: np.ndarray, start: np.ndarray, window: int) -> pa.RecordBatch:
    order = np.lexsort((start, row))
    row, start = row[order], start[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] - start[:-1] > window)
    last = np.append(np.flatnonzero(new)[1:] - 1, len(row) - 1) if len(row) else np.zeros(0, int)
    return pa.RecordBatch.from_arrays([pa.array(row[new]), pa.array(start[new].astype(np.int32)), pa.array((start[last] + window).astype(np.int32))], ["row", "low", "high"])


def repeats(texts: DataFrame, window: int, k: int, group: int, ordered: DataFrame | None) -> DataFrame:
    """(row, id, low, high): spans of words that repeated windows cover, high perhaps beyond the end. texts: (row, id, text); ordered: (row, id) where texts have no ids of their own."""
    base = texts.select("row", *([] if ordered is not None else ["id"]), F.md5(F.col("text").cast("binary")).alias("copy"))
    base = checkpoint(base.join(ordered, "row") if ordered is not None else base)
    firsts = base.groupBy("copy").agg(F.min(F.struct("id", "row")).alias("first"))
    later = checkpoint(base.join(firsts, "copy").filter(F.col("row") != F.col("first.row")).select("row", "id", F.lit(0).alias("low"), F.lit((1 << 31) - 1).alias("high")).distinct())

    led = leads(texts, window, k)
    counted = led.groupBy("lead").agg(F.min("own").alias("a"), F.max("own").alias("b"), F.max("places").alias("places"), F.sum("windows").alias("windows"))
    shared = counted.filter("a <> b OR places > 1").select("lead", (F.col("windows") > group).alias("heavy"))
    marked = led.select("lead", "row").join(shared, "lead").groupBy("row").agg(F.collect_set(F.struct("lead", "heavy")).alias("leads"))
    marked = checkpoint(marked.join(later.select("row").distinct(), "row", "left_anti"))
    found = packed(texts).join(marked, "row")
    if ordered is not None:
        found = found.drop("id").join(ordered, "row")
    runs = checkpoint(_suffix_runs(found.select("row", "id", "packed", "leads"), window, k))

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grown(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(rows)
            ids = t.column("id").fill_null(-(1 << 63))
            numbers = [t.column(c).to_numpy().astype(np.int64) for c in ("at", "back", "count")]
            rows_, starts = repeated_windows(t.column("lead").to_numpy(), t.column("row").to_numpy(), ids.to_numpy(), *numbers, t.column("codes").to_pylist(), window, k)
            return _intervals(rows_, starts, window)

        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            lead = batch.column("lead").to_numpy()
            edges = np.flatnonzero(lead[1:] != lead[:-1]) + 1
            sizes = np.concatenate([[0], np.cumsum(batch.column("count").to_numpy())])
            at = 0
            if held and held[-1].column("lead")[-1].as_py() != lead[0] and size >= TREE_WINDOWS:
                yield grown(held)
                held, size = [], 0
            for edge in edges.tolist():
                if size + sizes[edge] - sizes[at] >= TREE_WINDOWS:
                    held.append(batch.slice(at, edge - at))
                    yield grown(held)
                    held, size, at = [], 0, edge
            held.append(batch.slice(at))
            size += sizes[-1] - sizes[at]
        if held:
            yield grown(held)

    light = runs.filter("lead IS NOT NULL").select("lead", "row", "id", "at", "back", "count", "codes").repartition("lead").sortWithinPartitions("lead")
    below = light.mapInArrow(trees, "row long, low int, high int")
    # runs of lengthened prefixes: of equal runs all but the first repeat; the first ones are compared window by window
    heavy = runs.filter("key IS NOT NULL").select("key", F.struct("id", "row", F.col("at").alias("start")).alias("at"), "count", "windows")
    equal = heavy.groupBy("key").agg(F.min("at").alias("first"))
    joined = checkpoint(heavy.join(equal, "key").select("at", (F.col("at") == F.col("first")).alias("leads"), "count", F.when(F.col("at") == F.col("first"), F.col("windows")).alias("windows")))
    again = joined.filter("NOT leads").select(F.col("at.row").alias("row"), F.col("at.start").alias("low"), (F.col("at.start") + F.col("count") + window - 1).alias("high"))
    said = runs.filter("lead IS NULL AND key IS NULL").select("row", F.col("at").alias("low"), F.col("back").alias("high"))
    single = joined.filter("leads").select("at", F.explode("windows").alias("w")).select("w.window", F.struct(F.col("at.id").alias("id"), F.col("at.row").alias("row"), (F.col("at.start") + F.col("w.step")).alias("start")).alias("at"))
    earliest = single.groupBy("window").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("held")).filter("held > 1").select("window", "first")
    met = single.join(earliest, "window").filter("at <> first").select(F.col("at.row").alias("row"), F.col("at.start").alias("low"), (F.col("at.start") + window).alias("high")).unionByName(again).unionByName(said)
    return below.unionByName(met).unionByName(later.select("row", "low", "high"))


def dedup_substrings(docs: DataFrame, window: int = 20, k: int = 8, group: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs, with the text as its kept words joined by a blank, and n_words long, n_removed long, removed array<struct<low, high>>."""
    refuse_columns(docs, "n_words", "n_removed", "removed")
    inner = [c for c in docs.columns if c not in (id_col, text_col)]
    number = isinstance(docs.schema[id_col].dataType, IntegralType)
    doc, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")
    rest = F.struct(*[F.col(f"`{c}`") for c in inner], *([] if number else [doc])) if inner or not number else F.lit(None).cast("int")
    texts = docs.select(F.xxhash64(doc, text).alias("row"), (doc if number else F.lit(None)).cast("long").alias("id"), text.alias("text"), rest.alias("rest"), *([] if number else [doc.alias("doc")]))
    there = texts.filter("text IS NOT NULL")
    ordered = None
    if not number:  # documents numbered in the order of their ids
        ordered = checkpoint(there.select("doc", "row").distinct().orderBy("doc", "row").select("row", F.monotonically_increasing_id().alias("id")))
    spans = repeats(there.select("row", "id", "text"), window, k, group, ordered).groupBy("row").agg(F.collect_set(F.struct("low", "high")).alias("spans"))
    moved = packed(texts, "rest").join(spans, "row", "left")
    removed_kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts_ in _pieces(batch):
                kept, n_words, n_removed, removed = [], [], [], []
                for text, own in zip(texts_, part.column("spans").to_pylist(), strict=True):
                    words = [] if text is None else text.split()
                    n_words.append(len(words))
                    runs, at, out = [], 0, []
                    for s in sorted(own or [], key=lambda s: (s["low"], s["high"])) if len(words) >= window else []:
                        high = min(s["high"], len(words))
                        if runs and s["low"] <= runs[-1]["high"]:
                            runs[-1]["high"] = max(runs[-1]["high"], high)
                        else:
                            runs.append({"low": s["low"], "high": high})
                    for s in runs:
                        out += words[at : s["low"]]
                        at = s["high"]
                    out += words[at:]
                    kept.append(None if text is None else b" ".join(out))
                    n_removed.append(len(words) - len(out))
                    removed.append(runs)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("rest"), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(removed, removed_kind)],
                    ["id", "rest", "text", "n_words", "n_removed", "removed"],
                )

    made = "text string, n_words long, n_removed long, removed array<struct<low:int,high:int>>"
    done = moved.select("row", "id", "packed", "rest", "spans").mapInArrow(run, StructType([*texts.select("id", "rest").schema, *StructType.fromDDL(made)]))
    own = {text_col: F.col("text"), **({id_col: F.col("id").cast(docs.schema[id_col].dataType)} if number else {})}
    return done.select(*[own.get(c, F.col(f"rest.`{c}`")).alias(c) for c in docs.columns], "n_words", "n_removed", "removed")
