"""Quality classifier: ordinal regression with cumulative links.

A grade has ordered levels 0 .. m. One weight per hashed text feature is shared by all levels; ordered thresholds cut the score:
P(grade >= j) = sigmoid(score - threshold_j). Features of a whole text: which words it has (runs of letters and digits, ASCII case folded),
which runs of other characters stand between them, and how dense capitals, other characters and repeated words are, by steps.

Fitted on a bounded sample of rated rows (``rows``), scored in one pass without a shuffle.

Defined cases: a null or empty text has the features of a text without words; a row without a rating is never learnt from; with no
rated row at all every document has the middle of the scale. Repeated rows are scored alike, equal scores get equal probabilities, very long texts
are read whole. Other columns are passed through; columns called like those added are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tilewright.llm.jobs import bounded_sample, giving_back, numbered, refuse_columns, widened
from tilewright.llm.textkit import ALNUM, rows_of, slices, utf8, word_hashes, word_spans

U64 = np.uint64
BITS = 18
BUCKETS = 1 << BITS
_OTHER = ~ALNUM
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SIGN = _OTHER.copy()
_SIGN[[0x20, *range(0x09, 0x0E), *b".,-'\""]] = False
_SIGN[65:91] = False


def features(column: pa.Array) -> np.ndarray:
    """The features of a slice of texts, each once: row * BUCKETS + bucket, in order."""
    raw, offsets = utf8(column)
    text, _ = utf8(column, lower=True)
    n = len(column)
    seen = []
    counts = np.zeros(n, np.int64)
    repeats = np.zeros(n)
    for salt, table in ((0, ALNUM), (1, _OTHER)):
        starts, ends, first = word_spans(text, offsets, table)
        if not len(starts):
            continue
        hashes = word_hashes(text, starts, ends)
        rows = rows_of(first)
        seen.append((rows << BITS) + ((hashes + U64(salt)) >> U64(64 - BITS)).astype(np.int64))
        if not salt:
            counts = np.diff(first)
            follows = np.zeros(len(hashes), bool)
            follows[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
            repeats = np.bincount(rows, follows, n)
    size = np.maximum(np.diff(offsets), 1)
    sums = lambda flags: np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])
    shares = [sums(_UPPER[raw]) / size, sums(_SIGN[raw]) / size, repeats / np.maximum(counts, 1), (counts + 1.0) / (size / 6 + 1) / 4]
    for k, share in enumerate(shares):
        step = np.minimum(np.ceil(np.log2(1 + 255 * np.clip(share, 0, 1))), 8).astype(np.int64)
        for level in range(9):
            seen.append((np.flatnonzero(step >= level) << BITS) + 16 * k + level)
    return np.unique(np.concatenate(seen))


#: The grades of grade(), and the probability of the highest from which on a document is selected.
GRADES, SELECT_FROM = 3, 0.5


def grade() -> Column:
    """Of ratings (quality, toxic): 0 poor, 1 sound but toxic, 2 sound and clean; null if there is no rating."""
    clean = F.coalesce(F.col("toxic"), F.lit(0)) == 0
    return F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when((F.col("quality") == 1) & clean, 2)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray
    levels: int

    def at_least(self, scores: np.ndarray) -> np.ndarray:
        """P(grade >= j) for j = 1 .. levels - 1, one column each."""
        return 1 / (1 + np.exp(-np.clip(scores[:, None] - self.thresholds[None, :], -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, epochs: int = 12, rate: float = 0.1, decay: float = 2e-5, seed: int = 7) -> Model:
    """Adaptive stochastic gradient descent on the likelihood of the grades; ``rows`` has the buckets of each text."""
    weights, squares = np.zeros(BUCKETS), np.full(BUCKETS, 1e-2)
    first, gaps = -1.0, np.zeros(levels - 2)
    slopes = np.full(levels - 1, 1e-2)
    random = np.random.default_rng(seed)
    average, taken = np.zeros(BUCKETS), 0
    lengths = np.array([len(r) for r in rows]) if rows else np.zeros(0, int)
    for epoch in range(epochs if rows else 0):
        order = random.permutation(len(rows))
        for at in range(0, len(order), 64):
            some = order[at : at + 64]
            flat, owner = np.concatenate([rows[i] for i in some]), np.repeat(np.arange(len(some)), lengths[some])
            score = np.bincount(owner, weights[flat], len(some))
            cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
            padded = np.concatenate([[-40], cuts, [40]])
            y = grades[some]
            low = 1 / (1 + np.exp(-np.clip(score - padded[y], -40, 40)))
            high = 1 / (1 + np.exp(-np.clip(score - padded[y + 1], -40, 40)))
            slope = 1 - low - high  # of log(low - high) along the score
            gradient = np.bincount(flat, slope[owner], BUCKETS) / len(some) - decay * weights
            squares += gradient**2
            weights += rate * gradient / np.sqrt(squares)
            width = np.maximum(low - high, 1e-9)
            by_cut = np.zeros(levels + 1)
            np.add.at(by_cut, y, -low * (1 - low) / width)
            np.add.at(by_cut, y + 1, high * (1 - high) / width)
            by_cut = by_cut[1:-1] / len(some)
            along = np.concatenate([[by_cut.sum()], np.exp(gaps) * np.cumsum(by_cut[::-1])[::-1][1:]])
            slopes += along**2
            step = 0.05 * along / np.sqrt(slopes)
            first, gaps = first + step[0], np.clip(gaps + step[1:], -6, 4)
            if epoch >= epochs // 2:
                average, taken = average + weights, taken + 1
    cuts = first + np.concatenate([[0], np.cumsum(np.exp(gaps))])
    return Model((average / taken if taken else weights).astype(np.float64), cuts if rows else np.linspace(-1, 1, levels - 1), levels)


def train(docs: DataFrame, ratings: DataFrame, grade: Column, levels: int, rows: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fits on about ``rows`` rated documents. ``grade`` is a column over the ratings, 0 .. levels - 1, null where there is none.

    Of several ratings of one document the lowest holds.
    """
    rated = ratings.select(F.col(id_col).alias("__id"), grade.cast("int").alias("__grade")).filter("__id IS NOT NULL AND __grade IS NOT NULL")
    rated = bounded_sample(rated.groupBy("__id").agg(F.min("__grade").alias("__grade")), "__id", rows)
    texts = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").alias("__text"))
    chosen = texts.join(rated, "__id").select("__id", "__text", "__grade")

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("__text"), rows=1 << 14):
                seen = features(batch.column("__text").slice(a, b - a))
                ends = np.searchsorted(seen, np.arange(1, b - a) << BITS)
                packed = [x.tobytes() for x in np.split((seen & (BUCKETS - 1)).astype(np.int32), ends)]
                yield pa.RecordBatch.from_arrays([batch.column("__id").slice(a, b - a).cast(pa.string()), batch.column("__grade").slice(a, b - a), pa.array(packed, pa.binary())], ["id", "grade", "buckets"])

    got = chosen.mapInArrow(giving_back(sparse), "id string, grade int, buckets binary").orderBy(F.xxhash64("id"), "id", "buckets").limit(2 * rows).collect()
    got.sort(key=lambda r: (r["id"], r["buckets"]))
    return fit([np.frombuffer(r["buckets"], np.int32).astype(np.int64) for r in got], np.array([r["grade"] for r in got], int), levels)


def score(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None, keep_text: bool = False) -> DataFrame:
    """The columns ``keep`` and expected_grade double, at_least array<double>: the probability of each level from 1 on, or more."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    refuse_columns(docs.select(*[F.col(f"`{c}`") for c in keep]), "expected_grade", "at_least")
    narrow, names = numbered(docs, keep, F.col(f"`{text_col}`").cast("string").alias("__text"))
    given = narrow if keep_text else narrow.drop("__text")
    schema = widened(given, expected_grade="double", at_least="array<double>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("__text")
            for a, b in slices(text, rows=1 << 14):
                part = text.slice(a, b - a)
                seen = features(part)
                scores = np.bincount(seen >> BITS, model.weights[seen & (BUCKETS - 1)], len(part))
                tails = model.at_least(scores)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, tails.size + 1, tails.shape[1]), pa.int32()), pa.array(tails.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in names], *([part] if keep_text else []), pa.array(tails.sum(1)), lists], schema.names)

    return narrow.mapInArrow(giving_back(run), schema).toDF(*keep, *schema.names[len(keep) :])
