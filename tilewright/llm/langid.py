"""Language identification: averaged embeddings of hashed byte n-grams (2 to 4 bytes, words set off by blanks) under a linear softmax.

Trained by stochastic gradient descent in numpy on a bounded sample of labelled rows (``rows``): each document's whole text and a
short run of its words, so that short texts are met too. A temperature is fitted on a part kept back from training; ``reject_below`` is
the score under which a prediction is not accepted, chosen on the same part. Scoring is one pass without a shuffle: embedding and softmax
weights are multiplied once, and a text is the mean of its n-grams' rows in that product.

Defined cases: a null text, an empty one and one without a letter get ``und`` and score 0; with no labelled row every text does. A row
without a label or text is not learnt from. Repeated rows are predicted alike; of equally likely languages the first by name is taken; very long texts
are read whole. Other columns are passed through; columns called like those added are an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tilewright.llm.jobs import bounded_sample, numbered, refuse_columns, widened
from tilewright.llm.textkit import LOWER, slices, utf8

BITS = 13
BUCKETS = 1 << BITS
SLICE_ROWS = 384
UNKNOWN = "und"
#: Letters of ASCII in lower case and all bytes of other characters; the rest parts words.
_FOLD = LOWER.copy()
_FOLD[:128] = np.where((LOWER[:128] >= 97) & (LOWER[:128] <= 122), LOWER[:128], 32)


def gram_counts(text: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How often each text of a slice has an n-gram of each bucket."""
    n = len(offsets) - 1
    room = np.diff(offsets) + 2  # a blank before and behind
    ends = np.cumsum(room)
    padded = np.full(int(ends[-1]) if n else 0, 32, np.uint8)
    body = np.ones(len(padded), bool)
    body[ends - 1] = body[ends - room] = False
    padded[body] = _FOLD[text]
    rows = np.repeat(np.arange(n, dtype=np.int64), room)
    wide = padded.astype(np.uint32)
    keys = []
    code = wide.copy()
    for size in (2, 3, 4):
        code = (code[:-1] << np.uint32(8)) | wide[size - 1 :]
        spread = (code * np.uint32(2654435761) + np.uint32(size * 40503)) ^ (code >> np.uint32(15))
        bucket = ((spread * np.uint32(2246822519)) >> np.uint32(32 - BITS)).astype(np.int64)
        inside = (rows[: len(code)] == rows[size - 1 :]) & (padded[: len(code)] + padded[1 : len(code) + 1].astype(np.int32) > 64)
        keys.append((rows[: len(code)][inside] << BITS) + bucket[inside])
    return np.bincount(np.concatenate(keys), minlength=n * BUCKETS).reshape(n, BUCKETS)


@dataclass
class Model:
    languages: list[str]
    table: np.ndarray  # BUCKETS x languages: embedding times softmax weights
    bias: np.ndarray
    temperature: float = 1.0
    reject_below: float = 0.0

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        logits = (counts @ self.table / np.maximum(counts.sum(1, keepdims=True), 1) + self.bias) / self.temperature
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        return e / e.sum(1, keepdims=True)


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], dim: int = 16, epochs: int = 12, rate: float = 8.0, precision: float = 0.99, seed: int = 3) -> Model:
    """``counts``: for each text its buckets and how often it has them."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0, np.float32))
    random = np.random.default_rng(seed)
    y = np.array([languages.index(x) for x in labels])
    order = random.permutation(len(y))
    held, learnt = order[: len(y) // 5], order[len(y) // 5 :] if len(y) > 5 else order

    def dense(some: np.ndarray) -> np.ndarray:
        out = np.zeros((len(some), BUCKETS), np.float32)
        for k, i in enumerate(some):
            out[k, counts[i][0]] = counts[i][1] / max(1, counts[i][1].sum())
        return out

    embedding = random.normal(0, 0.3, (BUCKETS, dim)).astype(np.float32)
    weights, bias = random.normal(0, 0.3, (dim, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for at in range(0, len(learnt), 64):
            some = learnt[at : at + 64]
            x = dense(some)
            hidden = x @ embedding
            logits = hidden @ weights + bias
            logits -= logits.max(1, keepdims=True)
            error = np.exp(logits)
            error /= error.sum(1, keepdims=True)
            error[np.arange(len(some)), y[some]] -= 1
            error /= len(some)
            back = error @ weights.T
            weights -= step * 0.1 * hidden.T @ error
            bias -= step * 0.1 * error.sum(0)
            embedding -= step * 10 * (x.T @ back)
        random.shuffle(learnt)
    model = Model(languages, embedding @ weights, bias)
    if len(held):
        x, truth = dense(held), y[held]
        losses = []
        for t in np.geomspace(0.25, 8, 21):
            model.temperature = t
            losses.append((-np.log(np.maximum(model.probabilities(x)[np.arange(len(held)), truth], 1e-12)).mean(), t))
        model.temperature = min(losses)[1]
        p = model.probabilities(x)
        best, right = p.max(1), p.argmax(1) == truth
        down = np.argsort(-best)
        enough = np.cumsum(right[down]) >= precision * np.arange(1, len(down) + 1)
        model.reject_below = float(best[down][np.flatnonzero(enough).max()]) if enough.any() else 1.0
    return model


def train(docs: DataFrame, rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", seed: int = 5) -> Model:
    """Fits on about ``rows`` of the given documents."""
    labelled = docs.select(F.col(id_col).cast("string").alias("__id"), F.col(text_col).cast("string").alias("__text"), F.col(label_col).cast("string").alias("__label"))
    chosen = bounded_sample(labelled.filter("__text IS NOT NULL AND __label IS NOT NULL AND __text rlike '\\\\p{L}'"), "__id", rows)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            random = np.random.default_rng(seed)
            for a, b in slices(batch.column("__text"), rows=SLICE_ROWS):
                whole = batch.column("__text").slice(a, b - a)
                parts = []
                for text in whole.to_pylist():
                    words = text.split()
                    size = int(random.integers(1, 13))
                    at = int(random.integers(0, max(1, len(words) - size)))
                    parts.append(" ".join(words[at : at + size]))
                for column in (whole, pa.array(parts, pa.string())):
                    seen = gram_counts(*utf8(column))
                    found = [np.flatnonzero(x) for x in seen]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("__id").slice(a, b - a), batch.column("__label").slice(a, b - a), pa.array([f.astype(np.int32).tobytes() for f in found], pa.binary()), pa.array([x[f].astype(np.int32).tobytes() for x, f in zip(seen, found, strict=True)], pa.binary())],
                        ["id", "label", "buckets", "counts"],
                    )

    got = chosen.mapInArrow(sparse, "id string, label string, buckets binary, counts binary").collect()
    got.sort(key=lambda r: (r["id"], r["buckets"]))
    got = [r for r in got if r["buckets"]]
    return fit([(np.frombuffer(r["buckets"], np.int32), np.frombuffer(r["counts"], np.int32)) for r in got], [r["label"] for r in got])


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` and lang_pred string, score double, accepted boolean."""
    keep = [c for c in docs.columns if c != text_col] if keep is None else keep
    refuse_columns(docs.select(*[F.col(f"`{c}`") for c in keep]), "lang_pred", "score", "accepted")
    text = F.col(f"`{text_col}`").cast("string")
    narrow, own = numbered(docs, keep, text.alias("__text"), F.coalesce(text.rlike(r"\p{L}"), F.lit(False)).alias("__letters"))
    schema = widened(narrow.drop("__text", "__letters"), lang_pred="string", score="double", accepted="boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for batch in batches:
            for a, b in slices(batch.column("__text"), rows=SLICE_ROWS):
                letters = batch.column("__letters").slice(a, b - a).to_numpy(zero_copy_only=False)
                if model.languages:
                    p = model.probabilities(gram_counts(*utf8(batch.column("__text").slice(a, b - a))))
                    best, top = p.argmax(1), p.max(1).astype(float)
                else:
                    best, top, letters = np.zeros(b - a, int), np.zeros(b - a), np.zeros(b - a, bool)
                best, top = np.where(letters, best, len(model.languages)), np.where(letters, top, 0.0)
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(a, b - a) for c in own], pa.array(names[best], pa.string()), pa.array(top), pa.array(letters & (top >= model.reject_below))], schema.names)

    return narrow.mapInArrow(run, schema).toDF(*keep, *schema.names[len(keep) :])
