"""Sharding by vector bin packing: bytes, words and rows of the shards are balanced jointly.

Documents of equal text are one item with three sizes. An item goes where the dot product of its sizes with the shard's residual capacity
is highest, among the shards it still fits in. A group of copies that would fill more than half of a shard is split into pieces by row.

At scale the items are dealt into cells of about ``cell_items``. The few items over 1/64 of a shard (at most 64 * shards for each size) are
packed first, in one task; each cell then packs its own items against its share of what those leave free, so the errors of cells
don't add up in the same shards. Slots count through sub-buckets of a shard with offsets, never through a whole shard in one task.

Defined cases: a null text has no bytes and words, like an empty one; rows with equal text, and wholly repeated rows, stay together unless
their group is split; an empty table gives no rows; items of equal size are packed in the order of their hashes; a text of any length is one item; other
columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tilewright.llm.jobs import checkpoint

SIZES = ("bytes", "words", "rows")
SLACK = 0.02


def pack(items: np.ndarray, room: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The shard of each item. items: sizes as shares of a shard, largest first; room: free share of each shard and size, which is used up.

    Bytes are the law; words and rows may pass their share by a little, so that they don't keep an item from where its bytes belong.
    """
    out = np.empty(len(items), np.int64)
    weights = np.array([2.0, 1.0, 1.0])
    room = room[order] * np.array([1, 1 + SLACK, 1 + SLACK])
    for k, item in enumerate(items):
        value = room @ (item * weights)
        fits = (room >= item).all(1)
        best = int(np.where(fits, value, -np.inf).argmax()) if fits.any() else int(room[:, 0].argmax())
        room[best] -= item
        out[k] = order[best]
    return out


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16, cell_items: int = 20_000, slot_rows: int = 50_000) -> DataFrame:
    """(id, size long, text_crc32 long, shard int, slot long). size: UTF-8 bytes and ``overhead``."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text")).select(
        "id",
        (F.octet_length("text") + overhead).cast("long").alias("size"),
        F.regexp_count("text", F.lit("[^ \\t\\r\\n]+")).cast("long").alias("words"),
        F.crc32(F.col("text").cast("binary")).alias("crc"),
        F.xxhash64("text").alias("copy"),
    )
    rows = checkpoint(rows.withColumn("row", F.monotonically_increasing_id()))
    sums = (F.sum("size").alias("bytes"), F.sum("words").alias("words"), F.count(F.lit(1)).alias("rows"))
    groups = rows.groupBy("copy", "crc").agg(*sums)
    total = groups.agg(*[F.sum(s).alias(s) for s in SIZES], F.count(F.lit(1)).alias("items")).first()
    capacity = np.array([max(1, total[s] or 0) / shards for s in SIZES])
    share = F.greatest(*[F.col(s) / F.lit(float(c)) for s, c in zip(SIZES, capacity, strict=True)])
    # at most 2 * shards groups for each size are over half a shard
    split = groups.filter(share > 0.5).select("copy", "crc", F.least(F.ceil(share * 4), F.col("rows")).alias("pieces"))
    dealt = rows.join(F.broadcast(split), ["copy", "crc"], "left").withColumn("piece", F.when(F.col("pieces") > 1, F.pmod(F.xxhash64("row"), "pieces")).otherwise(F.lit(0).cast("long"))).drop("pieces")
    items = checkpoint(dealt.groupBy("copy", "crc", "piece").agg(*sums).withColumn("share", share))
    schema = "copy long, crc long, piece long, shard int"

    def packed(frame: pd.DataFrame, room: np.ndarray, seed: int) -> pd.DataFrame:
        sizes = frame[list(SIZES)].to_numpy(float) / capacity
        order = np.lexsort((frame["piece"].to_numpy(), frame["crc"].to_numpy(), frame["copy"].to_numpy(), -sizes.max(1)))
        where = np.empty(len(frame), np.int64)
        where[order] = pack(sizes[order], room.copy(), np.random.default_rng(seed).permutation(shards))
        return frame[["copy", "crc", "piece"]].assign(shard=where.astype(np.int32))

    large = F.col("share") > 1 / 64
    full = np.ones((shards, 3))
    first = checkpoint(items.filter(large).withColumn("cell", F.lit(-1)).groupBy("cell").applyInPandas(lambda frame: packed(frame, full, 0), schema))
    taken = first.join(items.filter(large), ["copy", "crc", "piece"]).groupBy("shard").agg(*[F.sum(s).alias(s) for s in SIZES]).collect()
    room = full.copy()
    for r in taken:
        room[r["shard"]] -= np.array([r[s] for s in SIZES]) / capacity
    cells = max(1, math.ceil((total["items"] or 0) / cell_items))
    free = np.maximum(room, 0)
    small = items.filter(~large).withColumn("cell", F.pmod(F.xxhash64("copy", "crc", "piece", F.lit(3)), F.lit(cells)).cast("int"))

    def fill(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        need = (frame[list(SIZES)].to_numpy(float) / capacity).sum(0)
        return packed(frame, free * (need / np.maximum(free.sum(0), 1e-12)), int(key[0]) + 1)

    placed = first.unionByName(small.groupBy("cell").applyInPandas(fill, schema))
    home = checkpoint(dealt.join(placed, ["copy", "crc", "piece"]).select("id", "size", "crc", "shard", "row"))
    parts = max(8, math.ceil((total["rows"] or 0) / shards / slot_rows))
    home = home.withColumn("part", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(parts)).cast("int"))
    behind = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = home.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n")).select("shard", "part", F.coalesce(F.sum("n").over(behind), F.lit(0)).alias("offset"))
    within = F.row_number().over(Window.partitionBy("shard", "part").orderBy("id", "row")) - 1
    return home.withColumn("within", within).join(offsets, ["shard", "part"]).select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("offset") + F.col("within")).cast("long").alias("slot"))
