"""Exact Jaccard join of shingle sets, and the components of its links.

Two documents link when ``per_cent`` * |union| <= 100 * |intersection|. Documents with equal sets are one class; classes are joined.

A set that has a link keeps p in 100 of its shingles in common with another class. So shingles are counted first: a class of which more than
(100 - p) in 100 are nobody else's has no links and goes no further. Half of all hashes are enough to see that, as a set's own ones among them are no more than all of its own.

In the metric of the symmetric difference D two sets of a and b shingles link when D <= (a + b) * (100 - p) / (100 + p). What is left is
first cut by parts of sets, as unrelated texts are all equally far from any pivot: sets of similar size are cut by hash range into more
parts than a link may have differences, so two linked sets have a whole part in common. Equal parts meet at their least holder, moved once in packed
blocks that hold a part once each, and what hangs together is a region; no link leaves its region.

A region of more than ``cell`` sets is cut by pivots. Each member belongs to the Voronoi region of its nearest pivot and, by the triangle
inequality, goes as a guest to each earlier pivot that isn't farther from it than its own by more than twice its longest link; any two linked members
so meet in the region of one of them. The parts are cut again, with other pivots, until they fit in one task. Where every member
of a part links to its pivot nothing is left to find. Where a cut doesn't part a region (its parts hold over twice its members, or one of
them most), the region is dense: each member is dealt to a cell, where it is compared with its cell and with the region's pivots, so
near copies of one text reach the region's main component at once. Then, in a region of more than ``NARROW`` cells, those who share a part are a region of their own, where they are not
all of one component yet and no other part has the same holders. In smaller regions, and where that would take more than comparing each outsider with all, the outsiders are compared with the rest
by the triangle inequality: a member goes only to the bands of distance from the first pivot that can hold a partner, and each band is joined block by block. So no group is ever
whole in one task, and no pair that could link is left out.

A class is known by 128 bits: two sums of its shingles' hashes, mixed apart.

Defined cases: null and empty texts and texts without words have no shingles, link with nothing and are their own component; with fewer
words than a shingle the whole sequence is one; repeated rows and equal texts share a class; ties between pivots go to the earlier one; very long
texts are sets like others; rows with a null id have no component; other columns are not read.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tilewright.llm.components import components
from tilewright.llm.jobs import checkpoint, giving_back
from tilewright.llm.textkit import NON_SPACE, gram_hashes, mix, slices, utf8, word_hashes, word_spans

U64 = np.uint64
SPARE = 1
CELL = 192
PIVOTS = 12
CUTS = 32
KEY_BYTES = 6
BLOCK_KEYS = 1 << 20
PARTITION_SHINGLES = 1 << 21
LINKS = 1 << 16
#: Cells up to which a dense region is compared by blocks at once; a set then moves under 20 times.
NARROW = 16


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """For each text of a slice the hashes of its shingles, each once, in order."""
    text, offsets = utf8(column, lower=True)
    starts, ends, first = word_spans(text, offsets, NON_SPACE)
    words = word_hashes(text, starts, ends)
    grams, inside = gram_hashes(words, first, size)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(grams[a : b - size + 1])
        elif b > a:
            turn = np.arange(1, b - a + 1, dtype=U64)
            yield mix(np.array([mix(words[a:b] + turn).sum(dtype=U64)], U64))
        else:
            yield np.zeros(0, U64)


def signature(hashes: np.ndarray, salt: int = 0x5851F42D4C957F2D) -> int:
    return int(mix(np.array([mix(hashes ^ U64(salt)).sum(dtype=U64) + U64(len(hashes))], U64))[0].astype(np.int64)) if len(hashes) else 0


def second_signature(hashes: np.ndarray) -> int:
    return signature(hashes, 0x2545F4914F6CDD1D)


def levels(largest: int, per_cent: int, tries: int = 1) -> list[tuple[int, int, int, int]]:
    """(least size, largest size, parts, spare parts) of each level of set sizes; with more than one try as many spare parts as parts are likely to be empty."""
    out, low = [], 1
    while low <= largest:
        high = max(low, int(low * 1.25))
        differences, spare = 2 * high * (100 - per_cent) // (100 + per_cent), SPARE
        least = -(-low * per_cent // 100)

        def empty(parts: int, least: int = least) -> float:
            expected = parts * math.exp(-least / parts)
            return expected + math.sqrt(expected)

        while tries > 1 and spare < high and empty(differences + 1 + spare) > spare:
            spare += 1
        out.append((low, high, differences + 1 + spare if differences else 0, spare))
        low = high + 1
    return out


def part_keys(hashes: np.ndarray, plan: list[tuple[int, int, int, int]], per_cent: int, tries: int = 1) -> np.ndarray:
    """A hash of each part of the set, at each level where it may have a partner.

    Of two linked sets at least 1 + spare parts agree. So empty parts are left out while there are at most ``spare`` of them: one that is not empty
    agrees as well, if that holds for either set. A set with more empty parts is cut anew by another hash, up to ``tries`` times, and so is each
    partner that has no better luck; after the last time all its parts count.
    """
    n, keys = len(hashes), []
    for number, (low, high, parts, spare) in enumerate(plan):
        if parts and high >= n and low * per_cent <= n * 100:
            cuts = np.array([(j << 64) // parts for j in range(1, parts)], U64)
            for turn in range(tries):
                cut = hashes if turn == 0 else np.sort(mix(hashes ^ mix(np.array([turn], U64))))
                bounds = np.concatenate([[0], np.searchsorted(cut, cuts), [n]])
                sums = np.concatenate([[U64(0)], np.cumsum(mix(cut + U64(1)), dtype=U64)])
                own = mix(mix((sums[bounds[1:]] - sums[bounds[:-1]]) + np.diff(bounds).astype(U64)) + np.arange(parts, dtype=U64) + U64((number << 40) + (turn << 56)))
                full = np.diff(bounds) > 0
                few = parts - full.sum() <= spare
                keys.append(own if not few and turn == tries - 1 else own[full])
                if few:
                    break
    return np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)


def _mapped(df: DataFrame, schema: str, names: list[str], make: Callable[[pa.RecordBatch], Iterator[list]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                for columns in make(batch.slice(a, b - a)):
                    yield pa.RecordBatch.from_arrays(columns, names)

    return df.mapInArrow(giving_back(run), schema)


def differences(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """|A xor B| for all pairs, through the shingles that occur in more than one set."""
    sizes_a, sizes_b = np.array([len(x) for x in a]), np.array([len(x) for x in b])
    flat = np.concatenate([*a, *b])
    owner = np.repeat(np.arange(len(a) + len(b)), np.concatenate([sizes_a, sizes_b]))
    _, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    both = np.zeros((len(a), len(b)), np.float32)
    common = np.flatnonzero(counts > 1)
    number = np.full(len(counts), -1, np.int64)
    number[common] = np.arange(len(common))
    col = number[where]
    for at in range(0, len(common), 8192):
        size = min(8192, len(common) - at)
        inside = (col >= at) & (col < at + size)
        rows, cols = owner[inside], col[inside] - at
        left, right = np.zeros((len(a), size), np.float32), np.zeros((len(b), size), np.float32)
        mine = rows < len(a)
        left[rows[mine], cols[mine]] = 1
        right[rows[~mine] - len(a), cols[~mine]] = 1
        both += left @ right.T
    return sizes_a[:, None] + sizes_b[None, :] - 2 * both.astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[dict[str, list]]:
    """The rows of each key, of batches that are sorted by the keys."""
    held: dict[str, list] | None = None
    now = None
    for batch in batches:
        rows = batch.to_pydict()
        names = list(rows)
        marks = list(zip(*[rows[k] for k in keys], strict=True))
        at = 0
        while at < len(marks):
            to = at
            while to < len(marks) and marks[to] == marks[at]:
                to += 1
            if held is not None and marks[at] != now:
                yield held
                held = None
            if held is None:
                held, now = {n: [] for n in names}, marks[at]
            for n in names:
                held[n] += rows[n][at:to]
            at = to
    if held is not None:
        yield held


def _linked(gap: np.ndarray, a: np.ndarray, b: np.ndarray, per_cent: int) -> np.ndarray:
    return gap * (100 + per_cent) <= (a[:, None] + b[None, :]) * (100 - per_cent)


def _roots(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric matrix of links the first one that it can reach: as many links as rows say all that many of them do."""
    root = np.arange(len(linked))
    while len(root):
        least = np.minimum(root, np.where(linked, root[None, :], len(root)).min(1))
        least = least[least]
        if (least == root).all():
            break
        root = least
    return root


def _pairs(ids: np.ndarray, sets: list[np.ndarray], per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of some sets, enough for their components."""
    n = np.array([len(s) for s in sets])
    root = _roots(_linked(differences(sets, sets), n, n, per_cent))
    own = np.flatnonzero(root != np.arange(len(root)))
    return ids[own], ids[root[own]]


def _within(small: DataFrame, per_cent: int) -> DataFrame:
    """(a, b): the links inside regions that fit in one task. small: (region, cls, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["region"]):
            a, b = _pairs(np.array(g["cls"], np.int64), [np.frombuffer(s, U64) for s in g["shingles"]], per_cent)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return small.select("region", "cls", "shingles").repartition("region").sortWithinPartitions("region").mapInArrow(giving_back(run), "a long, b long")


def _sized(members: DataFrame) -> DataFrame:
    return members.join(members.groupBy("region").agg(F.count(F.lit(1)).alias("m")), "region")


def _first(members: DataFrame, turn: int, most: int) -> DataFrame:
    """Some members of each region, by a hash that changes with the turn, numbered from 0."""
    order = Window.partitionBy("region").orderBy(F.xxhash64("cls", F.lit(turn)), "cls")
    return members.withColumn("at", F.row_number().over(order) - 1).filter(F.col("at") < most)


def _cut(large: DataFrame, sets: DataFrame, per_cent: int, cell: int, turn: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(links to pivots, members of the parts, members of dense regions) of regions cut by pivots. large: (region, cls, m)."""
    chunks = F.ceil(F.col("m") / (2 * cell))
    pivots = _first(large, turn, CUTS).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)))
    dealt = large.withColumn("at", F.lit(-1)).withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(turn), F.lit("chunk")), chunks))
    fields = ["region", "chunk", "at", "cls", "shingles"]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["region", "chunk"]):
            at, ids = np.array(g["at"]), np.array(g["cls"], np.int64)
            sets = [np.frombuffer(s, U64) for s in g["shingles"]]
            lead, rest = np.argsort(np.where(at < 0, len(at) + CUTS, at), kind="stable")[: (at >= 0).sum()], np.flatnonzero(at < 0)
            if not len(rest):
                continue
            # of pivots within twice a link of each other the first one is enough
            right = [sets[k] for k in lead]
            m = np.array([len(s) for s in right])
            apart = differences(right, right) > 2 * (np.maximum(m[:, None], m[None, :]) * (100 - per_cent) // per_cent)
            kept: list[int] = []
            for k in range(len(lead)):
                if apart[k, kept].all():
                    kept.append(k)
            left, right, lead, m = [sets[k] for k in rest], [right[k] for k in kept], lead[kept], m[kept]
            n = np.array([len(s) for s in left])
            gap = differences(left, right)
            home = gap.argmin(1)
            linked = _linked(gap, n, m, per_cent)
            # a partner is at most so far away, and no farther from its own pivot than from this one
            reach = n * (100 - per_cent) // per_cent
            guest = (gap <= (gap[np.arange(len(rest)), home] + 2 * reach)[:, None]) & (np.arange(len(lead)) < home[:, None])
            guest[np.arange(len(rest)), home] = True
            x, y = np.nonzero(guest)
            parts = pa.StructArray.from_arrays([pa.array(y.astype(np.int32)), pa.array(linked[x, y])], ["at", "linked"])
            bounds = np.concatenate([[0], np.cumsum(guest.sum(1))]).astype(np.int32)
            u, v = np.nonzero(linked)
            edges = np.concatenate([[0], np.cumsum(linked.sum(1))]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(rest), g["region"][0], np.int64)), pa.array(ids[rest]), pa.ListArray.from_arrays(pa.array(bounds), parts), pa.ListArray.from_arrays(pa.array(edges), pa.array(ids[lead[v]]))],
                ["region", "cls", "parts", "links"],
            )

    narrow = fields[:-1]
    met = dealt.select(*narrow).unionByName(pivots.select(*narrow)).join(sets, "cls").select(*fields).repartition("region", "chunk").sortWithinPartitions("region", "chunk")
    placed = checkpoint(met.mapInArrow(giving_back(nearest), "region long, cls long, parts array<struct<at:int,linked:boolean>>, links array<long>"))
    links = placed.select(F.col("cls").alias("a"), F.explode("links").alias("b")).filter("a <> b")
    flat = placed.select("region", "cls", F.explode("parts").alias("part")).select("region", "cls", "part.at", "part.linked")
    left = flat.groupBy("region", "at").agg(F.count(F.lit(1)).alias("held"), F.bool_and("linked").alias("done")).filter("NOT done")
    sums = left.groupBy("region").agg(F.sum("held").alias("total"), F.max("held").alias("most")).join(large.select("region", "m").distinct(), "region")
    sums = checkpoint(sums.select("region", ((F.col("total") > 2 * F.col("m")) | (F.col("most") > 0.75 * F.col("m"))).alias("dense")))
    open_ = flat.join(left.select("region", "at"), ["region", "at"], "left_semi").join(sums.filter("NOT dense"), "region", "left_semi")
    parts = open_.select(F.xxhash64("region", "at", F.lit(turn)).alias("region"), "cls")
    return links, parts, large.join(sums.filter("dense"), "region", "left_semi").select("region", "cls")


def _dense(members: DataFrame, sets: DataFrame, per_cent: int, cell: int, keys_of: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(a, b): links inside regions that pivots don't part, enough of them for the components."""
    members = checkpoint(_sized(members))
    # first pass: each member with its cell, and with the pivots of its region
    cells = F.ceil(F.col("m") / cell)
    member = members.withColumn("cell", F.pmod(F.xxhash64("cls"), cells)).withColumn("pivot", F.lit(-1))
    spread = _first(members, 7, PIVOTS).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), cells - 1))).withColumn("pivot", F.col("at"))

    def in_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, ["region", "cell"]):
            every, pivot = np.array(g["cls"], np.int64), np.array(g["pivot"])
            ids, once = np.unique(every, return_index=True)  # a pivot may be a member of its own cell
            held = [np.frombuffer(g["shingles"][k], U64) for k in once]
            n = np.array([len(s) for s in held])
            gap = differences(held, held)
            root = _roots(_linked(gap, n, n, per_cent))
            x = np.flatnonzero(root != np.arange(len(root)))
            y = root[x]
            centre = int(np.searchsorted(ids, every[pivot == 0][0]))
            a, b, sizes = np.concatenate([ids[x], ids]), np.concatenate([ids[y], ids]), np.concatenate([np.full(len(x), -1), n])
            far = np.concatenate([np.full(len(x), -1), gap[:, centre]])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), g["region"][0], np.int64)), pa.array(a), pa.array(b), pa.array(far.astype(np.int64)), pa.array(sizes.astype(np.int64))], ["region", "a", "b", "gap", "n"])

    fields = ["region", "cell", "cls", "pivot"]
    dealt = member.select(*fields).unionByName(spread.select(*fields)).join(sets, "cls").select(*fields, "shingles").repartition("region", "cell").sortWithinPartitions("region", "cell")
    first = checkpoint(dealt.mapInArrow(giving_back(in_cells), "region long, a long, b long, gap long, n long"))
    links = first.filter("a <> b").select("a", "b")
    roots = components(links)
    gaps = first.filter("a = b").groupBy("region", F.col("a").alias("cls")).agg(F.min("gap").alias("gap"), F.min("n").alias("n"))
    placed = checkpoint(members.join(roots, F.col("cls") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cls")).drop("node").join(gaps, ["region", "cls"]))

    main = placed.groupBy("region", "root").agg(F.count(F.lit(1)).alias("held")).groupBy("region").agg(F.max_by("root", F.struct("held", "root")).alias("main"), F.sum("held").alias("all"), F.max("held").alias("most"))
    narrow, wide = F.col("m") <= NARROW * cell, placed.filter(F.col("m") > NARROW * cell)
    bands = placed.filter(narrow).join(main.select("region", "main"), "region")
    if wide.isEmpty():
        return links.unionByName(_banded(bands, sets, per_cent, cell))
    # second pass, of wide regions either by the parts that members of two components share: all who have such a part are a region of their own
    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [np.unique(keys_of(np.frombuffer(s, U64))) for s in batch.column("shingles").to_pylist()]
            if keys:
                bounds = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(keys))), batch.column("cls")], ["keys", "cls"])

    # one row for a set, as a row for a part would take five times the room
    parts = checkpoint(sets.join(wide.select("cls").distinct(), "cls", "left_semi").select("cls", "shingles").mapInArrow(giving_back(keyed), "keys array<long>, cls long"))
    held = parts.select(F.explode("keys").alias("key"), "cls").join(wide.select("region", "cls", "root"), "cls")
    open_ = held.groupBy("region", "key").agg(F.count(F.lit(1)).alias("g"), F.min("root").alias("x"), F.max("root").alias("y"), F.bit_xor(F.xxhash64("cls")).alias("who"), F.bit_xor(F.xxhash64("cls", F.lit(1))).alias("also")).filter("x < y")
    open_ = checkpoint(open_.groupBy("region", "g", "who", "also").agg(F.min("key").alias("key")))
    # or, where that takes more, by the bands of distance from the first pivot
    outside = F.col("all") - F.col("most")
    by_parts = open_.groupBy("region").agg(F.sum("g").alias("rows"), F.max("g").alias("largest"))
    plans = main.join(by_parts, "region").select("region", "main", ((F.col("rows") <= F.col("all") * F.ceil(outside / (4 * cell)) + outside * F.ceil(F.col("all") / cell)) & (F.col("largest") <= F.col("all") / 2)).alias("parts"))
    plans = checkpoint(plans)
    by = held.join(open_.join(plans.filter("parts"), "region", "left_semi").select("region", "key"), ["region", "key"], "left_semi").select(F.xxhash64("region", "key").alias("region"), "cls")
    by = checkpoint(by)
    # a set goes to as many regions as have one of its parts; in so many turns that none of them moves much more than every set twice
    turns = max(1, -(-by.count() // (2 * wide.count())))
    for turn in range(turns):
        some = by.filter(F.pmod(F.xxhash64("region", F.lit("turn")), F.lit(turns)) == turn)
        links = links.unionByName(checkpoint(region_links(some, sets, per_cent, keys_of, cell)))
    rest = bands.unionByName(wide.join(plans.filter("NOT parts").select("region", "main"), "region"))
    return links if rest.isEmpty() else links.unionByName(_banded(rest, sets, per_cent, cell))


def _banded(placed: DataFrame, sets: DataFrame, per_cent: int, cell: int) -> DataFrame:
    """(a, b): links of who isn't in the main component of a region. placed: (region, cls, root, main, gap, n)."""
    # one step of a band is as wide as a link of the region's largest set can be
    width = placed.groupBy("region").agg(F.greatest(F.lit(1), F.floor(F.max("n") * 2 * (100 - per_cent) / (100 + per_cent))).alias("width"))
    banded = placed.join(width, "region").withColumn("band", F.floor(F.col("gap") / F.col("width")))
    outside = banded.filter("root <> main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    # a band's members in blocks, its guests in chunks; each block meets each chunk, and bands without guests meet nobody
    count = lambda df, name, size: df.groupBy("region", "band").agg(F.ceil(F.count(F.lit(1)) / size).alias(name))
    sizes = checkpoint(count(banded, "blocks", 2 * cell).join(count(outside, "chunks", 2 * cell), ["region", "band"]))
    up_to = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    home = banded.join(sizes, ["region", "band"]).withColumn("block", F.pmod(F.xxhash64("cls", F.lit(11)), F.col("blocks"))).withColumn("chunk", up_to("chunks"))
    sent = outside.join(sizes, ["region", "band"]).withColumn("chunk", F.pmod(F.xxhash64("cls", F.lit(13)), F.col("chunks"))).withColumn("block", up_to("blocks"))
    keys = ["region", "band", "block", "chunk"]
    met = home.select(*keys, "cls", F.lit(False).alias("guest")).unionByName(sent.select(*keys, "cls", F.lit(True).alias("guest"))).join(sets, "cls").select(*keys, "cls", "shingles", "guest")

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for g in _groups(batches, keys):
            ids, guest = np.array(g["cls"], np.int64), np.array(g["guest"])
            if guest.any() and not guest.all():
                held = [np.frombuffer(s, U64) for s in g["shingles"]]
                left, right = [held[k] for k in np.flatnonzero(guest)], [held[k] for k in np.flatnonzero(~guest)]
                across_ = _linked(differences(left, right), np.array([len(s) for s in left]), np.array([len(s) for s in right]), per_cent)
                every, m = np.concatenate([ids[guest], ids[~guest]]), len(left)
                both = np.zeros((len(every), len(every)), bool)
                both[:m, m:], both[m:, :m] = across_, across_.T
                root = _roots(both)
                x = np.flatnonzero(root != np.arange(len(root)))
                yield pa.RecordBatch.from_arrays([pa.array(every[x]), pa.array(every[root[x]])], ["a", "b"])

    return checkpoint(met.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(giving_back(across), "a long, b long")).filter("a <> b")


def region_links(members: DataFrame, sets: DataFrame, per_cent: int, keys_of: Callable[[np.ndarray], np.ndarray], cell: int = CELL, placed: DataFrame | None = None) -> DataFrame:
    """(a, b): links of the members (region long, cls long) of regions, enough of them for the components. sets: (cls long, shingles binary); keys_of: the keys of a set's parts.

    placed: members with their sets (region, cls, shingles), where there is one table of both, so that small regions move once. Behind the first round only the sets of
    large regions are moved.
    """
    links, dense, turn = [], [], 0
    while True:
        counted = checkpoint(_sized(members))
        large = counted.filter(F.col("m") > cell)
        # of large regions there are fewer than a cell's share of the members, so their names may go to every task
        named = F.broadcast(large.select("region").distinct())
        small = counted.filter(F.col("m") <= cell).join(sets, "cls") if placed is None else placed.join(named, "region", "left_anti")
        links.append(checkpoint(_within(small, per_cent)))
        if large.isEmpty():
            break
        if turn == 0:
            sets = checkpoint(sets.join(large.select("cls").distinct(), "cls", "left_semi") if placed is None else placed.join(named, "region", "left_semi").select("cls", "shingles"))
            placed = None
        to_pivots, parts, left = _cut(large, sets, per_cent, cell, turn)
        links.append(to_pivots)
        dense.append(left)
        members, turn = parts, turn + 1
    if dense:
        every = checkpoint(functools.reduce(DataFrame.unionByName, dense))
        if not every.isEmpty():
            links.append(_dense(every, sets, per_cent, cell, keys_of))
    return functools.reduce(DataFrame.unionByName, links)


def _least(keys: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(each key once and in order, its least owner, and links a, b of its other owners to that one, each link once)."""
    order = np.lexsort((owners, keys))
    keys, owners = keys[order], owners[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    least = owners[first]
    lead = np.repeat(least, np.diff(np.append(first, len(keys))))
    other = owners != lead
    a, b = owners[other], lead[other]
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    return keys[first], least, a[once], b[once]


def _packed(keys: np.ndarray, owners: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """Keys by their low bytes, and owners by their places in a list of those that there are."""
    there, at = np.unique(owners, return_inverse=True)
    return keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :KEY_BYTES].tobytes(), at.astype("<u2" if len(there) <= 1 << 16 else "<u4").tobytes(), there.astype("<i8").tobytes()


def _unpacked(keys: bytes, at: bytes, there: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys) // KEY_BYTES
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :KEY_BYTES] = np.frombuffer(keys, np.uint8).reshape(-1, KEY_BYTES)
    return wide.view("<u8")[:, 0], np.frombuffer(there, "<i8")[np.frombuffer(at, "<u2" if len(at) == 2 * n else "<u4")]


def _asked(hashes: np.ndarray) -> np.ndarray:
    """Those shingles of a set that are asked for: half of all hashes, the same ones in every set."""
    return hashes[(hashes & U64(1)) == 0]


def _partitions(spark: SparkSession, shingles: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-shingles // PARTITION_SHINGLES))


def _shared(texts: DataFrame, named: Callable[[pa.Array], Iterator[tuple[int, np.ndarray]]], shingles: int) -> DataFrame:
    """(cls, shared long): of how many of its asked shingles another class has one too; a class without such has no row. named: class and shingles of each text of a slice.

    Shingles move once, as four bytes beside their partition, in the order of their owners. Two of them that agree there, and classes that a partition counts again
    behind its first ``BLOCK_KEYS`` shingles, make a count larger: that lets a class pass which has no link, and never keeps one back.
    """
    partitions = _partitions(texts.sparkSession, shingles)

    def block(held: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        keys, names, own = np.concatenate(held), np.array(owners, np.int64), np.repeat(np.arange(len(owners)), [len(k) for k in held])
        part = (((keys >> U64(32)) * U64(partitions)) >> U64(32)).astype("u2" if partitions <= 1 << 16 else "u4")
        order = np.argsort(part, kind="stable")
        low, own = (keys >> U64(1)).astype("<u4")[order], own[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=partitions))])
        rows = []
        for p, (x, y) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            if y > x:
                there, runs = np.unique(own[x:y], return_counts=True)
                rows.append((p, low[x:y].tobytes(), runs.astype("<u4").tobytes(), names[there].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "keys", "runs", "there"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, count = [], [], 0
        for batch in batches:
            text = batch.column("text")
            for a, b in slices(text):
                for cls, hashes in named(text.slice(a, b - a)):
                    keys = _asked(hashes)
                    if len(keys):
                        held.append(keys)
                        owners.append(cls)
                        count += len(keys)
                if count >= BLOCK_KEYS:
                    yield block(held, owners)
                    held, owners, count = [], [], 0
        if count:
            yield block(held, owners)

    def answers(owners: np.ndarray) -> pa.RecordBatch:
        names, counts = np.unique(owners, return_counts=True)
        part = (mix(names.view(U64)) % U64(partitions)).astype("i4")
        order = np.argsort(part, kind="stable")
        to, first = np.unique(part[order], return_index=True)
        cut = lambda values: [v.tobytes() for v in np.split(values[order], first[1:])]
        return pa.RecordBatch.from_arrays([pa.array(to), pa.array(cut(names), pa.binary()), pa.array(cut(counts.astype("<u4")), pa.binary())], ["part", "there", "counts"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # of the shingles before: each once, its first owner and whether another one has been seen
        known, first, many = np.zeros(0, "<u4"), np.zeros(0, np.int64), np.zeros(0, bool)
        fresh: list[tuple[np.ndarray, np.ndarray]] = []
        count = 0

        def settle() -> Iterator[pa.RecordBatch]:
            nonlocal known, first, many
            old = len(known)
            keys, owners = np.concatenate([known, *[k for k, _ in fresh]]), np.concatenate([first, *[o for _, o in fresh]])
            order = np.argsort(keys, kind="stable")
            keys, owners = keys[order], owners[order]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(keys))))
            lead = owners[starts]
            now = np.zeros(len(starts), bool)
            now[group[owners != lead[group]]] = True
            was = np.zeros(len(starts), bool)
            before = order < old
            was[group[before]] = many[order[before]]
            # an owner from before is counted when the second one comes
            counted = (now | was)[group] & ~(before & was[group])
            g, o = group[counted], owners[counted]
            at = np.lexsort((o, g))
            g, o = g[at], o[at]
            once = np.concatenate([[True], (g[1:] != g[:-1]) | (o[1:] != o[:-1])])[: len(g)]
            known, first, many = keys[starts], lead, now | was
            if len(g):
                yield answers(o[once])

        for batch in batches:
            for keys, runs, there in zip(*[batch.column(c) for c in ("keys", "runs", "there")], strict=True):
                keys = np.frombuffer(keys.as_py(), "<u4")
                fresh.append((keys, np.repeat(np.frombuffer(there.as_py(), np.int64), np.frombuffer(runs.as_py(), "<u4"))))
                count += len(keys)
                if count >= 4 * BLOCK_KEYS:
                    yield from settle()
                    fresh, count = [], 0
        if fresh:
            yield from settle()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sums, fresh, count = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def total() -> tuple[np.ndarray, np.ndarray]:
            every, at = np.unique(np.concatenate([names, *[n for n, _ in fresh]]), return_inverse=True)
            return every, np.bincount(at, np.concatenate([sums, *[c for _, c in fresh]]), len(every)).astype(np.int64)

        for batch in batches:
            for there, counts in zip(batch.column("there"), batch.column("counts"), strict=True):
                fresh.append((np.frombuffer(there.as_py(), np.int64), np.frombuffer(counts.as_py(), "<u4").astype(np.int64)))
                count += len(fresh[-1][0])
                if count >= BLOCK_KEYS:
                    names, sums = total()
                    fresh, count = [], 0
        names, sums = total()
        for at in range(0, len(names), LINKS):
            yield pa.RecordBatch.from_arrays([pa.array(names[at : at + LINKS]), pa.array(sums[at : at + LINKS])], ["cls", "shared"])

    moved = texts.select("text").mapInArrow(giving_back(pack), "part int, keys binary, runs binary, there binary").repartitionById(partitions, F.col("part"))
    back = moved.mapInArrow(giving_back(meet), "part int, there binary, counts binary").repartitionById(partitions, F.col("part"))
    return back.mapInArrow(giving_back(add), "cls long, shared long")


def _touching(sets: DataFrame, keys_of: Callable[[np.ndarray], np.ndarray], shingles: int) -> DataFrame:
    """(a, b): enough links for the components of the classes that share a key. sets: (cls, shingles).

    Keys move once, in blocks: a task joins the owners of a key that it has itself, so a key leaves it once per ``BLOCK_KEYS`` keys however many own it, and what
    moves of a key is six bytes and its owner's place in the block. Its top bits choose the partition, of which there are as many as keep one small. Two keys that
    agree in what is left make a region larger and no link, as links are verified in their region.
    """
    partitions = _partitions(sets.sparkSession, shingles)

    def block(held: list[np.ndarray], owners: list[int]) -> pa.RecordBatch:
        keys, least, a, b = _least(np.concatenate(held).view(U64), np.repeat(np.array(owners, np.int64), [len(k) for k in held]))
        part = ((keys >> U64(32)) * U64(partitions)) >> U64(32)
        bounds = np.searchsorted(part, np.arange(partitions + 1, dtype=U64))
        rows = [(p, *_packed(keys[x:y], least[x:y])) for p, (x, y) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)) if y > x]
        turn = int(keys[0] % U64(partitions))
        for k, at in enumerate(range(0, len(a), LINKS)):
            rows.append(((turn + k) % partitions, b"", a[at : at + LINKS].tobytes(), b[at : at + LINKS].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["part", "keys", "at", "there"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, owners, count = [], [], 0
        for batch in batches:
            for cls, shingles in zip(batch.column("cls"), batch.column("shingles"), strict=True):
                keys = keys_of(np.frombuffer(shingles.as_py(), U64))
                if len(keys):
                    held.append(keys)
                    owners.append(cls.as_py())
                    count += len(keys)
                if count >= BLOCK_KEYS:
                    yield block(held, owners)
                    held, owners, count = [], [], 0
        if count:
            yield block(held, owners)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, fresh, count = (np.zeros(0, U64), np.zeros(0, np.int64)), [], 0

        def links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            for keys, at, there in zip(*[batch.column(c) for c in ("keys", "at", "there")], strict=True):
                keys, at, there = keys.as_py(), at.as_py(), there.as_py()
                if keys:
                    fresh.append(_unpacked(keys, at, there))
                    count += len(fresh[-1][0])
                else:
                    yield links(np.frombuffer(at, np.int64), np.frombuffer(there, np.int64))
                if count >= BLOCK_KEYS:
                    *known, a, b = _least(*[np.concatenate(c) for c in zip(known, *fresh, strict=True)])
                    fresh, count = [], 0
                    yield links(a, b)
        if fresh:
            yield links(*_least(*[np.concatenate(c) for c in zip(known, *fresh, strict=True)])[2:])

    moved = sets.select("cls", "shingles").mapInArrow(giving_back(pack), "part int, keys binary, at binary, there binary").repartitionById(partitions, F.col("part"))
    return moved.mapInArrow(giving_back(meet), "a long, b long")


def link_components(docs: DataFrame, size: int = 3, per_cent: int = 90, id_col: str = "doc_id", text_col: str = "text", tries: int = 1, cell: int = CELL) -> DataFrame:
    """(id, n_shingles long, component_id): the least id that links lead to, the document's own included. Thresholds under 90 need several ``tries``, or empty parts join regions."""
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(narrow.dtypes)["id"]

    def sized(batch: pa.RecordBatch) -> Iterator[list]:
        sets = list(shingle_sets(batch.column("text"), size))
        yield [batch.column("id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([signature(s) for s in sets], pa.int64()), pa.array([second_signature(s) for s in sets], pa.int64()), pa.array([len(_asked(s)) for s in sets], pa.int64())]

    own = checkpoint(_mapped(narrow, f"id {kind}, n long, cls long, also long, asked long", ["id", "n", "cls", "also", "asked"], sized))
    there = own.filter("id IS NOT NULL AND n > 0")
    classes = checkpoint(there.groupBy("cls", "also").agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("asked").alias("asked")))
    # two classes of one number are expected once in 2 ** 64 pairs; all but one of them get another
    shared = classes.groupBy("cls").agg(F.min("also").alias("least"), F.max("also").alias("most")).filter("least < most")
    renamed = {(r["cls"], r["also"]): r["new"] for r in classes.join(shared, "cls").filter("also > least").select("cls", "also", F.xxhash64("cls", "also").alias("new")).collect()}
    twice = {c for c, _ in renamed}

    def name(s: np.ndarray) -> int:
        first = signature(s)
        return renamed.get((first, second_signature(s)), first) if first in twice else first

    if renamed:
        pairs = there.sparkSession.createDataFrame([(*k, v) for k, v in renamed.items()], "cls long, also long, new long")
        there, classes = (df.join(F.broadcast(pairs), ["cls", "also"], "left").withColumn("cls", F.coalesce("new", "cls")).drop("new") for df in (there, classes))
    there, classes = there.drop("also", "asked"), classes.drop("also")
    plan = levels(classes.agg(F.max("n")).first()[0] or 0, per_cent, tries)

    # classes with as much in common with others as a link takes
    shingles = own.agg(F.sum("n")).first()[0] or 0
    shared = _shared(narrow.filter("id IS NOT NULL"), lambda t: ((name(s), s) for s in shingle_sets(t, size)), shingles)
    able = F.col("asked") - F.coalesce("shared", F.lit(0)) <= F.floor(F.col("n") * (100 - per_cent) / 100)
    likely = checkpoint(classes.join(shared, "cls", "left").filter(able).select(F.col("rep").alias("id"), "cls"))

    def whole(batch: pa.RecordBatch) -> Iterator[list]:
        sets = list(shingle_sets(batch.column("text"), size))
        own = pa.array([name(s) == c for s, c in zip(sets, batch.column("cls").to_pylist(), strict=True)], pa.bool_())  # rows of one id may hold other texts
        yield [batch.column("cls").filter(own), pa.array([s.tobytes() for s in sets], pa.binary()).filter(own)]

    sets = checkpoint(_mapped(narrow.join(likely, "id").select("cls", "text"), "cls long, shingles binary", ["cls", "shingles"], whole))
    if sets.count() > sets.select("cls").distinct().count():  # repeated rows; without them no set has to move for this
        sets = checkpoint(sets.dropDuplicates(["cls"]))

    # regions: classes that hang together by equal parts
    keys_of = lambda s: part_keys(s, plan, per_cent, tries)
    touching = _touching(sets, keys_of, (sets.agg(F.sum(F.octet_length("shingles"))).first()[0] or 0) // 8)
    regions = components(touching).select(F.col("node").alias("cls"), F.col("root").alias("region"))
    members = checkpoint(sets.join(regions, "cls").select("region", "cls", "shingles"))
    sets = members.select("cls", "shingles")
    roots = components(region_links(members.select("region", "cls"), sets, per_cent, keys_of, cell, members))
    joined = classes.join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    named = joined.join(joined.groupBy("root").agg(F.min("rep").alias("component_id")), "root").select("cls", "component_id")
    alone = own.filter("id IS NULL OR n = 0").select("id", "n", F.col("id").alias("component_id"))
    out = there.join(named, "cls").select("id", "n", "component_id").unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
