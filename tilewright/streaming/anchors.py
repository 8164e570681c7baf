"""Where an observer's block of finest tiles stands and which zooms hold, with memory of what was before; as a stream and over a table.

One observation after another moves the state of its observer, so this is a fold and no window. The stream keeps the state by observer; the batch
twin reads the rows sorted by observer and time and keeps one state at a time, so no observer's rows are ever held together.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tilewright.functions import geo

#: How much wider or narrower than wanted a tile may get before the zoom changes, and the dead band of boundary zooms.
REFINE, COARSEN, LATER, EARLIER = 3.75 / 2.56, 1.75 / 2.56, 1.1, 0.9
EDGE_COS = math.cos(math.radians(geo.MAX_LATITUDE))

OBSERVED = "observer_id long, ts long, lat double, lon double, max_zoom int, target_m double"
TARGET = "observer_id long, ts long, mode string, zoom int, block_x long, block_y long, side int, imagery_zoom int, pole_locked boolean, held_lon double, changed boolean"
STATE = "mode string, asked int, zoom int, block_x long, block_y long, side int, imagery int, locked boolean, held double, lat double, lon double"


def _half_up(v: float) -> int:
    return math.floor(v + 0.5)


def _tile(lat: float, lon: float, z: int) -> tuple[int, int]:
    w = 1 << z
    x = math.floor((lon + 180) / 360 * w) % w
    rad = math.radians(max(-geo.MAX_LATITUDE, min(geo.MAX_LATITUDE, lat)))
    return x, max(0, min(w - 1, math.floor((1 - math.log(math.tan(rad) + 1 / math.cos(rad)) / math.pi) / 2 * w)))


def _shift(index: int) -> int:
    """How far an axis of the block moves for an observer at ``index`` in it, or beyond it: from behind an inner tile to index 4, from ahead of one to 3."""
    return 0 if 1 <= index <= geo.BLOCK - 2 else index - geo.BLOCK // 2 if index < 1 else index - geo.BLOCK // 2 + 1


@dataclass
class Anchor:
    mode: str = ""
    asked: int = -1
    zoom: int = -1
    block_x: int = 0
    block_y: int = 0
    side: int = 0
    imagery: int = -1
    locked: bool = False
    held: float = 0.0
    lat: float = 0.0
    lon: float = 0.0

    def observe(self, lat: float, lon: float, max_zoom: int, target_m: float) -> bool:
        """Takes the next observation; whether the block has to be planned anew."""
        lat = max(-90.0, min(90.0, lat)) if math.isfinite(lat) else 0.0
        lon = (lon + 180) % 360 - 180 if math.isfinite(lon) else 0.0
        asked = max(0, max_zoom)
        self.imagery = self._imagery(lat, target_m)
        if (asked, lat, lon) == (self.asked, self.lat, self.lon) and self.zoom >= 0:
            return False
        w = 1 << asked
        _, row = _tile(lat, lon, asked)
        if abs(lat) > geo.MAX_LATITUDE:
            mode = "north-boundary" if lat > 0 else "south-boundary"
        else:
            mode = "normal" if w < geo.BLOCK or geo.MARGIN <= row <= w - geo.MARGIN - 1 else "north-boundary" if row < geo.MARGIN else "south-boundary"
        same = (mode, asked) == (self.mode, self.asked)
        changed = self._follow(lat, lon, asked, same) if mode == "normal" else self._border(lat, lon, asked, mode, same)
        self.mode, self.asked, self.lat, self.lon = mode, asked, lat, lon
        return changed

    def _follow(self, lat: float, lon: float, z: int, same: bool) -> bool:
        """The block stays while the observer is in its inner six columns and rows; an axis that is left moves on by itself."""
        w = 1 << z
        old = (self.block_x, self.block_y) if same else None
        column, row = _tile(lat, lon, z)
        if w <= geo.BLOCK:
            new = (0, 0)
        elif old is None:
            new = (column - 3, min(max(row - 3, 0), w - geo.BLOCK))
        else:
            half = w // 2 - geo.BLOCK // 2
            east = (column - old[0] + half) % w - half  # columns from the block's first, the short way around the world
            new = (old[0] + _shift(east), min(max(old[1] + _shift(row - old[1]), 0), w - geo.BLOCK))
        self.zoom, self.side, self.locked, self.held = z, min(geo.BLOCK, w), False, lon
        self.block_x, self.block_y = new
        return new != old

    def _border(self, lat: float, lon: float, asked: int, mode: str, same: bool) -> bool:
        """Beyond or next to the map's edge the zoom drops with distance, and near the pole the longitude is held."""
        width = 2 * math.pi * geo.EARTH_RADIUS_KM * EDGE_COS / (1 << asked)
        ratio = 1 + math.radians(max(0.0, abs(lat) - geo.MAX_LATITUDE)) * geo.EARTH_RADIUS_KM / width
        drop = math.floor(math.log2(ratio))
        if same:
            old = asked - self.zoom
            if drop > old and ratio < 2 ** (old + 1) * LATER or drop < old and ratio > 2**old * EARLIER:
                drop = old
        level, enter = abs(math.cos(math.radians(lat))), EDGE_COS / geo.STRIDE
        self.locked = level < (2 * enter if self.locked else enter)
        self.held = self.held if self.locked and self.zoom >= 0 else lon
        self.zoom = max(0, asked - drop)
        w = 1 << self.zoom
        self.side = min(geo.BLOCK, w)
        self.block_x = 0 if w < geo.BLOCK else (math.floor((self.held + 180) / 360 * w) - geo.MARGIN) // geo.STRIDE * geo.STRIDE
        self.block_y = 0 if mode == "north-boundary" else w - self.side
        return True

    def _imagery(self, lat: float, target_m: float) -> int:
        """The zoom that was, brought between the first one whose tiles aren't too wide and the last one whose tiles aren't too narrow."""
        wanted = math.log2(2 * math.pi * geo.EARTH_RADIUS_KM * 1000 * max(1e-6, math.cos(math.radians(lat))) / target_m)
        least, most = math.ceil(wanted - math.log2(REFINE)), math.floor(wanted - math.log2(COARSEN))
        now = _half_up(wanted) if self.imagery < 0 else self.imagery
        return max(0, least, min(now, most))

    def target(self, observer: int, ts: int, changed: bool) -> tuple:
        return (observer, ts, self.mode, self.zoom, self.block_x, self.block_y, self.side, self.imagery, self.locked, self.held, changed)


def imagery_target(tile_px: Column, metres_a_pixel: float, height_m: Column, focal_px: Column, screen_pixels: float = 1.0) -> Column:
    """target_m of an observation: the lesser of the width that shows the source's own detail and the one whose pixels match the screen's from the observer's height."""
    own = F.greatest(F.lit(1), tile_px) * screen_pixels
    return F.least(own * metres_a_pixel, F.when(focal_px > 0, own * height_m / focal_px))


NAMES = ["observer_id", "ts", "mode", "zoom", "block_x", "block_y", "side", "imagery_zoom", "pole_locked", "held_lon", "changed"]
READ = ["observer_id", "ts", "lat", "lon", "max_zoom", "target_m"]


def anchor_stream(observations: DataFrame) -> DataFrame:
    """The targets of observers as they move (columns of TARGET); those with ``changed`` need a new plan. observations: the columns of OBSERVED, in order of ts within a batch."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        anchor = Anchor(*state.get) if state.exists else Anchor()
        rows = pd.concat(list(frames)).sort_values("ts")
        out = []
        for r in rows.itertuples(index=False):
            changed = anchor.observe(r.lat, r.lon, int(r.max_zoom), r.target_m)
            out.append(anchor.target(int(key[0]), int(r.ts), changed))
        state.update(astuple(anchor))
        yield pd.DataFrame(out, columns=NAMES)

    return observations.select(*READ).groupBy("observer_id").applyInPandasWithState(step, TARGET, STATE, "append", GroupStateTimeout.NoTimeout)


def anchor_targets(observations: DataFrame) -> DataFrame:
    """The batch twin of ``anchor_stream``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, anchor = None, Anchor()
        for frame in frames:
            out = []
            for r in frame.itertuples(index=False):
                if r.observer_id != now:
                    now, anchor = r.observer_id, Anchor()
                changed = anchor.observe(r.lat, r.lon, int(r.max_zoom), r.target_m)
                out.append(anchor.target(int(now), int(r.ts), changed))
            yield pd.DataFrame(out, columns=NAMES)

    return observations.select(*READ).repartition("observer_id").sortWithinPartitions("observer_id", "ts").mapInPandas(run, TARGET)
