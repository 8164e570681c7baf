"""Moving objects: state from messages, positions between points, and where they are."""

from __future__ import annotations

import functools
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tilewright.functions import geo

KNOT, FOOT_PER_MINUTE, GRAVITY = 0.514444, 0.00508, 9.80665


def latest_track_state(ops: DataFrame, session: str = "session", track: str = "track") -> DataFrame:
    """The tracks that a session holds after its messages. ops: (session, seq, type, track, ...), type snapshot, upsert or remove.

    A snapshot wipes what was there; within a message removals come first; the last operation on a track holds.
    """
    wiped = ops.filter("type = 'snapshot'").groupBy(session).agg(F.max("seq").alias("__wiped"))
    held = ops.join(wiped, session, "left").filter(F.col("__wiped").isNull() | (F.col("seq") >= F.col("__wiped"))).drop("__wiped")
    turn = F.row_number().over(Window.partitionBy(session, track).orderBy(F.col("seq").desc(), F.when(F.col("type") == "remove", 1).otherwise(0)))
    return held.withColumn("__turn", turn).filter("__turn = 1 AND type <> 'remove'").drop("__turn")


def interpolate_tracks(points: DataFrame, times: DataFrame, track: str = "track") -> DataFrame:
    """Place at each asked offset: held before the first and after the last point, linear in between, longitude and course along the shorter arc.

    points: (track, offset_ms, lat, lon, altitude, course); times: (track, at_ms). Points and times of a track are merged by time in one
    window, so no pair of them is formed.
    """
    value = F.struct("offset_ms", "lat", "lon", "altitude", "course")
    both = points.select(track, F.col("offset_ms").cast("double").alias("t"), value.alias("p")).unionByName(times.select(track, F.col("at_ms").cast("double").alias("t"), F.lit(None).cast(points.select(value.alias("p")).schema["p"].dataType).alias("p")))
    back = Window.partitionBy(track).orderBy("t").rangeBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(track).orderBy("t").rangeBetween(0, Window.unboundedFollowing)
    at = both.withColumns({"a": F.last("p", ignorenulls=True).over(back), "b": F.first("p", ignorenulls=True).over(ahead)}).filter("p IS NULL")
    at = at.withColumns({"a": F.coalesce("a", "b"), "b": F.coalesce("b", "a")}).filter("a IS NOT NULL")
    gap = F.col("b.offset_ms") - F.col("a.offset_ms")
    share = F.when(gap > 0, geo.clamp((F.col("t") - F.col("a.offset_ms")) / gap, 0.0, 1.0)).otherwise(0.0)
    arc = lambda c: F.col(f"a.{c}") + geo.short_arc(F.col(f"a.{c}"), F.col(f"b.{c}")) * share
    altitude = F.when(F.col("a.altitude").isNotNull() & F.col("b.altitude").isNotNull(), F.col("a.altitude") + (F.col("b.altitude") - F.col("a.altitude")) * share).otherwise(F.coalesce("a.altitude", "b.altitude"))
    rate = F.when(gap > 0, geo.short_arc(F.col("a.course"), F.col("b.course")) / (gap / 1000)).otherwise(0.0)
    return at.select(track, F.col("t").alias("at_ms"), (F.col("a.lat") + (F.col("b.lat") - F.col("a.lat")) * share).alias("lat"), geo.wrap_longitude(arc("lon")).alias("lon"), altitude.alias("altitude"), F.pmod(arc("course"), F.lit(360.0)).alias("course"), rate.alias("turn_rate"))


def to_earth_fixed(df: DataFrame, lat: str, lon: str, height_km: str, multiplier: float = 1.0) -> DataFrame:
    """ex, ey, ez in Earth radii, y to the north pole, z against the east; the height counts from 0 and is multiplied along the normal."""
    e2 = 1 - (geo.WGS84_B_KM / geo.WGS84_A_KM) ** 2
    a, o = F.radians(lat), F.radians(lon)
    n = geo.WGS84_A_KM / F.sqrt(1 - e2 * F.sin(a) * F.sin(a))
    up = F.greatest(F.lit(0.0), F.col(height_km)) * multiplier
    r = geo.EARTH_RADIUS_KM
    return df.withColumns({"ex": (n + up) * F.cos(a) * F.cos(o) / r, "ey": (n * (1 - e2) + up) * F.sin(a) / r, "ez": -(n + up) * F.cos(a) * F.sin(o) / r})


def describe_tracks(samples: DataFrame) -> DataFrame:
    """kind, label, pitch and roll. samples: (category, on_ground, altitude, speed_kt, heading, vertical_fpm, turn_rate)."""
    level = F.greatest(F.lit(0).cast("long"), geo.half_up(F.col("altitude") / 100))
    vertical = F.when(F.col("on_ground"), "GND").when(F.col("altitude").isNull(), "ALT---").otherwise(F.concat(F.lit("FL"), F.when(level < 1000, F.lpad(level.cast("string"), 3, "0")).otherwise(level.cast("string"))))
    heading = geo.half_up(F.pmod(F.col("heading"), F.lit(360.0)))
    label = F.concat_ws(" ", vertical, F.concat(F.greatest(F.lit(0).cast("long"), geo.half_up("speed_kt")).cast("string"), F.lit("KT")), F.concat(F.lpad(heading.cast("string"), 3, "0"), F.lit("°")))
    speed = F.col("speed_kt") * KNOT
    ground = F.coalesce("on_ground", F.lit(False))
    pitch = F.when(ground | (speed <= 0), 0.0).otherwise(F.degrees(F.atan2(F.col("vertical_fpm") * FOOT_PER_MINUTE, speed)))
    roll = F.when(ground, 0.0).otherwise(F.degrees(F.atan(speed * F.radians("turn_rate") / GRAVITY)))
    return samples.withColumns({"kind": F.when(F.col("category").isin("C1", "C2"), "vehicle").otherwise("aircraft"), "label": label, "pitch": pitch, "roll": roll})


def _unit(lat: str, lon: str, names: list[str]) -> dict[str, Column]:
    """The unit vector of a place; NaN for null, so that the join asks none of them for nulls."""
    up, turn = (F.radians(F.coalesce(F.col(c).cast("double"), F.lit(float("nan")))) for c in (lat, lon))
    return dict(zip(names, [F.cos(up) * F.cos(turn), F.cos(up) * F.sin(turn), F.sin(up)], strict=True))


def tracks_within_radius(tracks: DataFrame, centres: DataFrame, nautical_miles: float, cell_degrees: float = 5.0) -> DataFrame:
    """Pairs (centre, track) within a distance. Both sides meet in cells of a degree grid: a centre emits the cells that its circle can reach.

    What a pair takes is the chord between unit vectors, made once for each side, and the arc sine of those that are near enough.
    """
    angle = nautical_miles * geo.NAUTICAL_MILE_KM / geo.EARTH_RADIUS_KM
    reach = math.degrees(angle)
    columns = int(360 / cell_degrees)
    low = F.floor((F.col("c_lat") - reach + 90) / cell_degrees)
    high = F.floor((F.col("c_lat") + reach + 90) / cell_degrees)
    rows = centres.withColumn("row", F.explode(F.sequence(low, high)))
    polar = F.abs(F.col("c_lat")) + reach >= 89
    spread = F.when(polar, F.lit(180.0)).otherwise(F.least(F.lit(180.0), F.degrees(F.asin(F.least(F.lit(1.0), F.sin(F.lit(angle)) / F.cos(F.radians("c_lat")))))))
    first, last = F.floor((F.col("c_lon") - spread + 180) / cell_degrees), F.floor((F.col("c_lon") + spread + 180) / cell_degrees)
    cells = rows.withColumn("column", F.explode(F.array_distinct(F.transform(F.sequence(first, last), lambda c: F.pmod(c, F.lit(columns).cast("long"))))))
    at = tracks.withColumns({"row": F.floor((F.col("lat") + 90) / cell_degrees), "column": F.pmod(F.floor((geo.wrap_longitude("lon") + 180) / cell_degrees), F.lit(columns).cast("long"))})
    ours, theirs = ["__x", "__y", "__z"], ["__c_x", "__c_y", "__c_z"]
    met = at.withColumns(_unit("lat", "lon", ours)).join(cells.withColumns(_unit("c_lat", "c_lon", theirs)).hint("merge"), ["row", "column"])
    chord = functools.reduce(operator.add, [(F.col(a) - F.col(b)) * (F.col(a) - F.col(b)) for a, b in zip(ours, theirs, strict=True)])
    near = met.filter(chord <= (2 * math.sin(min(angle, math.pi) / 2)) ** 2 * (1 + 1e-9))
    return near.withColumn("angle", 2 * F.asin(F.least(F.lit(1.0), F.sqrt(chord) * 0.5))).filter(F.col("angle") <= angle).drop("row", "column", *ours, *theirs)


def cap_tracks(tracks: DataFrame, first: str, n: int = 800) -> DataFrame:
    """The first n in order of arrival."""
    return tracks.orderBy(first).limit(n)


def priority_dedup(positions: DataFrame, priority: list[str], enabled: list[str]) -> DataFrame:
    """One row for each catalogue id among the enabled groups that have a position: the group of highest priority, then the first place."""
    order = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("group"))
    w = Window.partitionBy("catalog_id").orderBy(order, "pos")
    return positions.filter(F.col("group").isin(*enabled) & F.col("ok")).withColumn("__turn", F.row_number().over(w)).filter("__turn = 1").drop("__turn")


def merge_named(expanded: DataFrame) -> DataFrame:
    """merge_catalogues of rows that all have an id."""
    return expanded.groupBy("group", "id").agg(F.min("pos").alias("pos"), F.max_by("value", "pos").alias("value"), F.min("fetched_at").alias("fetched_at"))


def merge_catalogues(expanded: DataFrame) -> DataFrame:
    """One row for each (group, id): the last value, the first place, the least fetch time; rows without an id all stay."""
    return merge_named(expanded.filter("id IS NOT NULL")).unionByName(expanded.filter("id IS NULL").select("group", "id", "pos", "value", "fetched_at"))


def expand_groups(groups: DataFrame, catalogues: DataFrame) -> DataFrame:
    """Logical groups with the rows of their source catalogues. groups: (group, sources array)."""
    return groups.select("group", F.explode("sources").alias("source")).join(catalogues, "source")


def visible_stars(stars: DataFrame, limit: float = 6.5) -> DataFrame:
    """Unit direction and temperature code of stars down to a magnitude."""
    d = F.sqrt(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2)
    seen = stars.withColumn("distance", d).filter(geo.finite("magnitude") & (F.col("magnitude") <= limit) & geo.finite("distance") & (F.col("distance") > 1e-9))
    code = geo.half_up(F.log(geo.clamp("temperature", 2000.0, 50000.0) / 2000) / math.log(25) * 255)
    code = F.when(geo.finite("temperature"), F.least(F.lit(254).cast("long"), code)).otherwise(255)
    return seen.withColumns({"dx": F.col("x") / d, "dy": F.col("y") / d, "dz": F.col("z") / d, "code": code})


def asof_ephemeris(observations: DataFrame, ephemeris: DataFrame, key: str, bucket: int = 3600) -> DataFrame:
    """Each observation with the latest sample at or before it. observations: (key, ts long, id), ephemeris: (key, ts long, sample).

    A body has few names and very many rows, so both sides are ordered inside buckets of time only; what a bucket starts with is the last sample
    of the buckets before it, of which there is one row each.
    """
    kind = ephemeris.schema["sample"].dataType
    cell = lambda df: df.withColumn("__cell", F.floor(F.col("ts") / bucket))
    both = cell(ephemeris.select(key, "ts", F.lit(None).cast("long").alias("id"), "sample").unionByName(observations.select(key, "ts", "id", F.lit(None).cast(kind).alias("sample"))))
    last = both.groupBy(key, "__cell").agg(F.max_by("sample", F.when(F.col("sample").isNotNull(), F.col("ts"))).alias("__ends"))
    before = Window.partitionBy(key).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = last.select(key, "__cell", F.last("__ends", ignorenulls=True).over(before).alias("__starts"))
    within = Window.partitionBy(key, "__cell").orderBy("ts").rangeBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("sample", F.last("sample", ignorenulls=True).over(within)).filter("id IS NOT NULL").join(starts, [key, "__cell"], "left")
    return out.withColumn("sample", F.coalesce("sample", "__starts")).select(key, "ts", "id", "sample")


def _vector(of: str) -> list:
    return [F.col(f"{of}.{c}") for c in "xyz"]


def relative_bodies(df: DataFrame, body: str, observer: str, radius: str) -> DataFrame:
    """direction struct<x, y, z>, distance and angular_radius (radians, null inside the body) of a body as an observer sees it. body, observer: struct<x, y, z>."""
    step = [b - o for b, o in zip(_vector(body), _vector(observer), strict=True)]
    out = df.withColumn("distance", F.sqrt(step[0] * step[0] + step[1] * step[1] + step[2] * step[2]))
    unit = F.struct(*[F.try_divide(s, F.col("distance")).alias(c) for s, c in zip(step, "xyz", strict=True)])
    return out.withColumn("direction", unit).withColumn("angular_radius", F.when(F.col("distance") >= F.col(radius), F.asin(F.col(radius) / F.col("distance"))))


def visible_planets(planets: DataFrame, limit: float = 6.5) -> DataFrame:
    """Planets that are switched on and bright enough, with their strength from 0 to 1, and how large and how opaque they are shown. planets: (enabled, magnitude, diameter_deg)."""
    strength = geo.clamp((limit - F.col("magnitude")) / (limit + 4.5), 0.0, 1.0)
    seen = planets.filter(F.col("enabled") & geo.finite("magnitude") & (F.col("magnitude") <= limit)).withColumn("strength", strength)
    return seen.withColumns({"shown_deg": F.col("diameter_deg") * (0.85 + 0.2 * F.col("strength")), "opacity": 0.55 + 0.33 * F.col("strength")})


def eclipse_events_between(events: DataFrame, start: Column, end: Column) -> DataFrame:
    """Events from start up to end, whose id tells date and kind, with them. events: (event_id, at timestamp). Raises where the range is empty."""
    parts = lambda k: F.regexp_extract("event_id", r"^solar-(\d{4})-\d{2}-\d{2}-(partial|annular|total|hybrid)$", k)
    in_order = F.when(end > start, True).otherwise(F.raise_error(F.lit("the end must be after the start")))
    named = events.withColumns({"year": parts(1).try_cast("int"), "kind": parts(2)}).filter(F.col("year").isNotNull())
    return named.filter(in_order & (F.col("at") >= start) & (F.col("at") < end))


#: The fields of orbital elements that must be texts, and those that must be numbers or texts of numbers.
TEXTS = ("OBJECT_NAME", "OBJECT_ID", "EPOCH")
NUMBERS = ("MEAN_MOTION", "ECCENTRICITY", "INCLINATION", "RA_OF_ASC_NODE", "ARG_OF_PERICENTER", "MEAN_ANOMALY", "NORAD_CAT_ID", "ELEMENT_SET_NO", "BSTAR", "MEAN_MOTION_DOT", "MEAN_MOTION_DDOT")


def valid_orbital_elements(records: DataFrame, record: str = "record") -> tuple[DataFrame, DataFrame]:
    """(valid, rejects) of records as JSON text: all fields must be there with their kind; numbers are finite."""
    fields = ", ".join(f"{name} variant" for name in (*TEXTS, *NUMBERS))
    seen = lambda f, names: F.array(*[F.struct(F.schema_of_variant(f[n]).alias("kind"), F.try_variant_get(f[n], "$", "string").alias("text")) for n in names])
    plain = lambda t: F.trim(t).rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & geo.finite(t.try_cast("double"))
    number = lambda v: F.coalesce(v["kind"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL|STRING)") & plain(v["text"]), F.lit(False))
    good = lambda f: F.forall(seen(f, TEXTS), lambda v: F.coalesce(v["kind"] == "STRING", F.lit(False))) & F.forall(seen(f, NUMBERS), number)
    # a column of its own would be put in for each of its uses, and the record read as often, where the filter is pushed below it
    told = records.withColumn("__good", F.coalesce(geo.let(F.from_json(record, fields), good), F.lit(False)))
    return told.filter("__good").drop("__good"), told.filter("NOT __good").drop("__good")


def normalise_tracks(tracks: DataFrame, track: str = "track", received_ms: str = "received_ms") -> DataFrame:
    """One flat row for each track that has an id and a place, with the other columns. track: the reader's struct.

    Ids are trimmed and in upper case; a callsign is made up for by the registration or the id as it came, a heading by the course. Points
    are taken as far as offsets, latitudes and longitudes all go, where these are finite and the offset is after that of the last one taken; without any the current place is the one
    point.
    """
    at = lambda path: F.col(f"{track}.{path}")
    number = lambda path: F.when(geo.finite(at(path)), at(path))
    word = lambda path: F.nullif(F.trim(at(path)), F.lit(""))
    ident, lat, lon = word("id"), number("current.latitudeDegrees"), number("current.longitudeDegrees")
    good = tracks.filter(F.coalesce(ident.isNotNull() & lat.isNotNull() & lon.isNotNull(), F.lit(False)))
    course = F.coalesce(number("current.courseDegrees"), F.lit(0.0))
    heading, altitude = F.coalesce(number("current.headingDegrees"), course), number("current.altitudeFt")
    line = lambda name: F.coalesce(at(f"trajectory.{name}"), F.array().cast("array<double>"))
    count = F.least(*[F.size(line(c)) for c in ("offsetMs", "latitudeDegrees", "longitudeDegrees")])
    sound = lambda x: F.when(geo.finite(x), x)
    point = lambda offset, la, lo, al, co, he: F.struct(offset.alias("offset_ms"), la.alias("lat"), lo.alias("lon"), al.alias("altitude"), co.alias("course"), he.alias("heading"))
    value = lambda name, i: sound(F.get(line(name), i))

    def whole(i: Column) -> Column:
        own = F.coalesce(value("courseDegrees", i), course)
        return point(value("offsetMs", i), value("latitudeDegrees", i), value("longitudeDegrees", i), value("altitudeFt", i), own, F.coalesce(value("headingDegrees", i), own))

    each = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), whole)
    there = F.filter(each, lambda p: p["offset_ms"].isNotNull() & p["lat"].isNotNull() & p["lon"].isNotNull())
    kind = "array<struct<offset_ms:double,lat:double,lon:double,altitude:double,course:double,heading:double>>"
    later = F.aggregate(there, F.array().cast(kind), lambda seen, p: F.when((F.size(seen) == 0) | (p["offset_ms"] > F.try_element_at(seen, F.lit(-1))["offset_ms"]), F.concat(seen, F.array(p).cast(kind))).otherwise(seen))
    points = F.when(F.size(later) > 0, later).otherwise(F.array(point(F.lit(0.0), lat, lon, altitude, course, heading)).cast(kind))
    generated = F.coalesce(number("trajectory.generatedAtMs"), F.col(received_ms).cast("double"))
    others = [c for c in tracks.columns if c not in (track, received_ms)]
    out = good.select(
        *others, F.upper(ident).alias("id"), F.coalesce(number("revision"), F.lit(0.0)).alias("revision"), F.coalesce(number("observedAtMs"), F.col(received_ms).cast("double")).alias("observed_at_ms"),
        F.coalesce(word("callsign"), word("registration"), ident).alias("callsign"), word("registration").alias("registration"), word("aircraftType").alias("aircraft_type"), F.upper(word("emitterCategory")).alias("category"),
        lat.alias("lat"), lon.alias("lon"), altitude.alias("altitude"), at("current.onGround").alias("on_ground"), F.coalesce(number("current.groundSpeedKt"), F.lit(0.0)).alias("speed_kt"),
        course.alias("course"), heading.alias("heading"), F.coalesce(number("current.verticalRateFpm"), F.lit(0.0)).alias("vertical_fpm"), generated.alias("generated_at_ms"), points.alias("points"), number("trajectory.validUntilMs").alias("__until"),
    )
    return out.withColumn("valid_until_ms", F.coalesce("__until", F.col("generated_at_ms") + F.element_at("points", -1)["offset_ms"])).drop("__until")


def eclipse_geometry(vectors: DataFrame) -> DataFrame:
    """Distances of Sun and Moon from the Earth and each other, the shadow's direction, and how far along it the plane through the Earth's centre lies from the Moon (below 0: behind)."""
    dot = lambda a, b: sum((F.col(f"{a}.{c}") * F.col(f"{b}.{c}") for c in "yz"), F.col(f"{a}.x") * F.col(f"{b}.x"))
    df = vectors.withColumn("axis", F.struct(*[(F.col(f"moon.{c}") - F.col(f"sun.{c}")).alias(c) for c in "xyz"]))
    length = F.sqrt(dot("axis", "axis"))
    return df.withColumns({"sun_distance": F.sqrt(dot("sun", "sun")), "moon_distance": F.sqrt(dot("moon", "moon")), "sun_moon_distance": length, "axis_distance": -dot("moon", "axis") / length, "axis_x": F.col("axis.x") / length, "axis_y": F.col("axis.y") / length, "axis_z": F.col("axis.z") / length}).drop("axis")


def contact_range(contacts: DataFrame) -> DataFrame:
    """First and last contact of each event, and whether they make a range. contacts: (event_id, utc)."""
    return contacts.groupBy("event_id").agg(F.min("utc").alias("first"), F.max("utc").alias("last")).withColumn("valid", F.coalesce(F.col("first") < F.col("last"), F.lit(False)))
