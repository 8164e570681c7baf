"""Every query with SQL beside it gives the same rows on the smallest tables."""

import math

import duckdb
import pytest

from tilewright import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return "null"
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return f"{float(value):.5f}".replace("-0.00000", "0.00000")


def rows(names, found):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in found)


def same(a, b):
    """Equal, or numbers that only their last printed place parts."""
    try:
        return a == b or abs(float(a) - float(b)) <= 2e-5
    except ValueError:
        return False


@pytest.mark.parametrize("name", list(catalog.oracle_sql()))
def test_same_as_sql(spark, db, name):
    df = catalog.queries()[name](spark, SF)
    rel = db.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    mine, theirs = rows(df.columns, df.collect()), rows(rel.columns, rel.fetchall())
    assert len(mine) == len(theirs)
    assert not [(a, b) for a, b in zip(mine, theirs, strict=True) if not all(map(same, a, b))][:3]


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_empty_tables(spark, tmp_path_factory, name):
    home = tmp_path_factory.getbasetemp() / "none"
    if not home.exists():
        for t in TABLES:
            spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{home}/{t}.parquet")
    found = catalog.queries()[name](spark, str(home)).collect()
    assert name == "cuts_equal" or not found


def test_horizon_of_one_on_the_ground(spark):
    from tilewright.operators.tiles import assign_tiles, tiles_within_horizon

    seen = spark.createDataFrame([(1, 48.2, 16.37, 1000.0, 0.0), (2, -89.9, 0.0, 1000.0, 0.0), (3, 0.0, 180.0, 1000.0, 0.0), (4, 10.0, 10.0, 1000.0, 1e12), (5, None, 1.0, 1000.0, 1.0)], "observer_id long, lat double, lon double, radius_m double, height_m double")
    tiles = assign_tiles(seen.filter("lat IS NOT NULL"), [0, 2, 7, 18]).select("z", "x", "y")
    got = {i: {(r["z"], r["x"], r["y"]) for r in tiles_within_horizon(seen, tiles).collect() if r["observer_id"] == i} for i in range(1, 6)}
    underfoot = {i: {(r["z"], r["x"], r["y"]) for r in assign_tiles(seen.filter(f"observer_id = {i}"), [0, 2, 7, 18]).collect()} for i in range(1, 4)}
    assert got[1] == underfoot[1] and got[2] == underfoot[2] and underfoot[3] <= got[3]
    assert len(got[4]) > 4 and not got[5]


def test_every_cover_is_valid(spark):
    from tilewright.catalog import views
    from tilewright.operators.tiles import validate_cut
    from tilewright.plans.cover import balanced_cover, observer_targets

    cut = balanced_cover(observer_targets(views.observers(spark, SF)))
    assert validate_cut(cut, ["observer_id"]).count() == 0


def test_targets_at_seam_and_poles(spark):
    from tilewright.plans.cover import balanced_cover, finest_tiles, observer_targets

    seen = spark.createDataFrame([(1, 20.0, 179.75, 10), (2, 20.0, -180.25, 10), (3, 90.0, 90.0, 0), (4, 85.05112878 + 0.01, 0.0, 14), (5, 89.9, 0.0, 1)], "observer_id long, lat double, lon double, max_zoom int")
    targets = observer_targets(seen)
    tiles = {}
    for r in balanced_cover(targets).collect():
        tiles.setdefault(r["observer_id"], set()).add((r["z"], r["x"], r["y"]))
    assert tiles[1] == tiles[2]
    assert tiles[3] == {(0, 0, 0)}
    edge = [r for r in finest_tiles(targets).collect() if r["observer_id"] == 4]
    assert len(edge) == 64 and {r["y"] for r in edge} == set(range(8))
    assert all(abs(sum(4.0**-z for z, _, _ in t) - 1) < 1e-12 for t in tiles.values())


def test_pairs_within_a_radius(spark):
    from tilewright.catalog.tracks import tracks_within_radius as query
    from tilewright.operators.tracks import tracks_within_radius

    places = [(0.0, 0.0), (0.0, 4.0), (3.0, 3.0), (10.0, 179.9), (10.0, -179.9), (84.5, 0.0), (84.5, 30.0), (89.9, 10.0), (89.0, -170.0), (-88.0, 90.0), (-87.0, -90.0), (None, 1.0), (float("nan"), 1.0)]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(places)], "id long, lat double, lon double")
    got = tracks_within_radius(rows, rows.toDF("centre", "c_lat", "c_lon"), 250.0).collect()
    limit, want = 250 * 1.852 / 6371.0088, {}
    for i, (a, b) in enumerate(places[:-2]):
        for j, (c, d) in enumerate(places[:-2]):
            a_, c_ = math.radians(a), math.radians(c)
            h = math.sin((c_ - a_) / 2) ** 2 + math.cos(a_) * math.cos(c_) * math.sin(math.radians(d - b) / 2) ** 2
            if (angle := 2 * math.asin(math.sqrt(min(1, h)))) <= limit:
                want[i, j] = angle
    assert {(r["centre"], r["id"]) for r in got} == want.keys() and all(abs(r["angle"] - want[r["centre"], r["id"]]) < 1e-12 for r in got)
    # a pair takes no sine, cosine or decimal number, only the arc sine of its chord
    plan = query(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Join") + plan[plan.index("Join") :].index("\n")].lower()
    assert "round(" not in above and "cos(" not in above and " sin(" not in above and "asin(" in above
