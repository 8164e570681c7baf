"""How often records are read and rows are moved, and how many of a batch are Python objects at once."""

import re

import pyarrow as pa

from tilewright.catalog import tracks as catalogue
from tilewright.operators import rasters, tracks


def test_records_are_parsed_once(spark):
    good, bad = tracks.valid_orbital_elements(spark.range(3).selectExpr("cast(id as string) AS record"))
    for df in (good, bad):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert good.count() == 0 and bad.count() == 3


def test_named_rows_of_catalogues_move_once(spark):
    plan = catalogue.merge_catalogues(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    moved = re.findall(r"hashpartitioning\((group#\d+, id#\d+L)(, pos#\d+L)?, ", plan)
    assert sum(1 for _, pos in moved if not pos) == 1 and sum(1 for _, pos in moved if pos) == 1


def test_batches_are_taken_in_slices():
    batch = pa.RecordBatch.from_pydict({"n": list(range(1000))})
    sizes = [b.num_rows for b in rasters._slices(iter([batch]))]
    assert max(sizes) <= 64 and sum(sizes) == 1000
