"""Patches and their images' rectangles are joined without a table that the driver has to hold."""

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from terragrid.plans import catalog
from tests.oracle import differences


@pytest.mark.parametrize("name", ["rect_overlap", "polygon_clip_area"])
def test_patches_are_not_broadcast(spark, tmp_path, name):
    """A file of few bytes, far below the limit for broadcasts, whose patches may be many; repeated and null keys join as in SQL."""
    rows = [(k, 1 + k % 50) for k in range(300)] + [(7, 30), (7, 30), (None, 5)]
    part = pa.table({"p_partkey": pa.array([k for k, _ in rows], pa.int64()), "p_size": pa.array([n for _, n in rows], pa.int32())})
    pq.write_table(part, tmp_path / "part.parquet")
    assert differences(spark, catalog.QUERIES[name], catalog.ORACLES[name], tmp_path) == ""
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
