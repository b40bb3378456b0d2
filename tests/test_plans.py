"""Plans: what masks, boxes or blocks are spread to isn't broadcast, however small Spark takes it for."""

import re

import pytest

from lumatile.plans import kernels, planted, relational  # noqa: F401

SF = "/root/testdata/sf0.001"


def broadcast(plan: str) -> list[str]:
    """Operators below the exchanges that broadcast, down to sums by field of view, label or target."""
    found, bounds, small = [], [], []
    for line in plan.splitlines():
        text = line.lstrip(" :+-")
        depth = len(line) - len(text)
        while bounds and depth <= bounds[-1]:
            bounds.pop()
        while small and depth <= small[-1]:
            small.pop()
        keys = re.match(r"HashAggregate\(keys=\[(.*?)\]", text)
        if bounds and keys and not {"y", "x", "mask_id"} & {k.strip().split("#")[0] for k in keys[1].split(",")}:
            small.append(depth)
        if bounds and not small:
            found.append(text.split()[0] if text else "")
        if text.startswith("BroadcastExchange"):
            bounds.append(depth)
    return found


@pytest.mark.parametrize("name", ["ag1_assign_targets", "ag2_expression_long", "ag2_cells", "ag2_expression_matrix", "fs4_measure_at_spots", "fs5_measure_max", "fs5_measure_mean", "mo7_simple_merge", "mo6_logical_and", "ag4_concatenate_expression", "px7_planted_squares", "mo9_planted_cells"])
def test_what_is_spread_is_not_broadcast(spark, name):
    plan = relational.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" in plan
    assert not {"Generate", "FlatMapGroupsInPandas"} & set(broadcast(plan))


def test_masks_are_read_once_and_only_fields_with_spots_are_shuffled(spark):
    """F8: ag4_concatenate_expression."""
    plan = relational.QUERIES["ag4_concatenate_expression"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"FileScan parquet \[p_partkey", plan)) == 2  # a half of the table each
    assert len(re.findall(r"BroadcastHashJoin \[fov#\d+\], \[fov#\d+\], LeftSemi", plan)) == 2
    assert len(re.findall(r"Exchange hashpartitioning\(p_partkey#\d+L?, \d+\), REPARTITION_BY_NUM", plan)) == 2


def test_wide_matrix_keeps_cells_without_genes(spark):
    """F8: ag4_concatenate_expression, ag2_expression_matrix."""
    from lumatile.operators import assign

    d = spark.createDataFrame([("1", "G1"), ("1", None), ("2", None), (None, "G2"), ("3", "G9")], "cell_id string, target string")
    assert sorted(map(tuple, assign.expression_matrix(d, ["G1", "G2"]).collect())) == [("1", 1, 0), ("2", 0, 0), ("3", 0, 0), ("unassigned", 0, 1)]
    assert sorted(map(tuple, assign.expression_matrix(d).collect())) == [("1", 1, 0, 0), ("2", 0, 0, 0), ("3", 0, 0, 1), ("unassigned", 0, 1, 0)]


@pytest.mark.parametrize("name", ["ag2_expression_long", "ag2_cells"])
def test_parts_are_dealt_out_before_they_are_spread(spark, name):
    """ag2_expression_long, F9: ag2_cells."""
    plan = relational.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning\(p_partkey#\d+L?, \d+\), REPARTITION_BY_NUM", plan)) == 1
    assert len(re.findall(r"BroadcastHashJoin \[fov#\d+\], \[fov#\d+\], LeftSemi", plan)) == 1
