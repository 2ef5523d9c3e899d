"""Plan properties the design relies on, read from explain('formatted')."""

import contextlib
import io

from conftest import SF01
from penfit.operators import linalg
from penfit.sources.tables import price_design


def _plan(df) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


def test_price_design_scan_is_pruned_and_part_broadcast(spark):
    plan = _plan(linalg.column_norms(price_design(spark, SF01)))
    li = [l for l in plan.splitlines() if l.startswith("ReadSchema: struct<l_")][0]
    assert "l_shipdate" not in li and "l_returnflag" not in li and "l_orderkey" not in li
    assert "l_extendedprice" not in li          # the label is not needed for norms
    assert "BroadcastHashJoin" in plan
    assert "Generate" not in plan                # no row per cell


def test_dense_column_aggregates_make_no_row_per_cell(spark):
    from penfit.sources.tables import embedding_design
    d = embedding_design(spark, SF01)
    for df in (linalg.column_norms(d), linalg.transpose_product(linalg.residuals(d, [0.1] * 64)),
               linalg.mean_loss_gradient(d, [0.1] * 64)):
        plan = _plan(df)
        assert "Generate" not in plan and "posexplode" not in plan
        assert plan.count("Exchange") >= 2 and "summary" in plan.lower() or "aggregate" in plan.lower()
