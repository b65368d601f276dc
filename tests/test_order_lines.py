"""Order lines are joined to orders and products for the dates and columns that are read."""

from pyspark.sql import functions as F

from marketlens.operators import diagnostics
from marketlens.plans.warehouse import Warehouse


def test_order_lines_are_not_stored_whole(spark):
    wh = Warehouse.refresh(spark, "/root/testdata/sf0.001")
    diagnostics.EVENTS["supplier_outage"](wh).collect()
    assert "stg_order_lines" in wh.store._ready and "fct_order_lines" not in wh.store._ready
    window = wh.mart("fct_order_lines").filter(F.col("order_date").between("1999-01-01", "1999-06-30")).agg(F.sum("line_amount"))
    plan = window._jdf.queryExecution().executedPlan().toString()
    assert "order_line_id" not in plan and "GreaterThanOrEqual(order_date,1999-01-01)" in plan
