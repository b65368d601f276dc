"""Results that must not be computed over broken input; hashes that tell rows apart."""

import pytest
from fixtures import PLAN, customer, order, term, warehouse

from marketlens import config
from marketlens.operators import quality, revenue, subscriptions


def test_refund_rate_rejects_repeated_keys(spark):
    orders = [order("o1", "a", "d2c", "2000-01-05", 100), order("o1", "a", "d2c", "2000-01-06", 100)]
    wh = warehouse(spark, app_db__customers=[customer("a")], app_db__orders=orders)
    with pytest.raises(Exception, match="null or repeated"):
        revenue.refund_rate_by_quarter(wh, "2000-05-31").collect()
    wh = warehouse(spark, app_db__customers=[customer("a")], app_db__orders=orders[:1])
    assert len(revenue.refund_rate_by_quarter(wh, "2000-05-31").collect()) == 1


def test_migration_rejects_an_unmapped_plan(spark):
    old = {**PLAN, "plan_id": "old", "plan_generation": 1}
    terms = [term("a0", "a", "2000-01-01", "2000-12-31", 100, plan="old", status="active")]
    prices = [{"plan_id": "essentials", "effective_from": "1999-01-01", "annual_price_per_seat": 10}]
    wh = warehouse(spark, app_db__customers=[customer("a", segment="smb")], app_db__plans=[PLAN, old],
                   app_db__subscriptions=terms, app_db__plan_prices=prices)
    found = subscriptions.legacy_migration_violations(wh, "2000-06-30", config.CURRENT_GENERATION, {"pro": "essentials"}).count()
    assert found > 0
    with pytest.raises(Exception, match="undefined"):
        subscriptions.legacy_subscribers_migration(wh, "2000-06-30", config.CURRENT_GENERATION, {"pro": "essentials"}).collect()


def test_fingerprints_tell_nulls_and_separators_apart(spark):
    def content(rows):
        df = spark.createDataFrame(rows, "a string, b string")
        return df.agg(quality._hash_sum(["a", "b"]).alias("h")).first()["h"]

    different = [("x", None)], [("x", "null")], [("x", "")], [("x|b=y", "z")], [("x", "y|b=z")], [("x", "b")]
    assert len({content(rows) for rows in different}) == len(different)
    assert content([("1", "2"), ("3", "4")]) == content([("3", "4"), ("1", "2")])
