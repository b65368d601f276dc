"""Stored marts brought up to a later day by the signed changes alone.

Nothing is rebuilt: a change of a table is a row of weight -1, +1 or both, which passes through the same
joins, legs and sums as the rows of a full build. For a join of two tables the change is that of the one
against the other as it is now, and the other's change against the one as it was. Where rows only ever arrive, a
joined row shows from the later of both arrivals on; its changes over all days then come from one join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marketlens import config
from marketlens.functions import canonical_channel, day, literal_table, n
from marketlens.functions.prefix import RunningTotals
from marketlens.plans import marts
from marketlens.plans.staging import STAGING
from marketlens.plans.versions import FROM, OPEN, TO, WEIGHT, change_columns, signed_changes, versions, versions_of
from marketlens.plans.visibility import LATE_UPDATES, RAW_OF
from marketlens.plans.warehouse import Warehouse
from marketlens.sources.store import cut_lineage

DAILY = ("activity_date", "measure_name")


# -- revenue per day ---------------------------------------------------------------------------------------
STEP = "step"


def _real_orders(wh: Warehouse, upto: str) -> DataFrame:
    """Orders of real customers with ``known_from``, the first day that shows both, for days until ``upto``."""
    seen = lambda date: F.col(date) <= day(upto)
    people = marts.real_customers(wh).filter(seen("created_date")).groupBy(F.col("app_db_customer_id").alias("customer_id"))
    people = people.agg(F.min("created_date").alias("_since"))
    return wh.stg("orders").filter(seen("order_date")).join(people, "customer_id").withColumn(
        FROM, F.greatest("order_date", "_since")).drop("_since")


def revenue_changes(wh: Warehouse, *days: str) -> DataFrame:
    """Signed rows ``(step, weight, activity_date, measure_name, amount)`` of ``fct_revenue``: step n leads from day n - 1 to day n, from 0.

    Orders and customers only arrive, so a row shows from the latest arrival of its own, its order's and its customer's on.
    """
    orders = _real_orders(wh, days[-1])
    known = orders.groupBy("order_id").agg(F.min(FROM).alias("_known"))

    def steps(df: DataFrame) -> DataFrame:
        shown = [((F.col(FROM) <= day(d)) & (F.col(TO).isNull() | (F.col(TO) >= day(d)))).cast("int") for d in days]
        weights = [F.struct(F.lit(i).alias(STEP), (shown[i] - shown[i - 1]).alias(WEIGHT)) for i in range(1, len(days))]
        return df.select("*", F.inline(F.array(*weights))).filter(F.col(WEIGHT) != 0)

    def change(name: str) -> DataFrame:
        _, arrival, _ = change_columns(name)
        rows = wh.stg(name).filter(F.col(arrival) <= day(days[-1])).join(known, "order_id")
        return steps(versions_of(rows, name).withColumn(FROM, F.greatest(FROM, "_known")))

    orders = steps(orders.withColumn(TO, F.lit(None).cast("date")).withColumn("channel", canonical_channel("channel")))
    return marts.revenue_legs(orders, change("refunds"), change("invoices"), change("revenue_recognition"), STEP, WEIGHT)


def revenue_state(wh: Warehouse) -> DataFrame:
    """``revenue_daily`` with the number of rows behind each sum, so that a sum of no rows can go."""
    return wh.mart("fct_revenue").groupBy(*DAILY).agg(
        F.sum("amount").cast("decimal(28,2)").alias("amount"), F.count(F.lit(1)).alias("rows"))


def revenue_deltas(changes: DataFrame, *by: str) -> DataFrame:
    """Signed rows added up per day and measure, and per ``by``."""
    weight = F.col(WEIGHT)
    return changes.groupBy(*by, *DAILY).agg(
        F.sum(F.col("amount") * weight).cast("decimal(28,2)").alias("amount"), F.sum(weight).cast("long").alias("rows"))


def add_deltas(state: DataFrame, delta: DataFrame) -> DataFrame:
    """The state with sums added to it; a day of a measure that no row is left of goes."""
    out = state.unionByName(delta).groupBy(*DAILY).agg(
        F.sum("amount").cast("decimal(28,2)").alias("amount"), F.sum("rows").cast("long").alias("rows"))
    return out.filter(F.col("rows") != 0)


def apply_revenue(state: DataFrame, changes: DataFrame) -> DataFrame:
    """The state with signed rows added to it."""
    return add_deltas(state, revenue_deltas(changes))


def mart_increment(wh: Warehouse, *days: str) -> DataFrame:
    """Revenue per day and measure as of the last day: stored as of the first, then brought from day to day.

    The changes of all steps come from one pass over the facts, added up per step.
    """
    state = cut_lineage(revenue_state(wh.as_of(days[0])))
    deltas = cut_lineage(revenue_deltas(revenue_changes(wh, *days), STEP))
    for step in range(1, len(days)):
        state = cut_lineage(add_deltas(state, deltas.filter(F.col(STEP) == step).drop(STEP)))
    return state


# -- customers ---------------------------------------------------------------------------------------------
def _aliases(wh: Warehouse, name: str, after: str, upto: str) -> DataFrame:
    """Signed (source_system, source_customer_id, source_created_date) of one alias table; versions of a row that agree cancel."""
    system = next(s for s in ("stripe", "shopify", "salesforce", "app_db") if name.startswith(s) or s == "app_db")
    rows = signed_changes(wh, name, after, upto).select(
        F.lit(system).alias("source_system"), F.col(f"{system}_customer_id").alias("source_customer_id"),
        F.col("created_date").alias("source_created_date"), WEIGHT)
    key = ["source_system", "source_customer_id", "source_created_date"]
    return rows.groupBy(*key).agg(F.sum(WEIGHT).cast("int").alias(WEIGHT)).filter(F.col(WEIGHT) != 0)


def _only_new(df: DataFrame, what: str) -> DataFrame:
    """The rows, which must all be additions: a smallest date cannot be taken back by a sum."""
    gone = F.raise_error(F.lit(f"{what} withdrawn: rebuild dim_customers"))
    return df.withColumn(WEIGHT, F.when(F.col(WEIGHT) < 0, gone.cast("int")).otherwise(F.col(WEIGHT)))


def apply_customers(state: DataFrame, wh: Warehouse, after: str, upto: str) -> DataFrame:
    """``dim_customers`` as of ``upto`` from the one of ``after``: new customers, and new links and orders of all."""
    old, new = wh.as_of(after), wh.as_of(upto)
    key = "app_db_customer_id"
    came = _only_new(signed_changes(wh, "app_customers", after, upto), "a customer").drop(WEIGHT)
    came = cut_lineage(came)
    aliases = _aliases(wh, "app_customers", after, upto)
    for name in ("stripe_customers", "shopify_customers", "salesforce_customers"):
        aliases = aliases.unionByName(_aliases(wh, name, after, upto))
    on, take = ["source_system", "source_customer_id"], [key, "source_system", "source_created_date"]
    links = _only_new(signed_changes(wh, "customer_id_crosswalk", after, upto), "a link")
    before = old.mart("int_customer_identity").filter(F.col("resolution_status") == "resolved")
    known = marts.observed_aliases(old).select(*on, "source_created_date")
    resolved = (
        _only_new(aliases, "an alias").join(new.stg("customer_id_crosswalk"), on).select(*take)
        .unionByName(known.join(links, on).select(*take))
        .unionByName(before.join(came.select(key), key, "left_semi").select(*take))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_ids"), F.min("source_created_date").alias("_seen"),
             *[F.max(F.col("source_system") == s).alias(f"_{s}") for s, _, _ in config.SOURCE_SYSTEMS])
    )
    orders = signed_changes(wh, "orders", after, upto).select(F.col("customer_id").alias(key), "order_date")
    earlier = old.stg("orders").select(F.col("customer_id").alias(key), "order_date").join(came.select(key), key, "left_semi")
    orders = orders.unionByName(earlier).groupBy(key).agg(F.min("order_date").alias("_first_order"))
    flags = [f"has_{s}" for s, _, _ in config.SOURCE_SYSTEMS]
    fresh = came.select(
        key, F.col("created_date").alias("first_seen_date"), "segment", "account_type", "acquisition_channel",
        F.lit(None).cast("date").alias("first_order_date"), F.lit(False).alias("has_order"),
        F.lit(0).cast("long").alias("resolved_source_id_count"), F.lit(0).cast("long").alias("resolved_source_system_count"),
        *[F.lit(False).alias(f) for f in flags])
    now = {f"has_{s}": F.col(f"has_{s}") | F.coalesce(f"_{s}", F.lit(False)) for s, _, _ in config.SOURCE_SYSTEMS}
    # least() passes over nulls; without an id so far, the first date seen was only the customer's own
    seen = F.when(F.col("resolved_source_id_count") > 0, F.least("first_seen_date", "_seen")).otherwise(F.coalesce("_seen", "first_seen_date"))
    out = state.unionByName(fresh).join(resolved, key, "left").join(orders, key, "left")
    return out.select(
        key, seen.alias("first_seen_date"), "segment", "account_type", "acquisition_channel",
        F.least("first_order_date", "_first_order").alias("first_order_date"),
        (F.col("has_order") | F.col("_first_order").isNotNull()).alias("has_order"),
        (F.col("resolved_source_id_count") + F.coalesce("_ids", F.lit(0))).cast("long").alias("resolved_source_id_count"),
        sum((c.cast("long") for c in now.values()), F.lit(0).cast("long")).alias("resolved_source_system_count"),
        *[c.alias(f) for f, c in now.items()])


def mart_increment_customers(wh: Warehouse, *days: str) -> DataFrame:
    """``dim_customers`` as of the last day: stored as of the first, then brought from day to day."""
    mart = wh.as_of(days[0]).mart("dim_customers")
    state = cut_lineage(mart.select(*[F.col(f.name).cast("long") if f.name.endswith("_count") else F.col(f.name) for f in mart.schema]))
    for after, upto in zip(days[:-1], days[1:], strict=True):
        state = cut_lineage(apply_customers(state, wh, after, upto))
    return state


# -- all as-of days at once ------------------------------------------------------------------------------------
#: The money of a table that the series adds up.
AMOUNT = {
    "orders": "gross_amount", "order_lines": "line_amount", "products": "list_price", "plan_prices": "annual_price_per_seat",
    "subscriptions": "acv", "invoices": "amount", "revenue_recognition": "amount", "refunds": "refund_amount", "ad_spend": "spend_usd",
}


def _steps(wh: Warehouse, name: str) -> DataFrame:
    """(table_name, day, rows, open_rows, amount): what the snapshot of a day holds more than that of the day before."""
    def step(date: Column, sign: int) -> Column:
        amount = F.col(AMOUNT[name]) if name in AMOUNT else F.lit(0)
        return F.struct(
            date.alias("day"), F.lit(sign).alias("rows"), (F.col(OPEN).cast("int") * sign).alias("open_rows"),
            (F.coalesce(amount, F.lit(0)).cast("decimal(18,2)") * sign).cast("decimal(19,2)").alias("amount"))

    both = F.array(step(F.col(FROM), 1), step(F.date_add(TO, 1), -1))
    return versions(wh, name).select(F.lit(RAW_OF[name]).alias("table_name"), F.inline(both)).filter("day IS NOT NULL")


def visible_as_of_series(wh: Warehouse, days: Column) -> DataFrame:
    """Rows, rows whose late update is yet to come, and money of every table in the snapshot of each of ``days``.

    All days come from one pass over the version tables: intervals become steps, added up per table and day where
    they arise, then running totals over the calendar, which each asked day meets by equality. ``days`` is an array of dates.
    """
    steps = None
    for name in STAGING:
        part = _steps(wh, name)
        steps = part if steps is None else steps.unionByName(part)
    sums = ("rows", "open_rows", "amount")
    daily = steps.groupBy("table_name", "day").agg(*[F.sum(s).alias(s) for s in sums])
    names = literal_table(wh.spark, "table_name string", [(raw,) for raw, _ in STAGING.values()])
    asked = names.select("table_name", F.explode(days).alias("as_of"))
    out = RunningTotals(daily, "table_name", "day", sums).upto(asked, "as_of", *sums)
    updated = F.col("table_name").isin(*LATE_UPDATES)
    return out.select(
        "as_of", "table_name", n("rows").alias("rows"), F.when(updated, n("open_rows")).alias("open_rows"), F.col("amount").cast("double").alias("amount"))
