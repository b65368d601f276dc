"""The 19 raw commerce tables, derived from the order, part and event tables.

Every table is an expression over the whole input, and no order or order line is left out. One rule
shapes the population on purpose: each customer's history is pressed into the part of the
timeline after a staggered first date, order by order, so that acquisition spreads over it.

All joins are left to the planner (it broadcasts a side only when its measured size allows
it, and splits skewed partitions); only tables of fixed values are hinted. Nothing groups
a whole customer into one task: the one window over a customer, the term chain, runs over
the customer's distinct calendar days.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marketlens import config
from marketlens.functions import MONEY, RATE, day, literal_table, money
from marketlens.plans import derivations as dv
from marketlens.plans.temporal import as_of_lookup, effective_intervals, within
from marketlens.sources.registry import RAW_TABLES

CUSTOMER, ORDER, TERM = "cust_", "ord_", "sub_"


def _id(prefix: str, key: Column | str) -> Column:
    return F.concat(F.lit(prefix), F.col(key) if isinstance(key, str) else key)


def _key(prefix: str, col: str) -> Column:
    return F.expr(f"cast(substring({col}, {len(prefix) + 1}) as bigint)")


def order_channel() -> Column:
    urgent = (F.col("o_orderpriority") == "1-URGENT") & (F.col("o_custkey") % 3 == 1)
    return (
        F.when(urgent, F.lit("business_subscription"))
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit("marketplace"))
        .otherwise(F.lit("d2c"))
    )


def promo_for(order_key: Column, order_date: Column, channel: Column) -> Column:
    """The first promotion whose days, channels and attach share cover the order."""
    picks = []
    for code, _, start, end, _, channels, attach in config.PROMOTIONS:
        covered = (
            order_date.between(day(start), day(end))
            & channel.isin(*channels.split(","))
            & (order_key % 100 < attach)
        )
        picks.append(F.when(covered, F.lit(code)))
    return F.coalesce(*picks)


class MappedSource:
    """Raw tables by name. ``staged`` hands back already staged (stored) tables, ``stored`` one only if it is stored by now."""

    def __init__(
        self,
        spark: SparkSession,
        folder: str,
        staged: Callable[[str], DataFrame],
        stored: Callable[[str], DataFrame | None] = lambda name: None,
    ):
        self.spark = spark
        self.folder = folder
        self.staged = staged
        self.stored = stored

    def read(self, table: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet")

    def table(self, name: str) -> DataFrame:
        """One raw table in its contract types and column order."""
        built = getattr(self, "_" + name.split("__", 1)[0] + "_" + name.split("__", 1)[1])()
        schema = T.StructType.fromDDL(RAW_TABLES[name].ddl)
        return built.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

    # -- shared pieces --------------------------------------------------------------
    def base_orders(self) -> DataFrame:
        """Every order. Days within the timeline move into what is left of it after the customer's
        first date, in their old sequence; other days stay."""
        length = (date.fromisoformat(config.TIMELINE_END) - date.fromisoformat(config.TIMELINE_START)).days
        start, given = day(config.TIMELINE_START), day(F.col("o_orderdate"))
        late = F.coalesce(F.pmod(F.col("o_custkey") * 37, F.lit(2000)), F.lit(0)).cast("int")
        since = F.date_diff(given, start)
        moved = F.date_add(start, (late + F.floor(since * (length - late) / length)).cast("int"))
        return self.read("orders").select(
            F.col("o_custkey").alias("k"),
            F.col("o_orderkey").alias("ok"),
            F.when(since.between(0, length), moved).otherwise(given).alias("order_date"),
            order_channel().alias("channel"),
        )

    def _consumer_orders(self) -> DataFrame:
        return self.base_orders().filter(F.col("channel") != "business_subscription")

    def _promo(self) -> Column:
        return promo_for(F.col("ok"), F.col("order_date"), F.col("channel"))

    def _consumer(self) -> DataFrame:
        return self._consumer_orders().withColumn("promo_code", self._promo())

    # -- catalog ---------------------------------------------------------------------
    def _category(self, part_type: str = "p_type") -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for kind, category in config.CATEGORY_BY_PART_TYPE.items():
            out = out.when(F.col(part_type) == kind, F.lit(category))
        return out

    def _supplier_index(self, category: str = "category") -> Column:
        out = F.when(F.lit(False), F.lit(0))
        for i, name in enumerate(config.CATEGORIES):
            out = out.when(F.col(category) == name, F.lit(i))
        return out

    def _app_db_products(self) -> DataFrame:
        cost = F.round(
            money("p_retailprice") * (50 + F.col("p_partkey") % 30).cast("decimal(4,0)") / F.lit(100), 2
        )
        return (
            self.read("part")
            .withColumn("category", self._category())
            .select(
                _id("sku_", "p_partkey").alias("sku"),
                F.col("p_name").alias("product_name"),
                "category",
                _id("sup_", self._supplier_index()).alias("supplier_id"),
                cost.cast(MONEY).alias("unit_cost"),
                money("p_retailprice").alias("list_price"),
                F.date_add(
                    day(config.TIMELINE_START), (F.col("p_partkey") % 365).cast("int")
                ).alias("introduced_at"),
            )
        )

    def _erp_suppliers(self) -> DataFrame:
        """Every supplier; categories go round by key, the first of each is the one bought from."""
        slot = (F.col("s_suppkey") % len(config.CATEGORIES) + 1).cast("int")
        return self.read("supplier").select(
            _id("sup_", "s_suppkey").alias("supplier_id"),
            F.col("s_name").alias("supplier_name"),
            F.element_at(F.array(*[F.lit(c) for c in config.CATEGORIES]), slot).alias("category"),
            day(config.TIMELINE_START).alias("onboarded_at"),
        )

    def _erp_supplier_shipments(self) -> DataFrame:
        weekly = (
            self.read("lineitem")
            .select("l_partkey", "l_quantity", day(F.date_trunc("week", "l_shipdate")).alias("expected_date"))
            .join(
                self.read("part").select("p_partkey", self._category().alias("category")),
                F.col("l_partkey") == F.col("p_partkey"),
            )
            .groupBy("category", "expected_date")
            .agg(F.sum(F.col("l_quantity").cast("long")).alias("units_expected"))
            .withColumn("slot", self._supplier_index())
        )
        stopped = (F.col("category") == "paper") & F.col("expected_date").between(
            day(config.STOCKOUT[0]), day(config.STOCKOUT[1])
        )
        partial = F.dayofyear("expected_date") % 33 == 0
        return weekly.select(
            F.concat(
                F.lit("shp_"), "category", F.lit("_"), F.date_format("expected_date", "yyyyMMdd")
            ).alias("shipment_id"),
            _id("sup_", "slot").alias("supplier_id"),
            "category",
            "expected_date",
            F.when(~stopped, F.expr("date_add(expected_date, slot % 4)")).alias("received_date"),
            "units_expected",
            F.when(stopped, F.lit(0))
            .when(partial, F.expr("(units_expected * 8) div 10"))
            .otherwise(F.col("units_expected"))
            .alias("units_received"),
            F.when(stopped, F.lit("delayed"))
            .when(partial, F.lit("partial"))
            .otherwise(F.lit("received"))
            .alias("status"),
        )

    # -- plans and promotions (fixed values) -----------------------------------------
    def _app_db_plans(self) -> DataFrame:
        return literal_table(
            self.spark,
            "plan_id string, plan_name string, plan_generation bigint, tier string, "
            "launched_at date, retired_at date, is_current boolean",
            [(p[0], p[1], p[2], p[3], p[4], p[5], p[5] is None) for p in config.PLANS],
        )

    def _app_db_plan_prices(self) -> DataFrame:
        rows = [(p[0], p[4], p[6]) for p in config.PLANS]
        rows += [
            (p[0], config.PRICE_RISE_DATE, round(p[6] * config.PRICE_RISE_FACTOR, 2))
            for p in config.PLANS
            if p[2] == config.CURRENT_GENERATION
        ]
        return literal_table(
            self.spark,
            "plan_id string, effective_from date, annual_price_per_seat decimal(18,2)",
            rows,
        )

    def _app_db_promotions(self) -> DataFrame:
        return literal_table(
            self.spark,
            "promo_code string, promo_name string, start_date date, end_date date, "
            "discount_pct decimal(5,4), eligible_channels string",
            [p[:6] for p in config.PROMOTIONS],
        )

    # -- orders and lines --------------------------------------------------------------
    def _priced_lines(self) -> DataFrame:
        """Lines of consumer orders with their order, part, whole quantity, discount and amount."""
        discount = F.coalesce(
            *[
                F.when(F.col("promo_code") == p[0], F.lit(str(p[4])).cast(RATE))
                for p in config.PROMOTIONS
            ],
            F.lit("0").cast(RATE),
        )
        parts = self.read("part").select(
            "p_partkey", self._category().alias("category"), money("p_retailprice").alias("unit_price")
        )
        # Orders come last: the lines of an order then lie in one task, where their amounts are added up.
        lines = (
            self.read("lineitem")
            .select(
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity",
                "l_extendedprice", "l_shipdate",
            )
            .join(parts, F.col("l_partkey") == F.col("p_partkey"), "left")
            .join(self._consumer(), F.col("l_orderkey") == F.col("ok"))
        )
        lines = lines.withColumn("quantity", F.col("l_quantity").cast("long")).withColumn("discount_pct", discount)
        amount = dv.line_amount(F.col("quantity"), F.col("unit_price"), F.col("discount_pct"))
        return lines.withColumn("line_amount", amount)

    def _app_db_order_lines(self) -> DataFrame:
        return self._priced_lines().select(
            F.concat_ws(
                "-",
                "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                (money("l_extendedprice") * 100).cast("long"),
                F.date_format("l_shipdate", "yyyyMMdd"),
            ).alias("order_line_id"),
            _id(ORDER, "ok").alias("order_id"),
            _id("sku_", "l_partkey").alias("sku"),
            "quantity",
            "unit_price",
            "discount_pct",
            "line_amount",
            F.col("order_date").alias("created_at"),
        )

    def order_amount_lines(self) -> DataFrame:
        """``(ok, line_amount)`` for the amounts of orders: from the stored lines, or else as derived, where only the columns that are read are computed."""
        stored = self.stored("stg_order_lines")
        lines = self._priced_lines() if stored is None else stored.withColumn("ok", _key(ORDER, "order_id"))
        return lines.select("ok", "line_amount")

    def _app_db_orders(self) -> DataFrame:
        # Amounts are added up by the number by which the lines were joined, so they are not sent once more.
        rollup = dv.gross_from_lines(self.order_amount_lines(), "ok")
        marketplace = F.col("channel") == "marketplace"
        take = (F.lit("0.15").cast(RATE) + (F.col("ok") % 11).cast("decimal(3,0)") * F.lit("0.01").cast("decimal(3,2)")).cast(RATE)
        legacy = (F.col("channel") == "d2c") & (F.col("order_date") < day(config.CHANNEL_RENAME))
        consumer = (
            self._consumer_orders()
            .join(rollup, "ok", "left")
            .withColumn("promo_code", self._promo())
            .withColumn("gross_amount", F.coalesce("gross_amount", F.lit(0).cast(MONEY)))
            .withColumn("take_rate", F.when(marketplace, take))
            .select(
                _id(ORDER, "ok").alias("order_id"),
                _id(CUSTOMER, "k").alias("customer_id"),
                F.when(legacy, F.lit(config.LEGACY_D2C_LABEL)).otherwise(F.col("channel")).alias("channel"),
                "order_date",
                "gross_amount",
                "take_rate",
                dv.net_amount(F.col("gross_amount"), F.col("take_rate")).alias("net_amount"),
                "promo_code",
                F.lit(None).cast("string").alias("subscription_id"),
            )
        )
        business = self.staged("subscriptions").select(
            "order_id",
            "customer_id",
            F.lit("business_subscription").alias("channel"),
            F.col("term_start_date").alias("order_date"),
            F.col("acv").alias("gross_amount"),
            F.lit(None).cast(RATE).alias("take_rate"),
            F.col("acv").alias("net_amount"),
            F.lit(None).cast("string").alias("promo_code"),
            "subscription_id",
        )
        return consumer.unionByName(business)

    # -- subscriptions -------------------------------------------------------------------
    def _app_db_subscriptions(self) -> DataFrame:
        business = (
            self.base_orders().filter(F.col("channel") == "business_subscription").select("k", "ok", "order_date")
        )
        chain = dv.term_chain(business, "k", "order_date", "ok")
        tiers = self.read("customer").select(
            F.col("c_custkey").alias("k"),
            F.when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), F.lit("enterprise"))
            .otherwise(F.lit("smb"))
            .alias("segment"),
        )
        offers = literal_table(
            self.spark,
            "plan_id string, tier string, launched date, retired date, slot int",
            [(p[0], p[3], p[4], p[5], p[7]) for p in config.PLANS],
        )
        sold = (
            chain.join(tiers, "k", "left")
            .join(
                F.broadcast(offers),
                (F.col("segment") == F.col("tier"))
                & (F.col("chain_start") >= F.col("launched"))
                & (F.col("retired").isNull() | (F.col("chain_start") <= F.col("retired")))
                & (F.col("slot").isNull() | (F.col("slot") == F.col("chain_start_seq") % 2)),
                "left",
            )
            .withColumn(
                "seats",
                F.when(F.col("segment") == "enterprise", 50 * (40 + F.col("k") % 160)).otherwise(
                    50 * (3 + F.col("k") % 58)
                ),
            )
        )
        priced = as_of_lookup(
            sold, self._app_db_plan_prices(), key="plan_id", date="order_date",
            since="effective_from", take=["annual_price_per_seat"], fixed=True,
        )
        term_end = dv.term_end(F.col("order_date"))
        status = dv.term_status(F.col("order_date"), F.col("is_last"))
        return priced.withColumn("status", status).select(
            _id(TERM, "ok").alias("subscription_id"),
            _id(CUSTOMER, "k").alias("customer_id"),
            "plan_id",
            "seats",
            F.col("order_date").alias("term_start"),
            term_end.alias("term_end"),
            F.col("annual_price_per_seat").alias("price_per_seat"),
            dv.term_acv(F.col("seats"), F.col("annual_price_per_seat")).alias("acv"),
            _id(ORDER, "ok").alias("order_id"),
            F.when(F.col("previous_seq").isNotNull(), _id(TERM, "previous_seq")).alias("renewed_from_subscription_id"),
            "status",
            F.when(F.col("status") == "churned", term_end).alias("cancelled_at"),
        )

    def _app_db_invoices(self) -> DataFrame:
        key = _key(ORDER, "order_id")
        bad = key % 25 == 0
        return (
            dv.invoice_schedule(self.staged("orders"))
            .select(
                _id("inv_", key).alias("invoice_id"),
                "order_id",
                "billed_date",
                "due_date",
                F.when(~bad, F.date_add(F.col("order_date"), (27 + key % 15).cast("int"))).alias("collected_date"),
                "amount",
                bad.alias("is_bad_debt"),
                _id("sfc_", _key(CUSTOMER, "customer_id")).alias("salesforce_customer_id"),
            )
        )

    def _app_db_revenue_recognition(self) -> DataFrame:
        return dv.recognition_schedule(self.staged("orders"))

    def _stripe_refunds(self) -> DataFrame:
        key = _key(ORDER, "order_id")
        refunded = (
            self.staged("orders")
            .filter((F.col("channel") != "business_subscription") & (key % 17 == 0))
            .select(
                "order_id",
                "customer_id",
                F.date_add(F.col("order_date"), (3 + key % 42).cast("int")).alias("refund_date"),
                F.col("net_amount").alias("refund_amount"),
            )
        )
        history = self._stripe_aliases().withColumnRenamed("app_db_customer_id", "customer_id")
        named = as_of_lookup(
            refunded, history, key="customer_id", date="refund_date",
            since="created_at", take=["stripe_customer_id"],
        )
        return named.select(
            _id("ref_", key).alias("refund_id"), "order_id", "refund_date", "refund_amount", "stripe_customer_id"
        )

    # -- customers and their aliases ------------------------------------------------------
    def _app_db_customers(self) -> DataFrame:
        rollup = dv.customer_rollup(self.staged("orders"))
        k = F.col("c_custkey")
        account = (
            F.when(k % 67 == 3, F.lit("test")).when(k % 101 == 7, F.lit("internal")).otherwise(F.lit("customer"))
        )
        segment = (
            F.when(~F.coalesce("is_business", F.lit(False)), F.lit("consumer"))
            .when(F.col("c_mktsegment").isin("MACHINERY", "BUILDING"), F.lit("enterprise"))
            .otherwise(F.lit("smb"))
        )
        start = day(config.TIMELINE_START)
        created = F.when(F.col("account_type") == "internal", start).otherwise(
            F.coalesce("first_date", F.date_add(start, (k % 2190).cast("int")))
        )
        return (
            self.read("customer")
            .withColumn("customer_id", _id(CUSTOMER, "c_custkey"))
            .join(rollup, "customer_id", "left")
            .withColumn("account_type", account)
            .select(
                F.col("customer_id").alias("app_db_customer_id"),
                created.alias("created_at"),
                segment.alias("segment"),
                "account_type",
                F.coalesce("first_channel", F.lit("signup")).alias("acquisition_channel"),
            )
        )

    def _first_seen(self, *channels: str) -> DataFrame:
        seen = dv.source_first_seen(self.staged("orders"), *channels)
        return seen.withColumn("k", _key(CUSTOMER, "customer_id"))

    def _stripe_aliases(self) -> DataFrame:
        """Initial Stripe id per customer plus the id of a re-created account."""
        first = self._first_seen(*config.CONSUMER_CHANNELS)
        moved = F.when(F.col("k") % 16 == 5, F.expr("date_add(created_at, cast(200 + k % 300 as int))"))
        first = first.withColumn("moved_at", moved)
        old = F.struct(
            _id("cus_", "k").alias("stripe_customer_id"),
            F.col("created_at").alias("created_at"),
            F.col("moved_at").isNull().alias("is_active"),
            F.col("moved_at").alias("deactivated_at"),
        )
        new = F.struct(
            _id("cus_r_", "k").alias("stripe_customer_id"),
            F.col("moved_at").alias("created_at"),
            F.lit(True).alias("is_active"),
            F.lit(None).cast("date").alias("deactivated_at"),
        )
        rows = F.when(F.col("moved_at").isNull(), F.array(old)).otherwise(F.array(old, new))
        return first.select(F.col("customer_id").alias("app_db_customer_id"), F.inline(rows))

    def _stripe_customers(self) -> DataFrame:
        return self._stripe_aliases()

    def _shopify_customers(self) -> DataFrame:
        return self._first_seen("d2c").select(
            _id("shp_", "k").alias("shopify_customer_id"), "created_at", F.lit(True).alias("is_active")
        )

    def _salesforce_customers(self) -> DataFrame:
        return self._first_seen("business_subscription").select(
            _id("sfc_", "k").alias("salesforce_customer_id"), "created_at", F.lit(True).alias("is_active")
        )

    def complete_crosswalk(self) -> DataFrame:
        """Every alias with its customer, before any link is lost in the migration."""
        customers = self.staged("app_customers").select("app_db_customer_id", F.col("created_date").alias("app_created"))

        def alias(system: str, table: str, col: str, prefix: str) -> DataFrame:
            return self.staged(table).select(
                F.lit(system).alias("source_system"),
                F.col(col).alias("source_customer_id"),
                _key(prefix, f"replace({col}, 'cus_r_', 'cus_')").alias("k"),
                F.col("created_date").alias("source_created"),
            )

        aliases = alias("app_db", "app_customers", "app_db_customer_id", CUSTOMER)
        for system, prefix in (("stripe", "cus_"), ("shopify", "shp_"), ("salesforce", "sfc_")):
            aliases = aliases.unionByName(alias(system, f"{system}_customers", f"{system}_customer_id", prefix))
        system, created = F.col("source_system"), F.col("source_created")
        return (
            aliases.withColumn("app_db_customer_id", _id(CUSTOMER, "k"))
            .join(customers, "app_db_customer_id")
            .withColumn("linked_at", dv.linked_date(system, created, F.col("app_created"), F.col("k") % 31))
            .withColumn("link_method", dv.link_method(system, created))
        )

    def _app_db_customer_id_crosswalk(self) -> DataFrame:
        lost = dv.is_migrated(F.col("source_system"), F.col("source_created")) & (F.col("k") % 8 == 2)
        return self.complete_crosswalk().filter(~lost)

    # -- media and support ------------------------------------------------------------------
    def _ads_daily_spend(self) -> DataFrame:
        platform = F.element_at(
            F.array(*[F.lit(p) for p in config.PLATFORMS]), (F.col("user_id") % 3 + 1).cast("int")
        )
        clicks = F.count_if(F.col("event_type") == "click")
        return (
            self.read("events")
            .groupBy(
                F.add_months(day(F.col("ts")), -288).alias("spend_date"), platform.alias("platform")
            )
            .agg(
                F.sum(money("value")).alias("spend_usd"),
                (30 * clicks).alias("impressions"),
                clicks.alias("clicks"),
                F.count_if(F.col("event_type") == "signup").alias("reported_conversions"),
            )
        )

    def _zendesk_tickets(self) -> DataFrame:
        population = self.read("customer").agg(F.count(F.lit(1)).alias("c"))
        errors = (
            self.read("events")
            .filter(F.col("event_type") == "error")
            .select("event_id", (F.col("event_id") % population.scalar()).alias("k"))
            .select(
                "event_id",
                _id(CUSTOMER, "k").alias("customer_id"),
                F.date_add(day("1996-01-01"), ((F.col("event_id") * 7) % 2000).cast("int")).alias("created_at"),
            )
        )
        firsts = (
            self.staged("orders")
            .groupBy("customer_id")
            .agg(F.min_by("order_id", F.struct("order_date", _key(ORDER, "order_id"))).alias("related_order_id"))
        )
        terms = (
            self.staged("subscriptions")
            .groupBy("customer_id")
            .agg(
                F.min_by("subscription_id", F.struct("term_start_date", _key(TERM, "subscription_id"))).alias(
                    "related_subscription_id"
                )
            )
        )
        links = self.staged("customer_id_crosswalk")
        salesforce = links.filter(F.col("source_system") == "salesforce").select(
            F.col("app_db_customer_id").alias("customer_id"), F.col("source_customer_id").alias("sf_id")
        )
        stripe = (
            links.filter(F.col("source_system") == "stripe")
            .join(
                self.staged("stripe_customers"), F.col("source_customer_id") == F.col("stripe_customer_id")
            )
            .select(F.col("app_db_customer_id").alias("customer_id"), "stripe_customer_id", "created_date")
        )
        segments = self.staged("app_customers").select(F.col("app_db_customer_id").alias("customer_id"), "segment")
        # Everything about a customer comes together first, one row per Stripe id in force, so
        # that the tickets (of which one customer may have very many) are joined only once.
        contacts = segments
        for side in (salesforce, firsts, terms, effective_intervals(stripe, "customer_id", "created_date")):
            contacts = contacts.join(side, "customer_id", "left")
        who = within(
            errors, contacts, key="customer_id", date="created_at",
            take=["stripe_customer_id", "segment", "sf_id", "related_order_id", "related_subscription_id"],
        )
        system = dv.requester_system(F.col("segment"), F.col("sf_id"), F.col("stripe_customer_id"))
        resolved = F.expr("date_add(created_at, cast(event_id % 15 as int))")
        resolved = F.when(resolved <= day(config.TIMELINE_END), resolved)
        slot = F.col("event_id") % 20
        priority = (
            F.when(slot == 0, F.lit("urgent"))
            .when(slot <= 3, F.lit("high"))
            .when(slot <= 11, F.lit("normal"))
            .otherwise(F.lit("low"))
        )
        return who.withColumn("system", system).select(
            _id("zd_", "event_id").alias("ticket_id"),
            F.col("system").alias("requester_source_system"),
            F.when(F.col("system") == "salesforce", F.col("sf_id"))
            .when(F.col("system") == "stripe", F.col("stripe_customer_id"))
            .otherwise(F.col("customer_id"))
            .alias("requester_source_id"),
            "created_at",
            F.element_at(
                F.array(*[F.lit(c) for c in config.TICKET_CATEGORIES]), (F.col("event_id") % 6 + 1).cast("int")
            ).alias("category"),
            priority.alias("priority"),
            F.when(resolved.isNull(), F.lit("open")).otherwise(F.lit("solved")).alias("status"),
            resolved.alias("resolved_at"),
            "related_order_id",
            "related_subscription_id",
        )
