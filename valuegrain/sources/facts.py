"""Build the customer table from order, line, part, customer and event facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FACT_TABLES = ("customer", "orders", "lineitem", "part", "events")

# Fixed mapping of the fact vocabulary to the customer vocabulary.
SOURCE_OF_MARKET = {
    "AUTOMOBILE": "Meta Ads",
    "BUILDING": "Google Ads",
    "FURNITURE": "Email",
    "HOUSEHOLD": "Organic",
    "MACHINERY": "Referral",
}
CAMPAIGN_OF_PRIORITY = {"1-URGENT": "Retargeting", "2-HIGH": "Brand"}
ENGAGED_EVENTS = ("click", "purchase")
PAID_SOURCES = ("Meta Ads", "Google Ads")

MONEY_UNIT = 5000.0
COST_UNIT = 100.0
ORDER_KEYS = 2**63


def read_facts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}.parquet") for name in FACT_TABLES}


def _choose(column: Column, mapping: dict, otherwise: str) -> Column:
    chosen = F.lit(otherwise)
    for key, value in mapping.items():
        chosen = F.when(column == key, value).otherwise(chosen)
    return chosen


def build_customers(
    facts: dict[str, DataFrame],
    *,
    cutoff: str | None = None,
    money_unit: float = MONEY_UNIT,
    with_target: bool = False,
) -> DataFrame:
    """One row per customer with at least one order in the observation window.

    Without ``cutoff`` the window is every order and the snapshot date is the
    newest order date. With ``cutoff`` the window ends before that date, which is
    also the snapshot, and engagement events are left out because they may lie
    after it; ``with_target`` then adds lifetime spend as ``actual_clv``.

    Money is summed as whole cents, so totals are the same for every partitioning.
    Aggregations combine before they shuffle; joins carry no broadcast hints, so
    the size checks and the skew handling of adaptive execution decide.
    """
    # The window tests the stored column, so it reaches the scan as a pushed filter.
    ordered = facts["orders"]["o_orderdate"]
    in_window = F.lit(True)
    if cutoff is not None:
        stored_type = facts["orders"].schema["o_orderdate"].dataType
        in_window = ordered < F.lit(cutoff).cast(stored_type)
    orders = facts["orders"].select(
        "o_orderkey",
        "o_custkey",
        priority_code("o_orderpriority").alias("priority"),
        F.to_date("o_orderdate").alias("day"),
        in_window.alias("in_window"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    observed = orders if cutoff is None else orders.where("in_window")
    if cutoff is None:
        newest = facts["orders"].select(F.to_date(F.max("o_orderdate")).alias("day"))
        snapshot = newest.scalar()
    else:
        snapshot = F.lit(cutoff).cast("date")

    # A target spans the whole history, so its window is applied inside the aggregate.
    spans_history = cutoff is not None and with_target
    source = orders if spans_history else observed

    def windowed(column: Column) -> Column:
        return F.when(F.col("in_window"), column) if spans_history else column

    # Numbers of fixed width keep this a hash aggregate: the first order is the one of the
    # smallest (day, order key), packed into one decimal, and its priority is a code.
    placed = first_order("day", "o_orderkey")
    order_facts = source.groupBy("o_custkey").agg(
        F.count(windowed(F.col("o_orderkey"))).alias("total_orders"),
        F.sum(windowed(F.col("cents"))).alias("cents"),
        F.sum("cents").alias("lifetime_cents"),
        F.max(windowed(F.col("day"))).alias("last_day"),
        F.min(windowed(F.col("day"))).alias("first_day"),
        F.min_by("priority", windowed(placed)).alias("first_priority"),
    )
    if spans_history:
        order_facts = order_facts.where("total_orders > 0")

    line_facts = _line_facts(facts, observed)
    buyers = facts["customer"].select("c_custkey", "c_acctbal", "c_mktsegment")
    joined = order_facts.join(buyers, F.col("o_custkey") == F.col("c_custkey")).join(
        line_facts, "o_custkey", "left"
    )
    if cutoff is None:
        joined = joined.join(
            _email_facts(facts), F.col("o_custkey") == F.col("user_id"), "left"
        )

    columns = customer_columns(snapshot, money_unit)
    if cutoff is None:
        columns.append(F.col("email_engagement_rate"))
    columns.append(F.col("return_rate"))
    if with_target:
        lifetime = F.col("lifetime_cents").cast("double") / F.lit(100.0 * money_unit)
        columns.append(lifetime.alias("actual_clv"))
    return joined.select(*columns)


def first_order(day: str, order: str) -> Column:
    """The place of an order in time: (day, order key) as one decimal of fixed width."""
    return F.unix_date(day).cast("decimal(10,0)") * F.lit(str(ORDER_KEYS)).cast("decimal(20,0)") + F.col(order).cast(
        "decimal(20,0)"
    )


def priority_code(priority: str) -> Column:
    """An order's priority as the number of its campaign."""
    code = F.lit(len(CAMPAIGN_OF_PRIORITY))
    for number, name in enumerate(CAMPAIGN_OF_PRIORITY):
        code = F.when(F.col(priority) == name, number).otherwise(code)
    return code


def customer_columns(snapshot: Column, money_unit: float) -> list[Column]:
    """The customer's columns, but those of events and returns, from its aggregates."""
    spent = F.col("cents").cast("double") / F.lit(100.0 * money_unit)
    first_day = F.col("first_day")
    campaigns = dict(enumerate(CAMPAIGN_OF_PRIORITY.values()))
    acquired_by = _choose(F.col("c_mktsegment"), SOURCE_OF_MARKET, "Direct")
    campaign = F.when(
        acquired_by.isin(*PAID_SOURCES),
        _choose(F.col("first_priority"), campaigns, "Prospecting"),
    ).otherwise("None")
    return [
        F.format_string("CUST_%012d", "o_custkey").alias("customer_id"),
        first_day.alias("first_purchase_date"),
        F.col("last_day").alias("last_purchase_date"),
        F.col("total_orders"),
        spent.alias("total_spent"),
        (spent / F.col("total_orders")).alias("avg_order_value"),
        F.datediff(snapshot, first_day).alias("days_since_first_purchase"),
        F.datediff(snapshot, F.col("last_day")).alias("days_since_last_purchase"),
        F.col("product_categories"),
        F.col("num_categories"),
        acquired_by.alias("acquisition_source"),
        campaign.alias("campaign_type"),
        (F.greatest(F.col("c_acctbal"), F.lit(0.0)) / COST_UNIT).alias("acquisition_cost"),
    ]


def _line_facts(facts: dict[str, DataFrame], observed: DataFrame) -> DataFrame:
    """Return share and the bought part types of each customer.

    The two-step grouping first reduces lines to one row per customer and type with
    partial sums; the second step then sees at most one row per type.
    """
    lines = facts["lineitem"].select(
        "l_orderkey",
        "l_partkey",
        (F.col("l_returnflag") == "R").cast("long").alias("returned"),
    )
    owners = observed.select("o_orderkey", "o_custkey")
    types = facts["part"].select("p_partkey", "p_type")
    per_type = (
        lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(types, F.col("l_partkey") == F.col("p_partkey"), "left")
        .groupBy("o_custkey", "p_type")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("returned").alias("returned"))
    )
    return per_type.groupBy("o_custkey").agg(
        (F.sum("returned") / F.sum("lines")).alias("return_rate"),
        F.sort_array(F.collect_set("p_type")).alias("product_categories"),
        F.count("p_type").cast("int").alias("num_categories"),
    )


def _email_facts(facts: dict[str, DataFrame]) -> DataFrame:
    engaged = F.col("event_type").isin(*ENGAGED_EVENTS)
    return (
        facts["events"]
        .where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg((F.count_if(engaged) / F.count(F.lit(1))).alias("email_engagement_rate"))
    )
