"""The customer table kept up to date by merging the partial aggregates of new facts.

A customer's partial row holds counts, cents, the least place of an order with its priority, the last day,
line and event counts, and the set of bought part types. Two partial rows of a customer merge into
one without looking at facts again. The store keeps them bucketed by customer: a merge shuffles the new
partials alone, and each batch of facts gives a new generation of the table, so readers never see half of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.session import shared_dir
from valuegrain.sources.facts import ENGAGED_EVENTS, MONEY_UNIT, customer_columns, first_order, priority_code

SUMS = ("total_orders", "cents", "lines", "returned", "engaged", "events")
NO_TYPES = "array<string>"


def partial_aggregates(facts: dict[str, DataFrame], owners: DataFrame) -> DataFrame:
    """One mergeable row per customer of new orders, lines and events.

    ``owners`` (o_orderkey, o_custkey) covers the orders of the new lines, which may be older than the lines.
    Rows without a customer are left out, as in the whole table; empty facts give no rows.
    """
    orders = facts["orders"].select(
        "o_custkey",
        "o_orderkey",
        F.to_date("o_orderdate").alias("day"),
        priority_code("o_orderpriority").alias("priority"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    placed = first_order("day", "o_orderkey")
    bought = orders.groupBy("o_custkey").agg(
        F.count("o_orderkey").alias("total_orders"),
        F.sum("cents").alias("cents"),
        F.min(placed).alias("first_place"),
        F.min_by("priority", placed).alias("first_priority"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )
    lines = facts["lineitem"].select("l_orderkey", "l_partkey", (F.col("l_returnflag") == "R").cast("long").alias("back"))
    owners = owners.select("o_orderkey", F.col("o_custkey").alias("owner"))
    types = facts["part"].select("p_partkey", "p_type")
    # Lines are first reduced to one row per customer and type.
    per_type = (
        lines.join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(types, F.col("l_partkey") == F.col("p_partkey"), "left")
        .groupBy("owner", "p_type")
        .agg(F.count(F.lit(1)).alias("lines"), F.sum("back").alias("returned"))
    )
    shipped = per_type.groupBy("owner").agg(
        F.sum("lines").alias("lines"),
        F.sum("returned").alias("returned"),
        F.sort_array(F.collect_set("p_type")).alias("types"),
    )
    seen = facts["events"].groupBy("user_id").agg(
        F.count_if(F.col("event_type").isin(*ENGAGED_EVENTS)).alias("engaged"), F.count(F.lit(1)).alias("events")
    )
    key = lambda df, name: df.withColumnRenamed(name, "custkey").filter("custkey is not null")
    joined = key(bought, "o_custkey").join(key(shipped, "owner"), "custkey", "full")
    joined = joined.join(key(seen, "user_id"), "custkey", "full")
    filled = {c: F.coalesce(c, F.lit(0)).cast("long") for c in SUMS}
    return joined.withColumns(filled | {"types": F.coalesce("types", F.array().cast(NO_TYPES))})


def merge_partials(old: DataFrame, new: DataFrame) -> DataFrame:
    """The partial rows of both, one per customer. Each side has one row per customer."""
    a, b = old.alias("a"), new.alias("b")
    met = a.join(b, F.col("a.custkey") == F.col("b.custkey"), "full")
    pick = lambda f, c: f(F.col(f"a.{c}"), F.col(f"b.{c}"))
    earlier = F.col("b.first_place").isNull() | (F.col("a.first_place") <= F.col("b.first_place"))
    none: Column = F.array().cast(NO_TYPES)
    types = F.array_union(F.coalesce("a.types", none), F.coalesce("b.types", none))
    merged = {
        "custkey": pick(F.coalesce, "custkey"),
        **{c: F.coalesce(f"a.{c}", F.lit(0)) + F.coalesce(f"b.{c}", F.lit(0)) for c in SUMS},
        "first_place": pick(F.least, "first_place"),
        "first_priority": F.when(earlier, F.col("a.first_priority")).otherwise(F.col("b.first_priority")),
        "first_day": pick(F.least, "first_day"),
        "last_day": pick(F.greatest, "last_day"),
        "types": F.sort_array(types),
    }
    return met.select(*[column.alias(name) for name, column in merged.items()])


def customers_of(partials: DataFrame, buyers: DataFrame, money_unit: float = MONEY_UNIT) -> DataFrame:
    """The customer table of merged partial rows, as of the newest order; buyers are the customer facts."""
    snapshot = partials.select(F.max("last_day")).scalar()
    buyers = buyers.select("c_custkey", "c_acctbal", "c_mktsegment")
    # A customer without lines has unknown types, one whose parts are unknown has none.
    lined = F.col("lines") > 0
    columns = {
        "product_categories": F.when(lined, F.col("types")),
        "num_categories": F.when(lined, F.size("types")),
        "email_engagement_rate": F.when(F.col("events") > 0, F.col("engaged") / F.col("events")),
        "return_rate": F.when(lined, F.col("returned") / F.col("lines")),
    }
    joined = partials.filter("total_orders > 0").join(buyers, F.col("custkey") == F.col("c_custkey")).withColumns(columns)
    joined = joined.withColumnRenamed("custkey", "o_custkey")
    return joined.select(*customer_columns(snapshot, money_unit), "email_engagement_rate", "return_rate")


class CustomerStore:
    """Generations of a bucketed table of partial rows, one for each batch of facts, numbered from 1."""

    def __init__(self, spark: SparkSession, name: str, buckets: int):
        self.spark, self.name, self.buckets = spark, name, buckets

    def table(self, batch: int) -> str:
        return f"{self.name}_{batch}"

    def merge_in(self, partials: DataFrame, batch: int) -> DataFrame:
        """The partial rows up to this batch; a batch that was merged already is not merged twice."""
        if not self.spark.catalog.tableExists(self.table(batch)):
            if batch > 1:
                partials = merge_partials(self.spark.table(self.table(batch - 1)), partials)
            # A fresh folder: what a failed attempt left behind is never read.
            path = shared_dir(self.spark, self.table(batch))
            bucketed = partials.write.bucketBy(self.buckets, "custkey").sortBy("custkey").option("path", path)
            bucketed.saveAsTable(self.table(batch))
        return self.spark.table(self.table(batch))

    def forget(self, batch: int) -> None:
        """Take a generation out of the catalogue; its files stay until the shared folder is emptied."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table(batch)}")
