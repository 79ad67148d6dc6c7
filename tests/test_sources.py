from pyspark.sql import functions as F

from valuegrain.operators.validate import with_violations
from valuegrain.plans.jobs import feature_job
from valuegrain.operators.profile import Profile
from valuegrain.schema import CUSTOMER_SCHEMA
from valuegrain.sources.facts import build_customers
from valuegrain.sources.files import category_count, read_customers_csv, write_features_csv
from valuegrain.streaming.scoring import customer_stream, route_stream

CSV = '''customer_id,first_purchase_date,total_orders,total_spent,product_categories,campaign_type,extra
C1,2024-02-29,3,12.5,"[""Home"", ""Toys""]",None,x
C2,,1,,"[]",,y
'''


def test_csv_types_dates_lists_and_the_none_campaign(spark, tmp_path):
    path = tmp_path / "customers.csv"
    path.write_text(CSV)
    df = read_customers_csv(spark, str(path))
    kinds = dict(df.dtypes)
    assert kinds["first_purchase_date"] == "date"
    assert kinds["product_categories"] == "array<string>"
    assert (kinds["total_orders"], kinds["extra"]) == ("bigint", "string")
    one, two = df.withColumn("n", category_count("product_categories")).collect()
    assert (one.campaign_type, one.product_categories, one.n) == ("None", ["Home", "Toys"], 2)
    assert one.first_purchase_date.isoformat() == "2024-02-29"
    assert (two.campaign_type, two.total_spent, two.first_purchase_date) == (None, None, None)
    assert two.n == 0


def test_csv_round_trip(spark, space, tmp_path):
    path = str(tmp_path / "out")
    write_features_csv(space.customers, path)
    back = read_customers_csv(spark, path).select(*space.customers.columns)
    assert sorted(back.collect()) == sorted(space.customers.collect())


def test_customer_table_has_the_declared_types(space):
    declared = {f.name: f.dataType.simpleString() for f in CUSTOMER_SCHEMA}
    for name, kind in space.customers.dtypes:
        assert kind == declared[name], name


def test_training_table_sees_nothing_after_the_cutoff(space):
    labelled = space.labelled
    assert labelled.where("last_purchase_date >= '2000-01-01'").isEmpty()
    assert "email_engagement_rate" not in labelled.columns
    assert labelled.where("actual_clv < total_spent").isEmpty()
    early = {**space.facts, "orders": space.facts["orders"].where("o_orderdate < '2000-01-01'")}
    plain = build_customers(early, cutoff="2000-01-01")
    assert sorted(plain.collect()) == sorted(labelled.drop("actual_clv").collect())


def test_a_hot_customer_and_a_hot_part(spark):
    """One customer with most orders and one part on most lines."""
    orders = spark.range(600).select(
        F.col("id").alias("o_orderkey"),
        F.when(F.col("id") % 3 < 2, 1).otherwise(F.col("id")).cast("long").alias("o_custkey"),
        (F.col("id") * 1.25).alias("o_totalprice"),
        F.expr("timestamp_ntz'1999-01-01' + make_interval(0, 0, 0, cast(id as int))").alias(
            "o_orderdate"
        ),
        F.lit("1-URGENT").alias("o_orderpriority"),
    )
    lines = orders.select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.when(F.col("o_orderkey") % 4 == 0, 2).otherwise(1).cast("long").alias("l_partkey"),
        F.when(F.col("o_orderkey") % 2 == 0, "R").otherwise("N").alias("l_returnflag"),
    )
    facts = {
        "orders": orders,
        "lineitem": lines,
        "part": spark.createDataFrame([(1, "A"), (2, "B")], "p_partkey long, p_type string"),
        "customer": orders.select("o_custkey").distinct().select(
            F.col("o_custkey").alias("c_custkey"),
            F.lit(-5.0).alias("c_acctbal"),
            F.lit("AUTOMOBILE").alias("c_mktsegment"),
        ),
        "events": spark.createDataFrame([(1, "click"), (1, "view"), (None, "click")],
                                        "user_id long, event_type string"),
    }
    rows = {r.customer_id: r for r in build_customers(facts).collect()}
    assert len(rows) == 201
    hot = rows["CUST_000000000001"]
    mine = [i for i in range(600) if i % 3 < 2]
    assert hot.total_orders == 400
    assert hot.total_spent == sum(round(i * 125) for i in mine) / 500000.0
    assert (hot.product_categories, hot.num_categories) == (["A", "B"], 2)
    assert hot.return_rate == sum(i % 2 == 0 for i in mine) / 400
    assert (hot.email_engagement_rate, hot.acquisition_cost) == (0.5, 0.0)
    assert hot.campaign_type == "Retargeting"
    assert hot.days_since_first_purchase == 599


def test_feature_job_stores_features_and_profile(spark, space, tmp_path):
    space.customers.write.parquet(str(tmp_path / "in"))
    feature_job(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    stored = spark.read.parquet(str(tmp_path / "out" / "features"))
    assert len(stored.columns) == len(space.customers.columns) + 108
    profile = Profile.load(spark, str(tmp_path / "out" / "profile"))
    assert profile.rows == stored.count()
    assert profile.cuts == space.plan.profile.cuts


def test_stream_routing_equals_the_batch_split(spark, space, tmp_path):
    table = space.build(money_unit=1.0).repartition(3)
    source = str(tmp_path / "in")
    table.write.parquet(source)
    rows = customer_stream(spark, source, table.schema, files_per_batch=1)
    paths = [str(tmp_path / p) for p in ("valid", "bad", "state")]
    route_stream(rows, *paths).awaitTermination()
    checked = with_violations(spark.read.parquet(source))
    bad = spark.read.parquet(paths[1]).select("customer_id", "violations")
    expected = checked.where(F.size("violations") > 0).select("customer_id", "violations")
    assert sorted(bad.collect()) == sorted(expected.collect())
    assert spark.read.parquet(paths[0]).count() + bad.count() == table.count()
