"""Merging partial aggregates of facts."""

from itertools import permutations

from pyspark.sql import functions as F

from valuegrain.sources.facts import build_customers
from valuegrain.sources.increments import CustomerStore, customers_of, merge_partials, partial_aggregates


def parts(facts, n):
    """The facts dealt into n batches, lines apart from their orders."""
    keys = {"orders": "o_orderkey", "lineitem": "l_partkey", "events": "user_id"}
    deal = lambda name, i: facts[name].where(F.pmod(F.xxhash64(keys[name]), F.lit(n)) == i)
    return [partial_aggregates(facts | {name: deal(name, i) for name in keys}, facts["orders"]) for i in range(n)]


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_merging_in_any_order_equals_the_whole(spark, space):
    facts = space.facts
    want = rows(build_customers(facts))
    for a, b, c in permutations([p.cache() for p in parts(facts, 3)]):
        assert rows(customers_of(merge_partials(merge_partials(a, b), c), facts["customer"])) == want


def test_the_store_shuffles_new_rows_alone_and_merges_a_batch_once(spark, space):
    facts = space.facts
    one, two = parts(facts, 2)
    store = CustomerStore(spark, "partials_test", 4)
    store.merge_in(one, 1)
    merged = rows(store.merge_in(two, 2))
    assert rows(store.merge_in(two, 2)) == merged
    assert rows(customers_of(store.merge_in(two, 2), facts["customer"])) == rows(build_customers(facts))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        fresh = spark.createDataFrame(two.collect(), two.schema)
        plan = merge_partials(spark.table(store.table(1)), fresh)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 1 and "Bucketed: true" in plan
    for batch in (1, 2):
        store.forget(batch)


def test_no_new_facts_change_nothing(spark, space):
    facts = space.facts
    none = facts | {name: facts[name].limit(0) for name in ("orders", "lineitem", "events")}
    whole, empty = parts(facts, 1)[0], partial_aggregates(none, facts["orders"])
    assert empty.isEmpty() and customers_of(empty, facts["customer"]).isEmpty()
    want = rows(whole)
    for a, b in ((whole, empty), (empty, whole)):
        assert rows(merge_partials(a, b).select(*whole.columns)) == want


def test_users_without_orders_wait_for_them(spark, space):
    facts = space.facts
    early = facts | {name: facts[name].limit(0) for name in ("orders", "lineitem")}
    seen = partial_aggregates(early, facts["orders"])
    assert not seen.isEmpty() and customers_of(seen, facts["customer"]).isEmpty()
    late = partial_aggregates(facts | {"events": facts["events"].limit(0)}, facts["orders"])
    assert rows(customers_of(merge_partials(seen, late), facts["customer"])) == rows(build_customers(facts))
