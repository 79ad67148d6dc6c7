import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import plain
from tests.llm.conftest import SF
from valuegrain.llm.queries import ORACLES, QUERIES


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "near-duplicates", "personal data", "source mix", "packing"]
    good = stages["quality rules"](spark, docs, SF)
    assert all(not plain.quality_counts(r.text)[5] for r in good.collect())
    single = stages["near-duplicates"](spark, good, SF)
    prints = sorted(plain.fingerprint(r.text) for r in single.collect())
    assert all((a ^ b).bit_count() > 3 for i, a in enumerate(prints) for b in prints[i + 1 :])
    clean = stages["personal data"](spark, single, SF)
    assert clean.count() == single.count()
    mixed = stages["source mix"](spark, clean, SF)
    assert docs.columns == good.columns == single.columns == clean.columns == mixed.columns
    packed = stages["packing"](spark, mixed, SF)
    assert packed.groupBy("sequence_id").agg(F.sum("length").alias("n")).filter("n > 1024").count() == 0
    whole = mixed.groupBy("doc_id").count().count()
    assert packed.select("doc_id").distinct().count() == whole


def test_run_gives_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_their_sql(spark, name):
    from check import compare, connect

    got = QUERIES[name](spark, SF).toPandas()
    assert compare(got, connect(SF).execute(ORACLES[name]).df()) == "ok"
