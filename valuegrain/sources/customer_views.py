"""Scored customers stored for lookups, filters and search, in folders that a query can skip.

Rows lie in one folder for each segment and bucket of the customer id, sorted by id, with Parquet bloom
filters on it. A lookup reads the folders of one bucket, a segment's filter those of the segment.

Searching for a part of an id or source reads postings: one row for each distinct value and trigram in it, in
folders by trigram. A posting holds the value itself, so only the list of a term's rarest trigram is read
and each of its values is checked against the whole term. A source held by a third of all customers is one
value there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.errors import CustomerNotFound
from valuegrain.operators.clean import present_gaps
from valuegrain.operators.customers import filter_customers, search_customers, segment_column
from valuegrain.schema import ID
from valuegrain.session import shared_dir

SOURCE = "acquisition_source"
GRAM = 3
#: Customers of one bucket, and values of one folder of postings, that are aimed at.
BUCKET_ROWS = 1_000_000
MOST_BUCKETS = 1024
BLOOM = "parquet.bloom.filter"
#: Columns of the layout, dropped when rows are read.
BUCKET, PART = "id_bucket", "segment_part"
POSTINGS = f"kind string, value string, {BUCKET} int, gram string, folder int"


def bucket_of(value: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(buckets)).cast("int")


def grams_of(value: Column) -> Column:
    """The distinct trigrams of a text; none if it is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(value) - (GRAM - 1), F.lit(1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substr(value, i, F.lit(GRAM))))
    return F.filter(grams, lambda g: F.length(g) == GRAM)


def term_grams(term: str) -> list[str]:
    return sorted({term[i : i + GRAM] for i in range(len(term) - GRAM + 1)})


class CustomerViews:
    """A published table of scored customers and its postings, under one folder."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, schema: T.StructType):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.schema = T.StructType([*schema.fields]).add(PART, T.StringType()).add(BUCKET, T.IntegerType())

    @property
    def stored(self) -> DataFrame:
        """All rows with the columns of the layout."""
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/rows")

    @property
    def rows(self) -> DataFrame:
        return self.stored.drop(BUCKET, PART)

    def _postings(self, gram: str) -> DataFrame:
        """The values (kind, value, and the bucket of an id) that hold a trigram."""
        folder = self.spark.range(1).select(bucket_of(F.lit(gram), self.buckets)).first()[0]
        postings = self.spark.read.schema(POSTINGS).parquet(f"{self.path}/postings")
        return postings.where((F.col("folder") == folder) & (F.col("gram") == gram))

    def filtered(self, *, segment: str | None = None, **limits) -> DataFrame:
        """As filter_customers on the rows; a segment's filter skips the other segments' folders."""
        rows = self.stored
        if segment and segment_column(rows):
            rows = rows.where(F.col(PART) == _part(F.lit(segment)))
        return filter_customers(rows, segment=segment, **limits).drop(BUCKET, PART)

    def lookup(self, customer_id: str) -> DataFrame:
        """The rows of one customer, of which there is one where ids are unique, in one job over its bucket."""
        key = F.lit(customer_id)
        found = self.stored.where((F.col(BUCKET) == bucket_of(key, self.buckets)) & (F.col(ID) == key))
        return present_gaps(found.drop(BUCKET, PART))

    def find(self, customer_id: str) -> DataFrame:
        """As ``lookup``, already read; raises CustomerNotFound where there is no such customer."""
        found = self.lookup(customer_id)
        rows = found.collect()
        if not rows:
            raise CustomerNotFound(customer_id)
        return self.spark.createDataFrame(rows, found.schema)

    def matches(self, term: str) -> DataFrame | None:
        """The values (kind, value, id_bucket) that contain a term, whatever the case.

        None if the term is too short for postings. A trigram without postings, which only
        its entry in the counts tells, ends the search at once.
        """
        needle = term.lower()
        grams = term_grams(needle)
        if not grams:
            return None
        counts = self.spark.read.schema("gram string, n long").parquet(f"{self.path}/counts").where(F.col("gram").isin(grams))
        size = {r["gram"]: r["n"] for r in counts.collect()}  # at most one row for each of the term's trigrams
        rarest = min(grams, key=lambda g: (size.get(g, 0), g))
        found = self._postings(rarest).where(F.lower("value").contains(needle))
        return (found if rarest in size else found.where(F.lit(False))).select("kind", "value", BUCKET)

    def search(self, term: str, segment: str | None = None) -> DataFrame:
        """As search_customers on the rows; the rows read are those of the buckets of matching ids.

        Rows are scanned only for terms shorter than a trigram and where a source matches.
        """
        found = self.matches(term)
        if found is None:
            return search_customers(self.rows, term, segment)
        # At most MOST_BUCKETS numbers, and one row for the sources.
        places = found.groupBy("kind", BUCKET).count().collect()
        buckets = [r[BUCKET] for r in places if r["kind"] == "id"]
        rows = self.stored
        if segment and segment_column(rows):
            rows = rows.where(F.col(PART) == _part(F.lit(segment)))
        of = lambda kind, name: found.where(F.col("kind") == kind).select(F.col("value").alias(name))
        hits = rows.where(F.col(BUCKET).isin(buckets)).join(of("id", ID), ID, "left_semi")
        if any(r["kind"] == "source" for r in places):
            # A row whose id matches as well is among the hits already.
            others = rows.where(~F.coalesce(F.lower(ID).contains(term.lower()), F.lit(False)))
            hits = hits.unionByName(others.join(of("source", SOURCE), SOURCE, "left_semi"))
        order = self.rows.columns
        return present_gaps(filter_customers(hits, segment=segment).select(*order))


def _part(segment: Column) -> Column:
    """The folder's name of a segment; a segment that is null, empty or unusual keeps its rows apart by hash."""
    plain = segment.rlike("^[A-Za-z][A-Za-z0-9_-]*$")
    return F.when(plain, segment).otherwise(F.concat(F.lit("#"), F.hex(F.xxhash64(segment))))


def _postings_of(scored: DataFrame, buckets: int) -> DataFrame:
    """kind, value, id_bucket, gram and folder of every trigram of every distinct id and source."""
    none = F.lit(None).cast("int")
    entries = [F.struct(F.lit("id").alias("kind"), F.col(ID).alias("value"), bucket_of(F.col(ID), buckets).alias(BUCKET))]
    if SOURCE in scored.columns:
        entries.append(F.struct(F.lit("source").alias("kind"), F.col(SOURCE).alias("value"), none.alias(BUCKET)))
    values = scored.select(F.inline(F.array(*entries))).where("value is not null").distinct()
    spread = values.withColumn("gram", F.explode(grams_of(F.lower("value"))))
    return spread.withColumn("folder", bucket_of(F.col("gram"), buckets))


def publish_customers(scored: DataFrame, buckets: int | None = None, path: str | None = None) -> CustomerViews:
    """Store scored customers and their postings in a fresh folder.

    Missing ids and sources have no postings. Repeated rows stay; an empty table gives views without rows.
    A trigram that every id holds has as many postings as there are customers, so postings are dealt out
    by trigram and value, and a folder gets files from several tasks.
    """
    spark = scored.sparkSession
    path = path or shared_dir(spark, "customer-views")
    total = scored.count()
    if buckets is None:
        buckets = min(max(-(-total // BUCKET_ROWS), 1), MOST_BUCKETS)
    views = CustomerViews(spark, path, buckets, scored.schema)
    segment = segment_column(scored)
    part = _part(F.col(segment)) if segment else F.lit("all")
    placed = scored.withColumns({PART: part, BUCKET: F.coalesce(bucket_of(F.col(ID), buckets), F.lit(0))})
    # One task may write several folders, and a large folder is written by several tasks.
    rows = placed.repartitionByRange(PART, BUCKET, ID).sortWithinPartitions(PART, BUCKET, ID)
    filters = {f"{BLOOM}.enabled#{ID}": "true", f"{BLOOM}.expected.ndv#{ID}": str(max(total // buckets, 1))}
    rows.write.options(**filters).partitionBy(PART, BUCKET).parquet(f"{path}/rows")
    postings = _postings_of(scored, buckets)
    dealt = postings.repartitionByRange("folder", "gram", "value").sortWithinPartitions("folder", "gram", "value")
    dealt.write.partitionBy("folder").parquet(f"{path}/postings")
    stored = spark.read.schema(POSTINGS).parquet(f"{path}/postings")
    counts = stored.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    counts.repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/counts")
    return views
