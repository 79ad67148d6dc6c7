"""Mixing sources to target weights by hash-random order and distributed prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.llm.nativewords import count_words, words
from valuegrain.llm.tables import fresh, let, stored

#: Weights of the sources in order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix has this share of all words.
BUDGET = 1.5
#: No source is taken more often than this.
EPOCHS = 2
#: Hexadecimal digits of the key that make a bucket: 4096 ranges of the keys of each source.
DIGITS = 3


def _key() -> Column:
    """A random-looking key of a row that is the same in every run."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "source", "text")]
    return F.md5(F.concat_ws(":", *parts))


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """The sources with their weights by rank: by code point, null last.

    Ranks come from a range sort, ranks inside its parts and the parts' counts, so the sources
    may be many.
    """
    ordered = sizes.withColumn("last", F.col("source").isNull()).orderBy("last", "source")
    ordered = stored(ordered.withColumn("part", F.spark_partition_id()), "sources")
    counts = ordered.groupBy("part").agg(F.count("*").alias("n"))
    before = F.expr("sum(n) over (order by part rows between unbounded preceding and 1 preceding)")
    bases = counts.select("part", F.coalesce(before, F.lit(0)).alias("base"))
    own = F.expr("row_number() over (partition by part order by last, source) - 1")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("rank", F.lit(len(WEIGHTS))) + 1).cast("int"))
    ranked = ordered.withColumn("own", own).join(bases, "part").withColumn("rank", F.col("base") + F.col("own"))
    return ranked.select("source", "source_size", "rank", weight.cast("long").alias("weight"))


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size and target of each source of (source, source_size).

    The budget is shared by weight. Sources above EPOCHS times their size stop there, and their
    excess is shared among the others by weight, until none is above. Each round is one aggregate
    with one row; a share only grows, so a source that stopped stays so.
    """
    ranked = stored(ranked_sources(sizes), "ranked-sources")
    cap = F.lit(EPOCHS) * F.col("source_size")
    budget = BUDGET * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    capped = {None: None}
    share: Column = F.lit(0.0)
    full: Column = F.lit(False)
    while True:
        # Words left over and weights of the sources that don't stop.
        now = ranked.agg(
            F.coalesce(F.sum(F.when(full, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))
        ).first()
        left, weights = budget - now[0], now[1]
        if capped == now or not weights:
            break
        capped = now
        share = F.lit(float(left)) * F.col("weight") / F.lit(weights)
        full = share > cap
    target = F.when(full, cap.cast("double")).otherwise(share)
    return ranked.select("source", "source_size", target.alias("target"))


def _rest(docs: DataFrame) -> Column:
    """A hash of all columns but the text: rows alike in it and in their key are alike in all columns."""
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "text"]
    return F.xxhash64(F.to_json(F.struct(*others)))


def mix(docs: DataFrame, rest: Column | None = None) -> DataFrame:
    """doc_id, size, source, source_size, target, taken of every row, and the words its epochs take.

    ``first`` and ``again`` are the words taken in the first and the second pass over a source;
    ``taken`` is their sum. Rows of a source stand in the order of their keys; the epochs run over
    that order until the target, rounded to whole words, is reached, so the row at the end is
    taken in part and the words taken are the target exactly. Equal rows have equal keys and sizes, so the
    result doesn't depend on their order. Null text has size zero and is never taken. Null
    sources are one source, the last. An empty table gives no rows. ``rest`` tells rows of equal
    keys apart and is returned as well.
    """
    told = [] if rest is None else [rest.alias("rest")]
    rows = stored(
        docs.select("doc_id", "source", count_words(F.col("text")).alias("size"), _key().alias("key"), *told),
        "sizes",
    ).withColumn("bucket", F.substring("key", 1, DIGITS))
    buckets = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    buckets = buckets.withColumn(
        "before",
        F.expr("sum(words) over (partition by source order by bucket rows between unbounded preceding and 1 preceding)"),
    ).withColumn("before", F.coalesce("before", F.lit(0)))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    t, b = targets.alias("t"), buckets.alias("b")
    starts = b.join(t, F.col("b.source").eqNullSafe(F.col("t.source"))).select(
        F.col("b.source").alias("its_source"), F.col("b.bucket").alias("its_bucket"), "before", "source_size", "target"
    )
    names = ["rest"] if told else []
    inside = F.expr(
        f"coalesce(sum(size) over (partition by source, bucket order by {', '.join(['key', 'size', *names])}"
        " rows between unbounded preceding and 1 preceding), 0)"
    )
    placed = rows.withColumn("inside", inside).join(
        starts, F.col("source").eqNullSafe(F.col("its_source")) & (F.col("bucket") == F.col("its_bucket"))
    )
    budget = F.round("target").cast("long")
    at = F.col("before") + F.col("inside")

    def part(epoch: int) -> Column:
        left = budget - epoch * F.col("source_size") - at
        return F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), left))

    parts = placed.withColumn("first", part(0)).withColumn("again", part(1))
    return parts.select(
        "doc_id", "size", "source", "source_size", "target", (F.col("first") + F.col("again")).alias("taken"),
        "first", "again", "key", *names,
    )


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows the mix takes, once for each epoch that takes them, with their columns.

    A row taken in part keeps its first words, joined by one space, however long it is; ``n_chars``
    follows the text where the table has it. Rows that agree in id, source and text but not in
    other columns are taken each for itself. Null and blank texts have no words, so they aren't
    taken; an empty table gives no rows.
    """
    key = fresh(docs, "key")
    rows = docs.withColumn(key, _key())
    rest = fresh(rows, "rest")
    rows = rows.withColumn(rest, _rest(docs))
    # Rows equal in all columns share key and rest: one of them is joined, with as many copies as the mix takes.
    parts = mix(docs, _rest(docs)).select("key", "rest", F.explode(F.array("first", "again")).alias("words"), "size")
    parts = parts.filter("words > 0").groupBy("key", "rest", "words", "size").agg(F.count("*").alias("copies"))
    one = rows.dropDuplicates([key, rest])
    name = fresh(one, "mixed")
    taken = parts.select(F.col("key").alias(key), F.col("rest").alias(rest), F.struct("words", "size", "copies").alias(name))
    joined = one.join(taken, [key, rest])
    cut = let(words(F.col("text")), lambda w: F.array_join(F.slice(w, 1, F.col(name)["words"]), " "))
    whole = F.col(name)["words"] >= F.col(name)["size"]
    out = joined.withColumn("text", F.when(whole, F.col("text")).otherwise(cut))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length("text").cast(kind)))
    again = fresh(out, "copy")
    out = out.withColumn(again, F.explode(F.sequence(F.lit(1), F.col(name)["copies"].cast("int"))))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
