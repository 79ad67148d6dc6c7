"""Sharding by extendible hashing: a directory of hash prefixes in which only full buckets split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.llm.tables import only, stored

#: Bytes of text in a shard at most.
SHARD_BYTES = 32 << 20
#: Bits looked at in one pass over the sizes.
STEP = 12
#: Bits of the hash: rows alike in all of them can't be told apart.
BITS = 120


def hash_bits() -> Column:
    """The hash of a row's id and text as a string of BITS bits."""
    whole = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("text", F.lit(""))))
    nibbles = [F.conv(F.substring(whole, 1 + 3 * k, 3), 16, 2) for k in range(BITS // 12)]
    return F.concat(*[F.lpad(n, 12, "0") for n in nibbles])


def shard_directory(sizes: DataFrame, limit: int = SHARD_BYTES) -> DataFrame:
    """The buckets of (bits, size) rows: prefix, depth, bytes, n_rows, fits.

    Starting with one bucket, each that exceeds the limit splits on the next bit; empty halves
    aren't listed. One pass adds up sizes per prefix of STEP more bits, for the rows of buckets
    that are still too large, and splits as far as those bits reach; two passes cover buckets of
    2**24 limits. A bucket whose rows agree in all bits (copies of a row, or one large row) stays
    too large and says so in ``fits``.
    """
    done, rows, depth = [], sizes, 0
    while True:
        last = min(depth + STEP, BITS)
        cells = rows.groupBy(F.substring("bits", 1, last).alias("cell")).agg(
            F.sum("size").alias("size"), F.count("*").alias("n_rows")
        )
        # Sizes of all prefixes from the last depth on, each cell counted once at each depth.
        first = 0 if not depth else depth + 1
        levels = F.explode(F.sequence(F.lit(first), F.lit(last))).alias("depth")
        prefixes = (
            cells.select("cell", "size", "n_rows", levels)
            .groupBy(F.expr("substring(cell, 1, depth)").alias("prefix"), "depth")
            .agg(F.sum("size").alias("bytes"), F.sum("n_rows").alias("n_rows"))
            .withColumn("fits", F.col("bytes") <= limit)
        )
        prefixes = stored(prefixes, "prefixes")
        parent = prefixes.select(F.col("prefix").alias("up"), F.col("fits").alias("up_fits"))
        above = F.expr("substring(prefix, 1, greatest(depth - 1, 0))")
        linked = prefixes.join(parent, (above == F.col("up")) & (F.col("depth") > first), "left")
        # Below a bucket that fits nothing splits; the topmost one that fits is the leaf.
        leaf = F.col("fits") & ~F.coalesce("up_fits", F.lit(False))
        open_end = ~F.col("fits") & (F.col("depth") == last)
        ends = stored(linked.filter(leaf | open_end).drop("up", "up_fits"), "leaves")
        done.append(ends.filter("fits") if last < BITS else ends)
        if last == BITS or ends.filter("not fits").isEmpty():
            break
        full = ends.filter("not fits").select(F.col("prefix").alias("full"))
        rows = stored(rows.join(full, F.substring("bits", 1, last) == F.col("full"), "left_semi"), "open-rows")
        depth = last
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def shard(docs: DataFrame, limit: int = SHARD_BYTES) -> tuple[DataFrame, DataFrame]:
    """(rows, directory): each row's doc_id, size in bytes and shard, and the shards.

    ``shard`` is the bit prefix after a "b". The directory has shard, depth, bytes, n_rows, fits.
    Null text has size zero and null ids hash like empty ones; an empty table gives no rows and no
    shards. Copies of one row share a shard.
    """
    sizes = stored(
        only(docs, "doc_id", "text").select(
            "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("size"), hash_bits().alias("bits")
        ),
        "hashed",
    )
    directory = shard_directory(sizes.select("bits", "size"), limit)
    shards = stored(directory.withColumn("shard", F.concat(F.lit("b"), F.col("prefix"))), "directory")
    # A row's shard is the only prefix of its bits in the directory: look at the depths in use.
    depths = [r["depth"] for r in shards.select("depth").distinct().orderBy("depth").collect()]  # at most BITS + 1
    prefix = F.explode(F.array(*[F.substring("bits", 1, d) for d in depths])) if depths else F.lit("")
    tried = sizes.select("doc_id", "size", prefix.alias("own"))
    rows = tried.join(shards.select("prefix", "shard", "depth", "bytes", "n_rows", "fits"), F.col("own") == F.col("prefix"))
    return rows.select("doc_id", "size", "shard", "depth", "bytes", "n_rows", "fits"), shards.select(
        "shard", "depth", "bytes", "n_rows", "fits"
    )


def write_shards(docs: DataFrame, path: str, limit: int = SHARD_BYTES) -> None:
    """Write the rows, with all their columns, into one folder per shard."""
    bits = docs.withColumn("__bits", hash_bits())
    _, directory = shard(docs, limit)
    depths = [r["depth"] for r in directory.select("depth").distinct().collect()]
    prefixes = F.array(*[F.concat(F.lit("b"), F.substring("__bits", 1, d)) for d in sorted(depths)])
    rows = bits.withColumn("shard", F.explode(prefixes)).drop("__bits").join(directory.select("shard"), "shard")
    rows.repartition("shard").write.partitionBy("shard").parquet(path)
