"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are range-partitioned by decreasing length, so each chunk holds vectors of similar
length. A query that already has k scores needs, in a chunk whose longest vector is l, a cosine of
at least threshold / (|q| l). If that exceeds one the chunk is skipped; if it is small only the
lengths prune; else the query's largest coordinates bound the coordinates of candidates. What is
left is verified with exact integer products.

A first pass meets every query with the longest chunks alone; its k-th score there is the query's floor.
Queries are then packed into blocks by the length they need, floor / |q|, and a block is sent only to the
groups of chunks that hold vectors of that length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from valuegrain.llm.tables import only, stored

SCALE = 1024
TOP = 10
#: Vectors in a chunk, and queries in a block, at most.
CHUNK = 4096
QUERIES = 2048
#: Chunks of vectors in a group, to which blocks of queries are sent.
CHUNKS_PER_TASK = 4
#: Longest chunks that give the floors; each has at most CHUNK vectors, so they can be broadcast.
SEEDS = 2
#: Levels of length per octave, by which blocks find their groups.
LEVELS = 16
#: Local cosines from which coordinates are worth a look, and how many of them.
COORDINATE_COSINE = 0.7
FOCUS = 3


def integer_vectors(table: DataFrame) -> DataFrame:
    """vec_id, v (bigints) and norm of the rows that take part, v = floor(1024 * x).

    Rows with a null id, a null vector, or a null or non-finite component take no part.
    """
    x = F.col("embedding").cast("array<double>")
    limit = float(2**62)
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & F.forall(
        x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    )
    inside = lambda c: F.greatest(F.lit(-limit), F.least(F.lit(limit), F.floor(c * SCALE).cast("double")))
    rows = only(table, "vec_id", "embedding").filter(usable)
    rows = rows.select("vec_id", F.transform(x, lambda c: F.floor(inside(c)).cast("long")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return rows.withColumn("norm", norm)


def _matrix(values: pa.Array) -> np.ndarray:
    """A list column as a matrix; shorter vectors count as ending in zeros."""
    offsets = values.offsets.to_numpy()
    flat = values.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), int(sizes.max(initial=0))), np.int64)
    mask = np.arange(out.shape[1])[None, :] < sizes[:, None]
    out[mask] = flat[offsets[0] : offsets[-1]]
    return out


def _packed(batch_rows: int):
    """Rows of (vec_id, v, norm, floor), already in order, as chunks of one row each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, batch_rows):
                part = batch.slice(at, batch_rows)
                m = _matrix(part.column(1))
                norms, floors = (part.column(k).to_numpy() for k in (2, 3))
                ids = part.column(0).to_numpy().astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([norms.max()]), pa.array([len(ids)], pa.int64()), pa.array([m.shape[1]], pa.int64())]
                    + [pa.array([a.tobytes()], pa.binary()) for a in (ids, m, norms, floors)]
                    + [pa.array([_needed(floors, norms).min()])],
                    names=["longest", "n", "width", "ids", "matrix", "norms", "floors", "need"],
                )

    return run


def _needed(floors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The length a vector must have to reach a query's floor; minus infinity where any may."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where((floors > 0) & (norms > 0), floors / norms * (1 - 2e-9), -np.inf)


PACKED = "longest double, n long, width long, ids binary, matrix binary, norms binary, floors binary, need double"
PARTS = [c.split(" ")[0] for c in PACKED.split(", ")]


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by floats while every sum is exact in them, else by integers."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    most = int(np.abs(a).max(initial=0)) * int(np.abs(b).max(initial=0)) * max(width, 1)
    if most < 1 << 53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    if most < 1 << 63:
        return a @ b.T
    exact = a.astype(object) @ b.T.astype(object)
    return np.clip(exact, -(1 << 63), (1 << 63) - 1).astype(np.int64)


class _Best:
    """The best scores so far of each query of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, floors: np.ndarray, k: int):
        self.ids, self.vectors, self.norms, self.floors, self.k = ids, vectors, norms, floors, k
        #: Products computed so far.
        self.verified = 0
        self.scores = np.zeros((len(ids), 0), np.int64)
        self.found = np.zeros((len(ids), 0), np.int64)
        self.have = np.zeros(len(ids), np.int64)

    def thresholds(self) -> np.ndarray:
        """The k-th score of each query, at least its floor; minus infinity before it has either."""
        if self.scores.shape[1] < self.k:
            return self.floors
        return np.where(self.have >= self.k, np.maximum(self.floors, self.scores[:, -1]), self.floors)

    def add(self, ids: np.ndarray, vectors: np.ndarray, norms: np.ndarray, longest: float) -> None:
        """Meet a chunk of vectors, sorted by decreasing length."""
        need = self.thresholds()
        with np.errstate(divide="ignore", invalid="ignore"):
            cosine = need / (self.norms * longest)
        # Lengths are rounded, so a bound counts with a small allowance.
        cosine = np.where(np.isnan(cosine), -np.inf, cosine) - 1e-9
        active = np.flatnonzero(cosine <= 1)
        by_length = active[cosine[active] < COORDINATE_COSINE]
        if len(by_length):
            with np.errstate(divide="ignore", invalid="ignore"):
                shortest = np.nan_to_num(need[by_length] / self.norms[by_length], nan=0.0, neginf=0.0)
            long = int(np.searchsorted(-norms, -max(0.0, float(shortest.min())) * (1 - 1e-9), "right"))
            self._merge(by_length, ids[:long], vectors[:long])
        for q in active[cosine[active] >= COORDINATE_COSINE]:
            keep = self._feasible(q, vectors, norms, need[q], cosine[q])
            if len(keep):
                self._merge(np.array([q]), ids[keep], vectors[keep])

    def _feasible(self, q: int, vectors: np.ndarray, norms: np.ndarray, need: float, cosine: float) -> np.ndarray:
        """Vectors long enough, and whose focus coordinates allow the cosine."""
        keep = np.arange(int(np.searchsorted(-norms, -(need / self.norms[q]) * (1 - 1e-9), "right")))
        unit = self.vectors[q] / self.norms[q]
        for f in np.argsort(-np.abs(unit), kind="stable")[:FOCUS]:
            if f >= vectors.shape[1]:
                continue
            p = vectors[keep, f] / norms[keep]
            reach = p * unit[f] + np.sqrt(np.maximum(0, (1 - p * p) * (1 - unit[f] ** 2)))
            keep = keep[reach >= cosine - 1e-9]
        return keep

    def _merge(self, queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        scores = _products(self.vectors[queries], vectors)
        self.verified += scores.size
        least = np.iinfo(np.int64).min
        own = self.ids[queries][:, None] == ids[None, :]
        width = self.scores.shape[1]
        every = np.concatenate([self.scores[queries], scores], axis=1)
        names = np.concatenate([self.found[queries], np.broadcast_to(ids, scores.shape)], axis=1)
        valid = np.concatenate([np.arange(width)[None, :] < self.have[queries][:, None], ~own], axis=1)
        every = np.where(valid, every, least)
        # ~x sorts like -x and has no overflow.
        order = np.lexsort((names, ~every, ~valid), axis=1)
        order = order[:, : self.k]
        take = lambda x: np.take_along_axis(x, order, axis=1)
        if order.shape[1] > width:
            grown = np.zeros((len(self.ids), order.shape[1]), np.int64)
            for name in ("scores", "found"):
                new = grown.copy()
                new[:, :width] = getattr(self, name)
                setattr(self, name, new)
        self.scores[queries, : order.shape[1]] = take(every)
        self.found[queries, : order.shape[1]] = take(names)
        self.have[queries] = take(valid).sum(axis=1)

    def rows(self) -> pa.RecordBatch:
        """The best scores that reach the floors."""
        width = self.scores.shape[1]
        valid = (np.arange(width)[None, :] < self.have[:, None]) & (self.scores >= self.floors[:, None])
        queries = np.broadcast_to(self.ids[:, None], valid.shape)[valid]
        arrays = [pa.array(x, pa.int64()) for x in (queries, self.found[valid], self.scores[valid])]
        return pa.RecordBatch.from_arrays(arrays, names=["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score long"


def _unpack(row: dict, side: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n, width = row[side + "n"], row[side + "width"]
    matrix = np.frombuffer(row[side + "matrix"], np.int64).reshape(n, width)
    return np.frombuffer(row[side + "ids"], np.int64), matrix, *(np.frombuffer(row[side + c]) for c in ("norms", "floors"))


def _search(k: int):
    """The best scores of each pair of a block of queries and a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
                best = _Best(*_unpack(row, "q_"), k)
                ids, vectors, norms, _ = _unpack(row)
                best.add(ids, vectors, norms, row["longest"])
                yield best.rows()

    return run


def _blocks(queries: DataFrame, name: str) -> DataFrame:
    """Rows of (vec_id, v, norm, floor) in order, packed into blocks whose columns begin with q_."""
    packed = queries.mapInArrow(_packed(QUERIES), PACKED).select(*[F.col(c).alias(f"q_{c}") for c in PARTS])
    return stored(packed.withColumn("block", F.monotonically_increasing_id()), name)


def _level(length: str) -> Column:
    """The level of a length; lengths below one share the lowest."""
    return F.floor(F.log2(F.greatest(F.col(length), F.lit(1.0))) * LEVELS).cast("int")


def _floors(asked: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """query_id and floor, the k-th best score among the longest chunks, of the queries that have k scores there."""
    order = F.row_number().over(Window.orderBy(F.desc("longest"), "chunk"))
    longest = chunks.orderBy(F.desc("longest"), "chunk").limit(SEEDS).withColumn("seed", order)
    met = asked.withColumn("seed", F.explode(F.sequence(F.lit(1), F.lit(SEEDS)))).join(F.broadcast(longest), "seed")
    found = met.drop("seed", "group", "chunk", "block", "need", "q_need").mapInArrow(_search(k), FOUND)
    place = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    ranked = found.withColumn("place", place).filter(F.col("place") == k)
    # Slightly lower, as a double may round a large score up.
    score = F.col("score").cast("double")
    return ranked.select("query_id", (score - F.abs(score) * 1e-12).alias("floor"))


def met_groups(asked: DataFrame, chunks: DataFrame) -> DataFrame:
    """(block, group): the groups of chunks that hold vectors of the length a block needs.

    Groups are numbered by decreasing length, so a block meets those up to its reach: the last group with a
    vector in the level of the needed length or above it. The levels' reaches are a table of bounded size.
    """
    spark = chunks.sparkSession
    reach = dict(chunks.groupBy(_level("longest").alias("level")).agg(F.max("group")).collect())
    rows, furthest = [], -1
    for level in range(max(reach, default=0), -1, -1):
        furthest = max(furthest, reach.get(level, -1))
        rows.append((level, furthest))
    reaches = spark.createDataFrame(rows, "level int, reach int")
    needs = asked.select("block", F.least(_level("q_need"), F.lit(rows[0][0])).alias("level"))
    return needs.join(F.broadcast(reaches), "level").select("block", F.explode(F.sequence(F.lit(0), "reach")).alias("group"))


def top_products(table: DataFrame, every: int, k: int = TOP) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest products of each query with all other rows.

    Queries are the rows whose id is divisible by ``every``, one per id (the smallest vector, if
    an id repeats); candidates are all rows with another id, repeated ones included. Ties go to
    the smaller vec_id. Fewer candidates than k give fewer rows; an empty table gives none.
    """
    vectors = stored(integer_vectors(table).withColumn("floor", F.lit(float("-inf"))), "vectors")
    queries = vectors.filter(F.pmod("vec_id", F.lit(every)) == 0)
    queries = queries.groupBy("vec_id").agg(F.min(F.struct("v", "norm", "floor")).alias("m")).select("vec_id", "m.*")
    blocks = max(1, -(-queries.count() // QUERIES))
    groups = max(1, -(-vectors.count() // (CHUNK * CHUNKS_PER_TASK)))
    # A range sort by length; the id splits lengths that many vectors share.
    ordered = vectors.repartitionByRange(groups, F.desc("norm"), "vec_id").sortWithinPartitions(F.desc("norm"), "vec_id")
    chunks = ordered.mapInArrow(_packed(CHUNK), PACKED)
    chunks = chunks.withColumns({"chunk": F.monotonically_increasing_id(), "group": F.spark_partition_id()})
    chunks = stored(chunks, "chunks")
    floors = _floors(_blocks(queries.repartition(blocks, "vec_id"), "first-blocks"), chunks, k)
    bound = queries.drop("floor").join(floors, queries["vec_id"] == floors["query_id"], "left").drop("query_id")
    bound = bound.withColumn("floor", F.coalesce("floor", F.lit(float("-inf"))))
    need = F.when((F.col("norm") > 0) & (F.col("floor") > 0), F.col("floor") / F.col("norm")).otherwise(F.lit(0.0))
    bound = bound.withColumn("needed", need).repartitionByRange(blocks, "needed", "vec_id")
    bound = bound.sortWithinPartitions("needed", "vec_id").drop("needed")
    asked = _blocks(bound.select("vec_id", "v", "norm", "floor"), "query-blocks")
    # Spread the pairs, as a small side may be broadcast.
    tasks = min(blocks * groups, int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    met = met_groups(asked, chunks).repartition(tasks, "block", "group")
    met = met.join(asked, "block").join(chunks, "group").filter("longest >= q_need")
    found = met.drop("group", "chunk", "block", "need", "q_need").mapInArrow(_search(k), FOUND)
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)").alias("rank")
    return found.select("query_id", rank, "vec_id", "score").filter(F.col("rank") <= k)
