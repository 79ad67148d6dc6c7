"""A random forest of regression trees, grown from histograms of bins.

Each tree sees the rows as often as a Poisson draw by key and tree says, each node a third of the
features, drawn by tree and node. Nodes of many rows are split by passes over chunks of the table,
whose partial histograms meet per (tree, node). Once a node has few rows, these are dealt to one
task, which grows all that lies below. Sums are whole numbers, so for given bins the trees depend
neither on partitions and tasks nor on where the passes end.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from valuegrain.operators import trees as T
from valuegrain.session import constant_table, keep, shared_dir

#: Rows whose features are counted at once, nodes of a block, and cells of a task's partial histograms.
ROWS_AT_ONCE, NODES_AT_ONCE, CELLS_HELD = 16_384, 64, 1 << 21
#: Rows of a node that are sorted per feature instead of counted per bin.
SORTED_ROWS = 32
#: Bytes of dealt rows that a wave of trees shuffles, about.
WAVE_BYTES = 2 << 30
#: A split gains at least this part of what it reaches; less is rounding.
LEAST_SHARE = 1e-12

#: How often a row is drawn: the chance of at most 0, 1, 2, ... times.
POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])

PARTIAL = "tree int, node long, sums binary, counts binary"
SPLITS = "tree int, node long, feature int, bin int, gain double, left_sum double, left_rows double, sum double, rows double"
DEALT = "tree int, node long, times binary, parts binary, bins binary"
GROWN = "tree int, node long, features binary, bins binary, left binary, values binary, gains binary"
KINDS = {"features": "<i4", "bins": "u1", "left": "<i4", "values": "<f8", "gains": "<f8"}


@dataclass(frozen=True)
class ForestSettings:
    """A child has ``child_rows`` rows at least, counted as often as they are drawn. A single tree
    takes all rows and features."""

    trees: int = 100
    depth: int = 15
    child_rows: int = 2
    bins: int = 64
    seed: int = 42

    def drawn(self, width: int) -> int:
        return width if self.trees == 1 else -(-width // 3)


@dataclass
class ForestTree:
    """Nodes as arrays, the root first. A leaf has feature -1; ``right`` is the node after ``left``."""

    features: np.ndarray
    bins: np.ndarray
    left: np.ndarray
    values: np.ndarray
    gains: np.ndarray

    def place(self, codes: np.ndarray) -> np.ndarray:
        """The leaf of each row of a matrix of bins."""
        node, rows = np.zeros(len(codes), np.int32), np.arange(len(codes))
        while len(rows):
            rows = rows[self.features[node[rows]] >= 0]
            at = node[rows]
            node[rows] = self.left[at] + (codes[rows, self.features[at]] > self.bins[at])
        return node


def times_drawn(keys: np.ndarray, settings: ForestSettings, tree: int) -> np.ndarray:
    """How often a tree sees each row, by the row's key and the tree alone."""
    if settings.trees == 1:
        return np.ones(len(keys), np.uint8)
    chance = (T.mixed(keys, settings.seed * 1_000_003 + 2 * tree) >> np.uint64(11)) * 2.0**-53
    return np.searchsorted(POISSON, chance, "right").astype(np.uint8)


def features_drawn(nodes: np.ndarray, width: int, settings: ForestSettings, tree: int) -> np.ndarray:
    """The features of each node in ascending order, by the tree and the node alone."""
    count = settings.drawn(width)
    if count >= width:
        return np.tile(np.arange(width), (len(nodes), 1))
    cells = nodes[:, None] * width + np.arange(width)
    order = np.argpartition(T.mixed(cells, settings.seed * 1_000_003 + 2 * tree + 1), count, axis=1)
    return np.sort(order[:, :count], axis=1)


def histograms(bins, rows, place, columns, parts, times, settings) -> tuple[np.ndarray, np.ndarray]:
    """Sums and rows per (node, drawn feature, bin); ``place`` is the place of a row's node in ``columns``."""
    nodes, count = columns.shape
    shape = (nodes, count, settings.bins)
    sums, counts = np.zeros(math.prod(shape)), np.zeros(math.prod(shape))
    for at in range(0, len(rows), ROWS_AT_ONCE):
        some, where = rows[at : at + ROWS_AT_ONCE], place[at : at + ROWS_AT_ONCE]
        first = (where[:, None] * count + np.arange(count)) * settings.bins
        code = (first + bins[some[:, None], columns[where]]).ravel()
        sums += np.bincount(code, np.repeat(parts[some], count), len(sums))
        counts += np.bincount(code, np.repeat(times[some], count), len(counts))
    return sums.reshape(shape), counts.reshape(shape)


def best_split(left_sum, left_rows, total, rows, settings: ForestSettings, scale: float, allowed=True):
    """Which candidate of each node lowers squared error the most, and by how much; the first of equals.

    Candidates lie in the last axis. A gain of zero means that no split is worth it.
    """
    right_sum, right_rows = total[:, None] - left_sum, rows[:, None] - left_rows
    allowed = allowed & (left_rows >= settings.child_rows) & (right_rows >= settings.child_rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        reached = left_sum * left_sum / left_rows + right_sum * right_sum / right_rows
    reached[~allowed] = -np.inf
    at = np.argmax(reached, axis=1)
    best = reached[np.arange(len(at)), at]
    gain = best - total * total / rows
    worth = (gain > LEAST_SHARE * best) & (gain / scale**2 > T.LEAST_GAIN)
    return at, np.where(worth, gain / scale**2, 0.0)


def counted_splits(sums: np.ndarray, counts: np.ndarray, columns: np.ndarray, settings, scale: float):
    """Feature, bin, gain, sum and rows to the left, sum and rows of each node from its histograms."""
    nodes = len(sums)
    left_sum, left_rows = (np.cumsum(a, axis=2) for a in (sums, counts))
    total, rows = left_sum[:, 0, -1], left_rows[:, 0, -1]
    left_sum, left_rows = (a.reshape(nodes, -1) for a in (left_sum, left_rows))
    at, gain = best_split(left_sum, left_rows, total, rows, settings, scale)
    each = np.arange(nodes)
    feature = columns[each, at // settings.bins]
    return feature, at % settings.bins, gain, left_sum[each, at], left_rows[each, at], total, rows


def sorted_splits(bins, rows, columns, parts, times, settings, scale: float):
    """Feature, bin and gain of nodes of few rows. ``rows`` has a line for each node, -1 behind its last row.

    The same splits as from histograms, whose bins would be mostly empty.
    """
    nodes, size = rows.shape
    codes = bins[rows[:, None, :], columns[:, :, None]].astype(np.int32)
    codes[np.broadcast_to(rows[:, None, :] < 0, codes.shape)] = settings.bins
    order = np.sort(codes * size + np.arange(size, dtype=np.int32), axis=2)
    codes, order = order // size, order % size
    sums, counts = (np.where(rows < 0, 0.0, a[rows]) for a in (parts, times))
    each = np.arange(nodes)[:, None, None]
    left_sum, left_rows = (np.cumsum(a[each, order], axis=2)[:, :, :-1].reshape(nodes, -1) for a in (sums, counts))
    # A split lies behind the last row of a bin.
    last = (codes[:, :, 1:] > codes[:, :, :-1]).reshape(nodes, -1)
    total, drawn = sums.sum(axis=1), counts.sum(axis=1)
    at, gain = best_split(left_sum, left_rows, total, drawn, settings, scale, last)
    feature, place = at // (size - 1), at % (size - 1)
    each = np.arange(nodes)
    return columns[each, feature], codes[each, feature, place], gain


def _blocks(sizes: np.ndarray, some: np.ndarray) -> Iterator[np.ndarray]:
    """Nodes in blocks of about equal work."""
    work = np.cumsum(sizes[some])
    number = np.maximum(work // ROWS_AT_ONCE, np.arange(len(some)) // NODES_AT_ONCE)
    yield from np.split(some, np.flatnonzero(np.diff(number)) + 1) if len(some) else []


def grown_below(bins, parts, times, tree: int, node: int, settings: ForestSettings, scale: float, base: float) -> ForestTree:
    """The tree below a node from its rows, level by level. ``node`` is 1 for the root, 2n and 2n + 1 below n."""
    times = times.astype(np.float64)
    # Sums of whole parts of up to TASK_ROWS rows are exact in floats.
    parts = parts * times
    rows, sizes, numbers = np.arange(len(bins)), np.array([len(bins)]), np.array([node], np.int64)
    levels, count, depth = [], 1, node.bit_length() - 1
    while True:
        starts = np.cumsum(sizes) - sizes
        total, drawn = (np.add.reduceat(a[rows], starts) for a in (parts, times))
        feature, cut = np.full(len(numbers), -1, np.int32), np.zeros(len(numbers), np.uint8)
        gains, left = np.zeros(len(numbers)), np.zeros(len(numbers), np.int32)

        def keep_best(some: np.ndarray, found: tuple) -> None:
            worth = found[2] > 0
            feature[some[worth]], cut[some[worth]], gains[some[worth]] = (a[worth] for a in found[:3])

        may = (drawn >= 2 * settings.child_rows) & (sizes > 1) & (depth < settings.depth)
        for block in _blocks(sizes, np.flatnonzero(may & (sizes > SORTED_ROWS))):
            columns = features_drawn(numbers[block], bins.shape[1], settings, tree)
            used = np.concatenate([rows[starts[n] : starts[n] + sizes[n]] for n in block])
            place = np.repeat(np.arange(len(block)), sizes[block])
            found = histograms(bins, used, place, columns, parts, times, settings)
            keep_best(block, counted_splits(*found, columns, settings, scale))
        size = 2
        while size <= SORTED_ROWS:
            few = np.flatnonzero(may & (sizes > size // 2) & (sizes <= size))
            few = few[sizes[few] > 1]
            for block in np.split(few, range(NODES_AT_ONCE * 16 // size, len(few), NODES_AT_ONCE * 16 // size)):
                if not len(block):
                    continue
                at = starts[block][:, None] + np.arange(size)
                there = np.arange(size) < sizes[block][:, None]
                used = np.where(there, rows[np.minimum(at, len(rows) - 1)], -1)
                columns = features_drawn(numbers[block], bins.shape[1], settings, tree)
                keep_best(block, sorted_splits(bins, used, columns, parts, times, settings, scale))
            size *= 2

        split = np.flatnonzero(feature >= 0)
        left[split] = count + 2 * np.arange(len(split))
        levels.append((feature, cut, left, base + total / drawn / scale, gains))
        if not len(split):
            return ForestTree(*[np.concatenate(a) for a in zip(*levels)])
        place = np.repeat(np.arange(len(numbers)), sizes)
        goes_on = feature[place] >= 0
        rows, place = rows[goes_on], place[goes_on]
        rank = np.cumsum(feature >= 0) - 1
        child = 2 * rank[place] + (bins[rows, feature[place]] > cut[place])
        rows = rows[np.argsort(child, kind="stable")]
        sizes = np.bincount(child, minlength=2 * len(split))
        numbers = (2 * numbers[split][:, None] + np.arange(2)).ravel()
        count, depth = count + 2 * len(split), depth + 1


@dataclass
class _Top:
    """A tree's upper nodes by number: their splits and, for all of them, values."""

    splits: dict[int, tuple[int, int, float]] = field(default_factory=dict)
    values: dict[int, float] = field(default_factory=dict)

    def place(self, bins: np.ndarray) -> np.ndarray:
        """The node of each row that no known split divides."""
        node = np.ones(len(bins), np.int64)
        for number in sorted(self.splits):
            rows = np.flatnonzero(node == number)
            feature, cut, _ = self.splits[number]
            node[rows] = 2 * number + (bins[rows, feature] > cut)
        return node

    def joined(self, below: dict[int, ForestTree], base: float) -> ForestTree:
        """The whole tree, with what was grown below the upper nodes."""
        numbers = sorted({1, *self.splits, *self.values, *below})
        # In ascending order a node's children are neighbours.
        place = {number: i for i, number in enumerate(numbers)}
        columns = [[], [], [], [], []]
        for n in numbers:
            feature, cut, gain = self.splits.get(n, (-1, 0, 0.0))
            left = place[2 * n] if n in self.splits else 0
            for column, value in zip(columns, (feature, cut, left, self.values.get(n, base), gain)):
                column.append(value)
        found = [[np.array(c, kind)] for c, kind in zip(columns, KINDS.values())]
        count = len(numbers)
        for n, tree in sorted(below.items()):
            left = np.where(tree.features >= 0, tree.left + (count - 1), 0)
            for known, fresh in zip(found, (tree.features, tree.bins, left, tree.values, tree.gains)):
                known[0][place[n]] = fresh[0]
                known.append(fresh[1:])
            count += len(tree.features) - 1
        return ForestTree(*[np.concatenate(a).astype(kind) for a, kind in zip(found, KINDS.values())])


@dataclass
class ForestModel:
    """The mean of trees over a vector of features."""

    name: str
    width: int
    edges: list[list[float]]
    grown: list[ForestTree]

    @property
    def trees(self) -> int:
        return len(self.grown)

    @property
    def importances(self) -> list[float]:
        """Gain of each feature, each tree's summing to one before the trees are added up."""
        totals = np.zeros(self.width)
        for tree in self.grown:
            inner = tree.features >= 0
            gains = np.bincount(tree.features[inner], tree.gains[inner], self.width)
            totals += gains / (gains.sum() or 1.0)
        return [float(v) for v in totals / (totals.sum() or 1.0)]

    def values(self, x: np.ndarray) -> np.ndarray:
        """The prediction for each row of a matrix of features."""
        codes = np.zeros((len(x), self.width), np.uint8)
        for place, edges in enumerate(self.edges):
            codes[:, place] = np.searchsorted(edges, x[:, place], "left")
        total = np.zeros(len(x))
        for tree in self.grown:
            total += tree.values[tree.place(codes)]
        return total / max(self.trees, 1)

    def transform(self, vectors: DataFrame) -> DataFrame:
        """Add the prediction as column ``name``; row-wise, in Arrow batches."""
        lean = replace(self, grown=[replace(tree, gains=tree.gains[:0]) for tree in self.grown])

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, lean.width))
            return pd.Series(lean.values(rows))

        return vectors.withColumn(self.name, predict(vector_to_array("features")))

    def save(self, spark: SparkSession, path: str) -> None:
        state = {"name": self.name, "width": self.width, "edges": self.edges}
        constant_table(spark, [(json.dumps(state),)], "state").write.mode("overwrite").parquet(f"{path}/state")
        rows = [(i, 1, tree) for i, tree in enumerate(self.grown)]
        spark.createDataFrame(pa.Table.from_batches([_packed(rows)])).write.mode("overwrite").parquet(f"{path}/trees")

    @staticmethod
    def load(spark: SparkSession, path: str) -> ForestModel:
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        rows = spark.read.parquet(f"{path}/trees").collect()
        return ForestModel(**state, grown=[_unpacked(r) for r in sorted(rows, key=lambda r: r["tree"])])


def _packed(rows: list[tuple[int, int, ForestTree]]) -> pa.RecordBatch:
    """Trees as rows of GROWN."""
    blobs = [[getattr(t, name).astype(kind).tobytes() for _, _, t in rows] for name, kind in KINDS.items()]
    numbers = [pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64())]
    return pa.RecordBatch.from_arrays([*numbers, *[pa.array(b, pa.binary()) for b in blobs]], ["tree", "node", *KINDS])


def _unpacked(row) -> ForestTree:
    return ForestTree(*[np.frombuffer(row[name], kind) for name, kind in KINDS.items()])


def forest_edges(vectors: DataFrame, quantiles: list[list[float]], most: int) -> list[list[float]]:
    """The middles between all values of a feature that has at most ``most``, else its quantiles."""
    width = len(quantiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = [np.zeros(0)] * width
        for batch in batches:
            x = batch.column(0).flatten().to_numpy().reshape(-1, width)
            for i in range(width):
                # One more than allowed is enough to know that there are too many.
                if len(known[i]) <= most:
                    known[i] = np.unique(np.concatenate([known[i], x[:, i]]))[: most + 1]
        places = np.repeat(np.arange(width, dtype=np.int32), [len(k) for k in known])
        values = np.concatenate([*known, np.zeros(0)])
        yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(values)], ["place", "value"])

    found = vectors.select(vector_to_array("features").alias("x")).mapInArrow(run, "place int, value double")
    known = found.groupBy("place").agg(F.collect_set("value").alias("values")).where(F.size("values") <= most)
    edges = list(quantiles)
    for row in known.collect():
        values = sorted(set(row["values"]))
        middles = [a + (b - a) / 2 for a, b in zip(values, values[1:])]
        edges[row["place"]] = [m if m < b else a for m, a, b in zip(middles, values, values[1:])]
    return edges


@dataclass
class _Pass:
    """What tasks need to know of a wave of trees."""

    settings: ForestSettings
    scale: float
    base: float
    width: int
    tops: dict[int, _Top]
    #: The nodes of each tree that a pass is about.
    nodes: dict[int, list[int]]

    def _chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """Keys, parts and bins of chunks, a row of bins for each row of the table."""
        for batch in batches:
            for row in range(batch.num_rows):
                chunk = T._Chunk(batch, row, 1.0, [])
                parts = np.rint((chunk.labels - self.base) * self.scale)
                yield chunk.keys, parts, np.ascontiguousarray(chunk.bins.T)

    def _shown(self, chunk: tuple, tree: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The rows of a chunk that a tree draws and that lie in its nodes, the node's place, how often."""
        keys, _, bins = chunk
        times = times_drawn(keys, self.settings, tree)
        wanted = np.array(sorted(self.nodes[tree]), np.int64)
        node = self.tops[tree].place(bins)
        place = np.minimum(np.searchsorted(wanted, node), len(wanted) - 1)
        rows = np.flatnonzero((times > 0) & (wanted[place] == node))
        rows = rows[np.argsort(place[rows], kind="stable")]
        return rows, place[rows], times

    def partial(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's histograms, one row for each tree and node."""
        chunks = list(self._chunks(batches))
        names = [c.split()[0] for c in PARTIAL.split(", ")]
        for tree in self.nodes if chunks else ():
            numbers = np.array(sorted(self.nodes[tree]), np.int64)
            shown = [(chunk, *self._shown(chunk, tree)) for chunk in chunks]
            cells = self.settings.drawn(self.width) * self.settings.bins
            step = max(1, CELLS_HELD // cells)
            for first in range(0, len(numbers), step):
                some = numbers[first : first + step]
                columns = features_drawn(some, self.width, self.settings, tree)
                sums, counts = np.zeros((2, len(some), columns.shape[1], self.settings.bins))
                for (_, parts, bins), rows, place, times in shown:
                    low, high = np.searchsorted(place, (first, first + len(some)))
                    drawn = times.astype(np.float64)
                    found = histograms(
                        bins, rows[low:high], place[low:high] - first, columns, parts * drawn, drawn, self.settings
                    )
                    sums, counts = sums + found[0], counts + found[1]
                blobs = [pa.array([a.tobytes() for a in both], pa.binary()) for both in (sums, counts)]
                trees = pa.array(np.full(len(some), tree, np.int32))
                yield pa.RecordBatch.from_arrays([trees, pa.array(some), *blobs], names)

    def merged(self, table: pa.Table) -> pa.Table:
        """The best split of a node from all its partial histograms."""
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        columns = features_drawn(np.array([node], np.int64), self.width, self.settings, tree)
        shape = (1, columns.shape[1], self.settings.bins)
        sums, counts = (
            sum(np.frombuffer(v.as_py(), "<f8") for v in table.column(name)).reshape(shape) for name in ("sums", "counts")
        )
        found = counted_splits(sums, counts, columns, self.settings, self.scale)
        values = [tree, node, int(found[0][0]), int(found[1][0]), *[float(a[0]) for a in found[2:]]]
        kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32()] + [pa.float64()] * 5
        names = [c.split()[0] for c in SPLITS.split(", ")]
        return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names)

    def dealt(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of each node, a row for each chunk that has some."""
        names = [c.split()[0] for c in DEALT.split(", ")]
        for chunk in self._chunks(batches):
            _, parts, bins = chunk
            for tree in self.nodes:
                numbers = sorted(self.nodes[tree])
                rows, place, times = self._shown(chunk, tree)
                pieces = [p for p in np.split(rows, np.flatnonzero(np.diff(place)) + 1) if len(p)]
                nodes = [numbers[i] for i in sorted(set(place.tolist()))]
                blobs = [[a[p].tobytes() for p in pieces] for a in (times, parts, bins)]
                trees = pa.array(np.full(len(pieces), tree, np.int32))
                columns = [trees, pa.array(nodes, pa.int64()), *[pa.array(b, pa.binary()) for b in blobs]]
                yield pa.RecordBatch.from_arrays(columns, names)

    def grown(self, table: pa.Table) -> pa.Table:
        """What lies below a node, from all its rows."""
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        kinds = {"times": "u1", "parts": "<f8", "bins": "u1"}
        times, parts, bins = (
            np.concatenate([np.frombuffer(v.as_py(), kind) for v in table.column(name)]) for name, kind in kinds.items()
        )
        bins = bins.reshape(len(times), self.width)
        found = grown_below(bins, parts, times, tree, node, self.settings, self.scale, self.base)
        return pa.Table.from_batches([_packed([(tree, node, found)])])


def _grown_wave(chunks: DataFrame, one: _Pass, rows: int) -> list[ForestTree]:
    """Some trees: passes as long as nodes have more rows than a task takes, then their rows."""
    settings, large, small = one.settings, set(), set()
    (large if rows > T.TASK_ROWS else small).update((tree, 1) for tree in one.tops)
    while large:
        look = replace(one, nodes=_by_tree(large))
        partial = chunks.mapInArrow(look.partial, PARTIAL).groupBy("tree", "node")
        found = partial.applyInArrow(lambda rows: look.merged(rows), SPLITS).collect()
        large = set()
        for r in found:
            top = one.tops[r["tree"]]
            top.values[r["node"]] = one.base + r["sum"] / max(r["rows"], 1) / one.scale
            if r["gain"] <= 0:
                continue
            top.splits[r["node"]] = r["feature"], r["bin"], r["gain"]
            sides = ((r["left_sum"], r["left_rows"]), (r["sum"] - r["left_sum"], r["rows"] - r["left_rows"]))
            for child, (total, drawn) in zip((2 * r["node"], 2 * r["node"] + 1), sides):
                top.values[child] = one.base + total / drawn / one.scale
                if child.bit_length() <= settings.depth:
                    (large if drawn > T.TASK_ROWS else small).add((r["tree"], child))
    below: dict[int, dict[int, ForestTree]] = {tree: {} for tree in one.tops}
    if small:
        look = replace(one, nodes=_by_tree(small))
        dealt = chunks.mapInArrow(look.dealt, DEALT).repartition(min(len(small), 1000), "tree", "node")
        for r in dealt.groupBy("tree", "node").applyInArrow(lambda rows: look.grown(rows), GROWN).collect():
            below[r["tree"]][r["node"]] = _unpacked(r)
    return [top.joined(below[tree], one.base) for tree, top in one.tops.items()]


def _by_tree(nodes: set[tuple[int, int]]) -> dict[int, list[int]]:
    found: dict[int, list[int]] = {}
    for tree, node in sorted(nodes):
        found.setdefault(tree, []).append(node)
    return found


def fit_forest(
    vectors: DataFrame,
    settings: ForestSettings,
    *,
    name: str,
    label: str,
    held_out: str,
    key: str,
    edges: list[list[float]],
) -> ForestModel:
    """Grow a forest on all rows; ``key`` is a whole number by which they are drawn, ``edges`` the bins.

    Each tree's drawn rows are shuffled once, a wave of trees at a time.
    """
    spark, width = vectors.sparkSession, len(edges)
    facts = vectors.agg(F.avg(label), F.min(label), F.max(label)).first()
    # The last bits of a mean depend on the order of summation.
    base = float(f"{facts[0] or 0.0:.9g}")
    largest = max((abs(float(v) - base) for v in facts[1:] if v is not None), default=0.0)
    scale = T.PARTS / (largest or 1.0)
    path = shared_dir(spark, "chunks")
    T.binned_chunks(vectors, edges, base, (key, label, held_out)).write.parquet(path)
    written = spark.read.schema(T.CHUNKS).parquet(path)
    counted = written.agg(F.sum("n"), F.count("n")).first()
    rows, pieces = counted[0] or 0, counted[1]
    cores = spark.sparkContext.defaultParallelism
    tasks = max(min(pieces, cores), -(-rows // (T.CHUNK_ROWS * T.CHUNKS_PER_TASK)), 1)
    chunks = keep(written.repartition(tasks))
    wave = max(1, min(settings.trees, WAVE_BYTES // max(rows * (width + 9), 1)))
    grown: list[ForestTree] = []
    for first in range(0, settings.trees, wave):
        tops = {tree: _Top() for tree in range(first, min(first + wave, settings.trees))}
        grown += _grown_wave(chunks, _Pass(settings, scale, base, width, tops, {}), rows)
    chunks.unpersist()
    return ForestModel(name, width, edges, grown)
