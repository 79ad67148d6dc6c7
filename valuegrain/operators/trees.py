"""Regularised regression trees grown from histograms of quantile bins.

Rows are binned once and packed into chunks of a few thousand rows, a row of the table each. A
table of a few chunks fits one task, which then grows some trees in a row. Of a larger table every
task holds a part, a pass adds up gradients and rows per (node, feature, bin) in each, and the sums,
whose size is that of the nodes, meet at the driver. Either way only the smaller child of a split is
added up, as the larger one's sums are what that leaves; in the same way rare flags are summed over
the rows that have them. All sums are whole numbers, so for given bins a tree depends neither on
partitions and tasks nor on the order of rows.
"""

from __future__ import annotations

import gc
import json
import operator
import random
import uuid
from collections import OrderedDict
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import RDD
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from valuegrain.session import constant_table, keep, shared_dir

#: Rows of a chunk, and chunks that a task goes through, about.
CHUNK_ROWS, CHUNKS_PER_TASK = 16_384, 4
#: Rows of a table that one task grows trees of, and of a larger table's parts: 32 MB of bins at 256 features.
TASK_ROWS = 1 << 17
#: Parts whose sums meet at the driver at once; those of more meet in tasks first.
PARTS_AT_ONCE = 24
#: Parts are pickled already; Java would only wrap them once more at each reading.
PARTS_KEPT = StorageLevel(True, True, False, True)
#: Running predictions of parts that a Python worker remembers between passes, 1 MB each at most.
GUESSES_KEPT = 48
#: Rounds after which the running prediction is kept; passes in between apply the trees since then.
ROUNDS_KEPT = 20
#: A feature is counted by the rows outside its commonest bin, if that has at least this part of them.
COMMON_SHARE = 0.8
#: Features whose rows all lie in this many bins are looked at together.
FEW_BINS = 8
#: Gradients are rounded to whole parts; the largest one at the start has about this many.
PARTS = 2.0**30
#: A split gains at least this.
LEAST_GAIN = 1e-6
#: Node number of the row that carries the held-out error.
ERROR = -1

CHUNKS = "n long, key binary, label binary, held binary, guess binary, bins binary"
PARTIAL = "node int, feature int, sums binary, counts binary, error double"


@dataclass(frozen=True)
class TreeSettings:
    """How trees grow. ``leaves`` grows the leaf of the largest gain next until there are that
    many; else all leaves of a level split, down to ``depth``. ``l1`` and ``l2`` shrink leaf
    values; a child has ``child_rows`` rows at least (their weight under squared error)."""

    rounds: int = 500
    rate: float = 0.05
    depth: int | None = 6
    leaves: int | None = None
    l1: float = 0.1
    l2: float = 1.0
    child_rows: int = 3
    subsample: float = 0.8
    column_share: float = 0.8
    bins: int = 64
    patience: int | None = 50
    seed: int = 42


@dataclass
class Split:
    """The best split of a node: rows with ``feature`` in bins up to ``bin`` go left."""

    feature: int
    bin: int
    gain: float
    left_sum: int
    left_rows: int
    sum: int
    rows: int


@dataclass
class Tree:
    """Nodes by number, the root first. A leaf has feature -1; ``values`` are the leaves'."""

    features: list[int] = field(default_factory=lambda: [-1])
    bins: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [0])
    right: list[int] = field(default_factory=lambda: [0])
    values: list[float] = field(default_factory=lambda: [0.0])
    gains: list[float] = field(default_factory=lambda: [0.0])
    rows: list[int] = field(default_factory=lambda: [0])

    @property
    def leaves(self) -> int:
        return sum(f < 0 for f in self.features)

    def split(self, node: int, found: Split, settings: TreeSettings, scale: float) -> tuple[int, int]:
        """Turn a leaf into a split with two leaves; their numbers."""
        self.features[node], self.bins[node], self.gains[node] = found.feature, found.bin, found.gain
        ends = ((found.left_sum, found.left_rows), (found.sum - found.left_sum, found.rows - found.left_rows))
        children = []
        for total, rows in ends:
            children.append(len(self.features))
            value = leaf_value(total / scale, rows, settings)
            fresh = (-1, 0, 0, 0, value, 0.0, rows)
            for column, entry in zip(vars(self).values(), fresh):
                column.append(entry)
        self.left[node], self.right[node] = children
        return children[0], children[1]

    def place(self, pick, rows: int, bounds: np.ndarray) -> np.ndarray:
        """The leaf of each row. ``pick(feature, row)`` gives the rows' bins or values, ``bounds`` the
        largest one that goes left at each node."""
        features, left, right = (np.array(a) for a in (self.features, self.left, self.right))
        node = np.zeros(rows, np.int64)
        open_rows = np.arange(rows) if features[0] >= 0 else np.arange(0)
        while len(open_rows):
            at = node[open_rows]
            goes = pick(features[at], open_rows) <= bounds[at]
            node[open_rows] = np.where(goes, left[at], right[at])
            open_rows = open_rows[features[node[open_rows]] >= 0]
        return node


def soft(total, l1: float):
    """A sum of gradients moved towards zero by ``l1``."""
    return np.sign(total) * np.maximum(np.abs(total) - l1, 0.0)


def leaf_value(total: float, rows: int, settings: TreeSettings) -> float:
    """The step that lowers squared error plus penalties the most: -soft(G) / (H + l2)."""
    weight = rows + settings.l2
    return float(-soft(total, settings.l1) / weight) if weight > 0 else 0.0


def node_score(total, rows, settings: TreeSettings):
    """soft(G)^2 / (H + l2); a split gains the scores of its sides less its own."""
    weight = np.maximum(rows + settings.l2, 1e-300)
    return soft(total, settings.l1) ** 2 / weight


def best_splits(sums: np.ndarray, counts: np.ndarray, settings: TreeSettings, scale: float):
    """The best split of each histogram (rows of sums and counts per bin): its bin and gain.

    Ties go to the smallest bin; a gain of minus infinity means that no split is allowed.
    """
    left_sum, left_rows = np.cumsum(sums, axis=1), np.cumsum(counts, axis=1)
    total, rows = left_sum[:, -1:], left_rows[:, -1:]
    sides = node_score(left_sum / scale, left_rows, settings) + node_score(
        (total - left_sum) / scale, rows - left_rows, settings
    )
    gain = sides - node_score(total / scale, rows, settings)
    least = max(settings.child_rows, 1)
    gain = np.where((left_rows >= least) & (rows - left_rows >= least), gain, -np.inf)
    bins = np.argmax(gain, axis=1)
    at = np.arange(len(bins))
    return bins, gain[at, bins], left_sum[at, bins], left_rows[at, bins], total[:, 0], rows[:, 0]


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Evenly spread unsigned numbers, by the keys and the salt alone."""
    x = keys.astype(np.uint64) + np.uint64(((salt + 1) * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def sampled(keys: np.ndarray, share: float, salt: int) -> np.ndarray:
    """Which rows take part in a round, by their key and the round alone."""
    if share >= 1:
        return np.ones(len(keys), bool)
    return mixed(keys, salt) < np.uint64(int(share * (2**64 - 1)))


def quantile_edges(vectors: DataFrame, width: int, bins: int) -> list[list[float]]:
    """Ascending upper ends of all but the last bin of each feature, from one pass of sketches."""
    values = vectors.select(F.posexplode(vector_to_array("features")).alias("place", "value"))
    shares = [k / bins for k in range(1, bins)]
    found = values.groupBy("place").agg(F.percentile_approx("value", shares, 10 * bins).alias("edges"))
    edges = {row["place"]: sorted(set(row["edges"])) for row in found.collect()}
    return [edges.get(place, []) for place in range(width)]


def binned_chunks(vectors: DataFrame, edges: list[list[float]], base: float, columns: tuple[str, str, str]) -> DataFrame:
    """Rows as chunks: keys, labels, held-out flags, the first prediction and a matrix of bins."""
    key, label, held = columns
    cuts = [np.array(e) for e in edges]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_back: list[pa.RecordBatch] = []
        for batch in batches:
            held_back.append(batch)
            if sum(b.num_rows for b in held_back) >= CHUNK_ROWS:
                yield from packed(pa.Table.from_batches(held_back))
                held_back = []
        if held_back:
            yield from packed(pa.Table.from_batches(held_back))

    def packed(table: pa.Table) -> Iterator[pa.RecordBatch]:
        for at in range(0, table.num_rows, CHUNK_ROWS):
            part = table.slice(at, CHUNK_ROWS).combine_chunks()
            keys, labels, flags = (part.column(i).to_numpy() for i in range(3))
            x = part.column(3).combine_chunks().flatten().to_numpy().reshape(len(keys), len(cuts))
            bins = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)]).astype(np.uint8)
            guess = np.full(len(keys), base)
            arrays = (keys.astype("<i8"), labels.astype("<f8"), flags.astype("u1"), guess, bins)
            yield pa.RecordBatch.from_arrays(
                [pa.array([len(keys)], pa.int64()), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]],
                ["n", "key", "label", "held", "guess", "bins"],
            )

    features = vector_to_array("features").alias("x")
    return vectors.select(key, F.col(label).cast("double"), held, features).mapInArrow(run, CHUNKS)


class _Chunk:
    """One row of a chunk table as arrays, its prediction brought up to date by pending trees."""

    def __init__(self, batch: pa.RecordBatch, row: int, rate: float, pending: list[Tree]):
        kinds = ("<i8", "<f8", "u1", "<f8", "u1")
        found = [np.frombuffer(batch.column(i + 1)[row].as_py(), kind) for i, kind in enumerate(kinds)]
        self.keys, self.labels, held, guess, bins = found
        self.held = held.astype(bool)
        self.bins = bins.reshape(-1, len(self.keys)) if len(self.keys) else bins.reshape(0, 0)
        self.guess = guess
        for tree in pending:
            self.guess = self.guess + rate * np.array(tree.values)[self.nodes(tree)]

    def nodes(self, tree: Tree) -> np.ndarray:
        return tree.place(lambda f, rows: self.bins[f, rows], len(self.keys), np.array(tree.bins))


@dataclass
class _Pass:
    """What a pass over the chunks needs to know."""

    settings: TreeSettings
    scale: float
    salt: int
    pending: list[Tree]
    tree: Tree
    nodes: list[int]
    columns: list[int]
    #: Whether to add up the held-out error as well.
    judged: bool

    def chunks(self, batches: Iterator[pa.RecordBatch]) -> Iterator[_Chunk]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield _Chunk(batch, row, self.settings.rate, self.pending)

    def histograms(self, chunks: Iterable[_Chunk]):
        """Sums and counts per (node, feature, bin) of some chunks, and their held-out error."""
        shape = (len(self.nodes), len(self.columns), self.settings.bins)
        sums, counts = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        error = 0.0
        wanted = np.full(len(self.tree.features), -1)
        wanted[self.nodes] = np.arange(len(self.nodes))
        for chunk in chunks:
            missed = chunk.guess - chunk.labels
            if self.judged:
                error += float((missed[chunk.held] ** 2).sum())
            used = ~chunk.held & sampled(chunk.keys, self.settings.subsample, self.salt)
            place = wanted[chunk.nodes(self.tree)]
            at = np.flatnonzero(used & (place >= 0))
            if not len(at):
                continue
            parts = np.rint(missed[at] * self.scale)
            first = (place[at][None, :] * shape[1] + np.arange(shape[1])[:, None]) * shape[2]
            code = (first + chunk.bins[self.columns][:, at]).ravel()
            size = int(np.prod(shape))
            # A chunk's sums of whole parts are exact in floats.
            sums += np.bincount(code, np.tile(parts, shape[1]), size).astype(np.int64).reshape(shape)
            counts += np.bincount(code, minlength=size).reshape(shape)
        return sums, counts, error

    def _named(self) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(self.nodes, len(self.columns)), np.tile(self.columns, len(self.nodes))

    def partial(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's histograms, one row for each node and feature."""
        sums, counts, error = self.histograms(self.chunks(batches))
        nodes, features = self._named()
        flat = [a.reshape(-1, self.settings.bins) for a in (sums, counts)]
        used = np.flatnonzero(flat[1].any(axis=1))
        rows = [(int(nodes[i]), int(features[i]), flat[0][i].tobytes(), flat[1][i].tobytes(), 0.0) for i in used]
        rows.append((ERROR, 0, b"", b"", error))
        kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.float64())
        names = [c.split()[0] for c in PARTIAL.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


def grow_levels(root: Split | None, look, settings: TreeSettings, scale: float) -> Tree:
    """A tree in which all leaves with a gain split, level by level; one pass for each level."""
    tree, level = Tree(), {0: root} if root else {}
    for depth in range(1, settings.depth + 1):
        fresh = []
        for node, found in sorted(level.items()):
            fresh += tree.split(node, found, settings, scale)
        if not fresh or depth == settings.depth:
            break
        level = look(tree, fresh)
    return tree


def grow_best_first(root: Split | None, look, settings: TreeSettings, scale: float) -> Tree:
    """A tree in which the leaf of the largest gain splits next, until it has enough leaves.

    A pass looks at the children of all leaves that may still split, on a copy of the tree where
    they did; so a tree takes about as many passes as it is deep, not one for each split. Ties
    go to the leaf that came first.
    """
    tree, frontier = Tree(), {0: root} if root else {}
    #: What a pass found for the two children of a leaf.
    known: dict[int, tuple[Split | None, Split | None]] = {}
    while frontier and tree.leaves < settings.leaves:
        node = max(frontier, key=lambda n: (frontier[n].gain, -n))
        last = tree.leaves + 1 == settings.leaves
        if node not in known and not last:
            room = settings.leaves - tree.leaves
            likely = sorted(frontier, key=lambda n: (-frontier[n].gain, n))[:room]
            trial = Tree(**{name: list(column) for name, column in vars(tree).items()})
            children = {n: trial.split(n, frontier[n], settings, scale) for n in likely if n not in known}
            found = look(trial, [c for pair in children.values() for c in pair])
            known |= {n: (found.get(a), found.get(b)) for n, (a, b) in children.items()}
        pair = tree.split(node, frontier.pop(node), settings, scale)
        if not last:
            frontier |= {c: found for c, found in zip(pair, known.pop(node)) if found}
    return tree


@dataclass
class TreeModel:
    """A base value and trees added to it at one rate, over a vector of features."""

    name: str
    base: float
    rate: float
    width: int
    edges: list[list[float]]
    boosted: list[Tree]
    #: Held-out mean squared error after no tree, one tree, and so on; empty without such rows.
    errors: list[float] = field(default_factory=list)

    @property
    def trees(self) -> int:
        return len(self.boosted)

    @property
    def importances(self) -> list[float]:
        """Gain of each feature over all trees, summing to one where any split."""
        totals = np.zeros(self.width)
        for tree in self.boosted:
            for feature, gain in zip(tree.features, tree.gains):
                if feature >= 0:
                    totals[feature] += gain
        return [float(v) for v in totals / (totals.sum() or 1.0)]

    def bounds(self, tree: Tree) -> np.ndarray:
        return np.array([self.edges[f][b] if f >= 0 else 0.0 for f, b in zip(tree.features, tree.bins)])

    def values(self, x: np.ndarray) -> np.ndarray:
        """The prediction for each row of a matrix of features."""
        total = np.full(len(x), self.base)
        for tree in self.boosted:
            nodes = tree.place(lambda f, rows: x[rows, f], len(x), self.bounds(tree))
            total += self.rate * np.array(tree.values)[nodes]
        return total

    def transform(self, vectors: DataFrame) -> DataFrame:
        """Add the prediction as column ``name``; row-wise, in Arrow batches."""

        @F.pandas_udf("double")
        def predict(x: pd.Series) -> pd.Series:
            rows = np.stack(x.to_numpy()) if len(x) else np.zeros((0, self.width))
            return pd.Series(self.values(rows))

        return vectors.withColumn(self.name, predict(vector_to_array("features")))

    def save(self, spark: SparkSession, path: str) -> None:
        state = {**vars(self), "boosted": [asdict(t) for t in self.boosted]}
        constant_table(spark, [(json.dumps(state),)], "state").write.mode("overwrite").parquet(f"{path}/state")

    @staticmethod
    def load(spark: SparkSession, path: str) -> TreeModel:
        state = json.loads(spark.read.parquet(f"{path}/state").first()["state"])
        return TreeModel(**{**state, "boosted": [Tree(**t) for t in state["boosted"]]})


def _lowest(errors: list[float], patience: int) -> int:
    """The round of the lowest error before ``patience`` rounds brought no lower one."""
    best = 0
    for number, error in enumerate(errors):
        if error < errors[best]:
            best = number
        elif number - best >= patience:
            break
    return best


def drawn(settings: TreeSettings, width: int, number: int) -> list[int]:
    """The features of a round, by the seed and the round alone."""
    count = max(1, round(settings.column_share * width)) if width else 0
    return sorted(random.Random(settings.seed * 1_000_003 + number).sample(range(width), count))


def grown_tree(look, settings: TreeSettings, scale: float, root: Split) -> Tree:
    grow = grow_best_first if settings.leaves else grow_levels
    return grow(root, look, settings, scale)


def paths(tree: Tree) -> list[tuple]:
    """The path from the root to each node: (feature, bin, side) for each split."""
    found: list[tuple] = [()] * len(tree.features)
    # Children come after the node that they are split from.
    for node, feature in enumerate(tree.features):
        if feature >= 0:
            for side, child in enumerate((tree.left[node], tree.right[node])):
                found[child] = (*found[node], (feature, tree.bins[node], side))
    return found


def sibling(path: tuple) -> tuple | None:
    return (*path[:-1], (*path[-1][:2], 1 - path[-1][2])) if path else None


def found_splits(nodes, known: np.ndarray, columns, last, settings: TreeSettings, scale: float) -> dict[int, Split]:
    """The best split of each node that has one, from (sum or count, node, feature, bin)."""
    # Empty bins above a feature's last one hold no split, so most features need but a few.
    found = [np.zeros((len(nodes), len(columns)), kind) for kind in (int, float, int, int, int, int)]
    few = last[columns] < FEW_BINS
    for some, bins in ((few, FEW_BINS), (~few, settings.bins)):
        sums, counts = known[:, :, some, :bins].reshape(2, -1, min(bins, settings.bins))
        for column, fresh in zip(found, best_splits(sums, counts, settings, scale)):
            column[:, some] = fresh.reshape(len(nodes), -1)
    at = found[1].argmax(axis=1)
    best = zip(nodes, at, *[column[np.arange(len(nodes)), at].tolist() for column in found])
    return {n: Split(columns[i], *split) for n, i, *split in best if split[1] > LEAST_GAIN}


class _Held:
    """All rows of a table of a few chunks in one task, with what is known of the nodes of a round.

    Nodes go by their path from the root, (feature, bin, side) for each split, so that what is known
    of a node holds in every tree that has it.
    """

    def __init__(self, settings: TreeSettings, scale: float, chunks: list[_Chunk]):
        self.settings, self.scale = settings, scale
        names = ("keys", "labels", "held", "guess")
        self.keys, self.labels, self.held, self.guess = (np.concatenate([getattr(c, n) for c in chunks]) for n in names)
        self.bins = np.concatenate([c.bins for c in chunks], axis=1)
        counts = np.stack([np.bincount(column, minlength=settings.bins) for column in self.bins])
        self.common, self.last = counts.argmax(axis=1), (counts > 0).cumsum(axis=1).argmax(axis=1)
        self.rare = np.flatnonzero(counts.max(axis=1) >= COMMON_SHARE * len(self.keys))
        # The places among ``rare`` and bins that a row has outside the commonest bins, row after row.
        row, place = np.nonzero((self.bins[self.rare] != self.common[self.rare, None]).T)
        self.codes = (place * settings.bins + self.bins[self.rare[place], row]).astype(np.int32)
        self.many = np.bincount(row, minlength=len(self.keys))
        self.first = np.cumsum(self.many) - self.many

    def error(self) -> float:
        return float(((self.guess - self.labels)[self.held] ** 2).sum())

    def begin(self, salt: int, columns: list[int]) -> None:
        """A round: the rows and columns that take part, and the parts of the gradients."""
        self.columns = columns
        self.used = ~self.held & sampled(self.keys, self.settings.subsample, salt)
        # Sums of whole parts of up to TASK_ROWS rows are exact in floats.
        self.parts = np.rint((self.guess - self.labels) * self.scale)
        self.rows = {(): np.arange(len(self.keys))}
        self.known: dict[tuple, np.ndarray] = {}

    paths = staticmethod(paths)

    def column(self, feature: int) -> np.ndarray:
        """The rows' bins of a feature."""
        return self.bins[feature]

    def at(self, path: tuple) -> np.ndarray:
        """The rows of a node."""
        if path not in self.rows:
            feature, cut, _ = path[-1]
            rows = self.at(path[:-1])
            left = self.column(feature)[rows] <= cut
            self.rows[*path[:-1], (feature, cut, 0)], self.rows[*path[:-1], (feature, cut, 1)] = rows[left], rows[~left]
        return self.rows[path]

    def histogram(self, rows: np.ndarray) -> np.ndarray:
        return self.histograms([rows], np.full(len(self.common), self.settings.bins)).reshape(
            2, len(self.columns), self.settings.bins
        )

    def histograms(self, groups: list[np.ndarray], ends: np.ndarray) -> np.ndarray:
        """Sums and counts of groups of rows, (sum or count, group, cell): each column's bins below its end."""
        count, bins, rows = len(groups), self.settings.bins, np.concatenate(groups)
        place, parts = np.repeat(np.arange(count), [len(g) for g in groups]), self.parts[rows]
        rare = self._rare_histograms(rows, parts, place, count)
        places = dict(zip(self.rare.tolist(), range(len(self.rare))))
        first = {end: place * end for end in set(ends[self.columns].tolist())}
        total = []
        for column in self.columns:
            end = int(ends[column])
            if column in places:
                total.append(rare[:, :, places[column], :end])
                continue
            code = self.column(column)[rows].astype(np.intp)
            code += first[end]
            both = np.bincount(code, parts, count * end), np.bincount(code, minlength=count * end)
            total.append(np.stack([both[0].astype(np.int64), both[1]]).reshape(2, count, end))
        return np.concatenate(total, axis=2) if total else np.zeros((2, count, 0), np.int64)

    def _rare_histograms(self, rows: np.ndarray, parts: np.ndarray, place: np.ndarray, count: int) -> np.ndarray:
        """The histograms of the features that are counted outside their commonest bin."""
        many = self.many[rows]
        at = np.repeat(self.first[rows] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        size = len(self.rare) * self.settings.bins
        code = self.codes[at] + np.repeat(place * size, many)
        shape = (2, count, len(self.rare), self.settings.bins)
        both = [np.bincount(code, np.repeat(parts, many), count * size), np.bincount(code, minlength=count * size)]
        both = np.stack([a.astype(np.int64) for a in both]).reshape(shape)
        whole = np.stack([np.bincount(place, parts, count).astype(np.int64), np.bincount(place, minlength=count)])
        both[:, :, np.arange(len(self.rare)), self.common[self.rare]] = whole[:, :, None] - both.sum(axis=3)
        return both

    def look(self, tree: Tree, nodes: list[int]) -> dict[int, Split]:
        """The best split of each node that has one."""
        path_of = paths(tree)
        used = {path_of[n]: (rows := self.at(path_of[n]))[self.used[rows]] for n in nodes}
        for path in sorted(used, key=lambda p: len(used[p])):
            other = sibling(path)
            rest = other in self.known and path[:-1] in self.known
            self.known[path] = self.known[path[:-1]] - self.known[other] if rest else self.histogram(used[path])
        known = np.stack([self.known[path_of[n]] for n in nodes], axis=1)
        return found_splits(nodes, known, self.columns, self.last, self.settings, self.scale)

    def move(self, tree: Tree) -> None:
        """Add a tree to the predictions."""
        for path, feature, value in zip(paths(tree), tree.features, tree.values):
            if feature < 0:
                self.guess[self.at(path)] += self.settings.rate * value


class _Part(_Held):
    """The rows of a task where a table has many; bins of rare flags only where they aren't the commonest."""

    def __init__(self, settings: TreeSettings, scale: float, chunks: list[_Chunk]):
        super().__init__(settings, scale, chunks)
        self.place = np.full(len(self.bins), -1)
        dense = np.setdiff1d(np.arange(len(self.bins)), self.rare)
        self.place[dense] = np.arange(len(dense))
        self.bins, self.many, self.first = self.bins[dense], self.many.astype(np.int32), self.first.astype(np.int32)

    def column(self, feature: int) -> np.ndarray:
        if self.place[feature] >= 0:
            return self.bins[self.place[feature]]
        found = np.full(len(self.keys), self.common[feature], np.uint8)
        at = np.flatnonzero(self.codes // self.settings.bins == np.searchsorted(self.rare, feature))
        found[np.searchsorted(self.first, at, "right") - 1] = self.codes[at] % self.settings.bins
        return found

    def add(self, trees: list[Tree]) -> None:
        """Add trees of rounds before to the predictions."""
        for tree in trees:
            self.rows = {(): np.arange(len(self.keys))}
            self.move(tree)

    def begin(self, salt: int, columns: list[int]) -> None:
        super().begin(salt, columns)
        # No row that takes no part is looked at.
        self.rows = {(): np.flatnonzero(self.used)}


#: The predictions of parts in this Python worker, by fit and part: the trees added so far, and the values.
_GUESSES: OrderedDict[tuple[str, int], tuple[int, np.ndarray]] = OrderedDict()


@dataclass
class _Round:
    """A round as the tasks see it: the trees since the predictions were kept, ``first`` of them before."""

    fit: str
    first: int
    pending: list[Tree]
    salt: int
    columns: list[int]
    ends: np.ndarray

    def caught_up(self, number: int, part: _Part) -> _Part:
        """A part with the pending trees added, from what the worker remembers if it has that."""
        key, last = (self.fit, number), self.first + len(self.pending)
        done, guess = _GUESSES.get(key, (-1, None))
        if self.first <= done <= last and len(guess) == len(part.keys):
            part.guess = guess.copy()
        else:
            done = self.first
        part.add(self.pending[done - self.first :])
        _GUESSES[key] = last, part.guess
        _GUESSES.move_to_end(key)
        while len(_GUESSES) > GUESSES_KEPT:
            _GUESSES.popitem(last=False)
        return part

    def sums(self, parts: RDD, counted: list[tuple], judged: bool) -> tuple[np.ndarray, float]:
        """Sums and counts per (node, cell) of all rows, and their held-out error. Their size is that of the nodes."""

        def run(number: int, found: Iterator[_Part]) -> Iterator[tuple[np.ndarray, list[float]]]:
            # A worker goes through all objects after each task; the imported modules' take longer than a pass.
            if not gc.get_freeze_count():
                gc.freeze()
            for part in found:
                part = self.caught_up(number, part)
                part.begin(self.salt, self.columns)
                groups = [part.at(path) for path in counted]
                sums = part.histograms(groups, self.ends) if groups else np.zeros((2, 0, 0), np.int64)
                yield sums, [part.error()] if judged else []

        depth = 1 if parts.getNumPartitions() <= PARTS_AT_ONCE else 2
        sums, errors = parts.mapPartitionsWithIndex(run).treeReduce(
            lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=depth
        )
        # The last bits of a sum depend on its order.
        return sums, sum(sorted(errors))


def _rounds_over_tasks(parts, settings, scale, ends, first, rounds, fit) -> tuple[list[Tree], list[float]]:
    """Trees of some rounds, a few passes each, and the held-out error before each and after the last."""
    trees: list[Tree] = []
    errors: list[float] = []
    for number in range(first, first + rounds + 1):
        columns, last = drawn(settings, len(ends), number), number == first + rounds
        one = _Round(fit, first, list(trees), settings.seed + number, columns, ends)
        sums, error = one.sums(parts, [()] if columns and not last else [], True)
        errors.append(error)
        if last or not columns:
            break
        inside = np.arange(settings.bins) < ends[columns][:, None]
        known: dict[tuple, np.ndarray] = {}

        def learn(counted: list[tuple], sums: np.ndarray) -> None:
            for i, path in enumerate(counted):
                known[path] = np.zeros((2, *inside.shape), np.int64)
                known[path][:, inside] = sums[:, i]

        def look(tree: Tree, nodes: list[int]) -> dict[int, Split]:
            path_of = paths(tree)
            rows = {path_of[n]: (tree.rows[n], path_of[n]) for n in nodes}
            # Of two children the larger one's sums are what the smaller one's leave of their parent's.
            rest = [p for p in rows if p and sibling(p) in rows and rows[p] > rows[sibling(p)]]
            counted = [p for p in rows if p not in set(rest)]
            learn(counted, one.sums(parts, counted, False)[0])
            known.update({p: known[p[:-1]] - known[sibling(p)] for p in rest})
            return found_splits(nodes, np.stack([known[path_of[n]] for n in nodes], 1), columns, ends - 1, settings, scale)

        learn([()], sums)
        best = found_splits([0], known[()][:, None], columns, ends - 1, settings, scale)
        if 0 not in best:
            break
        trees.append(grown_tree(look, settings, scale, best[0]))
    return trees, errors


def _dealt(written: DataFrame, settings: TreeSettings, scale: float, tasks: int) -> RDD:
    """The chunks as parts, dealt in turn."""

    def part(found: Iterator[tuple]) -> Iterator[_Part]:
        # In a fixed order, as predictions are remembered by row.
        rows = [row for _, row in sorted(found, key=operator.itemgetter(0))]
        if rows:
            names = [c.split()[0] for c in CHUNKS.split(", ")]
            batches = (pa.RecordBatch.from_pydict({name: [row[name]] for name in names}) for row in rows)
            yield _Part(settings, scale, [_Chunk(batch, 0, settings.rate, []) for batch in batches])

    numbered = written.rdd.zipWithIndex().map(lambda pair: (pair[1], pair[0]))
    return numbered.partitionBy(tasks, lambda number: number % tasks).mapPartitions(part)


def _rounds_in_a_task(chunks, settings, scale, width, first, rounds) -> tuple[list[Tree], list[float]]:
    """The same where one task has all chunks, which are a few: it grows the trees of all the rounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = [_Chunk(batch, row, settings.rate, []) for batch in batches for row in range(batch.num_rows)]
        table = _Held(settings, scale, chunks) if chunks else None
        trees, errors = [], []
        for number in range(first, first + rounds + 1):
            columns = drawn(settings, width, number)
            errors.append(table.error() if table else 0.0)
            if number == first + rounds or not columns or not table:
                break
            table.begin(settings.seed + number, columns)
            best = table.look(Tree(), [0])
            if 0 not in best:
                break
            tree = grown_tree(table.look, settings, scale, best[0])
            trees.append(json.dumps(asdict(tree)))
            table.move(tree)
        lists = [pa.array([trees], pa.list_(pa.string())), pa.array([errors], pa.list_(pa.float64()))]
        yield pa.RecordBatch.from_arrays(lists, ["trees", "errors"])

    row = chunks.mapInArrow(run, "trees array<string>, errors array<double>").first()
    return [Tree(**json.loads(t)) for t in row["trees"]], list(row["errors"])


def fit_trees(
    vectors: DataFrame,
    settings: TreeSettings,
    *,
    name: str,
    label: str,
    held_out: str,
    key: str,
    edges: list[list[float]] | None = None,
    base: float | None = None,
) -> TreeModel:
    """Boost trees from the mean label on the rows that are not held out.

    ``key`` is a whole number by which rows are drawn in each round. With ``patience`` the trees
    up to the lowest held-out error are kept, at least one, and boosting ends once that many
    brought no lower one. Chunks are written to the shared folder; the running prediction is cached every few rounds and follows
    from the chunks and the trees if it is lost.
    """
    spark = vectors.sparkSession
    fitted = vectors.where(~F.col(held_out))
    facts = fitted.agg(F.avg(label), F.min(label), F.max(label)).first()
    # The last bits of a mean depend on the order of summation.
    base = float(f"{facts[0] or 0.0:.9g}") if base is None else float(base)
    largest = max((abs(float(v) - base) for v in facts[1:] if v is not None), default=0.0)
    scale = PARTS / (largest or 1.0)
    first = vectors.select(F.size(vector_to_array("features"))).first()
    width = first[0] if first else 0
    edges = quantile_edges(fitted, width, settings.bins) if edges is None else edges
    path = shared_dir(spark, "chunks")
    binned_chunks(vectors, edges, base, (key, label, held_out)).write.parquet(path)
    written = spark.read.schema(CHUNKS).parquet(path)
    counted = written.agg(F.sum("n"), F.count("n")).first()
    rows, pieces = counted[0] or 0, counted[1]
    held_rows = vectors.where(held_out).count()
    alone = rows <= TASK_ROWS
    if alone:
        chunks = keep(written.coalesce(1))
    else:
        cores, fit = spark.sparkContext.defaultParallelism, uuid.uuid4().hex
        tasks = min(pieces, cores * -(-rows // (cores * max(TASK_ROWS, 1))))
        ends = np.array([min(len(e) + 1, settings.bins) for e in edges], int)
        chunks = _dealt(written, settings, scale, tasks).persist(PARTS_KEPT)
    trees: list[Tree] = []
    errors: list[float] = []
    done = False
    while not done:
        number = len(trees)
        rounds = min(ROUNDS_KEPT, settings.rounds - number)
        if alone:
            grown, missed = _rounds_in_a_task(chunks, settings, scale, width, number, rounds)
        else:
            grown, missed = _rounds_over_tasks(chunks, settings, scale, ends, number, rounds, fit)
        if held_rows and settings.patience is not None:
            errors = errors[:number] + [m / held_rows for m in missed]
        trees += grown
        stalled = bool(errors) and len(trees) - int(np.argmin(errors)) >= settings.patience
        done = stalled or len(grown) < rounds or len(trees) == settings.rounds
        if not done:
            if alone:
                following = keep(chunks.mapInArrow(_moved(settings.rate, grown), CHUNKS))
            else:
                following = _moved_parts(chunks, _Round(fit, number, grown, 0, [], ends))
            following.count()
            chunks.unpersist()
            chunks = following
    chunks.unpersist()
    if errors and trees:
        kept = max(_lowest(errors, settings.patience), 1)
        trees, errors = trees[:kept], errors[: kept + 1]
    return TreeModel(name, base, settings.rate, width, edges, trees, errors)


def _moved(rate: float, pending: list[Tree]):
    """Chunks with their prediction moved by the trees."""
    pending = list(pending)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            guesses = [_Chunk(batch, row, rate, pending).guess.tobytes() for row in range(batch.num_rows)]
            place = batch.schema.get_field_index("guess")
            yield batch.set_column(place, "guess", pa.array(guesses, pa.binary()))

    return run


def _moved_parts(parts: RDD, one: _Round) -> RDD:
    """Parts with their prediction moved by the trees."""

    def run(number: int, found: Iterator[_Part]) -> Iterator[_Part]:
        for part in found:
            part = one.caught_up(number, part)
            part.rows = {}
            yield part

    return parts.mapPartitionsWithIndex(run).persist(PARTS_KEPT)


def split_gains(
    vectors: DataFrame, features: list[str], edges: list[list[float]], settings: TreeSettings, *, label: str, key: str
) -> DataFrame:
    """What each allowed split of the whole table gains: feature, threshold, left_rows, right_rows,
    gain, left_value, right_value. A table of the size of the edges."""
    settings = replace(settings, subsample=1.0, bins=max(map(len, edges)) + 1)
    flagged = vectors.withColumn("held_out", F.lit(False))
    largest = vectors.agg(F.max(F.abs(label))).first()[0] or 1.0
    scale = PARTS / float(largest)
    chunks = binned_chunks(flagged, edges, 0.0, (key, label, "held_out"))
    one = _Pass(settings, scale, 0, [], Tree(), [0], list(range(len(features))), False)
    partial = chunks.mapInArrow(one.partial, PARTIAL).where(F.col("node") != ERROR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for feature, sums, counts in zip(*[batch.column(i).to_pylist() for i in (1, 2, 3)]):
                totals[feature] = totals.get(feature, 0) + np.frombuffer(sums + counts, "<i8").reshape(2, -1)
        rows = []
        for feature, (sums, counts) in sorted(totals.items()):
            left, below, total, n = np.cumsum(sums), np.cumsum(counts), int(sums.sum()), int(counts.sum())
            for b, edge in enumerate(edges[feature]):
                a, c = int(left[b]), int(below[b])
                if min(c, n - c) < max(settings.child_rows, 1):
                    continue
                scores = [float(node_score(t / scale, m, settings)) for t, m in ((a, c), (total - a, n - c), (total, n))]
                values = [leaf_value(t / scale, m, settings) for t, m in ((a, c), (total - a, n - c))]
                rows.append((features[feature], edge, c, n - c, scores[0] + scores[1] - scores[2], *values))
        if rows:
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.int64()] + [pa.float64()] * 3
            names = ["feature", "threshold", "left_rows", "right_rows", "gain", "left_value", "right_value"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    schema = "feature string, threshold double, left_rows long, right_rows long, gain double, left_value double, right_value double"
    return partial.repartition("feature").mapInArrow(run, schema)
