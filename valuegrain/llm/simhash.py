"""SimHash fingerprints and their links within a Hamming radius, by pivot distance tables.

Every fingerprint is stored with a table of Hamming distances to fixed reference fingerprints
(pivots), computed once. Two fingerprints within the radius differ by at most the radius in each
coordinate (triangle inequality), so pairs whose largest coordinate difference exceeds it go
without a look at the fingerprints; the rest is verified by counting bits.

Distances to any reference lie close together, so pivots alone can't spread fingerprints over a
cluster. Pairs therefore meet in groups: of five blocks of bits, two at least are equal in any
pair that differs in three bits, so each fingerprint joins one group for each choice of two blocks.
Groups above a size are dealt out as pairs of chunks, so none has to fit into one task. What a
group returns is a spanning forest of its links, never all of its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm.bytewords import Words, single_spaced, word_slices
from valuegrain.llm.components import connected_components
from valuegrain.llm.tables import fresh, only, stored

SEED = 42
SHINGLE = 3
RADIUS = 3
#: Widths of the blocks of bits; RADIUS of them can differ, the others are equal.
BLOCKS = (13, 13, 13, 13, 12)
PIVOTS = 16
#: The stored pivot table: columns of eight distances, one in each byte.
TABLE = ("pivots_0", "pivots_1")
#: Fingerprints of a chunk; a larger group becomes pairs of chunks.
CHUNK = 2048

# Constants of the XXH64 specification.
P1 = np.uint64(0x9E3779B185EBCA87)
P2 = np.uint64(0xC2B2AE3D27D4EB4F)
P3 = np.uint64(0x165667B19E3779F9)
P4 = np.uint64(0x85EBCA77C2B2AE63)
P5 = np.uint64(0x27D4EB2F165667C5)


def _rotl(x: np.ndarray, r: int) -> np.ndarray:
    return (x << np.uint64(r)) | (x >> np.uint64(64 - r))


def xxh64_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each data[start:end]. Spans of 32 bytes or more go through the library."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    n = len(data) + 1
    u64 = np.ndarray((n,), "<u8", padded, 0, (1,))
    u32 = np.ndarray((n,), "<u4", padded, 0, (1,))
    length = ends - starts
    acc = np.uint64(seed) + P5 + length.astype(np.uint64)
    lanes = length >> 3
    for k in range(3):
        at = np.flatnonzero((lanes > k) & (length < 32))
        if not len(at):
            break
        x = acc[at] ^ (_rotl(u64[starts[at] + 8 * k] * P2, 31) * P1)
        acc[at] = _rotl(x, 27) * P1 + P4
    place = starts + 8 * lanes
    at = np.flatnonzero(((length & 4) > 0) & (length < 32))
    x = acc[at] ^ (u32[place[at]].astype(np.uint64) * P1)
    acc[at] = _rotl(x, 23) * P2 + P3
    place[at] += 4
    for k in range(3):
        at = np.flatnonzero(((length & 3) > k) & (length < 32))
        x = acc[at] ^ (padded[place[at] + k].astype(np.uint64) * P5)
        acc[at] = _rotl(x, 11) * P1
    acc ^= acc >> np.uint64(33)
    acc *= P2
    acc ^= acc >> np.uint64(29)
    acc *= P3
    acc ^= acc >> np.uint64(32)
    view = memoryview(padded)
    for i in np.flatnonzero(length >= 32):
        acc[i] = xxhash.xxh64_intdigest(view[starts[i] : ends[i]], seed)
    return acc


def _shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last words of the shingles, and the bounds of each text among them."""
    counts = np.diff(words.bounds)
    index = np.arange(len(words.starts))
    end = np.repeat(words.bounds[1:], counts)
    begin = np.repeat(words.bounds[:-1], counts)
    valid = (index + size <= end) | (index == begin)
    first = index[valid]
    last = np.minimum(first + size, end[valid]) - 1
    return first, last, np.concatenate([[0], np.cumsum(valid)])[words.bounds]


def fingerprints_of(words: Words, size: int = SHINGLE, piece: int = 1 << 16) -> np.ndarray:
    """The fingerprint of each text of a slice; zero without words."""
    words = single_spaced(words, lower=True)
    first, last, bounds = _shingles(words, size)
    total = np.zeros((words.texts, 64), np.int64)
    for a in range(0, len(first), piece):
        b = min(a + piece, len(first))
        hashes = xxh64_spans(words.data, words.starts[first[a:b]], words.ends[last[a:b]])
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        here = np.flatnonzero((bounds[1:] > a) & (bounds[:-1] < b) & (bounds[1:] > bounds[:-1]))
        total[here] += np.add.reduceat(bits, np.maximum(bounds[here], a) - a, axis=0, dtype=np.int32)
    ones = 2 * total > np.diff(bounds)[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view("<u8").reshape(-1)


def with_fingerprint(docs: DataFrame, name: str, text: str = "text") -> DataFrame:
    """The rows with the 64-bit fingerprint of their text as a long. Null text: no words, zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprints_of(w) for w in word_slices(batch.column(text))]
            values = np.concatenate([np.zeros(0, np.uint64), *values]).view(np.int64)
            yield batch.append_column(name, pa.array(values, pa.int64()))

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())])
    return docs.mapInArrow(run, schema)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: fixed, evenly mixed bit patterns."""
    return np.array([xxhash.xxh64_intdigest(b"pivot %d" % k, SEED) for k in range(count)], np.uint64)


def with_pivot_table(values: DataFrame, fp: str = "fp") -> DataFrame:
    """The rows with their distances to the pivots, packed into the columns of TABLE."""
    signed = [int(p) for p in pivots().view(np.int64)]

    def packed(some: list[int]) -> Column:
        far = [F.bit_count(F.col(fp).bitwiseXOR(F.lit(p).cast("long"))).cast("long") for p in some]
        return reduce(Column.bitwiseOR, [F.shiftleft(d, 8 * k) for k, d in enumerate(far)])

    return values.withColumns({name: packed(signed[8 * k : 8 * k + 8]) for k, name in enumerate(TABLE)})


def unpacked(columns: list[np.ndarray]) -> np.ndarray:
    """One row of distances for each value, from the columns of TABLE."""
    return np.stack(columns, axis=1).astype("<i8").view(np.int8)


def distances(values: np.ndarray) -> np.ndarray:
    return np.bitwise_count(values[:, None] ^ pivots()[None, :]).astype(np.int8)


def pivot_links(
    values: np.ndarray, radius: int, piece: int = 1 << 18, table: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius among the values of one group, whose pivot table is given.

    Sorted by the first pivot's distance, each value meets those at most the radius further on;
    the other pivots discard pairs by coordinate difference, then bits are counted.
    """
    table = distances(values) if table is None else table
    order = np.argsort(table[:, 0], kind="stable")
    table, sorted_values = table[order], values[order]
    end = np.searchsorted(table[:, 0], table[:, 0] + radius, "right")
    width = end - np.arange(len(values)) - 1
    total = np.concatenate([[0], np.cumsum(width)])
    left, right, row = [], [], 0
    while row < len(values):
        to = max(row + 1, int(np.searchsorted(total, total[row] + piece, "right")) - 1)
        a = np.repeat(np.arange(row, to), width[row:to])
        b = a + 1 + np.arange(total[to] - total[row]) - np.repeat(total[row:to] - total[row], width[row:to])
        for k in range(1, table.shape[1]):
            near = np.abs(table[a, k] - table[b, k]) <= radius
            a, b = a[near], b[near]
        close = np.bitwise_count(sorted_values[a] ^ sorted_values[b]) <= radius
        left.append(order[a[close]])
        right.append(order[b[close]])
        row = to
    return np.concatenate(left), np.concatenate(right)


def _pair_links(values: np.ndarray, table: np.ndarray, first: np.ndarray, radius: int) -> np.ndarray:
    """Of the groups of two that begin at the given places, those whose values link."""
    kept = first[np.abs(table[first] - table[first + 1]).max(axis=1, initial=0) <= radius]
    return kept[np.bitwise_count(values[kept] ^ values[kept + 1]) <= radius]


def _forest(values: np.ndarray, table: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a group as edges from each linked value to its class's first one."""
    a, b = pivot_links(values, radius, table=table)
    label = np.arange(len(values))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    linked = np.flatnonzero(label != np.arange(len(values)))
    return values[linked], values[label[linked]]


def _group_edges(radius: int):
    keys = ("table", "block", "one", "other")

    def links(rows: pa.Table) -> pa.RecordBatch:
        columns = [rows.column(k).to_numpy() for k in keys]
        values = rows.column("fp").to_numpy().view(np.uint64)
        table = unpacked([rows.column(k).to_numpy() for k in TABLE])
        new = np.zeros(len(values), bool)
        new[0] = True
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, len(values)))
        pair = _pair_links(values, table, starts[sizes == 2], radius)
        a, b = [values[pair]], [values[pair + 1]]
        for start, size in zip(starts[sizes > 2], sizes[sizes > 2]):
            x, y = _forest(values[start : start + size], table[start : start + size], radius)
            a.append(x)
            b.append(y)
        a, b = np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = pa.concat_tables([held, table]) if held is not None else table
            last = np.ones(held.num_rows, bool)
            for k in keys:
                c = held.column(k).to_numpy()
                last &= c == c[-1]
            cut = int(np.argmax(last))  # rows are sorted: the last group is a suffix
            if cut:
                yield links(held.slice(0, cut))
                held = held.slice(cut).combine_chunks()
        if held is not None and held.num_rows:
            yield links(held)

    return run


def _masks() -> list[int]:
    shifts = np.concatenate([[0], np.cumsum(BLOCKS)])
    blocks = [((1 << w) - 1) << int(s) for w, s in zip(BLOCKS, shifts)]
    return [blocks[i] | blocks[j] for i, j in combinations(range(len(BLOCKS)), len(BLOCKS) - RADIUS)]


def fingerprint_edges(values: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all values of column ``fp`` linked within RADIUS bits.

    ``values`` has each fingerprint once, with its pivot table if that is stored. The edges span the links: two values are connected by
    them if and only if a chain of links connects them.
    """
    if TABLE[0] not in values.columns:
        values = with_pivot_table(values)
    masks = [m - (1 << 64) if m >> 63 else m for m in _masks()]
    entries = [
        F.struct(F.lit(k).alias("table"), F.col("fp").bitwiseAND(F.lit(m).cast("long")).alias("block"))
        for k, m in enumerate(masks)
    ]
    keyed = values.select("fp", *TABLE, F.inline(F.array(*entries)))
    groups = keyed.groupBy("table", "block").agg(F.count("*").alias("size")).filter("size > 1")
    met = (
        keyed.join(groups, ["table", "block"])
        .withColumn("chunks", F.ceil(F.col("size") / CHUNK).cast("int"))
        .withColumn("own", F.pmod(F.xxhash64("fp", "table"), F.col("chunks")).cast("int"))
        .withColumn("mate", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .withColumns({"one": F.least("own", "mate"), "other": F.greatest("own", "mate")})
        .select("table", "block", "one", "other", "fp", *TABLE)
    )
    keys = ["table", "block", "one", "other"]
    dealt = met.repartition(*keys).sortWithinPartitions(*keys, "fp")
    return dealt.mapInArrow(_group_edges(RADIUS), "a long, b long")


def _placed(marked: DataFrame) -> DataFrame:
    """The rows of a stored frame (doc_id, fp, others) with their component_id."""
    values = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    values = stored(with_pivot_table(values), "distinct-fingerprints")
    linked = connected_components(fingerprint_edges(values.select("fp", *TABLE)))
    linked = linked.select(F.col("node").alias("fp"), "component")
    labelled = values.select("fp", "least").join(linked, "fp", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "fp"))
    least = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    places = labelled.join(least, "component").select("fp", "component_id")
    return marked.join(places, "fp")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fp (long) and component_id of every row: the smallest doc_id reachable by links.

    Null and blank texts have fingerprint zero and link like any other. Very long texts are taken
    whole, in pieces. Rows that repeat, with or without an id, get the component of their
    fingerprint; a component in which no row has an id has none. An empty table gives no rows.
    Other columns are not looked at.
    """
    rows = only(docs, doc_id, text).toDF("doc_id", "text")
    marked = stored(with_fingerprint(rows, "fp").select("doc_id", "fp"), "fingerprints")
    return _placed(marked).select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each component, the one with the smallest doc_id; columns as before.

    Rows without an id stay only if none of their component has one. Rows that repeat both id and
    fingerprint count as one. An empty table gives no rows. The rows are stored once with their
    fingerprint and a place, so that texts are fingerprinted once and then picked by place.
    """
    fp, at = fresh(docs, "fp"), fresh(docs, "at")
    marked = stored(with_fingerprint(docs, fp).withColumn(at, F.monotonically_increasing_id()), "marked")
    placed = _placed(marked.select("doc_id", F.col(fp).alias("fp"), F.col(at).alias("at")))
    # Without an id in its component, a row stands for its fingerprint alone.
    alone = F.when(F.col("component_id").isNull(), F.col("fp")).alias("alone")
    first = placed.groupBy("component_id", alone).agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "fp", "at")).alias("kept")
    )
    return marked.join(first.select(F.col("kept.at").alias(at)), at, "left_semi").select(*docs.columns)
