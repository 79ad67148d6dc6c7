"""Passages that repeat across documents, by a sparse suffix array over words.

Suffixes start only at minimisers: of the runs of KGRAM words in any MINIMUM words, the one with
the smallest hash. A passage of MINIMUM words holds its own minimiser wherever it occurs, so no
repeat is lost. Minimisers whose run of words occurs in one document only are dropped; the others
are range-sorted over the cluster by the words that follow (and once more by the words before),
each is compared with its neighbours of other documents, and matches are extended to both sides.

A nearest neighbour agrees longest on the side that was sorted by, so the two orders tell how far
any match at a minimiser can reach. Where the matches found fall short of that reach, a third
document may hide behind the neighbours: there the windows of MINIMUM words around the minimiser
are compared by hash with those of all documents that have the same run, so nothing is lost.

Neighbours alone don't tell which documents share a passage. Every window of MINIMUM words of the
stretches found is therefore linked by hash to the least stretch that holds it, and the connected stretches
form a class. Exact copies of a text are hashed once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain.llm.bytewords import Words, word_slices
from valuegrain.llm.components import connected_components
from valuegrain.llm.simhash import xxh64_spans
from valuegrain.llm.tables import only, stored

#: Words of a passage at least.
MINIMUM = 50
#: Words of a run whose hash is compared.
KGRAM = 8
#: Bytes of a word's hash in the contexts that are compared.
WORD_BYTES = 3
#: Open runs that are sent to every task at most; more of them are joined by a shuffle.
SENT_RUNS = 100_000
#: Windows that a task gathers before it links those of equal hash and passes each on once.
MET_WINDOWS = 2_000_000
_REACH = MINIMUM - KGRAM
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> np.uint64:
    return np.uint64(pow(odd, -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def run_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """A hash of each run of ``length`` consecutive words, from the words' hashes."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    powers = np.cumprod(np.full(len(hashes), _STEP, np.uint64))
    back = np.cumprod(np.full(n, _inverse(int(_STEP)), np.uint64))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mixed(hashes) * powers, dtype=np.uint64)])
    return _mixed((sums[length:] - sums[:n]) * back)


def minimisers(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the runs that are the smallest of some MINIMUM words of one text.

    The first one counts if there are several. In MINIMUM words that are all the same it is
    every ``_REACH + 1``-th place of the stretch of that word, so text of one word over and over
    doesn't select all its places.
    """
    own = run_hashes(hashes, KGRAM)
    width = _REACH + 1
    if len(own) < width:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    index = np.arange(len(own))
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    since = index - np.maximum.accumulate(np.where(new, index, 0))
    windows = np.lib.stride_tricks.sliding_window_view(own, width)
    chosen = windows.argmin(axis=1) + index[: len(windows)]
    same = np.flatnonzero(since[width - 1 :] >= width - 1)
    chosen[same] = same + (-since[same]) % width
    places = np.unique(chosen)
    return places, own[places]


def _word_hashes(words: Words) -> np.ndarray:
    return xxh64_spans(words.data, words.starts, words.ends)


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(run, row, place) of the minimisers of each text."""
    for batch in batches:
        rows = batch.column(0).to_numpy()
        for words in word_slices(batch.column(1)):
            hashes = _word_hashes(words)
            keys, owners, places = [], [], []
            for d in np.flatnonzero(np.diff(words.bounds) >= MINIMUM):
                at, own = minimisers(hashes[words.bounds[d] : words.bounds[d + 1]])
                keys.append(own)
                places.append(at)
                owners.append(np.full(len(at), rows[words.first + d]))
            if keys:
                arrays = [np.concatenate(keys).view(np.int64), np.concatenate(owners), np.concatenate(places)]
                yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names=["run", "row", "place"])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chosen minimiser with the words behind and before it, as bytes that compare like them."""
    size = _REACH * WORD_BYTES
    for batch in batches:
        ids, rows, chosen = batch.column(0), batch.column(1).to_numpy(), batch.column(3)
        for words in word_slices(batch.column(2)):
            hashes = _word_hashes(words)
            codes = np.zeros((len(hashes), WORD_BYTES), np.uint8)
            for k in range(WORD_BYTES):
                # No code is zero throughout: zeros stand for the end of the text.
                codes[:, k] = (hashes >> np.uint64(8 * k)).astype(np.uint8)
            codes[:, 0] |= 1
            for d in range(words.texts):
                places = np.sort(np.asarray(chosen[words.first + d].as_py(), np.int64))
                low, high = words.bounds[d], words.bounds[d + 1]
                own = hashes[low:high]
                text = np.zeros((high - low + 2 * _REACH + KGRAM, WORD_BYTES), np.uint8)
                text[_REACH : _REACH + high - low] = codes[low:high]
                span = np.arange(_REACH)
                after = text[places[:, None] + _REACH + KGRAM + span[None, :]].reshape(len(places), size)
                before = text[places[:, None] + _REACH - 1 - span[None, :]].reshape(len(places), size)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(run_hashes(own, KGRAM)[places].view(np.int64)),
                        pa.array([r.tobytes() for r in after], pa.binary()),
                        pa.array([r.tobytes() for r in before], pa.binary()),
                        pa.array(np.full(len(places), rows[words.first + d])),
                        pa.array([ids[words.first + d].as_py()] * len(places), pa.int64()),
                        pa.array(places),
                    ],
                    names=["run", "after", "before", "row", "doc_id", "place"],
                )


CONTEXTS = "run long, after binary, before binary, row long, doc_id long, place long"
MATCHES = (
    "row long, doc_id long, start long, end long, partner long, edge boolean, reach long, "
    "run long, after binary, before binary, place long"
)
WINDOWS = "run long, window long, row long, doc_id long, start long"


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many leading words of each row of a and b agree; the end of a text agrees with nothing."""
    shape = (len(a), _REACH, WORD_BYTES)
    x, y = a.reshape(shape), b.reshape(shape)
    same = (x == y).all(axis=2) & x.any(axis=2)
    return np.where(same.all(axis=1), _REACH, same.argmin(axis=1))


def _bytes(column: pa.ChunkedArray) -> np.ndarray:
    size = _REACH * WORD_BYTES
    joined = column.combine_chunks()
    return np.frombuffer(b"".join(joined.to_pylist()), np.uint8).reshape(-1, size)


def _words_in(context: np.ndarray) -> np.ndarray:
    """How many words of the text each row of contexts has."""
    return context.reshape(len(context), _REACH, WORD_BYTES).any(axis=2).sum(axis=1)


def _compare(table: pa.Table, known: int, last: bool, first: bool, forward: bool) -> pa.RecordBatch | None:
    """Matches of the rows from ``known`` on with their neighbours of other documents.

    The rows are sorted by the words after (``forward``) or before; earlier ones are context.
    Unless ``last``, the final document's rows have to wait for what follows. Rows at either end
    of the part come back as edges. Rows with a reach have the words that the nearest neighbour
    shares on the sorted side; they are left out where it shares all words of the other side too,
    as its match then covers whatever any other document could share.
    """
    n = table.num_rows
    run, row = (table.column(c).to_numpy() for c in ("run", "row"))
    new = np.ones(n, bool)
    new[1:] = (run[1:] != run[:-1]) | (row[1:] != row[:-1])
    group = np.cumsum(new) - 1
    begin = np.flatnonzero(new)
    end = np.append(begin[1:], n)
    index = np.arange(known, n if last else begin[-1])
    if not len(index):
        return None
    after, before = _bytes(table.column("after")), _bytes(table.column("before"))
    place, ids = table.column("place").to_numpy(), table.column("doc_id")
    edge = np.zeros(n, bool)
    if first:
        edge |= group == 0
    if last:
        edge |= group == group[-1]
    parts, nearest = [], np.zeros(n, np.int64)
    room = _words_in(before if forward else after)
    for mate in (begin[group[index]] - 1, end[group[index]]):
        inside = (mate >= 0) & (mate < n)
        i, j = index[inside], mate[inside]
        same = run[i] == run[j]
        i, j = i[same], j[same]
        right, left = _common(after[i], after[j]), _common(before[i], before[j])
        shared, other = (right, left) if forward else (left, right)
        nearest[i] = np.maximum(nearest[i], 2 * shared + (other == room[i]))
        long = left + right + KGRAM >= MINIMUM
        i, j, left, right = i[long], j[long], left[long], right[long]
        parts.append((i, place[i] - left, place[i] + KGRAM + right, j, np.zeros(len(i), bool), np.full(len(i), -1)))
    ends = index[edge[index]]
    parts.append((ends, place[ends], place[ends], ends, np.ones(len(ends), bool), np.full(len(ends), -1)))
    unsure = index[(nearest[index] > 1) & (nearest[index] % 2 == 0)]
    parts.append((unsure, place[unsure], place[unsure], unsure, np.zeros(len(unsure), bool), nearest[unsure] // 2))
    i, start, stop, j, edges, reach = (np.concatenate(x) for x in zip(*parts))
    blank = pa.array(~edges)

    def kept(name: str) -> pa.Array:
        values = table.column(name).take(pa.array(i)).combine_chunks()
        return pc.if_else(blank, pa.scalar(None, values.type), values)

    return pa.RecordBatch.from_arrays(
        [
            pa.array(row[i]),
            ids.take(pa.array(i)).combine_chunks(),
            pa.array(start),
            pa.array(stop),
            ids.take(pa.array(j)).combine_chunks(),
            pa.array(edges),
            pa.array(reach, mask=reach < 0),
            pa.array(run[i]),
            kept("after"),
            kept("before"),
            pa.array(place[i]),
        ],
        names=["row", "doc_id", "start", "end", "partner", "edge", "reach", "run", "after", "before", "place"],
    )


def _neighbours(forward: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        known, first = 0, True
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if held.num_rows < 4096:
                continue
            out = _compare(held, known, False, first, forward)
            if out is not None:
                yield out
                # Go on from the last document's rows, with the one before them as context.
                own, row = (held.column(c).to_numpy() for c in ("run", "row"))
                change = np.flatnonzero((own[1:] != own[:-1]) | (row[1:] != row[:-1]))
                at = int(change[-1])
                held, known, first = held.slice(at), 1, False
        if held is not None:
            out = _compare(held, known, True, first, forward)
            if out is not None:
                yield out

    return run


def _sorted_matches(contexts: DataFrame, forward: bool) -> tuple[DataFrame, DataFrame]:
    """Matches between neighbours in one order over the whole cluster, and the reaches."""
    order = ["run", *(("after", "before") if forward else ("before", "after")), "row", "place"]
    compare = _neighbours(forward)
    found = contexts.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(compare, MATCHES)
    found = stored(found, "by-suffix" if forward else "by-prefix")
    # Rows at the ends of the sorted parts: a few for each part, whatever the input.
    edges = found.filter("edge").select("run", "after", "before", "row", "doc_id", "place").distinct()
    across = edges.repartition(1).sortWithinPartitions(*order).mapInArrow(compare, MATCHES)
    both = found.filter("not edge").union(across.filter("not edge"))
    reaches = both.filter("reach is not null").select("run", "row", "place", "reach")
    return both.filter("reach is null").select("row", "doc_id", "start", "end", "partner"), reaches


def _open_places(matches: DataFrame, after: DataFrame, before: DataFrame) -> DataFrame:
    """run, row, place of the minimisers at which the matches may fall short of the reach."""
    sides = after.withColumnRenamed("reach", "right").withColumn("left", F.lit(0).cast("long"))
    sides = sides.unionByName(before.withColumnRenamed("reach", "left").withColumn("right", F.lit(0).cast("long")))
    wide = sides.groupBy("run", "row", "place").agg(F.max("left").alias("left"), F.max("right").alias("right"))
    wide = wide.filter(F.col("left") + F.col("right") + KGRAM >= MINIMUM).select(
        "run", "row", "place", (F.col("place") - F.col("left")).alias("start"),
        (F.col("place") + KGRAM + F.col("right")).alias("end"),
    )
    known = matches.select("row", "start", F.col("end").alias("to"))
    met = wide.unionByName(known, allowMissingColumns=True)
    # A match that starts no later and ends no earlier covers all there can be.
    met = met.withColumn("covered", F.expr("max(to) over (partition by row order by start)"))
    return met.filter("place is not null and coalesce(covered, -1) < end").select("run", "row", "place")


def _prefix_hashes(context: np.ndarray, salt: int) -> np.ndarray:
    """Hashes of the first 0, 1, ... words of each row of contexts."""
    codes = context.reshape(len(context), _REACH, WORD_BYTES).astype(np.uint64)
    value = sum(codes[:, :, k] << np.uint64(8 * k) for k in range(WORD_BYTES))
    spot = (np.arange(1, _REACH + 1, dtype=np.uint64) + np.uint64(salt)) << np.uint64(8 * WORD_BYTES)
    sums = np.cumsum(_mixed(value + spot), axis=1, dtype=np.uint64)
    return np.concatenate([np.zeros((len(context), 1), np.uint64), sums], axis=1)


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of MINIMUM words around each minimiser that lie inside the text."""
    back = np.arange(_REACH + 1)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            table = pa.Table.from_batches([batch.slice(at, 4096)])
            after, before = _bytes(table.column("after")), _bytes(table.column("before"))
            inside = (back[None, :] <= _words_in(before)[:, None]) & (_REACH - back[None, :] <= _words_in(after)[:, None])
            sums = _prefix_hashes(after, 0)[:, ::-1] + _prefix_hashes(before, MINIMUM)
            row, m = np.nonzero(inside)
            start = table.column("place").to_numpy()[row] - m
            arrays = [table.column(c).combine_chunks().take(pa.array(row)) for c in ("run", "row", "doc_id")]
            arrays = [arrays[0], pa.array(_mixed(sums[row, m]).view(np.int64)), *arrays[1:], pa.array(start)]
            yield pa.RecordBatch.from_arrays(arrays, names=["run", "window", "row", "doc_id", "start"])


def _hidden_matches(contexts: DataFrame, places: DataFrame) -> DataFrame:
    """Matches of the windows around open places with windows of any other document.

    Windows are compared by the run's hash and 64 bits of their own. Only the open places get
    matches; their partners may be any. Windows are reduced per hash before they are shuffled.
    """
    runs = stored(places.select("run").distinct(), "open-runs")
    size = runs.count()
    columns = ["run", "after", "before", "row", "doc_id", "place"]
    runs = F.broadcast(runs) if size <= SENT_RUNS else runs
    alike = stored(contexts.join(runs, "run", "left_semi").select(columns), "open-contexts")
    least, most = F.min(F.struct("row", "doc_id")).alias("least"), F.max(F.struct("row", "doc_id")).alias("most")
    shared = alike.mapInArrow(_windows, WINDOWS).groupBy("run", "window").agg(least, most)
    shared = shared.filter("least.row != most.row")
    own = alike.join(places, ["run", "row", "place"], "left_semi").select(columns).mapInArrow(_windows, WINDOWS)
    partner = F.when(F.col("row") == F.col("least.row"), F.col("most.doc_id")).otherwise(F.col("least.doc_id"))
    return own.join(shared, ["run", "window"]).select(
        "row", "doc_id", "start", (F.col("start") + MINIMUM).alias("end"), partner.alias("partner")
    )


def _linked_windows(keys: list[np.ndarray], nodes: list[np.ndarray]) -> pa.RecordBatch:
    """(window, node, other): each window once with its first node; without window, links between nodes."""
    every, owner = np.concatenate(keys), np.concatenate(nodes)
    windows, first, back = np.unique(every, return_index=True, return_inverse=True)
    others = owner[first][back]
    links = np.unique(np.stack([owner, others], axis=1)[owner != others], axis=0)
    none = len(links)
    arrays = [
        pa.concat_arrays([pa.array(windows.view(np.int64)), pa.nulls(none, pa.int64())]),
        pa.array(np.concatenate([owner[first], links[:, 0]])),
        pa.concat_arrays([pa.nulls(len(windows), pa.int64()), pa.array(links[:, 1])]),
    ]
    return pa.RecordBatch.from_arrays(arrays, names=["window", "node", "other"])


def _stretch_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The windows of MINIMUM words of the stretches of each text, linked where they meet in one task."""
    keys, nodes = [], []
    for batch in batches:
        spans = batch.column(0)
        for words in word_slices(batch.column(1)):
            hashes = _word_hashes(words)
            for d in range(words.texts):
                own = run_hashes(hashes[words.bounds[d] : words.bounds[d + 1]], MINIMUM)
                for span in spans[words.first + d].as_py():
                    keys.append(own[span["start"] : span["end"] - MINIMUM + 1])
                    nodes.append(np.full(len(keys[-1]), span["node"], np.int64))
            if sum(map(len, keys)) > MET_WINDOWS:
                yield _linked_windows(keys, nodes)
                keys, nodes = [], []
    if keys:
        yield _linked_windows(keys, nodes)


def passage_classes(rows: DataFrame, stretches: DataFrame) -> DataFrame:
    """The stretches (row, start, end, ...) with ``class_row``, the same for those connected by shared windows.

    Stretches that share MINIMUM words with one another, directly or through others, are one class.
    Equal places of equal texts are one node, and one row of each text gives the windows.
    """
    twins = rows.select("row", F.xxhash64("text").alias("twin")).distinct().join(stretches.select("row").distinct(), "row")
    twins = stored(twins, "twins")
    noded = stored(stretches.join(twins, "row").withColumn("node", F.xxhash64("twin", "start")), "stretches")
    firsts = twins.groupBy("twin").agg(F.min("row").alias("row")).select("row")
    spans = noded.join(firsts, "row", "left_semi").groupBy("row").agg(F.collect_list(F.struct("start", "end", "node")).alias("spans"))
    texts = rows.dropDuplicates(["row"]).join(spans, "row").select("spans", "text")
    found = stored(texts.mapInArrow(_stretch_windows, "window long, node long, other long"), "windows")
    windows = found.filter("window is not null").select("window", "node")
    least = windows.groupBy("window").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b")
    # Written out, so that Spark can split the join at a hot window.
    least = stored(least.select("window", "a"), "shared-windows")
    edges = windows.join(least, "window").select("a", F.col("node").alias("b")).filter("a != b")
    met = found.filter("window is null").select(F.col("node").alias("a"), F.col("other").alias("b"))
    parts = connected_components(edges.union(met).distinct())
    return noded.join(parts, "node", "left").withColumn("class_row", F.coalesce("component", "node")).drop("component", "twin", "node")


def repeated_passages(docs: DataFrame) -> DataFrame:
    """doc_id, start, end, n_words, partners, class_id, class_size of each stretch of words that repeats elsewhere.

    A stretch is a union of overlapping passages of MINIMUM words or more that occur in another
    document as well; words are numbered from 0, the end lies outside. ``partners`` are the
    documents it was matched with (one at least for each passage, not all that share it). Stretches that
    share a passage, directly or through others, have one ``class_id``, the least doc_id among them
    (null if none has one), and ``class_size``, their number. Texts of any length are read whole.
    Null, empty and short texts have none. Rows that repeat both id and text count as one; rows
    with another id or without one are documents of their own. An empty table gives no rows.
    """
    rows = only(docs, "doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text"))
    runs = stored(rows.select("row", "text").mapInArrow(_candidates, "run long, row long, place long"), "runs")
    shared = runs.groupBy("run").agg(F.min("row").alias("a"), F.max("row").alias("b")).filter("a != b").select("run")
    # Written out, so that the join's sides are plain exchanges, which Spark can split at a hot run.
    shared = stored(shared, "shared-runs")
    chosen = runs.join(shared, "run").groupBy("row").agg(F.collect_set("place").alias("places"))
    contexts = rows.join(chosen, "row").select("doc_id", "row", "text", "places").mapInArrow(_contexts, CONTEXTS)
    contexts = stored(contexts, "contexts")
    forward, after = _sorted_matches(contexts, True)
    backward, before = _sorted_matches(contexts, False)
    matches = forward.union(backward)
    matches = matches.union(_hidden_matches(contexts, stored(_open_places(matches, after, before), "open-places")))
    reach = "max(end) over (partition by row order by start, end rows between unbounded preceding and 1 preceding)"
    fresh = matches.withColumn("starts", (F.col("start") > F.coalesce(F.expr(reach), F.lit(-1))).cast("int"))
    number = "sum(starts) over (partition by row order by start, end, starts desc rows unbounded preceding)"
    stretches = (
        fresh.withColumn("stretch", F.expr(number))
        .groupBy("row", "stretch")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            F.sort_array(F.collect_set("partner")).alias("partners"),
        )
    )
    classed = stored(passage_classes(rows, stretches.drop("stretch")), "classed")
    sizes = classed.groupBy("class_row").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    sizes = stored(sizes, "classes")
    width = (F.col("end") - F.col("start")).alias("n_words")
    return classed.join(sizes, "class_row").select("doc_id", "start", "end", width, "partners", "class_id", "class_size")
