"""Ranked lexical search by presence masks.

Documents are gathered into chunks. For an item (a query text) a chunk's documents are told apart
by the mask of the item's terms that they hold, found by operations on the terms' bitmaps. A
mask's maximum score, the sum of the largest contributions of its terms in the chunk, bounds the
scores of all its documents. Masks are evaluated from the largest maximum on until the next one
lies below the k-th score found; documents without any of the terms that could reach that score
get no mask at all. Scores are exact integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm.slices import as_bytes, byte_slices, schema_of
from valuegrain.llm.tables import only, stored

TOP = 10
#: Documents of a chunk, and bytes of their texts, at most (or one longer text).
CHUNK_DOCS, CHUNK_BYTES = 8192, 16 << 20
#: Bytes of an item block's terms, about: what each task holds of the items.
ITEM_BYTES = 4 << 20
#: Documents that the first masks evaluated hold, at least; doubled from wave to wave.
WAVE = 128
#: Bytes of bitmaps that are remembered with a chunk.
BITMAP_BYTES = 64 << 20

#: Bytes that belong to terms, upper case lowered; all others become spaces.
FOLDED = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms(text: bytes) -> list[bytes]:
    """Runs of ASCII letters, digits and characters beyond ASCII; only A-Z are lower-cased.

    Longer UTF-8 characters have no bytes below 128, so bytes can be looked at one by one.
    """
    return text.translate(FOLDED).split()


def item_terms(items: DataFrame) -> DataFrame:
    """item (a number for each row), item_id, terms, repeats, and size: bytes of the terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1):
            counted = [Counter(terms(text)) for text in as_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([list(c) for c in counted], pa.list_(pa.binary())),
                    pa.array([list(c.values()) for c in counted], pa.list_(pa.int64())),
                    pa.array([sum(map(len, c)) + 16 * len(c) for c in counted], pa.int64()),
                ],
                ["item_id", "terms", "repeats", "size"],
            )

    schema = schema_of(items.schema["item_id"], more="terms array<binary>, repeats array<long>, size long")
    found = only(items, "item_id", "text").mapInArrow(run, schema).filter("size > 0")
    return stored(found.withColumn("item", F.monotonically_increasing_id()), "items")


def item_blocks(found: DataFrame, limit: int = ITEM_BYTES) -> tuple[DataFrame, int]:
    """Items with a block number, and how many blocks there are.

    Blocks go by a hash of the item. Their sizes are checked: there are as many blocks as it takes
    to hold each below twice the limit, or until each has one item.
    """
    total = found.agg(F.sum("size").alias("size"), F.count("*").alias("n")).first()
    blocks = max(1, math.ceil((total["size"] or 0) / limit))
    while True:
        numbered = found.withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)))
        held = numbered.groupBy("block").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
        if blocks == 1 or held.filter(f"size > {2 * limit} and n > 1").isEmpty():
            return numbered, blocks
        blocks *= 2


POSTINGS = ["n", "codes", "held", "docs", "counts"]


def _postings(texts: list[bytes], vocabulary: dict[bytes, int]) -> tuple[np.ndarray, ...]:
    """Terms in each text; then the vocabulary's terms found, how many texts hold each, and for
    each term in turn the texts with it and how often."""
    sizes = np.zeros(len(texts), np.int64)
    docs, codes, counts = [], [], []
    for i, text in enumerate(texts):
        found = terms(text)
        sizes[i] = len(found)
        known = Counter(map(vocabulary.get, found))
        known.pop(None, None)
        codes.extend(known)
        counts.extend(known.values())
        docs.append(len(known))
    code = np.array(codes, np.int64)
    doc = np.repeat(np.arange(len(texts)), docs)
    order = np.argsort(code, kind="stable")
    present, held = np.unique(code, return_counts=True)
    return sizes, present, held.astype(np.int64), doc[order].astype(np.int64), np.array(counts, np.int64)[order]


def chunk_postings(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """Chunks of documents with their postings for the vocabulary, each a row; stored.

    ``ids`` of a chunk are in ascending order, null last, so places in a chunk break ties.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1, CHUNK_BYTES, CHUNK_DOCS):
            order = pc.sort_indices(batch.column(0), null_placement="at_end")
            batch = batch.take(order)
            found = _postings(as_bytes(batch.column(1)), vocabulary)
            sizes = found[0]
            yield pa.RecordBatch.from_arrays(
                [pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), batch.column(0))]
                + [pa.array([a.astype("<i8").tobytes()], pa.binary()) for a in found]
                + [pa.array([int(v)], pa.int64()) for v in ((sizes > 0).sum(), sizes.sum())],
                ["ids", *POSTINGS, "full_docs", "all_terms"],
            )

    ids = T.StructField("ids", T.ArrayType(docs.schema["doc_id"].dataType))
    binaries = ", ".join(f"{name} binary" for name in POSTINGS)
    schema = schema_of(ids, more=f"{binaries}, full_docs long, all_terms long")
    return stored(only(docs, "doc_id", "text").mapInArrow(run, schema), "postings")


def term_weights(chunks: DataFrame, size: int, full_docs: int) -> np.ndarray:
    """The weight of each term of a vocabulary of ``size`` terms, by how many documents hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(size, np.int64)
        for batch in batches:
            for codes, counts in zip(as_bytes(batch.column(0)), as_bytes(batch.column(1))):
                held[np.frombuffer(codes, "<i8")] += np.frombuffer(counts, "<i8")
        known = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(held[known])], ["code", "held"])

    held = chunks.select("codes", "held").mapInArrow(run, "code long, held long")
    weights = np.zeros(size, np.int64)
    # At most one row for each term of the block of items.
    for row in held.groupBy("code").agg(F.sum("held").alias("held")).collect():
        weights[row["code"]] = math.floor(1000 * math.log((2 * full_docs + 2) / (2 * row["held"] + 1)))
    return weights


def _masks(present: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct columns of a matrix of bits (terms by documents): the index of one document of
    each, the documents sorted by mask, and where each mask's documents begin."""
    packed = np.packbits(present, axis=0, bitorder="little")
    wide = np.zeros((packed.shape[1], -(-packed.shape[0] // 8) * 8), np.uint8)
    wide[:, : packed.shape[0]] = packed.T
    keys = wide.view(np.uint64)
    order = np.lexsort(keys.T)
    ordered = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = (ordered[1:] != ordered[:-1]).any(axis=1)
    begins = np.flatnonzero(new)
    return order[begins], order, np.append(begins, len(order))


class Chunk:
    """Postings of a chunk with each document's contribution for each term."""

    def __init__(self, n: np.ndarray, codes, held, docs, counts, weights: np.ndarray, full_docs: int, all_terms: int):
        self.size = len(n)
        most = 75 * int(n.max(initial=0)) * full_docs
        exact = n.astype(object) if most >= 1 << 63 else n
        length = (25 + (75 * exact * full_docs) // max(all_terms, 1)).astype(np.int64)
        ends = np.cumsum(held)
        self.spans = {int(c): (int(e - h), int(e)) for c, h, e in zip(codes, held, ends)}
        self.docs = docs
        per_term = (1_000_000_000 * counts) // (1000 * counts + 8 * length[docs])
        self.scores = per_term * np.repeat(weights[codes], held)
        starts = ends - held
        self.most = dict(zip(codes.tolist(), np.maximum.reduceat(self.scores, starts).tolist())) if len(codes) else {}
        self.bitmaps: dict[int, np.ndarray] = {}

    def bitmap(self, code: int) -> np.ndarray:
        found = self.bitmaps.get(code)
        if found is None:
            if len(self.bitmaps) * self.size > 8 * BITMAP_BYTES:
                self.bitmaps.clear()
            begin, end = self.spans[code]
            bits = np.zeros(self.size, bool)
            bits[self.docs[begin:end]] = True
            found = self.bitmaps[code] = np.packbits(bits, bitorder="little")
        return found

    def evaluate(self, codes: list[int], repeats: np.ndarray, present: np.ndarray, at: np.ndarray, members) -> np.ndarray:
        """Exact scores of documents ``at[members]``; ``present`` tells which terms they hold."""
        scores = np.zeros(len(members), np.int64)
        for j, code in enumerate(codes):
            has = np.flatnonzero(present[j, members])
            begin, end = self.spans[code]
            places = begin + np.searchsorted(self.docs[begin:end], at[members[has]])
            scores[has] += repeats[j] * self.scores[places]
        return scores

    def search(self, item: list[tuple[int, int]], best: Best) -> int:
        """Meet one item, given as (term code, repeats); how many documents were evaluated."""
        known = [(r * self.most[c], c, r) for c, r in item if self.most.get(c, 0) > 0]
        known.sort(reverse=True)
        if not known:
            return 0
        most = np.array([k[0] for k in known], np.int64)
        codes = [k[1] for k in known]
        repeats = np.array([k[2] for k in known], np.int64)
        # Without any of the leading terms a document stays below the k-th score.
        behind = np.append(np.cumsum(most[::-1])[::-1], 0)
        leading = int(np.argmax(behind < best.least))
        if not leading:
            return 0
        bitmaps = np.stack([self.bitmap(c) for c in codes])
        some = np.bitwise_or.reduce(bitmaps[:leading], axis=0)
        at = np.flatnonzero(np.unpackbits(some, count=self.size, bitorder="little"))
        present = np.unpackbits(bitmaps, axis=1, count=self.size, bitorder="little")[:, at]
        one, order, begins = _masks(present)
        bounds = most @ present[:, one].astype(np.int64)
        ranked = np.argsort(-bounds, kind="stable")
        sizes = np.diff(begins)[ranked]
        ends = np.cumsum(sizes)
        done, evaluated, wave = 0, 0, WAVE
        while done < len(ranked) and bounds[ranked[done]] >= best.least:
            to = int(np.searchsorted(ends, evaluated + wave)) + 1
            group = ranked[done:to]
            group = group[bounds[group] >= best.least]
            members = np.concatenate([order[begins[g] : begins[g + 1]] for g in group])
            best.add(at[members], self.evaluate(codes, repeats, present, at, members))
            evaluated += len(members)
            done, wave = to, 2 * wave
        return evaluated


class Best:
    """The best documents of one item so far; ties go to the smaller id, null last."""

    def __init__(self, k: int):
        self.k = k
        self.rows: list[tuple] = []
        self.ids: list = []

    @property
    def least(self) -> int:
        """The lowest score that can still get in."""
        return -self.rows[-1][0] if len(self.rows) == self.k else 1

    def add(self, places: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= self.least
        places, scores = places[good], scores[good]
        if len(scores) > self.k:
            chosen = np.lexsort((places, -scores))[: self.k]
            places, scores = places[chosen], scores[chosen]
        new = [(-s, self.ids[p] is None, self.ids[p] if self.ids[p] is not None else 0, p) for s, p in zip(scores.tolist(), places.tolist())]
        self.rows = sorted([*self.rows, *new], key=lambda row: row[:3])[: self.k]


def search_chunks(
    chunks: DataFrame, items: dict[int, list[tuple[int, int]]], weights: np.ndarray, full_docs: int, all_terms: int, k: int
) -> DataFrame:
    """The k best documents of each item in each task: item, doc_id, score, and evaluated, the
    number of documents whose score the task worked out for the item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {item: Best(k) for item in items}
        evaluated: Counter = Counter()
        kind = None
        for batch in batches:
            for row in range(batch.num_rows):
                ids = batch.column(0).slice(row, 1).flatten()
                kind = ids.type
                ids = ids.to_pylist()
                arrays = [np.frombuffer(batch.column(i)[row].as_py(), "<i8") for i in range(1, 6)]
                chunk = Chunk(*arrays, weights, full_docs, all_terms)
                for item, wanted in items.items():
                    best[item].ids = ids
                    evaluated[item] += chunk.search(wanted, best[item])
        rows = [(item, r[2] if not r[1] else None, -r[0], evaluated[item]) for item, b in best.items() for r in b.rows]
        if rows:
            columns = zip(zip(*rows), (pa.int64(), kind, pa.int64(), pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in columns], ["item", "doc_id", "score", "evaluated"])

    doc_id = T.StructField("doc_id", chunks.schema["ids"].dataType.elementType)
    schema = schema_of(T.StructField("item", T.LongType()), doc_id, more="score long, evaluated long")
    return chunks.select("ids", *POSTINGS).mapInArrow(run, schema)


def _search_block(docs: DataFrame, block: DataFrame, k: int) -> DataFrame:
    # Bounded by the block's size, which item_blocks checks.
    rows = block.select("item", "terms", "repeats").collect()
    vocabulary: dict[bytes, int] = {}
    items = {}
    for row in rows:
        codes = [vocabulary.setdefault(bytes(t), len(vocabulary)) for t in row["terms"]]
        items[row["item"]] = list(zip(codes, row["repeats"]))
    chunks = chunk_postings(docs, vocabulary)
    total = chunks.agg(F.sum("full_docs").alias("docs"), F.sum("all_terms").alias("terms")).first()
    full_docs, all_terms = total["docs"] or 0, total["terms"] or 0
    weights = term_weights(chunks, len(vocabulary), full_docs)
    found = search_chunks(chunks, items, weights, full_docs, all_terms, k)
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.join(block.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, item_bytes: int = ITEM_BYTES) -> DataFrame:
    """The k documents with the highest scores of each item: item_id, rank, doc_id, score.

    Only scores above 0 count; ties go to the smaller doc_id, null last. Ids of any type that
    sorts. Items are searched in blocks, each with one pass over the documents. Null texts have no
    terms. Each row of either table counts for itself, repeated ones and null ids included. Items
    without terms and empty tables give no rows. Texts count whole; other columns are ignored.
    """
    numbered, blocks = item_blocks(item_terms(items), item_bytes)
    found = None
    for number in range(blocks):
        one = _search_block(docs, numbered.filter(F.col("block") == number), k)
        found = one if found is None else found.unionByName(one)
    return found
