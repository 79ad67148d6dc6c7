"""Packing tokens into fixed windows by minimum bin slack.

Documents become token ids plus a closing id and are cut into whole windows and one shorter
remainder. Only the number of remainders of each length matters for packing: at most
``window - 1`` numbers, whatever the input. A bitset subset-sum over these numbers picks the
multiset of lengths that fills a window with the least slack, is applied as often as the numbers
allow, and so on. Lengths for which no window fills up are laid end to end and cut at the window,
as documents may be cut freely, so at most one window of the result has padding.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.llm.tables import only, stored

WINDOW = 1024
CLOSING_ID = 0
#: The public byte-level vocabulary as ranks; its ids are those of byte_bpe_50k.json.
VOCABULARY = "byte_bpe_50k.tiktoken"
SPECIAL = "<|endoftext|>"
#: The same vocabulary for the library that defines the ids.
LIBRARY_FILE = "byte_bpe_50k.json"
#: Pieces of text a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
#: Runs of white space or of other characters as long as this go to the vocabulary's own library.
LONG_RUN = 10_000
_LONG = re.compile(rf"\s{{{LONG_RUN}}}|\S{{{LONG_RUN}}}")

PIECES = (
    "part long, doc_id long, start long, length long, doc_tokens long, ids binary, ids_crc32 long, "
    "whole boolean, place long"
)


class _Odd(Exception):
    """A piece that can't be encoded apart from its neighbours."""


class Encoder(dict):
    """Ids of a text as little-endian 32-bit bytes.

    The vocabulary's pattern always ends a token before a space between two characters that
    aren't white space. Texts are cut there, and the ids of the pieces, which repeat a lot, are
    looked up. Texts in which white space meets a space are encoded whole.
    """

    def __init__(self, vocabulary: str):
        super().__init__()
        import public_tokenizers
        import tiktoken

        self.slow = None
        self.plain = public_tokenizers.path(LIBRARY_FILE)

        with open(public_tokenizers.path(vocabulary), "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.codec = tiktoken.Encoding(
            "ranks",
            pat_str=public_tokenizers.PATTERN,
            mergeable_ranks=ranks,
            special_tokens={SPECIAL: len(ranks)},
        )

    def whole(self, text: str) -> bytes:
        # The fast encoder's recursion ends a task on white space of a million characters, and its
        # merging takes the square of a run's length.
        if len(text) >= LONG_RUN and _LONG.search(text):
            return self.by_library(text)
        if SPECIAL in text:
            ids = self.codec.encode(text, allowed_special="all")
        else:
            ids = self.codec.encode_ordinary(text)
        return np.array(ids, "<u4").tobytes()

    def by_library(self, text: str) -> bytes:
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.plain)
        return np.array(self.slow.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise _Odd
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[piece] = self.whole(" " + piece)
        return ids

    def encode(self, text: str) -> bytes:
        head, space, tail = text.partition(" ")
        if not space:
            return self.whole(text)
        if not head or head[-1].isspace():
            return self.whole(text)
        try:
            return self.whole(head) + b"".join(map(self.__getitem__, tail.split(" ")))
        except _Odd:
            return self.whole(text)


@lru_cache(maxsize=2)
def encoder(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


def token_pieces(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """Each document's ids cut into whole windows and a remainder.

    ``place`` numbers the whole windows of a task, and the remainders of each length of a task;
    ``part`` is the task. Null text counts as empty: it has the closing id alone.
    """
    closing = np.array([CLOSING_ID], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, places, encode = TaskContext.get().partitionId(), Counter(), encoder(vocabulary).encode
        schema = pa.schema(
            [("part", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64())]
            + [("doc_tokens", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64())]
            + [("whole", pa.bool_()), ("place", pa.int64())]
        )
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                some = batch.slice(at, 256)
                for doc_id, text in zip(some.column(0).to_pylist(), some.column(1)):
                    ids = encode(text.as_py() or "") + closing
                    n = len(ids) // 4
                    for start in range(0, n, window):
                        own = ids[4 * start : 4 * (start + window)]
                        size = len(own) // 4
                        key = size
                        rows.append((part, doc_id, start, size, n, own, zlib.crc32(own), size == window, places[key]))
                        places[key] += 1
                columns = [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else None
                if columns:
                    yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return only(docs, "doc_id", "text").mapInArrow(run, PIECES)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the largest sum up to the capacity.

    Bit s of a stage's bitset is set if the lengths so far can sum to s. Going back through the
    stages tells how many of each length the sum takes.
    """
    stages, reach, limit = [], 1, (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        if length > capacity or not counts[length]:
            continue
        stages.append((length, reach))
        step = reach
        for _ in range(min(counts[length], capacity // length)):
            step = (step << length) & limit
            if not step:
                break
            reach |= step
        if reach >> capacity:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, before in reversed(stages):
        while not before >> total & 1:
            total -= length
            taken[length] = taken.get(length, 0) + 1
    return taken


def plan_windows(histogram: dict[int, int], window: int = WINDOW, slack: int = 0):
    """Windows for the numbers of remainders of each length.

    Returns (patterns, rest). A pattern (repeats, {length: count}) is a multiset that fills a
    window up to the slack, and how many windows take it. rest: the remainders left over.
    """
    stock = {n: c for n, c in histogram.items() if c}
    patterns, rest = [], {}
    while stock:
        first = max(stock)
        stock[first] -= 1
        taken = fill(stock, window - first)
        stock[first] += 1
        taken[first] = taken.get(first, 0) + 1
        if window - sum(n * c for n, c in taken.items()) > slack:
            rest[first] = stock.pop(first)
            continue
        repeats = min(stock[n] // c for n, c in taken.items())
        patterns.append((repeats, taken))
        for n, c in taken.items():
            stock[n] -= repeats * c
            if not stock[n]:
                del stock[n]
    return patterns, rest


def _plan_rows(patterns, rest, window: int):
    """Per length the ranges of ranks, each with where its pieces go; and the windows planned."""
    ranges: dict[int, list[tuple]] = {}
    used: Counter = Counter()
    sequence = 0
    for repeats, taken in patterns:
        offset = 0
        for length in sorted(taken, reverse=True):
            count = taken[length]
            begin, used[length] = used[length], used[length] + repeats * count
            ranges.setdefault(length, []).append((begin, used[length], count, sequence, offset))
            offset += length * count
        sequence += repeats
    line = 0
    for length in sorted(rest, reverse=True):
        begin, used[length] = used[length], used[length] + rest[length]
        ranges.setdefault(length, []).append((begin, used[length], 0, sequence, line))
        line += length * rest[length]
    return [(n, r) for n, r in ranges.items()], sequence + -(-line // window)


def _place(plan: str, name: str) -> Column:
    return F.col(plan)[name]


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str = VOCABULARY) -> DataFrame:
    """Pieces of all documents with their places in windows of at most ``window`` ids.

    Columns: doc_id, start, length, ids (little-endian 32-bit), ids_crc32, doc_tokens,
    sequence_id, offset. Each id of each document is in one piece; offsets of a sequence have no
    gaps. sequence_id is unique to a window, not dense. Null or empty text gives one piece, the
    closing id. Repeated rows and those with a null id are packed each. Texts are encoded whole,
    whatever their length and however long their runs. An empty table gives no rows.
    """
    spark = docs.sparkSession
    pieces = stored(token_pieces(docs, window, vocabulary), "pieces")
    loose = pieces.filter(~F.col("whole"))
    counts = loose.groupBy("part", "length").agg(F.count("*").alias("n"))
    # One row for each length below the window: bounded, whatever the input.
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows, planned = _plan_rows(*plan_windows(histogram, window), window)
    plan = spark.createDataFrame(
        rows,
        "length long, ranges array<struct<begin:long,end:long,count:long,sequence:long,offset:long>>",
    )
    before = F.expr("sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding)")
    bases = counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("base"))
    ranked = (
        loose.join(bases.join(plan, "length"), ["part", "length"])
        .withColumn("rank", F.col("base") + F.col("place"))
        .withColumn("r", F.filter("ranges", lambda x: (F.col("rank") >= x["begin"]) & (F.col("rank") < x["end"]))[0])
        .withColumn("k", F.col("rank") - F.col("r.begin"))
    )
    same = ["doc_id", "start", "length", "ids", "ids_crc32", "doc_tokens"]
    count = F.col("r.count")
    windows = ranked.filter(count > 0).select(
        *same,
        (F.col("r.sequence") + F.floor(F.col("k") / count)).cast("long").alias("sequence_id"),
        (F.col("r.offset") + F.pmod(F.col("k"), count) * F.col("length")).alias("offset"),
    )
    # The rest lies end to end; a piece that crosses a window's end is cut there.
    line = ranked.filter(count == 0).withColumn("at", F.col("r.offset") + F.col("k") * F.col("length"))
    head = F.least("length", F.lit(window) - F.pmod("at", F.lit(window)))
    cuts = F.filter(
        F.array(
            F.struct(F.lit(0).cast("long").alias("skip"), head.alias("size")),
            F.struct(head.alias("skip"), (F.col("length") - head).alias("size")),
        ),
        lambda c: c["size"] > 0,
    )
    own = F.expr("substring(ids, cast(4 * cut.skip + 1 as int), cast(4 * cut.size as int))")
    rest = (
        line.withColumn("cut", F.explode(cuts))
        .withColumn("own", own)
        .withColumn("spot", F.col("at") + F.col("cut.skip"))
        .select(
            "doc_id",
            (F.col("start") + F.col("cut.skip")).alias("start"),
            F.col("cut.size").alias("length"),
            F.col("own").alias("ids"),
            F.crc32("own").alias("ids_crc32"),
            "doc_tokens",
            (F.col("r.sequence") + F.floor(F.col("spot") / window)).cast("long").alias("sequence_id"),
            F.pmod("spot", F.lit(window)).cast("long").alias("offset"),
        )
    )
    # A task numbers fewer than 2**33 windows.
    number = F.lit(planned) + F.shiftleft("part", 33) + F.col("place")
    full = pieces.filter("whole").select(
        *same, number.cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    return full.unionByName(windows).unionByName(rest)
