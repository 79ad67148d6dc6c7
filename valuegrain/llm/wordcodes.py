"""Replacing every word of many texts through a table of distinct words.

Texts are gathered into blocks. A block lists its distinct words once, and each text becomes
places in that list. Only the lists meet the table of distinct words: they are dealt out by a hash
of the word, so all occurrences of a word meet in one bucket, where it is looked up once. The
values return to their block and are put in by place. A word so travels once for each block, not
for each occurrence, and the texts themselves don't travel at all: blocks are stored bucketed by
their number, which is what the values are joined on.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from valuegrain.llm.slices import as_bytes, byte_slices, schema_of
from valuegrain.session import shared_dir

#: Bytes of texts in a block, about; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20
#: Bytes of results handed on at once.
RESULT_BYTES = 4 << 20
#: Listed words that a bucket of the table meets, about, and how many buckets there are at most.
BUCKET_WORDS, BUCKETS = 50_000, 1 << 16


class _Places(dict):
    """A number for each new word, in order of appearance."""

    def __missing__(self, word):
        place = self[word] = len(self)
        return place


def _kind(distinct: int) -> np.dtype:
    return np.dtype("<u2" if distinct <= 1 << 16 else "<u4")


def bucketed(df: DataFrame, column: str, label: str) -> DataFrame:
    """A frame written to the shared folder in buckets of a column, so joins on it don't move it.

    The table is known to the catalogue while it is written and no longer.
    """
    spark = df.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    writer = df.write.format("parquet").option("compression", "zstd").option("path", shared_dir(spark, label))
    writer.bucketBy(buckets, column).saveAsTable(name)
    found = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return found


def coded_blocks(rows: DataFrame, split: Callable[[bytes], list[bytes]]) -> DataFrame:
    """Blocks of (key, value) rows: block, keys, codes (places as 16 or 32 bits), words, distinct.

    ``split`` makes a value's words, which hold no space; ``words`` are a block's words with a
    space between them. Keys are of any type and need not differ. A block's number is made of its
    task's and its place in it; the blocks are written out, so that number stays.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in byte_slices(batches, 1, BLOCK_BYTES):
            places = _Places()
            codes = []
            for value in as_bytes(batch.column(1)):
                words = split(value)
                codes.append(np.fromiter(map(places.__getitem__, words), np.uint32, len(words)))
            kind = _kind(len(places))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0)),
                    pa.array([[c.astype(kind).tobytes() for c in codes]], pa.list_(pa.binary())),
                    pa.array([b" ".join(places)], pa.binary()),
                    pa.array([len(places)], pa.int64()),
                ],
                ["block", "keys", "codes", "words", "distinct"],
            )
            block += 1

    keys = T.StructField("keys", T.ArrayType(rows.schema["key"].dataType))
    more = "codes array<binary>, words binary, distinct long"
    schema = schema_of(T.StructField("block", T.LongType()), keys, more=more)
    return bucketed(rows.select("key", "value").mapInArrow(run, schema), "block", "blocks")


def _by_bucket(words: list[bytes], buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words in the order of their buckets, the buckets that have any, and where each begins."""
    bucket = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    used, begins = np.unique(bucket[order], return_index=True)
    return order, used, begins


def _split_words(text: bytes) -> list[bytes]:
    return text.split(b" ") if text else []


def _dealt(buckets: int):
    """The words of a block by bucket: a row (bucket, block, words) for each that has any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1))):
                words = _split_words(text)
                order, used, begins = _by_bucket(words, buckets)
                parts = np.split(order, begins[1:]) if words else []
                packed = [b" ".join(map(words.__getitem__, part.tolist())) for part in parts]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(used.astype(np.int32)),
                        pa.array(np.full(len(used), block, np.int64)),
                        pa.array(packed, pa.binary()),
                    ],
                    ["bucket", "block", "words"],
                )

    return run


def _sizes(found: list[bytes]) -> bytes:
    """How long values are: a byte each, or four if one is longer."""
    sizes = np.fromiter(map(len, found), np.uint32, len(found))
    return sizes.astype("u1" if sizes.max(initial=0) < 256 else "<u4").tobytes()


def _looked_up(look_up: Callable[[list[bytes]], list[bytes]]):
    """The values of each row's words, end to end, with their sizes; each word of a bucket is looked up once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        at = None
        for batch in byte_slices(batches, 2, RESULT_BYTES):
            sizes, values = [], []
            for bucket, text in zip(batch.column(0).to_pylist(), as_bytes(batch.column(2))):
                if bucket != at:
                    known, at = {}, bucket
                words = _split_words(text)
                new = [word for word in words if word not in known]
                if new:
                    known.update(zip(new, look_up(new)))
                found = [known[word] for word in words]
                sizes.append(_sizes(found))
                values.append(b"".join(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(1), batch.column(0), *[pa.array(packed, pa.binary()) for packed in (sizes, values)]],
                ["block", "bucket", "sizes", "values"],
            )

    return run


VALUES = "bucket int, sizes binary, values binary"


def word_values(blocks: DataFrame, look_up: Callable[[list[bytes]], list[bytes]], buckets: int) -> DataFrame:
    """block, bucket, sizes, values: what ``look_up`` gives for the words of each block.

    All rows of a bucket lie in one task and come one after the other, so every distinct word of
    the corpus is looked up once.
    """
    dealt = blocks.select("block", "words").mapInArrow(_dealt(buckets), "bucket int, block long, words binary")
    sorted_by_bucket = dealt.repartition("bucket").sortWithinPartitions("bucket")
    return sorted_by_bucket.mapInArrow(_looked_up(look_up), f"block long, {VALUES}")


def _block_values(words: list[bytes], buckets: int, found: pa.Array) -> list[bytes]:
    """The value of each place of a block, from its rows of word_values."""
    rows = {row["bucket"].as_py(): row for row in found}
    values: list[bytes] = [b""] * len(words)
    order, used, begins = _by_bucket(words, buckets)
    for bucket, places in zip(used.tolist(), np.split(order, begins[1:]) if words else []):
        row = rows[bucket]
        sizes = row["sizes"].as_py()
        ends = np.cumsum(np.frombuffer(sizes, "u1" if len(sizes) == len(places) else "<u4"), dtype=np.int64)
        data, begin = row["values"].as_py(), 0
        for place, end in zip(places.tolist(), ends.tolist()):
            values[place] = data[begin:end]
            begin = end
    return values


def replaced(
    rows: DataFrame,
    split: Callable[[bytes], list[bytes]],
    look_up: Callable[[list[bytes]], list[bytes]],
    finish: Callable[[bytes], bytes] = bytes,
) -> DataFrame:
    """key and value (binary): the values of the words of each (key, value) row, end to end.

    ``split`` makes a value's words, ``look_up`` the values of distinct words, and ``finish`` a
    row's value from theirs. How many buckets words are dealt to follows from how many are
    listed, so a bucket's table stays small.
    """
    blocks = coded_blocks(rows, split)
    listed = blocks.agg(F.sum("distinct")).first()[0] or 0
    buckets = int(min(max(1, -(-listed // BUCKET_WORDS)), BUCKETS))
    found = F.collect_list(F.struct("bucket", "sizes", "values")).alias("found")
    back = word_values(blocks, look_up, buckets).groupBy("block").agg(found)
    # What functions return has no size that Spark could go by; merged, no side is held whole.
    whole = blocks.select("block", "keys", "codes", "words").join(back.hint("merge"), "block", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                keys, codes = (batch.column(i).slice(row, 1).flatten() for i in (0, 1))
                words = _split_words(batch.column(2)[row].as_py())
                values = _block_values(words, buckets, batch.column(3).slice(row, 1).flatten())
                kind, out, held, begun = _kind(len(words)), [], 0, 0
                for own in codes:
                    places = np.frombuffer(own.as_buffer(), kind).tolist()
                    out.append(finish(b"".join(map(values.__getitem__, places))))
                    held += len(out[-1])
                    if held > RESULT_BYTES:
                        yield _pairs(keys.slice(begun, len(out)), out)
                        begun, out, held = begun + len(out), [], 0
                if out:
                    yield _pairs(keys.slice(begun), out)

    schema = schema_of(T.StructField("key", blocks.schema["keys"].dataType.elementType), more="value binary")
    empty = F.array().cast(f"array<struct<{VALUES.replace(' ', ':').replace(',:', ',')}>>")
    return whole.select("keys", "codes", "words", F.coalesce("found", empty).alias("found")).mapInArrow(run, schema)


def _pairs(keys: pa.Array, values: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys, pa.array(values, pa.binary())], ["key", "value"])
