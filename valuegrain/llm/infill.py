"""Fill-in-middle transformation with piece tables.

A document is never copied while it is rearranged. It is a list of descriptors (buffer, start,
length) over two immutable buffers, the text and the sentinels. Cutting splits descriptors, an
arrangement permutes the three parts and puts a sentinel before each, the inverse permutation
restores the order, and digests read the described bytes descriptor by descriptor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.llm.slices import as_bytes, byte_slices, schema_of
from valuegrain.llm.tables import only

TEXT, SENTINELS = 0, 1
SENTINEL_BYTES = b"<P><S><M>"
#: The sentinel of each part: prefix, middle, suffix.
PREFIX, MIDDLE, SUFFIX = range(3)
PLAIN = "plain"
#: In which order a form has the parts.
ARRANGEMENTS = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}
#: Of 100 documents so many are rearranged, and of 100 rearranged ones so many begin with the suffix.
REARRANGED, SUFFIX_FIRST = 90, 20


class Piece(NamedTuple):
    buffer: int
    start: int
    length: int


MARKS = {PREFIX: Piece(SENTINELS, 0, 3), SUFFIX: Piece(SENTINELS, 3, 3), MIDDLE: Piece(SENTINELS, 6, 3)}


def mark_bytes(part: int) -> bytes:
    mark = MARKS[part]
    return SENTINEL_BYTES[mark.start : mark.start + mark.length]


def cut(pieces: list[Piece], at: int) -> tuple[list[Piece], list[Piece]]:
    """The pieces before and after a byte of the text they describe; the one around it is split."""
    for i, piece in enumerate(pieces):
        if at < piece.length:
            head = [piece._replace(length=at)] if at else []
            tail = piece._replace(start=piece.start + at, length=piece.length - at)
            return pieces[:i] + head, [tail, *pieces[i + 1 :]]
        at -= piece.length
    return pieces, []


def arrange_parts(parts: list[list[Piece]], form: str) -> list[Piece]:
    """Prefix, middle and suffix in the order of a form, a sentinel before each."""
    return [piece for part in ARRANGEMENTS[form] for piece in (MARKS[part], *parts[part])]


def stream(pieces: list[Piece], text: bytes) -> Iterator[memoryview]:
    """The described bytes in order, without copying them."""
    buffers = (memoryview(text), memoryview(SENTINEL_BYTES))
    for buffer, start, length in pieces:
        yield buffers[buffer][start : start + length]


def digest(pieces: list[Piece], text: bytes) -> str:
    done = hashlib.sha256()
    for view in stream(pieces, text):
        done.update(view)
    return done.hexdigest()


def count_points(text: bytes) -> int:
    """Code points of a UTF-8 text."""
    if text.isascii():
        return len(text)
    return int(np.count_nonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80))


def byte_places(text: bytes, points: list[int]) -> list[int]:
    """At which byte each of the given code points begins; the end of the text counts as one."""
    if text.isascii():
        return points
    begins = np.flatnonzero(np.frombuffer(text, np.uint8) & 0xC0 != 0x80)
    return [int(begins[p]) if p < len(begins) else len(text) for p in points]


def restored_pieces(output: bytes, form: str) -> list[Piece]:
    """Descriptors over an output that give the text it was made from.

    No part holds a sentinel, and none begins inside one, so each sentinel is the first of its
    kind after the one before.
    """
    rest = [Piece(TEXT, 0, len(output))] if output else []
    if form == PLAIN:
        return rest
    parts, at, begun = {}, 0, None
    for part in ARRANGEMENTS[form]:
        found = output.index(mark_bytes(part), at)
        body, rest = cut(rest, found - at)
        if begun is not None:
            parts[begun] = body
        _, rest = cut(rest, len(mark_bytes(part)))
        at, begun = found + len(mark_bytes(part)), part
    parts[begun] = rest
    return [piece for part in (PREFIX, MIDDLE, SUFFIX) for piece in parts[part]]


def seed_hex(doc_id: Column, epoch: int = 1) -> Column:
    """The numbers that decide about a document, as hexadecimal text; a null id counts as empty."""
    return F.sha2(F.concat(F.lit(f"{epoch}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)


def _decide(text: bytes, seed: str, rearranged: int, suffix_first: int):
    """Form, number of code points, and the two places of the cuts."""
    n = count_points(text)
    h = [int(seed[i : i + 8], 16) for i in range(0, 32, 8)]
    marked = any(mark_bytes(part) in text for part in MARKS)
    if not n or marked or h[2] % 100 >= rearranged:
        return PLAIN, n, None
    cuts = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    return "spm" if h[3] % 100 < suffix_first else "psm", n, cuts


ARRANGED = [
    ("n", pa.int64(), "long"),
    ("form", pa.string(), "string"),
    ("prefix_chars", pa.int64(), "long"),
    ("middle_chars", pa.int64(), "long"),
    (
        "pieces",
        pa.list_(pa.struct([("buffer", pa.int32()), ("start", pa.int64()), ("length", pa.int64())])),
        "array<struct<buffer:int,start:long,length:long>>",
    ),
    ("output", pa.string(), "string"),
    ("output_sha256", pa.string(), "string"),
]


def arrange(
    docs: DataFrame, epoch: int = 1, rearranged: int = REARRANGED, suffix_first: int = SUFFIX_FIRST
) -> DataFrame:
    """Documents in fill-in-middle form.

    Columns: doc_id (of any type), n (code points), form (psm, spm or plain), prefix_chars,
    middle_chars (null if plain), pieces (the output's descriptors over the text's bytes, buffer
    0, and the sentinels', buffer 1), output, output_sha256. Cuts and form depend on the id and
    the epoch alone, so repeated rows come out alike. Null text counts as empty, a null id as an
    empty one; empty texts and texts with a sentinel stay plain. Texts of any length are cut
    whole. Other columns are left out, whatever their names; an empty table gives no rows.
    """
    rows = only(docs, "doc_id", "text").select("doc_id", "text", seed_hex(F.col("doc_id"), epoch).alias("seed"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 1):
            out: list[list] = [[] for _ in ARRANGED]
            for text, seed in zip(as_bytes(batch.column(1)), batch.column(2).to_pylist()):
                form, n, cuts = _decide(text, seed, rearranged, suffix_first)
                pieces = [Piece(TEXT, 0, len(text))] if text else []
                if cuts:
                    first, second = byte_places(text, cuts)
                    prefix, rest = cut(pieces, first)
                    middle, suffix = cut(rest, second - first)
                    pieces = arrange_parts([prefix, middle, suffix], form)
                sizes = (cuts[0], cuts[1] - cuts[0]) if cuts else (None, None)
                described = [p._asdict() for p in pieces]
                output = b"".join(stream(pieces, text))
                for column, value in zip(out, (n, form, *sizes, described, output, digest(pieces, text))):
                    column.append(value)
            arrays = [
                pa.array(values, pa.binary()).cast(kind) if name == "output" else pa.array(values, kind)
                for values, (name, kind, _) in zip(out, ARRANGED)
            ]
            names = ["doc_id", *[name for name, _, _ in ARRANGED]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names)

    schema = schema_of(docs.schema["doc_id"], more=", ".join(f"{name} {kind}" for name, _, kind in ARRANGED))
    return rows.mapInArrow(run, schema)


def restore(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The texts that outputs (columns output and form) were made from.

    Returns the columns to keep, restored and restored_sha256. A null output counts as an empty
    one and a null form as plain; an output without its form's sentinels is an error.
    """
    found = only(rows, "output", "form", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, 0):
            texts, digests = [], []
            for output, form in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                pieces = restored_pieces(output, form or PLAIN)
                texts.append(b"".join(stream(pieces, output)))
                digests.append(digest(pieces, output))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[2:], pa.array(texts, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                [*keep, "restored", "restored_sha256"],
            )

    kept = [found.schema[name] for name in keep]
    return found.mapInArrow(run, schema_of(*kept, more="restored string, restored_sha256 string"))
