"""Encoding and decoding with a public BPE vocabulary through a table of distinct words.

Texts are split into words where the vocabulary's own splitting has a boundary in any case, so a
text's ids are its words' ids in order. Each distinct word of the corpus is encoded once, by the
tokenizers library, and its ids are joined back by position. Decoding joins ids with the
vocabulary's pieces: that table is as large as the vocabulary's file, so every task holds it.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain.llm.slices import as_bytes, byte_slices, schema_of
from valuegrain.llm.tables import only
from valuegrain.llm.wordcodes import replaced

VOCABULARY = "word_bpe_49k.json"
#: Texts with this in them may hold special tokens.
SPECIAL = b"<|"
# ASCII letters and those of Latin-1 as UTF-8; a following character beyond ASCII may belong to them.
_LETTERS = rb"(?:[a-z]++|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])++(?![\x80-\xff])"
_SIGNS = rb"[^\s0-9a-z'\x80-\xff]++(?![\x80-\xff'])"
#: Words: letters, one digit, signs, an apostrophe with letters, or what lies up to a space or digit.
_WORD = re.compile(rb"[a-z]++(?![\x80-\xff])|" + _LETTERS + rb"|[0-9]|" + _SIGNS + rb"|'" + _LETTERS + rb"|[^\s0-9]+")


def split_words(text: bytes) -> list[bytes]:
    """The words of a text, A-Z lower-cased.

    The vocabulary's splitting always has a boundary at ASCII white space, which it drops, around
    a digit, after letters and after signs without an apostrophe. Where characters beyond ASCII
    or apostrophes are near, words are longer. Around a possible special token they reach from one
    white space to the next and keep their case.
    """
    if SPECIAL not in text:
        return _WORD.findall(text.lower())
    words = []
    for chunk in text.split():
        words += [chunk] if SPECIAL in chunk else _WORD.findall(chunk.lower())
    return words


def vocabulary_path(vocabulary: str) -> str:
    """The place of a public tokenizer's file; a path stays as it is."""
    if os.path.sep in vocabulary:
        return vocabulary
    import public_tokenizers

    return public_tokenizers.path(vocabulary)


@lru_cache(maxsize=2)
def _tokenizer(vocabulary: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary_path(vocabulary))


def encode_words(vocabulary: str, words: list[bytes]) -> list[bytes]:
    """The ids of each word as little-endian integers of the vocabulary's width."""
    tokenizer = _tokenizer(vocabulary)
    found = tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
    width = _width(vocabulary)
    return [np.array(e.ids, width).tobytes() for e in found]


@lru_cache(maxsize=2)
def _width(vocabulary: str) -> np.dtype:
    return np.dtype("<u2" if _tokenizer(vocabulary).get_vocab_size() <= 1 << 16 else "<u4")


def _full_width(vocabulary: str, ids: bytes) -> bytes:
    return np.frombuffer(ids, _width(vocabulary)).astype("<u4").tobytes()


@lru_cache(maxsize=2)
def pieces(vocabulary: str) -> dict[int, bytes]:
    """The piece of each id, the added tokens included."""
    with open(vocabulary_path(vocabulary), encoding="utf-8") as file:
        content = json.load(file)
    if content.get("decoder"):
        raise ValueError(f"{vocabulary}: pieces of a vocabulary with a decoder aren't its texts")
    found = {i: piece.encode() for piece, i in content["model"]["vocab"].items()}
    return found | {token["id"]: token["content"].encode() for token in content["added_tokens"]}


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id (of any type), n_tokens and ids (little-endian 32-bit integers) of every text.

    One row for each row of the input, repeated ones and null ids included. Null and empty texts,
    and those of white space alone, have no ids. Texts are encoded whole, whatever their length.
    Strings of special tokens in a text count as these tokens, as they do for the library. Other
    columns are left out; an empty table gives no rows.
    """
    rows = only(docs, "doc_id", "text").select(F.col("doc_id").alias("key"), F.col("text").alias("value"))
    look_up, finish = partial(encode_words, vocabulary), partial(_full_width, vocabulary)
    found = replaced(rows, split_words, look_up, finish)
    n_tokens = (F.octet_length("value") / 4).cast("long").alias("n_tokens")
    return found.select(F.col("key").alias("doc_id"), n_tokens, F.col("value").alias("ids"))


def decode(rows: DataFrame, keep: tuple[str, ...] = ("doc_id",), vocabulary: str = VOCABULARY) -> DataFrame:
    """The columns to keep, and text: the pieces of each row's ids with spaces between them.

    ``ids`` are little-endian 32-bit integers; null and empty ones give an empty text. Ids beyond
    the vocabulary are left out, as by the library. An empty table gives no rows.
    """
    found = only(rows, "ids", *keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pieces(vocabulary)
        for batch in byte_slices(batches, 0):
            texts = []
            for ids in as_bytes(batch.column(0)):
                known = map(table.get, np.frombuffer(ids, "<u4").tolist())
                texts.append(b" ".join(piece for piece in known if piece is not None))
            text = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], text], [*keep, "text"])

    return found.mapInArrow(run, schema_of(*[found.schema[name] for name in keep], more="text string"))
