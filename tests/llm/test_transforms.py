"""Fill-in-middle, encoding and lexical search against plain versions."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from valuegrain.llm import infill, lexical, word_bpe, wordcodes
from valuegrain.llm.queries import op11_infill, op12_word_bpe

SF = "/root/testdata/sf0.001"
MARKS = ["<|endoftext|>", "<P>", "<S>", "<M>"]
SIGNS = [*"aZséÉ漢“×=,\u0301 \n\t\x0b\x1c\x85\u00a0\u2003 'sµ<|>09.", *MARKS]
HARD = st.lists(st.sampled_from(SIGNS), max_size=40).map("".join)


def sha(text):
    return hashlib.sha256((text or "").encode()).hexdigest()


def infilled(doc_id, text):
    """Form, sizes and output by slicing."""
    text, seed = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(seed[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    a, b = sorted((h[0] % (len(text) + 1), h[1] % (len(text) + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < 20:
        return "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infill_equals_slicing_and_restores(docs, no_docs):
    arranged = infill.arrange(docs).cache()
    rows, texts = arranged.collect(), Counter((r.doc_id, r.text) for r in docs.collect())
    assert {r.form for r in rows} == {"psm", "spm", "plain"}
    plain = Counter()
    for (doc_id, text), times in texts.items():
        plain[doc_id, len(text or ""), *infilled(doc_id, text), sha(infilled(doc_id, text)[3])] += times
    assert plain == Counter(
        (r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.output_sha256) for r in rows
    )
    back = infill.restore(arranged).collect()
    assert Counter((r.doc_id, r.restored) for r in back) == Counter((i, t or "") for i, t in texts.elements())
    assert all(r.restored_sha256 == sha(r.restored) for r in back)
    assert not infill.arrange(no_docs).collect() and not infill.restore(arranged.limit(0)).collect()


def test_infill_takes_ids_of_other_types_and_long_texts(spark):
    long = "é<" * 1_500_000
    rows = infill.arrange(spark.createDataFrame([("a", long), ("b", long)], "doc_id string, text string"))
    got = {r.doc_id: r for r in rows.collect()}
    assert {i: (r.form, r.prefix_chars, r.middle_chars, r.output) for i, r in got.items()} == {
        i: infilled(i, long) for i in "ab"
    }
    assert infill.restore(rows).filter(f"restored_sha256 = '{sha(long)}'").count() == 2


@settings(max_examples=300, deadline=None)
@given(HARD, st.integers(0, 60), st.integers(0, 60), st.sampled_from(["psm", "spm"]))
def test_descriptors_restore_any_cut(text, a, b, form):
    text = text.replace("<P>", "").replace("<S>", "").replace("<M>", "")
    a, b = sorted((a % (len(text) + 1), b % (len(text) + 1)))
    data = text.encode()
    first, second = infill.byte_places(data, [a, b])
    prefix, rest = infill.cut([infill.Piece(0, 0, len(data))] if data else [], first)
    middle, suffix = infill.cut(rest, second - first)
    pieces = infill.arrange_parts([prefix, middle, suffix], form)
    output = b"".join(infill.stream(pieces, data))
    assert len(output) == len(data) + 9 and infill.digest(pieces, data) == hashlib.sha256(output).hexdigest()
    assert b"".join(infill.stream(infill.restored_pieces(output, form), output)) == data


def test_infill_query_has_the_agreed_columns(spark):
    rows = op11_infill(spark, SF)
    assert rows.columns == [
        "doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256",
    ]
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert Counter((r.doc_id, r.restored_sha256) for r in rows.collect()) == Counter((d.doc_id, sha(d.text)) for d in docs)


@pytest.fixture(scope="module")
def codec():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def encoded(codec, text):
    ids = codec.encode(text or "", add_special_tokens=False).ids
    return len(ids), np.array(ids, "<u4").tobytes(), codec.decode(ids, skip_special_tokens=False)


def test_words_encode_and_decode_as_the_library_does(spark, docs, no_docs, codec, monkeypatch):
    monkeypatch.setattr(wordcodes, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(wordcodes, "BUCKET_WORDS", 50)
    odd = ["<|endoftext|> a<|STARTOFTEXT|>b<|startoftext|>", "é ́x", "it's I'LL", " ", "a\x1cb \x85 c d", "ΑΣ Σ"]
    more = spark.createDataFrame([(20_000 + i, t) for i, t in enumerate(odd)], "doc_id long, text string")
    rows = docs.select("doc_id", "text").union(more).cache()
    want = Counter((r.doc_id, *encoded(codec, r.text)) for r in rows.collect())
    ids = word_bpe.encode(rows).cache()
    texts = word_bpe.decode(ids).collect()
    assert Counter((r.doc_id, r.n_tokens, bytes(r.ids)) for r in ids.collect()) == Counter(
        {k[:3]: 0 for k in want} | Counter(k[:3] for k in want.elements())
    )
    assert Counter((r.doc_id, r.text) for r in texts) == Counter((k[0], k[3]) for k in want.elements())
    assert not word_bpe.encode(no_docs).collect() and not word_bpe.decode(ids.limit(0)).collect()


def test_very_long_words_and_texts_encode(spark, codec):
    long = ["a" * 1_000_000, "word é" * 400_000, " " * 2_000_000, "\n" * 2_000_000, "no " + " " * 300_000 + "end"]
    rows = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, bytes(r.ids)) for r in word_bpe.encode(rows).collect()}
    assert got == {i: encoded(codec, t)[:2] for i, t in enumerate(long)}


@settings(max_examples=1500, deadline=None)
@given(HARD)
def test_words_are_encoded_independently(codec, text):
    found = [i for w in word_bpe.split_words(text.encode()) for i in codec.encode(w.decode(), add_special_tokens=False).ids]
    assert found == codec.encode(text, add_special_tokens=False).ids


def test_joining_blocks_does_not_move_them(spark, docs, capsys):
    word_bpe.encode(docs).explain()
    plan = capsys.readouterr().out
    assert plan.count("Bucketed: true") == 2 and plan.count("Exchange") == 2


def test_decoding_leaves_out_unknown_ids(spark, codec):
    ids = [[3306, 49407, 60_000, 12], [], None]
    data = [(str(i), None if x is None else bytearray(np.array(x, "<u4").tobytes())) for i, x in enumerate(ids)]
    got = {r.doc_id: r.text for r in word_bpe.decode(spark.createDataFrame(data, "doc_id string, ids binary")).collect()}
    assert got == {"0": codec.decode(ids[0], skip_special_tokens=False), "1": "", "2": ""}


def test_word_query_has_the_agreed_columns(spark, codec):
    rows = op12_word_bpe(spark, SF)
    assert rows.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = Counter()
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        n, ids, text = encoded(codec, d.text)
        want[d.doc_id, n, hashlib.sha256(ids).hexdigest(), sha(text)] += 1
    assert Counter(map(tuple, rows.collect())) == want


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def ranking(docs, items, k=10):
    """Every item against every document, one by one."""
    found = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    found = [(i, c, sum(c.values())) for i, c in found if c]
    total, everything = len(found), sum(n for _, _, n in found)
    held = Counter(t for _, c, _ in found for t in c)
    out = []
    for item_id, text in items:
        wanted = Counter(TERM.findall((text or "").translate(LOWER)))
        scores = []
        for doc_id, c, n in found:
            m = 25 + 75 * n * total // everything
            score = sum(
                repeats * math.floor(1000 * math.log((2 * total + 2) / (2 * held[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
                for t, repeats in wanted.items()
                if t in c
            )
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, r, s[3], -s[0]) for r, s in enumerate(sorted(scores, key=lambda s: s[:3])[:k], 1)]
    return Counter(out)


def test_search_equals_scoring_every_document(spark, docs, no_docs, monkeypatch):
    monkeypatch.setattr(lexical, "CHUNK_DOCS", 30)
    monkeypatch.setattr(lexical, "WAVE", 4)
    items = spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").limit(12)
    odd = [(100, None), (101, "... !"), (102, "word WORD x y z the The"), (None, "a b"), (100, "É é   漢字")]
    # More than 64 terms: masks of several words.
    odd.append((103, " ".join(f"{w}" for w in dict.fromkeys(docs.first().text.split()[:400]))))
    items = items.union(spark.createDataFrame(odd, "item_id long, text string")).cache()
    plain = [(r.doc_id, r.text) for r in docs.collect()]
    want = ranking(plain, [(r.item_id, r.text) for r in items.collect()])
    assert Counter(map(tuple, lexical.search(docs, items).collect())) == want
    assert Counter(map(tuple, lexical.search(docs, items, item_bytes=400).collect())) == want
    assert not lexical.search(no_docs, items).collect() and not lexical.search(docs, items.limit(0)).collect()


def test_ties_go_to_the_smaller_id_and_ids_may_be_text(spark):
    rows = [(f"d{i:02d}", "same words here") for i in range(30)] + [("other", "nothing alike")] * 40 + [(None, "same words here")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").repartition(5)
    items = spark.createDataFrame([("q", "words")], "item_id string, text string")
    got = lexical.search(docs, items).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [f"d{i:02d}" for i in range(10)] and len({r.score for r in got}) == 1


def test_most_masks_are_never_evaluated(spark):
    common = ["the", "of", "and"]
    rows = [(i, f"the of and filler{i} word{i % 50}") for i in range(4000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    words = [t.encode() for t in [*common, *(f"word{k}" for k in range(3))]]
    chunks = lexical.chunk_postings(docs, {w: i for i, w in enumerate(words)})
    weights = lexical.term_weights(chunks, len(words), 4000)
    found = lexical.search_chunks(chunks, {0: [(i, 1) for i in range(len(words))]}, weights, 4000, 20_000, 10)
    assert 0 < found.first().evaluated <= 4000 * 3 / 50 + lexical.WAVE


def test_blocks_of_items_are_bounded(spark):
    items = spark.createDataFrame([(i, f"word{i} " * 5 + f"other{i}") for i in range(300)], "item_id long, text string")
    found = lexical.item_terms(items)
    numbered, blocks = lexical.item_blocks(found, 500)
    assert blocks > 1 and numbered.count() == 300
    assert numbered.groupBy("block").sum("size").agg({"sum(size)": "max"}).first()[0] <= 1000
