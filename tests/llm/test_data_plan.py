import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from valuegrain.llm import mixing, packing, sharding, topk


def test_shards_fit_their_limit(spark, docs, no_docs):
    rows, directory = sharding.shard(docs, 20_000)
    got, shards = rows.collect(), {r.shard: r for r in directory.collect()}
    assert len(got) == docs.count()
    total = Counter()
    for r in got:
        total[r.shard] += r.size
    assert all(shards[s].bytes == n for s, n in total.items()) and set(shards) == set(total)
    assert all(r.bytes <= 20_000 or not r.fits for r in shards.values())
    # Only rows that can't be told apart, or a single large one, exceed the limit.
    assert all(r.depth == sharding.BITS for r in shards.values() if not r.fits)
    names = sorted(s[1:] for s in shards)
    assert not any(b.startswith(a) for a, b in zip(names, names[1:]))
    # A shard's parent exceeds the limit: nothing splits without need.
    for s in shards:
        if len(s) > 1:
            assert sum(n for other, n in total.items() if other[1:].startswith(s[1:-1])) > 20_000
    assert [f.collect() for f in sharding.shard(no_docs)] == [[], []]


def test_deep_buckets_split_in_later_passes(spark, docs, monkeypatch):
    monkeypatch.setattr(sharding, "STEP", 2)
    few = docs.dropDuplicates(["doc_id", "text"]).filter("length(text) < 3000")
    rows, directory = sharding.shard(few, 4_000)
    assert directory.filter("not fits").count() == 0 and rows.count() == few.count()
    assert directory.agg(F.max("depth")).first()[0] > 4


def _check_packing(rows, texts, window):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    codec = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append(r)
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
    for spans in sequences.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= window
    for doc_id, text in texts.items():
        own = sorted(pieces[doc_id], key=lambda r: r.start)
        ids = codec.encode(text or "", add_special_tokens=False).ids + [0]
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids
        assert {r.doc_tokens for r in own} == {len(ids)}
        assert [r.start for r in own] == np.cumsum([0] + [r.length for r in own])[:-1].tolist()
    assert len(sequences) == -(-sum(r.length for r in rows) // window)


@pytest.mark.parametrize("window", [64, 1024])
def test_packing_is_a_round_trip_without_waste(docs, window):
    some = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    texts = {r.doc_id: r.text for r in some.collect()}
    _check_packing(packing.pack(some, window).collect(), texts, window)


def test_packing_of_equal_lengths_and_none(spark, no_docs):
    same = spark.createDataFrame([(i, "one two three four five") for i in range(100)], "doc_id long, text string")
    _check_packing(packing.pack(same, 8).collect(), {i: "one two three four five" for i in range(100)}, 8)
    assert packing.pack(no_docs).collect() == []


@pytest.mark.parametrize(
    "text", ["a b", " a", "a  b", "a \nb", "a\n b", "x <|endoftext|> y", "I'll don't", "\u00a0 x\u2003 y", "a\x1c b", ""]
)
def test_pieces_encode_like_the_whole_text(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    codec = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.frombuffer(packing.encoder(packing.VOCABULARY).encode(text), "<u4").tolist()
    assert ids == codec.encode(text, add_special_tokens=False).ids


def test_fill_finds_the_least_slack():
    from itertools import combinations

    stock = {7: 2, 5: 3, 3: 1, 11: 1}
    items = [n for n, c in stock.items() for _ in range(c)]
    for capacity in range(30):
        best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) <= capacity)
        taken = packing.fill(stock, capacity)
        assert sum(n * c for n, c in taken.items()) == best and all(c <= stock[n] for n, c in taken.items())


def test_mix_meets_targets(docs, no_docs):
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    names = sorted((s for s in by if s is not None)) + [None]
    weights = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    size = {s: sum(r.size for r in by[s]) for s in names}
    capped, budget = set(), 1.5 * sum(size.values())
    while True:
        open_ = [s for s in names if s not in capped]
        left = budget - sum(2 * size[s] for s in capped)
        target = {s: left * weights[s] / sum(weights[o] for o in open_) for s in open_} | {s: 2 * size[s] for s in capped}
        over = {s for s in open_ if target[s] > 2 * size[s]}
        if not over:
            break
        capped |= over
    for s in names:
        assert {r.source_size for r in by[s]} == {size[s]}
        assert abs(by[s][0].target - target[s]) < 1e-6
        assert sum(r.taken for r in by[s]) == round(by[s][0].target)
    again = mixing.mix(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix(no_docs).collect() == []


def test_applied_mix_has_the_words_taken(docs):
    out = mixing.apply_mix(docs)
    assert out.columns == docs.columns
    words = lambda rows: Counter()
    got, want = Counter(), Counter()
    for r in out.collect():
        got[r.source] += len((r.text or "").split())
    for r in mixing.mix(docs).collect():
        want[r.source] += r.taken
    # split() also parts words at spaces the mix doesn't count.
    assert all(abs(got[s] - n) <= 20 for s, n in want.items())


def _plain_top(rows, every, k):
    ints = [(i, [int(np.floor(np.float64(1024) * x)) for x in v]) for i, v in rows]
    out = []
    for q in sorted({i for i, _ in ints if i % every == 0}):
        vector = min(v for i, v in ints if i == q)
        scores = sorted((-sum(a * b for a, b in zip(vector, v)), i) for i, v in ints if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def test_top_products_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 64)
    monkeypatch.setattr(topk, "QUERIES", 7)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) * rng.lognormal(sigma=1)).astype("f4").tolist()) for i in range(600)]
    rows += [(600 + i, list(rows[10][1])) for i in range(30)] + [rows[20], (700, [0.0] * 8), (701, [1.0, 2.0]), (710, [])]
    bad = [(720, None), (730, [float("nan")] + [0.0] * 7), (740, [float("inf")] * 8), (None, rows[0][1]), (750, [None] * 8)]
    frame = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + bad], "vec_id long, embedding array<float>, label int, norm double")
    got = [tuple(r) for r in topk.top_products(frame, 10, 5).orderBy("query_id", "rank").collect()]
    assert got == _plain_top(rows, 10, 5)


def test_top_products_of_few_rows(spark):
    frame = spark.createDataFrame([(0, [1.0]), (10, [-2.0])], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in topk.top_products(frame, 10).orderBy("query_id").collect()] == [
        (0, 1, 10, -2048 * 1024),
        (10, 1, 0, -2048 * 1024),
    ]
    assert topk.top_products(frame.limit(0), 10).collect() == []


def varied(n, seed):
    """Vectors whose lengths fall off steeply, their queries (ids divisible by ten) among them."""
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 8))
    return x / np.linalg.norm(x, axis=1)[:, None] * (40 / (1 + np.arange(n) % 997))[:, None]


def test_most_products_of_varied_lengths_are_skipped(spark, monkeypatch):
    monkeypatch.setattr(topk, "CHUNK", 64)
    monkeypatch.setattr(topk, "CHUNKS_PER_TASK", 2)
    monkeypatch.setattr(topk, "QUERIES", 50)
    x = varied(6000, 3)
    frame = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    met = []
    found = topk.met_groups
    monkeypatch.setattr(topk, "met_groups", lambda a, c: met.append((found(a, c).count(), a.count(), c.agg({"group": "max"}).first()[0] + 1)) or found(a, c))
    got = [tuple(r) for r in topk.top_products(frame, 10, 5).orderBy("query_id", "rank").collect()]
    v = np.floor(x * 1024).astype(np.int64)
    want = []
    for q in range(0, 6000, 10):
        scores = v @ v[q]
        best = sorted((i for i in range(6000) if i != q), key=lambda i: (-scores[i], i))[:5]
        want += [(q, r, i, int(scores[i])) for r, i in enumerate(best, 1)]
    assert got == want
    pairs, blocks, groups = met[0]
    assert groups > 40 and blocks >= 10 and pairs < 0.5 * blocks * groups


def test_chunks_skip_products_below_the_floors():
    x = np.floor(varied(2000, 4) * 1024).astype(np.int64)
    norms = np.linalg.norm(x.astype(float), axis=1)
    order = np.argsort(-norms)
    x, norms = x[order], norms[order]
    none = np.full(20, -np.inf)
    best = topk._Best(np.arange(20), x[:20], norms[:20], none, 5)
    for at in range(0, 2000, 100):
        best.add(np.arange(at, at + 100), x[at : at + 100], norms[at : at + 100], norms[at])
    assert best.verified < 0.3 * 20 * 2000
    top = np.sort(x[:20] @ x.T - np.where(np.eye(20, 2000) > 0, 1 << 40, 0), axis=1)[:, ::-1][:, :5]
    assert (best.scores == top).all()


def test_long_runs_are_packed_as_the_library_encodes_them(spark):
    n = 1_200_000
    runs = [" " * n, "\n" * n, "ab" * (n // 2), "some text" + " " * n + "end", "a b c\n" + "\n" * n + "x y", None]
    rows = packing.pack(spark.createDataFrame(list(enumerate(runs)), "doc_id long, text string")).collect()
    _check_packing(rows, dict(enumerate(runs)), packing.WINDOW)


def test_rows_with_null_ids_are_packed_each(spark):
    docs = spark.createDataFrame([(None, "one two")] * 3 + [(None, None)], "doc_id long, text string")
    rows = packing.pack(docs).collect()
    assert sorted(r.doc_tokens for r in rows) == [1, 3, 3, 3]


def test_rows_alike_but_for_other_columns_are_mixed_apart(spark):
    """Equal ids, sources and texts keep their own columns; joined keys that agree don't mix rows up."""
    schema = "doc_id string, source string, text string, note string, tags array<string>"
    alike = [("1", "s", "one two three", f"n{i}", ["t", None]) for i in range(6)]
    clash = [("a:b", "c", "x y", None, None), ("a", "b:c", "x y", None, None)]
    docs = spark.createDataFrame(alike + clash + [alike[0], (None, None, None, None, None)], schema)
    taken = {}
    for r in mixing.mix(docs, mixing._rest(docs)).collect():
        taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + r.taken
    got = mixing.apply_mix(docs.repartition(3)).collect()
    words = {}
    for r in got:
        words[r.doc_id, r.source] = words.get((r.doc_id, r.source), 0) + len(r.text.split())
    assert words == {k: n for k, n in taken.items() if n}
    whole = {r.note for r in got if r.doc_id == "1"}
    assert whole == {f"n{i}" for i in range(6)}
    assert {(r.doc_id, r.source) for r in got if r.note is None} == {("a:b", "c"), ("a", "b:c")}
    assert mixing.apply_mix(docs.limit(0)).collect() == []


def test_shards_that_split_match_their_sql(spark):
    """The SQL of the query with a limit at which the small table splits several times."""
    from check import compare, connect
    from tests.llm.conftest import SF
    from valuegrain.llm.oracles import ORACLES

    limit = 200_000
    rows, _ = sharding.shard(spark.read.parquet(f"{SF}/documents.parquet"), limit)
    assert rows.agg(F.min("depth")).first()[0] > 0 and rows.select("shard").distinct().count() > 3
    got = rows.withColumnRenamed("bytes", "shard_bytes").drop("n_rows").toPandas()
    sql = ORACLES["op1_extendible_shards"]
    assert "33554432" in sql
    assert compare(got, connect(SF).execute(sql.replace("33554432", str(limit))).df()) == "ok"
