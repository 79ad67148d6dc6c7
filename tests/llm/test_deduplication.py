import numpy as np
from pyspark.sql import functions as F

from tests.llm import plain
from valuegrain.llm import simhash, suffix_dedup
from valuegrain.llm.components import connected_components


def test_fingerprints_and_components_match_the_plain_version(spark, docs):
    got = simhash.near_duplicates(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    prints = {t: plain.fingerprint(t) for t in {r.text for r in rows}}
    want = [(r.doc_id, prints[r.text]) for r in rows]
    values = sorted({p for _, p in want})
    edges = [(a, b) for i, a in enumerate(values) for b in values[i:] if (a ^ b).bit_count() <= 3]
    label = plain.components(edges, values)
    least = {}
    for i, p in want:
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    want = sorted(((i, p, least.get(label[p])) for i, p in want), key=str)
    assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want


def test_near_duplicates_of_an_empty_table(no_docs):
    assert simhash.near_duplicates(no_docs).collect() == []


def test_one_document_of_each_component_stays(docs):
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    components = {r.component_id for r in simhash.near_duplicates(docs).collect()}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(components)


def test_pivots_lose_no_pair():
    values = np.random.default_rng(1).integers(0, 2**63, 1500, dtype=np.uint64)
    values[500:1000] = values[:500] ^ np.uint64(0b1010010)
    a, b = simhash.pivot_links(values, 3)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 3
    assert {tuple(sorted(p)) for p in zip(a, b)} == set(zip(*np.nonzero(np.triu(near, 1))))


def test_groups_above_a_chunk_keep_their_links(spark, monkeypatch, rng):
    monkeypatch.setattr(simhash, "CHUNK", 5)
    center = rng.getrandbits(62)
    values = {center ^ (1 << rng.randrange(62)) ^ (1 << rng.randrange(62)) for _ in range(40)} | {center}
    values |= {rng.getrandbits(62) for _ in range(40)}
    frame = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.fingerprint_edges(frame)).collect()}
    listed = sorted(values)
    edges = [(a, b) for i, a in enumerate(listed) for b in listed[i + 1 :] if (a ^ b).bit_count() <= 3]
    want = plain.components(edges, listed)
    assert {v: got.get(v, v) for v in values} == want


def test_components_of_a_long_chain(spark):
    chain = spark.range(300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.component for r in connected_components(chain).collect()} == {0}
    assert connected_components(chain.limit(0)).collect() == []


def _passages(spark, texts):
    frame = spark.createDataFrame([(i, t, "x") for i, t in texts.items()], "doc_id long, text string, run string")
    found = {i: [] for i in texts}
    for r in suffix_dedup.repeated_passages(frame).collect():
        found[r.doc_id].append((r.start, r.end))
        assert r.n_words == r.end - r.start and r.doc_id not in r.partners and r.partners
    return {i: sorted(s) for i, s in found.items()}


def test_repeated_passages_match_the_plain_version(spark, rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    shared, other, tail = text(55), text(120), text(30)
    texts = {i: text(rng.randrange(20, 200)) for i in range(30)}
    for i in range(0, 30, 3):
        at = rng.randrange(len(texts[i]))
        texts[i][at:at] = shared if i % 2 else other
    texts[40], texts[41] = text(20) + tail + text(9), text(20) + tail + text(9)
    texts[42] = texts[0][:49] + text(5)
    texts[43] = list(texts[1])
    texts = {i: " ".join(w) for i, w in texts.items()} | {50: None, 51: "", 52: "a " * 200, 53: "b " * 49}
    assert _passages(spark, texts) == plain.repeated(texts)


def test_passages_behind_nearer_neighbours_are_found(spark, rng, monkeypatch):
    """Shorter quotes from both sides lie between two documents in both sorted orders."""
    hidden = []
    whole = suffix_dedup._hidden_matches
    monkeypatch.setattr(suffix_dedup, "_hidden_matches", lambda *a: hidden.append(whole(*a)) or hidden[-1])
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    text = lambda n: [word() for _ in range(n)]
    texts = {}
    for _ in range(12):
        shared = text(50)
        for source in (text(40) + shared + text(40), text(40) + shared + text(40)):
            texts[len(texts)] = source
            for _ in range(12):
                size, at = rng.randrange(20, 50), rng.randrange(10, 75)
                texts[len(texts)] = text(25) + source[at : at + size] + text(25)
    texts = {i: " ".join(w) for i, w in texts.items()}
    want = plain.repeated(texts)
    assert _passages(spark, texts) == want and sum(map(len, want.values())) >= 24
    assert hidden[0].count()
    monkeypatch.setattr(suffix_dedup, "SENT_RUNS", 0)
    assert _passages(spark, texts) == want


def test_repeated_words_at_the_ends_of_a_passage(spark, rng):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = {}
    for k in range(20):
        middle, size = [word() for _ in range(rng.randrange(20, 45))], 50
        left = rng.randrange(0, size - len(middle) + 1)
        right = size - len(middle) - left
        for _ in range(2):
            a, b = rng.choice([0, 7, 60, 90]), rng.choice([0, 7, 60, 90])
            core = ["a"] * (left + a) + middle + ["a"] * (right + b)
            texts[len(texts)] = " ".join([word(), word(), *core, word(), word()])
    assert _passages(spark, texts) == plain.repeated(texts)


def test_repeated_passages_of_the_documents(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()
    texts = {r.doc_id: r.text for r in rows}
    assert _passages(spark, texts) == plain.repeated(texts)


def test_a_very_common_passage_and_an_empty_table(spark, rng):
    passage = " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(60))
    texts = {i: f"start{i} {passage} end{i} {i}" for i in range(300)}
    assert _passages(spark, texts) == {i: [(1, 61)] for i in texts}
    assert suffix_dedup.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def _classes(texts):
    """(doc, start) of each stretch with the least document of its class, by comparing all windows."""
    spans = [(i, a, b) for i, found in plain.repeated(texts).items() for a, b in found]
    held = [{tuple(texts[i].split()[k : k + 50]) for k in range(a, b - 49)} for i, a, b in spans]
    root = list(range(len(spans)))
    changed = True
    while changed:
        changed = False
        for x in range(len(spans)):
            for y in range(x):
                if root[x] != root[y] and held[x] & held[y]:
                    root = [min(root[x], root[y]) if r in (root[x], root[y]) else r for r in root]
                    changed = True
    members = lambda r: [spans[k][0] for k in range(len(spans)) if root[k] == r]
    return {(i, a): (min(members(r)), len(members(r))) for (i, a, b), r in zip(spans, root)}


def test_classes_join_pairs_of_one_passage(spark, rng):
    words = lambda n: [f"w{rng.randrange(1 << 40)}" for _ in range(n)]
    passage, texts = words(50), {}
    for pair in range(4):
        left, right = words(30), words(30)
        for k in (0, 1):
            texts[2 * pair + k] = " ".join([*words(40), *left, *passage, *right, *words(40)])
    for k in range(600):
        cut = rng.randrange(1, 50)
        texts[8 + k] = " ".join([*words(30), *(passage[cut:] if k % 2 else passage[:cut]), *words(30)])
    texts[1000] = texts[1001] = " ".join(words(60))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {(r.doc_id, r.start): (r.class_id, r.class_size) for r in suffix_dedup.repeated_passages(frame).collect()}
    assert found == {(i, 40): (0, 8) for i in range(8)} | {(1000, 0): (1000, 2), (1001, 0): (1000, 2)}


def test_windows_that_meet_are_linked_and_passed_on_once():
    keys = [np.array(k, np.uint64) for k in ([1, 2, 2], [2, 3], [3], [9])]
    out = suffix_dedup._linked_windows(keys, [np.full(len(k), n) for n, k in enumerate(keys)]).to_pylist()
    assert {r["window"]: r["node"] for r in out if r["window"] is not None} == {1: 0, 2: 0, 3: 1, 9: 3}
    assert {(r["node"], r["other"]) for r in out if r["window"] is None} == {(1, 0), (2, 1)}


def test_classes_match_the_plain_version(spark, rng):
    pool = [[f"p{k}x{rng.randrange(1 << 40)}" for _ in range(60 + 10 * k)] for k in range(6)]
    texts = {}
    for i in range(60):
        pieces = []
        for k in (rng.randrange(6), rng.randrange(6)):
            at = rng.randrange(15)
            pieces += [*(f"u{rng.randrange(1 << 40)}" for _ in range(rng.randrange(5, 40))), *pool[k][at : at + 55]]
        texts[i] = " ".join(pieces)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {(r.doc_id, r.start): (r.class_id, r.class_size) for r in suffix_dedup.repeated_passages(frame).collect()}
    assert found == _classes(texts)


def test_stored_pivot_tables_equal_the_distances(spark):
    values = np.random.default_rng(2).integers(-(2**63), 2**63, 300)
    frame = simhash.with_pivot_table(spark.createDataFrame([(int(v),) for v in values], "fp long"))
    rows = frame.toPandas()
    got = simhash.unpacked([rows[c].to_numpy() for c in simhash.TABLE])
    assert got.shape == (300, simhash.PIVOTS)
    assert (got == simhash.distances(rows["fp"].to_numpy().view(np.uint64))).all()


def test_links_depend_on_the_pivot_tables():
    """A pair goes without a look at its bits if its tables lie too far apart, in groups of any size."""
    values = np.array([5, 4, 5 + 2**40, 7], np.uint64)
    table = simhash.distances(values)
    assert len(simhash.pivot_links(values, 3, table=table)[0]) == 6
    assert list(simhash._pair_links(values, table, np.array([0, 2]), 3)) == [0, 2]
    table[1, 9] += 9
    assert len(simhash.pivot_links(values, 3, table=table)[0]) == 3
    assert list(simhash._pair_links(values, table, np.array([0, 2]), 3)) == [2]


def test_repeated_rows_of_one_component_leave_one(spark):
    rows = [(2, "a b c"), (2, "a b c"), (1, None), (3, " "), (None, "a b c"), (None, "x y z"), (None, "x y z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = simhash.drop_near_duplicates(docs).collect()
    assert sorted(kept, key=str) == sorted([rows[0], rows[2], rows[5]], key=str)
