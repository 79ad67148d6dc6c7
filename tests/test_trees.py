"""Histogram trees against plain versions."""

import pickle

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from valuegrain.operators import trees
from valuegrain.operators.trees import TreeSettings, fit_trees, leaf_value, split_gains


def table(spark, rows=200, seed=4):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.integers(0, 12, rows), rng.normal(size=rows).round(1), rng.integers(0, 2, rows)]).astype(float)
    y = 50 + 9 * x[:, 0] + 20 * (x[:, 1] > 0.3) * x[:, 2] + rng.normal(size=rows).round(2)
    data = [(i, Vectors.dense(v), float(t), i % 5 == 0) for i, (v, t) in enumerate(zip(x, y))]
    return x, y, spark.createDataFrame(data, ["id", "features", "label", "held_out"])


def fit(df, settings, **options):
    return fit_trees(df, settings, name="out", label="label", held_out="held_out", key="id", **options)


def plain_best(x, g, settings):
    """Gain, feature, threshold of the best split of some rows; ties to the first."""
    score = lambda t, n: max(abs(t) - settings.l1, 0) ** 2 / (n + settings.l2)
    best = (1e-6, None, None)
    for f in range(x.shape[1]):
        for edge in sorted(set(x[:, f]))[:-1]:
            left = x[:, f] <= edge
            if min(left.sum(), (~left).sum()) < settings.child_rows:
                continue
            gain = score(g[left].sum(), left.sum()) + score(g[~left].sum(), (~left).sum()) - score(g.sum(), len(g))
            if gain > best[0] + 1e-4:
                best = (gain, f, edge)
    return best


def plain_leaves(x, g, settings):
    """Rows of the leaves of a tree that splits the leaf of the largest gain next, with the gains taken."""
    leaves, gains = [np.arange(len(g))], []
    while len(leaves) < settings.leaves:
        found = [plain_best(x[rows], g[rows], settings) for rows in leaves]
        at = max(range(len(leaves)), key=lambda i: found[i][0])
        gain, f, edge = found[at]
        if f is None:
            break
        rows = leaves.pop(at)
        leaves += [rows[x[rows, f] <= edge], rows[x[rows, f] > edge]]
        gains.append(gain)
    return leaves, gains


ONE = dict(rounds=1, rate=1.0, subsample=1.0, column_share=1.0, patience=None)


def test_the_leaf_of_the_largest_gain_splits_next(spark):
    x, y, df = table(spark)
    settings = TreeSettings(**ONE, leaves=9, child_rows=5)
    used = np.arange(200) % 5 != 0
    edges = [sorted(set(column))[:-1] for column in x[used].T]
    model = fit(df, settings, edges=edges)
    tree = model.boosted[0]
    base = y[used].mean()
    leaves, gains = plain_leaves(x[used], (base - y)[used], settings)
    assert tree.leaves == len(leaves) == 9
    inner = [i for i, f in enumerate(tree.features) if f >= 0]
    assert sorted(tree.gains[i] for i in inner) == pytest.approx(sorted(gains), rel=1e-6)
    # Children come after the split that made them, in the order of the splits.
    order = sorted(inner, key=lambda i: tree.left[i])
    assert [tree.gains[i] for i in order] == pytest.approx(gains, rel=1e-6)
    want = np.zeros(used.sum())
    for rows in leaves:
        want[rows] = base + leaf_value(float((base - y)[used][rows].sum()), len(rows), settings)
    got = {r["id"]: r["out"] for r in model.transform(df).select("id", "out").collect()}
    assert [got[i] for i in np.flatnonzero(used)] == pytest.approx(want.tolist(), rel=1e-6)


def test_leaf_values_and_gains_equal_the_closed_form(spark):
    rows = [(i, Vectors.dense([float(i)]), y, False) for i, y in enumerate([1.0, 2.0, 3.0, 10.0, 11.0, 12.0])]
    df = spark.createDataFrame(rows, ["id", "features", "label", "held_out"])
    settings = TreeSettings(**ONE, depth=1, child_rows=3, l1=0.5, l2=2.0)
    tree = fit(df, settings, edges=[[0.0, 1.0, 2.0, 3.0, 4.0]], base=6.0).boosted[0]
    # Gradients 5, 4, 3, -4, -5, -6; child weight 3 leaves one split.
    assert (tree.features, tree.bins[0], tree.rows[1:]) == ([0, -1, -1], 2, [3, 3])
    assert tree.values[1:] == pytest.approx([-(12 - 0.5) / 5, (15 - 0.5) / 5])
    assert tree.gains[0] == pytest.approx(11.5**2 / 5 + 14.5**2 / 5 - 2.5**2 / 8)
    gains = split_gains(df, ["a"], [[0.0, 1.0, 2.0, 3.0, 4.0]], settings, label="label", key="id").collect()
    assert [(r.threshold, r.left_rows, r.right_rows) for r in gains] == [(2.0, 3, 3)]
    assert gains[0].left_value == pytest.approx((6 - 0.5) / 5) and gains[0].right_value == pytest.approx((33 - 0.5) / 5)


@pytest.mark.parametrize("growth", [dict(depth=3), dict(leaves=6, depth=None)])
def test_trees_do_not_depend_on_partitions_or_chunks(spark, monkeypatch, growth):
    _, _, df = table(spark)
    settings = TreeSettings(rounds=5, rate=0.3, **growth, patience=None)
    edges = [[float(k) for k in range(11)], [k / 4 for k in range(-8, 9)], [0.0]]
    once = fit(df.coalesce(1), settings, edges=edges)
    monkeypatch.setattr(trees, "CHUNK_ROWS", 16)
    monkeypatch.setattr(trees, "TASK_ROWS", 0)
    monkeypatch.setattr(trees, "ROUNDS_KEPT", 2)
    again = fit(df.repartition(5), settings, edges=edges)
    assert once.boosted == again.boosted and len(once.boosted) == 5


def test_boosting_stops_at_the_lowest_held_out_error_and_survives_storage(spark, tmp_path):
    x, y, df = table(spark, 600)
    model = fit(df, TreeSettings(rounds=40, rate=0.3, depth=3, patience=6))
    assert 3 < model.trees <= 40 and len(model.errors) == model.trees + 1
    assert min(model.errors) == model.errors[-1] < model.errors[0] / 4
    held = model.transform(df).where("held_out").selectExpr("avg(pow(label - out, 2)) as e").first()["e"]
    assert held == pytest.approx(model.errors[-1])
    assert sum(model.importances) == pytest.approx(1.0)
    model.save(spark, str(tmp_path))
    loaded = trees.TreeModel.load(spark, str(tmp_path))
    assert np.array_equal(loaded.values(x), model.values(x)) and loaded.errors == model.errors


def test_without_rows_or_gains_the_base_is_left(spark):
    _, _, df = table(spark)
    flat = df.selectExpr("id", "features", "7D as label", "held_out")
    assert fit(flat, TreeSettings(rounds=3)).values(np.zeros((2, 3))).tolist() == [7.0, 7.0]
    assert fit(df.limit(0), TreeSettings(rounds=3)).trees == 0


def test_a_task_adds_up_a_part_of_the_rows_of_each_level(spark):
    x, y, _ = table(spark, 512)
    settings = TreeSettings(**ONE, depth=5, child_rows=5)
    batch = chunk_of(x, y)
    held = trees._Held(settings, 1e6, [trees._Chunk(batch, 0, 1.0, [])])
    read, histogram = [], held.histogram
    held.histogram = lambda rows: read.append(len(rows)) or histogram(rows)
    held.begin(0, [0, 1, 2])
    tree = trees.grow_levels(held.look(trees.Tree(), [0])[0], held.look, settings, 1e6)
    assert tree.leaves > 8 and sum(read) <= 512 + 4 * 256
    held.known.clear()
    for path in [p for p in held.paths(tree) if len(p) == 3]:
        rows = held.at(path)
        assert held.histogram(rows)[1].sum(axis=1).tolist() == [len(rows)] * 3


def flags(rows=400, width=30):
    """Rare flags beside a number; one of them is nearly always set, one always."""
    rng = np.random.default_rng(9)
    x = (rng.random((rows, width)) < 0.04).astype(float)
    x[:, 1], x[:, 2], x[:, 3] = 1 - x[:, 1], 1.0, rng.integers(0, 40, rows)
    weights = np.where(np.arange(width) == 3, 0.3, 20 * rng.normal(size=width))
    return x, (x @ weights + rng.normal(size=rows)).round(2)


def test_rare_flags_are_counted_by_the_rows_that_have_them():
    x, y = flags()
    held = trees._Held(TreeSettings(subsample=1.0), 1e6, [trees._Chunk(chunk_of(x, y), 0, 1.0, [])])
    held.begin(0, [0, 1, 2, 3, 7, 29])
    for rows in (np.arange(400), np.arange(5, 390, 7), np.array([3]), np.arange(0)):
        sums, counts = held.histogram(rows)
        for i, column in enumerate(held.columns):
            code = held.bins[column, rows].astype(int)
            assert counts[i].tolist() == np.bincount(code, minlength=64).tolist()
            assert sums[i].tolist() == np.bincount(code, held.parts[rows], 64).astype(int).tolist()
    assert held.many.sum() < 400 * 30 * 0.06 and 3 not in held.rare


@pytest.mark.parametrize("growth", [dict(depth=4), dict(leaves=9, depth=None)])
def test_rare_flags_split_alike_in_a_task_and_in_passes(spark, monkeypatch, growth):
    x, y = flags()
    data = [(i, Vectors.dense(v), float(t), i % 5 == 0) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, ["id", "features", "label", "held_out"])
    settings = TreeSettings(rounds=4, rate=0.3, **growth, patience=None)
    edges = [[float(k) for k in range(39)] if i == 3 else [0.0] for i in range(30)]
    once = fit(df, settings, edges=edges)
    monkeypatch.setattr(trees, "TASK_ROWS", 0)
    assert fit(df.repartition(3), settings, edges=edges).boosted == once.boosted
    assert len({f for t in once.boosted for f in t.features}) > 5


def chunk_of(x, y):
    import pyarrow as pa

    n = len(y)
    bins = np.stack([np.searchsorted(np.unique(c)[:-1][:63], c) for c in x.T]).astype("u1")
    arrays = (np.arange(n), y, np.zeros(n, "u1"), np.full(n, y.mean()), bins)
    columns = [pa.array([n]), *[pa.array([a.tobytes()], pa.binary()) for a in arrays]]
    return pa.RecordBatch.from_arrays(columns, ["n", "key", "label", "held", "guess", "bins"])


def part_of(x, y, settings, pieces=1):
    """A part of a table, of chunks of its rows."""
    bounds = np.linspace(0, len(y), pieces + 1).astype(int)
    whole = trees._Chunk(chunk_of(x, y), 0, settings.rate, [])
    found = []
    for low, high in zip(bounds, bounds[1:]):
        chunk = trees._Chunk(chunk_of(x, y), 0, settings.rate, [])
        for name in ("keys", "labels", "held", "guess"):
            setattr(chunk, name, getattr(whole, name)[low:high])
        chunk.bins = whole.bins[:, low:high]
        found.append(chunk)
    return trees._Part(settings, 1e6, found)


def test_a_part_holds_rare_flags_by_their_rows_and_counts_nodes_together():
    x, y = flags()
    settings = TreeSettings(subsample=1.0)
    held = trees._Held(settings, 1e6, [trees._Chunk(chunk_of(x, y), 0, 1.0, [])])
    part = pickle.loads(pickle.dumps(part_of(x, y, settings, 3)))
    assert len(part.bins) == 1 and len(held.bins) == 30
    for feature in range(30):
        assert part.column(feature).tolist() == held.bins[feature].tolist()
    columns, ends = [0, 1, 2, 3, 29], held.last + 1
    held.begin(0, columns), part.begin(0, columns)
    groups = [np.arange(0, 400, 3), np.arange(0), np.arange(1, 400, 3)]
    sums = part.histograms(groups, ends)
    for i, rows in enumerate(groups):
        want = [held.histogram(rows)[:, c, : ends[f]] for c, f in enumerate(columns)]
        assert sums[:, i].tolist() == np.concatenate(want, axis=1).tolist()


def test_predictions_of_a_part_are_the_same_with_and_without_what_a_worker_remembers(spark):
    x, y, df = table(spark, 300)
    settings = TreeSettings(rounds=4, rate=0.3, depth=3, patience=None)
    grown = fit(df, settings, edges=[sorted(set(c))[:-1] for c in x.T]).boosted

    def caught_up(fit, first, pending):
        return trees._Round(fit, first, pending, 0, [], np.zeros(3, int)).caught_up(0, part_of(x, y, settings)).guess

    want = caught_up("whole", 0, grown).tolist()
    assert len(set(want)) > 8 and trees._GUESSES["whole", 0][0] == 4
    assert caught_up("whole", 0, grown).tolist() == want
    # A worker that has seen half of the trees, and one that remembers what is older than the part.
    caught_up("half", 0, grown[:2])
    assert caught_up("half", 0, grown).tolist() == want
    trees._GUESSES["older", 0] = 2, np.full(300, 1e9)
    assert caught_up("older", 3, grown[3:]).max() < 1e8


@pytest.mark.parametrize("growth", [dict(depth=4), dict(leaves=9, depth=None)])
def test_a_round_takes_one_job_for_each_level_and_counts_the_smaller_children(spark, monkeypatch, growth):
    x, y = flags()
    data = [(i, Vectors.dense(v), float(t), i % 5 == 0) for i, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, ["id", "features", "label", "held_out"])
    settings = TreeSettings(rounds=3, rate=0.3, **growth, patience=None)
    edges = [[float(k) for k in range(39)] if i == 3 else [0.0] for i in range(30)]
    asked, sums = [], trees._Round.sums
    monkeypatch.setattr(trees._Round, "sums", lambda self, parts, counted, judged: asked.append(counted) or sums(self, parts, counted, judged))
    monkeypatch.setattr(trees, "CHUNK_ROWS", 16)
    monkeypatch.setattr(trees, "TASK_ROWS", 100)
    monkeypatch.setattr(trees, "PARTS_AT_ONCE", 3)
    model = fit(df, settings, edges=edges)
    assert model.trees == 3 and len(asked) <= 3 * 9 + 1
    for counted in asked:
        assert len({trees.sibling(p) for p in counted} & set(counted)) == 0
    monkeypatch.setattr(trees, "TASK_ROWS", 1000)
    assert fit(df, settings, edges=edges).boosted == model.boosted
