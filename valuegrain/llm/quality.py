"""Quality rules: base counts of each text and a hashed n-gram log-likelihood ratio.

Words and pairs of words are hashed into a fixed number of buckets. Their shares among trusted
documents (labelled good) and among all documents are two multinomials; a document's score is the
mean over its n-grams of the logarithm of trusted share over corpus share. Documents at or above
a threshold stay; equal texts always get equal verdicts. Everything is DataFrame expressions.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from valuegrain.llm.nativewords import SPACES, count_ascii, words
from valuegrain.llm.tables import fresh, let, only, stored

SYMBOLS = "#*$%&|<>"
WINDOW = 5
LEAST_WORDS = 10
MOST_REPEATED_PERCENT = 20
#: Buckets of the hashed n-grams: bounds the model, which travels with the plan.
BUCKETS = 1 << 16
#: Labelled documents are dealt into so many parts, each scored by the counts of the others for the threshold.
PARTS = 5
#: Labelled documents that were once drawn for the threshold. Now all are, and nothing reads this.
LABELLED = 20_000
#: Added to every bucket, as shares of the bucket's mean count.
SMOOTHING = 0.05
#: Log-ratios are stored as whole numbers of this fraction.
SCALE = 10_000
#: Scores are compared in steps of this size when the threshold is chosen.
STEP = 0.01
#: The threshold keeps this share of the good documents at least.
KEPT_SHARE = 0.999


def word_hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _runs(h: Column, length: int) -> Column:
    """Hashes of the runs of ``length`` consecutive words, from the words' hashes."""
    starts = F.slice(h, 1, F.greatest(F.size(h) - (length - 1), F.lit(0)))
    return F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, length)]))


def repeated_words(h: Column) -> Column:
    """How many words lie in windows of five words that occur twice or more in the text.

    Windows are compared by a 64-bit hash, made of the hashes of their words.
    """

    def covered(windows: Column) -> Column:
        ordered = F.sort_array(F.transform(windows, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, j: (F.get(s, j - 1)["h"] == e["h"]) | (F.get(s, j + 1)["h"] == e["h"])
            places = F.transform(s, lambda e, j: F.when(same(e, j), e["i"]))
            return F.sort_array(F.filter(places, lambda p: p.isNotNull()))

        def length(p: Column) -> Column:
            gaps = F.transform(p, lambda x, j: F.least(F.lit(WINDOW), F.coalesce(F.get(p, j + 1) - x, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

        return let(let(ordered, twice), length)

    distinct = lambda x: F.size(F.array_distinct(x)) == F.size(x)
    return let(_runs(h, WINDOW), lambda x: F.when(distinct(x), F.lit(0)).otherwise(covered(x))).cast("long")


def repeated_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def _bucket(h: Column) -> Column:
    return F.pmod(h, F.lit(BUCKETS)).cast("int")


@dataclass(frozen=True)
class QualityModel:
    """Log-ratios of the buckets, none if all are zero, and the least score that passes.

    The ratios are a scalar subquery on a stored table: tasks get its one value, and plans name it
    instead of spelling it out, so the driver holds no copy of the numbers for each plan it describes.
    """

    ratios: Column | None
    threshold: float


def _score(h: Column, ratios: Column) -> Column:
    """Mean log-ratio of the words of given hashes and of their pairs; zero without words.

    Ratios are whole numbers of 1/SCALE, so their sum doesn't depend on the order.
    """
    add = lambda total, x: total + F.get(ratios, _bucket(x))
    total = F.aggregate(_runs(h, 2), F.aggregate(h, F.lit(0).cast("long"), add), add)
    return F.when(F.size(h) > 0, total / (SCALE * (2 * F.size(h) - 1))).otherwise(F.lit(0.0))


def _hashed(text: Column, body) -> Column:
    """``body(hashes of the words)``, with the hashes found once."""
    return let(word_hashes(words(text)), body)


def choose_threshold(steps: list[tuple[int, int, int]]) -> float:
    """The least score that passes, from (step, good, bad) counts of labelled documents.

    Among the scores that keep KEPT_SHARE of the good documents, the one with the largest sum of
    good documents' share kept and bad documents' share rejected; the lower one of equals.
    """
    good, bad = sum(s[1] for s in steps), sum(s[2] for s in steps)
    if not good or not bad:
        return -math.inf
    best, threshold, lost, caught = 1.0, -math.inf, 0, 0
    for step, g, b in sorted(steps):
        gain = (good - lost) / good + caught / bad
        if lost <= (1 - KEPT_SHARE) * good and gain > best:
            best, threshold = gain, step * STEP
        lost, caught = lost + g, caught + b
    return threshold


def fit_quality(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """Count n-grams over all documents and over trusted ones, and choose the threshold.

    All documents labelled good make the trusted counts. The threshold comes from all labelled
    documents: they are dealt into PARTS by a hash of their id, and each is scored against the trusted
    counts of the other parts, so that no document is judged by its own words. Counts come back as one row
    for each of BUCKETS buckets, scores as one row for each step. Without good documents all
    ratios are zero, and without good or bad ones every document passes. Labels that clash count
    as bad; labels of null quality and of unknown documents don't count.
    """
    label = (
        labels.filter("quality is not null and doc_id is not null")
        .groupBy("doc_id")
        .agg((F.min("quality") > 0).alias("good"))
        .withColumn("part", F.pmod(F.xxhash64(F.col("doc_id") + 1), F.lit(PARTS)).cast("int"))
    )
    # Labels grow with the input, so texts meet them by id: only labelled texts are stored, for their counts and scores.
    texts = only(docs, "doc_id", "text").filter("doc_id is not null")
    known = stored(texts.join(label.hint("shuffle_hash"), "doc_id").select("good", "part", "text"), "labelled-texts")
    total = _bucket_counts(docs.select(F.col("text"), F.lit(0).alias("part")))
    counts = stored(
        total.select("b", F.lit(PARTS).alias("part"), "n").unionByName(
            _bucket_counts(known.filter("good").select("text", "part"))
        ),
        "bucket-counts",
    )
    sums = {r["part"]: r["n"] for r in counts.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    trusted = {part: sums.get(part, 0) for part in range(PARTS)}
    if not any(trusted.values()):
        return QualityModel(None, -math.inf)

    def share(n: Column, of: int) -> Column:
        return (n / of + SMOOTHING / BUCKETS) / (1 + SMOOTHING)

    wide = counts.groupBy("b").pivot("part", [*range(PARTS + 1)]).agg(F.sum("n")).na.fill(0)
    every = docs.sparkSession.range(BUCKETS).withColumnRenamed("id", "b").join(wide, "b", "left").na.fill(0)

    def ratios(parts: list[int]) -> Column:
        """An array of BUCKETS numbers, from the trusted counts of some parts; zeros if they have none."""
        of = sum(trusted[p] for p in parts)
        if not of:
            return F.array_repeat(F.lit(0), BUCKETS)
        found = sum((F.col(str(p)) for p in parts), F.lit(0))
        ratio = F.round(SCALE * F.log(share(found, of) / share(F.col(str(PARTS)), sums[PARTS]))).cast("int")
        pairs = F.sort_array(F.collect_list(F.struct(F.col("b"), ratio.alias("ratio"))))
        return F.transform(pairs, lambda p: p["ratio"])

    folds = [[p for p in range(PARTS) if p != k] for k in range(PARTS)]
    # One row, of the model's size.
    found = stored(every.agg(F.array(*[ratios(parts) for parts in [*folds, [*range(PARTS)]]]).alias("ratios")), "ratios")

    # The score by the counts that leave out the document's part.
    unseen = let(F.get("ratios", F.col("part")), lambda ratios: _hashed(F.col("text"), lambda h: _score(h, ratios)))
    scored = known.withColumn("ratios", found.scalar()).select("good", unseen.alias("score"))
    steps = scored.groupBy(F.floor(F.col("score") / STEP).alias("step")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad")
    )
    everywhere = found.select(F.get("ratios", F.lit(PARTS)).alias("ratios")).scalar()
    return QualityModel(everywhere, choose_threshold([(r["step"], r["good"], r["bad"]) for r in steps.collect()]))


def _bucket_counts(rows: DataFrame) -> DataFrame:
    """part, b, n: how often the words and pairs of words of each part's texts fall into a bucket."""
    w = rows.select("part", words(F.col("text")).alias("w"))
    both = F.arrays_zip(F.col("w").alias("a"), F.slice("w", 2, F.size("w")).alias("b"))
    grams = w.filter(F.size("w") > 0).select("part", F.explode(both).alias("g"))
    one, two = F.xxhash64("g.a"), F.xxhash64(F.xxhash64("g.a"), F.xxhash64("g.b"))
    each = grams.select("part", F.explode(F.array(_bucket(one), F.when(F.col("g.b").isNotNull(), _bucket(two)))).alias("b"))
    return each.filter("b is not null").groupBy("part", "b").agg(F.count("*").alias("n"))


def _judged(text: Column, ratios: Column | None) -> Column:
    """n_words, n_repeat_words and score of a text, with its words found once."""

    def judged(score) -> Column:
        return _hashed(
            text,
            lambda h: F.struct(
                F.size(h).cast("long").alias("n_words"),
                repeated_words(h).alias("n_repeat_words"),
                score(h).alias("score"),
            ),
        )

    if ratios is None:
        return judged(lambda h: F.lit(0.0))
    return let(ratios, lambda found: judged(lambda h: _score(h, found)))


def _with_ratios(docs: DataFrame, model: QualityModel) -> tuple[DataFrame, Column | None]:
    """The rows with the model's ratios as a column, as functions of arrays take no subqueries."""
    if model.ratios is None:
        return docs, None
    name = fresh(docs, "ratios")
    return docs.withColumn(name, model.ratios), F.col(name)


def _base_failed(judged: Column) -> Column:
    n, repeated = judged["n_words"], judged["n_repeat_words"]
    return (n < LEAST_WORDS) | (100 * repeated > MOST_REPEATED_PERCENT * n)


def judge(docs: DataFrame, model: QualityModel) -> DataFrame:
    """Counts and verdict of every row: doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, score.

    Null text has no words, so it fails the base rule. Repeated rows each give a row; an empty
    table gives none. Columns besides doc_id and text aren't looked at.
    """
    text = F.col("text")
    rows, ratios = _with_ratios(only(docs, "doc_id", "text"), model)
    rows = rows.select(
        "doc_id",
        _judged(text, ratios).alias("j"),
        (F.length(F.coalesce(text, F.lit(""))) - count_ascii(text, SPACES)).alias("word_chars"),
        count_ascii(text, SYMBOLS).alias("n_symbols"),
        repeated_lines(text).alias("n_dup_lines"),
    )
    j = F.col("j")
    return rows.select(
        "doc_id",
        "j.n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "j.n_repeat_words",
        _base_failed(j).alias("base_failed"),
        (~_base_failed(j) & (j["score"] >= model.threshold)).alias("kept"),
        "j.score",
    )


def keep_good(docs: DataFrame, model: QualityModel) -> DataFrame:
    """The rows whose verdict is to keep them, with all their columns."""
    rows, ratios = _with_ratios(docs, model)
    # One expression, as a filter on columns would work out the judgement again for each of them.
    good = let(_judged(F.col("text"), ratios), lambda j: ~_base_failed(j) & (j["score"] >= model.threshold))
    return rows.filter(good).select(*[F.col(f"`{c}`") for c in docs.columns])
