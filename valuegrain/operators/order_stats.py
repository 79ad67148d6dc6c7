"""Exact order statistics of large tables in bounded memory.

``percentile`` keeps every distinct value in one task, which does not hold for
billions of distinct amounts. Here each wanted rank is bracketed with a bounded
sample, the rows below and inside the bracket are counted in one scan, and the
bracket shrinks until it is small enough to be gathered whole. Rows are never
shuffled, and ties are broken by the row id, so a value shared by a third of all
rows is bracketed like any other. The samples only decide how fast it converges;
the result is exact whatever they hold.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from valuegrain.schema import ID

SAMPLE_ROWS = 20_000
# Below this a bracket of eight standard deviations may fail to shrink.
MIN_SAMPLE_ROWS = 200
_ROW_ID, _DRAW = "row:id", "row:draw"
MAX_ROUNDS = 60

# Bits of a value that a pass of value_quantiles settles: sign and exponent first.
DIGIT_BITS = (12, 13, 13, 13, 13)
COUNTED = "place int, start binary, digit int, n long"
SETTLED = "place int, rank long, start binary, digit int, before long"

Key = tuple


@dataclass(frozen=True)
class _Range:
    """Keys from ``low`` (left out if ``open_low``) up to but not including ``high``.

    None leaves a side open. ``before`` and ``end`` are the exact row counts before
    the range and up to its end.
    """

    low: Key | None
    open_low: bool
    high: Key | None
    before: int
    end: int


@dataclass(frozen=True)
class _Bracket:
    """A guess within a known range that should hold the row of each rank."""

    column: str
    ranks: tuple[int, ...]
    known: _Range
    low: Key | None
    open_low: bool
    high: Key | None
    expected: float


@dataclass(frozen=True)
class _Seen:
    """What one scan found out about a bracket."""

    below: int
    inside: int
    at_low: int
    at_high: int
    drawn: int
    picks: dict[int, tuple[Key | None, Key | None]]
    whole: bool


def order_statistics(
    df: DataFrame,
    ranks: Mapping[str, Iterable[int]],
    sizes: Mapping[str, int],
    *,
    id_column: str = ID,
    sample_rows: int = SAMPLE_ROWS,
) -> dict[str, dict[int, Key]]:
    """``(value, id)`` at each zero-based rank of each column, nulls left out.

    ``sizes`` holds the non-null row count per column. Copies of a row share a key
    and simply fill neighbouring ranks.
    """
    sample_rows = max(sample_rows, MIN_SAMPLE_ROWS)
    found: dict[str, dict[int, Key]] = {c: {} for c in ranks}
    pending = []
    for column, wanted in ranks.items():
        size = sizes[column]
        inside = tuple(sorted({r for r in wanted if 0 <= r < size}))
        if inside:
            known = _Range(None, False, None, 0, size)
            pending.append(_Bracket(column, inside, known, None, False, None, size))
    row_id = F.coalesce(F.col(id_column).cast("string"), F.lit(""))
    keyed = df.select(*ranks, row_id.alias(_ROW_ID))

    for round_number in range(MAX_ROUNDS):
        if not pending:
            return found
        scan = _first_scan if round_number == 0 else _scan
        following: dict[_Bracket, None] = {}
        for bracket, seen in scan(keyed, pending, sample_rows, round_number):
            for rank in bracket.ranks:
                hit = _hit(bracket, seen, rank)
                if hit is not None:
                    found[bracket.column][rank] = hit
                else:
                    following[_narrow(bracket, seen, rank)] = None
        pending = list(following)
    raise RuntimeError(f"no convergence on {[b.column for b in pending]}")


def _hit(bracket: _Bracket, seen: _Seen, rank: int) -> Key | None:
    end = seen.below + seen.inside
    if end <= rank < end + seen.at_high:
        return bracket.high
    if seen.below <= rank < seen.below + seen.at_low:
        return bracket.low
    return seen.picks[rank][0] if seen.whole else None


def _narrow(bracket: _Bracket, seen: _Seen, rank: int) -> _Bracket:
    """Next bracket for a rank: the sampled part of this one, or the side it fell on."""
    known, end = bracket.known, seen.below + seen.inside
    if rank < seen.below:
        known = _Range(known.low, known.open_low, bracket.low, known.before, seen.below)
    elif rank >= end:
        known = _Range(bracket.high, True, known.high, end + seen.at_high, known.end)
    else:
        known = _Range(bracket.low, bracket.open_low, bracket.high, seen.below, end)
        low, high = seen.picks[rank]
        # The rank is not at the low end, so copies there need no further search.
        stays = low is None or low == bracket.low
        start, stop = _sample_span(rank - seen.below, seen.inside, seen.drawn)
        part = (stop - start) / seen.drawn if seen.drawn else 1.0
        return _Bracket(
            bracket.column,
            (rank,),
            known,
            bracket.low if stays else low,
            stays and bracket.low is not None,
            bracket.high if high is None else high,
            seen.inside * part,
        )
    rows = known.end - known.before
    return _Bracket(
        bracket.column, (rank,), known, known.low, known.open_low, known.high, rows
    )


def _sample_span(position: int, inside: int, drawn: int) -> tuple[float, float]:
    """Sample positions four standard deviations around a rank, cut to the sample."""
    share = position / inside
    spread = 4.0 * math.sqrt(max(drawn * share * (1 - share), 1.0)) + 2.0
    return max(drawn * share - spread, 0.0), min(drawn * share + spread, float(drawn))


def _before(column: str, key: Key, inclusive: bool = False) -> Column:
    value, row_id = F.lit(key[0]), F.lit(key[1])
    same = F.col(_ROW_ID) <= row_id if inclusive else F.col(_ROW_ID) < row_id
    return (F.col(column) < value) | ((F.col(column) == value) & same)


def _equals(column: str, key: Key) -> Column:
    return (F.col(column) == F.lit(key[0])) & (F.col(_ROW_ID) == F.lit(key[1]))


# Places of a key relative to a bracket.
OUTSIDE, BELOW, AT_LOW, INSIDE, AT_HIGH, ABOVE = range(6)


def _place(bracket: _Bracket) -> Column:
    """Where a row's key lies, worked out once per row before the aggregation."""
    c, known = bracket.column, bracket.known
    place = F.when(F.col(c).isNull(), OUTSIDE)
    if known.low is not None:
        place = place.when(_before(c, known.low, known.open_low), OUTSIDE)
    if known.high is not None:
        place = place.when(~_before(c, known.high), OUTSIDE)
    if bracket.low is not None:
        place = place.when(_before(c, bracket.low, bracket.open_low), BELOW)
        if not bracket.open_low:
            place = place.when(_equals(c, bracket.low), AT_LOW)
    if bracket.high is None:
        return place.otherwise(INSIDE)
    place = place.when(_before(c, bracket.high), INSIDE)
    return place.when(_equals(c, bracket.high), AT_HIGH).otherwise(ABOVE)


def _first_scan(keyed: DataFrame, brackets: list[_Bracket], sample_rows: int, seed: int):
    """Sample the whole table once for all columns; the counts are known already."""
    share = sample_rows / 2 / max(b.expected for b in brackets)
    whole = all(b.expected <= sample_rows for b in brackets)
    rows = keyed if whole else keyed.where(F.rand(seed) < share)
    gathered = rows.agg(*[_gather(b, i) for i, b in enumerate(brackets)])
    outputs = []
    for i, b in enumerate(brackets):
        below, inside = F.lit(0), F.lit(b.known.end)
        outputs += _pick_columns(b, i, whole, below, inside)
    row = gathered.select(*outputs).first()
    for i, b in enumerate(brackets):
        drawn, picks = _read_picks(row, b, i, whole)
        yield b, _Seen(0, b.known.end, 0, 0, drawn, picks, whole)


def _scan(keyed: DataFrame, brackets: list[_Bracket], sample_rows: int, seed: int):
    """One pass: exact counts and sampled cut keys of every bracket.

    Only single keys reach the driver; each sample is sorted and read where it was
    gathered. A bracket that should hold at most ``sample_rows`` rows is gathered
    whole, a larger one is sampled at random to half that number.
    """
    rows = keyed.withColumn(_DRAW, F.rand(seed)).withColumns(
        {f"place_{i}": _place(b) for i, b in enumerate(brackets)}
    )
    whole = [b.expected <= sample_rows for b in brackets]
    aggregates, outputs = [], []
    for i, b in enumerate(brackets):
        place = F.col(f"place_{i}")
        inside = (place == AT_LOW) | (place == INSIDE)
        taken = inside
        if not whole[i]:
            taken = inside & (F.col(_DRAW) < sample_rows / 2 / b.expected)
        aggregates += [
            (F.count_if(place == BELOW) + b.known.before).alias(f"below_{i}"),
            F.count_if(inside).alias(f"inside_{i}"),
            F.count_if(place == AT_LOW).alias(f"low_{i}"),
            F.count_if(place == AT_HIGH).alias(f"high_{i}"),
            _gather(b, i, taken),
        ]
        outputs += [F.col(f"{n}_{i}") for n in ("below", "inside", "low", "high")]
        outputs += _pick_columns(b, i, whole[i], F.col(f"below_{i}"), F.col(f"inside_{i}"))
    row = rows.agg(*aggregates).select(*outputs).first()
    for i, b in enumerate(brackets):
        counts = [row[f"{n}_{i}"] for n in ("below", "inside", "low", "high")]
        yield b, _Seen(*counts, *_read_picks(row, b, i, whole[i]), whole[i])


def _gather(bracket: _Bracket, i: int, taken: Column | None = None) -> Column:
    """The sorted keys of the taken rows."""
    value = F.col(bracket.column)
    key = F.struct(value.alias("value"), F.col(_ROW_ID).alias("id"))
    taken = value.isNotNull() if taken is None else taken
    return F.sort_array(F.collect_list(F.when(taken, key))).alias(f"keys_{i}")


def _pick_columns(b: _Bracket, i: int, whole: bool, below: Column, inside: Column):
    """The keys at or around each rank, by the rules of ``_sample_span``."""
    keys = F.col(f"keys_{i}")
    drawn = F.size(keys)
    columns = [drawn.alias(f"drawn_{i}")]
    for rank in b.ranks:
        place = F.lit(rank) - below
        wanted = [place]
        if not whole:
            part = F.try_divide(place.cast("double"), inside)
            part = F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))
            spread = 4.0 * F.sqrt(F.greatest(drawn * part * (1 - part), F.lit(1.0))) + 2.0
            wanted = [F.floor(drawn * part - spread), F.ceil(drawn * part + spread)]
        for side, position in enumerate(wanted):
            columns.append(_at(keys, position).alias(f"pick_{i}_{rank}_{side}"))
    return columns


def _read_picks(row: Row, b: _Bracket, i: int, whole: bool):
    sides = (0,) if whole else (0, 1)
    picks = {r: tuple(_key(row[f"pick_{i}_{r}_{s}"]) for s in sides) for r in b.ranks}
    if whole:
        picks = {r: (key[0], None) for r, key in picks.items()}
    return row[f"drawn_{i}"], picks


def _at(keys: Column, place: Column) -> Column:
    """Zero-based element, null outside the array."""
    place = place.cast("int")
    return F.when((place >= 0) & (place < F.size(keys)), F.get(keys, place))


def _key(row: Row | None) -> Key | None:
    return None if row is None else (row["value"], row["id"])


def quantile_ranks(share: float, size: int) -> tuple[int, int, float]:
    """Neighbouring ranks and the weight of the upper one for linear interpolation."""
    position = share * (size - 1)
    lower = math.floor(position)
    return lower, math.ceil(position), position - lower


def interpolate(keys: Mapping[int, Key], share: float, size: int) -> float | None:
    if size == 0:
        return None
    lower, upper, weight = quantile_ranks(share, size)
    low, high = float(keys[lower][0]), float(keys[upper][0])
    return low if low == high else low + (high - low) * weight


def quantiles(
    df: DataFrame,
    shares: Mapping[str, Iterable[float]],
    *,
    sizes: Mapping[str, int] | None = None,
    id_column: str = ID,
    sample_rows: int = SAMPLE_ROWS,
) -> dict[str, dict[float, float | None]]:
    """Exact linearly interpolated quantiles of several columns."""
    shares = {c: list(s) for c, s in shares.items()}
    if not shares:
        return {}
    if sizes is None:
        sizes = df.agg(*[F.count(c).alias(c) for c in shares]).first().asDict()
    ranks = {
        c: {r for s in wanted for r in quantile_ranks(s, sizes[c])[:2]}
        for c, wanted in shares.items()
        if sizes[c] > 0
    }
    keys = order_statistics(
        df, ranks, sizes, id_column=id_column, sample_rows=sample_rows
    )
    return {
        c: {s: interpolate(keys.get(c, {}), s, sizes[c]) for s in wanted}
        for c, wanted in shares.items()
    }


def value_quantiles(
    df: DataFrame, shares: Mapping[str, Iterable[float]], sizes: Mapping[str, int]
) -> dict[str, dict[float, float | None]]:
    """Exact linearly interpolated quantiles of many columns as doubles, in a fixed number of passes.

    Values become whole numbers of the same order, and the one at each rank is settled digit by
    digit: a pass counts the next digit of the values that begin with the digits settled so far.
    ``quantiles`` has several expressions for each rank in one plan, which a hundred columns make
    too large. A task returns at most one row for each beginning and digit, whatever the rows.
    """
    shares = {c: list(s) for c, s in shares.items()}
    names = [c for c in shares if sizes[c] > 0]
    values = df.select(*[F.col(c).cast("double").alias(c) for c in names])
    #: The beginning of the value at each (place of a column, rank), and the rows before the beginning.
    known = {
        (place, rank): (0, 0)
        for place, c in enumerate(names)
        for share in shares[c]
        for rank in quantile_ranks(share, sizes[c])[:2]
    }
    left = sum(DIGIT_BITS)
    for bits in DIGIT_BITS if known else ():
        left -= bits
        counted = values.mapInArrow(_digits(known, left, bits), COUNTED)
        summed = counted.groupBy("place", "start", "digit").agg(F.sum("n").alias("n"))
        settled = summed.groupBy("place").applyInArrow(_settled(known), SETTLED).collect()
        known = {
            (r["place"], r["rank"]): (int.from_bytes(r["start"]) << bits | r["digit"], r["before"]) for r in settled
        }
    found: dict[str, dict[int, Key]] = {c: {} for c in shares}
    for (place, rank), (number, _) in known.items():
        found[names[place]][rank] = (_value(number), None)
    return {c: {s: interpolate(found[c], s, sizes[c]) for s in wanted} for c, wanted in shares.items()}


def _numbers(values: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values; both zeros are one, NaN comes last."""
    plain = np.where(np.isnan(values), np.nan, values) + 0.0
    bits = np.ascontiguousarray(plain).view(np.uint64)
    top = np.uint64(1 << 63)
    return np.where(bits & top, ~bits, bits | top)


def _value(number: int) -> float:
    top = 1 << 63
    bits = number ^ top if number & top else number ^ (2**64 - 1)
    return float(np.array([bits], np.uint64).view(np.float64)[0])


def _digits(known: Mapping[tuple[int, int], tuple[int, int]], left: int, bits: int):
    """Count the digit above the lowest ``left`` bits of the values with a known beginning."""
    starts: dict[int, list[int]] = {}
    for place, start in sorted({(place, start) for (place, _), (start, _) in known.items()}):
        starts.setdefault(place, []).append(start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {place: np.zeros(len(s) << bits, np.int64) for place, s in starts.items()}
        for batch in batches:
            for place, of in starts.items():
                numbers = _numbers(batch.column(place).drop_null().to_numpy()) >> np.uint64(left)
                wanted = np.array(of, np.uint64)
                start = numbers >> np.uint64(bits)
                at = np.minimum(np.searchsorted(wanted, start), len(wanted) - 1)
                shown = wanted[at] == start
                digit = (numbers & np.uint64((1 << bits) - 1)).astype(np.int64)
                totals[place] += np.bincount((at[shown] << bits) + digit[shown], minlength=len(totals[place]))
        for place, counts in totals.items():
            used = np.flatnonzero(counts)
            columns = [
                pa.array(np.full(len(used), place, np.int32)),
                pa.array([starts[place][i].to_bytes(8) for i in (used >> bits).tolist()], pa.binary()),
                pa.array((used & ((1 << bits) - 1)).astype(np.int32)),
                pa.array(counts[used]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["place", "start", "digit", "n"])

    return run


def _settled(known: Mapping[tuple[int, int], tuple[int, int]]):
    """The next digit of the value at each rank of a column, and the rows before it."""

    def run(table: pa.Table) -> pa.Table:
        here = table.column("place")[0].as_py()
        table = table.sort_by([("start", "ascending"), ("digit", "ascending")])
        start, digit, n = (table.column(c).to_pylist() for c in ("start", "digit", "n"))
        rows = []
        for (place, rank), (beginning, before) in known.items():
            if place != here:
                continue
            for of, d, count in zip(start, digit, n):
                if int.from_bytes(of) != beginning:
                    continue
                if rank < before + count:
                    rows.append((place, rank, of, d, before))
                    break
                before += count
        kinds = (pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
        names = ("place", "rank", "start", "digit", "before")
        return pa.table({name: pa.array(c, k) for name, c, k in zip(names, zip(*rows), kinds)})

    return run
