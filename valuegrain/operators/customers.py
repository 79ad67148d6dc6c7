"""Filters, ordering, pages, lookup and search over a scored customer table."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain.errors import CustomerNotFound
from valuegrain.operators.clean import present_gaps
from valuegrain.operators.order_stats import order_statistics
from valuegrain.schema import ID, MAX_PAGE_SIZE

#: Rows before a page that are sorted along with it; for more, the page's first key is searched.
SHALLOW_ROWS = 10_000


def value_column(df: DataFrame) -> str | None:
    return next((c for c in ("predicted_clv", "actual_clv") if c in df.columns), None)


def segment_column(df: DataFrame) -> str | None:
    return next((c for c in ("predicted_segment", "customer_segment") if c in df.columns), None)


def filter_customers(
    df: DataFrame,
    *,
    segment: str | None = None,
    source: str | None = None,
    min_value: float | None = None,
    max_value: float | None = None,
) -> DataFrame:
    """Predicted columns take precedence over labels; absent columns do not filter."""
    value, label = value_column(df), segment_column(df)
    if segment and label:
        df = df.where(F.col(label) == segment)
    if source and "acquisition_source" in df.columns:
        df = df.where(F.col("acquisition_source") == source)
    if value and min_value is not None:
        df = df.where(F.col(value) >= min_value)
    if value and max_value is not None:
        df = df.where(F.col(value) <= max_value)
    return df


def sort_customers(
    df: DataFrame, sort_by: str = "predicted_clv", descending: bool = True
) -> DataFrame:
    """Order by a column, missing values last; an unknown column leaves the order alone."""
    if sort_by not in df.columns:
        return df
    column = F.col(sort_by)
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return df.orderBy(order, F.col(ID))


class Page(NamedTuple):
    rows: DataFrame
    info: DataFrame


def page_bounds(page: int, page_size: int) -> tuple[int, int]:
    page = max(page, 1)
    page_size = min(max(page_size, 1), MAX_PAGE_SIZE)
    return page, page_size


def rows_from(df: DataFrame, sort_by: str, descending: bool, skipped: int) -> DataFrame:
    """The rows from a position of the sorted table on, unsorted.

    Finds the value at that position and, among its ties, the id, by exact order statistics,
    so no task holds the rows before it. Missing values come last; ids are unique.
    """
    column = F.col(sort_by)
    present, total = df.agg(F.count(column), F.count(F.lit(1))).first()
    if skipped >= total:
        return df.limit(0)

    def first_id(rows: DataFrame, rank: int, size: int):
        return F.lit(order_statistics(rows, {ID: [rank]}, {ID: size})[ID][rank][0])

    if skipped >= present:
        gaps = df.where(column.isNull())
        return gaps.where(F.col(ID) >= first_id(gaps, skipped - present, total - present))
    rank = present - 1 - skipped if descending else skipped
    value = F.lit(order_statistics(df, {sort_by: [rank]}, {sort_by: present})[sort_by][rank][0])
    ahead, behind = column < value, column > value
    if descending:
        ahead, behind = behind, ahead
    before, ties = df.agg(F.count_if(ahead), F.count_if(column == value)).first()
    own = df.where(column == value)
    start = first_id(own, skipped - before, ties)
    return df.where(behind | column.isNull() | ((column == value) & (F.col(ID) >= start)))


def customer_page(
    df: DataFrame,
    *,
    page: int = 1,
    page_size: int = 100,
    sort_by: str = "predicted_clv",
    descending: bool = True,
    shallow_rows: int = SHALLOW_ROWS,
    **filters,
) -> Page:
    """One page of the filtered customers, and a row with the total and position.

    A page of an unknown sort column is ordered by id so that it stays repeatable. Beyond
    ``shallow_rows`` the page starts from a searched key, so the sort holds one page only.
    """
    page, page_size = page_bounds(page, page_size)
    kept = filter_customers(df, **filters)
    sort_by = sort_by if sort_by in kept.columns else ID
    skipped = (page - 1) * page_size
    if skipped > shallow_rows:
        late = rows_from(kept, sort_by, descending, skipped)
        rows = sort_customers(late, sort_by, descending).limit(page_size)
    else:
        rows = sort_customers(kept, sort_by, descending).offset(skipped).limit(page_size)
    rows = present_gaps(rows)
    info = kept.agg(F.count(F.lit(1)).alias("total")).select(
        "total",
        F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
        (F.lit(skipped + page_size) < F.col("total")).alias("has_more"),
    )
    return Page(rows, info)


def find_customer(df: DataFrame, customer_id: str) -> DataFrame:
    """The row of one customer; the id filter reaches a stored table's scan."""
    found = df.where(F.col(ID) == customer_id)
    if found.select(ID).isEmpty():
        raise CustomerNotFound(customer_id)
    return present_gaps(found)


def search_customers(df: DataFrame, term: str, segment: str | None = None) -> DataFrame:
    """Customers whose id or source contains ``term``, whatever the case."""
    needle = F.lit(term.lower())
    hit = F.lower(ID).contains(needle) | F.lower("acquisition_source").contains(needle)
    return present_gaps(filter_customers(df, segment=segment).where(hit))


def top_customers(df: DataFrame, count: int = 5) -> DataFrame:
    """Highest values first; each task keeps only its own best ``count`` rows."""
    value = value_column(df)
    ordered = df.where(F.col(value).isNotNull()).orderBy(F.desc(value), F.col(ID))
    return present_gaps(ordered.limit(count))
