"""Z-scores, percentile ranks and outlier flags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from valuegrain.functions.bins import flag
from valuegrain.operators.profile import STATISTICAL_COLUMNS, Profile
from valuegrain.operators.ranks import average_percent_ranks, fitted_percent_rank

OUTLIER_DEVIATIONS = 3


def add_statistical(df: DataFrame, profile: Profile, *, exact_ranks: bool = True) -> DataFrame:
    """Add the family for every column that varies in the fitted population.

    ``exact_ranks`` ranks the rows of ``df`` among themselves and is meant for the
    fitted table; otherwise ranks come from the fitted edges.
    """
    varying = [
        c
        for c in STATISTICAL_COLUMNS
        if c in df.columns and (profile.deviations.get(c) or 0) > 0
    ]
    if not varying:
        return df
    outputs = {c: f"{c}_percentile" for c in varying}
    if exact_ranks:
        df = average_percent_ranks(df, outputs, sizes=profile.sizes, edges=profile.edges)
    else:
        for c, output in outputs.items():
            df = fitted_percent_rank(df, c, output, edges=profile.edges[c])
    scores = {
        f"{c}_zscore": (F.col(c) - F.lit(profile.means[c])) / F.lit(profile.deviations[c])
        for c in varying
    }
    flags = {
        f"{c}_is_outlier": flag(F.abs(F.col(f"{c}_zscore")) > OUTLIER_DEVIATIONS)
        for c in varying
    }
    total = sum((F.col(name) for name in flags), F.lit(0))
    return df.withColumns(scores).withColumns(flags).withColumn("outlier_score", total)
