"""Scores of a model against a reference."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridverify.functions.values import clean
from gridverify.schema import dimension_columns, dimension_list, require

# Score name -> aggregate of the error column.
SCORES = {
    "ME": lambda e: F.avg(e),
    "MAE": lambda e: F.avg(F.abs(e)),
    "RMSE": lambda e: F.sqrt(F.avg(e * e)),
}


def pair(
    model: DataFrame,
    reference: DataFrame,
    *,
    value: str = "value",
    reference_value: str = "value",
    carry: Sequence[str] = (),
) -> DataFrame:
    """Match both sides on the dimensions they share and add ``error``.

    A dimension only one side has (usually ``member``) is kept. Both sides
    carry one row per label once aggregated, so a label matches at most one
    reference row and the join does not multiply rows.

    ``carry`` names reference columns to keep, such as the band of the cell:
    the reference has a row per cell where the model has one per member, so
    whatever depends on the cell alone is looked up for the reference.
    """
    require(model, value)
    require(reference, reference_value)
    shared = [d for d in dimension_columns(model) if d in reference.columns]
    right = reference.select(
        *dimension_columns(reference), *carry, clean(reference_value).alias("_reference")
    )
    error = (clean(value) - F.col("_reference")).alias("error")
    kept = [c for c in model.columns if c != value]
    extra = [d for d in dimension_columns(reference) if d not in shared]
    return model.join(right, shared).select(*kept, *extra, *carry, error)


def _score_columns(metrics: Iterable[str]) -> list[Column]:
    unknown = [m for m in metrics if m not in SCORES]
    if unknown:
        raise ValueError(f"unknown metrics {unknown}; choose from {list(SCORES)}")
    return [SCORES[m](F.col("error")).alias(m) for m in metrics]


def kept_dimensions(df: DataFrame, collapse: str | Sequence[str] | None) -> list[str]:
    """Dimensions left after averaging over ``collapse``; None averages over all."""
    dims = dimension_columns(df)
    if collapse is None:
        return []
    names = dimension_list(collapse)
    unknown = [n for n in names if n not in dims]
    if unknown:
        hint = "; seasonal data have 'season' in place of 'time'" if "season" in dims else ""
        raise ValueError(f"cannot average over {unknown}: dimensions are {dims}{hint}")
    return [d for d in dims if d not in names]


def score(
    errors: DataFrame,
    collapse: str | Sequence[str] | None = None,
    *,
    metrics: Sequence[str] = tuple(SCORES),
    by: Sequence[str] = (),
) -> DataFrame:
    """All metrics in one aggregate, one row per kept dimension label and ``by`` value."""
    keys = [*kept_dimensions(errors, collapse), *by]
    return errors.groupBy(*keys).agg(*_score_columns(metrics))


def score_with_bands(
    errors: DataFrame,
    collapse: str | Sequence[str] | None = None,
    *,
    metrics: Sequence[str] = tuple(SCORES),
) -> DataFrame:
    """Scores of the whole domain and of every altitude band.

    Takes the output of ``mark_bands``. Both groupings come out of one pass;
    rows with NULL ``bin_min`` are the domain's.
    """
    require(errors, "bin_min", "bin_max")
    keys = [F.col(k) for k in kept_dimensions(errors, collapse)]
    band = [F.col("bin_min"), F.col("bin_max")]
    domain = F.grouping_id().alias("_domain")
    scored = errors.groupingSets([keys, [*keys, *band]], *keys, *band).agg(
        *_score_columns(metrics), domain
    )
    # A band row without edges stands for the cells outside every band.
    return scored.where((F.col("_domain") > 0) | F.col("bin_min").isNotNull()).drop("_domain")


def to_long(scores: DataFrame, metrics: Sequence[str] | None = None) -> DataFrame:
    """One row per metric: columns ``metric`` and ``score``."""
    names = [m for m in (metrics or SCORES) if m in scores.columns]
    keys = [c for c in scores.columns if c not in names]
    return scores.unpivot(keys, names, "metric", "score")


def mean_error(model: DataFrame, reference: DataFrame, dim=None, **columns) -> DataFrame:
    return score(pair(model, reference, **columns), dim, metrics=["ME"])


def mean_absolute_error(model: DataFrame, reference: DataFrame, dim=None, **columns) -> DataFrame:
    return score(pair(model, reference, **columns), dim, metrics=["MAE"])


def root_mean_squared_error(
    model: DataFrame, reference: DataFrame, dim=None, **columns
) -> DataFrame:
    return score(pair(model, reference, **columns), dim, metrics=["RMSE"])


def all_metrics(model: DataFrame, reference: DataFrame, dim=None, **columns) -> DataFrame:
    return score(pair(model, reference, **columns), dim)


__all__ = [
    "SCORES",
    "all_metrics",
    "kept_dimensions",
    "mean_absolute_error",
    "mean_error",
    "pair",
    "root_mean_squared_error",
    "score",
    "score_with_bands",
    "to_long",
]
