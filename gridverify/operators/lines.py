"""Line specifications: which rows feed which line of a figure."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridverify.functions.values import clean, in_half_open
from gridverify.operators.temporal import ensemble_mean
from gridverify.schema import CELL, dimension_list, present, require

# Default label templates, and the member shown for reference lines.
SERIES_LABEL = "{source}_{member}_{alt_min}-{alt_max}"
CYCLE_LABEL = "{source}-{member}_{alt_min}-{alt_max}"
NO_MEMBER = "na"


@dataclass(frozen=True)
class Line:
    """One line: a source, a choice of members, an altitude range, and what to average over."""

    label: str
    source: str = "ensemble"
    members: str | tuple[str, ...] | None = None
    altitude: tuple[float, float] | None = None
    reduce_dims: tuple[str, ...] = ()


def build_lines(config: Mapping, template: str = SERIES_LABEL) -> list[Line]:
    """Lines for every altitude range and member choice, then the reference's.

    ``config`` has ``alt_bin_ranges``, ``ensemble_members`` ("all", "mean", an
    id or a list of these), ``include_reference``, ``label_template`` and
    ``reduce_dims``.
    """
    ranges = [tuple(r) for r in config.get("alt_bin_ranges", [])]
    chosen = config.get("ensemble_members", "all")
    if not isinstance(chosen, (str, list)):
        raise ValueError(f"ensemble_members must be a text or a list, got {chosen!r}")
    choices = [chosen] if isinstance(chosen, str) else chosen
    template = config.get("label_template", template)
    dims = tuple(dimension_list(config.get("reduce_dims")))

    def label(source: str, member: str, span: tuple) -> str:
        return template.format(source=source, member=member, alt_min=span[0], alt_max=span[1])

    lines = [
        Line(label("ens", m, span), "ensemble", m, span, dims) for span in ranges for m in choices
    ]
    if config.get("include_reference", True):
        lines += [
            Line(label("ref", NO_MEMBER, span), "reference", None, span, dims) for span in ranges
        ]
    return lines


def build_cycle_lines(config: Mapping) -> list[Line]:
    return build_lines(config, CYCLE_LABEL)


def _member_choice(line: Line) -> list[str] | None:
    """Ids a line is limited to, None for no limit."""
    if line.members is None or line.members in ("all", "mean"):
        return None
    return [line.members] if isinstance(line.members, str) else list(line.members)


def _tag(df: DataFrame, lines: Sequence[Line]) -> DataFrame:
    """Add the label of every line a row feeds, once per line; drop rows feeding none."""
    with_altitude = "altitude" in df.columns
    if not with_altitude and any(line.altitude for line in lines):
        warnings.warn("no altitude column; altitude ranges of the lines are ignored")

    def feeds(line: Line) -> Column:
        tests = [F.lit(True)]
        if line.altitude and with_altitude:
            tests.append(in_half_open("altitude", *line.altitude))
        ids = _member_choice(line)
        if ids is not None:
            require(df, "member")
            tests.append(F.col("member").isin(ids))
        return reduce(Column.__and__, tests)

    labels = F.array(*[F.when(feeds(line), F.lit(line.label)) for line in lines])
    kept = present(df, ("time", "season", "member", *CELL))
    return df.select(F.explode(F.array_compact(labels)).alias("line"), *kept, "value")


def line_values(
    ensemble: DataFrame | None,
    reference: DataFrame | None,
    lines: Sequence[Line],
    *,
    ensemble_value: str = "value",
    reference_value: str = "value",
) -> DataFrame:
    """Rows of both datasets under the lines they feed.

    Columns ``line, source, time, member, iy, ix, value``. Each dataset is read
    once for all lines that take its members as they are, and once more if any
    line wants the mean over members.
    """
    for line in lines:
        if line.source not in ("ensemble", "reference"):
            raise ValueError(f"unknown data source {line.source!r}")

    parts = []

    def add(df: DataFrame | None, value: str, source: str, wanted: list[Line]) -> None:
        if not wanted:
            return
        if df is None or value not in df.columns:
            warnings.warn(f"{value} not found in {source} data; its lines are skipped")
            return
        tagged = _tag(df.withColumnRenamed(value, "value"), wanted)
        if "member" not in tagged.columns:
            tagged = tagged.withColumn("member", F.lit(None).cast("string"))
        parts.append(tagged.withColumn("source", F.lit(source)))

    of = lambda s, mean: [
        line for line in lines if line.source == s and (line.members == "mean") is mean
    ]
    add(ensemble, ensemble_value, "ensemble", of("ensemble", False))
    averaged = of("ensemble", True)
    if averaged and ensemble is not None and ensemble_value in ensemble.columns:
        add(_mean_over_members(ensemble, ensemble_value), ensemble_value, "ensemble", averaged)
    add(reference, reference_value, "reference", of("reference", False) + of("reference", True))
    if not parts:
        raise ValueError("no line has data")
    return reduce(DataFrame.unionByName, parts)


def _mean_over_members(df: DataFrame, value: str) -> DataFrame:
    if "altitude" not in df.columns:
        return ensemble_mean(df, value)
    # Altitude is a property of the cell: any of the rows averaged here has it.
    if "member" not in df.columns:
        return df
    keys = present(df, ("time", "season", *CELL))
    return df.groupBy(*keys).agg(F.avg(clean(value)).alias(value), F.first("altitude").alias("altitude"))
