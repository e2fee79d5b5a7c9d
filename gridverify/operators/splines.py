"""Spline interpolation between grids: cubic with not-a-knot ends, and local monotone cubic.

Both work on one axis after the other, longitude first. A cubic spline is linear in
the data, so its tridiagonal system is solved once per axis, for weights: of each target
coordinate, a weight for every source coordinate around it. Weights fall by a factor of
at least two per coordinate (3.7 on even grids), so KNOTS on either side are all that
matters. The monotone cubic (Fritsch and Carlson; harmonic means of slopes) needs
the values of two coordinates on either side.

Long axes are cut into blocks with KNOTS coordinates of the neighbouring blocks around them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gridverify.operators.grid import RANGE_ROWS, GridSize, _coordinates, _in_range, axis_neighbours, hinted, measure
from gridverify.schema import CELL, dimension_columns

# Source coordinates on either side of a target that have weights; smaller weights are 0.
KNOTS = 40
LEAST_WEIGHT = 1e-18


def _placed(source: DataFrame, bounds: Sequence[float] | None) -> DataFrame:
    """Source coordinates ``i, c`` with ``pos``, their place from 0, and ``n``, their number."""
    source = source.where("c IS NOT NULL")
    inner = list(bounds or [])[1:-1]
    if not inner:
        every = W.partitionBy(F.lit(0))
        return source.select(
            "i", "c", (F.row_number().over(every.orderBy("c")) - 1).alias("pos"), F.count(F.lit(1)).over(every).alias("n")
        )
    cuts = F.expr("array(" + ", ".join(f"{b!r}D" for b in inner) + ")")
    ranged = source.withColumn("range", F.size(F.filter(cuts, lambda b: b < F.col("c"))))
    # One row per range, so at most one more than there are bounds.
    sizes = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("size"))
    along = W.partitionBy(F.lit(0)).orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select(
        "range", F.coalesce(F.sum("size").over(along), F.lit(0)).alias("start"), F.sum("size").over(W.partitionBy(F.lit(0))).alias("n")
    )
    inside = F.row_number().over(W.partitionBy("range").orderBy("c")) - 1
    placed = ranged.withColumn("inside", inside).join(F.broadcast(starts), "range")
    return placed.select("i", "c", (F.col("start") + F.col("inside")).alias("pos"), "n")


def _blocks(placed: DataFrame, rows: int | None = None) -> tuple[DataFrame, W]:
    """The coordinates in each block that needs them, with ``own`` where they are its own, and the order in a block."""
    size = F.lit(rows or RANGE_ROWS)
    block = lambda shift: F.floor((F.col("pos") + shift) / size)
    wide = 2 * KNOTS + 4
    dealt = placed.withColumn("block", F.explode(F.sequence(block(-wide), block(wide))))
    return dealt.withColumn("own", F.col("block") == block(0)), W.partitionBy("block").orderBy("pos")


def _knots(source: DataFrame, bounds: Sequence[float] | None) -> DataFrame:
    """Per source coordinate, the solved system's part around it.

    Row j of the system has the diagonal d, u above and l below it; the first and the last
    row are those of the not-a-knot ends. ``left`` and ``right`` are the factors by which
    the solution for one coordinate shrinks from knot to knot on either side.
    """
    dealt, order = _blocks(_placed(source, bounds))
    near = lambda name, k: F.lead(name, k).over(order) if k >= 0 else F.lag(name, -k).over(order)
    steps = dealt.select(
        "*", near("i", -1).alias("i_before"), near("i", 1).alias("i_after"),
        (F.col("c") - near("c", -1)).alias("hp"), (near("c", 1) - F.col("c")).alias("hn"),
    )
    steps = steps.select("*", near("hp", -1).alias("hpp"), near("hn", 1).alias("hnn"))
    inner = (F.col("pos") >= 1) & (F.col("pos") <= F.col("n") - 2)
    first, last = F.col("pos") == 1, F.col("pos") == F.col("n") - 2
    hp, hn = F.col("hp"), F.col("hn")
    system = steps.select(
        "*",
        F.when(inner, 2 * (hp + hn) + F.when(first, hp * (1 + hp / hn)).otherwise(0.0) + F.when(last, hn * (1 + hn / hp)).otherwise(0.0)).alias("d"),
        F.when(inner, hn - F.when(first, hp * hp / hn).otherwise(0.0)).alias("u"),
        # What the row after this one has below its diagonal.
        F.when(F.col("pos") + 1 == F.col("n") - 2, hn - F.col("hnn") * F.col("hnn") / hn).otherwise(hn).alias("l"),
    ).where(inner)
    fold = lambda rows, w: F.aggregate(
        rows, F.lit(0.0), lambda acc, x: F.when(acc == 0, x["d"]).otherwise(x["d"] - x[w] / acc)
    )
    pair = system.withColumn("w", F.col("u") * F.col("l")).withColumn("w_before", near("w", -1))
    before = F.collect_list(F.struct("d", F.coalesce("w_before", F.lit(0.0)).alias("w"))).over(order.rowsBetween(-KNOTS, 0))
    after = F.collect_list(F.struct("d", F.coalesce("w", F.lit(0.0)).alias("w"))).over(order.rowsBetween(0, KNOTS))
    solved = pair.select("*", fold(before, "w").alias("from_left"), fold(F.reverse(after), "w").alias("from_right"))
    solved = solved.select("*", (-F.col("l") / F.col("from_left")).alias("left"), (-near("u", -1) / F.col("from_right")).alias("right"))
    knot = F.struct("i_before", "i", "i_after", "hp", "hn", "left", "right")
    chain = lambda a, b: F.collect_list(knot).over(order.rowsBetween(a, b))
    return solved.select(
        "pos", "n", "own", "from_left", "u", "l", near("from_right", 1).alias("from_right"), knot.alias("here"), F.lead(knot, 1).over(order).alias("next"),
        F.reverse(chain(-KNOTS, -1)).alias("before"), chain(2, KNOTS + 1).alias("after"),
    ).where("own")


def cubic_axis(source: DataFrame, target: DataFrame, bounds: Sequence[float] | None = None, length: int | None = None) -> DataFrame:
    """Weighted source indices per target index, ``target_i, source_i, weight, corners``.

    Weights are those of the cubic spline with not-a-knot ends, of fewer than four source
    coordinates those of the polynomial through them. ``weight`` is NULL beyond the
    source's ends, ``corners`` the number of a target's weights. A target on a source
    coordinate needs that one alone. ``length`` is the number of source coordinates.
    """
    if length is None:
        length = source.where("c IS NOT NULL").count()
    found = axis_neighbours(source, target, bounds).withColumn("inside", _in_range())
    ends = F.coalesce("below", "above")
    alone = found.where(~F.col("inside") | (F.col("c") == F.col("above.c")))
    alone = alone.select(
        F.col("i").alias("target_i"),
        F.when(F.col("inside"), F.col("above.i")).otherwise(ends["i"]).alias("source_i"),
        F.when(F.col("inside"), F.lit(1.0)).alias("weight"),
    )
    between = found.where(F.col("inside") & (F.col("c") < F.col("above.c")))
    if length < 4:
        weights = _polynomial(source, between)
    else:
        weights = _spline(source, between, bounds)
    rows = weights.groupBy("target_i", "source_i").agg(F.sum("weight").alias("weight")).where(F.abs("weight") > LEAST_WEIGHT)
    rows = rows.unionByName(alone)
    return rows.withColumn("corners", F.count(F.lit(1)).over(W.partitionBy("target_i")))


def _polynomial(source: DataFrame, between: DataFrame) -> DataFrame:
    """Lagrange weights of at most three coordinates."""
    knots = [(r["i"], r["c"]) for r in source.where("c IS NOT NULL").orderBy("c").limit(3).collect()]
    terms = []
    for i, c in knots:
        weight = F.lit(1.0)
        for j, d in knots:
            if j != i:
                weight = weight * (F.col("c") - F.lit(float(d))) / F.lit(float(c) - float(d))
        terms.append(F.struct(F.lit(i).alias("source_i"), weight.alias("weight")))
    if not terms:
        return between.select(F.col("i").alias("target_i"), F.col("i").alias("source_i"), F.lit(None).cast("double").alias("weight")).where("false")
    return between.select(F.col("i").alias("target_i"), F.explode(F.array(*terms)).alias("x")).select("target_i", "x.*")


def _spline(source: DataFrame, between: DataFrame, bounds: Sequence[float] | None) -> DataFrame:
    placed = _placed(source, bounds).select(F.col("i").alias("low_i"), "pos", F.col("n").alias("knots"))
    base = F.least(F.greatest(F.col("pos"), F.lit(1)), F.col("knots") - 3)
    asked = between.select(
        F.col("i").alias("target_i"), F.col("c").alias("t"), F.col("below.i").alias("low_i"), F.col("below.c").alias("x0"),
        F.col("above.i").alias("high_i"), F.col("above.c").alias("x1"),
    ).join(placed, "low_i").withColumn("base", base)
    both = asked.join(_knots(source, bounds).withColumnRenamed("pos", "base").drop("n"), "base")
    h = F.col("x1") - F.col("x0")
    a, b = (F.col("x1") - F.col("t")) / h, (F.col("t") - F.col("x0")) / h
    low, high = (a * a * a - a) * h * h / 6, (b * b * b - b) * h * h / 6
    # In the outermost intervals the end's second derivative follows from its two neighbours.
    at_first, at_last = F.col("pos") == 0, F.col("pos") == F.col("knots") - 2
    r, s = F.col("here.hp") / F.col("here.hn"), F.col("next.hn") / F.col("next.hp")
    one = F.when(at_first, high + low * (1 + r)).when(at_last, -high * s).otherwise(low)
    two = F.when(at_first, -low * r).when(at_last, low + high * (1 + s)).otherwise(high)
    both = both.select("*", a.alias("wa"), b.alias("wb"), one.alias("g0"), two.alias("g1"))
    det = F.col("from_left") * F.col("from_right") - F.col("u") * F.col("l")
    both = both.select(
        "*", ((F.col("g0") * F.col("from_right") - F.col("l") * F.col("g1")) / det).alias("z0"),
        ((F.col("from_left") * F.col("g1") - F.col("u") * F.col("g0")) / det).alias("z1"),
    )

    def shrinking(chain: str, factor: str, start: str) -> Column:
        """The solution at the knots of a chain, each a multiple of the one before."""
        return F.aggregate(
            chain, F.struct(F.col(start).alias("z"), F.expr("cast(array() as array<double>)").alias("all")),
            lambda acc, x: F.struct((acc["z"] * x[factor]).alias("z"), F.concat(acc["all"], F.array(acc["z"] * x[factor])).alias("all")),
        )["all"]

    solved = F.concat(
        F.arrays_zip(F.col("before").alias("k"), shrinking("before", "left", "z0").alias("z")),
        F.array(F.struct(F.col("here").alias("k"), F.col("z0").alias("z")), F.struct(F.col("next").alias("k"), F.col("z1").alias("z"))),
        F.arrays_zip(F.col("after").alias("k"), shrinking("after", "right", "z1").alias("z")),
    )
    term = lambda i, w: F.struct(i.alias("source_i"), w.cast("double").alias("weight"))
    z, k = F.col("x.z"), F.col("x.k")
    of_knots = both.select("target_i", F.explode(solved).alias("x")).select("target_i", F.explode(F.array(
        term(k["i_before"], 6 * z / k["hp"]), term(k["i"], -6 * z * (1 / k["hp"] + 1 / k["hn"])), term(k["i_after"], 6 * z / k["hn"]),
    )).alias("y"))
    own = both.select("target_i", F.explode(F.array(term(F.col("low_i"), F.col("wa")), term(F.col("high_i"), F.col("wb")))).alias("y"))
    return of_knots.union(own).select("target_i", "y.source_i", "y.weight")


def pchip_axis(source: DataFrame, target: DataFrame, bounds: Sequence[float] | None = None) -> DataFrame:
    """Up to four source indices per target: ``target_i, source_i, role, corners`` and the coordinates ``t, x0 ... x3``.

    Roles 1 and 2 are the neighbours, 0 and 3 those beyond them, where there are any. A target on a
    source coordinate has that one alone, with role 4, and one beyond the ends role 5.
    """
    dealt, order = _blocks(_placed(source, bounds))
    shift = {0: -1, 1: 0, 2: 1, 3: 2}
    near = lambda name, k: F.lead(name, k).over(order) if k >= 0 else F.lag(name, -k).over(order)
    knots = dealt.select(
        "own", F.col("i").alias("low_i"), *[near(name, k).alias(f"{'x' if name == 'c' else 'i'}{role}") for role, k in shift.items() for name in ("i", "c")]
    ).where("own").drop("own")
    found = axis_neighbours(source, target, bounds).withColumn("inside", _in_range())
    on_knot = F.col("inside") & (F.col("c") == F.col("above.c"))
    xs = [f"x{role}" for role in shift]
    ends = F.coalesce("below", "above")
    alone = found.where(~F.col("inside") | on_knot).select(
        F.col("i").alias("target_i"), F.when(on_knot, F.col("above.i")).otherwise(ends["i"]).alias("source_i"),
        F.when(on_knot, F.lit(4)).otherwise(F.lit(5)).alias("role"), F.col("c").alias("t"), *[F.lit(None).cast("double").alias(x) for x in xs],
    )
    between = found.where(F.col("inside") & ~on_knot).select(F.col("i").alias("target_i"), F.col("c").alias("t"), F.col("below.i").alias("low_i"))
    roles = F.array(*[F.struct(F.col(f"i{role}").alias("source_i"), F.lit(role).alias("role")) for role in shift])
    rows = between.join(knots, "low_i").select("target_i", "t", *xs, F.explode(F.filter(roles, lambda y: y["source_i"].isNotNull())).alias("y"))
    rows = rows.select("target_i", "y.source_i", "y.role", "t", *xs).unionByName(alone)
    return rows.withColumn("corners", F.count(F.lit(1)).over(W.partitionBy("target_i")))


def _end_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """One-sided slope at an end that keeps the shape of the data."""
    slope = ((2 * h0 + h1) * m0 - h0 * m1) / (h0 + h1)
    return (
        F.when(F.signum(slope) != F.signum(m0), F.lit(0.0))
        .when((F.signum(m0) != F.signum(m1)) & (F.abs(slope) > 3 * F.abs(m0)), 3 * m0)
        .otherwise(slope)
    )


def _inner_slope(h0: Column, h1: Column, m0: Column, m1: Column) -> Column:
    """Weighted harmonic mean of the slopes on either side, 0 at a turn."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(m0 * m1 <= 0, F.lit(0.0)).otherwise((w0 + w1) / (w0 / m0 + w1 / m1))


def monotone_cubic(t: Column, x: Sequence[Column], y: Sequence[Column]) -> Column:
    """The value at t, between x[1] and x[2]; x[0] and x[3] may be NULL."""
    h = [x[k + 1] - x[k] for k in range(3)]
    m = [(y[k + 1] - y[k]) / h[k] for k in range(3)]
    first, last = x[0].isNull(), x[3].isNull()
    d0 = F.when(first & last, m[1]).when(first, _end_slope(h[1], h[2], m[1], m[2])).otherwise(_inner_slope(h[0], h[1], m[0], m[1]))
    d1 = F.when(first & last, m[1]).when(last, _end_slope(h[1], h[0], m[1], m[0])).otherwise(_inner_slope(h[1], h[2], m[1], m[2]))
    s = (t - x[1]) / h[1]
    rise = s * s * (3 - 2 * s)
    return (1 - rise) * y[1] + rise * y[2] + h[1] * s * (1 - s) * ((1 - s) * d0 - s * d1)


def spline_maps(
    source_cells: DataFrame, target_cells: DataFrame, method: str, *, sizes: tuple[GridSize, GridSize] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Latitude and longitude maps for ``regrid_spline``; the ``sizes`` of the grids are measured by a small job if not given."""
    if sizes is None:
        sizes = tuple(measure({"source": source_cells, "target": target_cells}).values())
    source, target = (_coordinates(cells) for cells in (source_cells, target_cells))

    def one(axis: str) -> DataFrame:
        split = max(size.lengths[axis] for size in sizes) > RANGE_ROWS
        bounds = sorted({*sizes[0].cuts[axis], *sizes[1].cuts[axis]}) if split else None
        if method == "cubic":
            found = cubic_axis(source[axis], target[axis], bounds, sizes[0].lengths[axis])
        else:
            found = pchip_axis(source[axis], target[axis], bounds)
        return hinted(found, sizes[1].axes_fit and not split)

    return one("iy"), one("ix")


def _along(df: DataFrame, axis_map: DataFrame, axis: str, method: str, value: str) -> DataFrame:
    """Interpolation along one axis; NULL where a needed value is missing."""
    rest = [c for c in df.columns if c not in (axis, value)]
    named = axis_map.withColumnsRenamed({"source_i": axis, "target_i": "target"})
    joined = df.join(named, axis)
    if method == "cubic":
        part = (F.col("weight") * F.col(value)).alias("part")
        parts = joined.select(*rest, F.col("target").alias(axis), part, "corners")
        found = parts.groupBy(*rest, axis).agg(F.when(F.count("part") == F.max("corners"), F.sum("part")).alias(value))
    else:
        keep = ["t", "x0", "x1", "x2", "x3"]
        parts = joined.select(*rest, F.col("target").alias(axis), F.col(value).alias("y"), "role", "corners", *keep)
        by_role = [F.max(F.when(F.col("role") == role, F.col("y"))).alias(f"y{role}") for role in range(5)]
        sums = parts.groupBy(*rest, axis).agg(*by_role, F.count("y").alias("held"), F.max("corners").alias("corners"), F.max("role").alias("last"), *[F.max(c).alias(c) for c in keep])
        curve = monotone_cubic(F.col("t"), [F.col(f"x{k}") for k in range(4)], [F.col(f"y{k}") for k in range(4)])
        whole = F.col("held") == F.col("corners")
        found = sums.select(*rest, axis, F.when(F.col("last") == 4, F.col("y4")).when(whole & (F.col("last") < 4), curve).alias(value))
    return found


def regrid_spline(df: DataFrame, lat_map: DataFrame, lon_map: DataFrame, method: str, *, value: str = "value") -> DataFrame:
    """Interpolation along longitudes, then along latitudes, by maps of ``spline_maps``.

    NULL beyond the grid and where a value with a weight is missing, which for the
    cubic spline are all values up to KNOTS away on either axis.
    """
    rest = [d for d in dimension_columns(df) if d not in CELL]
    found = _along(df.select(*rest, *CELL, value), lon_map, "ix", method, value)
    return _along(found, lat_map, "iy", method, value).select(*rest, *CELL, value)
