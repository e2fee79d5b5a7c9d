"""Small hand-made tables."""

from datetime import datetime

import numpy as np
import pandas as pd

from gridverify.schema import CELLS, ENSEMBLE, REFERENCE, WEATHER


def ensemble(spark, rows):
    """Rows ``(time text, member, iy, ix, value)``."""
    return spark.createDataFrame(
        [(datetime.fromisoformat(t), m, y, x, v) for t, m, y, x, v in rows], ENSEMBLE
    )


def reference(spark, rows):
    return spark.createDataFrame(
        [(datetime.fromisoformat(t), y, x, v) for t, y, x, v in rows], REFERENCE
    )


def weather(spark, rows):
    return spark.createDataFrame([(datetime.fromisoformat(t), k) for t, k in rows], WEATHER)


def cells(spark, lats, lons):
    return spark.createDataFrame(
        [(y, x, float(a), float(o)) for y, a in enumerate(lats) for x, o in enumerate(lons)], CELLS
    )


def field(spark, values):
    """A map ``iy, ix, value`` from a two-dimensional array; NaN becomes NULL."""
    values = np.asarray(values, dtype=float)
    rows = [
        (y, x, None if np.isnan(v) else float(v)) for (y, x), v in np.ndenumerate(values)
    ]
    return spark.createDataFrame(rows, "iy INT, ix INT, value DOUBLE")


def array(df, value="value"):
    """The map as an array ordered by iy, ix; NULL becomes NaN."""
    p = pd.DataFrame([r.asDict() for r in df.select("iy", "ix", value).collect()])
    return p.pivot(index="iy", columns="ix", values=value).to_numpy(dtype=float)


def as_dict(df, keys, value="value"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}
