"""The star-schema tables in the roles of a verification.

``lineitem`` is the model and the observation: ship date, line number as the
member, supplier as the grid cell, quantity as the value; member 01 is the
observation. ``supplier`` is the grid and its terrain, ``orders`` the
weather-type series, ``events`` an hourly series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridverify.sources.readers import read_grid

# Cells per grid row, and the geometry of the grid.
ROW = 10
LAT0, LON0, SPACING = 46.0, 10.0, 0.25


# Columns the roles use; a given schema spares a look into the files.
SCHEMAS = {
    "lineitem": "l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE, l_discount DOUBLE, l_shipdate TIMESTAMP_NTZ",
    "supplier": "s_suppkey BIGINT, s_acctbal DOUBLE",
    "orders": "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = T.StructType.fromDDL(SCHEMAS[name])
    return read_grid(spark, f"{sf_dir}/{name}.parquet", schema=schema)


def cell_index(cell: str) -> list[Column]:
    return [
        F.expr(f"CAST({cell} DIV {ROW} AS INT) AS iy"),
        F.expr(f"CAST({cell} % {ROW} AS INT) AS ix"),
    ]


def forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All members, the observation's included."""
    member = F.lpad(F.col("l_linenumber").cast("string"), 2, "0")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").alias("time"),
        member.alias("member"),
        *cell_index("l_suppkey"),
        F.col("l_quantity").alias("value"),
        "l_linenumber",
    )


def ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast(spark, sf_dir).where("l_linenumber <> 1").drop("l_linenumber")


def reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast(spark, sf_dir).where("l_linenumber = 1").drop("l_linenumber", "member")


def everything(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast(spark, sf_dir).drop("l_linenumber")


def cells(spark: SparkSession, sf_dir: str, lat0: float = LAT0, lon0: float = LON0) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(*cell_index("s_suppkey")).select(
        "iy",
        "ix",
        (F.col("iy") * SPACING + lat0).alias("lat"),
        (F.col("ix") * SPACING + lon0).alias("lon"),
    )


def rotated_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same cells, latitude falling along a grid row and longitude along a column."""
    return cells(spark, sf_dir).select(
        "iy",
        "ix",
        (F.col("lat") - F.col("ix") * 0.0625).alias("lat"),
        (F.col("lon") - F.col("iy") * 0.03125).alias("lon"),
    )


def terrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        *cell_index("s_suppkey"), F.col("s_acctbal").alias("altitude")
    )


def fine_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three target cells per source cell and axis: on it, half-way (a tie) and beyond half-way."""
    source = cells(spark, sf_dir)
    steps = F.array(*[
        F.struct(F.lit(k).alias("k"), F.lit(d).alias("d"))
        for k, d in enumerate((0.0, 0.125, 0.1875))
    ])
    return (
        source.withColumn("sy", F.explode(steps))
        .withColumn("sx", F.explode(steps))
        .select(
            (F.col("iy") * 3 + F.col("sy.k")).alias("iy"),
            (F.col("ix") * 3 + F.col("sx.k")).alias("ix"),
            (F.col("lat") + F.col("sy.d")).alias("lat"),
            (F.col("lon") + F.col("sx.d")).alias("lon"),
        )
    )


def weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.split_part(F.col("o_orderpriority"), F.lit("-"), F.lit(1)).cast("int")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderdate").alias("time"), kind.alias("slwt")
    )


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("ts").alias("time"),
        F.col("event_type").alias("member"),
        *cell_index("user_id"),
        "value",
    )
