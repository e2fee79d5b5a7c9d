"""Verification of gridded ensemble forecasts against gridded observations on Spark.

Every operator takes a long-form DataFrame (one row per time, grid cell and
member) and returns a DataFrame, so operators chain with ``df.transform``.
"""
