"""Queries that go through streams and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spotframe.operators import geometry
from spotframe.plans.base import Registry, spots
from spotframe.session import cut, shared_folder
from spotframe.streaming import ingest

query = Registry()
QUERIES, SQL = query.queries, query.sql


@query("SELECT lower(trim(marker)) AS marker, strftime(acquired_at, '%Y-%m') AS month, count(*) AS n_rows FROM foci GROUP BY 1, 2")
def stream_ingest_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deliveries appended through a stream, exactly once, then counted."""
    out = shared_folder(spark, "stream")
    s = ingest.file_stream(spark, sf_dir, "foci").select(F.lower(F.trim("marker")).alias("marker"), F.date_format("acquired_at", "yyyy-MM").alias("month"))
    ingest.append_once(s, out)
    return spark.read.schema("marker string, month string").parquet(out).groupBy("marker", "month").agg(F.count("*").alias("n_rows"))


@query()
def polynomial_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cubic fit of the intensity by position per marker, with its residuals."""
    s = cut(spots(spark, sf_dir).where("intensity IS NOT NULL").select("marker", "z", "y", "x", "intensity"))
    fit = cut(geometry.polynomial_fit(s, "marker", ["x", "y", "z"], "intensity"))
    res = geometry.fit_residuals(s, fit, "marker", ["x", "y", "z"], "intensity")
    return fit.join(res, "marker").select("marker", "n", F.col("coefficients")[0].alias("constant"), "mean", "p90", "ok")
