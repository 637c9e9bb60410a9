"""Sorting, choosing and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .aggregates import in_force


def sort_rates(rates: DataFrame) -> DataFrame:
    return rates.orderBy("rate")


def best_mode(candidates: DataFrame, lam: float, by: str = "mb", order: str = "cand") -> DataFrame:
    """Least D + lambda R of each unit, the first of equals, and by how much the runner-up lost."""
    cost = F.col("dist") + F.lit(lam) * F.col("rate")
    ranked = candidates.withColumn("cost", cost).withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy("cost", order, "rate", "dist")))
    two = ranked.where("__n <= 2").groupBy(by).agg(
        F.min(F.when(F.col("__n") == 1, F.col(order))).alias(order), F.min("cost").alias("cost"), F.max("cost").alias("__second"), F.count("*").alias("__k")
    )
    return two.select(by, order, F.round("cost", 6).alias("cost"), F.when(F.col("__k") > 1, F.round(F.col("__second") - F.col("cost"), 6)).alias("margin"))


def frame_range(frames: DataFrame, seek: int, n: int, by: str = "stream_id", order: str = "i") -> DataFrame:
    """``n`` frames of every stream from number ``seek`` on."""
    at = F.row_number().over(Window.partitionBy(by).orderBy(order)) - 1
    return frames.withColumn("__at", at).where(F.col("__at").between(seek, seek + n - 1)).drop("__at")


def rd_front(points: DataFrame, by: str = "mb") -> DataFrame:
    """Distinct points that no other beats in rate or distortion without losing in the other."""
    once = points.select(by, "rate", "dist").groupBy(by, "rate").agg(F.min("dist").alias("dist"))
    earlier = Window.partitionBy(by).orderBy("rate").rowsBetween(Window.unboundedPreceding, -1)
    return once.withColumn("__low", F.min("dist").over(earlier)).where("__low is null or dist < __low").drop("__low")


def mux_union(parts: list[tuple[DataFrame, Column]]) -> DataFrame:
    """Packets of several streams with their pts in one clock (each with the expression that rescales it)."""
    out = None
    for df, pts in parts:
        one = df.withColumn("pts", pts)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def prefer_primary(slices: DataFrame, key: tuple[str, ...] = ("stream_id", "pic", "first_mb"), tie: str = "pos") -> DataFrame:
    """Of slices of the same picture and place the one with the lowest redundant count."""
    w = Window.partitionBy(*key).orderBy("redundant_pic_cnt", tie)
    return slices.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def param_set_changes(a: DataFrame, b: DataFrame, normalise: bool = False) -> DataFrame:
    """Sets that only one of two deliveries has, with the side that has them."""
    if normalise:
        a, b = in_force(a), in_force(b)
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def param_sets_in_common(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def chain(df: DataFrame, steps: list) -> DataFrame:
    """A filter chain: a list of functions (``functools.partial`` of operators) applied in order."""
    for step in steps:
        df = df.transform(step)
    return df
