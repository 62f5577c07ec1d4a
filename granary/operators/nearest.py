"""Nearest neighbours by rings that widen until they are sure."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.functions import geo as G

#: Half the way round: what a reach that covers every point is.
ROUND_KM = 20016.0


def nearest(queries: DataFrame, points: DataFrame, k: int, write: Callable[[DataFrame], DataFrame], first_km: float = 50.0, growth: float = 4.0) -> DataFrame:
    """(id, near, km, rank): the k nearest points of each query, by distance and then id; all of them if there are fewer.

    queries and points: id, lat, lon. One round is an equi join on cells of the reach; queries that have k points within
    it are done, the others go on to a wider reach, in the end to all points. write ends a DataFrame's lineage.
    """
    out, left, reach = None, queries.select("id", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), first_km
    order = Window.partitionBy("id").orderBy("km", "near")
    while True:
        last = reach >= ROUND_KM / 2
        p = points.select(F.col("id").alias("near"), "lat", "lon")
        if last:
            near = left.join(p.withColumn("_all", F.lit(0)), F.lit(0) == F.col("_all"))  # few queries are left, if any
        else:
            cells = left.withColumn("_cell", F.explode(G.reach_cells(F.col("_lat"), F.col("_lon"), reach)))
            near = cells.join(p.withColumn("_of", G.reach_cell(F.col("lat"), F.col("lon"), reach)), F.col("_cell") == F.col("_of"))
        near = near.withColumn("km", G.haversine(F.col("_lat"), F.col("_lon"), F.col("lat"), F.col("lon")))
        near = near if last else near.filter(F.col("km") <= reach)
        ranked = near.select("id", "near", "km").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        if last:
            return ranked if out is None else out.unionByName(ranked)
        ranked = write(ranked)
        done = ranked.filter(F.col("rank") == k).select(F.col("id").alias("_done"))
        sure = ranked.join(done, F.col("id") == F.col("_done"), "left_semi")
        out = sure if out is None else out.unionByName(sure)
        left = write(left.join(done, F.col("id") == F.col("_done"), "left_anti"))
        if left.isEmpty():
            return out
        reach *= growth
