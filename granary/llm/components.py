"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm._shared import discard, materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. Large: link each larger neighbour of u to the least of u and its neighbours; small: the same for u and its smaller ones."""
    if large:
        sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    else:
        sides = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = sides.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("m"))
    met = sides.join(least, F.col("u") == F.col("at"))
    if large:
        out = met.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("at").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) of one integer type, in either direction. Returns (id, component) for every id that has an edge;
    component is the least id reachable. Rows with a null end and loops are ignored; an empty table gives none.
    Every round is written to the shared folder, so lineage stays short and no link reaches the driver."""
    now = materialize(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    state = None
    while True:
        after = materialize(_star(_star(now, True), False), "edges")
        was, state = state, tuple(after.agg(F.count("*"), F.sum(F.col("a").cast("decimal(20,0)")), F.sum(F.col("b").cast("decimal(20,0)"))).first())
        discard(now)
        now = after
        if state == was:
            break
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
