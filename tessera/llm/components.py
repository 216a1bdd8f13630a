"""Connected components of a graph given by its edges, by repeated contraction.

Each round maps every vertex to the one of its closed neighbourhood whose salted hash is least, and relabels the edges;
loops go. Hashes are salted by the round, so that neither paths nor stars contract slowly: a constant share of the
vertices is expected to go in each round. Only aggregations with partial sums and joins on unique keys are used; a hub's
edges are never gathered. Every round is a written table, so a lost executor costs one round at most."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``edges``: a, b (long). One row (v, root) for each vertex that has an edge to another; ``root`` is one of its
    component's vertices, the same for all of them."""
    a, b = F.col("a"), F.col("b")
    loopless = lambda df: df.where(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    edges = written(loopless(edges), "edges")
    labels, number = None, 0
    while labels is None or not edges.isEmpty():
        best = lambda x: F.struct(F.xxhash64(F.lit(number), x).alias("h"), x.alias("to"))  # noqa: E731, B023
        ends = edges.select(a.alias("v"), b.alias("u")).union(edges.select(b.alias("v"), a.alias("u")))
        step = ends.groupBy("v").agg(F.min(best(F.col("u"))).alias("m")).select("v", F.least(F.col("m"), best(F.col("v")))["to"].alias("to"))
        step = written(step, "step")
        of = lambda name: step.select(F.col("v").alias(name), F.col("to").alias(f"{name}_to"))  # noqa: E731, B023
        moved = edges.join(of("a"), "a").join(of("b"), "b").select(F.col("a_to").alias("a"), F.col("b_to").alias("b"))
        edges = written(loopless(moved), "edges")
        if labels is None:
            labels = step.withColumnRenamed("to", "root")
        else:
            labels = written(labels.join(of("root"), "root", "left").select("v", F.coalesce("root_to", "root").alias("root")), "labels")
        number += 1
    return labels
