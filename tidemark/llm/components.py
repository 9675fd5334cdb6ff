"""Connected components of a graph given by its edges, without a graph library and without the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tidemark.llm.rows import prepare

#: A node with more edges than this, and than a thousandth of all, is hot: its edges are dealt to tasks of so many each.
EDGES = 50_000


def _hot(edges: DataFrame, total: int) -> DataFrame | None:
    """(u, k): the hot nodes, fewer than 2,000, with the number of tasks for the edges of each; None if there are none."""
    most = max(EDGES, total // 1000)
    rows = edges.groupBy("u").agg(F.ceil(F.count(F.lit(1)) / most).cast("int").alias("k")).where("k > 1").collect()
    return edges.sparkSession.createDataFrame(rows, StructType([edges.schema["u"], StructField("k", IntegerType())])) if rows else None


def _lowest(edges: DataFrame, hot: DataFrame | None) -> DataFrame:
    """(u, v) with the least neighbour m of u, the node itself included. Only hot nodes' rows are copied, once a task."""
    least = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    if hot is None:
        return edges.join(least.hint("merge"), "u")
    least = least.join(F.broadcast(hot), "u", "left").withColumn("s", F.explode(F.sequence(F.lit(0), F.coalesce("k", F.lit(1)) - 1))).drop("k")
    dealt = edges.join(F.broadcast(hot), "u", "left").withColumn("s", F.pmod(F.xxhash64("v"), F.coalesce("k", F.lit(1))).cast("int")).drop("k")
    return dealt.join(least.hint("merge"), ["u", "s"])


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node with an edge; root is the least node of its component.

    edges: two columns of one orderable type; direction, repeats and loops don't matter; an edge with a null
    is left out. Alternating large-star and small-star steps (Kiveris et al. 2014): each step keeps the components and
    hangs nodes nearer to the least one; about log2 of the largest component's diameter rounds are needed. Each
    round is written to the checkpoint folder, so its lineage is short and it survives lost executors.
    """
    prepare(edges.sparkSession)
    a, b = edges.columns[:2]
    edges = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"), F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)) & F.lit(True))
    edges = edges.where(edges[2]).select("u", "v").distinct().checkpoint()
    before = None
    while True:
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        before = state
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A node has no more edges in `large` than here, so the hot nodes of both are these.
        hot = _hot(both, 2 * state[0])
        large = _lowest(both, hot).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        small = _lowest(large, hot).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = small.select("e.u", "e.v").where("u <> v").distinct().checkpoint()
