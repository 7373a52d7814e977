"""Breadth-first search and single-source shortest paths as frontier loops over edge relations (src, dst, w).

Each round handles the frontier only; its rows are checkpointed, so plans stay short. Parents are the least eligible
vertex, so answers are the same on every run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut


MERGE = 16  #: rounds after which what they found is written as one


def bfs(edges: DataFrame, source: int, alpha: float = 0.01, vertices: int | None = None, most: int | None = None) -> DataFrame:
    """(v, level, parent) of every vertex that can be reached; the source is its own parent.

    With a frontier over alpha * vertices the unvisited vertices pull from it, else the frontier pushes; alpha over 1
    only pushes. Answers are the same.
    """
    spark = edges.sparkSession
    e = edges.select("src", "dst").distinct().persist()
    n = vertices if vertices is not None else e.select("dst").distinct().count()
    try:
        frontier = spark.createDataFrame([(source, 0, source)], "v long, level int, parent long")
        visited, size, level, apart = frontier, 1, 0, 0
        while size and (most is None or level < most):
            level += 1
            if apart == MERGE:  # else every round would read as many parts as there are levels
                visited, apart = cut(visited.coalesce(int(spark.conf.get("spark.sql.shuffle.partitions")))), 0
            seen = visited.select(F.col("v").alias("dst"))
            f = frontier.select(F.col("v").alias("src"))
            if size > alpha * max(n, 1):
                found = e.join(seen, "dst", "left_anti").join(f, "src", "left_semi")
            else:
                found = f.join(e, "src").join(seen, "dst", "left_anti")
            frontier = cut(found.groupBy(F.col("dst").alias("v")).agg(F.lit(level).alias("level"), F.min("src").alias("parent")))
            size = frontier.count()
            visited, apart = visited.unionByName(frontier), apart + 1
        return visited
    finally:
        e.unpersist()


def bfs_check(edges: DataFrame, found: DataFrame) -> DataFrame:
    """How many vertices have a parent that isn't one level up, or isn't joined to them."""
    up = found.select(F.col("v").alias("parent"), F.col("level").alias("up"))
    e = edges.select(F.col("src").alias("parent"), F.col("dst").alias("v"), F.lit(True).alias("edge")).distinct()
    rows = found.where("level > 0").join(up, "parent", "left").join(e, ["parent", "v"], "left")
    return rows.agg(F.count_if(~F.coalesce(F.col("up") == F.col("level") - 1, F.lit(False)) | F.col("edge").isNull()).alias("bad"))


def sssp(edges: DataFrame, source: int, most: int | None = None) -> DataFrame:
    """(v, dist): least sums of weights, by relaxing the edges of vertices that got better.

    Better distances are kept as deltas of each round and merged every few rounds.
    Raises for a cycle of negative weight, found when vertices still get better after as many rounds as there are vertices.
    """
    spark = edges.sparkSession
    e = edges.groupBy("src", "dst").agg(F.min("w").alias("w")).persist()
    try:
        rounds = most or e.select("src").union(e.select("dst")).distinct().count() + 1
        active = dist = spark.createDataFrame([(source, 0.0)], "v long, dist double")
        apart = 0
        for _ in range(rounds):
            reached = active.select(F.col("v").alias("src"), F.col("dist").alias("d")).join(e, "src").groupBy(F.col("dst").alias("v")).agg(F.min(F.col("d") + F.col("w")).alias("new"))
            best = dist.groupBy("v").agg(F.min("dist").alias("dist"))
            active = cut(reached.join(best, "v", "left").where("dist is null or new < dist").select("v", F.col("new").alias("dist")))
            if active.isEmpty():
                return best
            dist, apart = dist.unionByName(active), apart + 1
            if apart == MERGE:
                dist, apart = cut(dist.groupBy("v").agg(F.min("dist").alias("dist"))), 0
        raise ValueError("a cycle of negative weight can be reached")
    finally:
        e.unpersist()


def sssp_parents(edges: DataFrame, dist: DataFrame, source: int) -> DataFrame:
    """(v, dist, parent): the least neighbour over a tight edge; null for the source."""
    d = dist.select(F.col("v").alias("src"), F.col("dist").alias("d"))
    tight = edges.join(d, "src").join(dist.select(F.col("v").alias("dst"), "dist"), "dst").where(F.col("d") + F.col("w") <= F.col("dist"))
    least = tight.where(F.col("dst") != source).groupBy(F.col("dst").alias("v")).agg(F.min("src").alias("parent"))
    return dist.join(least, "v", "left").select("v", "dist", "parent")


def sssp_check(edges: DataFrame, found: DataFrame, expected: DataFrame) -> DataFrame:
    """(wrong, loose): distances that differ from the expected ones (v, dist), and parents whose edge isn't tight under these; found is (v, dist, parent)."""
    right = expected.select("v", F.col("dist").alias("right"))
    wrong = found.join(right, "v", "full_outer").agg(F.count_if(~F.col("dist").eqNullSafe(F.col("right"))).alias("wrong"))
    up = expected.select(F.col("v").alias("parent"), F.col("dist").alias("up"))
    e = edges.groupBy(F.col("src").alias("parent"), F.col("dst").alias("v")).agg(F.min("w").alias("w"))
    rows = found.where("parent is not null").select("v", "parent").join(up, "parent", "left").join(e, ["parent", "v"], "left").join(right, "v", "left")
    loose = rows.agg(F.count_if(~F.coalesce(F.col("up") + F.col("w") == F.col("right"), F.lit(False))).alias("loose"))
    return wrong.crossJoin(loose)  # one row each


def components(edges: DataFrame) -> DataFrame:
    """(v, root) of the vertices of edges (a, b): the least vertex of their component.

    Each round hangs every vertex's larger neighbours, and then its smaller ones, on the least vertex it sees, so the
    number of rounds grows with the logarithm of the longest path; edges are cut each round.
    """
    e = edges.select("a", "b").where("a <> b").distinct()
    loops = edges.select(F.col("a").alias("v")).union(edges.select(F.col("b").alias("v"))).distinct()
    state = None
    while True:
        both = e.select("a", "b").unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = cut(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        pair = F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct(F.col("a"), F.col("m").alias("b"))))
        e = cut(large.join(low, "a").select(pair.alias("x")).select("x.a", "x.b").where("a <> b").distinct())
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == state:
            break
        state = now
    low = e.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("root"))
    return loops.join(low, "v", "left").select("v", F.coalesce("root", "v").alias("root"))
