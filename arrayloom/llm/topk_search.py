"""Exact top-k search by term-at-a-time accumulation.

Vectors are sparse rows of whole-number weights: dimension -> weight, zeros left out. Candidates are dealt into blocks;
a block is an inverted index (for each dimension the positions and weights of its postings). Queries come in blocks too.
For each pair of a query block and a candidate block, the terms are taken one at a time: each query weight times the
term's postings is scattered into a dense array of scores (queries x candidates of the block). A partition selection
keeps each query's k best of the block, and the blocks' winners are merged by score, then least vec_id.

Candidate blocks meet groups of `GROUP` query blocks: rows are dealt by (candidate block, query group) and sorted so that the
candidates come first. A task builds the index once for each such cell and streams the group's query blocks past it, so it
holds one index and one Arrow batch of queries, both of bounded size, and a candidate block moves once for each group.

Defined cases: a vector that is null, or holds null or non-finite components, takes no part; an empty vector scores 0;
vectors of different lengths are compared as if padded by zeros; equal vectors tie by vec_id; rows that repeat a vec_id
are candidates each, and none is a candidate of a query with that vec_id; query rows that repeat a vec_id are one query with
several vectors: its k best scores over all of them are returned (equal rows count once); null vec_ids take no part; other
columns are ignored; fewer than k candidates give all of them.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table

BLOCK = 8192  #: candidates in a block
QUERIES = 256  #: queries in a block
GROUP = 16  #: query blocks that share an index


def whole_numbers(vectors: DataFrame, scale: int = 256, vec_id: str = "vec_id", column: str = "embedding") -> DataFrame:
    """id, v: floor(scale * x) of every usable vector."""
    x = F.col(column)
    usable = x.isNotNull() & F.col(vec_id).isNotNull() & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    return vectors.where(usable).select(F.col(vec_id).cast("long").alias("id"), F.transform(x, lambda e: F.floor(e.cast("double") * scale).cast("long")).alias("v"))


class Postings:
    """Inverted index of one block: for each term the positions and weights of its non-zero postings."""

    def __init__(self, ids: np.ndarray, rows: list):
        self.ids = ids
        width = max((len(r) for r in rows), default=0)
        table = np.zeros((len(rows), width), np.int64)
        for i, r in enumerate(rows):
            table[i, : len(r)] = r
        self.terms = []
        for t in range(width):
            at = np.flatnonzero(table[:, t])
            self.terms.append((None if len(at) == len(rows) else at, np.ascontiguousarray(table[at, t])))

    def scores(self, rows: list) -> np.ndarray:
        out = np.zeros((len(rows), len(self.ids)), np.int64)
        for i, row in enumerate(rows):
            acc = out[i]
            for t in np.flatnonzero(row[: len(self.terms)]).tolist():
                at, weight = self.terms[t]
                if at is None:
                    acc += row[t] * weight
                else:
                    acc[at] += row[t] * weight
        return out


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best candidates but the query's own: ids and scores; ties to smaller ids."""
    other = np.flatnonzero(ids != own)
    s = scores[other]
    if len(s) > k:
        least = np.partition(s, len(s) - k)[len(s) - k]
        keep = np.flatnonzero(s >= least)
        other, s = other[keep], s[keep]
    order = np.lexsort((ids[other], -s))[:k]
    return ids[other][order], s[order]


def search(queries: DataFrame, candidates: DataFrame, k: int = 5, block: int = BLOCK, query_block: int = QUERIES) -> DataFrame:
    """query_id, rank, vec_id, score: exact, for queries (id, v) against candidates (id, v)."""
    import math

    spark = queries.sparkSession
    scratch = Scratch(spark, "top-k")
    queries, candidates = scratch.table(queries, "queries"), scratch.table(candidates, "candidates")
    nc, nq = max(1, math.ceil(candidates.count() / block)), max(1, math.ceil(queries.count() / query_block))
    dealt = lambda df, salt, n: df.groupBy(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).alias("b")).agg(F.collect_list(F.struct("id", "v")).alias("e"))
    up_to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    c = scratch.table(dealt(candidates, 1, nc), "candidate-blocks").select(F.col("b").alias("cb"), up_to(math.ceil(nq / GROUP)).alias("qg"), F.lit(0).alias("kind"), F.col("e.id").alias("ids"), F.col("e.v").alias("vs"))
    q = scratch.table(dealt(queries, 2, nq), "query-blocks").select(up_to(nc).alias("cb"), F.floor(F.col("b") / GROUP).alias("qg"), F.lit(1).alias("kind"), F.col("e.id").alias("ids"), F.col("e.v").alias("vs"))
    cells = c.unionByName(q).repartition("cb", "qg").sortWithinPartitions("cb", "qg", "kind")

    def run(batches):
        import pandas as pd

        at, index = None, None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if r.kind == 0:
                    at, index = (r.cb, r.qg), Postings(np.asarray(r.ids, np.int64), list(r.vs))
                    continue
                if at != (r.cb, r.qg):  # queries without candidates
                    continue
                rows = [np.asarray(v, np.int64) for v in r.vs]
                out = []
                for i in range(0, len(rows), 16):
                    for own, s in zip(r.ids[i : i + 16], index.scores(rows[i : i + 16])):
                        ids, s = best(s, index.ids, int(own), k)
                        out.append((int(own), ids, s))
                yield pd.DataFrame({"query_id": np.repeat([x[0] for x in out], [len(x[1]) for x in out]), "vec_id": np.concatenate([x[1] for x in out]), "score": np.concatenate([x[2] for x in out])})

    found = cells.mapInPandas(run, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    rows = whole_numbers(read_table(spark, sf_dir, "embeddings"))
    return search(rows.where("id % 50 = 0").distinct(), rows)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v q, v c WHERE q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
