"""Nearest neighbours by NN-descent and greedy graph search (operator 5).

The index is a graph over the distinct vectors.  It starts from exact
neighbours within blocks of vectors that share a nearest centre, and is improved
by joins (``descent.py``): the neighbours of each vector, in both directions,
meet, and pairs that are nearer than what either of them has become
its neighbours, until few change.  A search starts at the query's own vector, if
it is in the index, and at the nearest of a fixed number of entry vectors, and
expands the best candidates of its list until all of them are expanded.  Lists
are short, as most of what is near is the query's neighbour in the graph already;
a query looks at about as many vertices as its list has links.  The recall of
some of the queries is measured against all vectors, and lists are doubled until
it is at least RECALL or they hold every vertex.

Equal vectors are one vertex; the least ids of each, as many as a search
returns, are its members.  Vectors that are null, zero, or have a null or
non-finite component take no part, nor do rows without an id or vectors of
another length than most.  Of rows that share an id the one with the least
vector counts.  Results are exact Euclidean distances in double precision of
the original vectors; which ids are found is approximate.  An empty table gives
an empty result.  Columns other than id and vector are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from newsgrid.llm.common import materialise
from newsgrid.llm.descent import Graph, edges, grown, links, matrix

NEIGHBOURS = 64
REVERSE = 32           # of those that have a vertex as their neighbour, in order of a hash
STILL = 0.01           # share of fresh edges at which the graph is done
ENTRIES, START, LIST = 256, 4, 24
RECALL, MEASURED = 0.95, 200   # queries whose recall is measured
BROADCAST_QUERIES = 50_000     # of one vector each


def usable(df: DataFrame, vec_id: str, vector: str) -> DataFrame:
    """``id`` and ``vec`` of the vectors that take part."""
    rows = df.select(df[vec_id].cast("long").alias("id"), df[vector].alias("vec")).filter(
        "id IS NOT NULL AND size(vec) > 0 "
        "AND forall(vec, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('infinity')) "
        "AND exists(vec, x -> x <> 0)")
    rows = rows.groupBy("id").agg(F.min("vec").alias("vec"))
    rows = materialise(rows, "vectors")
    size = (rows.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("rows"))
            .orderBy(F.desc("rows"), "n").first())
    return rows.filter(F.size("vec") == (size.n if size else 0))


def vertices(rows: DataFrame, members: int) -> DataFrame:
    """``node`` (the least id), ``vec`` and ``members`` of each distinct vector."""
    rank = F.row_number().over(Window.partitionBy("vec").orderBy("id"))
    return (rows.withColumn("rank", rank).filter(F.col("rank") <= members)
            .groupBy("vec").agg(F.min("id").alias("node"),
                                F.sort_array(F.collect_list("id")).alias("members")))


def grow(nodes: DataFrame) -> Graph:
    """The neighbour graph in packed rows."""
    return grown(nodes, NEIGHBOURS, REVERSE, STILL)


def descend(nodes: DataFrame) -> DataFrame:
    """The neighbour graph: ``node``, ``other``, ``dist``, ``fresh``."""
    return edges(grow(nodes))


def distance(rows: DataFrame) -> DataFrame:
    """``query``, ``node`` and ``dist`` from columns ``query``, ``node``, ``qvec``, ``vec``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gap = matrix(batch.column(2)) - matrix(batch.column(3))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(np.sqrt((gap * gap).sum(axis=1)))],
                    names=["query", "node", "dist"])

    return rows.select("query", "node", "qvec", "vec").mapInArrow(
        run, "query long, node long, dist double")


def reaches(nodes: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """``query``, ``reach``, ``most`` of MEASURED queries, against every vertex.

    ``most``, ``k`` or fewer, other vertices are at most ``reach`` away.
    """
    sample = queries.orderBy(F.xxhash64("query"), "query").limit(MEASURED).collect()
    asked = np.array([r.query for r in sample])
    vec = np.array([r.qvec for r in sample], dtype=np.float64)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(asked):
                continue
            x, n = matrix(batch.column(0)), min(k + 1, batch.num_rows)
            d = (x ** 2).sum(axis=1) - 2 * vec @ x.T
            near = np.argpartition(d, n - 1, axis=1)[:, :n]
            dist = np.sqrt(((x[near] - vec[:, None]) ** 2).sum(axis=2)).ravel()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(asked, n)[dist > 0]), pa.array(dist[dist > 0])],
                names=["query", "dist"])

    best = Window.partitionBy("query").orderBy("dist")
    return (nodes.select("vec").mapInArrow(scan, "query long, dist double")
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .groupBy("query").agg(F.max("dist").alias("reach"), F.count("*").alias("most")))


def recall(found: DataFrame, reach: DataFrame) -> float:
    """The share of what is within ``reach`` that was found; ties count as found."""
    hits = (reach.join(found, "query", "left").groupBy("query")
            .agg(F.count_if((F.col("dist") > 0) & (F.col("dist") <= F.col("reach"))).alias("hits"),
                 F.first("most").alias("most")))
    share = hits.agg(F.avg(F.least("hits", "most") / F.col("most"))).first()[0]
    return 1.0 if share is None else share


def search(nodes: DataFrame, graph: DataFrame, queries: DataFrame, size: int) -> DataFrame:
    """``query``, ``node``, ``dist``: each query's list of ``size`` when all of it is expanded."""
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(ENTRIES).select("node", "vec").collect()
    entry = np.array([r.node for r in sample])
    entry_vec = np.array([r.vec for r in sample], dtype=np.float64)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not len(entry):
                continue
            x, k = matrix(batch.column(1)), min(START, len(entry))
            d = (entry_vec ** 2).sum(axis=1) - 2 * x @ entry_vec.T
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(batch.column(0).to_numpy(), k)), pa.array(entry[near].ravel())],
                names=["query", "node"])

    vectors = nodes.select("node", "vec")
    few = F.broadcast(queries) if queries.count() <= BROADCAST_QUERIES else queries
    own = queries.join(vectors, F.col("qvec") == F.col("vec")).select("query", "node")
    found = own.unionByName(queries.mapInArrow(enter, "query long, node long")).distinct()
    best = Window.partitionBy("query").orderBy("dist", "node")
    state, known = None, None
    while True:
        found = materialise(found, "search-found")
        known = found if known is None else known.unionByName(found)
        new = distance(found.join(vectors, "node").join(few, "query")).withColumn(
            "open", F.lit(True))
        if state is not None:
            # What is in the list is expanded already.
            new = state.withColumn("open", F.lit(False)).unionByName(new)
        state = materialise(new.withColumn("rank", F.row_number().over(best))
                            .filter(F.col("rank") <= size).drop("rank"), "search")
        ahead = state.filter("open")
        if ahead.isEmpty():
            return state.select("query", "node", "dist")
        found = (ahead.join(graph, "node").select("query", F.explode("others").alias("node")).distinct()
                 .join(known, ["query", "node"], "left_anti"))


def nearest_rows(df: DataFrame, queries: Column, k: int = 10, vec_id: str = "vec_id",
                 vector: str = "embedding") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: neighbours of the rows where ``queries`` holds.

    ``queries`` is a condition on column ``id``.  A row isn't its own neighbour.
    """
    rows = usable(df, vec_id, vector)
    nodes = materialise(vertices(rows, k + 1), "vertices")
    asked = materialise(rows.filter(queries).select(
        F.col("id").alias("query"), F.col("vec").alias("qvec")), "queries")
    graph = materialise(links(grow(nodes)), "graph-links")
    reach = materialise(reaches(nodes, asked, k), "reaches")
    size, total = max(LIST, k + 1), nodes.count()
    while True:
        found = search(nodes, graph, asked, size)
        if size >= total or recall(found, reach) >= RECALL:
            break
        size *= 2
    best = Window.partitionBy("query").orderBy("dist", "id")
    return (found.join(nodes.select("node", "members"), "node")
            .select("query", "dist", F.explode("members").alias("id")).filter("id <> query")
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"),
                    F.col("dist").alias("score")))
