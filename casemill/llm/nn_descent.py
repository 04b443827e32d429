"""Approximate nearest neighbours with NN-descent graphs and greedy search.

Vectors are dealt into cells by their nearest centre; centres come from k-means on a
bounded sample (``Settings.sample``).  Cells are parted by a hash into shards of at
most about ``Settings.shard_size``; a shard's graph and vectors fit into one task,
whatever the table.  In each shard, a graph of the nearest neighbours found so far
starts from random projections and is refined by NN-descent: Spark joins bring every
node the neighbours of its neighbours (out-going and in-coming ones), the best of
them stay.  A query walks the graphs of some shards greedily: it opens the best
nodes that are not open yet, until the best ``Settings.beam`` are all open.  The
best of all these shards are ranked by the inner product in double precision.

A query goes to the cells whose centres have the largest inner products with it.  How
many cells that takes is measured: the true neighbours of ``Settings.probe`` queries
are found by brute force over all rows, and enough cells are taken that
``Settings.covered`` of them lie inside (with few cells, or vectors without any
structure, that may be all cells).  Every row is indexed; work grows with the number
of queries times the cells taken, not with queries times shards, as long as there are
no more than ``Settings.cells`` shards; beyond that, the shards of a cell grow.

Cases: vectors that are null, empty, zero, or hold null or non-finite components
take no part, nor do those with another dimension than most (of equally common
ones, the larger); null ids take no part; rows that repeat an id are rows of their
own; of equal scores the smaller id is nearer; with fewer candidates than asked
for, all of them are ranked if the walk meets them (a shard of up to ``beam`` rows
is always searched in full); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import dropped, small, written


@dataclass(frozen=True)
class Settings:
    nearest: int = 20
    shard_size: int = 8_192
    degree: int = 24
    out_edges: int = 12
    in_edges: int = 12
    trees: int = 3
    leaf: int = 192
    sweeps: int = 4
    beam: int = 256
    opened: int = 12
    block: int = 1_024
    sample: int = 32_768
    cells: int = 2_048
    probe: int = 64
    covered: float = 0.97
    seed: int = 17


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and vec (array<double>) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return rows.where(F.forall("vec", finite) & F.exists("vec", lambda x: x != 0))


def centres(x: np.ndarray, k: int, seed: int, turns: int = 12) -> np.ndarray:
    """k-means: the centres of k cells of the rows of ``x`` (fewer if rows repeat)."""
    rng = np.random.default_rng(seed)
    found = np.unique(x[rng.choice(len(x), min(k, len(x)), replace=False)], axis=0)
    for _ in range(turns):
        cell = nearest_centre(x, found)
        sums, n = np.zeros(found.shape), np.bincount(cell, minlength=len(found))
        np.add.at(sums, cell, x)
        found = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], found)
    return found


def nearest_centre(x: np.ndarray, found: np.ndarray) -> np.ndarray:
    return np.argmin((found * found).sum(1) - 2 * (x @ found.T), axis=1)


def _stacked(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(np.float64)


@dataclass(frozen=True)
class Cells:
    """Centres, and the first shard, the number of shards and the number of vectors of each."""

    centres: np.ndarray
    first: np.ndarray
    shards: np.ndarray
    sizes: np.ndarray


def _celled(rows: DataFrame, n: int, s: Settings) -> tuple[DataFrame, np.ndarray]:
    """Adds the cell of each row."""
    order = F.xxhash64("vec_id", "vec", F.lit(s.seed))
    sample = rows.orderBy(order, "vec_id").limit(s.sample).select("vec").collect()
    found = centres(np.array([r["vec"] for r in sample], np.float64), min(s.cells, -(-n // s.shard_size)), s.seed)
    held = rows.sparkSession.sparkContext.broadcast(found)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.assign(cell=nearest_centre(_stacked(frame["vec"]), held.value).astype(np.int32) if len(frame) else [])

    return written(rows.mapInPandas(run, "vec_id long, vec array<double>, cell int"), "cells"), found


def _nodes(vectors: DataFrame, s: Settings) -> tuple[DataFrame, Cells | None]:
    """(shard, node, vec_id, vec): node numbers run from 0 in each shard."""
    rows = usable(vectors)
    sizes = rows.groupBy(F.size("vec").alias("d")).count().orderBy(F.col("count").desc(), F.col("d").desc()).first()
    if sizes is None:
        return rows.select(F.lit(0).alias("shard"), F.lit(0).alias("node"), "vec_id", "vec").limit(0), None
    celled, found = _celled(rows.where(F.size("vec") == sizes["d"]), sizes["count"], s)
    counts = np.zeros(len(found), np.int64)
    for cell, n in celled.groupBy("cell").count().collect():
        counts[cell] = n
    shards = -(-counts // s.shard_size)
    cells = Cells(found, np.cumsum(shards) - shards, shards, counts)
    table = F.broadcast(rows.sparkSession.createDataFrame([(i, int(f), int(k)) for i, (f, k) in enumerate(zip(cells.first, shards, strict=True)) if k], "cell int, first int, shards int"))
    # The place in the written table parts rows that repeat an id.
    dealt = celled.withColumn("place", F.monotonically_increasing_id()).join(table, "cell")
    dealt = dealt.withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id", "place", F.lit(s.seed)), F.col("shards")).cast("int"))
    order = W.partitionBy("shard").orderBy("vec_id", F.xxhash64("vec"))
    nodes = written(dealt.select("shard", (F.row_number().over(order) - 1).alias("node"), "vec_id", "vec"), "vectors")
    dropped(celled)
    return nodes, cells


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest of each row, largest first."""
    k = min(k, scores.shape[1])
    part = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    return np.take_along_axis(part, np.argsort(-np.take_along_axis(scores, part, 1), axis=1, kind="stable"), 1)


GRAPH = "shard int, node int, near array<int>"


def _first_graph(nodes: DataFrame, s: Settings) -> DataFrame:
    """Neighbours within the leaves of a few random projection trees."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("node")
        x = np.stack(frame["vec"].to_numpy()).astype(np.float32)
        n, rng = len(x), np.random.default_rng(s.seed + int(frame["shard"].iloc[0]))
        near = [set() for _ in range(n)]
        for _ in range(s.trees):
            open_ = [np.arange(n)]
            while open_:
                at = open_.pop()
                if len(at) > s.leaf:
                    a, b = rng.choice(at, 2, replace=False)
                    order = at[np.argsort(x[at] @ (x[a] - x[b]), kind="stable")]
                    open_ += [order[: len(at) // 2], order[len(at) // 2 :]]
                    continue
                scores = x[at] @ x[at].T
                np.fill_diagonal(scores, -np.inf)
                for i, places in zip(at, _best(scores, min(s.degree, len(at) - 1)) if len(at) > 1 else np.empty((len(at), 0), int), strict=True):
                    near[i].update(at[places].tolist())
        out = []
        for i, found in enumerate(near):
            c = np.array(sorted(found), np.int64)
            out.append(c[np.argsort(-(x[c] @ x[i]), kind="stable")][: s.degree].astype(np.int32))
        return pd.DataFrame({"shard": frame["shard"].to_numpy(), "node": frame["node"].to_numpy(), "near": out})

    return nodes.select("shard", "node", "vec").groupBy("shard").applyInPandas(run, GRAPH)


def _two_steps(graph: DataFrame, s: Settings) -> DataFrame:
    """(shard, node, near, far): far are the neighbours of neighbours, by joins on the neighbour."""
    out = graph.select("shard", "node", F.explode(F.slice("near", 1, s.out_edges)).alias("to"))
    back = out.groupBy("shard", "to").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.xxhash64("node", F.lit(s.seed)).alias("h"), "node"))), 1, s.in_edges)["node"].alias("back"))
    both = written(
        graph.join(back.withColumnRenamed("to", "node"), ["shard", "node"], "left").select(
            "shard", "node", "near", F.array_union(F.slice("near", 1, s.out_edges), F.coalesce("back", F.expr("cast(array() as array<int>)"))).alias("around")
        ),
        "around",
    )
    hop = both.select("shard", F.col("node").alias("start"), F.explode("around").alias("node"))
    met = hop.join(both.select("shard", "node", F.col("around").alias("theirs")), ["shard", "node"])
    far = met.groupBy("shard", F.col("start").alias("node")).agg(F.array_distinct(F.flatten(F.collect_list("theirs"))).alias("far"))
    return both.select("shard", "node", "near").join(far, ["shard", "node"], "left"), both


def _refined(graph: DataFrame, nodes: DataFrame, s: Settings) -> DataFrame:
    found, held = _two_steps(graph, s)

    def run(_key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        right = right.sort_values("node")
        x = np.stack(right["vec"].to_numpy()).astype(np.float32)
        out = []
        for node, near, far in zip(left["node"], left["near"], left["far"], strict=True):
            c = np.union1d(near, [] if far is None else far).astype(np.int64)
            c = c[c != node]
            scores = x[c] @ x[node]
            top = np.argpartition(-scores, s.degree)[: s.degree] if len(c) > s.degree else np.arange(len(c))
            out.append(c[top[np.argsort(-scores[top], kind="stable")]].astype(np.int32))
        return pd.DataFrame({"shard": left["shard"].to_numpy(), "node": left["node"].to_numpy(), "near": out})

    vectors = nodes.select("shard", "node", "vec")
    refined = written(found.groupBy("shard").cogroup(vectors.groupBy("shard")).applyInPandas(run, GRAPH), "graph")
    dropped(held)
    return refined


def neighbour_graph(nodes: DataFrame, s: Settings) -> DataFrame:
    graph = written(_first_graph(nodes, s), "graph")
    for _ in range(s.sweeps):
        new = _refined(graph, nodes, s)
        dropped(graph)
        graph = new
    return graph


def greedy_search(x: np.ndarray, near: np.ndarray, q: np.ndarray, own: np.ndarray, s: Settings) -> np.ndarray:
    """For each query the nodes of its final beam, best first (-1: none).

    x: vectors; near: neighbours by node (-1: none); own: the query's node, or -1.
    All queries of a block take a step together.
    """
    n, rows = len(x), np.arange(len(q))[:, None]
    beam = min(s.beam, n)
    starts = np.random.default_rng(s.seed).permutation(n)[: n if n <= s.beam else beam // 2]
    pool = np.tile(starts, (len(q), 1))
    pool[:, 0] = np.where((own >= 0) & ~(pool == own[:, None]).any(1), own, pool[:, 0])
    # A spare last column takes what padding (-1) marks.
    seen = np.zeros((len(q), n + 1), bool)
    seen[rows, pool] = True
    score = np.einsum("qpd,qd->qp", x[pool], q)
    opened = np.zeros(pool.shape, bool)
    while True:
        order = _best(score, beam)
        pool, score, opened = (np.take_along_axis(a, order, 1) for a in (pool, score, opened))
        turn = _best(np.where(opened | (pool < 0), -np.inf, score), s.opened)
        live = ~np.take_along_axis(opened | (pool < 0), turn, 1)
        if not live.any():
            return pool
        np.put_along_axis(opened, turn, True, 1)
        nodes = np.where(live, np.take_along_axis(pool, turn, 1), 0)
        new = np.where(live[:, :, None], near[nodes], -1).reshape(len(q), -1)
        new.sort(axis=1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        new = np.where((new >= 0) & ~seen[rows, new], new, -1)
        new = -np.sort(-new, axis=1)[:, : max(1, int((new >= 0).sum(1).max()))]
        seen[rows, new] = True
        value = np.where(new >= 0, np.einsum("qpd,qd->qp", x[new], q), -np.inf)
        pool, score = np.concatenate([pool, new], 1), np.concatenate([score, value], 1)
        opened = np.concatenate([opened, np.zeros(new.shape, bool)], 1)


def _cells_taken(nodes: DataFrame, queries: DataFrame, cells: Cells, s: Settings) -> int:
    """How many cells a query goes to, by the true neighbours of a few queries."""
    probe = queries.orderBy(F.xxhash64("vec_id", "shard", "node", F.lit(s.seed)), "vec_id").limit(s.probe).select("vec_id", "shard", "node", "vec").collect()
    x = np.array([r["vec"] for r in probe], np.float64)
    own = [(r["shard"], r["node"]) for r in probe]
    held = nodes.sparkSession.sparkContext.broadcast((x, own, cells.centres))
    k = s.nearest

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, own, found = held.value
        for frame in frames:
            if not len(frame):
                continue
            v = _stacked(frame["vec"])
            score, cell = asked @ v.T, nearest_centre(v, found)
            at = {key: i for i, key in enumerate(zip(frame["shard"], frame["node"], strict=True))}
            for i, key in enumerate(own):
                if key in at:
                    score[i, at[key]] = -np.inf
            top = np.argpartition(-score, min(k, len(v)) - 1, axis=1)[:, :k]
            yield pd.DataFrame({"query": np.repeat(np.arange(len(asked)), top.shape[1]), "score": np.take_along_axis(score, top, 1).ravel(), "cell": cell[top].ravel()})

    near = nodes.mapInPandas(run, "query int, score double, cell int")
    best = near.where(F.col("score") > float("-inf")).groupBy("query").agg(F.slice(F.sort_array(F.collect_list(F.struct("score", "cell")), False), 1, k).alias("best")).collect()
    rank = np.argsort(np.argsort(-(x @ cells.centres.T), axis=1, kind="stable"), axis=1)
    needed = np.sort([rank[r["query"], b["cell"]] for r in best for b in r["best"]])
    return int(needed[min(len(needed) - 1, int(np.ceil(s.covered * len(needed))) - 1)]) + 1 if len(needed) else 1


def cells_of(x: np.ndarray, cells: Cells, taken: int, least: int) -> list[np.ndarray]:
    """The cells that each query goes to: the ``taken`` best, and further ones until they hold ``least`` vectors, or all there are."""
    best = _best(x @ cells.centres.T, taken)
    short = np.flatnonzero(cells.sizes[best].sum(axis=1) < least)
    out = list(best)
    if len(short):
        every = _best(x[short] @ cells.centres.T, len(cells.centres))
        held = np.cumsum(cells.sizes[every], axis=1)
        for row, order, upto in zip(short, every, held, strict=True):
            out[row] = order[: int(np.searchsorted(upto, least)) + 1]
    return out


def _routed(queries: DataFrame, cells: Cells, taken: int, s: Settings) -> DataFrame:
    """A row for each query and shard of the cells that it goes to; they hold as many vectors as it is to find, and itself."""
    held = queries.sparkSession.sparkContext.broadcast(cells)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = held.value
        for frame in frames:
            if len(frame):
                cell = cells_of(_stacked(frame["vec"]), c, taken, s.nearest + 1)
                yield frame.assign(shards=[np.concatenate([c.first[i] + np.arange(c.shards[i]) for i in row]).astype(np.int32) for row in cell])

    routed = queries.mapInPandas(run, "vec_id long, home int, node int, vec array<double>, shards array<int>")
    return routed.select("vec_id", "home", "node", "vec", F.explode("shards").alias("shard"))


def nearest(vectors: DataFrame, every: int = 20, s: Settings = Settings()) -> DataFrame:
    """query_id, rank, vec_id and score of each query's nearest rows; queries have an id divisible by ``every``."""
    nodes, cells = _nodes(vectors, s)
    result = "query_id long, rank int, vec_id long, score double"
    if cells is None:
        return vectors.sparkSession.createDataFrame([], result)
    graph = neighbour_graph(nodes, s)
    queries = nodes.where(F.col("vec_id") % every == 0)
    taken = len(cells.centres) if len(cells.centres) <= 2 else _cells_taken(nodes, queries, cells, s)
    asked = written(_routed(queries.select("vec_id", F.col("shard").alias("home"), "node", "vec"), cells, taken, s), "routed")
    # As many blocks of queries meet a shard as it has queries for; its vectors are copied to each.
    blocks = written(asked.groupBy("shard").agg(F.ceil(F.count("*") / s.block).cast("int").alias("blocks")), "blocks")
    asked = asked.join(small(blocks), "shard").withColumn("block", F.pmod(F.xxhash64("vec_id", "home", "node"), F.col("blocks")).cast("int")).drop("blocks")
    held = nodes.join(graph, ["shard", "node"]).join(small(blocks), "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")

    def run(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:  # noqa: ANN001
        out = []
        if len(left) and len(right):
            right = right.sort_values("node")
            exact = np.stack(right["vec"].to_numpy())
            x, ids = exact.astype(np.float32), right["vec_id"].to_numpy()
            near = np.full((len(x), s.degree), -1, np.int64)
            for i, found in enumerate(right["near"]):
                near[i, : len(found)] = found
            own = np.where(left["home"].to_numpy() == key[0], left["node"].to_numpy(), -1)
            asked_x = np.stack(left["vec"].to_numpy())
            for at in range(0, len(left), 128):
                part = slice(at, at + 128)
                pool = greedy_search(x, near, asked_x[part].astype(np.float32), own[part], s)
                for i, (found, mine) in enumerate(zip(pool, own[part], strict=True)):
                    found = found[(found >= 0) & (found != mine)]
                    value = exact[found] @ asked_x[at + i]
                    top = np.lexsort((ids[found], -value))[: s.nearest]
                    row = left.iloc[at + i]
                    out += [(row["vec_id"], row["home"], row["node"], ids[found[t]], value[t]) for t in top]
        return pd.DataFrame(out, columns=["query_id", "home", "node", "vec_id", "score"])

    keys = ("shard", "block")
    found = asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, "query_id long, home int, node int, vec_id long, score double")
    order = W.partitionBy("query_id", "home", "node").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.nearest).select("query_id", "rank", "vec_id", "score")
