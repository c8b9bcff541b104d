"""Approximate nearest neighbours: robust-pruned directed graphs, one per shard, beam search.

Every usable vector is in exactly one shard and is a node of that shard's graph. A graph grows
in batches that double: each new node's neighbours come from a greedy beam search over the graph so
far, are thinned by relaxed distance pruning (a candidate goes when a kept neighbour is ALPHA
times closer to it than the node is), and get edges back, thinned again where a list
overflows; a second round over all nodes refines the lists. A query enters every shard,
follows a beam of BEAM nodes and takes the best of what it met; the shards' answers merge by
(distance, id). Distances in the answer are exact, in double precision, on the vectors as given.

Equal vectors are one node that keeps its K + 1 smallest ids, so a large group of copies
costs one node and still answers exactly. Shards are dealt by a hash of the vector. A shard has
SHARD_ROWS vectors, or more in a large table: one in SHARDS_MOST of all, as far as SHARD_BYTES allow,
since a search costs little more in a larger graph and every query enters every shard. A graph
goes to one task, once; the queries stream past it in Arrow batches, and neither copies of graphs
nor all queries are ever held.

Graphs and searches work on vectors less the shard's mean and divided by its largest component, in
single precision, so that any finite scale of the table serves.

Vectors that are null, empty, all zero, or hold null or non-finite components take no part,
as query or as candidate; vectors of another length than the query's are no candidates. Rows
with a null id take no part. Rows that repeat an id and a vector are one; an id with several
vectors is found once, by the nearest, and asks with all of them. With fewer than K candidates all are returned. An empty
table gives no rows; other columns are passed by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, ids_type, prepare

SHARD_ROWS, SHARDS_MOST, SHARD_BYTES = 8192, 1000, 128 << 20
#: Compute, not size, asks for many tasks here: two for each shard, so that few meet in one.
TASKS_MOST = 10_000
DEGREE, BEAM, BUILD_BEAM, ALPHA = 32, 128, 48, 1.2
K = 10


def _distances(x: np.ndarray, norms: np.ndarray, q: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """Squared distances (single precision) of each query row to its row of nodes; -1 is far."""
    got = norms[nodes] - 2 * np.einsum("bnd,bd->bn", x[nodes], q)
    got += np.einsum("bd,bd->b", q, q)[:, None]
    got[nodes < 0] = np.inf
    return got


def beam_search(x: np.ndarray, graph: np.ndarray, entry: np.ndarray, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (nearest first, -1 for none) and squared distances met by a greedy beam search.

    All queries advance together: each expands its nearest unexpanded beam member until none
    is left. The beam keeps its members' expansion marks; duplicates are dropped by sorting.
    """
    b = len(q)
    norms = np.einsum("nd,nd->n", x, x)
    nodes = np.full((b, beam), -1, dtype=np.int64)
    dist = np.full((b, beam), np.inf, dtype=np.float32)
    done = np.ones((b, beam), dtype=bool)
    first = np.unique(entry)[:beam]
    start = np.tile(first, (b, 1))
    d0 = _distances(x, norms, q, start)
    order = np.argsort(d0, axis=1)
    nodes[:, : len(first)] = np.take_along_axis(start, order, 1)
    dist[:, : len(first)] = np.take_along_axis(d0, order, 1)
    done[:, : len(first)] = False
    active = np.arange(b)
    while len(active):
        open_ = ~done[active]
        has = open_.any(axis=1)
        active, open_ = active[has], open_[has]
        if not len(active):
            break
        at = open_.argmax(axis=1)
        done[active, at] = True
        near = graph[nodes[active, at]]
        seen = (near[:, :, None] == nodes[active][:, None, :]).any(axis=2)
        near = np.where(seen, -1, near)
        d = _distances(x, norms, q[active], near)
        all_nodes = np.concatenate([nodes[active], near], axis=1)
        all_dist = np.concatenate([dist[active], d], axis=1)
        all_done = np.concatenate([done[active], near < 0], axis=1)
        keep = np.argsort(all_dist, axis=1, kind="stable")[:, :beam]
        nodes[active] = np.take_along_axis(all_nodes, keep, 1)
        dist[active] = np.take_along_axis(all_dist, keep, 1)
        done[active] = np.take_along_axis(all_done, keep, 1) | ~np.isfinite(dist[active])
    return np.where(np.isfinite(dist), nodes, -1), dist


def robust_prune(x: np.ndarray, owner: np.ndarray, pool: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Of each owner's candidates (nearest first, -1 for none) at most degree diverse ones."""
    b, c = pool.shape
    p = x[np.maximum(pool, 0)]
    own = ((p - x[owner][:, None, :]) ** 2).sum(axis=2)
    own[(pool < 0) | (pool == owner[:, None])] = np.inf
    order = np.argsort(own, axis=1, kind="stable")
    pool, own = np.take_along_axis(pool, order, 1), np.take_along_axis(own, order, 1)
    p = np.take_along_axis(p, order[:, :, None], 1)
    sq = np.einsum("bcd,bcd->bc", p, p)
    between = sq[:, :, None] + sq[:, None, :] - 2 * p @ p.transpose(0, 2, 1)
    alive = np.isfinite(own)
    alive[:, 1:] &= pool[:, 1:] != pool[:, :-1]  # equal candidates stand together
    out = np.full((b, degree), -1, dtype=np.int64)
    filled = np.zeros(b, dtype=np.int64)
    relax = np.float32(alpha * alpha)
    for i in range(c):
        take = alive[:, i] & (filled < degree)
        rows = np.flatnonzero(take)
        if not len(rows):
            continue
        out[rows, filled[rows]] = pool[rows, i]
        filled[rows] += 1
        alive[rows, i:] &= relax * between[rows, i, i:] > own[rows, i:]
        alive[rows, i] = False
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA) -> tuple[np.ndarray, np.ndarray]:
    """Neighbour lists (-1 for none) and entry nodes of distinct vectors x (single precision)."""
    n = len(x)
    graph = np.full((n, degree), -1, dtype=np.int64)
    middle = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.random.default_rng(7).permutation(n)
    order = np.concatenate(([middle], order[order != middle]))
    entry = order[: min(n, 16)]
    if n <= degree + 1:
        for i in range(n):
            others = np.delete(np.arange(n), i)
            graph[i, : n - 1] = others
        return graph, entry
    first = degree + 1
    for i in order[:first]:
        graph[i] = order[:first][order[:first] != i]
    batches, lo = [], first
    while lo < n:
        hi = min(n, lo + min(lo, 1024))
        batches.append(order[lo:hi])
        lo = hi
    batches += [order[lo : lo + 1024] for lo in range(0, n, 1024)]
    for batch in batches:
        found, _ = beam_search(x, graph, entry, x[batch], beam)
        pool = np.concatenate([found, graph[batch]], axis=1)
        for a in range(0, len(batch), 256):
            graph[batch[a : a + 256]] = robust_prune(x, batch[a : a + 256], pool[a : a + 256], degree, alpha)
        _add_reverse(x, graph, batch, degree, alpha)
    return graph, entry


def _add_reverse(x: np.ndarray, graph: np.ndarray, batch: np.ndarray, degree: int, alpha: float) -> None:
    to = graph[batch].reshape(-1)
    source = np.repeat(batch, degree)
    source, to = source[to >= 0], to[to >= 0]
    order = np.argsort(to, kind="stable")
    source, to = source[order], to[order]
    targets, begin, count = np.unique(to, return_index=True, return_counts=True)
    width = int(count.max()) if len(count) else 0
    rank = np.arange(len(to)) - np.repeat(begin, count)
    most = 2 * degree  # nearest sources first would need their distances; a pool this wide loses none below
    for lo in range(0, width, most):
        part = (rank >= lo) & (rank < lo + most)
        if not part.any():
            break
        ts, at, cs = np.unique(to[part], return_index=True, return_counts=True)
        new = np.full((len(ts), int(cs.max())), -1, dtype=np.int64)
        r = np.arange(int(part.sum())) - np.repeat(at, cs)
        new[np.repeat(np.arange(len(ts)), cs), r] = source[part]
        seen = (new[:, :, None] == graph[ts][:, None, :]).any(axis=2)
        new[seen] = -1
        free = (graph[ts] < 0).sum(axis=1)
        extra = (new >= 0).sum(axis=1)
        for a in range(0, len(ts), 256):
            t, m, f, e = ts[a : a + 256], new[a : a + 256], free[a : a + 256], extra[a : a + 256]
            easy = (e <= f) & (e > 0)
            for k in np.flatnonzero(easy).tolist():
                row = graph[t[k]]
                row[np.flatnonzero(row < 0)[: e[k]]] = m[k][m[k] >= 0]
            hard = e > f
            if hard.any():
                pool = np.concatenate([graph[t[hard]], m[hard]], axis=1)
                graph[t[hard]] = robust_prune(x, t[hard], pool, degree, alpha)
    return


def _matrix(lists: pa.Array, kind: type = np.float64) -> np.ndarray:
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)


def _scaled(x: np.ndarray, middle: np.ndarray, scale: float) -> np.ndarray:
    # what lies far outside the shard keeps its direction; the answer's distances are computed anew
    return np.clip((x - middle) / scale, -1e15, 1e15).astype(np.float32)


def _frame(x: np.ndarray) -> tuple[np.ndarray, float]:
    """The mean of a shard's vectors and their largest component less the mean."""
    top = float(np.abs(x).max())
    middle = (x / top).mean(axis=0) * top
    return middle, float(np.abs(x - middle).max()) or top


def _build(table: pa.Table) -> pa.Table:
    """One shard: node, shard, dim, vec, ids -> with near (neighbour rows) and entry."""
    exact = _matrix(table.column("vec").combine_chunks())
    x = _scaled(exact, *_frame(exact))
    graph, entry = build_graph(x)
    mark = np.zeros(len(x), dtype=bool)
    mark[entry] = True
    offsets = np.arange(len(x) + 1, dtype=np.int32) * graph.shape[1]
    near = pa.ListArray.from_arrays(pa.array(offsets), pa.array(graph.astype(np.int32).reshape(-1)))
    return pa.table({
        "dim": table.column("dim"), "shard": table.column("shard"), "row": pa.array(np.arange(len(x)), pa.int32()),
        "vec": table.column("vec"), "ids": table.column("ids"), "near": near, "entry": pa.array(mark),
    })


class _Shard:
    """A graph in memory, and its answers."""

    def __init__(self, table: pa.Table) -> None:
        self.exact = _matrix(table.column("vec").combine_chunks())
        self.frame = _frame(self.exact)
        self.x = _scaled(self.exact, *self.frame)
        self.graph = _matrix(table.column("near").combine_chunks(), np.int32)
        self.entry = np.flatnonzero(table.column("entry").to_numpy())
        self.ids = table.column("ids").to_pylist()

    def answer(self, own: list, q: np.ndarray, k: int, beam: int) -> tuple[list, list, list]:
        """Query ids, vector ids and exact distances of the k nearest met by each query."""
        out: tuple[list, list, list] = ([], [], [])
        for lo in range(0, len(q), 512):
            mine = q[lo : lo + 512]
            nodes, _ = beam_search(self.x, self.graph, self.entry, _scaled(mine, *self.frame), beam)
            for i, row in enumerate(nodes):
                row = row[row >= 0]
                d = np.sqrt(((self.exact[row] - mine[i]) ** 2).sum(axis=1))
                me, best = own[lo + i], {}
                for j in np.argsort(d, kind="stable").tolist():
                    far = float(d[j])
                    if len(best) >= k and far > sorted(best.values())[k - 1]:
                        break
                    for v in self.ids[row[j]]:
                        if v != me and far < best.get(v, np.inf):
                            best[v] = far
                nearest_ = sorted((s, v) for v, s in best.items())[:k]
                out[0].extend([me] * len(nearest_))
                out[1].extend(v for _, v in nearest_)
                out[2].extend(s for s, _ in nearest_)
        return out


def _search(k: int, beam: int):
    """Rows sorted by dim and shard, nodes (by row) before queries: answers as query_id, vec_id, score."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            dim, no = batch.column("dim").to_numpy(), batch.column("shard").to_numpy()
            asks = batch.column("row").is_null().to_numpy(zero_copy_only=False)
            change = np.flatnonzero((dim[1:] != dim[:-1]) | (no[1:] != no[:-1]) | (asks[1:] != asks[:-1])) + 1
            bounds = [0, *change.tolist(), len(dim)]
            for a, b in zip(bounds[:-1], bounds[1:]):
                if (mine := (int(dim[a]), int(no[a]))) != key:
                    key, parts, shard = mine, [], None
                piece = batch.slice(a, b - a)
                if not asks[a]:
                    parts.append(piece)
                    continue
                if shard is None and parts:
                    shard, parts = _Shard(pa.Table.from_batches(parts)), []
                if shard is not None:
                    found = shard.answer(piece.column("query_id").to_pylist(), _matrix(piece.column("vec")), k, beam)
                    kind = batch.schema.field("query_id").type
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(found[0], kind), pa.array(found[1], kind), pa.array(found[2], pa.float64())], names=["query_id", "vec_id", "score"]
                    )

    return work


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    doubles = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    return (
        vectors.select(F.col(id_col).alias("vec_id"), doubles.alias("vec"))
        .where(F.col("vec_id").isNotNull() & F.col("vec").isNotNull())
        .where(F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
        .where(F.exists("vec", lambda v: v != 0))
        # -0.0 and 0.0 are one value
        .withColumn("vec", F.transform("vec", lambda v: v + F.lit(0.0)))
    )


def nearest(
    spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM,
    id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of each row of queries(id, vector)."""
    ws = Workspace(spark, "ann")
    good = usable(vectors, id_col, vec_col).distinct()
    kind = ids_type(good, "vec_id")
    # row_number() <= k is limited in each task before the shuffle: a group of copies stays small
    by_vector = Window.partitionBy("vec").orderBy("vec_id")
    few = good.withColumn("_r", F.row_number().over(by_vector)).where(F.col("_r") <= k + 1)
    distinct = ws.save(few.groupBy("vec").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")), "nodes")
    size = distinct.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("dim")).first()
    widest = max(1, SHARD_BYTES // (4 * (size["dim"] or 1)))
    rows = min(max(shard_rows, -(-size["n"] // SHARDS_MOST)), max(shard_rows, widest))
    shards = max(1, -(-size["n"] // rows))
    dealt = distinct.select(
        F.size("vec").alias("dim"), F.pmod(F.xxhash64("vec"), F.lit(shards)).cast("int").alias("shard"), "vec", "ids"
    )
    graphs = ws.save(
        dealt.repartition(min(2 * shards, TASKS_MOST), "dim", "shard").groupBy("dim", "shard").applyInArrow(
            _build, f"dim int, shard int, row int, vec array<double>, ids array<{kind}>, near array<int>, entry boolean"
        ),
        "graphs",
    )
    ws.drop("nodes")
    # the stated queries against all rows: every query goes to every shard, every graph to one task
    asked = usable(queries, id_col, vec_col).distinct().select(
        F.size("vec").alias("dim"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
        F.col("vec_id").alias("query_id"), "vec",
    )
    columns = ["dim", "shard", "row", "query_id", "vec", "ids", "near", "entry"]
    both = graphs.withColumn("query_id", F.lit(None).cast(kind)).select(*columns).unionAll(
        asked.select("dim", "shard", F.lit(None).cast("int").alias("row"), "query_id", "vec", F.lit(None).cast(f"array<{kind}>").alias("ids"),
                     F.lit(None).cast("array<int>").alias("near"), F.lit(None).cast("boolean").alias("entry"))
    )
    laid = both.repartition(min(2 * shards, TASKS_MOST), "dim", "shard").sortWithinPartitions("dim", "shard", F.col("row").asc_nulls_last())
    found = laid.mapInArrow(_search(k, beam), f"query_id {kind}, vec_id {kind}, score double")
    nearest_first = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def ann_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(spark, vectors, vectors.where(F.col("vec_id") % 100 == 0))
