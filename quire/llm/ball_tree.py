"""Exact top-k search by inner product with a ball tree per shard.

Vectors become integers floor(256 x). A tree of planes, grown from a bounded
sample of ``SAMPLE`` vectors, deals the rows to cells of neighbours; each cell has
a centre, the largest distance from it (its ball) and one or more shards. For a
ball with centre c and radius r no vector scores above q.c + |q| r. Every task
builds a ball tree over its shard and takes the queries in batches: descending
the tree drops nodes whose bound is below the query's current k-th score, and
leaves are visited in falling order of their bounds.

The current k-th score is shared in three passes: a query first searches one
shard of its most promising cell, then its best ``NEAR_CELLS`` cells, then only
those cells whose bound still reaches its k-th score. Queries are sent to no
other shard. Shards grow with the table, up to ``SHARD_BYTES``, so a query meets
about a thousand shards at most before any is dropped, whatever the table.

Scores are exact: they are computed in doubles where every sum stays below 2^53
and in Python integers otherwise, bounds carry a margin for rounding, and a cell
or node with a bound equal to the k-th score is searched.

Defined results: null vectors and those with null or non-finite components take
no part, nor do rows without an id; rows are rows: of several with one id each is
a candidate, also for the others, and a query if the id is one; vectors of
unequal length are compared as if padded by zeros; components beyond 64 bits
count as the nearest such integer, and so do scores; with fewer than k candidates
all are returned. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quire.llm.recovery import checkpointed

SAMPLE = 4096
SAMPLE_NUMBERS = 8_000_000  # the sample has fewer vectors where they are long
MOST_CELLS, LEAST_CELLS = 256, 16
NEAR_CELLS = 3
SHARD_ROWS, SHARDS = 4096, 1024
SHARD_BYTES = 64 << 20
LEAF_ROWS = 64
QUERY_ROWS = 1024
K = 5
SCALE = 256
_LONG = (1 << 63) - 1
_NONE = np.iinfo(np.int64).max


class BallTree:
    """Nodes over a shard's vectors; leaves hold contiguous rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, rows: np.ndarray | None = None):
        self.order = np.arange(len(ids))
        self.points = vectors.astype(np.float64)
        self.nodes: list[tuple[np.ndarray, float, int, int, int, int]] = []  # centre, radius, smallest id, children, or -1 and rows
        self.leaves: list[tuple[int, int]] = []
        self.ids = ids
        self._build(0, len(ids))
        self.ids, self.vectors = ids[self.order], vectors[self.order]
        self.rows = self.ids if rows is None else rows[self.order]

    def _build(self, a: int, b: int) -> int:
        rows = self.points[self.order[a:b]]
        centre = rows.mean(axis=0)
        radius = float(np.sqrt(((rows - centre) ** 2).sum(axis=1).max()))
        me = len(self.nodes)
        self.nodes.append(None)
        left = right = -1
        leaf = -1
        if b - a <= LEAF_ROWS or radius == 0:
            leaf = len(self.leaves)
            self.leaves.append((a, b))
        else:
            far = rows[((rows - centre) ** 2).sum(axis=1).argmax()]
            other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
            half = (b - a) // 2
            split = np.argpartition(rows @ (other - far), half)
            self.order[a:b] = self.order[a:b][split]
            left, right = self._build(a, a + half), self._build(a + half, b)
        self.nodes[me] = (centre, radius, int(self.ids[self.order[a:b]].min()), left, right, leaf)
        return me

    def search(self, queries: np.ndarray, query_rows: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of the best k of this shard for each query, leaving out scores below ``floor`` and the query's own row."""
        m = len(queries)
        q = queries.astype(np.float64)
        length = np.sqrt((q**2).sum(axis=1))
        reach = max(float(np.abs(q).sum(axis=1).max(initial=0)) * float(np.abs(self.points).max(initial=0)), 1.0)
        exact = reach < 2.0**53
        kind = np.float64 if exact else object
        vectors, q_exact = self.vectors.astype(kind), queries.astype(kind)
        slack = 1e-9 * reach + 1e-3
        bound = np.full((m, len(self.leaves)), -np.inf)
        stack = [(0, np.arange(m))]
        floor = floor.astype(np.float64).copy()
        while stack:
            node, rows = stack.pop()
            centre, radius, _, left, right, leaf = self.nodes[node]
            top = q[rows] @ centre + length[rows] * radius + slack
            alive = top >= floor[rows]
            rows = rows[alive]
            if not len(rows):
                continue
            if leaf >= 0:
                bound[rows, leaf] = top[alive]
            else:
                stack += [(left, rows), (right, rows)]
        best = np.full((m, k), -np.inf)
        score = np.zeros((m, k), dtype=object) if not exact else best
        names = np.full((m, k), _NONE, dtype=np.int64)
        visit = np.argsort(-bound, axis=1, kind="stable")
        open_rows = np.arange(m)
        for turn in range(len(self.leaves)):
            leaf = visit[open_rows, turn]
            worth = bound[open_rows, leaf]
            keep = np.isfinite(worth) & (worth >= np.maximum(floor[open_rows], best[open_rows, -1]))
            open_rows, leaf = open_rows[keep], leaf[keep]
            if not len(open_rows):
                break
            by = np.argsort(leaf, kind="stable")
            cuts = np.flatnonzero(np.diff(leaf[by], prepend=-1, append=-1))
            for s, e in zip(cuts[:-1], cuts[1:], strict=True):
                rows = open_rows[by[s:e]]
                a, b = self.leaves[leaf[by[s]]]
                got = q_exact[rows] @ vectors[a:b].T
                near = got.astype(np.float64)
                near[query_rows[rows][:, None] == self.rows[a:b][None, :]] = -np.inf
                least = np.maximum(floor[rows], best[rows, -1])
                some = np.flatnonzero((near >= least[:, None]).any(axis=1))
                if not len(some):
                    continue
                rows, near, got = rows[some], near[some], got[some]
                all_near = np.concatenate([best[rows], near], axis=1)
                all_ids = np.concatenate([names[rows], np.broadcast_to(self.ids[a:b], near.shape)], axis=1)
                if exact:
                    pick = np.lexsort((all_ids, -all_near), axis=1)[:, :k]
                else:
                    all_got = np.concatenate([score[rows], got], axis=1)
                    pick = np.array([sorted(range(len(n)), key=lambda j: (n[j] == -np.inf, -g[j], i[j]))[:k] for n, g, i in zip(all_near, all_got, all_ids, strict=True)])
                    score[rows] = np.take_along_axis(all_got, pick, axis=1)
                best[rows] = np.take_along_axis(all_near, pick, axis=1)
                names[rows] = np.take_along_axis(all_ids, pick, axis=1)
        row, place = np.nonzero(np.isfinite(best) & (best >= floor[:, None]))
        values = score[row, place]
        return row, names[row, place], np.array([max(-_LONG - 1, min(_LONG, int(v))) for v in values], dtype=np.int64)


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    bounds = np.asarray(column.offsets).astype(np.int64)
    bounds -= bounds[0]
    values = np.asarray(column.flatten())
    sizes = np.diff(bounds)
    width = max(width, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), dtype=np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - bounds[:-1][row]] = values
    return out


def _search(k: int):
    """Rows come by shard, a shard's vectors before its queries."""

    def run(batches):
        state = {"shard": None, "parts": [], "tree": None, "width": 0}

        def ask(part: pa.RecordBatch):
            if state["tree"] is None and state["parts"]:
                ids = np.concatenate([np.asarray(p.column("vec_id")) for p in state["parts"]])
                rows = np.concatenate([np.asarray(p.column("row")) for p in state["parts"]])
                state["width"] = max(_matrix(p.column("v")).shape[1] for p in state["parts"])
                state["tree"] = BallTree(ids, np.concatenate([_matrix(p.column("v"), state["width"]) for p in state["parts"]]), rows)
                state["parts"] = []
            tree = state["tree"]
            if tree is None:
                return
            for s in range(0, part.num_rows, QUERY_ROWS):
                some = part.slice(s, QUERY_ROWS)
                q = _matrix(some.column("v"), state["width"])[:, : state["width"]]
                ids, rows = np.asarray(some.column("vec_id")), np.asarray(some.column("row"))
                row, name, score = tree.search(q, rows, _floors(some.column("floor")), k)
                yield pa.RecordBatch.from_arrays([pa.array(rows[row]), pa.array(ids[row]), pa.array(name), pa.array(score)], ["query", "query_id", "vec_id", "score"])

        for batch in batches:
            shard, kind = np.asarray(batch.column("shard")), np.asarray(batch.column("kind"))
            cuts = np.flatnonzero((np.diff(shard, prepend=shard[:1] - 1) != 0) | (np.diff(kind, prepend=-1) != 0)) if len(shard) else []
            for s, e in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                if shard[s] != state["shard"]:
                    state.update(shard=shard[s], parts=[], tree=None, width=0)
                part = batch.slice(s, e - s)
                if kind[s] == 0:
                    state["parts"].append(part)
                else:
                    yield from ask(part)

    return run


def _floors(column: pa.Array) -> np.ndarray:
    """k-th scores as doubles that are not above them; none is below everything."""
    return np.array([-np.inf if f is None else float(f) - (0 if abs(f) < 1 << 53 else abs(f) * 1e-15) for f in column.to_pylist()])


class Cells:
    """A complete binary tree of planes over a sample; its leaves are the cells."""

    def __init__(self, sample: np.ndarray, cells: int):
        self.levels = max(0, (cells - 1).bit_length())
        points = sample.astype(np.float64)
        width = points.shape[1]
        self.planes = np.zeros(((1 << self.levels) - 1, width))
        self.cuts = np.zeros((1 << self.levels) - 1)
        groups = {0: np.arange(len(points))}
        for node in range(len(self.planes)):
            own = groups.get(node, np.zeros(0, np.int64))
            if len(own) > 1:
                rows = points[own]
                far = rows[((rows - rows.mean(axis=0)) ** 2).sum(axis=1).argmax()]
                other = rows[((rows - far) ** 2).sum(axis=1).argmax()]
                self.planes[node] = other - far
                along = rows @ self.planes[node]
                self.cuts[node] = np.median(along)
                groups[2 * node + 1], groups[2 * node + 2] = own[along <= self.cuts[node]], own[along > self.cuts[node]]
        leaves = [groups.get(len(self.planes) + i, np.zeros(0, np.int64)) for i in range(1 << self.levels)]
        self.centres = np.array([points[own].mean(axis=0) if len(own) else np.zeros(width) for own in leaves])

    def of(self, vectors: np.ndarray) -> np.ndarray:
        node = np.zeros(len(vectors), dtype=np.int64)
        points = vectors.astype(np.float64)
        for _ in range(self.levels):
            node = 2 * node + 1 + ((points * self.planes[node]).sum(axis=1) > self.cuts[node])
        return node - len(self.planes)


def _fitted(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``width`` components, and the squared length of the others."""
    v = _matrix(column, width)
    return v[:, :width], (v[:, width:].astype(np.float64) ** 2).sum(axis=1)


def _placed(cells):
    def run(batches):
        own = cells.value
        for batch in batches:
            v, more = _fitted(batch.column("v"), own.centres.shape[1])
            cell = own.of(v)
            away = np.sqrt(((v.astype(np.float64) - own.centres[cell]) ** 2).sum(axis=1) + more)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(away)], [*batch.schema.names, "cell", "away"])

    return run


def _wanted(balls):
    """For each query and the cells it has not searched: those that its pass asks (``turn`` 0 one shard of the best, 1 the near ones, 2 all whose bound reaches the floor)."""

    def run(batches):
        centres, radius, parts, turn = balls.value
        names = np.flatnonzero(parts)
        for batch in batches:
            v, more = _fitted(batch.column("v"), centres.shape[1])
            q = v.astype(np.float64)
            length = np.sqrt((q**2).sum(axis=1) + more)
            reach = length[:, None] * (np.sqrt((centres[names] ** 2).sum(axis=1)) + radius[names])[None, :]
            bound = q @ centres[names].T + length[:, None] * radius[names][None, :] + 1e-9 * reach + 1e-3
            order = np.argsort(-bound, axis=1, kind="stable")
            floors = _floors(batch.column("floor"))
            shards = []
            for i in range(len(q)):
                asked = order[i, :1] if turn == 0 else order[i, :NEAR_CELLS] if turn == 1 else order[i, NEAR_CELLS:]
                asked = names[asked[bound[i, asked] >= floors[i]]]
                if turn == 0:
                    shards.append([int(asked[0]) << 32] if len(asked) else [])
                else:
                    best = int(names[order[i, 0]]) << 32
                    shards.append([s for c in asked.tolist() for j in range(parts[c]) if (s := c << 32 | j) != best])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shards, pa.list_(pa.int64()))], [*batch.schema.names, "shards"])

    return run


def _pass(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = vectors.select("shard", F.lit(0).alias("kind"), "row", "vec_id", "v", F.lit(None).cast("long").alias("floor")).unionByName(queries.select("shard", F.lit(1).alias("kind"), "row", "vec_id", "v", "floor"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "kind")
    return rows.mapInArrow(_search(k), "query long, query_id long, vec_id long, score long")


def integers(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(row, vec_id, v) of the rows that take part; ``row`` numbers them."""
    v = F.col(vector_col).cast("array<double>")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbers = table.where(F.col(id_col).isNotNull() & v.isNotNull() & whole)
    numbers = numbers.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * SCALE).cast("long")).alias("v"))
    return checkpointed(numbers.select(F.monotonically_increasing_id().alias("row"), "vec_id", "v"))


def top_k(table: DataFrame, every: int = 50, k: int = K, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other rows for each row whose id is divisible by ``every``."""
    context = table.sparkSession.sparkContext
    numbers = integers(table, id_col, vector_col)
    n, width = numbers.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    width = max(width, 1)
    most = min(SAMPLE, max(1, SAMPLE_NUMBERS // width))
    sample = numbers.orderBy(F.xxhash64("row"), "row").limit(most).select("v").toArrow().column("v").combine_chunks()
    sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) and sample.num_chunks else sample
    shard_rows = max(1, min(max(SHARD_ROWS, n // SHARDS), SHARD_BYTES // (8 * width)))
    cells = Cells(_matrix(sample, width) if n else np.zeros((0, width), np.int64), min(MOST_CELLS, max(LEAST_CELLS, n // shard_rows)))
    placed = checkpointed(numbers.mapInArrow(_placed(context.broadcast(cells)), "row long, vec_id long, v array<long>, cell int, away double"))
    count, radius = np.zeros(1 << cells.levels, np.int64), np.zeros(1 << cells.levels)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("away").alias("r")).collect():  # at most MOST_CELLS rows
        count[r.cell], radius[r.cell] = r.n, r.r
    parts = -(-count // shard_rows)
    split = F.element_at(F.array(*(F.lit(int(max(p, 1))) for p in parts)), F.col("cell") + 1)
    sharded = placed.withColumn("shard", F.shiftleft(F.col("cell").cast("long"), 32) + F.pmod(F.xxhash64("row"), split)).select("shard", "row", "vec_id", "v")
    queries = sharded.where(F.col("vec_id") % every == 0).drop("shard").withColumn("floor", F.lit(None).cast("long"))
    by = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    best = lambda df: df.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)
    found = None
    for turn in range(3):
        if found is not None:
            floors = best(found).where(F.col("rank") == k).select(F.col("query").alias("row"), F.col("score").alias("floor"))
            queries = queries.drop("floor").join(floors, "row", "left")
        asked = queries.mapInArrow(_wanted(context.broadcast((cells.centres, radius, parts, turn))), "row long, vec_id long, v array<long>, floor long, shards array<long>")
        got = _pass(sharded, asked.select("row", "vec_id", "v", "floor", F.explode("shards").alias("shard")), k)
        found = checkpointed(got if found is None else best(found.unionByName(got)).drop("rank"))
    return best(found).select("query_id", "rank", "vec_id", "score")


#: Exact where scores stay below 2^53.
ORACLE_SQL = """
WITH v AS (SELECT row_number() OVER () AS rn, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rn, q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2]))::BIGINT AS score FROM v q JOIN v c ON q.rn <> c.rn WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rn ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
"""
