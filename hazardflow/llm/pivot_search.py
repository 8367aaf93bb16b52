"""Exact top-k search by inner product with elimination over a pivot table.

Vectors are lifted by one coordinate to equal length, so that a larger inner product is a smaller distance. The
distances of every vector to ``PIVOTS`` pivots are computed once. For a query, the largest difference of pivot distances is
a lower bound of its distance to a vector, hence an upper bound of the inner product. Candidates are evaluated in the
order of their bounds until the next bound is below the k-th score found: no later one can enter the result.

The query set meets all vectors in blocks: blocks of queries visit every block of vectors, each pair of blocks gives the
k best per query, and these are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from hazardflow.llm.storage import stored

SCALE = 256
TOP = 5
PIVOTS = 32
# The pivots are taken from this many vectors, the least by a hash; any choice of pivots gives the same result.
PIVOT_SAMPLE = 512
BLOCK_VECTORS = 8192
BLOCK_QUERIES = 256
SLACK = 1e-3  # far above the rounding of bounds, below the step of integer scores


def whole_vectors(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id, x``: components as ``floor(256 * x)``; rows with nulls or non-finite components are left out."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    chosen = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    kept = chosen.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
    return kept.select("vec_id", F.transform("x", lambda x: F.floor(SCALE * x).cast("double")).alias("x"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Rows as a matrix; shorter vectors are filled with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dims).all():
        return flat.reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def choose_pivots(x: np.ndarray, n: int) -> np.ndarray:
    """Row numbers of up to ``n`` distinct vectors, each far from those chosen before."""
    chosen, far = [0], ((x - x[0]) ** 2).sum(axis=1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


class PivotTable:
    """The pivots, lifted; small and of fixed size, sent with the tasks."""

    def __init__(self, ids: np.ndarray, pivots: np.ndarray, radius: float):
        self.ids, self.pivots, self.radius = ids, pivots, radius  # radius: largest squared length

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(self.radius - (x * x).sum(axis=1), 0.0))

    def distances(self, x: np.ndarray, query: bool = False) -> np.ndarray:
        """Distances to the pivots after the lift; a query's own extra coordinate is 0."""
        height = np.zeros(len(x)) if query else self.lifted(x)
        flat = (x * x).sum(axis=1)[:, None] + (self.pivots**2).sum(axis=1) - 2 * (x @ self.pivots.T)
        return np.sqrt(np.maximum(flat + (height[:, None] - self.lifted(self.pivots)) ** 2, 0.0))


def best(
    queries: np.ndarray, query_ids: np.ndarray, query_d: np.ndarray, floors: np.ndarray,
    x: np.ndarray, ids: np.ndarray, d: np.ndarray, radius: float, top: int,
) -> tuple[list[tuple[int, int, int]], int]:
    """``(query, vector, score)`` of each query's best in this block, and how many inner products it took.

    ``floors`` are scores that the query's k-th best surely reaches.
    """
    gap = np.zeros((len(queries), len(x)))
    for p in range(d.shape[1]):
        np.maximum(gap, np.abs(query_d[:, p, None] - d[:, p]), out=gap)
    bound = np.floor(((queries * queries).sum(axis=1)[:, None] + radius - gap * gap) / 2 + SLACK)
    bound[query_ids[:, None] == ids] = -np.inf
    found, work = [], 0
    for q in range(len(queries)):
        near = np.flatnonzero(bound[q] >= floors[q])
        near = near[np.argsort(-bound[q, near], kind="stable")]
        scores, rows = np.empty(0), np.empty(0, dtype=np.int64)
        begin, step, limit = 0, 64, floors[q]
        while begin < len(near) and bound[q, near[begin]] >= limit and bound[q, near[begin]] > -np.inf:
            some = near[begin : begin + step]
            some = some[(bound[q, some] >= limit) & (bound[q, some] > -np.inf)]
            work += len(some)
            scores, rows = np.concatenate([scores, x[some] @ queries[q]]), np.concatenate([rows, some])
            order = np.lexsort((ids[rows], -scores))[:top]
            scores, rows = scores[order], rows[order]
            if len(scores) == top:
                limit = max(limit, scores[-1])
            begin, step = begin + step, 2 * step
        found += [(int(query_ids[q]), int(ids[r]), int(s)) for r, s in zip(rows, scores)]
    return found, work


PACKED = "part int, role int, ids binary, x binary, d binary, floors binary"


def _packed(rows: DataFrame, table: PivotTable, dims: int, size: int, top: int, query: bool) -> DataFrame:
    """Blocks of up to ``size`` vectors with their pivot distances; queries also get their floors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                piece = batch.slice(at, size)
                ids = piece.column("vec_id").to_numpy().astype(np.int64)
                x = _matrix(piece.column("x"), dims)
                floors = np.full(len(ids), -np.inf)
                if query and len(table.ids) > top:  # pivots are vectors too: their scores are reached
                    own = np.where(ids[:, None] == table.ids, -np.inf, x @ table.pivots.T)
                    floors = -np.sort(-own, axis=1)[:, top - 1]
                blobs = (ids, x, table.distances(x, query), floors)
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array([int(piece.column("part")[0].as_py())], pa.int32()), "role": pa.array([int(query)], pa.int32())}
                    | {k: pa.array([b.tobytes()], pa.binary()) for k, b in zip(("ids", "x", "d", "floors"), blobs)}
                )

    return rows.mapInArrow(run, PACKED)


def top_k(
    vectors: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", top: int = TOP,
    pivots: int = PIVOTS, block: int = BLOCK_VECTORS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``top`` largest inner products of every query row, ties to smaller ids.

    ``is_query`` is a condition on ``vec_id``. Candidates are all rows whose id is not the query's. Rows without an id
    or with null or non-finite components take no part; shorter vectors count as filled with zeros; a query id that occurs
    on several rows is one query with the first of their vectors. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = stored(whole_vectors(vectors, id_col, vector_col), "vectors")
    norm = F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)
    n, dims, radius = rows.agg(F.count("*"), F.max(F.size("x")), F.max(norm)).first()
    if not n or not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    sample = rows.dropDuplicates(["vec_id"]).orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOT_SAMPLE).toArrow().combine_chunks()
    some = _matrix(sample.column("x").chunk(0), dims)
    chosen = choose_pivots(some, pivots)
    table = PivotTable(sample.column("vec_id").to_numpy()[chosen], some[chosen], radius)

    parts = max(1, -(-n // block))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", "x"), F.lit(parts)).cast("int"))
    # All vectors of a part come to one task, in the order of parts.
    by_part = dealt.repartition(parts, "part").sortWithinPartitions("part")
    queries = rows.where(is_query).groupBy("vec_id").agg(F.min("x").alias("x"))
    query_parts = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    query_blocks = _packed(queries.withColumn("part", F.lit(0)), table, dims, BLOCK_QUERIES, top, True)
    visits = query_blocks.select(query_parts, *[c for c in query_blocks.columns if c != "part"])

    def by_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cut sorted batches where the part changes, so that a block holds rows of one part."""
        for batch in batches:
            part = batch.column("part").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)]
            yield from (batch.slice(a, b - a) for a, b in zip(edges, edges[1:]) if b > a)

    blocks = by_part.mapInArrow(by_runs, "vec_id long, x array<double>, part int")
    packed = _packed(blocks, table, dims, block, top, False)
    # Blocks of a part (role 0) come before the queries that visit them (role 1).
    meeting = packed.unionByName(visits).repartition(parts, "part").sortWithinPartitions("part", "role")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held = None, []
        for batch in batches:
            found: list[tuple[int, int, int]] = []
            for row in batch.to_pylist():
                ids = np.frombuffer(row["ids"], dtype=np.int64)
                x = np.frombuffer(row["x"]).reshape(len(ids), dims)
                d = np.frombuffer(row["d"]).reshape(len(ids), -1)
                if row["part"] != here:
                    here, held = row["part"], []
                if row["role"] == 0:
                    held.append((x, ids, d))
                    continue
                floors = np.frombuffer(row["floors"])
                for vectors_ in held:
                    found += best(x, ids, d, floors, *vectors_, table.radius, top)[0]
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in zip(*found)], ["query_id", "vec_id", "score"]
                )

    candidates = meeting.mapInArrow(run, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = candidates.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.x, c.x)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
