"""Exact top-k by inner product: columnar branch and bound.

Vectors are packed into blocks in vertical layout (one row of a block per
dimension). For a query, scores are accumulated a few dimensions at a time over
a whole block; after each step only candidates are kept whose score so far plus
the greatest possible rest (the product of the remaining norms) can still reach
the query's k-th best score.
"""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import map_arrow, materialise

#: Vectors to a block of candidates, and of queries.
CANDIDATES, QUERIES = 8192, 2048
#: Dimensions added at a time.
STEP = 16
#: Query blocks whose best scores a task holds at once.
HELD = 64

_PACKED = "block long, dim int, wide boolean, ids binary, data binary"


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """``(id, q)``: floor(scale * x) per component, for rows with an id and a finite vector."""
    fine = F.forall(vector_col, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & fine).select(F.col(id_col).alias("id"), F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("q"))


def pack(vectors: DataFrame, size: int) -> DataFrame:
    """Blocks of up to ``size`` vectors of one length, packed where the rows are: no shuffle."""

    def run(batches):
        from pyspark import TaskContext

        place, serial = TaskContext.get().partitionId(), 0
        open_blocks: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def emit(dim):
            nonlocal serial
            ids = np.concatenate([x for x, _ in open_blocks[dim]])
            data = np.concatenate([x for _, x in open_blocks.pop(dim)]).T
            wide = bool(data.size) and int(max(data.max(), -int(data.min()))) >= 1 << 31
            serial += 1
            row = [[place * (1 << 32) + serial], [dim], [wide], [ids.tobytes()], [np.ascontiguousarray(data, dtype=np.int64 if wide else np.int32).tobytes()]]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()), strict=True)], ["block", "dim", "wide", "ids", "data"])

        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            lists = batch.column(1)
            starts, flat = lists.offsets.to_numpy(), lists.values.to_numpy(zero_copy_only=False)
            dims = np.diff(starts)
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                data = flat[starts[rows][:, None] + np.arange(dim)].reshape(len(rows), dim)
                for at in range(0, len(rows), size):
                    held = open_blocks.setdefault(int(dim), [])
                    held.append((ids[rows[at : at + size]], data[at : at + size]))
                    if sum(len(x) for x, _ in held) >= size:
                        yield emit(int(dim))
        for dim in list(open_blocks):
            yield emit(dim)

    return map_arrow(vectors, run, _PACKED)


class Block:
    def __init__(self, dim: int, wide: bool, ids: bytes, data: bytes):
        self.ids = np.frombuffer(ids, dtype=np.int64)
        raw = np.frombuffer(data, dtype=np.int64 if wide else np.int32).reshape(dim, len(self.ids))
        self.raw, self.most = raw, int(max(raw.max(), -int(raw.min()))) if raw.size else 0
        self.data = raw.astype(np.float64)
        # Norm of what is left from each step on.
        squares = np.square(self.data)
        self.rest = np.array([np.sqrt(squares[at:].sum(axis=0)) for at in range(0, dim + STEP, STEP)])


class Best:
    """The k best scores so far for each query of a block."""

    def __init__(self, queries: Block, k: int):
        self.queries, self.k = queries, k
        self.found: list[tuple[np.ndarray, np.ndarray]] = [(np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))] * len(queries.ids)

    def offer(self, at: int, scores: np.ndarray, ids: np.ndarray) -> None:
        s, i = np.concatenate([self.found[at][0], scores]), np.concatenate([self.found[at][1], ids])
        order = np.lexsort((i, np.invert(s)))[: self.k]  # inverted, as -(-2**63) does not exist
        self.found[at] = (s[order], i[order])

    def floor(self, at: int) -> float:
        scores = self.found[at][0]
        return float(scores[-1]) if len(scores) == self.k else -np.inf

    def rows(self) -> pa.RecordBatch:
        n = [len(i) for _, i in self.found]
        s, i = (np.concatenate([f[j] for f in self.found]) for j in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.queries.ids, n)), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])


#: Scores are cut to the range of 64 bits.
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def _exact(vector: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Inner products in integers of any size, cut to 64 bits."""
    if not len(vector):
        return np.zeros(columns.shape[1], dtype=np.int64)
    return np.array([min(max(int(x), LOW), HIGH) for x in vector.astype(object) @ columns.astype(object)], dtype=np.int64)


def search(best: Best, block: Block) -> None:
    """Offer ``block`` to all queries of ``best``.

    Bounds are in floating point. Scores are whole numbers, so a slack of a half
    makes up for rounding while all sums are below 2**52; beyond, the slack
    follows the norms, and the scores of what survives are added up in integers.
    """
    queries, dim, k = best.queries, block.data.shape[0], best.k
    wide = queries.most * block.most * max(dim, 1) >= 1 << 52
    # One dimension step for a group of queries is one product of two narrow matrices.
    for at in range(0, len(queries.ids), 64):
        first = queries.data[:STEP, at : at + 64].T @ block.data[:STEP]
        for j in range(first.shape[0]):
            q = at + j
            vector, qid = queries.data[:, q], queries.ids[q]
            slack = 0.5 + (dim + 4) * 2.0**-50 * queries.rest[0, q] * block.rest[0] if wide else np.full(len(block.ids), 0.5)
            partial = first[j]
            floor = best.floor(q)
            if floor == -np.inf:
                # No bound yet: score the most promising fully, to have one.
                n = min(len(partial), 16 * k)
                lead = np.argpartition(-partial, n - 1)[:n] if n else np.empty(0, dtype=np.int64)
                lead = lead[block.ids[lead] != qid]
                scores = np.sort(vector @ block.data[:, lead] - slack[lead])[::-1]
                floor = float(scores[k - 1]) if len(scores) >= k else -np.inf
            # Beyond 64 bits all scores are alike.
            floor = -np.inf if floor <= LOW else min(floor, float(HIGH))
            alive = np.flatnonzero(partial + queries.rest[1 if dim else 0, q] * block.rest[1 if dim else 0] >= floor - slack)
            partial = partial[alive]
            for step, d in enumerate(range(STEP, dim, STEP), 2):
                partial = partial + vector[d : d + STEP] @ block.data[d : d + STEP, alive]
                fits = partial + queries.rest[step, q] * block.rest[step, alive] >= floor - slack[alive]
                alive, partial = alive[fits], partial[fits]
            other = block.ids[alive] != qid
            alive = alive[other]
            scores = _exact(queries.raw[:, q], block.raw[:, alive]) if wide else np.rint(partial[other]).astype(np.int64)
            best.offer(q, scores, block.ids[alive])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """Each query's ``k`` highest inner products: ``(query_id, rank, vec_id, score)``.

    Components are taken as floor(scale * x). Candidates are all rows of
    ``vectors`` but those with the query's id, and only those of the query's
    length; ties go to the smaller id. Null vectors, vectors that hold nulls,
    NaN or infinities, and null ids take no part. A query id that repeats is
    one query (its least vector); candidates that repeat each count. Vectors may
    be of any length, extra columns are not read. An empty side gives an empty
    result. Scores beyond 64 bits are cut to the range.
    """
    spark = vectors.sparkSession
    asked = quantised(queries, id_col, vector_col, scale).groupBy("id").agg(F.min("q").alias("q"))
    n_queries = queries.filter(F.col(id_col).isNotNull()).count()
    blocks = max(1, -(-n_queries // QUERIES))
    query_blocks = pack(asked.repartition(blocks, "id"), QUERIES)
    packed = materialise(pack(quantised(vectors, id_col, vector_col, scale), CANDIDATES), "vectors")
    # Every query block meets every candidate block once, on a grid of tasks. Query blocks are
    # copied to each of its columns and candidate blocks to each of its rows; the grid's shape
    # makes the copies of both about equal.
    held_blocks, tasks = packed.count(), 4 * spark.sparkContext.defaultParallelism
    columns = max(1, min(held_blocks, tasks, round((tasks * held_blocks * CANDIDATES / (blocks * QUERIES)) ** 0.5)))
    lines = max(1, min(blocks, tasks // columns))
    place = lambda block, n: F.pmod(F.xxhash64(block), F.lit(n)).cast("int")
    copies = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packed.withColumn("column", place("block", columns)).withColumn("line", copies(lines))
    right = query_blocks.withColumn("line", place("block", lines)).withColumn("column", copies(columns)).select("line", "column", "dim", *[F.col(c).alias(f"q_{c}") for c in ("block", "wide", "ids", "data")])

    def run(batches):
        held: OrderedDict[int, Best] = OrderedDict()
        last, block = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                at, dim, wide, ids, data, qat, qwide, qids, qdata = (batch.column(c)[i] for c in range(9))
                if qat.as_py() in held:
                    held.move_to_end(qat.as_py())
                else:
                    if len(held) >= HELD:
                        yield held.popitem(last=False)[1].rows()
                    held[qat.as_py()] = Best(Block(dim.as_py(), qwide.as_py(), qids.as_py(), qdata.as_py()), k)
                if last != at.as_py():
                    last, block = at.as_py(), Block(dim.as_py(), wide.as_py(), ids.as_py(), data.as_py())
                search(held[qat.as_py()], block)
        for best in held.values():
            yield best.rows()

    grid = left.join(right.hint("merge"), ["line", "column", "dim"]).select("block", "dim", "wide", "ids", "data", "q_block", "q_wide", "q_ids", "q_data")
    local = map_arrow(grid, run, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
