"""Exact top-k by inner product with distributed histogram selection.

Queries go through in blocks. For a block, every task scores all of its candidates and
returns a histogram of the scores per query; the merged histogram shows in which bin a
query's kth score lies, and the next round cuts that bin again until it holds a single
value. A last pass keeps what lies above the kth score and, of the scores equal to it,
the k least ids of each task. No task or query ever holds more than counts and k rows.
"""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from casewright.llm.common import table
from casewright.session import cut_lineage

K = 5
SCALE = 256
QUERY_STEP = 50
#: Queries of a block, at most: 1024 x 64 components are half a megabyte.
BLOCK = 1024
#: Bins per round.
BINS = 512
#: Candidates that a task scores at once.
ROWS = 1024
#: Products and their sums stay exact in double arithmetic below this.
EXACT = 2.0 ** 53
_LONG = 2 ** 63


def whole_vectors(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): components as doubles; vectors that are null or hold a null or
    non-finite component are left out, and so are rows without an id."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def whole_numbers(x: np.ndarray) -> np.ndarray:
    """floor(256 x), as doubles, which hold it exactly, or as numbers of Python where it exceeds them."""
    if np.abs(x).max(initial=0) < 2.0 ** 1000:
        return np.floor(x * SCALE)
    return np.array([int(c) * SCALE if abs(c) >= 2 ** 53 else int(np.floor(c * SCALE)) for c in x.tolist()], dtype=object)


def _matrix(column: pa.ListArray) -> list[np.ndarray]:
    offsets, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return [whole_numbers(values[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def scores(queries: list[np.ndarray], rows: list[np.ndarray]) -> np.ndarray:
    """Integer inner products, queries x rows. A vector of another length is taken as
    filled up with zeros. Where doubles might round, whole numbers of Python are used,
    and a score outside a long becomes the nearest long."""
    width = max(len(v) for v in (*queries, *rows))
    q, r = (np.stack([np.pad(v, (0, width - len(v))) for v in part]) for part in (queries, rows))
    doubles = q.dtype != object and r.dtype != object
    if doubles and np.abs(q).max(initial=0) * np.abs(r).max(initial=0) * max(width, 1) < EXACT:
        return (q @ r.T).astype(np.int64)
    big = np.vectorize(int, otypes=[object])
    return np.clip(big(q) @ big(r).T, -_LONG, _LONG - 1).astype(np.int64)


def _scored(parts, ids: np.ndarray, queries: list[np.ndarray]):
    """(vec_ids, scores, is another row) of a task's candidates, some rows at a time."""
    for part in parts:
        for at in range(0, part.num_rows, ROWS):
            some = part.slice(at, ROWS)
            if some.num_rows:
                own = some["vec_id"].to_numpy()
                yield own, scores(queries, _matrix(some["v"])), own != ids[:, None]


def _bins(low: int, high: int) -> int:
    """Width of a bin for scores from ``low`` to ``high``; a power of two."""
    return 1 << max(0, ((high - low) // BINS).bit_length())


def _range_of(block_ids: np.ndarray, queries: list[np.ndarray]):
    def least_and_most(parts):
        low, high = np.full(len(queries), _LONG - 1), np.full(len(queries), -_LONG)
        count = np.zeros(len(queries), np.int64)
        for _, s, other in _scored(parts, block_ids, queries):
            low = np.minimum(low, np.where(other, s, _LONG - 1).min(1))
            high = np.maximum(high, np.where(other, s, -_LONG).max(1))
            count += other.sum(1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(queries))), pa.array(low), pa.array(high), pa.array(count)],
                                         names=["q", "low", "high", "n"])
    return least_and_most


def _histogram(block_ids: np.ndarray, queries: list[np.ndarray], low: np.ndarray, high: np.ndarray):
    widths = [_bins(int(a), int(b)) for a, b in zip(low, high, strict=True)]
    shift = np.array([w.bit_length() - 1 for w in widths])[:, None]

    def counted(parts):
        counts = np.zeros((len(queries), BINS + 1), np.int64)
        base = np.arange(len(queries))[:, None] * (BINS + 1)
        for _, s, other in _scored(parts, block_ids, queries):
            inside = other & (s >= low[:, None]) & (s <= high[:, None])
            # Unsigned: the distance of two longs may not fit a long.
            distance = (s.astype(np.uint64) - low[:, None].astype(np.uint64)) >> shift.astype(np.uint64)
            at = (base + np.minimum(distance, np.uint64(BINS)).astype(np.int64))[inside]
            counts += np.bincount(at, minlength=counts.size).reshape(counts.shape)
        q, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(counts[q, b])], names=["q", "bin", "n"])
    return counted


def kth_scores(candidates: DataFrame, ids: np.ndarray, queries: list[np.ndarray], k: int) -> np.ndarray:
    """The kth highest score of each query of a block (the least, if there are fewer).

    What comes to the driver is one number per query and round, for one block."""
    got = candidates.mapInArrow(_range_of(ids, queries), "q long, low long, high long, n long").groupBy("q").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    low, high, want = np.zeros(len(ids), np.int64), np.full(len(ids), -1), np.full(len(ids), k)
    for r in got:
        low[r.q], high[r.q], want[r.q] = r.low, r.high, min(k, r.n)
    high = np.where(want > 0, high, low)  # nothing to find
    while (low < high).any():
        bins = candidates.mapInArrow(_histogram(ids, queries, low, high), "q long, bin long, n long").groupBy("q", "bin").agg(
            F.sum("n").alias("n"))
        from_top = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")))
        wanted = F.element_at(F.array(*(F.lit(int(w)) for w in want)), F.col("q").cast("int") + 1)
        hit = bins.withColumn("reached", from_top).filter(
            (F.col("reached") >= wanted) & (F.col("reached") - F.col("n") < wanted)).collect()
        for r in hit:
            width = _bins(int(low[r.q]), int(high[r.q]))
            begin = int(low[r.q]) + r.bin * width
            want[r.q] -= r.reached - r.n
            low[r.q], high[r.q] = begin, min(int(high[r.q]), begin + width - 1)
    return low


def _selected(block_ids: np.ndarray, queries: list[np.ndarray], kth: np.ndarray, k: int):
    def picked(parts):
        equal: list[list[int]] = [[] for _ in queries]
        for own, s, other in _scored(parts, block_ids, queries):
            q, r = np.nonzero(other & (s > kth[:, None]))
            yield pa.RecordBatch.from_arrays([pa.array(block_ids[q]), pa.array(own[r]), pa.array(s[q, r])],
                                             names=["query_id", "vec_id", "score"])
            q, r = np.nonzero(other & (s == kth[:, None]))
            for query in np.unique(q):
                new = own[r[q == query]]
                equal[query] = sorted([*equal[query], *np.partition(new, min(k, len(new)) - 1)[:k].tolist()])[:k]
        rows = [(block_ids[q], v, kth[q]) for q, some in enumerate(equal) for v in some]
        columns = list(zip(*rows, strict=True)) or [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "vec_id", "score"])
    return picked


def topk(vectors: DataFrame, k: int = K, step: int = QUERY_STEP, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score of the k best candidates of each query.

    Rows whose id is divisible by ``step`` are queries, against all other rows; rows of
    one id are each other's own. Ties go to the smaller id. A repeated query row is one
    query if its vector is equal; of different vectors of one id the first in order counts.
    Products are exact at any size; a score that no long holds counts as the nearest long,
    so such scores tie.
    """
    spark = vectors.sparkSession
    all_rows = cut_lineage(whole_vectors(vectors))
    asked = all_rows.filter(F.col("vec_id") % step == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    found = []
    rows = asked.orderBy("vec_id").toLocalIterator()
    while some := list(islice(rows, block)):
        ids = np.array([r.vec_id for r in some], np.int64)
        queries = [whole_numbers(np.array(r.v, float)) for r in some]
        kth = kth_scores(all_rows, ids, queries, k)
        near = all_rows.mapInArrow(_selected(ids, queries, kth, k), "query_id long, vec_id long, score long")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        found.append(cut_lineage(near.withColumn("rank", rank).filter(F.col("rank") <= k)))
    result = spark.createDataFrame([], "query_id long, vec_id long, score long, rank int")
    for part in found:
        result = result.union(part)
    return result.select("query_id", "rank", "vec_id", "score")


def op7_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best other vectors of every vector whose id is divisible by 50."""
    return topk(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
             list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2]))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
