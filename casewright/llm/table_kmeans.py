"""Clustering of integer vectors whose distances are read from tables.

Components are whole numbers, and few different ones occur in a dimension. So no distance
is computed by vector arithmetic: for a batch of vectors, a table per dimension holds the
squared difference of every occurring value and every centroid, once per value, and the
distance of a vector is the sum of what its values find in the tables. Tables are made anew
in every round, when the centroids are known.

Everything is exact. Sums of clusters travel as digits to the base 2^40, which no number
of tasks can make overflow; what comes to the driver is one sum per cluster and dimension.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from casewright.llm.common import table
from casewright.session import cut_lineage

CLUSTERS = 16
COMPONENTS = 64
SCALE = 64
ROUNDS = 3
#: Vectors whose distances are looked up together.
ROWS = 2048
DIGIT_BITS = 40
#: Differences below this have squares whose sums fit a long, up to this many components.
_NARROW, _NARROW_COMPONENTS = 2 ** 27, 2 ** 9
_LONG = 2 ** 63 - 1

Centroids = list[list[int]]


def kept_vectors(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, x): vectors of exactly ``components`` components, none null or not finite."""
    x = F.transform("embedding", lambda c: c.cast("double"))
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c))
    return vectors.filter((F.size("embedding") == components) & finite).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def whole_numbers(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x), as longs, or as numbers of Python where a long is too short."""
    if np.abs(x).max(initial=0) < _LONG // scale // 2:
        return np.floor(x * scale).astype(np.int64)
    # A double this large is whole; below that the product is exact.
    return np.array([[int(c) * scale if abs(c) >= 2 ** 53 else math.floor(c * scale) for c in row] for row in x.tolist()],
                    dtype=object)


def first_centroids(kept: DataFrame, clusters: int = CLUSTERS, scale: int = SCALE) -> Centroids:
    """The vectors with the least digests of their ids, in that order. Rows of one id go by
    their components; rows without an id come last."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)
    rows = kept.orderBy(digest.asc_nulls_last(), "x").select("x").limit(clusters).collect()
    return [whole_numbers(np.array([r.x], float), scale)[0].tolist() for r in rows]


def distances(values: np.ndarray, centroids: Centroids) -> np.ndarray:
    """Squared distances, vectors x centroids, by one table per dimension."""
    target = np.array(centroids, dtype=object)
    small = lambda a: a.size == 0 or max(abs(int(a.min())), abs(int(a.max()))) < _NARROW // 2
    kind = np.int64 if small(values) and small(target) and values.shape[1] <= _NARROW_COMPONENTS else object
    target = target.astype(kind)
    result = np.zeros((len(values), len(centroids)), kind)
    for d in range(values.shape[1]):
        occurring, place = np.unique(values[:, d], return_inverse=True)
        squares = (occurring.astype(kind)[:, None] - target[:, d]) ** 2
        result += squares[place]
    return result


def _assigned(batches, centroids: Centroids, scale: int):
    """(ids, whole numbers, nearest centroid, distance) of some vectors at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            some = batch.slice(at, ROWS)
            x = some["x"].flatten().to_numpy(zero_copy_only=False).reshape(some.num_rows, -1)
            values = whole_numbers(x, scale)
            far = distances(values, centroids)
            cluster = far.argmin(1)  # the first of equal ones
            yield some["vec_id"], values, cluster, far[np.arange(len(far)), cluster]


def _digits(number: int) -> list[int]:
    """To the base 2^40, the last digit with the sign."""
    out = []
    while not -2 ** DIGIT_BITS <= number < 2 ** DIGIT_BITS:
        number, digit = divmod(number, 2 ** DIGIT_BITS)
        out.append(digit)
    return [*out, number]


def _summed(centroids: Centroids, scale: int):
    def sums(batches):
        total = np.zeros((len(centroids), len(centroids[0]) + 1), object)  # the last column counts
        for _, values, cluster, _ in _assigned(batches, centroids, scale):
            for c in np.unique(cluster):
                mine = values[cluster == c]
                # Halves of a long cannot overflow when summed over a batch.
                high, low = (mine >> 32, mine & 0xFFFFFFFF) if mine.dtype != object else (mine * 0, mine)
                total[c, :-1] += high.sum(0).astype(object) * 2 ** 32 + low.sum(0).astype(object)
                total[c, -1] += len(mine)
        rows = [(c, d, i, digit) for c in range(len(total)) if total[c, -1] for d, number in enumerate(total[c])
                for i, digit in enumerate(_digits(int(number)))]
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["cluster", "dim", "place", "digit"])
    return sums


def moved(kept: DataFrame, centroids: Centroids, scale: int = SCALE) -> Centroids:
    """One round: every centroid becomes the floor of its vectors' mean; one without
    vectors stays."""
    parts = kept.mapInArrow(_summed(centroids, scale), "cluster long, dim long, place long, digit long")
    sums: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "dim", "place").agg(F.sum("digit").alias("digit")).collect():
        row = sums.setdefault(r.cluster, [0] * (len(centroids[0]) + 1))
        row[r.dim] += r.digit << (DIGIT_BITS * r.place)
    return [[number // sums[c][-1] for number in sums[c][:-1]] if c in sums else old for c, old in enumerate(centroids)]


def _labelled(centroids: Centroids, scale: int):
    def labels(batches):
        for ids, _, cluster, distance in _assigned(batches, centroids, scale):
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(cluster, pa.int32()), pa.array([min(int(d), _LONG) for d in distance], pa.int64())],
                names=["vec_id", "cluster", "distance"])
    return labels


def clustered(vectors: DataFrame, clusters: int = CLUSTERS, components: int = COMPONENTS, rounds: int = ROUNDS,
              scale: int = SCALE) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector.

    Vectors that are null, hold a null or non-finite component or have another number of
    components are left out. Every other row counts, also where ids or vectors repeat or
    the id is null. With fewer vectors than ``clusters`` each begins a cluster; of equal
    centroids the first takes all. A distance or sum that no long holds is given as the
    greatest long; the clustering itself is exact. Other columns are never read. An empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    kept = cut_lineage(kept_vectors(vectors, components))
    centroids = first_centroids(kept, clusters, scale)
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids, scale)
    labelled = cut_lineage(kept.mapInArrow(_labelled(centroids, scale), "vec_id long, cluster int, distance long"))
    fits = lambda total: F.least(total, F.lit(_LONG)).cast("long")
    # One row per cluster, of which there are as many as centroids.
    sums = labelled.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    whole = sums.agg(F.sum("total")).scalar()
    named = spark.createDataFrame(
        [(c, hashlib.sha256(",".join(map(str, row)).encode()).hexdigest()) for c, row in enumerate(centroids)],
        "cluster int, centroid_sha256 string")
    per_cluster = sums.join(named, "cluster").select(
        "cluster", fits(F.col("total")).alias("cluster_inertia"), fits(whole).alias("inertia"), "centroid_sha256")
    return labelled.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_table_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen clusters of all whole vectors of ``embeddings``."""
    return clustered(table(spark, sf_dir, "embeddings"))


# A round: every vector's nearest centroid, then the floors of the means.
_SQL_ASSIGN = """
a{n} AS MATERIALIZED (SELECT r, vec_id, e, c AS cluster, d AS distance FROM (
  SELECT v.r, v.vec_id, v.e, k.c, list_sum(list_transform(list_zip(v.e, k.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d
  FROM v CROSS JOIN k{n} k) QUALIFY row_number() OVER (PARTITION BY r ORDER BY d, c) = 1),"""
_SQL_MOVE = """
m{n} AS (SELECT cluster AS c, i, sum(e[i])::HUGEINT AS s, count(*) AS n FROM a{n}, range(1, 65) t(i) GROUP BY ALL),
f{n} AS (SELECT c, list(CASE WHEN s % n < 0 THEN s // n - 1 ELSE s // n END ORDER BY i)::BIGINT[] AS e FROM m{n} GROUP BY c),
k{next} AS MATERIALIZED (SELECT k.c, coalesce(f.e, k.e) AS e FROM k{n} k LEFT JOIN f{n} f ON f.c = k.c),"""

ORACLE_SQL = """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, embedding AS x,
        list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
      WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
k0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x)::INTEGER - 1 AS c, e
      FROM v QUALIFY c < 16),""" + "".join(
    _SQL_ASSIGN.format(n=n) + _SQL_MOVE.format(n=n, next=n + 1) for n in range(ROUNDS)) + _SQL_ASSIGN.format(n=ROUNDS) + """
s AS (SELECT c, sha256(array_to_string(e, ',')) AS centroid_sha256 FROM k{n})
SELECT a.vec_id, a.cluster, a.distance, sum(a.distance) OVER (PARTITION BY a.cluster)::BIGINT AS cluster_inertia,
       sum(a.distance) OVER ()::BIGINT AS inertia, s.centroid_sha256
FROM a{n} a JOIN s ON s.c = a.cluster
""".format(n=ROUNDS)
