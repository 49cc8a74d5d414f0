"""Centroid clustering by Walsh-Hadamard progressive search, in whole numbers.

Components x become floor(scale * x). Vectors and centroids are turned by the
Walsh-Hadamard transform, which is exact in whole numbers and multiplies every squared
distance by the number of coefficients. Coefficients are ordered coarse to fine, by their
number of sign changes. Differences accumulate block by block; after each block a centroid
goes that is strictly worse, its smallest possible distance being above the greatest
possible one of another, where what is left lies between the squares of the difference and
of the sum of both suffix norms. What stays is summed over all coefficients, so distances
are exact and ties go to the smaller number.

A round is one pass over the rows without a shuffle of them: tasks return sums and counts of
each centroid. ``rows`` is read once for the first centroids, once a round, and for the sums
and the result; hand over a table, not a long plan.

Defined cases. Vectors that are null, of another length, or that hold a null or non-finite
component are left out. First centroids are the ``k`` kept vectors with the smallest SHA-256 of
``seed:id``, ties by smaller vector; a null id counts as the word null. With fewer than
``k`` vectors there are fewer centroids. Repeated rows count each; an empty table gives an
empty result. A component beyond 2^27 after scaling stops the run with an error, as squared
distances no longer fit a long; up to there arithmetic is exact (whole numbers of any size
replace doubles where those could round). Other columns may have any name.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibloom.llm.common import column
from bibloom.llm.vectors import embeddings, matrix, usable

LENGTH, K, ROUNDS, SCALE, SEED = 64, 8, 10, 1024, 3
#: Coefficients seen when centroids are eliminated; then all
CHECKPOINTS = (4, 8, 16, 32)
LARGEST = 1 << 27


def walsh(d: int) -> np.ndarray:
    """The transform of d numbers, d a power of two, as a matrix whose columns have ever more sign changes."""
    h = np.ones((1, 1), np.int64)
    while len(h) < d:
        h = np.block([[h, h], [h, -h]])
    return h[:, np.argsort((np.diff(h, axis=0) != 0).sum(axis=0), kind="stable")]


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    found = np.floor(scale * vectors)
    if found.size and np.abs(found).max() > LARGEST:
        raise ArithmeticError(f"a component is beyond {LARGEST} after scaling: squared distances do not fit a long")
    return found.astype(np.int64)


def nearest(vectors: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid of each vector, and the squared distance."""
    n, d = vectors.shape
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = 1 << (d - 1).bit_length()
    largest = max(int(np.abs(vectors).max()), int(np.abs(centroids).max()))
    # doubles hold the sums exactly below 2^53
    kind = np.float64 if wide * wide * (2 * largest) ** 2 < 1 << 53 else object
    turn = walsh(wide)[:d].astype(kind)
    x, c = vectors.astype(kind) @ turn, centroids.astype(kind) @ turn
    part, alive, done = np.zeros((n, len(c)), kind), np.ones((n, len(c)), bool), 0
    for end in [k for k in CHECKPOINTS if k < wide] + [wide]:
        for k in range(len(c)):
            at = np.nonzero(alive[:, k])[0]
            part[at, k] += ((x[at, done:end] - c[k, done:end]) ** 2).sum(axis=1)
        done = end
        if done < wide:
            seen = part.astype(np.float64)
            rx, rc = (np.sqrt((z[:, done:].astype(np.float64) ** 2).sum(axis=1)) for z in (x, c))
            low, high = seen + (rx[:, None] - rc) ** 2, seen + (rx[:, None] + rc) ** 2
            best = np.where(alive, high, np.inf).min(axis=1, keepdims=True)
            # the margin is far above rounding: equals stay
            alive &= low <= best * (1 + 1e-9) + 1e-3
    part[~alive] = np.inf
    number = part.argmin(axis=1)
    return number, (part[np.arange(n), number].astype(object) // wide).astype(np.int64)


def kept(rows: DataFrame, length: int, id_col: str, vec_col: str) -> DataFrame:
    """(id, v) of the vectors that take part."""
    v = column(vec_col)
    return rows.filter((F.size(v) == length) & usable(v)).select(column(id_col).alias("id"), v.alias("v"))


def first_centroids(vectors: DataFrame, k: int, scale: int, seed: int) -> np.ndarray:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"), 256)
    found = vectors.select(digest.alias("digest"), "v").orderBy("digest", "v").limit(k).collect()
    return whole(np.array([r["v"] for r in found], np.float64), scale)


def tallies(vectors: DataFrame, centroids: np.ndarray, scale: int) -> tuple[list[int], list[list[int]], list[int]]:
    """Of each centroid: vectors, sums of their components, sum of squared distances."""
    k, d = centroids.shape

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, d + 2), np.int64)
        for part in parts:
            x = whole(matrix(part.column("v")), scale)
            number, distance = nearest(x, centroids)
            for c in np.unique(number):
                own = number == c
                sums[c] += [*x[own].sum(axis=0), own.sum(), distance[own].sum()]
        yield pa.RecordBatch.from_pydict({"c": np.repeat(np.arange(k), d + 2), "i": np.tile(np.arange(d + 2), k), "s": sums.ravel()})

    total = np.zeros((k, d + 2), np.int64)
    for r in vectors.select("v").mapInArrow(tally, "c long, i long, s long").groupBy("c", "i").agg(F.sum("s").alias("s")).collect():
        total[r["c"], r["i"]] = r["s"]
    return total[:, d].tolist(), total[:, :d].tolist(), total[:, d + 1].tolist()


def fit(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, scale: int = SCALE, seed: int = SEED) -> np.ndarray:
    """The centroids after ``rounds`` rounds over (id, v)."""
    centroids = first_centroids(vectors, k, scale, seed)
    for _ in range(rounds if len(centroids) else 0):
        counts, sums, _ = tallies(vectors, centroids, scale)
        moved = [[s // n for s in own] if n else old for n, own, old in zip(counts, sums, centroids.tolist())]
        if moved == centroids.tolist():
            break  # every later round would repeat this one
        centroids = np.array(moved, np.int64)
    return centroids


def assign(vectors: DataFrame, centroids: np.ndarray, scale: int = SCALE) -> DataFrame:
    """(id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each of (id, v)."""
    schema = T.StructType([vectors.schema["id"]])
    for name, kind in (("cluster", T.IntegerType()), ("distance", T.LongType()), ("cluster_inertia", T.LongType()), ("inertia", T.LongType()), ("centroid_sha256", T.StringType())):
        schema.add(name, kind)
    if not len(centroids):
        return vectors.sparkSession.createDataFrame([], schema)
    inertia = tallies(vectors, centroids, scale)[2]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def near(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, names = np.array(inertia, np.int64), pa.array(digests)
        for part in parts:
            number, distance = nearest(whole(matrix(part.column("v")), scale), centroids)
            columns = [part.column("id"), pa.array(number.astype(np.int32)), pa.array(distance), pa.array(own[number]), pa.array(np.full(len(number), own.sum())), names.take(pa.array(number))]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return vectors.mapInArrow(near, schema)


def clusters(rows: DataFrame, k: int = K, rounds: int = ROUNDS, length: int = LENGTH, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = SCALE, seed: int = SEED) -> DataFrame:
    vectors = kept(rows, length, id_col, vec_col)
    return assign(vectors, fit(vectors, k, rounds, scale, seed), scale).withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    return clusters(embeddings(spark, sf_dir))


def _oracle() -> str:
    parts = [
        """v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        """c0 AS (SELECT row_number() OVER (ORDER BY h) - 1 AS c, e FROM (SELECT sha256('3:' || vec_id) AS h, e FROM v ORDER BY h LIMIT 8))""",
        "w AS (SELECT vec_id, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM v)",
    ]
    for r in range(ROUNDS + 1):
        parts.append(f"""d{r} AS (SELECT v.vec_id, c.c, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS s FROM v, c{r} c)""")
        parts.append(f"a{r} AS MATERIALIZED (SELECT vec_id, c, s FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s, c) = 1)")
        if r < ROUNDS:
            parts.append(f"m{r} AS (SELECT c, list(f ORDER BY i) AS e FROM (SELECT a.c, w.i, floor(sum(w.x)::DOUBLE / count(*))::BIGINT AS f FROM a{r} a JOIN w USING (vec_id) GROUP BY a.c, w.i) GROUP BY c)")
            parts.append(f"c{r + 1} AS MATERIALIZED (SELECT o.c, coalesce(m.e, o.e) AS e FROM c{r} o LEFT JOIN m{r} m USING (c))")
    last = ROUNDS
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, a.c::INTEGER AS cluster, a.s AS distance, sum(a.s) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(a.s) OVER ()::BIGINT AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a{last} a JOIN c{last} c USING (c)"""


ORACLE = _oracle()
