"""Hard-negative mining with segment summary filtering.

Every anchor meets every row, block by block. A row's vector is cut into segments, and each
segment's mean and deviation are stored. On a segment of n numbers the product of two
vectors is n times the product of their means, plus or minus at most the product of their
deviations; sums over the segments bound the score. Pairs whose bounds cannot reach the
anchor's scores go, segments are halved, and what is left after the finest ones is scored
exactly. The scores to reach rise while a block is read: from the best found so far.

Positives come first: each anchor's best rows of its own label. They give the score windows
in which the best rows of other labels are its negatives. A block returns a few candidates
an anchor, and a ranking over the blocks' candidates decides.

Defined cases. Rows with a null label, a null vector or a null or non-finite component take
no part. Vectors of different lengths have no score; empty ones score 0. Rows that repeat
an id are rows of their own: an anchor's copy may be its positive. Null ids come last among
equal scores. Components are whole numbers after scaling; scores are exact while they fit a
long, beyond which the run stops with an error. An empty table, or one without anchors,
gives an empty result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.llm.common import column, forget, tidy, written
from bibloom.llm.vectors import by_length, embeddings, matrix, usable

POSITIVES, NEGATIVES, LOW, HIGH, SCALE = 5, 3, 50, 95, 256
#: Rows and anchors of a block, on average
ROWS, ANCHORS = 4096, 2048
#: Segments of the finest summaries; each coarser level has half as many
SEGMENTS = 16
COARSEST = 4
CHUNK_ANCHORS, CHUNK_ROWS = 256, 1024


def bounds_of(d: int) -> np.ndarray:
    """Where the finest segments of d numbers begin and end."""
    return np.linspace(0, d, SEGMENTS + 1).astype(np.int64)


def summary(vectors: np.ndarray) -> np.ndarray:
    """Means, then deviations (roots of the summed squares about the mean), of each vector's finest segments."""
    out = np.zeros((len(vectors), 2 * SEGMENTS))
    ends = bounds_of(vectors.shape[1])
    for k, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
        if b > a:
            out[:, k] = vectors[:, a:b].mean(axis=1)
            out[:, SEGMENTS + k] = np.sqrt(((vectors[:, a:b] - out[:, k : k + 1]) ** 2).sum(axis=1))
    return out


def levels(stored: np.ndarray, d: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """(means times the root of the segment's size, deviations) from the coarsest level to the finest."""
    sizes = np.diff(bounds_of(d)).astype(np.float64)
    means, squares = stored[:, :SEGMENTS], stored[:, SEGMENTS:] ** 2
    found = []
    while True:
        found.append((means * np.sqrt(sizes), np.sqrt(squares)))
        if len(sizes) <= COARSEST:
            return found[::-1]
        both = sizes[::2] + sizes[1::2]
        mixed = (means[:, ::2] * sizes[::2] + means[:, 1::2] * sizes[1::2]) / np.maximum(both, 1)
        between = sizes[::2] * (means[:, ::2] - mixed) ** 2 + sizes[1::2] * (means[:, 1::2] - mixed) ** 2
        means, squares, sizes = mixed, squares[:, ::2] + squares[:, 1::2] + between, both


def best_of(anchors: dict, rows: dict, allowed, low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, window, row, score): of each window low..high (anchors x windows) the k best allowed rows.

    anchors and rows: x (whole numbers as doubles or objects) and levels. Rows are in the order of ties.
    """
    windows = low.shape[1]
    keys, at, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, low.dtype)
    low = low.copy()
    largest = max((np.sqrt((m**2).sum(axis=1) + (s**2).sum(axis=1)).max(initial=0.0) for m, s in (anchors["levels"][0], rows["levels"][0])))
    slack = 1e-3 + 1e-9 * float(largest) ** 2
    for begin in range(0, len(rows["x"]), CHUNK_ROWS):
        cols = np.arange(begin, min(begin + CHUNK_ROWS, len(rows["x"])))
        mask = allowed(cols)
        i, j = np.arange(len(mask)), cols
        least, most = low.min(axis=1).astype(np.float64), high.max(axis=1).astype(np.float64)
        for (ma, sa), (mb, sb) in zip(anchors["levels"], rows["levels"]):
            keep = mask.any(axis=1), mask.any(axis=0)
            i, j, mask = i[keep[0]], j[keep[1]], mask[np.ix_(*keep)]
            mid, dev = ma[i] @ mb[j].T, sa[i] @ sb[j].T
            mask = mask & (mid + dev >= least[i][:, None] - slack) & (mid - dev <= most[i][:, None] + slack)
        keep = mask.any(axis=1), mask.any(axis=0)
        i, j, mask = i[keep[0]], j[keep[1]], mask[np.ix_(*keep)]
        if not len(i):
            continue
        exact = anchors["x"][i] @ rows["x"][j].T
        for w in range(windows):
            fits = mask & (exact >= low[i, w][:, None]) & (exact <= high[i, w][:, None])
            a, b = np.nonzero(fits)
            keys, at, scores = np.concatenate([keys, i[a] * windows + w]), np.concatenate([at, j[b]]), np.concatenate([scores, exact[a, b]])
        order = np.lexsort((at, -scores, keys)) if scores.dtype != object else np.array(sorted(range(len(keys)), key=lambda t: (keys[t], -scores[t], at[t])), np.int64)
        keys, at, scores = keys[order], at[order], scores[order]
        place = np.arange(len(keys)) - np.searchsorted(keys, keys)
        keys, at, scores, place = keys[place < k], at[place < k], scores[place < k], place[place < k]
        full = place == k - 1
        low[keys[full] // windows, keys[full] % windows] = scores[full]
    return keys // windows, keys % windows, at, scores


def _blocks(anchors: DataFrame, rows: DataFrame, n_rows: int, n_anchors: int) -> DataFrame:
    """Both sides dealt to pairs of blocks (p, q), with a mark of the side."""
    here, there = max(1, -(-n_rows // ROWS)), max(1, -(-n_anchors // ANCHORS))
    deal = lambda n, salt: F.pmod(F.xxhash64("rid", F.lit(salt)), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = anchors.select("*", deal(there, 1).alias("p"), F.lit(True).alias("anchor")).select("*", each(here).alias("q"))
    right = rows.select("*", deal(here, 2).alias("q"), F.lit(False).alias("anchor")).select("*", each(there).alias("p"))
    return left.unionByName(right, allowMissingColumns=True)


def _sides(table: pa.Table) -> Iterator[tuple[int, pa.Table, pa.Table, dict, dict]]:
    """Anchors and rows of one length at a time, with what ``best_of`` takes."""
    table = table.sort_by([("id", "ascending"), ("rid", "ascending")])
    for d, at in by_length(table, "x").items():
        own = table.take(pa.array(at))
        marks = own.column("anchor").to_numpy(zero_copy_only=False).astype(bool)
        parts = [own.filter(pa.array(marks)), own.filter(pa.array(~marks))]
        if not all(p.num_rows for p in parts):
            continue
        found = []
        for p in parts:
            x = p.column("x").combine_chunks().flatten().to_numpy().reshape(p.num_rows, d)
            found.append({"x": x, "levels": levels(matrix(p.column("stored")), d)})
        largest = [int(np.abs(s["x"]).max(initial=0)) for s in found]
        kind = np.float64 if d * largest[0] * largest[1] < 1 << 53 else object
        for s in found:
            s["x"] = s["x"].astype(kind)
        yield d, *parts, *found


def _same(anchors: pa.Table, rows: pa.Table, name: str) -> np.ndarray:
    values = pa.chunked_array([*anchors.column(name).chunks, *rows.column(name).chunks]).combine_chunks().dictionary_encode().indices.to_numpy()
    return values[: anchors.num_rows, None] == values[None, anchors.num_rows :]


def prepared(rows: DataFrame, is_anchor: Column, id_col: str, vec_col: str, label_col: str, scale: int) -> DataFrame:
    """A table (rid, id, label, anchor, x, stored) of the rows that take part: whole numbers and segment summaries."""
    v, label = column(vec_col), column(label_col)
    kept = rows.filter(usable(v) & label.isNotNull())
    read = kept.select(F.monotonically_increasing_id().alias("rid"), column(id_col).alias("id"), label.alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"), v.alias("v"))
    kinds = dict(read.dtypes)

    def summarise(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            xs, stored = [None] * part.num_rows, [None] * part.num_rows
            for _, at in by_length(part, "v").items():
                x = matrix(part.column("v").take(pa.array(at))) if len(at) else np.zeros((0, 0))
                x = np.floor(scale * x)
                if x.size and np.abs(x).max() >= 2.0**62:
                    raise ArithmeticError("a component does not fit a long after scaling")
                for k, whole, own in zip(at, x.astype(np.int64), summary(x)):
                    xs[k], stored[k] = whole, own
            columns = [part.column(c) for c in ("rid", "id", "label", "is_anchor")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(xs, pa.list_(pa.int64())), pa.array(stored, pa.list_(pa.float64()))], ["rid", "id", "label", "is_anchor", "x", "stored"])

    return written(read.mapInArrow(summarise, f"rid long, id {kinds['id']}, label {kinds['label']}, is_anchor boolean, x array<bigint>, stored array<double>"))


def _empty(schema: pa.Schema) -> pa.Table:
    return schema.empty_table()


def positives_of(table: DataFrame, k: int, n_rows: int, n_anchors: int) -> DataFrame:
    """A table (rid, found): each anchor's k best other rows of its label, as (score, id) in order."""
    kinds = dict(table.dtypes)

    def scan(group: pa.Table) -> pa.Table:
        out = []
        for _, anchors, rows, left, right in _sides(group):
            fits = _same(anchors, rows, "label") & ~_same(anchors, rows, "rid")
            for begin in range(0, anchors.num_rows, CHUNK_ANCHORS):
                part = slice(begin, begin + CHUNK_ANCHORS)
                some = {"x": left["x"][part], "levels": [(m[part], s[part]) for m, s in left["levels"]]}
                n, edge = len(some["x"]), float("inf")
                i, _, j, score = best_of(some, right, lambda cols: fits[part][:, cols], np.full((n, 1), -edge, left["x"].dtype), np.full((n, 1), edge, left["x"].dtype), k)
                out.append(pa.table({"rid": anchors.column("rid").take(pa.array(i + begin)), "id": rows.column("id").take(pa.array(j)), "score": pa.array([int(s) for s in score], pa.int64())}))
        return pa.concat_tables(out) if out else _empty(pa.schema([("rid", pa.int64()), ("id", group.schema.field("id").type), ("score", pa.int64())]))

    sides = table.select("rid", "id", "label", "x", "stored"), table.filter("is_anchor").select("rid", "id", "label", "x", "stored")
    met = _blocks(sides[1], sides[0], n_rows, n_anchors).groupBy("p", "q").applyInArrow(scan, f"rid long, id {kinds['id']}, score long")
    order = Window.partitionBy("rid").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    best = met.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", "score", "id"))), lambda s: F.struct(s["score"].alias("score"), s["id"].alias("id")))
    return written(best.groupBy("rid").agg(listed.alias("found")))


def mine(
    rows: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, scale: int = SCALE,
    id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label",
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Of each row for which ``is_anchor`` holds the ``positives`` best rows of its label, and for each of these the
    ``negatives`` best rows of other labels that score from low to high percent of the positive's score.
    """
    with tidy(rows.sparkSession):
        table = prepared(rows, is_anchor, id_col, vec_col, label_col, scale)
        kinds = dict(table.dtypes)
        counts = table.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("is_anchor"), 1)).alias("m")).first()
        found = positives_of(table, positives, counts["n"], counts["m"])
        anchors = table.filter("is_anchor").join(found, "rid").select("rid", "id", "label", "x", "stored", F.col("found.score").alias("scores"))

        def scan(group: pa.Table) -> pa.Table:
            out = []
            for _, anchors, rows, left, right in _sides(group):
                differs = ~_same(anchors, rows, "label")
                # a window that nothing fits where an anchor has fewer positives
                lists, kind = anchors.column("scores").to_pylist(), left["x"].dtype
                below, above = np.full((len(lists), positives), 1, kind), np.full((len(lists), positives), 0, kind)
                for i, scores in enumerate(lists):
                    for w, s in enumerate(scores):
                        below[i, w], above[i, w] = -(-low * s // 100), high * s // 100
                for begin in range(0, anchors.num_rows, CHUNK_ANCHORS):
                    part = slice(begin, begin + CHUNK_ANCHORS)
                    some = {"x": left["x"][part], "levels": [(m[part], s[part]) for m, s in left["levels"]]}
                    i, w, j, score = best_of(some, right, lambda cols: differs[part][:, cols], below[part], above[part], negatives)
                    out.append(pa.table({"rid": anchors.column("rid").take(pa.array(i + begin)), "w": pa.array(w.astype(np.int32)), "id": rows.column("id").take(pa.array(j)), "score": pa.array([int(s) for s in score], pa.int64())}))
            return pa.concat_tables(out) if out else _empty(pa.schema([("rid", pa.int64()), ("w", pa.int32()), ("id", group.schema.field("id").type), ("score", pa.int64())]))

        met = _blocks(anchors, table.select("rid", "id", "label", "x", "stored"), counts["n"], counts["m"]).groupBy("p", "q").applyInArrow(scan, f"rid long, w int, id {kinds['id']}, score long")
        order = Window.partitionBy("rid", "w").orderBy(F.desc("score"), F.asc_nulls_last("id"))
        best = met.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
        named = best.join(table.filter("is_anchor").select("rid", F.col("id").alias("anchor_id")), "rid").join(found, "rid")
        positive = F.element_at("found", F.col("w") + 1)
        result = written(named.select("anchor_id", positive["id"].alias("positive_id"), "rank", F.col("id").alias("negative_id"), positive["score"].alias("positive_score"), F.col("score").alias("negative_score")))
        forget(table, found)
    return result


def query(spark, sf_dir: str) -> DataFrame:
    rows = embeddings(spark, sf_dir)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", moved), F.col("vec_id") % 50 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2]))::BIGINT AS s
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT a, b AS p, s AS ps FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
), negatives AS (
  SELECT p.a, p.p, p.ps, n.b, n.s, row_number() OVER (PARTITION BY p.a, p.p ORDER BY n.s DESC, n.b) AS r
  FROM positives p JOIN scored n ON n.a = p.a AND NOT n.same AND 50 * p.ps <= 100 * n.s AND 100 * n.s <= 95 * p.ps
)
SELECT a AS anchor_id, p AS positive_id, r::INTEGER AS rank, b AS negative_id, ps AS positive_score, s AS negative_score FROM negatives WHERE r <= 3
"""
