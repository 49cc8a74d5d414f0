"""Near-deduplication of vectors by PCA-ordered tiled comparison.

Vectors of one label and length are compared by cosine. Equal vectors are one class, so a
group of copies takes part once. Unit vectors are turned into the axes of the second
moments of all of them, largest first; such a rotation keeps every product. Classes are
ordered by cells of their two leading coordinates and cut into tiles of some ``TILE``
rows. Two tiles meet unless the boxes of their leading coordinates lie too far apart: unit
vectors of cosine c are sqrt(2 - 2c) apart, and no projection is farther.

Where tiles meet, products of the leading dimensions come first. What the other dimensions
can add is at most the product of both vectors' suffix norms; pairs that cannot reach the
threshold go at each of a few checkpoints, and what survives is decided on the original
vectors. A pair of tiles returns link counts and a spanning forest, at most as many rows as
it holds, never its pairs: a group of near copies costs a few rows a member.

The rotation serves speed alone. It is made for the ``LENGTHS`` commonest lengths of at
most ``MAX_AXES`` dimensions; vectors of other lengths keep their own axes.

Defined cases. A vector with a null label, that is null, zero or empty, or that holds a
null or non-finite component is linked with nothing and is its own component. Rows that
repeat an id are vectors of their own; ``kept`` holds for each row whose id is its
component's smallest. Null ids take part in links, never as a component's id unless all of
its ids are null, and are not ``kept``. ``deduplicate`` keeps one row of each component and
every row that can't be compared. An empty table gives an empty result. Other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bibloom.llm.common import column, forget, tidy, whole_row, written
from bibloom.llm.near_dedup import components
from bibloom.llm.vectors import by_length, doubles, embeddings, matrix, unit, usable

THRESHOLD = 0.98
TILE = 2048
#: Steps of each of the two leading coordinates over [-1, 1] that make a cell
STEPS = 64
#: Leading coordinates that bound a tile
LEAD = 8
LENGTHS, MAX_AXES = 8, 512
#: Dimensions compared so far at each checkpoint; then all
CHECKPOINTS = (8, 16, 32)
CHUNK = 256
#: Above any rounding of a product of unit vectors
SLACK = 1e-9


def _keys(label: Column, vector: Column) -> list[Column]:
    """128 bits that name a class."""
    return [F.xxhash64(label, vector).alias("h1"), F.xxhash64(F.lit(11), label, vector).alias("h2")]


def _read(rows: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(row, id, label, v): v is null where the row can't be compared."""
    vector, label = column(vec_col), column(label_col)
    fit = usable(vector) & label.isNotNull() & F.exists(vector, lambda x: x != 0)
    return rows.select(whole_row(rows).alias("row"), column(id_col).alias("id"), label.alias("label"), F.when(fit, doubles(vector)).alias("v"))


def moments(classes: DataFrame) -> dict[int, np.ndarray]:
    """Axes by length, as columns in falling order of second moment, from all classes of the commonest lengths."""

    def tally(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for part in parts:
            for d, at in by_length(part, "v").items():
                if d <= MAX_AXES:
                    z = unit(matrix(part.column("v").take(pa.array(at))))
                    sums[d] = sums.get(d, 0) + z.T @ z
        for d, m in sums.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_pydict({"d": np.full(len(i), d, np.int32), "i": i.astype(np.int32), "j": j.astype(np.int32), "m": m[i, j]})

    common = classes.groupBy(F.size("v").alias("d")).count().filter(F.col("d") <= MAX_AXES).orderBy(F.desc("count"), "d").limit(LENGTHS)
    lengths = [r["d"] for r in common.collect()]
    found = classes.filter(F.size("v").isin(lengths)).select("v").mapInArrow(tally, "d int, i int, j int, m double")
    sums = {d: np.zeros((d, d)) for d in lengths}
    for r in found.groupBy("d", "i", "j").agg(F.sum("m").alias("m")).toLocalIterator():
        sums[r["d"]][r["i"], r["j"]] = sums[r["d"]][r["j"], r["i"]] = r["m"]
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in sums.items()}


def turned(vectors: np.ndarray, axes: dict[int, np.ndarray]) -> np.ndarray:
    rows = unit(vectors)
    own = axes.get(rows.shape[1])
    return rows if own is None else rows @ own


def tiles(classes: DataFrame, axes: dict[int, np.ndarray]) -> DataFrame:
    """A table (node, n, label, d, v, lead, tile) of the classes."""

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lead, cell = [None] * part.num_rows, np.zeros(part.num_rows, np.int32)
            for d, at in by_length(part, "v").items():
                z = turned(matrix(part.column("v").take(pa.array(at))), axes)
                step = np.clip(((z[:, :2] + 1) * (STEPS / 2)).astype(np.int32), 0, STEPS - 1)
                cell[at] = step[:, 0] * STEPS + step[:, -1]
                for k, row in zip(at, z[:, :LEAD]):
                    lead[k] = row
            columns = [part.column(c) for c in ("node", "n", "label", "v")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(lead, pa.list_(pa.float64())), pa.array(cell)], ["node", "n", "label", "v", "lead", "cell"])

    kinds = dict(classes.dtypes)
    placed = classes.select("node", "n", "label", "v").mapInArrow(place, f"node long, n long, label {kinds['label']}, v array<double>, lead array<double>, cell int")
    placed = written(placed.withColumn("d", F.size("v")))
    # a cell's classes follow those of the cells before; a cell that spans tiles is dealt out among them
    counts = placed.groupBy("label", "d", "cell").agg(F.count(F.lit(1)).alias("here"))
    before = F.sum("here").over(Window.partitionBy("label", "d").orderBy("cell")) - F.col("here")
    spans = counts.select("label", "d", "cell", F.floor(before / TILE).alias("first"), F.floor((before + F.col("here") - 1) / TILE).alias("last"))
    tile = F.col("first") + F.pmod(F.xxhash64("node"), F.col("last") - F.col("first") + 1)
    found = written(placed.join(written(spans), ["label", "d", "cell"]).withColumn("tile", tile).drop("cell", "first", "last"))
    forget(placed)
    return found


def meetings(tiled: DataFrame, threshold: float) -> DataFrame:
    """A table (pair, label, d, x, y) of tiles x <= y whose boxes are near enough."""
    most = max(0.0, 2 - 2 * threshold) + SLACK
    box = [f(F.try_element_at("lead", F.lit(k + 1))).alias(f"{name}{k}") for k in range(LEAD) for name, f in (("lo", F.min), ("hi", F.max))]
    boxes = tiled.groupBy("label", "d", "tile").agg(*box)
    # strips of the first coordinate as wide as linked vectors can be apart
    wide = most**0.5
    strip = lambda c: F.floor(F.col(c) / wide)
    boxes = written(boxes.withColumn("from", strip("lo0")).withColumn("to", strip("hi0")))
    x = boxes.select("label", "d", F.col("tile").alias("x"), *[F.col(f"{e}{k}").alias(f"x{e}{k}") for k in range(LEAD) for e in ("lo", "hi")], F.col("from").alias("x_from"), F.explode(F.sequence("from", "to")).alias("strip"))
    y = boxes.select("label", "d", F.col("tile").alias("y"), *[f"lo{k}" for k in range(LEAD)], *[f"hi{k}" for k in range(LEAD)], (F.col("from") - 1).alias("y_from"), F.explode(F.sequence(F.col("from") - 1, F.col("to") + 1)).alias("strip"))
    gap = [F.greatest(F.col(f"xlo{k}") - F.col(f"hi{k}"), F.col(f"lo{k}") - F.col(f"xhi{k}"), F.lit(0.0)) for k in range(LEAD)]
    apart = sum((F.coalesce(g * g, F.lit(0.0)) for g in gap[1:]), gap[0] * gap[0])
    # a pair that shares several strips is met in the first of them
    first = F.col("strip") == F.greatest("x_from", "y_from")
    met = x.join(y, ["label", "d", "strip"]).filter((F.col("x") <= F.col("y")) & first & (apart <= most)).select("label", "d", "x", "y")
    found = written(met.withColumn("pair", F.monotonically_increasing_id()))
    forget(boxes)
    return found


def pairs_of(x: np.ndarray, y: np.ndarray, axes: dict[int, np.ndarray], threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows of x and y whose cosine reaches the threshold, chunk by chunk."""
    d = x.shape[1]
    ux, uy, tx, ty = unit(x), unit(y), turned(x, axes), turned(y, axes)
    ends = [k for k in CHECKPOINTS if k < d]
    suffix = lambda z: [np.sqrt((z[:, k:] ** 2).sum(axis=1)) for k in ends]
    sx, sy = suffix(tx), suffix(ty)
    for at in range(0, len(x), CHUNK):
        i, j = np.arange(at, min(at + CHUNK, len(x))), np.arange(len(y))
        part, done = np.zeros((len(i), len(j))), 0
        alive = None
        for k, end in enumerate(ends):
            part += tx[i, done:end] @ ty[j, done:end].T
            alive = part + sx[k][i][:, None] * sy[k][j] >= threshold - SLACK
            done = end
            rows, cols = alive.any(axis=1), alive.any(axis=0)
            i, j, part, alive = i[rows], j[cols], part[np.ix_(rows, cols)], alive[np.ix_(rows, cols)]
            if alive.size > 20 * alive.sum():  # few of many: pair by pair from here on
                break
        if not len(i):
            continue
        if alive is None or alive.size <= 20 * alive.sum():
            hit = ux[i] @ uy[j].T >= threshold
            a, b = np.nonzero(hit if alive is None else hit & alive)
            yield i[a], j[b]
            continue
        a, b = np.nonzero(alive)
        p, q, part = i[a], j[b], part[a, b]
        for k, end in enumerate(ends):
            if end > done:
                part = part + np.einsum("ij,ij->i", tx[p, done:end], ty[q, done:end])
                stay = part + sx[k][p] * sy[k][q] >= threshold - SLACK
                p, q, part, done = p[stay], q[stay], part[stay], end
        hit = np.einsum("ij,ij->i", ux[p], uy[q]) >= threshold
        yield p[hit], q[hit]


def _join(roots: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Roots after the links (i, j): of two trees the larger root hangs on the smaller one."""
    while True:
        a, b = roots[i], roots[j]
        open_ = a != b
        if not open_.any():
            return roots
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(roots, np.maximum(a, b), np.minimum(a, b))
        while (beyond := roots[roots]).tobytes() != roots.tobytes():
            roots = beyond


def compared(tiled: DataFrame, met: DataFrame, axes: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """A table (node, peer, links): counts where peer is null, else an edge of a spanning forest."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("side", "ascending"), ("node", "ascending")])
        side, node, size = (table.column(c).to_numpy() for c in ("side", "node", "n"))
        vectors = matrix(table.column("v"))
        cut = int(np.searchsorted(side, 1))
        same = cut == len(side)
        x, y = vectors[:cut], vectors if same else vectors[cut:]
        links, roots, shift = np.zeros(len(node), np.int64), np.arange(len(node)), 0 if same else cut
        for i, j in pairs_of(x, y, axes, threshold):
            if same:
                i, j = i[i < j], j[i < j]
            j = j + shift
            np.add.at(links, i, size[j])
            np.add.at(links, j, size[i])
            roots = _join(roots, i, j)
        some, hung = np.nonzero(links)[0], np.nonzero(roots != np.arange(len(node)))[0]
        nodes = np.concatenate([node[some], node[hung]])
        peers = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[roots[hung]], pa.int64())])
        return pa.table({"node": pa.array(nodes, pa.int64()), "peer": peers, "links": pa.array(np.concatenate([links[some], np.zeros(len(hung), np.int64)]))})

    side = lambda c, s: met.select("pair", "label", "d", F.col(c).alias("tile"), F.lit(s).alias("side"))
    sides = side("x", 0).unionByName(side("y", 1).join(met.filter("x <> y").select("pair"), "pair", "left_semi"))
    dealt = tiled.select("label", "d", "tile", "node", "n", "v").join(written(sides), ["label", "d", "tile"]).select("pair", "side", "node", "n", "v")
    return written(dealt.groupBy("pair").applyInArrow(compare, "node long, peer long, links long"))


def _decided(read: DataFrame, threshold: float) -> DataFrame:
    """A table (h1, h2, n_links, component, least) of the classes; least: the smallest id of the component."""
    classes = read.filter("v is not null").groupBy("label", "v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id"))
    classes = written(classes.select("*", *_keys(F.col("label"), F.col("v")), F.monotonically_increasing_id().alias("node")))
    axes = moments(classes)
    tiled = tiles(classes, axes)
    met = meetings(tiled, threshold)
    found = compared(tiled, met, axes, threshold)
    labels = components(found.filter("peer is not null").select(F.col("node").alias("u"), F.col("peer").alias("v")))
    counts = found.filter("peer is null").groupBy("node").agg(F.sum("links").alias("links"))
    named = classes.select("node", "h1", "h2", "n", "id").join(labels, "node", "left").join(counts, "node", "left")
    named = written(named.select("h1", "h2", "id", F.coalesce("label", "node").alias("component"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")))
    least = written(named.groupBy("component").agg(F.min("id").alias("least")))
    decided = written(named.drop("id").join(least, "component"))
    forget(classes, tiled, met, found, labels, named, least)
    return decided


def vector_components(
    rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(id, n_links, component_id, kept) of every row; n_links: other rows at the threshold or above."""
    read = _read(rows, id_col, vec_col, label_col).drop("row")
    with tidy(rows.sparkSession):
        decided = _decided(read, threshold)
    keyed = read.select("id", F.col("v").isNotNull().alias("fit"), *_keys(F.col("label"), F.col("v")))
    # rows that can't be compared must not meet a class
    keyed = keyed.select("id", *[F.when(F.col("fit"), F.col(h)).alias(h) for h in ("h1", "h2")])
    found = keyed.join(decided, ["h1", "h2"], "left")
    own = F.when(F.col("component").isNull(), F.col("id")).otherwise(F.col("least"))
    return found.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def deduplicate(rows: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """The rows that stay, with their own columns: of each component one row with its smallest id, and what can't be compared."""
    read = _read(rows, id_col, vec_col, label_col)
    with tidy(rows.sparkSession):
        decided = _decided(read.drop("row"), threshold)
    keyed = read.select("row", "id", F.col("v").isNotNull().alias("fit"), *_keys(F.col("label"), F.col("v")))
    met = keyed.filter("fit").join(decided, ["h1", "h2"]).filter(F.col("id").eqNullSafe(F.col("least")))
    one = met.groupBy("component").agg(F.min_by("row", F.struct("h1", "h2")).alias("row"))
    return keyed.filter("not fit").select("row").unionByName(one.select("row")).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return vector_components(embeddings(spark, sf_dir))


ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.98
), reach(u, v) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.u, links.v FROM reach JOIN links ON links.u = reach.v
), least AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT e.vec_id, coalesce(c.n, 0)::BIGINT AS n_links, l.component_id, e.vec_id = l.component_id AS kept
FROM embeddings e JOIN least l ON l.u = e.vec_id LEFT JOIN counts c ON c.u = e.vec_id
"""
