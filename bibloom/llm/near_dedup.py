"""MinHash near-deduplication with sequential Bayesian verification.

Documents become sets of word shingles, and documents with equal sets one class. Bands of
each class's MinHash signature propose candidates; a candidate pair's signatures are
compared batch by batch, and the pair goes as soon as the posterior probability that its
similarity reaches the threshold falls below ``miss``. What survives is verified on the
full sets. Links make components.

Candidates are proposed in three rounds, each of which leaves out what is in one component
already. First each class meets the least class of all its buckets, one pair a class. Then
members of buckets that still span several components meet their bucket's least and
greatest member. What is left of such buckets meets by an exact prefix filter over rare
shingles, which loses no similar pair. A group of near copies costs a few rows a member.

Signatures travel as the low 8 bits of each value. Values that differ agree there once in
256 times, which can only keep a pair longer, so the miss probability holds.

Chances: with 40 bands of 6 rows a pair at similarity 0.8 shares no band with probability
5e-6, at 0.85 with 3e-9.

Defined cases. A null text counts as empty; a text without words has no shingles, is linked
with nothing and is its own component. Ids may be null or repeated: rows with equal sets
are one class, whatever their ids; a null id is greater than any other. ``deduplicate``
keeps one row of each component and every row without words. An empty table gives an empty
result. Other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bibloom.llm.common import column, documents, forget, small_batches, text_of, tidy, whole_row, written
from bibloom.llm.shingles import band_keys, fingerprint, least_matches, shingle_set, signature, similar_enough

WIDTH = 5
PERCENT = 80
BANDS, ROWS = 40, 6
SEED = 5
BATCH = 40
MISS = 1e-6
#: In a bucket of so many, its least and its greatest member have met everyone
FAN = 2
SLOTS = 1 << 20
BROADCAST_ROWS = 200_000


def text_keys(text: Column) -> list[Column]:
    """128 bits that name a text among those of one id."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(SEED), text).alias("t2")]


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(id, t1, t2, n_shingles, a, b, bands, sig) of every row: (a, b) is the set's fingerprint, bands its bucket keys."""

    def sketch(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            sizes, prints, bands, sigs = [], [], [], []
            for text in part.column("content").to_pylist():
                found = shingle_set(text, width)
                sizes.append(len(found))
                prints.append(fingerprint(found))
                if len(found):
                    sig = signature(found, BANDS * ROWS, SEED)
                    bands.append(band_keys(sig, BANDS))
                    sigs.append(sig.astype(np.uint8).tobytes())
                else:
                    sigs.append(None)
            ends = np.cumsum([0] + [BANDS if n else 0 for n in sizes]).astype(np.int32)
            flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
            a, b = np.array(prints, np.int64).reshape(-1, 2).T
            columns = [pa.array(sizes, pa.int64()), pa.array(a), pa.array(b), pa.ListArray.from_arrays(pa.array(ends), flat), pa.array(sigs, pa.binary())]
            yield pa.RecordBatch.from_arrays([*map(part.column, ("id", "t1", "t2")), *columns], ["id", "t1", "t2", "n_shingles", "a", "b", "bands", "sig"])

    text = text_of(text_col)
    rows = docs.select(column(id_col).alias("id"), *text_keys(text), text.alias("content"))
    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType)])
    for name in ("t1", "t2", "n_shingles", "a", "b"):
        schema.add(name, T.LongType())
    return rows.mapInArrow(sketch, schema.add("bands", T.ArrayType(T.LongType())).add("sig", T.BinaryType()))


def classes_of(sketched: DataFrame) -> DataFrame:
    """(a, b, n_shingles, rep, bands, sig): each different non-empty set once, with its smallest id."""
    return (
        sketched.filter("n_shingles > 0")
        .groupBy("a", "b", "n_shingles")
        .agg(F.min("id").alias("rep"), F.any_value("bands").alias("bands"), F.any_value("sig").alias("sig"))
    )


def crowded(classes: DataFrame) -> DataFrame:
    """(bucket, a, low, high, size) of buckets with two members or more."""
    members = classes.select("a", F.explode("bands").alias("bucket"))
    held = members.groupBy("bucket").agg(F.min("a").alias("low"), F.max("a").alias("high"), F.count(F.lit(1)).alias("size")).filter("low < high")
    # from a table, so that both sides of the join are dealt anew and a hot bucket can be split
    held = written(held)
    found = written(members.join(held, "bucket"))
    forget(held)
    return found


def pruned(pairs: DataFrame, classes: DataFrame, percent: int, miss: float) -> DataFrame:
    """Candidate pairs (x, y) that the signatures don't refute, with both classes' keys and representatives."""
    bounds = least_matches(BANDS * ROWS, BATCH, percent / 100, miss)

    @F.pandas_udf("boolean")
    def stays(left: pd.Series, right: pd.Series) -> pd.Series:
        n = len(left)
        if not n:
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), np.uint8).reshape(n, -1) for s in (left, right))
        alive, matches = np.arange(n), np.zeros(n, np.int64)
        for k, least in enumerate(bounds):
            part = slice(k * BATCH, (k + 1) * BATCH)
            matches[alive] += (x[alive, part] == y[alive, part]).sum(axis=1)
            alive = alive[matches[alive] >= least]
        out = np.zeros(n, bool)
        out[alive] = True
        return pd.Series(out)

    side = lambda c: classes.select(F.col("a").alias(c), *[F.col(k).alias(f"{c}_{k}") for k in ("b", "n_shingles", "rep", "sig")])
    both = pairs.join(side("y"), "y").join(side("x"), "x")
    # a pair of such sizes cannot reach the threshold
    sized = both.filter(100 * F.least("x_n_shingles", "y_n_shingles") >= percent * F.greatest("x_n_shingles", "y_n_shingles"))
    return sized.filter(stays("x_sig", "y_sig")).drop("x_sig", "y_sig", "x_n_shingles", "y_n_shingles")


def sets_of(docs: DataFrame, needed: DataFrame, width: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, shingles) of the classes in needed (a, b, rep), a table, read again from their representatives' texts."""

    @F.pandas_udf("struct<a:bigint,b:bigint,shingles:binary>")
    def full(texts: pd.Series) -> pd.DataFrame:
        found = [shingle_set(t, width) for t in texts]
        return pd.DataFrame([(*fingerprint(s), s.tobytes()) for s in found], columns=["a", "b", "shingles"])

    # else an inferred null check on its fields would run it over every row before the join
    full = full.asNondeterministic()
    few = needed.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    reps = needed.select(F.col("rep").alias("r")).distinct()
    reps = F.broadcast(reps) if few else reps.hint("shuffle_hash")
    read = docs.select(column(id_col).alias("id"), text_of(text_col).alias("content")).join(reps, F.col("id").eqNullSafe(F.col("r")), "left_semi")
    sets = read.select(full("content").alias("f")).select("f.*")
    # repeated ids bring texts of other classes along, repeated rows the same set again
    return sets.join(needed.select("a", "b"), ["a", "b"], "left_semi").groupBy("a", "b").agg(F.any_value("shingles").alias("shingles"))


def verified(docs: DataFrame, alive: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A table of links (ax, bx, ay, by) between classes whose full sets are similar enough. x should be the side that repeats."""

    @F.pandas_udf("boolean")
    def similar(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([similar_enough(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(left, right)], dtype=bool)

    ends = [alive.select(F.col(c).alias("a"), F.col(f"{c}_b").alias("b"), F.col(f"{c}_rep").alias("rep")) for c in ("x", "y")]
    needed = written(ends[0].unionByName(ends[1]).distinct())
    sets = written(sets_of(docs, needed, width, id_col, text_col))
    left = sets.select(F.col("a").alias("x"), F.col("b").alias("x_b"), F.col("shingles").alias("sx"))
    right = sets.select(F.col("a").alias("y"), F.col("b").alias("y_b"), F.col("shingles").alias("sy"))
    both = alive.join(right, ["y", "y_b"]).join(left, ["x", "x_b"])
    links = written(both.filter(similar("sx", "sy")).select(F.col("x").alias("ax"), F.col("x_b").alias("bx"), F.col("y").alias("ay"), F.col("y_b").alias("by")))
    forget(needed, sets)
    return links


def components(links: DataFrame) -> DataFrame:
    """A table (node, label): the least node that each linked node reaches. links: (u, v).

    Labels fall to the least label among neighbours, then jump to their label's label, until none falls.
    """
    edges = written(links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = written(edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = edges.join(labels, edges.v == labels.node).groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(near, labels.node == near.u).select("node", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("beyond"))
        fresh = written(lower.join(jump, F.col("label") == F.col("at")).select("node", "old", F.least("label", "beyond").alias("label")))
        fell = not fresh.filter("label <> old").isEmpty()
        forget(labels)
        labels = fresh.select("node", "label")
        if not fell:
            forget(edges)
            return labels


def _node(a: str, b: str) -> Column:
    """A class as one value, by its whole fingerprint."""
    return F.concat(F.hex(F.col(a)), F.lit("-"), F.hex(F.col(b)))


def linked_components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A table (node, label) after new links; those known before stand for their components, so earlier links are not walked again."""
    ends = links.select(_node("ax", "bx").alias("u"), _node("ay", "by").alias("v"))
    if known is None:
        return components(ends)
    for end in ("u", "v"):
        own = known.select(F.col("node").alias(end), "label")
        ends = ends.join(own, end, "left").withColumn(end, F.coalesce("label", end)).drop("label")
    joined = components(ends.filter("u <> v"))
    beyond = joined.select(F.col("node").alias("label"), F.col("label").alias("least"))
    old = known.join(beyond, "label", "left").select("node", F.coalesce("least", "label").alias("label"))
    labels = written(old.unionByName(joined.join(known.select("node"), "node", "left_anti")))
    forget(joined, known)
    return labels


def _open_buckets(members: DataFrame, labels: DataFrame) -> DataFrame:
    """A table (bucket, a, low, high, size, label, low_label, high_label) of the buckets that span several components."""
    by_a = labels.select(F.conv(F.substring_index("node", "-", 1), 16, -10).cast("long").alias("a"), "label").groupBy("a").agg(F.min("label").alias("label"))
    # a table, so that a hot end can be split in the joins below
    by_a = written(by_a)
    named = members
    for key, name in (("a", "label"), ("low", "low_label"), ("high", "high_label")):
        own = by_a.select(F.col("a").alias(key), F.col("label").alias(name))
        named = named.join(own, key, "left").withColumn(name, F.coalesce(name, F.hex(key)))
    split = written(named.filter("label <> low_label").select("bucket").distinct())
    found = written(named.join(split, "bucket", "left_semi"))
    forget(split, by_a)
    return found


def _rare_pairs(docs: DataFrame, needed: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """A table of pairs (x, y) of different components among the classes in needed (a, b, rep, label); no similar pair is left out.

    Let t be the threshold and x the smaller set of a similar pair. In any common order of
    shingles one of the first n - ceil(2 t / (1 + t) n) + 1 of x is among the first
    m - ceil(t m) + 1 of y. The order is by frequency among these classes (counted in SLOTS
    hashed slots, a bounded table), so what a text alone has comes first and meets nothing.
    A shared shingle at places i and j of sets of n and m allows at most min(n - i, m - j)
    shared ones from there on; pairs for which that is too few are not made, nor pairs inside
    a shingle's most common component.
    """
    sets = sets_of(docs, needed.select("a", "b", "rep"), width, id_col, text_col).join(needed.select("a", "b", "label"), ["a", "b"])
    sets = written(sets)

    def tally(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SLOTS, np.int64)
        for part in parts:
            for s in part["shingles"]:
                np.add.at(counts, np.frombuffer(s, np.uint64) % np.uint64(SLOTS), 1)
        used = np.nonzero(counts)[0]
        yield pd.DataFrame({"slot": used, "n": counts[used]})

    counts = np.zeros(SLOTS, np.int64)
    for row in sets.select("shingles").mapInPandas(tally, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[row["slot"]] = row["n"]
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    @F.pandas_udf("struct<n:int,few:int,first:array<bigint>>")
    def rarest(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        counts = shared.value
        for part in parts:
            rows = []
            for raw in part:
                s = np.frombuffer(raw, np.uint64)
                order = np.lexsort((s, counts[s % np.uint64(SLOTS)]))
                n = len(s)
                rows.append((n, n + (-2 * percent * n) // (100 + percent) + 1, s[order[: n + (-percent * n) // 100 + 1]].view(np.int64)))
            yield pd.DataFrame({"n": [r[0] for r in rows], "few": [r[1] for r in rows], "first": pd.Series([r[2] for r in rows], dtype=object)})

    rows = sets.select("a", "label", rarest("shingles").alias("r")).select("a", "label", "r.n", "r.few", F.posexplode("r.first").alias("i", "shingle"))
    crowds = sets.groupBy("label").agg(F.count(F.lit(1)).alias("held"))
    rows = written(rows.join(crowds, "label"))
    # a shingle that one component or one class alone has meets nothing
    top = written(rows.groupBy("shingle").agg(F.max(F.struct("held", "label")).alias("top"), F.min("label").alias("l"), F.max("label").alias("h")).filter("l < h").select("shingle", F.col("top.label").alias("top")))
    named = written(rows.join(top, "shingle").withColumn("major", F.col("label") == F.col("top")).drop("top", "held"))
    side = lambda c, x: named.filter(c).select("shingle", *[F.col(k).alias(f"{k}_{x}") for k in ("a", "n", "i", "label")])
    index, probe = "i < few", "true"
    most = F.least(F.col("n_x") - F.col("i_x"), F.col("n_y") - F.col("i_y"))
    enough = (100 + percent) * most >= percent * (F.col("n_x") + F.col("n_y"))
    fits = (F.col("label_x") != F.col("label_y")) & (F.struct("n_x", "a_x") < F.struct("n_y", "a_y")) & (100 * F.col("n_x") >= percent * F.col("n_y")) & enough
    parts = [side(index + " and not major", "x").join(side(probe, "y"), "shingle").filter(fits), side(index + " and major", "x").join(side("not major", "y"), "shingle").filter(fits)]
    met = written(parts[0].unionByName(parts[1]).select(F.least("a_x", "a_y").alias("x"), F.greatest("a_x", "a_y").alias("y")).distinct())
    shared.unpersist()
    forget(sets, rows, top, named)
    return met


def near_components(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text", miss: float = MISS
) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; kept: the row has the component's smallest id."""
    with small_batches(docs.sparkSession), tidy(docs.sparkSession):
        sketched, decided = _near_components(docs, width, percent, id_col, text_col, miss)
    rows = sketched.select("id", "n_shingles", "a", "b").join(decided, ["a", "b"], "left")
    component = F.when(F.col("n_shingles") == 0, F.col("id")).otherwise(F.col("component_id"))
    return rows.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id")).withColumn(
        "kept", column(id_col).eqNullSafe(F.col("component_id"))
    )


def _near_components(docs: DataFrame, width: int, percent: int, id_col: str, text_col: str, miss: float) -> tuple[DataFrame, DataFrame]:
    """Tables (id, t1, t2, n_shingles, a, b) of every row and (a, b, label, component_id) of every class."""
    sketched = written(sketches(docs, width, id_col, text_col))
    classes = written(classes_of(sketched))
    narrow = written(sketched.drop("bands", "sig"))
    forget(sketched)
    members = crowded(classes)

    def links_of(pairs: DataFrame) -> DataFrame:
        alive = written(pruned(pairs, classes, percent, miss))
        links = verified(docs, alive, width, percent, id_col, text_col)
        forget(alive)
        return links

    tried = written(members.filter("a <> low").groupBy(F.col("a").alias("y")).agg(F.min("low").alias("x")))
    labels = linked_components(links_of(tried))
    left = _open_buckets(members, labels)
    forget(members)
    if not left.isEmpty():
        star = lambda end: left.filter(f"a <> {end} and label <> {end}_label").select(F.least("a", end).alias("x"), F.greatest("a", end).alias("y"))
        pairs = written(star("low").unionByName(star("high")).distinct().join(tried, ["x", "y"], "left_anti"))
        tried = written(tried.unionByName(pairs))
        labels = linked_components(links_of(pairs), labels)
        again = _open_buckets(left.drop("label", "low_label", "high_label"), labels).filter(F.col("size") > FAN).filter("a <> low and a <> high")
        forget(left)
        if not again.isEmpty():
            needed = written(again.groupBy("a").agg(F.min("label").alias("label")).join(classes.select("a", "b", "rep"), "a"))
            pairs = written(_rare_pairs(docs, needed, width, percent, id_col, text_col).join(tried, ["x", "y"], "left_anti"))
            labels = linked_components(links_of(pairs), labels)

    named = classes.select("a", "b", "rep", _node("a", "b").alias("node")).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = written(named.drop("node"))
    smallest = written(named.groupBy("label").agg(F.min("rep").alias("component_id")))
    decided = written(named.join(smallest, "label").select("a", "b", "label", "component_id"))
    forget(classes, named, smallest, labels)
    return narrow, decided


def deduplicate(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns: of each component the row with the smallest id, of rows that repeat it one."""
    with small_batches(docs.sparkSession), tidy(docs.sparkSession):
        sketched, decided = _near_components(docs, width, percent, id_col, text_col, MISS)
        order = F.struct(F.col("id").isNull().alias("none"), "id", "t1", "t2")
        rows = sketched.filter("n_shingles > 0").join(decided.select("a", "b", "label"), ["a", "b"]).select("label", "id", "t1", "t2")
        best = written(rows.groupBy("label").agg(F.min(order).alias("best")))
        same = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("t1") == F.col("best.t1")) & (F.col("t2") == F.col("best.t2"))
        marked = rows.join(best, "label").groupBy("id", "t1", "t2").agg(F.bool_or(same).alias("stays"), F.count(F.lit(1)).alias("copies")).filter("not stays or copies > 1")
        marked = written(marked.select(F.col("id").alias("d_id"), F.col("t1").alias("d1"), F.col("t2").alias("d2"), "stays"))
        forget(sketched, decided, best)
    few = marked.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    side = F.broadcast(marked) if few else marked.hint("shuffle_hash")
    keyed = docs.select(whole_row(docs).alias("row"), column(id_col).alias("id"), *text_keys(text_of(text_col)))
    met = F.col("id").eqNullSafe(F.col("d_id")) & (F.col("t1") == F.col("d1")) & (F.col("t2") == F.col("d2"))
    out = keyed.join(side, met, "left_anti").select("row")
    if not marked.filter("stays").isEmpty():
        repeated = keyed.join(side.filter("stays"), met, "left_semi").groupBy("id", "t1", "t2").agg(F.any_value("row").alias("row"))
        out = out.unionByName(repeated.select("row"))
    return out.select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    return near_components(documents(spark, sf_dir), width=4)
