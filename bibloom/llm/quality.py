"""Quality classification by nearest-neighbour voting in a latent-semantic space.

A text's terms are its words, which carry most of its vector, the shapes of its words, how
much of it repeats, and its length class, each block a tf-idf vector over hashed or fixed
terms. Document frequencies come from the whole corpus. A bounded sample of labelled rows
(``MAX_LABELLED``, by a hash of the id) gives the latent axes (the leading singular vectors
of the sample's matrix, by subspace iteration from a seeded start) and the labelled vectors, which are broadcast: their size is bounded by MAX_LABELLED x
DIMENSIONS numbers. Every document is then compared with every labelled vector by blocks of
exact cosine products, and the labels of its nearest ones vote, weighted by similarity.

Labels are learnt from rows whose crc32(id as text) mod 5 is not 0; label, language, source
and id are no inputs of a score.

Defined cases. A null text counts as empty and is scored like any text. A null id is held
out by no rule (held_out false) and has no label. An id labelled more than once counts with
the mean of its labels; null labels are left out. Without labels every score is 0.5. Ids
may be repeated. An empty table gives an empty result.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bibloom.llm.common import column, documents, labels, text_of

MAX_LABELLED = 8192
DIMENSIONS = 64
NEIGHBOURS = 15
SHARPNESS = 24
THRESHOLD = 0.3
FOLDS = 5
BLOCK = 256
WORDS, SHAPES, STEPS, LENGTHS = 4096, 256, 11, 24
#: Blocks of terms: size and weight
BLOCKS = ((WORDS, 1.0), (SHAPES, 0.5), (STEPS, 0.4), (STEPS, 0.4), (STEPS, 0.4), (LENGTHS, 0.1))
TERMS = sum(n for n, _ in BLOCKS)
CACHE = 300_000
#: Further directions and rounds of the subspace iteration
SPARE, ROUNDS = 16, 8
SCORE = "__score"

_KNOWN: dict[str, tuple[int, int]] = {}


def shape(word: str) -> str:
    """Capitals as A, other letters as a, digits as 0, longer runs as two."""
    kinds = "".join("A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c for c in word)
    return re.sub(r"(.)\1+", r"\1\1", kinds)


def _terms_of(word: str) -> tuple[int, int]:
    if len(_KNOWN) >= CACHE:
        _KNOWN.clear()
    found = zlib.crc32(word.lower().encode()) % WORDS, WORDS + zlib.crc32(shape(word).encode()) % SHAPES
    if len(word) <= 64:
        _KNOWN[word] = found
    return found


def _step(share: float) -> int:
    return min(STEPS - 1, int(np.ceil((STEPS - 1) * share)))


def term_counts(text: str) -> np.ndarray:
    words = text.split()
    known, distinct = _KNOWN, Counter(words)
    found: list[int] = []
    for w in distinct:
        found += known.get(w) or _terms_of(w)
    times = np.repeat(np.fromiter(distinct.values(), np.float64, len(distinct)), 2)
    counts = np.bincount(np.array(found, np.int64), times, TERMS).astype(np.float32)
    n = len(words)
    lines = [x for x in text.split("\n") if x.strip()]
    at = WORDS + SHAPES
    counts[at + _step(1 - len(distinct) / max(1, n))] = 1
    counts[at + STEPS + _step(sum(map(str.__eq__, words, words[1:])) / max(1, n - 1))] = 1
    counts[at + 2 * STEPS + _step(1 - len(set(lines)) / max(1, len(lines)) if lines else 0)] = 1
    counts[at + 3 * STEPS + min(LENGTHS - 1, (n + 1).bit_length() - 1)] = 1
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """tf-idf rows in the place of the counts, each block of unit length times its weight."""
    out = np.log1p(counts, out=counts)
    out *= idf
    at = 0
    for size, weight in BLOCKS:
        part = out[:, at : at + size]
        part *= weight / np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-9)
        at += size
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def fold(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % FOLDS


def inverse_frequencies(docs: DataFrame, text_col: str) -> np.ndarray:
    """log((1 + N) / (1 + df)) of each term over all documents; each task gives one row a term."""

    def count(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        df, n = np.zeros(TERMS, np.int64), 0
        for part in parts:
            for text in part["text"]:
                df += term_counts(text) > 0
                n += 1
        if n:
            yield pd.DataFrame({"term": np.arange(-1, TERMS), "n": np.concatenate([[n], df])})

    texts = docs.select(text_of(text_col).alias("text"))
    rows = texts.mapInPandas(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(TERMS + 1)
    for r in rows:
        df[r["term"] + 1] = r["n"]
    return np.log((1 + df[0]) / (1 + df[1:])).astype(np.float32)


def labelled_sample(docs: DataFrame, marks: DataFrame, label_col: str, id_col: str, text_col: str, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of at most ``most`` labelled rows outside the held-out fold."""
    usable = marks.select(column(id_col).alias("k"), column(label_col).cast("double").alias("y")).filter("k is not null and y is not null")
    usable = usable.filter(fold("k") != 0).groupBy("k").agg(F.avg("y").alias("y"))
    chosen = usable.orderBy(F.xxhash64("k"), "k").limit(most)

    @F.pandas_udf("at binary, n binary")
    def counted(texts: pd.Series) -> pd.DataFrame:
        counts = [term_counts(t) for t in texts]
        at = [np.nonzero(c)[0] for c in counts]
        return pd.DataFrame({"at": [a.astype(np.int32).tobytes() for a in at], "n": [c[a].tobytes() for c, a in zip(counts, at)]})

    # the chosen rows are at most ``most``; copies of an id count once
    held = docs.select(column(id_col).alias("k"), text_of(text_col).alias("t")).join(F.broadcast(chosen), "k")
    rows = held.groupBy("k", "y").agg(F.min("t").alias("t")).select("k", "y", counted("t").alias("v")).orderBy("k").collect()
    x = np.zeros((len(rows), TERMS), np.float32)
    for row, r in zip(x, rows):
        row[np.frombuffer(r["v"]["at"], np.int32)] = np.frombuffer(r["v"]["n"], np.float32)
    return x, np.array([r["y"] for r in rows], np.float32)


def latent_axes(rows: np.ndarray, dimensions: int) -> np.ndarray:
    """The leading right singular vectors by subspace iteration, so that no matrix of terms by terms is made; signs fixed."""
    width = min(dimensions + SPARE, rows.shape[1])
    basis = np.linalg.qr(np.random.default_rng(5).normal(size=(rows.shape[1], width)))[0].astype(np.float32)
    for _ in range(ROUNDS):
        basis = np.linalg.qr(rows.T @ (rows @ basis))[0]
    seen = (rows @ basis).astype(np.float64)
    vectors = np.linalg.eigh(seen.T @ seen)[1][:, ::-1][:, :dimensions]
    axes = basis @ vectors
    return (axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])])).astype(np.float32)


def vote(vectors: np.ndarray, labelled: np.ndarray, y: np.ndarray, neighbours: int, sharpness: float) -> np.ndarray:
    """The nearest labels' mean, weighted by similarity to the power ``sharpness``."""
    if not len(y):
        return np.full(len(vectors), 0.5)
    similar = vectors @ labelled.T
    k = min(neighbours, len(y))
    top = np.argpartition(-similar, k - 1, axis=1)[:, :k]
    near = np.clip(np.take_along_axis(similar, top, axis=1), 0, 1).astype(np.float64)
    weights = (near / np.maximum(near.max(axis=1, keepdims=True), 1e-9)) ** sharpness + 1e-12
    return (weights * y[top]).sum(axis=1) / weights.sum(axis=1)


def score(
    docs: DataFrame, marks: DataFrame, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text",
    most: int = MAX_LABELLED, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS,
    keep: dict[str, str] | None = None,
) -> DataFrame:
    """(id, score) of every row: how likely its label is 1. ``keep`` maps names of the result to other columns of docs instead of the id."""
    idf = inverse_frequencies(docs, text_col)
    x, y = labelled_sample(docs, marks, label_col, id_col, text_col, most)
    rows = weighted(x, idf)
    axes = latent_axes(rows, dimensions)
    model = docs.sparkSession.sparkContext.broadcast((idf, axes, unit(rows @ axes), y))

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        idf, axes, labelled, y = model.value
        for texts in parts:
            out = np.empty(len(texts))
            for at in range(0, len(texts), BLOCK):
                counts = np.array([term_counts(t) for t in texts.iloc[at : at + BLOCK]]).reshape(-1, TERMS)
                out[at : at + BLOCK] = vote(unit(weighted(counts, idf) @ axes), labelled, y, neighbours, sharpness)
            yield pd.Series(np.round(np.clip(out, 0, 1), 6))

    return docs.select(*[column(c).alias(a) for a, c in (keep or {id_col: id_col}).items()], scored(text_of(text_col)).alias(SCORE))


def keep_good(docs: DataFrame, marks: DataFrame, threshold: float = THRESHOLD, **settings) -> DataFrame:
    """The rows whose score reaches the threshold, with their own columns."""
    names = docs.columns
    # numbered names cannot clash with the score's
    found = score(docs, marks, keep={f"c{i}": c for i, c in enumerate(names)}, **settings).filter(F.col(SCORE) >= threshold)
    return found.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(names)])


def query(spark, sf_dir: str) -> DataFrame:
    found = score(documents(spark, sf_dir), labels(spark, sf_dir))
    return found.select(
        "doc_id",
        F.coalesce(fold("doc_id") == 0, F.lit(False)).alias("held_out"),
        F.col(SCORE).alias("score"),
        F.when(F.col(SCORE) >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )
