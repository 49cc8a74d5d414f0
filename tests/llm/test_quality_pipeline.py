import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from bibloom.llm import exact_dedup, near_dedup, quality, secret_scan

from . import cases


def test_vote_against_brute_force():
    rng = np.random.default_rng(0)
    a, b, y = quality.unit(rng.normal(size=(40, 8))), quality.unit(rng.normal(size=(90, 8))), rng.integers(0, 2, 90).astype(np.float32)
    got = quality.vote(a, b, y, 5, 24)
    for i in range(40):
        s = b @ a[i]
        top = np.argsort(-s)[:5]
        w = (np.clip(s[top], 0, 1) / s[top].max()) ** 24
        assert abs(got[i] - (w * y[top]).sum() / w.sum()) < 1e-4
    assert (quality.vote(a, b[:0], y[:0], 5, 24) == 0.5).all()


def test_words_carry_most_of_a_vector(spark):
    texts = [r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()]
    counts = np.array([quality.term_counts(t) for t in texts])
    for t, c in zip(texts[:50], counts):
        words, want = t.split(), np.zeros(quality.WORDS)
        for w in words:
            want[zlib.crc32(w.lower().encode()) % quality.WORDS] += 1
        assert (c[: quality.WORDS] == want).all()
    idf = np.log((1 + len(texts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32)
    rows = quality.weighted(counts, idf)
    assert (rows[:, : quality.WORDS] ** 2).sum() > 0.5 * (rows**2).sum()


def test_axes_against_a_whole_decomposition():
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(300, 20)) * 2.0 ** -np.arange(20)) @ rng.normal(size=(20, 500)) + 1e-4 * rng.normal(size=(300, 500))
    values, vectors = np.linalg.svd(rows)[1:]
    axes = quality.latent_axes(rows.astype(np.float32), 8)
    assert np.allclose(np.abs((axes * vectors[:8].T).sum(axis=0)), 1, atol=1e-3)
    assert np.allclose(np.linalg.norm(rows @ axes, axis=0), values[:8], rtol=1e-3)
    assert quality.latent_axes(np.zeros((0, quality.TERMS), np.float32), 8).shape == (quality.TERMS, 8)


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    rows = quality.query(spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    good = np.array([r["score"] for r in held if r["quality"] == 1])
    bad = np.array([r["score"] for r in held if r["quality"] == 0])
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert np.mean([r["predicted"] == r["quality"] for r in held]) > 0.95


def test_awkward_rows_and_labels(spark):
    docs = cases.documents(spark)
    marks = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (999, 1)], "doc_id long, quality int")
    assert quality.score(docs, marks).count() == len(cases.TEXTS)
    none = quality.score(docs, marks.limit(0)).collect()
    assert {r["__score"] for r in none} == {0.5}
    assert quality.score(docs.limit(0), marks).count() == 0
    kept = quality.keep_good(docs, marks.limit(0))
    assert kept.columns == docs.columns and kept.count() == docs.count()


def test_pipeline_stages_agree_with_their_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    names = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "exact_dedup", "minhash_near_dedup", "secret_scan", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    scores = {r["doc_id"]: r["score"] for r in quality.query(spark, sf_dir).collect()}
    good = stage["quality_classifier"](spark, docs, sf_dir).cache()
    assert good.columns == names and {r["doc_id"] for r in good.collect()} == {k for k, s in scores.items() if s >= quality.THRESHOLD}
    single = stage["exact_dedup"](spark, good, sf_dir).cache()
    keep = {}
    for r in good.collect():
        keep[r["text"]] = max(keep.get(r["text"], -1), r["doc_id"])
    assert single.columns == names and {r["doc_id"] for r in single.collect()} == set(keep.values())
    apart = stage["minhash_near_dedup"](spark, single, sf_dir).cache()
    assert apart.columns == names
    decided = {r["doc_id"] for r in near_dedup.near_components(single).filter("kept").collect()}
    assert {r["doc_id"] for r in apart.collect()} == decided
    clean = stage["secret_scan"](spark, apart, sf_dir).cache()
    assert clean.columns == names and clean.count() == apart.count()
    before = {r["doc_id"]: r["text"] for r in apart.collect()}
    for r in clean.collect():
        assert (r["text"] == before[r["doc_id"]]) == (not cases.secrets(before[r["doc_id"]]))
    packed = stage["packing"](spark, clean, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(before)
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_duplicate_stages_on_an_empty_table(spark, sf_dir):
    none = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for _, f in corpus_pipeline.STAGES:
        none_out = f(spark, none, sf_dir)
        assert none_out.count() == 0
    assert exact_dedup.exact_groups(none).count() == 0 and secret_scan.scan(none)[0].count() == 0
    assert none.select(F.lit(1)).count() == 0
