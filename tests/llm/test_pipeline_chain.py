"""The pipeline's five stages one after another on awkward tables, against plain Python."""

import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from bibloom.llm import packing

from . import cases

NAMES = "row rest id label spans blob digest text.old __score __out c0 batch".split()
BODY = " ".join(f"word{i}" for i in range(80))
EXTRA = [
    (None, "plain words only"), (None, None), (None, "no id and no like of it"), (None, "no id and no like of it"),
    (7, cases.TEXTS[7]), (7, cases.TEXTS[7]), (6, cases.TEXTS[6] + " again"), (4, "another text under the same id"),
    (200, BODY), (201, BODY.upper() + " tail"), (202, "head " + BODY), (203, BODY), (204, "Password: hunter2hunter2 " + BODY), (None, BODY + " end"),
]


def rank(key):
    return (key is None, key if key is not None else 0)


def single(rows):
    """One row of equal texts, null being empty: the largest id, a null one last."""
    best = {}
    for key, text in rows:
        held = best.get(text or "")
        if held is None or (held[0] is None and key is not None) or (held[0] is not None and key is not None and key > held[0]):
            best[text or ""] = (key, text)
    return list(best.values())


def apart(rows):
    """A set for each component of texts that share 80 % of their five-word shingles: the rows of its smallest id, of which one stays."""
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    groups = {}
    for i, row in enumerate(rows):
        groups.setdefault(top(i), []).append(row)
    least = [min(rank(r[0]) for r in g) for g in groups.values()]
    return [{r for r in g if rank(r[0]) == n} for g, n in zip(groups.values(), least)]


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=lambda r: (rank(r[0]), r[1] is None, r[1] or ""))


def ordered(rows):
    return sorted(rows, key=lambda r: (rank(r[0]), r[1] is None, r[1] or ""))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("chain"))
    rows = [*enumerate(cases.TEXTS), *EXTRA]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    docs.select("doc_id", *[F.lit(n).alias(n) for n in NAMES], "text", F.lit(None).cast("string").alias("lang")).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_chain_on_awkward_rows(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stage, names, rows = dict(corpus_pipeline.STAGES), docs.columns, [*enumerate(cases.TEXTS), *EXTRA]
    good = stage["quality_classifier"](spark, docs, folder).cache()
    assert good.columns == names and pairs(good) == ordered(rows)  # without labels every score is 0.5
    one = stage["exact_dedup"](spark, good, folder).cache()
    rows = single(rows)
    assert one.columns == names and pairs(one) == ordered(rows)
    lone = stage["minhash_near_dedup"](spark, one, folder).cache()
    choices, rows = apart(rows), pairs(lone)
    assert lone.columns == names and len(rows) == len(choices) and all(sum(r in c for r in rows) == 1 for c in choices)
    clean = stage["secret_scan"](spark, lone, folder).cache()
    found = pairs(clean)
    assert clean.columns == names and Counter(k for k, _ in found) == Counter(k for k, _ in rows)
    assert all(not cases.secrets(t) for _, t in found)
    untouched = [r for r in rows if not cases.secrets(r[1]) and "PRIVATE KEY" not in (r[1] or "")]
    assert not Counter(untouched) - Counter(found)
    assert {tuple(r[n] for n in NAMES) for r in clean.select(*[f"`{n}`" for n in NAMES]).collect()} == {tuple(NAMES)}
    packed = [tuple(r) for r in stage["packing"](spark, clean, folder).select("doc_id", "seq", "first_token", "n_tokens").collect()]
    assert {k for k, *_ in packed} == {k for k, _ in rows} and max(n for *_, n in packed) <= packing.MAX_TOKENS
    ids = Counter(k for k, _ in rows)
    for key in ids:
        if ids[key] == 1:  # the pieces of a document follow each other
            ends = 0
            for _, seq, first, n in sorted(p for p in packed if p[0] == key):
                assert first == ends
                ends += n
    whole = corpus_pipeline.run(spark, folder).select("doc_id", "seq", "first_token", "n_tokens").collect()
    assert Counter(tuple(r) for r in whole) == Counter(packed)
