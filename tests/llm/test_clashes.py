"""Names that helpers might use, null ids and repeated ids, in every operator that keeps rows."""

import pytest
from pyspark.sql import functions as F

from bibloom.llm import exact_dedup, near_dedup, pii, quality, secret_scan

NAMES = (
    "__digest __id __blob __b __spans __sha __s __out __score __gone row rest none rank t1 t2 sha s out blob b d1 d2 d_id digest salt content "
    "entities spans best copies stays label id a text.old c0 c1"
).split()
SAME, OTHER, LONE = "a b c d e f g", "other text entirely here and so on", "no id and no like of it anywhere"
ROWS = [(None, SAME), (None, SAME), (None, LONE), (1, SAME), (1, SAME), (1, OTHER), (2, ""), (3, None), (4, "token=abcdefgh12 and more"), (5, "mail zed@corp.example now")]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string").repartition(3)
    return df.select("doc_id", *[F.lit(n).alias(n) for n in NAMES], "text")


def rows(df, docs):
    assert df.columns == docs.columns
    found = df.collect()
    assert all(r[n] == n for r in found for n in NAMES)
    return sorted(((r["doc_id"], r["text"]) for r in found), key=str)


def want(*kept):
    return sorted(kept, key=str)


def test_exact_dedup(docs):
    assert rows(exact_dedup.deduplicate(docs), docs) == want((None, LONE), (1, SAME), (1, OTHER), (3, None), *ROWS[8:])


def test_near_dedup(docs):
    assert rows(near_dedup.deduplicate(docs), docs) == want((None, LONE), (1, SAME), (1, OTHER), (2, ""), (3, None), *ROWS[8:])
    found = near_dedup.near_components(docs).collect()
    assert len(found) == len(ROWS) and {r["component_id"] for r in found if r["doc_id"] is None} == {1, None}


def test_redact_and_sanitise(docs):
    assert rows(secret_scan.redact(docs), docs) == want(*ROWS[:8], (4, "[SECRET] and more"), ROWS[9])
    assert rows(pii.sanitise(docs), docs) == want(*ROWS[:9], (5, "mail [EMAIL] now"))


def test_quality(spark, docs):
    marks = spark.createDataFrame([(1, 1), (5, 0)], "doc_id long, quality int")
    assert rows(quality.keep_good(docs, marks, threshold=0.0), docs) == want(*ROWS)


def test_null_and_repeated_ids_in_scans(docs):
    groups = {(r["doc_id"], r["group_size"]) for r in exact_dedup.exact_groups(docs).collect()}
    assert groups == {(None, 4), (None, 1), (1, 4), (1, 1), (2, 2), (3, 2), (4, 1), (5, 1)}
    assert secret_scan.scan(docs)[0].count() == pii.find(docs).count() == len(ROWS)
