import pytest
from pyspark.sql import functions as F

from bibloom.llm import license_scan, pii, secret_scan

from . import cases


@pytest.fixture(scope="module")
def small(spark, sf_dir):
    docs = cases.documents(spark, extra=False)
    real = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id") + 1000)
    return docs.unionByName(real).cache()


@pytest.fixture(scope="module")
def folder(small, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("scans"))
    small.write.parquet(f"{path}/documents.parquet")
    return path


def test_secrets_against_brute_force(spark, small, folder):
    got = {r["doc_id"]: r for r in secret_scan.query(spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        want = cases.secrets(t)
        for kind in ("assign", "access", "hex"):
            assert got[k][f"n_{kind}"] == sum(s[0] == kind for s in want), (k, kind)
        base = cases.base_text(want, ["assign", "access", "hex"])
        assert got[k]["base_sha256"] == cases.sha(base)
        assert set(filter(None, base.split(","))) <= set(got[k]["spans"].split(","))
    assert "pem:" in got[17]["spans"] and "jwt:" in got[17]["spans"]


def test_ledger_scans_only_what_it_lacks(spark):
    docs = cases.documents(spark)
    found, added = secret_scan.scan(docs)
    assert added.count() == len({t or "" for t in cases.TEXTS})
    again, none = secret_scan.scan(docs, added)
    assert none.count() == 0
    assert sorted(map(str, again.collect())) == sorted(map(str, found.collect()))
    raised = tuple(secret_scan.Rule(r.kind, r.pattern, r.group, r.least, r.needs, 2 if r.kind == "hex" else 1) for r in secret_scan.RULES)
    _, hexes = secret_scan.scan(docs, added, raised)
    assert {tuple(r["rules"]) for r in hexes.collect()} == {("hex@2",)}
    more = docs.unionByName(docs.limit(1).withColumns({"doc_id": F.lit(99).cast("long"), "text": F.lit("token=abcdefgh")}))
    _, one = secret_scan.scan(more, added)
    assert one.count() == 1


def test_redaction_keeps_rows_and_columns(spark):
    docs = cases.documents(spark)
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    text = {r["doc_id"]: r["text"] for r in out.collect()}
    assert text[0] is None and text[4] == cases.TEXTS[4]
    assert "24be64439e3e" not in text[6] and "[SECRET]" in text[6] and "AKIASHORT" in text[7]


def test_personal_data_against_brute_force(spark, small, folder):
    got = {r["doc_id"]: r for r in pii.query(spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    assert got.keys() == texts.keys()
    for k, t in texts.items():
        want = cases.personal(t)
        for kind in pii.KINDS:
            assert got[k][f"n_{kind}"] == sum(s[0] == kind for s in want), (k, kind, (t or "")[:60])
        base = cases.base_text(want, list(pii.KINDS))
        assert got[k]["base_sha256"] == cases.sha(base), k
        assert set(filter(None, base.split(","))) <= set(got[k]["spans"].split(","))
        if not want:
            assert got[k]["spans"] == ""


def test_disclosing_terms_against_brute_force(spark):
    import math
    import re
    from collections import Counter, defaultdict

    texts = [f"alpha beta{i % 2} zed@corp.example quorzel common{i}" for i in range(5)] + ["alpha common word here"] * 4 + ["quorzel2 10.1.1.1"] * 5 + [None, ""]
    docs = cases.documents(spark, texts)
    words = lambda t: {w for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower()) if len(w) >= 4}
    n, n_t, n_e, n_et, kinds, pair_kinds = len(texts), Counter(), Counter(), Counter(), defaultdict(set), defaultdict(set)
    for t in texts:
        n_t.update(words(t))
        for e in {(k, (t or "")[a:b]) for k, a, b in cases.personal(t)}:
            n_e[e] += 1
            kinds[e].add(t)
            for w in words(t):
                n_et[e, w] += 1
                pair_kinds[e, w].add(t)
    strong = {(e, w) for (e, w), c in n_et.items() if len(kinds[e]) >= 3 and len(pair_kinds[e, w]) >= 3 and math.log(n * c / (n_e[e] * n_t[w])) >= 0.95 * math.log(n / n_e[e])}
    assert strong
    found = {r["doc_id"]: r["spans"] for r in pii.find(docs).collect()}
    for i, t in enumerate(texts):
        own = {w for e, w in strong if e in {(k, (t or "")[a:b]) for k, a, b in cases.personal(t)}}
        held = [(a, b) for _, a, b in cases.personal(t)]
        want = sorted(
            m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t or "")
            if m[0].lower() in own and not any(a < m.end() and m.start() < b for a, b in held)
        )
        assert sorted((s["start"], s["end"]) for s in found[i] if s["kind"] == "term") == want, i
    out = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert out[0] == "alpha  [EMAIL]  common0" and out[5] == texts[5] and out[14] is None
    assert pii.sanitise(docs).columns == docs.columns


def test_licences_against_brute_force(spark, small, folder):
    got = {r["doc_id"]: r for r in license_scan.query(spark, folder).collect()}
    texts = {r["doc_id"]: r["text"] for r in small.collect()}
    for k, t in texts.items():
        n, starts, labels = cases.licences(t)
        r = got[k]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (n, len(starts), labels), k
        assert (r["first_word"], r["last_word"]) == ((min(starts), max(starts)) if starts else (None, None))
        assert set(filter(None, labels.split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert got[15]["labels"] == "gpl-3,mit" and got[15]["score"] == 1.0 and got[4]["labels"] == ""


def test_licence_needs_its_key_phrase(spark):
    texts = ["it is released under the apple license", "we licensed under the gnu general public licence version 3", "this work is licensed under the gnu general public license version 3"]
    got = [r["matches"] for r in license_scan.scan(cases.documents(spark, texts)).orderBy("doc_id").collect()]
    assert got[0] == [] and got[1] == [] and [m["label"] for m in got[2]] == ["gpl-3"]


def test_empty_tables(spark):
    none = cases.documents(spark).limit(0)
    assert license_scan.scan(none).count() == 0
    assert pii.find(none).count() == 0
    assert secret_scan.scan(none)[0].count() == 0
    assert secret_scan.redact(none).count() == 0 and pii.sanitise(none).count() == 0
