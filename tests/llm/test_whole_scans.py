"""Cases where the scans once did less than the whole job."""

import re

from bibloom.llm import pii

from . import cases

FILLER = ["plain words of no interest", "more plain words of no interest at all"]


def _folder(spark, tmp_path, texts):
    path = str(tmp_path / "scan")
    cases.documents(spark, texts, extra=False).write.parquet(f"{path}/documents.parquet")
    return path


def terms_in(row, text):
    found = [s.split(":") for s in row["spans"].split(",") if s]
    return {text[int(a) : int(b)] for kind, a, b in found if kind == "term"}


def test_terms_of_entities_in_one_text_are_found(spark, tmp_path):
    texts = ["call Li Quorzel zed@corp.example with plain words"] + FILLER * 20
    got = {r["doc_id"]: r for r in pii.query(spark, _folder(spark, tmp_path, texts)).collect()}
    assert terms_in(got[0], texts[0]) == {"call", "Li", "Quorzel", "with"}
    assert all(got[i]["spans"] == "" for i in range(1, len(texts)))


def test_terms_are_found_in_texts_without_the_entity(spark):
    texts = [f"quorzel {i} zed@corp.example plain" for i in range(9)] + ["quorzel told plain words"] + FILLER * 400
    docs = cases.documents(spark, texts, extra=False)
    for support in (1, 3):
        found = {r["doc_id"]: r["spans"] for r in pii.find(docs, support=support).collect()}
        assert [(s["kind"], s["start"], s["end"]) for s in found[9]] == [("term", 0, 7)]
        assert all(found[i] == [] for i in range(10, len(texts)))
    assert {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}[9] == " told plain words"


def test_many_entities_and_many_terms_in_one_text(spark):
    text = " ".join(f"word{i} user{i}@corp{i}.example" for i in range(200))
    found = pii.find(cases.documents(spark, [text] + FILLER, extra=False), support=1).orderBy("doc_id").first()
    assert len(found["entities"]) == 200
    assert sum(s["kind"] == "term" for s in found["spans"]) == 200


def test_very_long_texts(spark):
    words = " ".join(f"word{i}" for i in range(20000)) + " mail zed@corp.example"
    addresses = " ".join(f"user{i}@corp{i}.example" for i in range(3000))
    got = {r["doc_id"]: r for r in pii.find(cases.documents(spark, [words, addresses] + FILLER, extra=False), support=1).collect()}
    ends = [m.span() for m in re.finditer("[a-z0-9]+", words) if m[0] not in ("zed", "corp", "example")]
    assert [(s["start"], s["end"]) for s in got[0]["spans"] if s["kind"] == "term"] == ends
    assert [s["start"] for s in got[1]["entities"]] == [m.start() for m in re.finditer(r"user", addresses)]
