"""A document with more notices than the scan once looked up."""

from bibloom.llm import license_scan

from . import cases

FILLER = ["plain words of no interest", "more plain words of no interest at all"]


def test_a_document_with_all_notices_matches_each(spark):
    text = " filler ".join(t.notice for t in license_scan.TEMPLATES)
    row = license_scan.scan(cases.documents(spark, [text] + FILLER * 3 + [t.notice for t in license_scan.TEMPLATES[5:]] * 2, extra=False)).orderBy("doc_id").first()
    assert {m["label"] for m in row["matches"]} == {t.label for t in license_scan.TEMPLATES}
    assert sum(m["score"] == 1.0 for m in row["matches"]) == len(license_scan.TEMPLATES)


def test_a_cut_or_changed_notice_matches_by_its_key_phrase(spark):
    bsd = "Redistribution and use in source and binary forms with or without modification are permitted"
    changed = "x permission to use copy modify and or distribute this software for every goal with or sans charge is now given"
    texts = [bsd, changed, "SPDX-License-Identifier: MIT", "spdx license identifier gpl", "use in source and binary forms of redistribution"]
    got = [[(m["label"], round(m["score"], 6)) for m in r["matches"]] for r in license_scan.scan(cases.documents(spark, texts + FILLER, extra=False)).orderBy("doc_id").collect()]
    whole = {t.label: len(t.notice.split()) for t in license_scan.TEMPLATES if t.label in ("bsd", "isc", "spdx-mit")}
    assert got[0] == [("bsd", round(14 / whole["bsd"], 6))] and [label for label, _ in got[1]] == ["isc"] and got[2] == [("spdx-mit", 1.0)]
    assert got[3:] == [[]] * (len(got) - 3)
