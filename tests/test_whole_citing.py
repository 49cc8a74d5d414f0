"""The registered citing papers, up to the reference's 200 a paper."""

from collections import Counter

from bibloom.plans import catalog
from bibloom.sources.recipes import table

from .conftest import SF


def test_all_citing_papers_are_kept(spark):
    edges = [tuple(r) for r in table(spark, SF, "edges").select("source_paper_id", "target_paper_id").collect()]
    counts = Counter(t for _, t in edges)
    assert 5 < max(counts.values()) <= 200
    want, place = set(), Counter()
    for s, t in sorted(edges, key=lambda e: (e[1], -counts[e[0]], e[0])):
        place[t] += 1
        want.add((s, t, counts[s], place[t]))
    got = catalog.queries()["a5_most_cited_citing_whole"](spark, SF).select("source_paper_id", "target_paper_id", "cited_by_count", "rank")
    assert {tuple(r) for r in got.collect()} == want
