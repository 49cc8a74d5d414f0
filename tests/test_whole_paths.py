"""The registered path queries that go to four edges, against brute force over the small tables."""

from collections import defaultdict

from bibloom.plans import catalog, graph
from bibloom.sources.recipes import table

from .conftest import SF


def test_paths_of_four_edges(spark):
    step = defaultdict(list)
    for r in graph.plain_edges(spark, SF).collect():
        step[r["source"]].append((r["target"], r["weight"], r["confidence"]))
    counts, ranked = {}, {}
    for (seed,) in table(spark, SF, "seeds").select("seed_id").distinct().collect():
        found, level = [], [((seed,), 0.0, 1.0)]
        for n in range(1, 5):
            level = [((*p, t), w + x, c * y) for p, w, c in level for t, x, y in step[p[-1]] if t not in p]
            found += [(round(w / n * c / (n + 1) ** 0.5, 9), ">".join(p)) for p, w, c in level]
            if level:
                counts[seed, n] = (len(level), len({p[-1] for p, _, _ in level}))
        ranked[seed] = sorted(found, key=lambda x: (-x[0], x[1]))[:10]
    got = {(r["seed_id"], r["path_length"]): (r["n"], r["ends"]) for r in catalog.queries()["f11_simple_paths_whole"](spark, SF).collect()}
    assert got == counts and any(n == 4 for _, n in got)
    best = defaultdict(list)
    for r in catalog.queries()["f12_rank_paths_whole"](spark, SF).orderBy("seed_id", "rank").collect():
        best[r["seed_id"]].append(r["score"])
    for seed, want in ranked.items():
        assert all(abs(a - b) < 2e-9 for a, (b, _) in zip(best[seed], want, strict=True))
