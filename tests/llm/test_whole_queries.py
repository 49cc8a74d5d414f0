"""Whole queries against plain Python: packing, shuffle, votes and licence labels."""

import math
import re

import numpy as np
import pytest
import xxhash

from bibloom.llm import license_scan, packing, quality, sharding

from . import cases

TEXTS = [*cases.TEXTS[:18], "a b c " * 1500, "x " * 2048, "x " * 2049, "Released under the MIT License. cc by nc 4.0"] + [f"w{i} " * (i * 7 % 50) for i in range(150)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("whole"))
    cases.documents(spark, TEXTS, extra=False).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, len(TEXTS), 2)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def hashed(*values):
    """Spark's xxhash64 of (kind, value) pairs: i for int, l for long, s for string; nulls leave it."""
    h = 42
    for kind, v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v.encode() if kind == "s" else int(v).to_bytes(4 if kind == "i" else 8, "little", signed=True), h)
    return h - (1 << 64) if h >= 1 << 63 else h


def test_packing(spark, folder):
    pieces = []
    for i, t in enumerate(TEXTS):
        total = len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
        for seq in range(max(1, -(-total // 2048))):
            pieces.append((i, seq, min(2048, total - seq * 2048)))
    counts = np.bincount([n for _, _, n in pieces], minlength=2049)
    bounds = packing.optimal_boundaries(counts, packing.BUCKETS)
    share = max(1, math.ceil(len(pieces) / packing.LEAST_PARTS))
    groups = {}
    for i, seq, n in pieces:
        b = next(k for k, x in enumerate(bounds) if n <= x)
        groups.setdefault(b, []).append((i, seq, n))
    want = set()
    for b, held in groups.items():
        parts, per = math.ceil(len(held) / share), max(1, packing.BUDGET // max(1, bounds[b]))

        def place(p):
            mixed = hashed(("i", 11), ("l", p[0]), ("i", p[1]))
            return hashed(("i", 12), ("l", mixed), ("i", p[2])) % parts, mixed, p[0], p[1]

        for at, (i, seq, n) in enumerate(sorted(held, key=place)):
            want.add((i, seq, seq * 2048, n, bounds[b], bounds[b] - n, at // per, at % per))
    got = [tuple(r) for r in packing.query(spark, folder).collect()]
    assert len(got) == len(pieces) and set(got) == want


def test_two_pass_shuffle(spark, folder):
    n, buckets = sharding.MIN_BUCKETS, {}
    for i, t in enumerate(TEXTS):
        buckets.setdefault(hashed(("s", t), ("i", 18), ("l", i)) % n, []).append((hashed(("i", 17), ("l", i), ("s", t)), i))
    order = []
    for b in sorted(buckets):
        held = [i for _, i in sorted(buckets[b])]
        order += [held[k] for k in sharding.fisher_yates(len(held), 17 * 1_000_003 + b)]
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.query(spark, folder).collect()}
    assert got == {i: (at % 24, at // 24) for at, i in enumerate(order)}


def test_votes(spark, folder):
    counts = np.array([quality.term_counts(t or "") for t in TEXTS])
    idf = np.log((1 + len(TEXTS)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32)
    rows = quality.weighted(counts.copy(), idf)
    known = [i for i in range(0, len(TEXTS), 2) if __import__("zlib").crc32(str(i).encode()) % 5]
    axes = np.linalg.svd(rows[known].astype(np.float64), full_matrices=False)[2][: quality.DIMENSIONS]
    latent = rows @ axes.T
    latent /= np.maximum(np.linalg.norm(latent, axis=1, keepdims=True), 1e-9)
    y = np.array([i % 2 for i in known], float)
    got = {r["doc_id"]: r["score"] for r in quality.query(spark, folder).collect()}
    assert len(got) == len(TEXTS)
    for i, v in enumerate(latent):
        near = latent[known] @ v
        top = np.argsort(-near)[: quality.NEIGHBOURS]
        w = (np.clip(near[top], 0, 1) / max(near[top].max(), 1e-9)) ** quality.SHARPNESS + 1e-12
        assert abs(got[i] - (w * y[top]).sum() / w.sum()) < 0.02


def test_licence_labels(spark, folder):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    words = [re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t)) for t in TEXTS]
    held = [set(w) for w in words]
    posted = license_scan.posted_words({w: sum(w in h for h in held) for t in license_scan.TEMPLATES for w in t.notice.split()})
    got = {r["doc_id"]: r for r in license_scan.query(spark, folder).collect()}
    for i, (t, own) in enumerate(zip(TEXTS, words)):
        _, starts, base = cases.licences(t)
        labels, best = set(filter(None, base.split(","))), 0.5 if starts else 0.0
        for template, entries in zip(license_scan.TEMPLATES, posted):
            notice, key = template.notice.split(), template.key.split()
            at = len(template.notice[: template.notice.index(template.key)].split())
            for off in range(-len(notice), len(own)):
                here = lambda k: own[off + k] if 0 <= off + k < len(own) else None  # noqa: B023, E731
                if sum(here(p) == w for w, p in entries) >= 2 and all(here(at + k) == w for k, w in enumerate(key)):
                    labels.add(template.label)
                    best = max(best, sum(here(k) == w for k, w in enumerate(notice)) / len(notice))
        assert (got[i]["labels"], round(got[i]["score"], 9)) == (",".join(sorted(labels)), round(best, 9)), i
