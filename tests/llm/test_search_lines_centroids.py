"""Centroid clustering, ranked search and line dedup against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.llm import centroids, lexical, lines

DOCS = "doc_id long, text string"


def lloyd(rows, k, rounds, dim, scale):
    """Plain k-means in whole numbers: [(vec_id, cluster, distance)], centroids."""
    kept = [(i, [math.floor(scale * float(np.float32(x))) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest() if i is not None else "", x) for i, x in kept)
    cs = [x for _, _, x in order[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), j) for j, c in enumerate(cs))

    for _ in range(rounds):
        groups: dict = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        cs = [[sum(col) // len(groups[j]) for col in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(cs)]
    return [(i, nearest(x)[1], nearest(x)[0]) for i, x in kept], cs


def null_last(row):
    return [(x is None, x or 0) for x in row]


@pytest.mark.parametrize("grid", [False, True])
def test_centroids_equal_plain_rounds(spark, grid):
    rng = random.Random(11)
    hearts = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(9)]
    make = (lambda k: [rng.choice([-0.5, 0.0, 0.5]) for _ in range(6)]) if grid else (lambda k: [x + rng.gauss(0, 0.15) for x in hearts[k % 9]])
    rows = [(k, make(k)) for k in range(700)]
    rows += [(5, rows[5][1]), (None, rows[7][1]), (900, None), (901, []), (902, [1.0] * 5), (903, [1.0] * 5 + [None]), (904, [1.0] * 5 + [math.nan]), (905, [math.inf] * 6)]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, upper int").repartition(5)
    got, cs = centroids.cluster(df, k=5, rounds=6, dim=6)
    want, want_cs = lloyd(rows, 5, 6, 6, 1024)
    found = got.collect()
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in found), key=null_last) == sorted(want, key=null_last)
    assert cs == want_cs
    if not grid:
        assert sum(r["scans"] for r in found) < 0.8 * 7 * len(found)


def test_centroids_of_few_and_large_vectors(spark):
    kind = "vec_id long, embedding array<double>"
    got, cs = centroids.cluster(spark.createDataFrame([(1, [0.5, 0.25]), (2, [1.0, 0.0])], kind), dim=2)
    assert len(cs) == 2 and sorted(r["distance"] for r in got.collect()) == [0, 0]
    assert centroids.cluster(spark.createDataFrame([], kind), dim=2)[0].count() == 0
    one, cs = centroids.cluster(spark.createDataFrame([(1, [0.5, -0.7])] * 3, kind), k=1, dim=2)
    assert cs == [[512, -717]] and {r["cluster"] for r in one.collect()} == {0}
    with pytest.raises(Exception, match="too large"):
        centroids.cluster(spark.createDataFrame([(1, [1e9, 0.0])], kind), dim=2)


TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def ranked(docs, items, top):
    bags = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, n_terms = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked: dict = {}
    for i, t in items:
        asked.setdefault(i, Counter()).update(terms(t))
    out = []
    for item, words in asked.items():
        scores = []
        for doc_id, bag in bags:
            m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // n_terms
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * bag[t]) // (1000 * bag[t] + 8 * m)) for t, q in words.items() if t in bag)
            if s > 0:
                scores.append((-s, doc_id is None, doc_id or 0, doc_id))
        out += [(item, k + 1, d, -s) for k, (s, _, _, d) in enumerate(sorted(scores)[:top])]
    return out


@pytest.mark.parametrize(("block_chars", "shard_docs"), [(10**6, 10**6), (200, 37)])
def test_search_equals_scores_of_all(spark, block_chars, shard_docs):
    rng = random.Random(12)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)] + ["Über", "naïve", "漢字"]
    docs = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 60)))) for k in rng.sample(range(5000), 400)]
    docs += [docs[3], (docs[4][0], docs[5][1]), (None, docs[6][1]), (6000, docs[6][1]), (6001, None), (6002, ""), (6003, "?! --"), (6004, " ".join(rng.choices(words, k=60_000)))]
    items = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 30)))) for k in range(30)] + [(3, "w1 w1 ÜBER"), (100, None), (101, "--"), (102, "nowhere"), (None, "w2 w3")]
    given = spark.createDataFrame([(*d, "z", 0) for d in docs], DOCS + ", item_id string, n int").repartition(3)
    asked = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, score int")
    got = [tuple(r) for r in lexical.search(given, asked, 10, block_chars, shard_docs).collect()]
    assert sorted(got, key=null_last) == sorted(ranked(docs, items, 10), key=null_last)


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], DOCS), spark.createDataFrame([("a", "w1")], "item_id string, text string")
    assert lexical.search(none, one).count() == 0
    assert lexical.search(spark.createDataFrame([(1, "w1")], DOCS), one.limit(0)).count() == 0
    assert [tuple(r)[:3] for r in lexical.search(spark.createDataFrame([(1, "w1"), (2, "x")], DOCS), one).collect()] == [("a", 1, 1)]


BLANK = " \t\n\x0b\x0c\r"


def deduped(docs, least_docs=5, least_chars=40):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))

    holders: dict = {}
    for r, (_, text) in enumerate(docs):
        for line in (text or "").split("\n"):
            if len(key(line)) >= least_chars:
                holders.setdefault(key(line), set()).add(r)
    keeper = {k: max((docs[r][0] for r in rows if docs[r][0] is not None), default=None) for k, rows in holders.items() if len(rows) >= least_docs}
    out = []
    for doc_id, text in docs:
        all_lines = (text or "").split("\n")
        kept = [x for x in all_lines if keeper.get(key(x), doc_id) == doc_id or keeper[key(x)] is None]
        out.append((doc_id, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return out


def line_docs():
    rng = random.Random(13)
    pool = ["".join(rng.choices("abcdefghij ÄÖ漢", k=rng.randrange(30, 60))) for _ in range(150)]
    dress = lambda x: rng.choice(["", " ", "\t", "\r"]) + (x.upper() if x.isascii() and rng.random() < 0.3 else x) + rng.choice(["", "\r", "  "])
    docs = [(k, "\n".join(dress(pool[int(len(pool) * rng.random() ** 2)]) for _ in range(rng.randrange(0, 12)))) for k in range(200)]
    docs += [(k, "the banner that stands in every single one of them\n" + t) for k, t in docs[:120]]
    docs += [docs[9], (9, "other\n" + pool[0]), (None, pool[0]), (1000, None), (1001, ""), (1002, "\n\n"), (1003, "\n".join(rng.choices(pool, k=20_000)))]
    docs += [(None, "only rows without an id hold this line of enough length")] * 6
    return docs


@pytest.mark.parametrize("how", [{}, {"broadcast_bytes": 0, "shard_keys": 5, "probes": 40}, {"shard_keys": 5}])
def test_lines_equal_brute_force(spark, how):
    docs = line_docs()
    df = spark.createDataFrame([(*d, "s", 7, "x") for d in docs], DOCS + ", source string, n_chars int, cw_text string").repartition(4)
    done = lines.cut(df, **how)
    got = sorted(((r["doc_id"], r["cw_lines"], r["cw_dropped"], r["cw_text_"] or "") for r in done.collect()), key=null_last)
    assert [g[:3] for g in got] == [w[:3] for w in sorted(deduped(docs), key=null_last)]
    assert Counter(g[3] for g in got) == Counter(w[3] for w in deduped(docs))
    kept = lines.clean(df, **how)
    assert kept.columns == df.columns
    assert kept.where((F.length("text") != F.col("n_chars")) & (F.col("n_chars") != 7)).count() == 0


def test_lines_of_nothing(spark):
    assert lines.cut(spark.createDataFrame([], DOCS)).count() == 0
    assert [tuple(r)[2:] for r in lines.cut(spark.createDataFrame([(1, None)], DOCS)).collect()] == [(None, 1, 0)]


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_minimal_perfect_hash(n):
    rng = np.random.default_rng(n)
    hi, lo = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, 2**63, n, dtype=np.uint64)
    if n > 10:
        hi[:10] = hi[0]
    shard = lines.Shard.from_row(*lines.Shard.build(hi, lo, np.arange(n), np.arange(n) * 3).to_row())
    assert sorted(shard.index(hi, lo).tolist()) == list(range(n))
    known, count, keeper = shard.probe(hi, lo)
    assert known.all() and count.tolist() == list(range(n)) and keeper.tolist() == [3 * k for k in range(n)]
    assert not shard.probe(lo + np.uint64(1), hi + np.uint64(2**63))[0].any()
    assert sum(len(x) for x in shard.levels) <= n + 64
