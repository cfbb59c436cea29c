"""Language, toxicity, and the four dedup operators against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseweave.llm import common, langid, minhash, neardup_vectors, substrings, toxicity

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = {"en": "the and that with from have this will your which their would there could other about".split(), "de": "und der die nicht mit sich auch eine werden haben durch über schön für wird einem".split()}


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], DOCS)


def prose(rng, n, kind="en", extra=()):
    return " ".join(rng.choice(WORDS[kind] + list(extra)) + ("." if rng.random() < 0.1 else "") for _ in range(n))


def unique(rng, n):
    """Words that hardly occur twice, in sentences."""
    return " ".join(f"w{rng.randrange(10**6)}" + ("." if rng.random() < 0.15 else "") for _ in range(n))


def components(edges, ids):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_connected_components(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(120)] + [(1000, 1000 + k) for k in range(40)] + [(rng.randrange(5000, 5100), rng.randrange(5000, 5100)) for _ in range(60)]
    got = {r["id"]: r["component"] for r in common.connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert got == components(edges, ids)
    assert common.connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_language(spark):
    rng = random.Random(1)
    rows = [(k, prose(rng, rng.randrange(3, 60), "de" if k % 3 == 0 else "en"), "de" if k % 3 == 0 else "en", "s", 1) for k in range(400)]
    odd = [(9001, None, "en", "s", 0), (9002, "", None, "s", 0), (9003, "123 !!!", "en", "s", 1), (9004, "漢字漢字漢字", None, "s", 1), (None, "the and that with", None, None, 1)]
    given = spark.createDataFrame(rows + odd, DOCS)
    model = langid.fit(given)
    got = {r["doc_id"]: r for r in langid.predict(given, model).collect()}
    held = [r for r in rows if got[r[0]]["held_out"]]
    assert len(held) > 50 and np.mean([got[r[0]]["lang_pred"] == r[2] for r in held]) > 0.97
    assert [got[k]["lang_pred"] for k in (9001, 9002, 9003)] == ["und"] * 3 and got[None]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in langid.keep(given, model).collect()}
    assert kept == {r[0] for r in rows} | {None}
    assert langid.fit(given.limit(0)).predict("the") == ("und", 0.0)


def test_language_distance_by_hand():
    profiles = langid.Profiles({"x": langid.ranked(*langid.ngrams("ab ab a"), 5).tolist(), "y": langid.ranked(*langid.ngrams("zz"), 5).tolist()}, 5)
    own = langid.ranked(*langid.ngrams("ab"), 5).tolist()
    for k, lang in enumerate(profiles.langs):
        ranks = langid.ranked(*langid.ngrams("ab ab a" if lang == "x" else "zz"), 5).tolist()
        far = sum(abs(ranks.index(g) - i) if g in ranks else 5 for i, g in enumerate(own))
        if k == 0:
            assert profiles.predict("ab") == ("x", pytest.approx(1 - far / (5 * len(own))))


def test_toxicity(spark):
    rng = random.Random(2)
    bad = ["idiotic", "worthless", "moronic", "trashy"]
    rows, labels = [], []
    for k in range(900):
        toxic = k % 5 == 0
        text = prose(rng, 60) + ("" if not toxic else " " + " ".join(rng.choice(bad) for _ in range(rng.choice([1, 6]))))
        rows.append((k, text))
        labels.append((k, 1, int(toxic)))
    given = docs(spark, rows + [(2000, None), (2001, ""), (None, "trashy trashy trashy idiotic")])
    model = toxicity.fit(given, spark.createDataFrame(labels + [(0, 1, None)], "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r for r in toxicity.score(given, model).collect()}
    flags = [(got[k]["toxic"], bool(t)) for k, _, t in labels]
    assert sum(a for a, b in flags if b) > 0.95 * sum(b for _, b in flags)
    assert not any(a for a, b in flags if not b)
    assert not got[2000]["toxic"] and not got[2001]["toxic"] and got[None]["toxic"]
    assert all(0 <= r["severity"] <= 2 for r in got.values())
    none = toxicity.fit(given, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert all(not r["toxic"] for r in toxicity.score(given.limit(5), none).collect())


def test_edit_distance():
    rng = random.Random(3)

    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for _ in range(2000):
        a = [rng.randrange(4) for _ in range(rng.randrange(25))]
        b = list(a) if rng.random() < 0.6 else [rng.randrange(4) for _ in range(rng.randrange(25))]
        for _ in range(rng.randrange(5)):
            b.insert(rng.randrange(len(b) + 1), rng.randrange(4))
        most, d = rng.randrange(10), plain(a, b)
        assert minhash.edit_distance_within(a, b, most) == (d if d <= most else None)


def test_minhash_classes(spark):
    rng = random.Random(4)
    rows = [(k, unique(rng, 80)) for k in range(40)]
    for k in range(30):  # one large group of near copies
        words = rows[0][1].split()
        words[rng.randrange(80)] = f"x{k}"
        rows.append((100 + k, " ".join(words)))
    rows += [(200 + k, rows[1][1].upper()) for k in range(20)]  # copies
    rows += [(300, None), (301, ""), (302, "..."), (303, "one two"), (304, "One, two!"), (None, rows[2][1]), (305, "long " * 3000), (305, "long " * 3000)]
    given = docs(spark, rows)
    got = {r["doc_id"]: r for r in minhash.classes(given).collect()}
    words = {i: common.words_of(t) for i, t in rows if i is not None}
    ids = sorted(words)
    edges = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1 :] if words[a] and words[b] and minhash.edit_distance_within(words[a], words[b], int(0.2 * max(len(words[a]), len(words[b])) + 1e-9)) is not None]
    want = components(edges, ids)
    assert {i: got[i]["component_id"] for i in ids} == want
    assert got[None]["kept"] and got[300]["kept"] and got[303]["kept"] and not got[304]["kept"]
    left = Counter(r["doc_id"] for r in minhash.dedup(given).collect())
    assert left == Counter(i for i, _ in rows if i is None or want[i] == i)
    assert minhash.classes(given.limit(0)).count() == 0


def test_minhash_chains_in_a_large_group(spark):
    """Documents unlike the leader of a large group, but like members that are connected through it."""
    rng = random.Random(11)
    base = unique(rng, 100).split()

    def changed(words, at):
        return words[:at] + [f"z{rng.randrange(10**6)}" for _ in range(16)] + words[at + 16 :]

    near = [changed(base, 4) for _ in range(3)] + [changed(base, rng.randrange(0, 84)) for _ in range(27)]
    far = [changed(words, 60) for words in near[:3]]
    rows = [(k, " ".join(words)) for k, words in enumerate([base, *near, *far])]
    words = {i: common.words_of(t) for i, t in rows}
    edges = [(a, b) for a in words for b in words if a < b and minhash.edit_distance_within(words[a], words[b], 20) is not None]
    assert not any((0, i) in edges for i in range(31, 34))
    want = components(edges, list(words))
    got = {r["doc_id"]: r["component_id"] for r in minhash.classes(docs(spark, rows)).collect()}
    assert got == want


def test_substrings(spark):
    rng = random.Random(6)
    passage = unique(rng, 70) + "."
    rows = [(k, unique(rng, 50) + ".\n" + (passage + "\n" if k % 3 == 0 else "") + unique(rng, 30) + ".") for k in range(24)]
    rows += [(100, passage + " " + passage), (101, None), (102, ""), (103, "Short. Short. Short."), (104, "Short. Short. Short."), (None, passage)]
    given = docs(spark, rows)
    got = {r["doc_id"]: r["text"] for r in substrings.clean(given).collect()}
    marker = passage.split()[20]
    assert marker in got[0] and all(marker not in got[k] for k in range(3, 24, 3)) and marker not in got[100]
    assert all(got[i] == t for i, t in rows if i is not None and i < 24 and i % 3) and got[103] == got[104] == "Short. Short. Short."
    assert got[101] is None and got[None] == passage
    assert substrings.clean(given.limit(0)).count() == 0


def brute_substrings(rows):
    """Words removed by doc_id: spans as tuples of words in a dictionary, first occurrence by doc_id and place."""
    parts = {}
    for i, text in rows:
        if i is not None:
            _, first, words = substrings.units((text or "").encode())
            parts[i] = [tuple(words[a:b]) for a, b in zip(first, [*first[1:], len(words)], strict=True)] if words else []
    places = {}
    for i in sorted(parts):
        size, n = [len(u) for u in parts[i]], len(parts[i])
        runs = set()
        for lo in range(n):  # shortest run from lo on, shortest run up to lo
            hi = next((h for h in range(lo + 2, n) if sum(size[lo : h + 1]) >= 25), None)
            runs |= {(lo, hi)} if hi is not None else set()
            back = next((b for b in range(lo - 2, -1, -1) if sum(size[b : lo + 1]) >= 25), None)
            runs |= {(back, lo)} if back is not None else set()
        for lo, hi in sorted(runs):
            places.setdefault(sum(parts[i][lo : hi + 1], ()), []).append((i, lo, hi))
    gone = {i: set() for i in parts}
    for at in places.values():
        for i, lo, hi in at:
            if (i, lo) > min((a, b) for a, b, _ in at):
                gone[i] |= set(range(lo, hi + 1))
    return {i: sum(len(parts[i][k]) for k in ks) for i, ks in gone.items()}


def test_substrings_against_brute_force(spark):
    rng = random.Random(16)
    passages = [unique(rng, rng.randrange(30, 120)) + "." for _ in range(6)] + [unique(rng, 90).replace(".", "")]
    rows = []
    for k in range(60):
        text = [prose(rng, rng.randrange(5, 60)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            text.insert(rng.randrange(len(text)), rng.choice(passages))
        rows.append((k, rng.choice([" ", ".\n", " "]).join(text)))
    rows += [(70, rows[3][1]), (71, rows[3][1] + "! " + rows[3][1]), (72, None), (73, ""), (74, "no end " * 9000)]
    got = {r["doc_id"]: r["cw_removed"] for r in substrings.cut(docs(spark, rows)).collect()}
    want = brute_substrings(rows)
    assert got == want and sum(v > 0 for v in want.values()) > 15


def test_substrings_cut_alike_at_any_offset(spark):
    """A passage without sentence ends, in texts without sentence ends, at all offsets; and full-width ends."""
    rng = random.Random(26)
    passage = unique(rng, 60).replace(".", "").split()
    rows = [(k, " ".join([f"q{k}x{j}" for j in range(20 + k)] + passage + [f"r{k}x{j}" for j in range(30)])) for k in range(15)]
    got = {r["doc_id"]: r["text"] for r in substrings.clean(docs(spark, rows)).collect()}
    assert got[0] == rows[0][1]
    for k in range(1, 15):
        left = got[k].split()
        assert not set(passage[12:48]) & set(left) and f"q{k}x0" in left and f"r{k}x29" in left
    at, first, words = substrings.units("一二三四 五六。七八！九十 a？b".encode())
    assert len(first) == 4
    assert max(np.diff(substrings.units(" ".join(f"v{k}" for k in range(900)).encode())[1])) <= substrings.UNIT_WORDS * 2


def test_substrings_keep_clashing_columns(spark):
    rng = random.Random(36)
    text = unique(rng, 80) + "."
    given = spark.createDataFrame([(1, text, "a", 5, "x"), (2, text, "b", 6, "y"), (2, text, "b", 6, "y")], "doc_id long, text string, cw_text string, cw_units long, cw_cuts string")
    got = sorted((r["doc_id"], r["text"] == text, r["cw_text"], r["cw_units"], r["cw_cuts"]) for r in substrings.clean(given).collect())
    assert got == [(1, True, "a", 5, "x"), (2, False, "b", 6, "y"), (2, False, "b", 6, "y")]


def test_vectors(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((300, 16))
    x = np.concatenate([base, base[:20] + 0.05 * rng.standard_normal((20, 16)), base[5] + 0.05 * rng.standard_normal((60, 16)), base[9:10]])
    rows = [(k, [float(v) for v in r], 0) for k, r in enumerate(x)]
    odd = [(1000, None, 0), (1001, [0.0] * 16, 0), (1002, [float("nan")] * 16, 0), (1003, [None] * 16, 0), (1004, [], 0), (1005, [1.0, 2.0], 0), (1006, [2.0, 4.0], 0), (None, rows[3][1], 0)]
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, label int")).collect()}
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    edges = [(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if near[i, j]]
    want = components(edges, range(len(x)))
    assert {k: got[k]["component_id"] for k in want} == want
    assert all(got[k]["n_links"] == near[k].sum() - 1 for k in want)
    assert all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (1000, 1001, 1002, 1003, 1004))
    assert got[1006]["component_id"] == 1005 and got[None]["kept"]


def test_vectors_of_tight_groups_that_link(spark):
    """Lists full of near copies hide the links between groups; a third group links through the second only."""
    rng = np.random.default_rng(8)
    x = np.zeros((180, 16))
    for g, angle in enumerate((0.0, 0.26, 0.52)):
        x[60 * g : 60 * g + 60, :2] = np.cos(angle), np.sin(angle)
    x += 0.002 * rng.standard_normal(x.shape)
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)]
    got = {r["vec_id"]: r for r in neardup_vectors.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = np.float32(x).astype(float)
    u /= np.linalg.norm(u, axis=1)[:, None]
    near = u @ u.T >= 0.95
    assert near[:60, 60:120].all() and near[60:120, 120:].all() and not near[:60, 120:].any()
    assert {r["component_id"] for r in got.values()} == {0}
    assert all(got[k]["n_links"] == near[k].sum() - 1 for k in range(180))


def test_vectors_odd_rows(spark):
    """Very large and very small finite vectors link; repeated ids are copies; columns may clash; a table may be empty."""
    big, small = [1e200, 2e200, 0.0], [1e-200, 2e-200, 0.0]
    rows = [(1, big, "a", 0), (2, small, "b", 0), (3, [1.0, 2.0, 0.01], "c", 0), (4, [-1.0, -2.0, 0.0], "d", 0), (5, [0.0, 0.0, 1.0], "e", 0), (5, [0.0, 0.0, 2.0], "e", 0), (6, [0.0, 0.0, 3.0], "f", 0), (7, [float("inf"), 1.0, 0.0], "g", 0)]
    given = spark.createDataFrame(rows, "vec_id long, embedding array<double>, unit string, id long")
    got = {(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in neardup_vectors.near_duplicates(given).collect()}
    assert got == {(1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 0, 4, True), (5, 2, 5, True), (6, 2, 5, False), (7, 0, 7, True)}
    assert neardup_vectors.near_duplicates(given).count() == len(rows)
    assert neardup_vectors.near_duplicates(given.limit(0)).count() == 0


def test_minhash_keeps_clashing_columns(spark):
    rng = random.Random(46)
    text = unique(rng, 60)
    given = spark.createDataFrame([(2, text, 1, "x"), (1, text + " more", 2, "y"), (None, text, 3, "z")], "doc_id long, text string, cw_gone long, rep string")
    assert sorted(map(tuple, minhash.dedup(given).collect()), key=str) == sorted([(1, text + " more", 2, "y"), (None, text, 3, "z")], key=str)


def test_toxicity_is_the_same_for_any_partitioning(spark):
    """Equal texts with other labels and ids, dealt otherwise: equal weights; and severity ranks held-out documents."""
    rng = random.Random(56)
    bad = ["idiotic", "worthless", "moronic", "trashy"]
    rows = []
    for k in range(700):
        toxic = k % 4 == 0
        rows.append((k, prose(rng, 40) + ("" if not toxic else " " + " ".join(rng.choice(bad) for _ in range(rng.choice([1, 2, 5])))), int(toxic)))
    rows += [(1000 + k, rows[k][1], 1 - rows[k][2]) for k in range(20)]
    labels = spark.createDataFrame([(k, t) for k, _, t in rows], "doc_id long, toxic int")
    given = docs(spark, [(k, t) for k, t, _ in rows])
    one, two = toxicity.fit(given, labels), toxicity.fit(given.repartition(7, "text").sortWithinPartitions(F.desc("doc_id")), labels.repartition(3))
    assert one.weights == two.weights and one.flag == two.flag and (one.steps == two.steps).all()
    fresh = [(k, prose(rng, 40) + " " + " ".join(rng.choice(bad) for _ in range(k % 3 * 3))) for k in range(90)]
    score = {r["doc_id"]: r["severity"] for r in toxicity.score(docs(spark, fresh), one).collect()}
    level = [np.mean([score[k] for k in range(90) if k % 3 == j]) for j in range(3)]
    assert level[0] < level[1] < level[2]


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(21)
    a, b = unique(rng, 60), unique(rng, 60)
    near = b.split()
    near[30] = "changed"
    near = " ".join(near)
    kept = lambda rows: Counter((r["doc_id"], r["text"]) for r in minhash.dedup(docs(spark, rows)).collect())
    assert kept([(3, a), (5, a), (5, b)]) == Counter([(3, a), (5, b)])
    assert kept([(5, a), (5, b), (7, near)]) == Counter([(5, a), (5, b)])
    assert sum(kept([(5, b), (5, near), (5, b), (6, None), (None, a)]).values()) >= 3
    got = minhash.classes(docs(spark, [(5, a), (5, b), (7, near)])).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(5, 5, True), (5, 5, True), (7, 5, False)]
    passage = " ".join(f"p{k}" + ("." if k % 9 == 8 else "") for k in range(63))
    own = unique(rng, 80)
    rows = [(1, passage), (2, own + ". " + passage), (2, "Two short sentences. They stay."), (2, unique(rng, 200)), (2, passage)]
    done = Counter((r["doc_id"], r["text"].strip()) for r in substrings.clean(docs(spark, rows)).collect())
    assert done == Counter([(1, passage), (2, own + "."), (2, rows[2][1]), (2, rows[3][1]), (2, "")])


def test_word_digest_equals_that_of_signatures(spark):
    texts = [(1, "  Ein ÜBER-langes\tWort, x"), (2, "a"), (3, "!!a\x7fB\n"), (4, "漢字 İ ß z")]
    given = docs(spark, texts)
    want = {r["doc_id"]: bytes(r["key"]) for r in minhash.signatures(given).collect()}
    got = {r["doc_id"]: bytes(r["k"]) for r in given.select("doc_id", minhash.word_digest(F.col("text")).alias("k")).collect()}
    assert got == want


def test_audit_sees_isolated_vectors(spark):
    rng = np.random.default_rng(4)
    hearts = rng.standard_normal((400, 16))
    rows = [(2 * k + s, (hearts[k] + 0.01 * s).tolist()) for k in range(400) for s in (0, 1)]
    points = neardup_vectors.vertices(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).withColumnRenamed("vec_id", "id")
    parts = spark.createDataFrame([(2 * k + s, 2 * k) for k in range(260) for s in (0, 1)], "id long, component long")
    true, found = neardup_vectors.audit(points, parts)
    assert true > 100 and 0.5 < found / true < 0.8


def test_minhash_large_groups_lose_no_link(spark, monkeypatch):
    """One sketch shared by all, all others unlike: links of members that every refinement parts."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    rng = random.Random(77)
    base = [unique(rng, 60).split() for _ in range(25)] + [f"a{k} b{k} c{k} d{k} e{k}".split() for k in range(3)]

    def changed(words):
        out = list(words)
        for at in rng.sample(range(len(words)), len(words) // 5):  # at the very bound
            out[at] = f"z{rng.randrange(10**6)}"
        return out

    texts = [w for words in base for w in (words, changed(words), changed(words))] + [prose(rng, 30).split() for _ in range(20)]
    texts += [base[4][:48], base[5][:47], ["alone"], base[6] + ["and"] * 15, base[7] + ["and"] * 16]
    given = docs(spark, [(k, " ".join(words)) for k, words in enumerate(texts)])
    bands = F.concat(F.array(F.lit(7)), F.transform(F.sequence(F.lit(1), F.lit(31)), lambda j: F.xxhash64("key", j))).alias("bands")
    reps = common.materialize(minhash.signatures(given).select(F.col("doc_id").alias("rep"), "doc_id", "key", bands), "test-reps")
    got = {r["rep"]: r["home"] for r in minhash.homes(given, reps).collect()}
    words = {k: common.words_of(" ".join(t)) for k, t in enumerate(texts)}
    edges = [(a, b) for a in words for b in words if a < b and minhash.edit_distance_within(words[a], words[b], int(0.2 * max(len(words[a]), len(words[b])) + 1e-9)) is not None]
    assert len(edges) > 50 and got == components(edges, list(words))


def test_minhash_large_groups_take_few_rows(spark, monkeypatch):
    """Unlike members that share common words: no table has a row for a member and a word, and refinement that finds nothing ends."""
    rng = random.Random(79)
    pool = [f"w{k}" for k in range(150)]
    texts = [[rng.choice(pool) for _ in range(100)] for _ in range(120)]
    texts += [[*words[:20], f"y{k}", *words[21:]] for k, words in enumerate(texts[100:])]
    given = docs(spark, [(k, " ".join(words)) for k, words in enumerate(texts)])
    # The first three sketches are those of all, so two levels do not part them; the others are a text's own.
    bands = F.concat(F.array(*map(F.lit, (7, 8, 9))), F.transform(F.sequence(F.lit(3), F.lit(31)), lambda j: F.xxhash64("key", j))).alias("bands")
    reps = common.materialize(minhash.signatures(given).select(F.col("doc_id").alias("rep"), "doc_id", "key", bands), "test-reps")
    own, rows = minhash.materialize, {}

    def counted(df, tag):
        out = own(df, tag)
        rows[tag] = out.count()
        return out

    monkeypatch.setattr(minhash, "materialize", counted)
    got = {r["rep"]: r["home"] for r in minhash.homes(given, reps).collect()}
    words = {k: common.words_of(" ".join(t)) for k, t in enumerate(texts)}
    edges = [(a, b) for a in words for b in words if a < b and minhash.edit_distance_within(words[a], words[b], 20) is not None]
    assert len(edges) == 20 and got == components(edges, list(words))
    assert max(rows.values()) <= 3 * len(texts) and "omh-rows-4" not in rows
    left = common.materialize(given.join(spark.createDataFrame(list(got.items()), "doc_id long, home long"), "doc_id"), "test-left")
    left = left.select(F.col("doc_id").alias("rep"), "home", "text")
    met = [(r["chunk"], r["rep"], len(r["words"])) for r in minhash._dealt(left, 0.8).collect()]
    assert len(met) == len({m[:2] for m in met}) <= len(texts) and sum(m[2] for m in met) > 10 * len(texts)


def test_minhash_large_groups_make_no_row_for_a_pair(spark, monkeypatch):
    """Members just outside the bound of one another, or all alike: rows grow with members and tiles, and no link is lost."""
    monkeypatch.setattr(minhash, "TILE", 32, raising=False)
    rng = random.Random(80)
    passage, base = unique(rng, 300).split(), unique(rng, 300).split()
    pool = [f"y{k}" for k in range(2_000)]  # so that the rarest words are shared as well
    texts = [passage + rng.sample(pool, 100) for _ in range(60)]
    for _ in range(60):
        words = list(base)
        for at in rng.sample(range(300), 30):
            words[at] = f"z{rng.randrange(10**6)}"
        texts.append(words)
    for _ in range(10):  # their bitmaps differ in width
        words = unique(rng, 140).split()
        texts += [words, [w for at, w in enumerate(words) if at % 5]]
    given = spark.createDataFrame([(k, " ".join(words)) for k, words in enumerate(texts)], "rep long, text string")
    tiles = common.materialize(minhash._alike(given.select("rep", F.col("rep").alias("home")), given, 0.8), "test-tiles")
    blocks = 1 + len(texts) // 32
    assert tiles.count() <= blocks * 80 and tiles.where("rep < 60").count() < 60
    assert tiles.select("tile", "rep").distinct().count() == tiles.count() and tiles.select("tile").distinct().count() > 1
    joined = [tuple(r) for r in minhash._joined(tiles, given, 0.8).collect()]
    words = {k: common.words_of(" ".join(t)) for k, t in enumerate(texts)}
    edges = [(a, b) for a in words for b in words if a < b and minhash.edit_distance_within(words[a], words[b], int(0.2 * max(len(words[a]), len(words[b])) + 1e-9)) is not None]
    assert len(edges) > 1_700 and len(joined) < tiles.count()
    assert components(joined, list(words)) == components(edges, list(words))
