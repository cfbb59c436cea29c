"""Chat, decontamination, mixing, licences, personal data: exact results and edge cases."""

from __future__ import annotations

import hashlib
import random
import re
import textwrap

import pytest
from pyspark.sql import functions as F

from caseweave.llm import chat, decontaminate, licenses, mixing, pii
from caseweave.llm.common import materialize

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in rows], DOCS)


# chat


def test_chat_round_trip(spark):
    nasty = ["", "a </turn> b", "\\### Assistant: </turn> ok", "\\b\\h\\l#<", "### user: x</turn>\n", "é\n\nü"]
    rows = [(1, k, "assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)] + [(2, 0, None, None), (2, 0, "a:b#<", "x"), (None, 1, "user", "y"), (3, 5, "user", "same"), (3, 5, "user", "same")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    out = {r["conv_id"]: r for r in chat.render(df).select("conv_id", "valid", chat.parse(F.col("formatted")).alias("turns"), "segments").collect()}
    assert [(t["role"], t["text"]) for t in out[1]["turns"]] == [("assistant" if k % 2 else "user", t) for k, t in enumerate(nasty)]
    assert {(t["role"], t["text"]) for t in out[2]["turns"]} == {("", ""), ("a:b#<", "x")}
    assert len(out[3]["turns"]) == 2 and not out[3]["valid"] and out[1]["valid"]
    assert [s["text"] for s in out[1]["segments"] if s["loss"]] == [chat_escape(t) for k, t in enumerate(nasty) if k % 2]
    digest = {r["conv_id"]: r for r in chat.digest(chat.render(df)).collect()}
    spoken = "".join(f"{'assistant' if k % 2 else 'user'}\n{t}\n" for k, t in enumerate(nasty))
    assert digest[1]["turns_sha256"] == hashlib.sha256(spoken.encode()).hexdigest()
    assert digest[1]["loss_chars"] == sum(len(t) for k, t in enumerate(nasty) if k % 2)


def chat_escape(text):
    for a, b in chat.DEFAULT.escapes:
        text = text.replace(a, b)
    return text


def test_chat_empty_table(spark):
    assert chat.digest(chat.render(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


# decontamination


def test_decontaminate(spark):
    item = "One two three four five six seven eight nine ten eleven"
    bench = spark.createDataFrame([(1, item), (2, "Short item"), (3, None), (4, ""), (5, item)], "item_id long, text string")
    given = docs(spark, [(1, f"Before {item.upper()} after all of these other words that stay here for good", "a"), (2, "a short, ITEM", "a"), (3, None, "a"), (4, "", None), (5, "clean words", "a"), (None, "short item", "a"), (7, "clean words", "a"), (7, "clean words", "a")])
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.scan(given, bench)).collect()}
    assert (got[1]["n_hit"], got[1]["n_items"], got[1]["items_sha256"]) == (11, 2, hashlib.sha256(b"1,5").hexdigest())
    assert (got[2]["n_words"], got[2]["n_hit"], got[2]["contaminated"]) == (3, 2, True)
    assert (got[3]["n_words"], got[4]["n_words"], got[5]["n_hit"], got[None]["n_hit"]) == (0, 0, 0, 2)
    blocks = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.scan(given, bench, block_chars=20)).collect()}
    assert blocks[1] == got[1] and blocks[2] == got[2]
    kept = {r["doc_id"]: r for r in decontaminate.clean(given, bench).collect()}
    assert 2 not in kept and None not in kept and kept[5]["text"] == "clean words"
    assert kept[1]["text"] == "Before  after all of these other words that stay here for good" and kept[1]["n_chars"] == len(kept[1]["text"])
    assert decontaminate.scan(given, bench.limit(0)).where(F.size("hits") > 0).count() == 0
    assert decontaminate.scan(given.limit(0), bench).count() == 0


def test_decontaminate_by_blocks_as_at_once(spark):
    words = [f"w{k}" for k in range(60)]
    part = lambda a, b: " ".join(words[a:b])
    bench = spark.createDataFrame([(k, part(5 * k, 5 * k + 20)) for k in range(5)] + [(10 + k, f"q{k} r{k}") for k in range(6)], "item_id long, text string")
    rows = [(1, part(0, 40) + " " + " ".join(f"c{k}" for k in range(50)), "a"), (2, part(0, 20) + " x y z " + part(20, 40) + " u v", "a"), (3, "b " + part(0, 12) + " q0 r0 e f g h i j k l m n o p", "a")]
    rows += [(None, "q0 r0 s t u v", "a"), (None, "q1 r1 s t u v", "a"), (None, "s t u v w x", "a"), (7, "q2 r2 s t u v", "a"), (7, "q2 r2 s t u v", "a"), (8, "q3 q4 r4 r3 s t u v w", "a"), (9, None, "a"), (9, None, "a")]
    given = docs(spark, rows)
    key = lambda r: tuple(map(str, r))
    for work in (decontaminate.scan, decontaminate.clean):
        once = sorted((tuple(r) for r in work(given, bench).collect()), key=key)
        for chars in (20, 60):
            assert sorted((tuple(r) for r in work(given, bench, block_chars=chars).collect()), key=key) == once


# mixing


def test_mixing_targets_and_bounds(spark):
    rows = [(k, "w " * (1 + k % 40), ("a", "b", "c", None)[k % 4] if k % 7 else "a") for k in range(2000)] + [(5000, None, "b"), (None, "x y", "c"), (5001, "", "d")]
    given = docs(spark, rows)
    got = mixing.mix(given).collect()
    assert len(got) == len(rows)
    size, weight = {}, {}
    for r in got:
        size[r["source"]] = size.get(r["source"], 0) + r["size"]
    for k, s in enumerate(sorted(size, key=lambda s: (s is None, s))):
        weight[s] = k % 3 + 1
    want, free, total = {}, set(size), sum(size.values())
    while True:
        left = total - sum(want.values())
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * size[s]}
        if not over:
            break
        want |= {s: 3.0 * size[s] for s in over}
        free -= over
    want |= {s: weight[s] * level for s in free}
    taken = {}
    for r in got:
        assert 0 <= r["copies"] <= 3
        assert r["target"] == pytest.approx(want[r["source"]])
        taken[r["source"]] = taken.get(r["source"], 0) + r["copies"] * r["size"]
    for s, t in want.items():
        assert t - 40 <= taken[s] <= t + 1e-6, (s, t, taken[s])
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(given.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}


def test_mixing_empty(spark):
    assert mixing.mix(docs(spark, []).limit(0)).count() == 0


# licences


def test_licenses(spark):
    grant = next(t for n, t in licenses.TEMPLATES if n == "MIT" and 300 < len(t) < 600)
    whole = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 900)
    wrap = lambda text: "\n".join(f" * {line}" for line in textwrap.wrap(text, 72))
    code = "\n".join(f"value_{k} = compute(value_{k - 1}) + {k}" for k in range(400))
    given = docs(spark, [
        (1, "Text.\nlicensed UNDER the apache license, version 2.0!\nMore.", "a"), (2, wrap(grant), "a"), (3, None, "a"), (4, "", "a"), (4, "", "a"),
        (5, "the licence of the work is under review by the board of the press", "a"), (None, "All rights reserved.", "a"),
        (6, wrap(grant) + "\n" + code, "a"), (7, "Copyright 2020 Jane Doe. Released under the MIT License.", "a"),
        (8, code + "\nCopyright 2021\n" + wrap(whole).replace("NONINFRINGEMENT", "NON-INFRINGEMENT") + "\n" + code, "a"), (9, "word " * 20_000, "a"),
    ])
    got = {r["doc_id"]: r for r in licenses.scan(given).collect()}
    assert [(x["start"], x["license"], x["dice"]) for x in got[1]["matches"]] == [(1, "Apache-2.0", 1.0)]
    assert got[2]["whole"]["license"] == "MIT" and got[2]["whole"]["dice"] == 1.0
    assert got[3]["matches"] == got[4]["matches"] == got[5]["matches"] == got[9]["matches"] == [] and got[5]["whole"] is None
    assert got[None]["matches"][0]["license"] == "Proprietary"
    assert [(x["license"], x["start"]) for x in got[6]["matches"]] == [("MIT", 0)] and got[6]["whole"] is None
    assert [x["license"] for x in got[7]["matches"]] == ["MIT"]
    assert {x["license"] for x in got[8]["matches"]} == {"MIT"} and max(x["words"] for x in got[8]["matches"]) > 150
    assert licenses.digest(licenses.scan(given)).count() == 11
    assert licenses.digest(licenses.scan(given.limit(0))).count() == 0


def test_license_anchors_meet_every_match():
    """Any set of bigrams similar enough to a template holds one of its anchors."""
    rng = random.Random(3)
    for _, body in licenses.TEMPLATES:
        grams = licenses.bigrams_of(body)
        anchors = {g for g, _ in licenses.anchors_of(body)}
        for _ in range(50):
            kept = rng.sample(grams, rng.randint(1, len(grams)))
            if 2 * len(kept) / (len(kept) + len(grams)) >= licenses.LEAST:
                assert anchors & set(kept)


# personal data

RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _luhn(digits):
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _brute(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            good = kind == "email" or (kind == "ip" and all(int(p) <= 255 for p in m[0].split("."))) or (kind == "card" and 13 <= len(digits) <= 19 and _luhn(digits)) or (kind == "phone" and 9 <= len(digits) <= 15)
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_pii_base_matches_brute_force(spark):
    texts = ["", None, "é a@b.c_d@e.f.g, x@y", "1.2.3.4.5.6.7.8 256.1.1.1 0255.1.1.1", "4111 1111 1111 1111 and 4111-1111-1111-1112", "+1 (212) 555-0173 +12 +1234567890123456 ++49 30 123456", "9" * 30000, "a" * 30000 + "@x", "card 4111111111111111.", "5500 0000 0000 0004 1.1.1.1"]
    given = docs(spark, [(k, t, "a") for k, t in enumerate(texts)] + [(None, "z@z.zz", "a"), (8, texts[8], "a")])
    got = pii.digest(pii.find(given, pii.Model())).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        text = texts[r["doc_id"]] if r["doc_id"] is not None else "z@z.zz"
        assert r["spans"] == _brute(text)
        assert r["base_sha256"] == hashlib.sha256(_brute(text).encode()).hexdigest()


def test_pii_model_adds_and_redacts(spark):
    rows = [(k, f"Text {k}: call +1 ({200 + k % 700}) 555-{1000 + k % 9000} or mail a{k}@mail.example.com, order {1234567 + k * 991} of 2020, id {9999999 - k}.", "a") for k in range(1200)]
    given = docs(spark, rows)
    seen = materialize(pii.examples(given), "test-pii")
    model = pii.fit_examples(seen)
    assert model.trees and {k for k, _ in model.thresholds} == set(pii.KINDS)
    # On held-out planted spans, by kind: what is accepted is right, and most of what is right is accepted.
    tried = seen.where("held").select("kind", "label", model.accepts(F.struct("kind", "x")).alias("ok"))
    for r in tried.groupBy("kind").agg(F.avg(F.expr("if(ok, label, null)")).alias("precision"), F.avg(F.expr("if(label = 1, cast(ok as int), null)")).alias("recall")).collect():
        assert r["precision"] >= 0.97 and r["recall"] >= 0.9, r
    texts = {
        1: ("please phone (555) 123-4567 or write to bob (at) site (dot) org today", ["email:40:63", "phone:13:27"]),
        2: ("plain words only", []),
        3: (None, []),
        4: ("on the 2024-05-17 at 10:22:33 version 1.22.333, order 20240517-00012", []),
        5: ("lost in digits 4417123456789114 4111111111111111 here", ["card:32:48"]),
        6: ("host 2001:db8:85a3:1:2:8a2e:370:7334 answers", ["ip:5:36"]),
        7: ("no card 4111.1111.1111.1112 here", []),
    }
    probe = docs(spark, [(k, t, "a") for k, (t, _) in texts.items()])
    found = {r["doc_id"]: r for r in pii.digest(pii.find(probe, model)).collect()}
    for k, (_, want) in texts.items():
        assert [x for x in found[k]["spans"].split(",") if x] == want, (k, found[k]["spans"])
        assert found[k]["n_email"] == found[k]["n_card"] == 0
    red = {r["doc_id"]: r["text"] for r in pii.redact(given.limit(3), model).collect()}
    assert all("[PHONE]" in t and "[EMAIL]" in t and "@" not in t for t in red.values())
    assert pii.redact(probe, model).schema == probe.schema
    assert pii.fit(given.limit(0)).trees == ()


def test_pii_clashing_columns_and_long_texts(spark):
    """Columns named like internal ones pass through redact; a very long text is read to its end."""
    long = "word " * 60_000 + "a@b.cc"
    given = spark.createDataFrame([(1, long, "x", "y", 7), (1, long, "x", "y", 7), (None, None, None, None, None)], "doc_id long, text string, cw_base string, cw_spans string, n_chars long")
    rows = pii.redact(given, pii.Model()).collect()
    assert [r["cw_base"] for r in rows] == ["x", "x", None] and rows[0]["text"] == "word " * 60_000 + "[EMAIL]" and rows[0]["n_chars"] == len(rows[0]["text"])
    found = pii.digest(pii.find(given, pii.Model())).collect()
    assert sorted(r["spans"] for r in found) == ["", "email:300000:300006", "email:300000:300006"]


def test_pii_in_dense_texts(spark):
    """Tens of thousands of matches in one text: positions, overlaps and redaction as in short ones, across blocks and chunks."""
    n = 20_000
    text = "".join(f"é call 10.0.{k % 256}.{k % 255} now 😀 " for k in range(n))
    given = docs(spark, [(1, text, "a"), (2, "x@y.zz" + " " * pii.CHUNK + "x@y.zz", "a"), (3, "1.2.3.4 " * (2 * pii.BLOCK), "a")])
    found = {r["doc_id"]: r["spans"] for r in pii.digest(pii.find(given, pii.Model())).collect()}
    assert found[1] == _brute(text) and found[1].count(",") == n - 1
    assert found[2] == f"email:0:6,email:{pii.CHUNK + 6}:{pii.CHUNK + 12}" and found[3].count("ip:") == 2 * pii.BLOCK
    red = {r["doc_id"]: r["text"] for r in pii.redact(given, pii.Model()).collect()}
    assert red[1] == "é call [IP] now 😀 " * n and red[2] == "[EMAIL]" + " " * pii.CHUNK + "[EMAIL]"
    assert red[3] == "[IP] " * (2 * pii.BLOCK)


def test_pii_spans_apart(spark):
    """Overlap with the base and with each other agrees with comparing all pairs."""
    draw = random.Random(3)
    rows = []
    for k in range(60):
        span = lambda kind: (lambda a: (kind, a, a + draw.randint(1, 12), [0.0]))(draw.randint(0, 400 if k % 2 else 40))
        rows.append((k, [span("ip") for _ in range(draw.randint(0, 9))], [span("phone") for _ in range(draw.randint(0, 12 if k % 3 else 200))]))
    kind = "array<struct<kind:string,start:int,end:int,x:array<double>>>"
    df = spark.createDataFrame(rows, f"k long, base {kind}, wide {kind}")
    got = df.select("k", pii._apart(F.col("wide"), F.col("base")).alias("free"), pii._apart(F.col("wide"), F.col("base"), alone=True).alias("alone")).collect()
    for r in got:
        _, base, wide = rows[r["k"]]
        free = sorted((a, b) for _, a, b, _ in wide if all(b <= s or e <= a for _, s, e, _ in base))
        assert [(s["start"], s["end"]) for s in r["free"]] == free
        kept = []
        for a, b in free:
            if all(b <= s or e <= a for s, e in kept):
                kept.append((a, b))
        assert [(s["start"], s["end"]) for s in r["alone"]] == kept
