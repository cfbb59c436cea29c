"""Personal data: high-recall candidates, boosted trees, calibrated thresholds; DataFrame functions only.

Base spans are found by exact rules of four kinds (email, ip, card, phone), each
leftmost and non-overlapping within its kind, and always stay. On top, wider
generators propose candidate spans that overlap freely: addresses with a spelt-out
or spaced `at` and `dot`, dotted addresses with brackets or spaces, IPv6, runs of
seven and more digits with separators, and cards and phone numbers that a rule lost as it
ran on into neighbouring digits. Gradient-boosted trees score each candidate by
its format and context.

What the trees are to find is what the rules do not match, so their positives are
disguised: into the words around a random place of each of a bounded sample of
documents (`train_docs`) a made-up address, card or phone number is planted in a form
that no rule accepts (see `_plants`). Negatives are planted lookalikes (dates, versions,
order numbers, clock times, card numbers of wrong checksum, ...) and every candidate
of the sampled texts themselves that touches no base span; since such a candidate may be
disguised data too, it counts a tenth (`GIVEN_WEIGHT`), in the trees and in the thresholds. On a third of the sample that
the trees have not seen, the lowest score that reaches `precision` is chosen for each
kind. Candidates at or above it that touch no base span are added.

All text work is one scan without a shuffle, linear in a text and its matches: patterns
are possessive, so that very long runs of digits or letters neither recurse nor rescan;
positions and context follow from the pieces between matches, which one pass sums up;
results gather in blocks, so that no step copies all that came before; spans are held
against the base by one pass from either side; redaction reads a text in chunks. The
trees are turned into CASE expressions. Only fitting runs aggregations, over the sample.

Defined results: a null text is empty and has no span; null ids pass through;
repeated rows are reported each; an empty table gives an empty result and a model
that adds nothing; further columns, whatever their names, are ignored by `find` and
kept by `redact`.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.llm.common import materialize, table

KINDS = ("email", "ip", "card", "phone")

#: Possessive forms of the rules; a local part is only tried from its first character, or from the last match's end.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A character without which a rule cannot match.
NEEDS = {"email": "@", "phone": "+"}

_WORD, _LABEL = r"[A-Za-z0-9._%+-]++", r"[A-Za-z0-9-]++"
_AT, _DOT = r"(?:@|[\[({<](?i:at)[\])}>])", r"(?:\.|[\[({<](?:\.|(?i:dot))[\])}>])"
GENERATORS = {
    "address": rf"(?:\G|(?<![A-Za-z0-9._%+-])){_WORD}(?:\x20?+{_AT}\x20?+{_LABEL}(?:\x20?+{_DOT}\x20?+{_LABEL})++|\x20(?i:at)\x20{_LABEL}(?:\x20(?i:dot)\x20{_LABEL})++)",
    "dotted": rf"(?<![0-9.])[0-9]{{1,3}}+(?:\x20?+{_DOT}\x20?+[0-9]{{1,3}}+){{3}}(?![0-9])",
    "number": r"[+(]?[0-9](?:[\x20()._/-]{0,2}+[0-9]){6,}+",
    "bare": r"(?<![0-9])[0-9]{4}+([\x20-]?+)[0-9]{4}+\1[0-9]{4}+\1[0-9]{1,7}+(?![0-9])",
    "plus": r"\+[0-9]{1,3}+[\x20.-]?+\(?+[0-9]{2,4}+\)?+[\x20.-]?+[0-9]{3,4}+[\x20.-]?+[0-9]{3,4}+(?![0-9])",
    "ipv6": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{0,4}+:){2,7}+[0-9A-Fa-f]{1,4}+(?![0-9A-Za-z:])",
}
CUE = r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|card|visa|iban|account|ip|address|host|reach)\W*$"
TLD = r"(?i)[^a-z](?:com|org|net|edu|gov|mil|int|info|biz|io|co|me|eu|uk|de|fr|es|it|nl|ch|at|us|ca|au|jp|cn|in|br|ru)$"

TRAIN_DOCS = 10_000
ROUNDS = 16
DEPTH = 4
PRECISION = 0.99
#: Planted spans per sampled document.
PLANTED = 4
#: Weight in fitting of a sampled text's own candidates, which may be personal data in disguise.
GIVEN_WEIGHT = 0.1


#: Items per block of a fold, and code points per chunk of a text.
BLOCK, CHUNK = 128, 1024
#: Code points of context before a candidate.
AHEAD = 16


def _folded(items: Column, kind: str, state: Column, step) -> Column:
    """array<kind> of what step(state, item) -> (state, result, kept) keeps, in order; time is linear in the items.

    Spark copies an accumulator at every item, so none holds all results: one pass finds the
    state at the start of each block of items, and each block gathers its own results from there.
    """

    def block(items: Column) -> Column:
        each = F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))
        return F.transform(each, lambda k: F.slice(items, k * BLOCK + 1, BLOCK))

    def through(acc: Column, items: Column) -> Column:
        after = F.aggregate(items, acc["state"], lambda at, item: step(at, item)[0])
        return F.struct(after.alias("state"), F.concat(acc["starts"], F.array(acc["state"])).alias("starts"))

    def gather(acc: Column, item: Column) -> Column:
        after, result, kept = step(acc["state"], item)
        return F.struct(after.alias("state"), F.when(kept, F.concat(acc["out"], F.array(result))).otherwise(acc["out"]).alias("out"))

    def fold(blocks: Column) -> Column:
        begin = F.struct(state.alias("state"), F.slice(F.array(state), 1, 0).alias("starts"))
        starts = F.when(F.size(blocks) == 1, F.array(state)).otherwise(F.aggregate(blocks, begin, through, lambda acc: acc["starts"]))
        none = F.array().cast(f"array<{kind}>").alias("out")
        return F.flatten(F.zip_with(blocks, starts, lambda items, at: F.aggregate(items, F.struct(at.alias("state"), none), gather, lambda acc: acc["out"])))

    some = F.filter(F.array(items), lambda x: F.size(x) > 0)
    return F.flatten(F.transform(F.transform(some, block), fold))


def _located(text: Column, pattern: str, needs: str | None = None) -> Column:
    """array<struct<start, end, text, before, after>> of a pattern's matches, in code points, end exclusive.

    before are up to AHEAD code points in front of a match, after is the one behind it.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if needs:
        matches = F.when(F.instr(text, needs) > 0, matches).otherwise(F.array().cast("array<string>"))
    kind = "struct<start:int,end:int,text:string,before:string,after:string>"
    last = lambda x: F.substring(x, -AHEAD, AHEAD)

    def place(both: Column) -> Column:
        pieces, found = both["pieces"], both["found"]

        def one(m: Column, k: Column) -> Column:
            ahead, behind = F.get(pieces, k), F.get(pieces, k + 1)
            after = F.substring(F.when(behind != "", behind).otherwise(F.coalesce(F.get(found, k + 1), F.lit(""))), 1, 1)
            return F.struct(F.length(ahead).alias("gap"), last(ahead).alias("ahead"), F.length(m).alias("n"), m.alias("text"), after.alias("after"))

        def step(state: Column, m: Column) -> tuple[Column, Column, Column]:
            start, before = state["pos"] + m["gap"], last(F.concat(state["tail"], m["ahead"]))
            end = start + m["n"]
            result = F.struct(start.alias("start"), end.alias("end"), m["text"].alias("text"), before.alias("before"), m["after"].alias("after"))
            return F.struct(end.alias("pos"), last(F.concat(before, m["text"])).alias("tail")), result, F.lit(True)

        return _folded(F.transform(found, one), kind, F.struct(F.lit(0).alias("pos"), F.lit("").alias("tail")), step)

    # One array each of pieces and matches, named once: an expression inside a lambda is worked out for every element.
    found = F.transform(F.array(matches), lambda found: F.struct(F.when(F.size(found) > 0, F.split(text, pattern, -1)).alias("pieces"), found.alias("found")))
    return F.flatten(F.transform(found, place))


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn checksum of a string of digits; 0 modulo 10 where it passes."""
    each = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, k: F.when(k % 2 == 0, d.cast("int")).otherwise((2 * d.cast("int")) % 10 + F.floor(d.cast("int") / 5).cast("int")),
    )
    return F.aggregate(each, F.lit(0), lambda a, x: a + x) % 10


def _luhn(digits: Column) -> Column:
    return _luhn_sum(digits) == 0


_OCTET = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2}|)"
_DOTTED = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"


def _valid(kind: str, text: Column) -> Column:
    n = F.length(_digits(text))
    if kind == "ip":
        return text.rlike(_DOTTED)
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(_digits(text))).otherwise(False)
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<kind, start, end>> of one rule."""
    found = F.filter(_located(text, BASE[kind], NEEDS.get(kind)), lambda m: _valid(kind, m["text"]))
    return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))


def _count(text: Column, chars: str) -> Column:
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("double")


def _candidate(generator: str, m: Column) -> Column:
    """A candidate span with its kind and features."""
    body, before, after = m["text"], m["before"], m["after"]
    n = F.length(_digits(body))
    plain = F.regexp_replace(body, r"(?i:dot)|[^0-9.]", "")
    dotted = F.regexp_replace(body, r"[\[({<](?:\.|(?i:dot))[\])}>]", ".")
    dotted = F.translate(dotted, " ", "").rlike(_DOTTED)
    if generator == "number":
        kind = F.when(body.rlike(_DOTTED), "ip").when(n.between(13, 19) & ~body.startswith("+"), "card").otherwise("phone")
    else:
        kind = F.lit({"address": "email", "bare": "card", "plus": "phone"}.get(generator, "ip"))
    runs = F.filter(F.split(body, "[^0-9]+"), lambda r: r != "")
    groups = F.filter(F.split(body, "[^0-9A-Za-z]+"), lambda r: r != "")
    features = [
        F.lit(float(list(GENERATORS).index(generator))),
        F.length(body).cast("double"),
        n.cast("double"),
        F.size(runs).cast("double"),
        F.coalesce(F.array_max(F.transform(runs, F.length)), F.lit(0)).cast("double"),
        F.coalesce(F.array_min(F.transform(runs, F.length)), F.lit(0)).cast("double"),
        F.length(F.coalesce(F.element_at(groups, 1), F.lit(""))).cast("double"),
        F.length(F.coalesce(F.element_at(groups, -1), F.lit(""))).cast("double"),
        _count(body, "."),
        _count(body, "-"),
        _count(body, " "),
        _count(body, "()[]{}<>"),
        _count(body, "/_"),
        _count(body, ":"),
        (F.length(body) - F.length(F.regexp_replace(body, "[A-Za-z]", ""))).cast("double"),
        F.when(n.between(13, 19), _luhn(_digits(body))).otherwise(False).cast("double"),
        dotted.cast("double"),
        F.length(plain).cast("double"),
        body.rlike(r"^(?:19|20)[0-9]{2}[-/._ ]?(?:0[1-9]|1[0-2])").cast("double"),
        body.rlike(r"^[0-9]+\.[0-9]+$").cast("double"),
        body.rlike(TLD).cast("double"),
        before.rlike(r"[A-Za-z0-9_=\"'/#:-]$").cast("double"),
        after.rlike(r"[A-Za-z0-9_\"'/%-]").cast("double"),
        before.rlike(CUE).cast("double"),
    ]
    return F.struct(kind.alias("kind"), m["start"].alias("start"), m["end"].alias("end"), F.array(*features).alias("x"))


def candidates(text: Column) -> Column:
    """array<struct<kind, start, end, x array<double>>> of all generators; spans may overlap."""
    of = lambda g: F.transform(_located(text, GENERATORS[g]), lambda m: _candidate(g, m))
    return F.concat(*map(of, GENERATORS))


def _spanned(docs: DataFrame, *names: str) -> DataFrame:
    """docs with `cw_base` and `cw_wide`, the base spans and the candidates of the whole text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(*names, F.concat(*(base_spans(text, k) for k in KINDS)).alias("cw_base"), candidates(text).alias("cw_wide"))


def _apart(wide: Column, base: Column, alone: bool = False) -> Column:
    """Those of wide (kind, start, end, x) that touch no span of base, by start; with alone, no earlier one kept either.

    A pass from the end drops what a later base span begins in, a pass from the front what an earlier one reaches.
    """
    kind = "struct<start:int,wide:boolean,end:int,kind:string,x:array<double>>"
    row = lambda s, is_wide: F.struct(
        s["start"].alias("start"), F.lit(is_wide).alias("wide"), s["end"].alias("end"), s["kind"].alias("kind"),
        (s["x"] if is_wide else F.lit(None).cast("array<double>")).alias("x"),
    )
    from_end = lambda following, s: (F.when(s["wide"], following).otherwise(s["start"]), s, ~s["wide"] | (s["end"] <= following))

    def from_front(reach: Column, s: Column) -> tuple[Column, Column, Column]:
        kept = s["wide"] & (s["start"] >= reach)
        return F.when(kept if alone else F.lit(False), s["end"]).when(s["wide"], reach).otherwise(F.greatest(reach, s["end"])), s, kept

    def clear(wide: Column) -> Column:
        both = F.array_sort(F.concat(F.transform(base, lambda s: row(s, False)), F.transform(wide, lambda s: row(s, True))))
        return _folded(F.reverse(_folded(F.reverse(both), kind, F.lit(2**31 - 1), from_end)), kind, F.lit(0), from_front)

    return F.flatten(F.transform(F.filter(F.array(wide), lambda w: F.size(w) > 0), clear))


@dataclass(frozen=True)
class Model:
    """Trees as nested (feature, threshold, left, right) or a leaf's value, their weights, and a threshold for each kind."""

    trees: tuple = ()
    weights: tuple[float, ...] = ()
    thresholds: tuple[tuple[str, float], ...] = ()

    def margin(self, x: Column) -> Column:
        def value(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            feature, threshold, left, right = node
            return F.when(x[feature] <= threshold, value(left)).otherwise(value(right))

        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            total = total + F.lit(weight) * value(tree)
        return total

    def accepts(self, c: Column) -> Column:
        """Whether a candidate reaches its kind's threshold."""
        if not self.trees:
            return F.lit(False)
        least = F.coalesce(*(F.when(c["kind"] == k, F.lit(t)) for k, t in self.thresholds), F.lit(float("inf")))
        return F.floor(self.margin(c["x"]) * 100) / 100 >= least


def _tree(node) -> tuple | float:
    if node.subtreeDepth() == 0:
        return float(node.prediction())
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def _made_up(key: Column, turn: Column) -> dict[str, Column]:
    """Digits, letters and hexadecimal digits, fixed by key and turn."""
    md5 = lambda k: F.md5(F.concat_ws("/", F.lit(k), key, turn.cast("string")))
    number = lambda k: F.lpad(F.conv(F.substring(md5(k), 1, 15), 16, 10), 18, "7")
    letters = lambda k: F.translate(F.substring(md5(k), 1, 9), "0123456789", "ghijklmnop")
    return {"d": number("d"), "e": number("e"), "u": letters("u"), "v": letters("v"), "w": letters("w"), "h": md5("h")}


def _plants(key: Column, turn: Column) -> tuple[list[Column], list[Column]]:
    """Disguised personal data, and lookalikes, as text columns."""
    m = _made_up(key, turn)
    d, e, u, v, h = m["d"], m["e"], m["u"], m["v"], m["h"]
    cut = lambda x, a, n: F.substring(x, a, n)
    join = lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts))
    pick = lambda k, *names: F.element_at(F.array(*map(F.lit, names)), (cut(e, k, 2).cast("int") % len(names) + 1))
    end = pick(3, "com", "org", "net", "de", "fr", "es", "info", "io", "co.uk")
    host = F.when(cut(e, 5, 1) < "5", v).otherwise(join("mail.", v))
    octet = lambda k: (cut(e, k, 3).cast("int") % 256).cast("string")
    octets = [octet(k) for k in (1, 4, 7, 10)]
    first = cut(join(pick(1, "4", "5", "37", "6011"), cut(d, 2, 15)), 1, 15)
    check = F.pmod(10 - _luhn_sum(join(first, "0")), F.lit(10))
    card = join(first, check.cast("string"))
    wrong = join(first, F.pmod(check + 1 + cut(e, 9, 1).cast("int") % 9, F.lit(10)).cast("string"))
    by_four = lambda x, s: F.concat_ws(s, *(cut(x, k, 4) for k in (1, 5, 9, 13)))
    area, a3, a4 = join(pick(7, "2", "3", "5", "6", "8", "9"), cut(d, 6, 2)), cut(d, 8, 3), cut(d, 11, 4)
    six = [F.regexp_replace(cut(h, 4 * k + 1, 4), "^0{1,3}", "") for k in range(8)]
    year, month, day = join("20", cut(e, 1, 2)), F.lpad((cut(e, 3, 2).cast("int") % 12 + 1).cast("string"), 2, "0"), F.lpad((cut(e, 5, 2).cast("int") % 28 + 1).cast("string"), 2, "0")
    clock = F.concat_ws(":", cut(join("0", (cut(e, 7, 1).cast("int") % 10).cast("string")), 1, 2), *(F.lpad((cut(e, k, 2).cast("int") % 60).cast("string"), 2, "0") for k in (8, 10)))
    good = [
        join(u, " (at) ", host, " (dot) ", end), join(u, "[at]", host, "[dot]", end), join(u, " at ", v, " dot ", end), join(u, " @ ", host, ".", end), join(u, "@", v, " [.] ", end),
        F.concat_ws("[.]", *octets), F.concat_ws(" . ", *octets), F.concat_ws("(dot)", *octets), F.concat_ws(":", *six), join(six[0], ":", six[1], "::", six[7]), F.concat_ws(":", *six[:3], F.lit(""), six[6], six[7]),
        by_four(card, "."), by_four(card, "  "), by_four(card, "/"), by_four(card, "_"),
        card, by_four(card, " "), by_four(card, "-"), join("+1 (", area, ") ", a3, "-", a4), join("+1 ", area, " ", a3, " ", a4),
        join("(", area, ") ", a3, "-", a4), join(area, ".", a3, ".", a4), join(area, "/", a3, "-", a4), join(area, "-", a3, "-", a4), join("0049 ", area, " ", a3, a4), join("0", area, " ", a3, " ", a4),
    ]
    like = [
        join(cut(d, 1, 2), " @ ", cut(d, 3, 1), ".", cut(d, 4, 2)), join(u, " at ", v, " dot ", m["w"]), join(u, " @ ", v, " . ", cut(d, 1, 2)),
        F.concat_ws(".", cut(d, 1, 1), cut(d, 2, 1), cut(d, 3, 2)), F.concat_ws(" . ", *(join(pick(2 * k + 1, "3", "4", "9"), cut(d, 3 * k + 1, 2)) for k in range(4))), clock, F.concat_ws(":", *(cut(h, 2 * k + 1, 2) for k in range(6))), F.concat_ws(":", *(cut(d, k, 1) for k in (2, 3, 4))),
        by_four(wrong, "."), by_four(wrong, "  "), by_four(wrong, "/"), by_four(wrong, "_"), cut(wrong, 1, 16), cut(d, 1, 17),
        F.concat_ws("-", year, month, day), join(F.concat_ws("/", year, month, day), " ", clock), join(F.concat_ws("-", day, month, year), " ", cut(d, 1, 2)), join(year, month, day, "-", cut(d, 3, 5)),
        cut(d, 4, 8), cut(d, 2, 10), join(cut(d, 4, 3), ".", cut(d, 5, 8)), join("978-", cut(d, 2, 1), "-", cut(d, 3, 2), "-", cut(d, 5, 6), "-", cut(d, 11, 1)), join(cut(d, 1, 4), "-", cut(d, 5, 4)), cut(h, 1, 24),
    ]
    return good, like


def _planted(docs: DataFrame) -> DataFrame:
    """Snippets of docs around a random place, text, with a span [cw_from, cw_to) planted there and cw_label 1 or 0."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("whole"), F.explode(F.array(*map(F.lit, range(PLANTED)))).alias("turn"))
    lot = lambda k, n: F.pmod(F.xxhash64(F.lit(k), key, F.col("turn")), F.lit(n)).cast("int")
    place = F.pmod(F.xxhash64(F.lit("place"), key, F.col("turn")), F.greatest(F.length("whole"), F.lit(1))).cast("int")
    cut = F.when(F.instr(F.expr("substring(whole, cw_place + 1, 400)"), " ") > 0, F.col("cw_place") + F.instr(F.expr("substring(whole, cw_place + 1, 400)"), " ")).otherwise(F.length("whole"))
    good, like = _plants(key, F.col("turn"))
    # Each sampled document gets forms of both labels in turn.
    chosen = lambda forms: reduce(lambda out, k: F.when(lot("form", len(forms)) == k, forms[k]).otherwise(out), range(1, len(forms)), forms[0])
    spans = F.when(F.col("turn") % 2 == 0, chosen(good)).otherwise(chosen(like))
    cues = F.array(*map(F.lit, ["", "", "", "", "", "call ", "mail ", "phone: ", "tel. ", "card no. ", "ip ", "contact ", "order ", "invoice no. ", "version ", "on ", "20481 ", "7 ", "5830012 ", "2353820953013749 "]))
    words = lambda part: F.translate(F.expr(part), "0123456789+@", "")  # noqa: E731  # numbers around a span would be labelled with it
    rows = rows.withColumn("cw_place", place).withColumn("cut", cut)
    rows = rows.select(
        "doc_id",
        F.concat(words("substring(whole, greatest(cut - 39, 1), least(cut, 40))"), F.when(F.col("cut") > 0, "").otherwise(" "), F.element_at(cues, lot("cue", 20) + 1)).alias("before"),
        spans.alias("span"),
        F.concat(F.element_at(F.array(*map(F.lit, [" ", ". ", ", ", "\n", " 48213 ", " 7720118294 "])), lot("end", 6) + 1), words("substring(whole, cut + 1, 40)")).alias("after"),
        (F.col("turn") % 2 == 0).alias("good"),
    )
    at = F.length("before")
    return rows.select("doc_id", F.concat("before", "span", "after").alias("text"), at.alias("cw_from"), (at + F.length("span")).alias("cw_to"), F.col("good").cast("double").alias("cw_label"))


def examples(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """(kind, x, label, held, planted): labelled candidates that touch no base span, from a bounded sample."""
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    share = min(1.0, train_docs / max(1, docs.count()))
    some = docs.select("doc_id", "text").where(F.pmod(F.xxhash64(F.lit("personal"), key), F.lit(1 << 30)) < int(share * (1 << 30)))
    some = materialize(some, "pii-sample")
    held = (F.pmod(F.xxhash64(F.lit("calibrate"), key), F.lit(3)) == 0).alias("held")
    free = _apart(F.col("cw_wide"), F.col("cw_base"))
    given = _spanned(some, "doc_id").select(held, F.explode(free).alias("c"))
    given = given.select("c.kind", "c.x", F.lit(0.0).alias("label"), "held", F.lit(False).alias("planted"))
    # Stored, since Spark would work out the snippets anew for each pattern.
    made = _spanned(materialize(_planted(some), "pii-planted"), "doc_id", "cw_from", "cw_to", "cw_label")
    meets = lambda c: (c["start"] < F.col("cw_to")) & (F.col("cw_from") < c["end"])
    # A planted span must be met from end to end; a candidate that runs far beyond it is neither.
    exact = lambda c: (F.abs(c["start"] - F.col("cw_from")) <= 1) & (F.abs(c["end"] - F.col("cw_to")) <= 1)
    made = made.select(held, "cw_label", F.explode(F.filter(free, lambda c: meets(c) & ((F.col("cw_label") == 0) | exact(c)))).alias("c"))
    made = made.select("c.kind", "c.x", F.col("cw_label").alias("label"), "held", F.lit(True).alias("planted"))
    return given.unionByName(made)


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, precision: float = PRECISION) -> Model:
    """Boosted trees and thresholds from candidates in about train_docs documents, chosen by hashed doc_id."""
    return fit_examples(materialize(examples(docs, train_docs), "pii-fit"), precision)


def fit_examples(some: DataFrame, precision: float = PRECISION) -> Model:
    """The model of stored examples()."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    seen = {(r["held"], r["label"]) for r in some.select("held", "label").distinct().collect()}
    if len(seen) < 4:
        return Model()
    weight = F.when(F.col("planted"), 1.0).otherwise(GIVEN_WEIGHT)
    trees = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, seed=7, maxBins=32, weightCol="weight").fit(
        some.where(~F.col("held")).select(array_to_vector("x").alias("features"), "label", weight.alias("weight"))
    )
    model = Model(tuple(_tree(t._call_java("rootNode")) for t in trees.trees), tuple(map(float, trees.treeWeights)))
    # Margins in steps of 0.01: a few hundred levels a kind reach the driver, whatever the sample.
    scored = some.where("held").select("kind", "label", weight.alias("weight"), F.floor(model.margin(F.col("x")) * 100).alias("level"))
    levels = scored.groupBy("kind", "level").agg(F.sum(F.col("label") * F.col("weight")).alias("hits"), F.sum("weight").alias("n")).orderBy(F.desc("level")).collect()
    best: dict[str, float] = {}
    for kind in KINDS:
        hits = n = 0.0
        for r in (r for r in levels if r["kind"] == kind):
            hits, n = hits + r["hits"], n + r["n"]
            if hits >= precision * n:
                best[kind] = r["level"] / 100
    return Model(model.trees, model.weights, tuple(best.items()))


def _added(model: Model) -> Column:
    """Accepted candidates that touch no base span and no earlier accepted one."""
    return _apart(F.filter("cw_wide", model.accepts), F.col("cw_base"), alone=True)


def find(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, base, spans): arrays of struct<kind, start, end>; spans holds the base and what the model adds."""
    if not model.trees:
        text = F.coalesce(F.col("text"), F.lit(""))
        base = docs.select("doc_id", F.concat(*(base_spans(text, k) for k in KINDS)).alias("base"))
        return base.withColumn("spans", F.col("base"))
    added = F.transform(_added(model), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    found = _spanned(docs, "doc_id")
    return found.select("doc_id", F.col("cw_base").alias("base"), F.concat("cw_base", added).alias("spans"))


def redact(docs: DataFrame, model: Model) -> DataFrame:
    """docs, same columns: each span in text becomes its kind in brackets; n_chars follows where there is one."""
    given = docs.select(F.struct("*").alias("cw_row"), F.col("text").alias("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    wide = _spanned(given, "cw_row", "text")
    span = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    spans = F.array_sort(F.concat(F.transform("cw_base", span), F.transform(_added(model), span)))
    wide = wide.withColumn("cw_spans", spans)
    # A substring is counted from the start of its string, so pieces come from the chunks they lie in.
    chunks = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{CHUNK}}}+"), F.lit(0))

    def clean(chunks: Column) -> Column:
        def piece(start: Column, end: Column) -> Column:
            first = F.floor(start / CHUNK).cast("int")
            some = F.slice(chunks, first + 1, F.floor((end - 1) / CHUNK).cast("int") - first + 1)
            return F.when(end > start, F.substring(F.array_join(some, ""), start % CHUNK + 1, end - start)).otherwise("")

        def step(at: Column, s: Column) -> tuple[Column, Column, Column]:
            label = F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))
            return F.greatest(at, s["end"]), F.concat(piece(at, s["start"]), label), s["start"] >= at

        rest = piece(F.array_max(F.transform("cw_spans", lambda s: s["end"])), F.length(text))
        return F.concat(F.array_join(_folded(F.col("cw_spans"), "string", F.lit(0), step), ""), rest)

    cut = F.element_at(F.transform(F.array(chunks), clean), 1)
    wide = wide.withColumn("cw_text", F.when(F.size("cw_spans") > 0, cut).otherwise(F.col("text")))
    new = {"text": F.col("cw_text")}
    if "n_chars" in docs.columns:
        length = F.length("cw_text").cast(docs.schema["n_chars"].dataType)
        new["n_chars"] = F.when(F.size("cw_spans") > 0, length).otherwise(F.col("cw_row.n_chars"))
    return wide.select(*(new.get(c, F.col(f"cw_row.`{c}`")).alias(c) for c in docs.columns))


def _joined(spans: Column) -> Column:
    """kind:start:end, by kind as listed, then start, comma-joined."""
    place = lambda s: F.struct(
        F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")
    )
    ordered = F.array_sort(F.transform(spans, place))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the op5 contract; n_ counts base spans."""
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n = map(of, KINDS)
    return found.select("doc_id", *n, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return digest(find(docs, fit(docs)))
