from __future__ import annotations

import itertools
import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from caseweave.log import EventLog, ObjectLog
from caseweave.operators import complexity, metric_series, miners, ocel, simulation
from tests.helpers import of_variants, rows


def canonical(tree):
    """Children in order where order says nothing; several redo parts as one choice."""
    if not isinstance(tree, tuple):
        return tree
    op, *kids = tree
    kids = [canonical(k) for k in kids]
    if op == "loop":
        redo = kids[1] if len(kids) == 2 else canonical(miners._joined("xor", *kids[1:]))
        return ("loop", kids[0], redo)
    node = miners._joined(op, *kids)
    if isinstance(node, tuple) and node[0] in ("xor", "parallel"):
        return (node[0], *sorted(node[1:], key=repr))
    return node


def grown(rng, names, depth=0):
    """A tree over these names."""
    if len(names) == 1:
        return names[0]
    cut = sorted(rng.sample(range(1, len(names)), rng.randint(1, min(2, len(names) - 1))))
    parts = [names[a:b] for a, b in itertools.pairwise([0, *cut, len(names)])]
    op = rng.choice(["sequence", "xor", "parallel", "loop"])
    kids = [grown(rng, p, depth + 1) for p in parts]
    if op == "loop" and rng.random() < 0.2:
        kids = [None, *kids]
    if op == "xor" and rng.random() < 0.3:
        kids.append(None)
    return (op, *kids)


@pytest.mark.parametrize("seed", range(60))
def test_a_tree_comes_back_from_its_net(seed):
    rng = random.Random(seed)
    tree = grown(rng, [f"a{k}" for k in range(rng.randint(1, 12))])
    back = miners.tree_of_net(miners.net_of_tree(tree))
    assert miners.leaves(back) == miners.leaves(tree)
    if canonical(back) != canonical(tree):
        # A loop inside a loop may be read the other way round; then the words must agree.
        names = sorted(miners.leaves(tree))
        for _ in range(400):
            word = tuple(rng.choices(names, k=rng.randint(0, 7)))
            assert miners.accepts(tree, word) == miners.accepts(back, word)


def test_nets_without_blocks_say_so():
    # b and c run beside each other, d waits for b alone, e for both: no blocks.
    arcs = [("place", "source", "a"), *(("transition", "a", p) for p in ("p", "q")), ("place", "p", "b"), ("place", "q", "c"), ("transition", "b", "r"), ("transition", "b", "s"), ("transition", "c", "u")]
    arcs += [("place", "r", "d"), ("transition", "d", "v"), ("place", "s", "e"), ("place", "u", "e"), ("transition", "e", "w"), ("place", "v", "z"), ("place", "w", "z"), ("transition", "z", "sink")]
    with pytest.raises(miners.Unstructured):
        miners.tree_of_net(arcs)
    with pytest.raises(miners.Unstructured):
        miners.tree_of_net([("place", "source", "a"), ("transition", "a", "sink"), ("place", "sink", "b"), ("transition", "b", "source")])
    with pytest.raises(miners.Unstructured):
        miners.tree_of_net([])


def test_alpha_trees(spark):
    arcs = lambda spec, **kw: rows(miners.alpha_tree(of_variants(spark, spec), **kw))
    assert arcs({"a,b,c,d": 1, "a,c,b,d": 1}) == {("sequence", "0", "0.0:a"), ("sequence", "0", "0.1:parallel"), ("parallel", "0.1", "0.1.0:b"), ("parallel", "0.1", "0.1.1:c"), ("sequence", "0", "0.2:d")}
    assert {(k, c.split(":")[1]) for k, _, c in arcs({"a,c": 1, "a,b,c": 1, "a,b,b,c": 1}, loops=True)} == {("sequence", "a"), ("sequence", "loop"), ("loop", "τ"), ("loop", "b"), ("sequence", "c")}
    assert {c.split(":")[-1] for *_, c in arcs({"a,b,c": 1, "a,c": 1})} == {"a", "b", "c"}
    # d waits for b alone, e for b and c.
    assert {k for k, *_ in arcs({"a,b,c,d,e,z": 1, "a,b,c,e,d,z": 1, "a,b,d,c,e,z": 1, "a,c,b,d,e,z": 1, "a,c,b,e,d,z": 1})} == {"unstructured"}


def brute_graph(relations, kind):
    events, types = {}, {}
    for e, o, t, at in relations:
        events.setdefault(o, set()).add((at, e))
        types[o] = t
    born, dead = {o: min(x)[1] for o, x in events.items()}, {o: max(x)[1] for o, x in events.items()}
    found = set()
    for a, b in itertools.permutations(types, 2):
        for _, e in events[a] & events[b]:
            ok = {"interaction": a < b, "descendants": born[b] == e != born[a], "inheritance": born[b] == e == dead[a], "cobirth": a < b and born[a] == e == born[b], "codeath": a < b and dead[a] == e == dead[b]}[kind]
            if ok:
                found.add((a, b))
    ordered = kind in ("descendants", "inheritance")
    return {(s, t, n) for (s, t), n in Counter((types[a], types[b]) if ordered else tuple(sorted((types[a], types[b]))) for a, b in found).items()}


def test_object_graphs_by_counts(spark, monkeypatch):
    """A hub event of many objects that occur once, an object in every event, and tiles of three classes."""
    monkeypatch.setattr(ocel, "_TILE", 3)
    rng = random.Random(3)
    relations = {(f"e{rng.randrange(12)}", f"o{k % 25}", "xyz"[k % 25 % 3]) for k in range(90)} | {("e5", f"h{k}", "xy"[k % 2]) for k in range(30)} | {(f"e{k}", "all", "z") for k in range(12)}
    relations = [(e, o, t, int(e[1:]) // 2) for e, o, t in sorted(relations)]
    df = spark.createDataFrame([(e, o, t, "act", datetime(2024, 1, 1) + timedelta(days=at), None) for e, o, t, at in relations], "eid string, oid string, type string, activity string, timestamp timestamp_ntz, qualifier string")
    log = ObjectLog(df.select("eid", "activity", "timestamp").distinct(), df.select("oid", "type").distinct(), df.union(df.limit(20)), df.selectExpr("oid", "oid AS oid_2", "qualifier").limit(0))
    for kind in ocel.GRAPHS:
        assert rows(ocel.object_graph(log, kind)) == brute_graph(relations, kind), kind
        assert ocel.object_graph(ObjectLog(*(x.limit(0) for x in (log.events, log.objects, log.relations, log.o2o))), kind).count() == 0


def test_affinity_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(complexity, "_BLOCK", 4)
    rng = random.Random(5)
    spec = {",".join(rng.choices("abcde", k=rng.randint(1, 6))): rng.randint(1, 4) for _ in range(40)}
    cases = [frozenset(itertools.pairwise(v.split(","))) for v, n in spec.items() for _ in range(n)]
    alike = [len(a & b) / len(a | b) if a | b else 0.0 for a, b in itertools.combinations(cases, 2)]
    assert complexity.affinity(of_variants(spark, spec)).first()[0] == pytest.approx(sum(alike) / len(alike), abs=1e-6)
    assert complexity.affinity(of_variants(spark, {"a": 3})).first()[0] == 0.0
    assert complexity.affinity(of_variants(spark, {"a,b": 1})).first()[0] is None


def test_states_are_prefixes(spark):
    """As many states as distinct prefixes, also where activities repeat or contain the arrow."""
    spec = {"a,b,a,b": 2, "b,a,b,a": 1, "a→b,a": 1, "a,b→a": 1, "a,a,a,a,a,a": 3}
    prefixes = {tuple(v.split(",")[:k]) for v in spec for k in range(1, len(v.split(",")) + 1)}
    states = complexity.prefix_states(of_variants(spark, spec))
    assert states.count() == len(prefixes) == states.select("state").distinct().count()
    leaves = [p for p in prefixes if not any(q[: len(p)] == p and len(q) > len(p) for q in prefixes)]
    assert complexity.n_ties(of_variants(spark, spec)).first()[0] == sum(map(len, leaves))


def test_series_of_a_slice_is_the_log_of_its_cases(spark):
    """Cases in several slices, a slice of single events, a case in no slice."""
    log = of_variants(spark, {"a,b,c": 3, "a,c,b": 2, "d": 2, "a,b,b,a": 1})
    ids = log.traces().select("case_id", F.array_join("trace", "").alias("v"))
    slices = ids.where("v <> 'd'").select("case_id", F.lit(1).alias("slice")).union(ids.where("v IN ('d')").selectExpr("case_id", "2")).union(ids.where("v = 'acb' OR v = 'd'").selectExpr("case_id", "3"))
    got = {r["slice"]: r.asDict() for r in metric_series.metric_series(log, slices).collect()}
    assert set(got) == {1, 2, 3} and all(v is None or math.isfinite(v) for r in got.values() for v in r.values())
    for k, row in got.items():
        held = [r["case_id"] for r in slices.where(F.col("slice") == k).collect()]
        part = EventLog(log.df.where(F.col("case_id").isin(held)))
        want = {}
        for f in (complexity.size_metrics, complexity.order_variation, complexity.structure, complexity.time_granularity):
            want |= f(part).first().asDict()
        want |= {f"{r['metric']}_entropy": r["value"] for r in complexity.epa_entropy(part).collect()}
        want.pop("activities")
        assert {c: row[c] for c in want} == want, k
    assert metric_series.metric_series(log, slices.limit(0)).count() == 0


def test_object_centric_nets_meet_in_activities(spark):
    """An order with two items: both types pass pack, of which only the item's arcs are variable."""
    at = lambda h: datetime(2024, 1, 1, h)
    data = [("e1", "order", "o1", "place", 1), ("e2", "order", "o1", "pack", 3), ("e3", "item", "i1", "pick", 2), ("e4", "item", "i2", "pick", 2), ("e2", "item", "i1", "pack", 3), ("e2", "item", "i2", "pack", 3)]
    rel = spark.createDataFrame([(e, o, t, a, at(h), None) for e, t, o, a, h in data], "eid string, oid string, type string, activity string, timestamp timestamp_ntz, qualifier string")
    log = ObjectLog(rel.select("eid", "activity", "timestamp").distinct(), rel.select("oid", "type").distinct(), rel, rel.selectExpr("oid", "oid AS oid_2", "qualifier").limit(0))
    assert rows(miners.object_centric_net(log)) == {
        ("place", "order:source", "place", "order", False), ("transition", "place", "order:p1", "order", False), ("place", "order:p1", "pack", "order", False), ("transition", "pack", "order:sink", "order", False),
        ("place", "item:source", "pick", "item", False), ("transition", "pick", "item:p1", "item", False), ("place", "item:p1", "pack", "item", True), ("transition", "pack", "item:sink", "item", True),
    }


def test_roles_over_blocks(spark, monkeypatch):
    """Blocks of three profiles, multiples of one profile, flat profiles, chains of links, a null resource."""
    monkeypatch.setattr(simulation, "_BLOCK", 3)
    rng = random.Random(11)
    profiles = {f"r{k:02d}": [rng.choice([0, 0, 1, 4, 9]) for _ in range(6)] for k in range(30)}
    profiles |= {"m1": [1, 2, 0, 0, 0, 0], "m2": [3, 6, 0, 0, 0, 0], "f1": [2] * 6, "f2": [2] * 6, "f3": [4] * 6}
    profiles = {r: p for r, p in profiles.items() if any(p)}
    data = [(r, "abcdef"[j]) for r, p in profiles.items() for j, n in enumerate(p) for _ in range(n)] + [(None, "a")]
    log = EventLog(spark.createDataFrame([(f"c{i}", a, datetime(2024, 1, 1), i, r) for i, (r, a) in enumerate(data)], "case_id string, activity string, timestamp timestamp_ntz, seq long, resource string"))

    def linked(x, y):
        sx, sy = sum(x), sum(y)
        return 6 * sum(a * b for a, b in zip(x, y, strict=True)) - sx * sy > 0.7 * math.sqrt((6 * sum(a * a for a in x) - sx**2) * (6 * sum(b * b for b in y) - sy**2))

    label = {r: r for r in profiles}
    for _ in profiles:
        for a, b in itertools.permutations(profiles, 2):
            if linked(profiles[a], profiles[b]):
                label[a] = min(label[a], label[b])
    order = {x: k for k, x in enumerate(sorted(set(label.values())))}
    got = rows(simulation.resource_roles(log))
    assert got == {(r, order[x]) for r, x in label.items()} and len(set(label.values())) > 4
    assert simulation.resource_roles(EventLog(log.df.limit(0))).count() == 0
