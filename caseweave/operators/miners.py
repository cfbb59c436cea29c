"""Process models mined from aggregated tables, and distances between stochastic languages.

The aggregates (edges, footprints, variants with counts) are Spark tables. Inductive
mining splits the table of all variants in Spark at every cut; the driver sees only the
directly-follows counts of each part, which the number of activities bounds. Distances
between languages take a stated number of variants, which is part of their definition.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave.log import EventLog, ObjectLog
from caseweave.operators import discovery, ocel

#: What the driver holds is at most the square of this many counts; more activities raise an error.
MAX_ACTIVITIES = 2_000
EMD_VARIANTS = 100


def _arcs(log: EventLog | ObjectLog, rows: list[tuple]) -> DataFrame:
    df = log.df if isinstance(log, EventLog) else log.events
    return df.sparkSession.createDataFrame(rows, "kind string, source string, target string")


def _footprint(log: EventLog) -> tuple[set[str], set[tuple[str, str]], set[str], set[str]]:
    edges = {(r["source"], r["target"]) for r in discovery.edge_counts(log).collect()}
    nodes = discovery.dfg_nodes(log).collect()
    if len(nodes) > MAX_ACTIVITIES:
        raise ValueError(f"more than {MAX_ACTIVITIES} activities")
    return {r["activity"] for r in nodes}, edges, {r["activity"] for r in nodes if r["starts"]}, {r["activity"] for r in nodes if r["ends"]}


def _maximal_cliques(near: dict) -> Iterator[set]:
    """The maximal cliques of a graph given by neighbours, by branching on what is not next to a pivot."""
    open_ = [(set(), set(near), set())]
    while open_:
        clique, may, done = open_.pop()
        if not may and not done:
            yield clique
            continue
        if not may:
            continue
        pivot = max(may | done, key=lambda x: len(near[x] & may))
        for x in list(may - near[pivot]):
            open_.append((clique | {x}, may & near[x], done & near[x]))
            may = may - {x}
            done = done | {x}


def alpha(log: EventLog, loops: bool = False) -> DataFrame:
    """Alpha miner net as arcs (kind place / transition). With loops, loops of one and two are told from concurrency."""
    names, follows, starts, ends = _footprint(log)
    short = {a for a, b in follows if a == b} if loops else set()
    two = {(r["a"], r["b"]) for r in discovery.loops_of_two(log).collect()} if loops else set()
    causal = {(a, b) for a, b in follows if (b, a) not in follows or ((a, b) in two and a != b)}
    apart = lambda group: all((x, y) not in follows and (y, x) not in follows for x in group for y in group)
    names -= short
    causal = {(a, b) for a, b in causal if a in names and b in names}
    alone = {x for x in names if apart([x])}
    # A place joins a set of left and one of right activities: a clique of what goes together, maximal and with both sides.
    near: dict[tuple[int, str], set] = {(side, x): {(side, y) for y in alone if y != x and apart([x, y])} for side in (0, 1) for x in alone}
    for a, b in causal:
        if a in alone and b in alone:
            near[0, a].add((1, b))
            near[1, b].add((0, a))
    sides = ([sorted(x for k, x in clique if k == side) for side in (0, 1)] for clique in _maximal_cliques(near))
    places = sorted((left, right) for left, right in sides if left and right)
    rows = [("place", "source", x) for x in sorted(starts & names)] + [("transition", x, "sink") for x in sorted(ends & names)]
    for left, right in places:
        p = f"p({','.join(left)}|{','.join(right)})"
        rows += [("transition", a, p) for a in left] + [("place", p, b) for b in right]
        rows += [arc for s in sorted(short) if any((a, s) in follows for a in left) and any((s, b) in follows for b in right) for arc in (("place", p, s), ("transition", s, p))]
    return _arcs(log, rows)


def heuristics(log: EventLog, dependency: float = 0.5, and_threshold: float = 0.65) -> DataFrame:
    """Arcs of the heuristics net, with AND between two targets of an activity where they follow each other often."""
    kept = [r for r in discovery.heuristics_edges(log, dependency).collect() if r["kept"]]
    counts = {(r["source"], r["target"]): r["frequency"] for r in discovery.edge_counts(log).collect()}
    rows = [("edge", r["source"], r["target"]) for r in kept]
    out: dict[str, list[str]] = {}
    for r in kept:
        out.setdefault(r["source"], []).append(r["target"])
    for a, targets in out.items():
        for b, c in combinations(sorted(targets), 2):
            share = (counts.get((b, c), 0) + counts.get((c, b), 0)) / (counts.get((a, b), 0) + counts.get((a, c), 0) + 1)
            rows.append(("and" if share >= and_threshold else "xor", f"{a}→{b}", f"{a}→{c}"))
    return _arcs(log, sorted(rows))


Tree = tuple | str | None


def _parts(nodes: set[str], linked) -> list[set[str]]:
    """Connected components of nodes under a symmetric relation."""
    left, out = set(nodes), []
    while left:
        group, todo = set(), [min(left)]
        while todo:
            x = todo.pop()
            if x not in group:
                group.add(x)
                todo += [y for y in left if y not in group and (linked(x, y) or linked(y, x))]
        left -= group
        out.append(group)
    return out


def _among(a: Column, names: set[str]) -> Column:
    return a.isin(sorted(names))


def _place(a: Column, groups: list[set[str]]) -> Column:
    """The number of the group an activity is in."""
    out = F.lit(None).cast("int")
    for k, g in enumerate(groups):
        out = F.when(_among(a, g), k).otherwise(out)
    return out


def _summed(parts: DataFrame) -> DataFrame:
    return parts.groupBy("trace").agg(F.sum("n_cases").alias("n_cases"))


def _only(names: set[str]) -> Column:
    return F.filter("trace", lambda a: _among(a, names))


def _kept(log: DataFrame, names: set[str]) -> DataFrame:
    return _summed(log.select(_only(names).alias("trace"), "n_cases"))


def _in_order(log: DataFrame, groups: list[set[str]]) -> list[DataFrame]:
    """The part of each trace in each group, as long as groups come in order."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<k:int,a:string>>").alias("out"))

    def step(acc: Column, a: Column) -> Column:
        k = _place(a, groups)
        more = F.concat(acc["out"], F.array(F.struct(k.alias("k"), a.alias("a"))))
        return F.struct(F.greatest(acc["at"], k).alias("at"), F.when(k >= acc["at"], more).otherwise(acc["out"]).alias("out"))

    kept = log.select(F.aggregate("trace", start, step, lambda acc: acc["out"]).alias("steps"), "n_cases")
    of = lambda k: F.transform(F.filter("steps", lambda s: s["k"] == k), lambda s: s["a"])
    return [_summed(kept.select(of(k).alias("trace"), "n_cases")) for k in range(len(groups))]


def _runs(log: DataFrame, redo: list[set[str]]) -> list[DataFrame]:
    """The runs of each trace in the body (0) and in each redo part; a trace begins and ends in the body."""
    start = F.array(F.struct(F.lit(0).alias("k"), F.array().cast("array<string>").alias("t")))

    def step(acc: Column, a: Column) -> Column:
        k = F.coalesce(_place(a, redo) + 1, F.lit(0))
        last = F.element_at(acc, -1)
        same = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct(k.alias("k"), F.concat(last["t"], F.array(a)).alias("t"))))
        return F.when(last["k"] == k, same).otherwise(F.concat(acc, F.array(F.struct(k.alias("k"), F.array(a).alias("t")))))

    runs = log.select(F.explode(F.aggregate("trace", start, step)).alias("run"), "n_cases").select("run.k", F.col("run.t").alias("trace"), "n_cases")
    return [_summed(runs.where(F.col("k") == k)) for k in range(len(redo) + 1)]


def _follows(log: DataFrame) -> dict[tuple[str | None, str | None], int]:
    """Cases by pair of neighbours, None standing for the start and the end; at most one row a pair of activities."""
    none = F.array(F.lit(None).cast("string"))
    padded = F.concat(none, F.col("trace"), none)
    pairs = F.zip_with(F.slice(padded, F.lit(1), F.size(padded) - 1), F.slice(padded, F.lit(2), F.size(padded)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    rows = log.select(F.explode(pairs).alias("p"), "n_cases").groupBy("p").agg(F.sum("n_cases").alias("n")).limit((MAX_ACTIVITIES + 2) ** 2).collect()
    return {(r["p"]["a"], r["p"]["b"]): r["n"] for r in rows}


def mine_tree(variants: DataFrame, noise: float = 0.0) -> Tree:
    """Process tree of variants (trace, n_cases), by inductive cuts on their directly-follows graph.

    Nodes are (operator, child, ...), a name, or None for silence. With noise, edges
    below that share of their source's strongest edge are ignored when cutting. Each
    part of the log is kept while its own parts are mined.
    """
    log = variants.select("trace", "n_cases").persist()
    try:
        return _mined(log, noise)
    finally:
        log.unpersist()


def _mined(log: DataFrame, noise: float) -> Tree:
    counts = _follows(log)
    empty = counts.pop((None, None), 0)
    starts, ends = {b for a, b in counts if a is None}, {a for a, b in counts if b is None}
    edges = {(a, b): n for (a, b), n in counts.items() if a is not None and b is not None}
    names = starts | ends | {x for pair in edges for x in pair}
    if len(names) > MAX_ACTIVITIES:
        raise ValueError(f"more than {MAX_ACTIVITIES} activities")
    if not names:
        return None
    if empty:
        cases = empty + sum(n for (a, _), n in counts.items() if a is None)
        body = mine_tree(log.where(F.size("trace") > 0), noise)
        return body if noise and empty < noise * cases else ("xor", body, None)
    if len(names) == 1:
        (a,) = names
        return ("loop", a, None) if edges else a
    if noise:
        top = {a: max(n for (x, _), n in edges.items() if x == a) for a, _ in edges}
        edges = {(a, b): n for (a, b), n in edges.items() if n >= noise * top[a]}

    groups = _parts(names, lambda a, b: (a, b) in edges)
    if len(groups) > 1:
        # A trace goes to the part that holds most of it.
        share = [F.size(_only(g)) for g in groups]
        best = F.lit(0)
        for k in range(len(groups) - 1, -1, -1):
            best = F.when(share[k] == F.greatest(*share), k).otherwise(best)
        dealt = log.withColumn("k", best)
        return ("xor", *(mine_tree(_kept(dealt.where(F.col("k") == k), g), noise) for k, g in enumerate(groups)))

    reach = {a: {a} for a in names}
    for _ in names:
        for a, b in edges:
            reach[a] |= reach[b]
    groups = _parts(names, lambda a, b: (b in reach[a]) == (a in reach[b]))
    if len(groups) > 1:
        groups.sort(key=lambda g: sum(any(b in reach[a] for a in g) for b in names), reverse=True)
        return ("sequence", *(mine_tree(part, noise) for part in _in_order(log, groups)))

    groups = _parts(names, lambda a, b: not ((a, b) in edges and (b, a) in edges))
    if len(groups) > 1 and all(g & starts and g & ends for g in groups):
        return ("parallel", *(mine_tree(_kept(log, g), noise) for g in groups))

    body = starts | ends
    inner = {(a, b) for a, b in edges if not (a in ends and b in starts)}
    rest = _parts(names - body, lambda a, b: (a, b) in inner)
    redo = [g for g in rest if not any((a, b) in edges for a in starts - ends for b in g) and not any((a, b) in edges for a in g for b in ends - starts)]
    if redo:
        return ("loop", *(mine_tree(part, noise) for part in _runs(log, redo)))

    return ("loop", None, *sorted(names))


def accepts(tree: Tree, trace: tuple[str, ...]) -> bool:
    """Whether a tree can produce a trace."""
    memo: dict = {}

    def spans(node: Tree, i: int) -> frozenset[int]:
        """Positions a node can reach from i."""
        if node is None:
            return frozenset([i])
        if isinstance(node, str):
            return frozenset([i + 1]) if i < len(trace) and trace[i] == node else frozenset()
        key = (id(node), i)
        if key not in memo:
            memo[key] = frozenset()
            op, *kids = node
            if op == "xor":
                out = {j for k in kids for j in spans(k, i)}
            elif op == "sequence":
                out = {i}
                for k in kids:
                    out = {x for j in out for x in spans(k, j)}
            elif op == "loop":
                out, todo = set(), set(spans(kids[0], i))
                while todo:
                    out |= todo
                    mid = {x for j in todo for k in kids[1:] for x in spans(k, j)}
                    todo = {x for j in mid for x in spans(kids[0], j)} - out
            else:
                sets = [leaves(k) for k in kids]
                out = set()
                for j in range(i, len(trace) + 1):
                    part = trace[i:j]
                    if all(any(a in s for s in sets) for a in part) and all(accepts(k, tuple(a for a in part if a in s)) for k, s in zip(kids, sets, strict=True)):
                        out.add(j)
            memo[key] = frozenset(out)
        return memo[key]

    return len(trace) in spans(tree, 0)


def leaves(tree: Tree) -> set[str]:
    if tree is None:
        return set()
    return {tree} if isinstance(tree, str) else {a for k in tree[1:] for a in leaves(k)}


def variants_of(log: EventLog, most: int) -> dict[tuple[str, ...], int]:
    """The most frequent variants with counts; a bounded number reaches the driver."""
    rows = log.variants().withColumn("v", F.array_join("trace", "→")).orderBy(F.desc("n_cases"), "v").limit(most).collect()
    return {tuple(r["trace"]): r["n_cases"] for r in rows}


def inductive(log: EventLog, noise: float = 0.0) -> DataFrame:
    """Process tree as arcs from each operator node to its children; nodes are numbered in depth-first order."""
    return _arcs(log, _tree_rows(mine_tree(log.variants(), noise)))


def net_of_tree(tree: Tree) -> list[tuple[str, str, str]]:
    """Arcs of the workflow net of a process tree; silent transitions are named tau and numbered."""
    rows: list[tuple[str, str, str]] = []
    count = {"p": 0, "tau": 0}

    def fresh(kind: str) -> str:
        count[kind] += 1
        return f"{kind}{count[kind]}"

    def pass_through(t: str, before: str, after: str) -> None:
        rows.extend([("place", before, t), ("transition", t, after)])

    def build(node: Tree, before: str, after: str) -> None:
        if not isinstance(node, tuple):
            pass_through(fresh("tau") if node is None else node, before, after)
            return
        op, *kids = node
        if op == "sequence":
            stops = [before, *(fresh("p") for _ in kids[1:]), after]
            for k, child in enumerate(kids):
                build(child, stops[k], stops[k + 1])
        elif op == "xor":
            for child in kids:
                build(child, before, after)
        elif op == "parallel":
            split, join = fresh("tau"), fresh("tau")
            rows.extend([("place", before, split), ("transition", join, after)])
            for child in kids:
                a, b = fresh("p"), fresh("p")
                rows.extend([("transition", split, a), ("place", b, join)])
                build(child, a, b)
        else:
            start, done = fresh("p"), fresh("p")
            pass_through(fresh("tau"), before, start)
            build(kids[0], start, done)
            for child in kids[1:]:
                build(child, done, start)
            pass_through(fresh("tau"), done, after)

    build(tree, "source", "sink")
    return rows


def inductive_net(log: EventLog, noise: float = 0.0) -> DataFrame:
    """The inductive miner's process tree as a Petri net."""
    return _arcs(log, net_of_tree(mine_tree(log.variants(), noise)))


class Unstructured(ValueError):
    """A net that is not built from blocks, so it has no process tree."""


def _joined(op: str, *kids: Tree) -> Tree:
    """An operator node, without nested nodes of a sequence, choice or concurrency, and without silent steps that do nothing."""
    flat: list[Tree] = []
    for k in kids:
        flat += k[1:] if isinstance(k, tuple) and k[0] == op else [k]
    if op in ("sequence", "parallel"):
        flat = [k for k in flat if k is not None]
    if op == "xor" and None in flat:
        flat = [k for k in flat if k is not None] + [None]
    return (op, *flat) if len(flat) > 1 else flat[0] if flat else None


def tree_of_net(arcs: list[tuple[str, str, str]]) -> Tree:
    """The process tree of a workflow net given by its arcs, from place source to place sink.

    Blocks of the net are replaced by one transition until one is left: transitions
    between the same places (xor), two around a place of their own (sequence), two
    between places that fill and empty together (parallel), one there and one back
    (loop), and one that takes and gives one token of a place (loop around nothing);
    places that hold a token just when others do are left out.
    Each replacement keeps the net's language. Raises Unstructured where none applies.
    Transitions named tau and a number are silent; more activities than the miners take are an error.
    """
    take: dict[str, set[str]] = {}
    give: dict[str, set[str]] = {}
    for kind, a, b in arcs:
        t, place, side = (b, a, take) if kind == "place" else (a, b, give)
        take.setdefault(t, set())
        give.setdefault(t, set())
        side[t].add(place)
    if len(take) > 4 * MAX_ACTIVITIES:
        raise ValueError(f"more than {MAX_ACTIVITIES} activities")
    tree: dict[str, Tree] = {t: None if t.startswith("tau") and t[3:].isdigit() else t for t in take}
    into: dict[str, set[str]] = {"source": set(), "sink": set()}
    out: dict[str, set[str]] = {"source": set(), "sink": set()}
    for t in take:
        for p in take[t]:
            out.setdefault(p, set()).add(t)
            into.setdefault(p, set())
        for p in give[t]:
            into.setdefault(p, set()).add(t)
            out.setdefault(p, set())
    if into["source"] or out["sink"]:
        raise Unstructured("the net's source has arcs in, or its sink arcs out")
    if any(not take[t] or not give[t] for t in take):
        raise Unstructured("a transition has no place before it, or none after it")
    made = 0

    def drop(t: str) -> None:
        for p in take.pop(t):
            out[p].discard(t)
        for p in give.pop(t):
            into[p].discard(t)
        del tree[t]

    def drop_place(p: str) -> None:
        for t in out.pop(p):
            take[t].discard(p)
        for t in into.pop(p):
            give[t].discard(p)

    def choices() -> bool:
        groups: dict[tuple, list[str]] = {}
        for t in sorted(take):
            groups.setdefault((frozenset(take[t]), frozenset(give[t])), []).append(t)
        many = [g for g in groups.values() if len(g) > 1]
        for g in many:
            tree[g[0]] = _joined("xor", *(tree[t] for t in g))
            for t in g[1:]:
                drop(t)
        return bool(many)

    def sequences() -> bool:
        found = False
        for p in sorted(into):
            if len(into[p]) == len(out[p]) == 1:
                (a,), (b,) = into[p], out[p]
                if a != b and give[a] == {p} and take[b] == {p}:
                    tree[a] = _joined("sequence", tree[a], tree[b])
                    after = set(give[b])
                    drop(b)
                    drop_place(p)
                    for q in after:
                        give[a].add(q)
                        into[q].add(a)
                    found = True
        return found

    def parallels() -> bool:
        groups: dict[tuple, list[str]] = {}
        for t in sorted(take):
            if len(take[t]) == len(give[t]) == 1:
                (p,), (q,) = take[t], give[t]
                if p != q and out[p] == into[q] == {t} and into[p] and out[q]:
                    groups.setdefault((frozenset(into[p]), frozenset(out[q])), []).append(t)
        many = [g for g in groups.values() if len(g) > 1]
        for g in many:
            tree[g[0]] = _joined("parallel", *(tree[t] for t in g))
            for t in g[1:]:
                (p,), (q,) = take[t], give[t]
                drop(t)
                drop_place(p)
                drop_place(q)
        return bool(many)

    def spare_places() -> bool:
        """Places that fill and empty with another place, or with a transition between places of its own, change nothing."""
        first: dict[tuple, str] = {}
        spare = [p for p in sorted(into) if p not in ("source", "sink") and first.setdefault((frozenset(into[p]), frozenset(out[p])), p) != p]
        around = {}
        for t in take:
            if len(take[t]) == len(give[t]) == 1:
                (p,), (q,) = take[t], give[t]
                if p != q and out[p] == into[q] == {t} and into[p] and out[q]:
                    around[frozenset(into[p]), frozenset(out[q])] = t
        spare += [p for key, p in first.items() if key in around and around[key] not in key[0] | key[1]]
        for p in spare:
            drop_place(p)
        return bool(spare)

    def loops() -> bool:
        nonlocal made
        for t in sorted(take):
            if len(take[t]) != 1 or len(give[t]) != 1:
                continue
            (p,), (q,) = take[t], give[t]
            if p == q:
                # The place is cut in two, with the loop between them.
                made += 1
                after = f"{p}'{made}"
                rest = out[p] - {t}
                into[p].discard(t)
                into[after], out[after], out[p] = {t}, rest, {t}
                for x in rest:
                    take[x] = take[x] - {p} | {after}
                give[t] = {after}
                tree[t] = ("loop", None, tree[t])
                return True
            back = sorted(out[q] & into[p]) if out[p] == {t} and into[q] == {t} else []
            back = [x for x in back if take[x] == {q} and give[x] == {p}]
            if back:
                tree[t] = ("loop", tree[t], tree[back[0]])
                drop(back[0])
                return True
        return False

    while choices() or sequences() or parallels() or spare_places() or loops():
        pass
    if len(take) == 1:
        (t,) = take
        if take[t] == {"source"} and give[t] == {"sink"} and set(into) == {"source", "sink"}:
            return tree[t]
    raise Unstructured(f"{len(take)} transitions are left that form no block")


def _tree_rows(tree: Tree) -> list[tuple[str, str, str]]:
    rows: list[tuple[str, str, str]] = []

    def walk(node: Tree, name: str) -> None:
        for k, child in enumerate(node[1:] if isinstance(node, tuple) else ()):
            label = "τ" if child is None else child if isinstance(child, str) else child[0]
            below = f"{name}.{k}"
            rows.append((node[0], name, f"{below}:{label}"))
            walk(child, below)

    if isinstance(tree, tuple):
        walk(tree, "0")
    elif tree is not None:
        rows.append(("activity", "0", tree))
    return rows


def alpha_tree(log: EventLog, loops: bool = False) -> DataFrame:
    """The alpha miner's net as a process tree, in the arcs of `inductive`.

    A net that is not built from blocks gives one row of kind unstructured with the reason.
    """
    return net_tree(alpha(log, loops))


def net_tree(net: DataFrame) -> DataFrame:
    """The process tree of a net given as arcs (kind, source, target), in the arcs of `inductive`; see `tree_of_net`."""
    most = 16 * MAX_ACTIVITIES**2
    arcs = [(r["kind"], r["source"], r["target"]) for r in net.limit(most + 1).collect()]
    if len(arcs) > most:
        raise ValueError("more arcs than a net of the miners' activities has")
    try:
        rows = _tree_rows(tree_of_net(arcs))
    except Unstructured as reason:
        rows = [("unstructured", "0", str(reason))]
    return net.sparkSession.createDataFrame(rows, "kind string, source string, target string")


def object_centric_net(log: ObjectLog, noise: float = 0.2) -> DataFrame:
    """One net for all object types: (kind, source, target, type, variable), an arc a row.

    Each type's net is that of its inductive tree, with places and silent steps of its
    own (named type:place); the nets meet in the activities. An arc of an activity whose
    events hold several objects of the type, or at times none, is variable.
    """
    types = [r["type"] for r in log.relations.select("type").distinct().orderBy("type").limit(MAX_ACTIVITIES).collect()]
    marks = ocel.variable_arcs(log).where("variable").limit(MAX_ACTIVITIES**2).collect()
    variable = {(r["activity"], r["type"]) for r in marks}
    rows = []
    for t in types:
        silent = lambda x: x.startswith("tau") and x[3:].isdigit()
        for kind, a, b in net_of_tree(mine_tree(log.flatten(t).variants(), noise)):
            step = b if kind == "place" else a
            own = lambda x: f"{t}:{x}" if x != step or silent(step) else x  # noqa: B023, E731
            rows.append((kind, own(a), own(b), t, (step, t) in variable and not silent(step)))
    return log.events.sparkSession.createDataFrame(rows, "kind string, source string, target string, type string, variable boolean")


def transport(cost: list[list[float]], a: list[float], b: list[float]) -> float:
    """Cost of the optimal transport of masses a to b, by successive shortest paths."""
    n, m = len(a), len(b)
    a, b, total = list(a), list(b), 0.0
    flow = [[0.0] * m for _ in range(n)]
    up, down = [0.0] * n, [0.0] * m
    while (s := next((i for i in range(n) if a[i] > 1e-12), None)) is not None:
        far, came, done = {("a", s): 0.0}, {}, set()
        end = None
        while True:
            node = min((x for x in far if x not in done), key=lambda x: far[x], default=None)
            if node is None:
                break
            done.add(node)
            side, k = node
            if side == "b" and b[k] > 1e-12:
                end = k
                break
            steps = ((("b", j), cost[k][j] - up[k] - down[j]) for j in range(m)) if side == "a" else ((("a", i), -(cost[i][k] - up[i] - down[k])) for i in range(n) if flow[i][k] > 1e-12)
            for to, w in steps:
                if to not in done and far[node] + w < far.get(to, float("inf")) - 1e-15:
                    far[to], came[to] = far[node] + w, node
        if end is None:
            break
        reach = far["b", end]
        for side, k in done:
            if side == "a":
                up[k] += reach - far[side, k]
            else:
                down[k] -= reach - far[side, k]
        path, x = [], ("b", end)
        while x in came:
            path.append((came[x], x))
            x = came[x]
        move = min([a[s], b[end], *(flow[v[1]][u[1]] for u, v in path if u[0] == "b")])
        for u, v in path:
            if u[0] == "a":
                flow[u[1]][v[1]] += move
                total += move * cost[u[1]][v[1]]
            else:
                flow[v[1]][u[1]] -= move
                total -= move * cost[v[1]][u[1]]
        a[s], b[end] = a[s] - move, b[end] - move
    return total


def token_distance(a: tuple[str, ...], b: tuple[str, ...]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def language_distance(a: dict[tuple[str, ...], int], b: dict[tuple[str, ...], int]) -> float:
    """Earth mover's distance of two variant distributions under normalised edit distance."""
    x, y = list(a), list(b)
    if not x or not y:
        return 0.0 if not x and not y else 1.0
    cost = [[token_distance(p, q) / max(1, len(p), len(q)) for q in y] for p in x]
    return transport(cost, [n / sum(a.values()) for n in a.values()], [n / sum(b.values()) for n in b.values()])


def emd(a: EventLog, b: EventLog, top: int = EMD_VARIANTS) -> DataFrame:
    """Earth mover's distance of two logs over their `top` variants, renormalised."""
    value = language_distance(variants_of(a, top), variants_of(b, top))
    return a.df.sparkSession.createDataFrame([(round(value, 6),)], "emd double")
