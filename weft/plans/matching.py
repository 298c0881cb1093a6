"""MATCH: sentences to bindings.

Predicates on one vertex go to its scan. A pattern with symmetries is bound once per orbit: only bindings that are the least, in the order of ids, of their images are
joined, and the images are made from them at the end, without another join. A triangle is so found once and not six times.

Where all edges of a pattern are of one relation that joins the members of classes (`PropertyGraph.classes`), its bindings are as many as the product of the classes' sizes, and
counting them needs none of them: see `class_count`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import parse, variables
from .catalogue import Catalogue
from .lower import executed
from .pattern import Pattern, PatternError
from .pattern_planner import heuristic_order
from .planner import Link, Plan, Planner, QueryGraph, Vertex


def ordered_plan(query: QueryGraph, order: list[str]) -> Plan:
    """The left-deep plan of an order, without costs."""
    plan = Plan("scan", frozenset(order[:1]), 0.0, 0.0, order[0])
    for alias in order[1:]:
        links = query.between(alias, plan.covered)
        if not links:
            raise PatternError("the pattern may be disconnected")
        plan = Plan("expand", plan.covered | {alias}, 0.0, 0.0, alias, tuple(links), (plan,))
    return plan


def symmetries(label: dict[str, str], inner: list[tuple[str, str, str]], predicates: dict[str, str], symmetric: frozenset[str]) -> list[dict[str, str]]:
    """Renamings of the bound vertices that leave pattern and predicates as they are, the identity first."""
    names = list(label)
    place = {n: i for i, n in enumerate(names)}
    # A vertex with a predicate has no equals but itself
    kinds = {place[n]: label[n] if n not in predicates else f"{label[n]} {n}" for n in names}
    found = Pattern.of(kinds, [(place[s], place[e], r) for s, r, e in inner]).automorphisms(symmetric)
    return [{names[t]: names[u] for t, u in x.items()} for x in found]


def least(group: list[dict[str, str]], names: list[str]) -> tuple[list[str], list[tuple[str, str, Column]]]:
    """An order of the names, and the conditions between two of them that the least binding of an orbit fulfils."""
    order, conditions, fixing = [], [], group
    while len(order) < len(names):
        orbit = {n: {g[n] for g in fixing} for n in names if n not in order}
        first = max(orbit, key=lambda n: len(orbit[n]))
        conditions += [(first, x, F.col(f"{first}__id") <= F.col(f"{x}__id")) for x in sorted(orbit[first] - {first})]
        order.append(first)
        fixing = [g for g in fixing if g[first] == first]
    return order, conditions


def unfolded(df: DataFrame, group: list[dict[str, str]], order: list[str]) -> DataFrame:
    """All distinct images of the bindings that are the least of theirs."""
    image = lambda g: F.struct(*[F.col(f"{g[n]}__id").alias(f"{n}__id") for n in order])
    images = [image(g) for g in group]
    # Two images are the same where a binding has a vertex twice
    for other in images[1:]:
        df = df.where(images[0] <= other)
    new = [images[0], *[F.when(~reduce(lambda a, b: a | b, [x == y for y in images[:k]]), x) for k, x in enumerate(images) if k]]
    rows = df.select(F.explode(F.array(*new)).alias("_b")).where("_b IS NOT NULL")
    return rows.select(*[F.col(f"_b.{n}__id").alias(f"{n}__id") for n in order])


#: Pairs of vertices with an edge that a pattern may have to be counted by classes: the terms are two to the power of that.
CLASS_PAIRS = 10


def class_terms(edges: list[tuple[str, str]]) -> dict[tuple[int, ...], int]:
    """Coefficients of products of power sums, by their powers, that give the bindings of a pattern in one class.

    A vertex row that occurs w times gives each of its edges the factor w. Ends of an edge must differ: by inclusion and exclusion over the pairs whose ends
    do not, each part that these pairs connect is one vertex, which has the factor w to the power of the part's degrees.
    """
    degree = Counter(x for e in edges for x in e)
    pairs = sorted({tuple(sorted(e)) for e in edges})
    terms: Counter[tuple[int, ...]] = Counter()
    for k in range(len(pairs) + 1):
        for same in combinations(pairs, k):
            part = {x: x for x in degree}
            for a, b in same:
                part = {x: part[a] if p == part[b] else p for x, p in part.items()}
            powers = Counter()
            for x, p in part.items():
                powers[p] += degree[x]
            terms[tuple(sorted(powers.values()))] += (-1) ** k
    return {t: n for t, n in terms.items() if n}


def class_count(graph, relation, edges: list[tuple[str, str]]) -> DataFrame | None:
    """`n`, the number of bindings of a connected pattern whose edges all are of one relation of `graph.classes`; None where an id is in several classes."""
    keys = list(graph.classes[relation])
    rows = graph.vertex_tables[relation.src].select("id", *keys).dropna()
    rows = rows.groupBy(*keys, "id").agg(F.count(F.lit(1)).cast("decimal(38,0)").alias("w"))
    if not rows.groupBy("id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").isEmpty():
        return None
    terms = class_terms(edges)
    product = lambda columns: reduce(lambda a, b: a * b, columns).cast("decimal(38,0)")
    sums = rows.groupBy(*keys).agg(*[F.sum(product([F.col("w")] * d)).cast("decimal(38,0)").alias(f"p{d}") for d in sorted({d for t in terms for d in t})], F.count(F.lit(1)).alias("size"))
    each = [product([F.lit(n).cast("decimal(38,0)"), *[F.col(f"p{d}") for d in t]]) for t, n in terms.items()]
    total = reduce(lambda a, b: (a + b).cast("decimal(38,0)"), each, F.lit(0).cast("decimal(38,0)"))
    return sums.agg(F.coalesce(F.sum(total), F.lit(0)).cast("long").alias("n"))


def counter(graph, sentences, label, edges, predicates) -> Callable[[], DataFrame] | None:
    """What counts the bindings without making them, where the pattern allows it."""
    relations = {x for s, r, e, _ in edges for x in graph.schema.matching(r, [label[s]], [label[e]])}
    pairs = {frozenset((s, e)) for s, _, e, _ in edges}
    if predicates or len(relations) != 1 or not relations <= set(graph.classes) or any(k != "inner" for *_, k in edges) or len(pairs) > CLASS_PAIRS:
        return None
    relation = next(iter(relations))

    def run() -> DataFrame:
        from ..operators.query import GraphQuery

        found = class_count(graph, relation, [(s, e) for s, _, e, _ in edges])
        if found is None:
            plain = graph.stored(relation.name)
            plain.classes = {}
            found = GraphQuery(plain).match(sentences, label).group_by({}, {"n": ("count",)}).df
        return found

    return run


def matched(outer, sentences, labels, predicates, catalogue: Catalogue | None):
    from ..operators.query import GraphQuery, QueryError

    graph = outer.graph
    edges = []
    for sentence in sentences:
        start, relation, end, *kind = sentence
        kind = kind[0] if kind else "inner"
        if kind not in ("inner", "semi", "anti"):
            raise QueryError(f"no sentence kind {kind!r}")
        edges.append((end, relation[1:], start, kind) if relation.startswith("<") else (start, relation, end, kind))
    names = list(dict.fromkeys(x for s, _, e, _ in edges for x in (s, e)))
    if bad := [n for n in names if n in outer.tags]:
        raise QueryError(f"tag {bad[0]!r} of the outer query can't be used in a pattern")
    found = graph.schema.inferred({n: labels.get(n) for n in names}, [(s, e, r) for s, r, e, _ in edges])
    several = [n for n in names if len(found[n]) > 1]
    if several:
        raise QueryError(f"{several[0]} may be any of {sorted(found[several[0]])}; give its label")
    label = {n: next(iter(found[n])) for n in names}
    inner = [(s, r, e) for s, r, e, k in edges if k == "inner"]
    bound = list(dict.fromkeys(x for s, _, e in inner for x in (s, e)))
    if not bound:
        raise QueryError("a pattern needs an inner sentence")
    query = QueryGraph({n: Vertex(n, label[n]) for n in bound}, [Link(s, e, r) for s, r, e in inner if s != e])
    if not query.connected():
        raise PatternError("the pattern may be disconnected")
    ranked = QueryGraph({n: Vertex(n, label[n], predicate=predicates.get(n)) for n in bound}, query.links)
    plan = Planner(query, catalogue).best() if catalogue else ordered_plan(query, heuristic_order(ranked))
    properties = lambda n: set(graph.columns_of([label[n]]))
    own = lambda n: all(tag in (None, n) and (prop or "~id").lstrip("~") in properties(n) for tag, prop in variables(parse(predicates[n])))
    filters = {n: predicates[n] for n in bound if n in predicates and own(n)}
    # Without a cycle, joining all bindings costs no more than making their images
    cyclic = len(query.links) >= len(bound)
    group = symmetries({n: label[n] for n in bound}, inner, predicates, graph.symmetric) if cyclic else []
    order, conditions = least(group, bound) if len(group) > 1 else (bound, [])
    df = executed(plan, graph, query, filters=filters, conditions=conditions)
    df = unfolded(df, group, order) if len(group) > 1 else df
    df = df.withColumns({f"{n}__label": F.lit(label[n]) for n in bound})
    out = GraphQuery(graph, df, {n: ("vertex", (label[n],)) for n in bound}, bound[-1])
    for s, r, e in inner:
        if s == e:
            out = out.edge_check(s, e, [r])
    for n in bound:
        if n in predicates and n not in filters:
            out = out._with(out.df, head=n).where(predicates[n])
    for s, r, e, kind in edges:
        if kind == "inner":
            continue
        free = [x for x in (s, e) if x not in bound]
        if len(free) == 2:
            raise PatternError("a semi or anti sentence must touch a bound vertex")
        if not free:
            out = out.edge_check(s, e, [r], distinct=True, negated=kind == "anti")
            continue
        have, way = (s, "out") if free[0] == e else (e, "in")

        def task(q, r=r, way=way, name=free[0], have=have):
            q = q.expand(have, [r], way, alias=name)
            return q.where(predicates[name]) if name in predicates else q

        out = out.apply(task, kind, on=have)
    out = out._with(out.df, head=bound[-1])
    out.counter = counter(graph, sentences, label, edges, predicates)
    return out
