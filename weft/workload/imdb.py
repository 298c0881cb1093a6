"""Join templates over a film database: 33 shapes of joins of its tables, as query graphs.

Every table is a vertex label and every foreign key a relation of its column's name, from the table that has it. A template is planned as any query graph is, with selectivities and
predicates set on its vertices, and lowered to joins.
"""

from __future__ import annotations

import re
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.pattern import Pattern
from ..plans.planner import Link, QueryGraph, Vertex
from ..sources.graph import PropertyGraph
from ..sources.schema import Relation

# Tables by alias, their foreign keys with the aliases they point to, and the joins of each template (alias: what its foreign keys point to, in order; - is not joined).
TABLES = {
    "an": "aka_name", "at": "aka_title", "cc": "complete_cast", "cct": "comp_cast_type", "chn": "char_name", "ci": "cast_info", "cn": "company_name", "ct": "company_type", "it": "info_type", "k": "keyword", "kt": "kind_type",
    "lt": "link_type", "mc": "movie_companies", "mi": "movie_info", "mi_idx": "movie_info_idx", "mk": "movie_keyword", "ml": "movie_link", "n": "name", "pi": "person_info", "rt": "role_type", "t": "title",
}
KEYS = {
    "an": "person_id:n", "at": "movie_id:t", "cc": "movie_id:t subject_id:cct status_id:cct", "ci": "movie_id:t person_id:n person_role_id:chn role_id:rt", "mc": "movie_id:t company_id:cn company_type_id:ct",
    "mi": "movie_id:t info_type_id:it", "mi_idx": "movie_id:t info_type_id:it", "mk": "movie_id:t keyword_id:k", "ml": "movie_id:t linked_movie_id:t link_type_id:lt", "pi": "person_id:n info_type_id:it", "t": "kind_id:kt",
}
TEMPLATES = {
    "q1": "mc:t,-,ct mi_idx:t,it",
    "q2": "mc:t,cn mk:t,k",
    "q3": "mk:t,k mi:t",
    "q4": "mi_idx:t,it mk:t,k",
    "q5": "mc:t,-,ct mi:t,it",
    "q6": "ci:t,n mk:t,k",
    "q7": "an:n pi:n,it ci:t,n ml:-,t,lt",
    "q8": "an:n ci:t,n,-,rt mc:t,cn",
    "q9": "an:n ci:t,n,chn,rt mc:t,cn",
    "q10": "ci:t,-,chn,rt mc:t,cn,ct",
    "q11": "mc:t,cn,ct mk:t,k ml:t,-,lt",
    "q12": "mc:t,cn,ct mi:t,it1 mi_idx:t,it2",
    "q13": "mc:t,cn,ct mi:t,it2 mi_idx:t,it1 t:kt",
    "q14": "mi:t,it1 mi_idx:t,it2 mk:t,k t:kt",
    "q15": "at:t mc:t,cn,ct mi:t,it mk:t,k",
    "q16": "an:n ci:t,n mc:t,cn mk:t,k",
    "q17": "ci:t,n mc:t,cn mk:t,k",
    "q18": "ci:t,n mi:t,it1 mi_idx:t,it2",
    "q19": "an:n ci:t,n,chn,rt mc:t,cn mi:t,it",
    "q20": "cc:t,cct1,cct2 ci:t,n,chn mk:t,k t:kt",
    "q21": "mc:t,cn,ct mi:t mk:t,k ml:t,-,lt",
    "q22": "mc:t,cn,ct mi:t,it1 mi_idx:t,it2 mk:t,k t:kt",
    "q23": "cc:t,-,cct mc:t,cn,ct mi:t,it mk:t,k t:kt",
    "q24": "an:n ci:t,n,chn,rt mc:t,cn mi:t,it mk:t,k",
    "q25": "ci:t,n mi:t,it1 mi_idx:t,it2 mk:t,k",
    "q26": "cc:t,cct1,cct2 ci:t,n,chn mi_idx:t,it mk:t,k t:kt",
    "q27": "cc:t,cct1,cct2 mc:t,cn,ct mi:t mk:t,k ml:t,-,lt",
    "q28": "cc:t,cct1,cct2 mc:t,cn,ct mi:t,it1 mi_idx:t,it2 mk:t,k t:kt",
    "q29": "an:n cc:t,cct1,cct2 ci:t,n,chn,rt mc:t,cn mi:t,it1 mk:t,k pi:n,it2",
    "q30": "cc:t,cct1,cct2 ci:t,n mi:t,it1 mi_idx:t,it2 mk:t,k",
    "q31": "ci:t,n mc:t,cn mi:t,it1 mi_idx:t,it2 mk:t,k",
    "q32": "mk:t1,k ml:t1,t2,lt",
    "q33": "mc1:t1,cn1 mc2:t2,cn2 mi_idx1:t1,it1 mi_idx2:t2,it2 ml:t1,t2,lt t1:kt1 t2:kt2",
}


def kind(alias: str) -> str:
    """An alias without its number."""
    return re.sub(r"\d+$", "", alias)


def foreign_keys(alias: str) -> list[tuple[str, str]]:
    """(column, kind of alias it points to)"""
    return [tuple(x.split(":")) for x in KEYS.get(kind(alias), "").split()]


def template(name: str, predicates: dict[str, str] | None = None, selectivity: dict[str, float] | None = None) -> QueryGraph:
    vertices, links = {}, []
    for part in TEMPLATES[name].split():
        alias, ends = part.split(":")
        for (column, _), end in zip(foreign_keys(alias), ends.split(","), strict=False):
            for a in (alias, end):
                if a != "-":
                    vertices.setdefault(a, Vertex(a, TABLES[kind(a)], predicate=(predicates or {}).get(a), selectivity=(selectivity or {}).get(a, 1.0)))
            if end != "-":
                links.append(Link(alias, end, column))
    return QueryGraph(vertices, links)


def pattern(query: QueryGraph) -> Pattern:
    """What the catalogue is to count for a template."""
    place = {a: i for i, a in enumerate(query.vertices)}
    return Pattern.of({place[a]: v.label for a, v in query.vertices.items()}, [(place[k.src], place[k.dst], k.relation) for k in query.links])


def film_graph(tables: dict[str, DataFrame]) -> PropertyGraph:
    """The graph of the tables by name, which have `id`, their foreign keys and any other columns."""
    vertices, edges = {}, {}
    for alias, name in TABLES.items():
        if name in tables:
            vertices[name] = tables[name]
            for column, end in foreign_keys(alias):
                edges[Relation(name, column, TABLES[end])] = tables[name].where(F.col(column).isNotNull()).select(F.col("id").alias("src"), F.col(column).alias("dst"))
    return PropertyGraph(vertices, edges)


def with_selectivities(query: QueryGraph, found: dict[str, float]) -> QueryGraph:
    return QueryGraph({a: replace(v, selectivity=found.get(a, v.selectivity)) for a, v in query.vertices.items()}, query.links)
