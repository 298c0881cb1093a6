"""All join templates, planned and run on small tables made by rule, against DuckDB."""

import duckdb
import pytest

from weft.plans.catalogue import Catalogue
from weft.plans.job_planner import JoinPlanner
from weft.plans.lower import executed
from weft.plans.planner import Planner
from weft.workload import imdb

SIZES = {"title": 40, "name": 25, "cast_info": 60, "movie_companies": 50, "movie_info": 50, "movie_info_idx": 45, "movie_keyword": 55, "movie_link": 30, "person_info": 30}


@pytest.fixture(scope="module")
def tables():
    """Columns of each table by name; every seventh foreign key is missing."""
    out = {}
    for alias, name in imdb.TABLES.items():
        n = SIZES.get(name, 9)
        columns = {"id": list(range(n))}
        for j, (column, end) in enumerate(imdb.foreign_keys(alias)):
            size = SIZES.get(imdb.TABLES[end], 9)
            columns[column] = [None if (i + j) % 7 == 6 else (i * (5 + 2 * j) + len(name) * i * i + j) % size for i in range(n)]
        columns["x"] = [(i * 3) % 10 for i in range(n)]
        out[name] = columns
    return out


@pytest.fixture(scope="module")
def graph(spark, tables):
    frames = {}
    for name, columns in tables.items():
        rows = list(zip(*columns.values(), strict=True))
        frames[name] = spark.createDataFrame(rows, ", ".join(f"{c} long" for c in columns)).coalesce(1)
    return imdb.film_graph(frames)


@pytest.fixture(scope="module")
def db(tables):
    import pandas as pd

    con = duckdb.connect()
    for name, columns in tables.items():
        con.register(name, pd.DataFrame({c: pd.array(v, "Int64") for c, v in columns.items()}))
    return con


@pytest.fixture(scope="module")
def catalogue(graph):
    return Catalogue.from_schema(graph, 2)


@pytest.mark.parametrize("name", list(imdb.TEMPLATES))
def test_template(name, graph, db, catalogue):
    plain = imdb.template(name)
    least = min(plain.vertices)
    q = imdb.template(name, predicates={least: "x < 8"}, selectivity={least: 0.8})
    assert q.connected() and len(q.vertices) == len(plain.vertices)
    planner = Planner(q, catalogue)
    join = JoinPlanner(planner)
    cost, steps = join.best()
    assert cost > 0 and [s.kind for s in steps].count("VERTEX_SCAN") == 1 and "AGGREGATE" in join.rendered()
    df = executed(planner.left_deep(join.order()), graph, q)
    froms = ", ".join(f'{v.label} AS "{a}"' for a, v in q.vertices.items())
    joins = " AND ".join(f'"{k.src}".{k.relation} = "{k.dst}".id' for k in q.links)
    want = db.sql(f'SELECT count(*), sum("{least}".id) FROM {froms} WHERE {joins} AND "{least}".x < 8').fetchall()[0]
    row = df.selectExpr("count(*)", f"sum({least}__id)").first()
    assert (row[0], row[1]) == (want[0], None if want[1] is None else int(want[1]))
