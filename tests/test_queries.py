import ast
import math
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_module
from codexweave import plans, registry
from codexweave.plans import collation_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def same(a, b):
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-5) if isinstance(a, float) and isinstance(b, float) else a == b


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    if name not in registry.ORACLES:
        return
    r = duck.execute(registry.ORACLES[name])
    at = [[d[0] for d in r.description].index(c) for c in cols]
    want = [tuple(x[i] for i in at) for x in r.fetchall()]
    key = lambda row: repr([round(v, 4) if isinstance(v, float) else v for v in row])
    got.sort(key=key)
    want.sort(key=key)
    assert len(got) == len(want) and all(same(x, y) for a, b in zip(got, want) for x, y in zip(a, b))


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_names_of_plans_are_bound_once():
    """A query reads its module's constants when it runs, its SQL when it is registered: a constant bound again would part the two."""
    for path in Path(plans.__file__).parent.glob("*.py"):
        bound = Counter()
        for node in ast.parse(path.read_text()).body:
            if isinstance(node, ast.FunctionDef):
                bound[node.name] += 1
            elif isinstance(node, ast.Assign):
                bound.update(x.id for t in node.targets for x in ast.walk(t) if isinstance(x, ast.Name))
        assert not [name for name, n in bound.items() if n > 1], path.name


def test_known_people_are_those_of_the_sql(spark):
    assert sorted(r["name"] for r in collation_queries.known_people(spark).collect()) == ["Den", "Er", "Oror", "The", "Thth"]


def test_verdicts_measures_texts_once(spark):
    """Scores and style of the texts are written before the medians are taken and the verdicts given: the result's plan reads no documents."""
    plan = registry.QUERIES["verdicts"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "regexp_extract_all" not in plan
