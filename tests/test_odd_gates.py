"""Gates over odd rows (repeated ids, nulls, other spaces), compared with DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry_module

SAID = "Abc the x. Bcd the, Cde the. Def the! Efg the. Fgh der. Ghi la, Hij la. Ijk la. Jkl la."
DOCUMENTS = [(1, SAID), (1, SAID), (1, "Abc the. Zed der. The la. Abq la."), (2, None), (2, "Abd the x"), (2, "Abd the x"), (None, "Abe the x"), (None, "Abe the x")]
DOCUMENTS += [(3, "Ering"), (9, "zuver thwh"), (8, "nicht")]
DOCUMENTS += [(20 + i, f"{c}# head") for i, c in enumerate(["", " ", "\u00a0", "\u1680", "\u2003", "\u3000 ", "\n", "\t", "\u2028", "\u200b"])]
DOCUMENTS += [(40, "Eran"), (41, "was" + "\U0001f600" * 11 + "Eran"), (42, "was" + "\U0001f600" * 12 + "Eran"), (43, "was Eran, Erxx, Ererer"), (44, "Ororing\x00Ororen "), (45, "OrorOrore")]
TURNS = [(1, 0, None, "Er thwh"), (2, 0, "Er", None), (3, 0, "Er", "zuver"), (4, 0, "thwh", ""), (5, 0, "", "quxz"), (6, 0, None, "quxz nicht"), (None, 0, "Er", "nicht"), (7, 1, "x", "nicht Er")]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i, t, "en", "src0") for i, t in DOCUMENTS], "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{at}/conversations.parquet")
    return at


@pytest.mark.parametrize("name", ["body_checks", "deaths", "event_index", "gate_chronology", "gate_deceased", "gate_grounding", "plan_sanity", "recheck"])
def test_odd_rows(spark, odd, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{odd}/{t}.parquet/*.parquet'")
    df = entry_module.queries()[name](spark, odd)
    cols = sorted(df.columns)
    got = [tuple(r) for r in df.select(*cols).collect()]
    want = con.execute(f"select {', '.join(f'"{c}"' for c in cols)} from ({entry_module.oracle_sql()[name]})").fetchall()
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))
