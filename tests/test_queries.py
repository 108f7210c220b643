import duckdb
import pytest
from conftest import SF

from terracota import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(rows):
    return sorted(tuple(str(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v) for v in r) for r in rows)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_equals_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    expected = duck.execute(f"SELECT {', '.join(columns)} FROM ({queries.ORACLES[name]})").fetchall()
    assert expected
    assert plain(df.select(columns).collect()) == plain(expected)


def test_link_queries_prune_and_stay_native(spark):
    plan = queries.page_links(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan.split("== Physical Plan ==")[1]


def test_flagship(spark):
    out = queries.flagship(spark, SF)
    assert out.count() > 0 and {"area_m2", "preco", "publicado", "rua"} <= set(out.columns)
