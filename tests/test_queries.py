"""Every registered query of the grid engine against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return str(v)[:19] if hasattr(v, "year") else v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([tuple(plain(r[i]) for i in order) for r in rows], key=lambda t: tuple((x is None, str(x)) for x in t))


def test_queries_match_sql(spark, db):
    from rillgrid.plans import edge_queries  # noqa: F401
    from rillgrid.plans.queries import ORACLE, QUERIES

    wrong = []
    for name, sql in ORACLE.items():
        df = QUERIES[name](spark, SF)
        result = db.execute(sql)
        names = [d[0] for d in result.description]
        a, b = rows_of(df.columns, df.collect()), rows_of(names, result.fetchall())
        if sorted(names) != sorted(df.columns) or len(a) != len(b) or any(x != y and x != pytest.approx(y, abs=2e-6) for r, s in zip(a, b, strict=True) for x, y in zip(r, s, strict=True)):
            wrong.append(name)
    assert not wrong


def test_entry_and_names(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_plans_push_down_and_avoid_cartesian_products(spark):
    from rillgrid.operators import stack
    from rillgrid.plans import views

    plan = stack.occurrence(views.daily(spark, SF).where("series = 3"), 30)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(user_id), EqualTo(user_id,3)]" in plan and "props" not in plan.split("ReadSchema")[-1]
    for name in ("nnls_fractions", "wilson", "strata_candidates", "rolling_median"):
        from rillgrid.plans.queries import QUERIES

        assert "CartesianProduct" not in QUERIES[name](spark, SF)._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["dtw_kmeans", "dtw_assign"])
def test_clusters_run_to_the_end(spark, monkeypatch, name):
    """The reference's 50 iterations and 3 starts."""
    import inspect

    from rillgrid.operators import clustering
    from rillgrid.plans.queries import QUERIES

    fit, asked = clustering.kmeans, []

    def seen(*args, **named):
        bound = inspect.signature(fit).bind(*args, **named)
        bound.apply_defaults()
        asked.append((bound.arguments["k"], bound.arguments["iterations"], bound.arguments["inits"]))
        return fit(args[0], iterations=1, inits=1)  # enough for a result

    monkeypatch.setattr(clustering, "kmeans", seen)
    assert QUERIES[name](spark, SF).count() > 0
    assert asked == [(4, 50, 3)]


def test_strata_reach_the_last_row(spark, tmp_path):
    from rillgrid.plans.queries import QUERIES

    events = spark.range(0, 3000, 7).selectExpr("id AS user_id", "TIMESTAMP '2024-01-01 00:00:00' AS ts", "40.0D AS value")
    events.write.parquet(f"{tmp_path}/events.parquet")
    found = QUERIES["strata_candidates"](spark, str(tmp_path)).collect()
    assert sum(r.candidates for r in found) == events.count()
    assert QUERIES["spaced_sample"](spark, str(tmp_path)).agg({"row": "max"}).first()[0] >= 195
