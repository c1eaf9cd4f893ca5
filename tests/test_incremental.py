import os

import pytest

from rillgrid.streaming.incremental import follow

SCHEMA = "k long, v double"


def write(spark, folder, low, high, files=3):
    spark.range(low, high).selectExpr("id AS k", "IF(id % 5 = 0, NULL, id / 2.0D) AS v").repartition(files).write.mode("append").parquet(folder)


def test_new_files_are_taken_once(spark, tmp_path):
    folder, path, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    os.makedirs(folder)
    assert follow(spark, folder, SCHEMA, path, state) == []
    write(spark, folder, 0, 100)
    seen = []
    told = follow(spark, folder, SCHEMA, path, state, files=1, report=seen.append)
    assert told == seen and [b["rows"] for b in told] and sum(b["rows"] for b in told) == 100 and len(told) == 3
    assert all(b["seconds"] > 0 and b["rate"] == pytest.approx(b["rows"] / b["seconds"]) for b in told)
    write(spark, folder, 100, 130)
    assert sum(b["rows"] for b in follow(spark, folder, SCHEMA, path, state)) == 30
    assert follow(spark, folder, SCHEMA, path, state) == []
    rows = {r.k: r.v for r in spark.read.parquet(path).collect()}
    assert rows == {k: None if k % 5 == 0 else k / 2 for k in range(130)} and spark.read.parquet(path).count() == 130


def test_a_broken_run_is_taken_up(spark, tmp_path):
    """A batch fails after others were finished; the next run does it again, and no row is twice or missing."""
    folder, path, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    write(spark, folder, 0, 60, files=1)
    late = str(tmp_path / "late")
    write(spark, late, 60, 100, files=1)
    whole = next(os.path.join(late, x) for x in os.listdir(late) if x.endswith(".parquet"))
    data, damaged = open(whole, "rb").read(), os.path.join(folder, "part-late.parquet")
    with open(damaged, "wb") as file:
        file.write(data[: len(data) // 2])
    os.utime(damaged, (4e9, 4e9))  # the last of its run
    with pytest.raises(Exception):  # noqa: B017
        follow(spark, folder, SCHEMA, path, state, files=1)
    assert spark.read.parquet(path).count() == 60
    with open(damaged, "wb") as file:
        file.write(data)
    os.utime(damaged, (4e9, 4e9))
    told = follow(spark, folder, SCHEMA, path, state, files=1)
    assert [(b["batch"], b["rows"]) for b in told] == [(1, 40)]
    assert sorted(r.k for r in spark.read.parquet(path).collect()) == list(range(100))


def test_work_and_key(spark, tmp_path):
    folder, path, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    write(spark, folder, 0, 50)
    follow(spark, folder, SCHEMA, path, state, work=lambda rows: rows.where("v IS NOT NULL").selectExpr("k % 4 AS part", "v"), key="part")
    assert {x for x in os.listdir(path) if x.startswith("part=")} == {f"part={i}" for i in range(4)}
    assert spark.read.parquet(path).count() == 40
