import pytest

from tallyspark.plans import port_tables, sql_runner
from tallyspark.sources import bronze, files, synthetic


def test_ingest(spark, tmp_path):
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw/terminal_metadata.csv").write_text("terminal_id,terminal_name,berth_count,crane_count,extra\nA,x,3,oops,1\n,y,2,2,2\nB,,1.5,4,3\n")
    raw, out, bad = (f"file://{tmp_path}/{x}" for x in ("raw", "bronze", "quarantine"))
    results = bronze.ingest_all(spark, raw, out, bad)
    first = results[0]
    assert (first["rows_read"], first["rows_written"], first["rows_quarantined"]) == (3, 2, 1)
    assert first["coerced"] == {"crane_count": 1, "berth_count": 1} and first["nulls"] == {"terminal_name": 1, "berth_count": 1, "crane_count": 1}
    assert [r["status"] for r in results[1:]] == ["skipped"] * 4
    df = spark.read.parquet(f"{out}/terminal_metadata")
    assert {"extra", "latitude", "_ingestion_ts", "_source_system", "_batch_id", "_source_file"} <= set(df.columns)
    total = {r.table: r for r in bronze.summary(spark, results).collect()}["TOTAL"]
    assert (total.rows_read, total.rows_quarantined) == (3, 1)
    assert sum(map(len, bronze.SCHEMAS.values())) == 62


def test_files(spark, tmp_path):
    path = f"file://{tmp_path}"
    files.write_layer(spark.range(3), f"{path}/t", "_silver_ts")
    assert files.read_tables(spark, path, ["t"])["t"].count() == 3
    with pytest.raises(FileNotFoundError):
        files.read_tables(spark, path, ["t", "u"])
    files.write_json(spark, {"a": [1, None]}, f"{path}/doc")
    assert files.read_json(spark, f"{path}/doc") == {"a": [1, None]}
    files.write_csv_sample(spark.range(100), f"{path}/sample", ["id"], 60)
    assert spark.read.option("header", True).csv(f"{path}/sample").count() == 60


SQL = """
-- === First: one; two ===
SELECT 1 AS a, 'x;y' AS b;
-- a comment alone;
CREATE OR REPLACE TEMP VIEW v AS SELECT id FROM range(5);
/* block; */ SELECT count(*) AS n FROM v;
SELECT nothing FROM nowhere;
COPY (SELECT id FROM v) TO '{path}' (FORMAT PARQUET, COMPRESSION SNAPPY);
SELECT id FROM v ORDER BY id
"""


def test_runner(spark, tmp_path):
    path = f"file://{tmp_path}/copied"
    results = sql_runner.run_sql(spark, SQL.replace("{path}", path), limit=3)
    assert [r.query for r in results] == [True, False, True, True, False, True]
    assert results[0].label == "First: one; two" and results[0].rows == [(1, "x;y")]
    assert results[2].rows == [(5,)] and results[3].error and spark.read.parquet(path).count() == 5
    assert results[5].total == 5 and len(results[5].rows) == 3
    assert sql_runner.rendered([(1, None)], ["a", "b"], 2).splitlines() == ["a | b   ", "--+-----", "1 | NULL", "... 2 more rows"]


def test_derived_tables_stand_before_the_query():
    sql = port_tables.with_tables("weather", "SELECT 1")
    assert sql.index("terminals AS") < sql.index("vessel_calls AS") < sql.index("weather AS")


def test_forms_of_other_dialects(spark, tmp_path):
    spark.range(3).selectExpr("id", "id * 2 AS twice", "'a' AS tag").write.parquet(str(tmp_path / "t.parquet"))
    sql = f"""
-- read_parquet('comment') stays
CREATE OR REPLACE VIEW v AS SELECT * FROM read_parquet('{tmp_path}/t.parquet');
-- All but one
SELECT * EXCLUDE (tag) FROM v ORDER BY id
"""
    made, shown = sql_runner.run_sql(spark, sql)
    assert not made.error and not shown.error
    assert shown.columns == ["id", "twice"] and shown.rows == [(0, 0), (1, 2), (2, 4)]


def test_all_files_of_a_folder(spark, tmp_path, monkeypatch, capsys):
    (tmp_path / "b.sql").write_text("-- second\nSELECT 2 AS b;")
    (tmp_path / "a.sql").write_text("-- first\nSELECT 1 AS a;")
    monkeypatch.setattr("sys.argv", ["sql_runner", "--all", str(tmp_path)])
    sql_runner.main()
    said = capsys.readouterr().out
    assert said.index("first") < said.index("second")


def test_unions_by_name(spark):
    sql = """
WITH f AS (SELECT 'x' AS name, 1 AS n UNION ALL BY NAME SELECT 2 AS n, 'y' AS name
  -- UNION ALL BY NAME in a comment
  UNION ALL BY NAME SELECT 'z' AS name, true AS flag)
SELECT name, n, flag FROM f ORDER BY name;
SELECT 1 AS a, 'UNION ALL BY NAME' AS b UNION ALL BY NAME SELECT 'q' AS b, 0 AS a ORDER BY a
"""
    one, two = sql_runner.run_sql(spark, sql)
    assert not one.error and one.rows == [("x", 1, None), ("y", 2, None), ("z", None, True)]
    assert not two.error and two.rows == [(0, "q"), (1, "UNION ALL BY NAME")]


def test_synthetic_sources(spark, tmp_path):
    raw, out, bad = (f"file://{tmp_path}/{x}" for x in ("raw", "bronze", "quarantine"))
    synthetic.write_raw(spark, raw, n_calls=3000)
    results = {r["table"]: r for r in bronze.ingest_all(spark, raw, out, bad)}
    assert all(r["status"] == "ok" and not r["rows_quarantined"] and not r["coerced"] for r in results.values())
    calls, cranes, moves = (spark.read.parquet(f"{out}/{n}") for n in ("vessel_calls", "crane_assignments", "container_moves"))
    n = calls.count()
    share = lambda df, condition: df.where(condition).count() / df.count()
    assert results["weather_daily"]["rows_read"] == 731 * 5
    assert 0.005 < n / 3000 - 1 < 0.02 and calls.select("vessel_call_id").distinct().count() == 3000
    assert 0.008 < share(calls, "eta IS NULL") < 0.025 and 0.004 < share(calls, "ata IS NULL") < 0.018
    assert 0.001 < share(calls, "ata > atd") < 0.011 and share(calls, "status = 'in_progress' AND atd IS NOT NULL") == 0
    assert 0.25 < share(calls, "delay_hours > 0") < 0.7 and share(calls, "etd < eta") == 0
    assert 0.010 < share(cranes, "actual_start IS NULL") < 0.020 and 0.002 < share(cranes, "actual_end < actual_start") < 0.009
    assert cranes.select("assignment_id").distinct().count() == cranes.count()
    assert 0.001 < share(moves, "actual_duration_minutes < 0") < 0.006 and moves.select("move_id").distinct().count() == moves.count()
    assert cranes.join(calls, "vessel_call_id", "left_anti").isEmpty() and moves.join(cranes, "assignment_id", "left_anti").isEmpty()
    again = synthetic.tables(spark.newSession(), n_calls=3000)["vessel_calls"].repartition(7)
    assert sorted(map(tuple, again.select("vessel_call_id", "atd").collect()), key=str) == sorted(map(tuple, calls.select("vessel_call_id", "atd").collect()), key=str)
