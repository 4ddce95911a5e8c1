import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from fieldglass.operators import incremental
from fieldglass.sources import landing, nested, sinks, versions
from fieldglass.streaming.upserts import landed_stream, upsert_stream

SCHEMA = "k long, day date, v string, loaded int"


def _table(spark, path):
    return {(r.k, str(r.day), r.v) for r in versions.read(spark, path).collect()}


def _put(spark, path, rows):
    return versions.upsert(spark.createDataFrame(rows, SCHEMA), path, ["k"], "day", [F.col("loaded")])


def test_upsert_is_idempotent_and_touches_only_its_days(spark, tmp_path):
    path, d1, d2 = str(tmp_path / "t"), dt.date(2025, 4, 1), dt.date(2025, 4, 2)
    _put(spark, path, [(1, d1, "a", 1), (2, d2, "b", 1), (2, d2, "old", 0)])
    late = [(2, d2, "B", 2), (3, d2, "c", 2)]
    _put(spark, path, late)
    _put(spark, path, late)
    assert _table(spark, path) == {(1, "2025-04-01", "a"), (2, "2025-04-02", "B"), (3, "2025-04-02", "c")}
    # The untouched day keeps the folder of the first version.
    first, last = (versions.manifest(spark, path, v)[1] for v in (1, 3))
    assert [e.commit for e in first if e.span == "2025-04-01"] == [e.commit for e in last if e.span == "2025-04-01"]
    assert _put(spark, path, []) == 3
    _put(spark, path, [(1, d2, "moved", 3)])
    assert _table(spark, path) == {(1, "2025-04-02", "moved"), (2, "2025-04-02", "B"), (3, "2025-04-02", "c")}
    assert [e.span for e in versions.manifest(spark, path)[1]] == ["2025-04-02"]


def test_readers_keep_their_version(spark, tmp_path, monkeypatch):
    path, d1, d2 = str(tmp_path / "t"), dt.date(2025, 4, 1), dt.date(2025, 4, 2)
    before = [(k, d1, "a", 1) for k in range(50)]
    _put(spark, path, before)
    reader = versions.read(spark, path)
    seen = []
    commit = versions._commit

    def watched(*given):
        # All new files are written, none is visible: no moved row is seen twice or missing.
        seen.append(sorted(r.k for r in versions.read(spark, path).collect()))
        commit(*given)

    monkeypatch.setattr(versions, "_commit", watched)
    _put(spark, path, [(k, d2, "moved", 2) for k in range(0, 50, 2)])
    assert seen == [list(range(50))]
    assert sorted(r.k for r in reader.collect()) == list(range(50)) and {str(r.day) for r in reader.collect()} == {"2025-04-01"}
    assert sorted(r.k for r in versions.read(spark, path).collect()) == list(range(50))
    assert versions.read(spark, path).where("v = 'moved'").count() == 25 and versions.read(spark, path, 1).where("v = 'moved'").count() == 0
    # A view stays at the version it was made from.
    sinks.publish_view(versions.read(spark, path, 1), "pinned")
    assert spark.sql("SELECT COUNT(*) AS n FROM pinned WHERE v = 'a'").first().n == 50
    # A writer that dies before its commit leaves the table as it was.
    monkeypatch.setattr(versions, "_commit", lambda *given: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError, match="lost"):
        _put(spark, path, [(1, d1, "never", 9)])
    assert versions.versions(spark, path) == [1, 2] and versions.read(spark, path).where("v = 'never'").count() == 0


def test_the_second_of_two_writers_is_refused(spark, tmp_path, monkeypatch):
    path, d1 = str(tmp_path / "t"), dt.date(2025, 4, 1)
    _put(spark, path, [(1, d1, "a", 1)])
    commit = versions._commit
    raced = []

    def late(*given):
        if not raced:
            raced.append(True)
            _put(spark, path, [(2, d1, "other", 2)])
        commit(*given)

    monkeypatch.setattr(versions, "_commit", late)
    with pytest.raises(versions.CommitConflict):
        _put(spark, path, [(3, d1, "mine", 2)])
    assert _table(spark, path) == {(1, "2025-04-01", "a"), (2, "2025-04-01", "other")}
    _put(spark, path, [(3, d1, "mine", 2)])
    assert len(_table(spark, path)) == 3


def test_weeks_are_compacted_once_and_still_upserted(spark, tmp_path):
    path, monday = str(tmp_path / "t"), dt.date(2025, 3, 31)
    rows = [(k, monday + dt.timedelta(days=k % 10), f"v{k}", 1) for k in range(200)] + [(900, None, "no day", 1)]
    _put(spark, path, rows)
    whole = _table(spark, path)
    assert versions.compact_weeks(spark, path, "day", ["k"]) == 2
    assert versions.compact_weeks(spark, path, "day", ["k"]) == 2
    assert _table(spark, path) == whole
    entries = {e.span: e.days for e in versions.manifest(spark, path)[1]}
    assert entries == {"0001-01-01": 1, "2025-03-31": 7, "2025-04-07": 1, "2025-04-08": 1, "2025-04-09": 1}
    # A correction inside the week writes the whole week anew; day bounds read few folders.
    _put(spark, path, [(3, monday + dt.timedelta(days=1), "late", 2), (900, monday, "dated", 2)])
    assert {e.span: e.days for e in versions.manifest(spark, path)[1]} == {k: v for k, v in entries.items() if k != "0001-01-01"}
    got = _table(spark, path)
    assert (3, "2025-04-01", "late") in got and (900, "2025-03-31", "dated") in got and len(got) == 201
    late = versions.read(spark, path, first="2025-04-08", last="2025-04-08")
    assert {str(r.day) for r in late.collect()} == {"2025-04-08"}
    # New columns are null in older folders.
    wide = spark.createDataFrame([(5, monday + dt.timedelta(days=8), "w", 3, "x")], SCHEMA + ", extra string")
    versions.upsert(wide, path, ["k"], "day", [F.col("loaded")])
    assert versions.read(spark, path).where("extra = 'x'").count() == 1 and versions.read(spark, path).where("extra IS NULL").count() == 200
    versions.expire(spark, path, 1)
    assert versions.versions(spark, path) == [4] and versions.read(spark, path).count() == 201
    used = {f"table_commit={e.commit}" for e in versions.manifest(spark, path)[1]}
    assert {p.name for p in (tmp_path / "t").glob("table_commit=*")} == used
    with pytest.raises(ValueError, match="no version"):
        versions.read(spark, path, 1)
    versions.replace(wide, path, "day")
    assert versions.read(spark, path).count() == 1


def test_stream_upserts_each_file_once(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    day = dt.date(2025, 4, 1)
    run = lambda: upsert_stream(landed_stream(spark, source, SCHEMA), target, str(tmp_path / "cp"), ["k"], "day", [F.col("loaded")]).awaitTermination()
    spark.createDataFrame([(1, day, "a", 1), (1, day, "b", 2)], SCHEMA).write.mode("append").parquet(source)
    run()
    spark.createDataFrame([(1, day, "c", 3), (2, day, "d", 3)], SCHEMA).write.mode("append").parquet(source)
    run()
    run()
    assert _table(spark, target) == {(1, "2025-04-01", "c"), (2, "2025-04-01", "d")}


def test_landing_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, 2, 3, dt.date(2025, 4, 1), "FF"), (1, 1, 1, dt.date(2025, 4, 1), "SL")], "game_pk long, at_bat_number int, pitch_number int, game_date date, pitch_type string")
    sinks.write_landing(df, str(tmp_path / "land"), "2025-04-01", "2025-04-01")
    back = landing.read_partitions(spark, [str(tmp_path / "land")])
    assert back.count() == 2 and {"source_start_date", "loaded_at_utc"} <= set(back.columns)
    sinks.write_clustered(df.withColumn("pitcher_id", F.lit(1)), str(tmp_path / "clustered"), rows_per_file=2)
    assert spark.read.parquet(str(tmp_path / "clustered")).count() == 2
    sinks.write_csv(df.select("game_pk", "pitch_type"), str(tmp_path / "csv"), ["pitch_type"])
    assert [r.pitch_type for r in landing.read_csv(spark, str(tmp_path / "csv"), "game_pk long, pitch_type string").orderBy("pitch_type").collect()] == ["FF", "SL"]
    sinks.append_run_log(sinks.run_log_row(df, "r1", "full"), str(tmp_path / "log"))
    sinks.append_run_log(sinks.run_log_row(df, "r2", "full"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2
    sinks.write_json(df.withColumn("x", F.lit(float("nan"))), str(tmp_path / "json"))
    text = "".join(p.read_text() for p in (tmp_path / "json").glob("*.json"))
    assert json.loads(text.splitlines()[0])["x"] is None


def test_forecast_archive_keeps_the_file_name(spark, tmp_path):
    (tmp_path / "f1.json").write_text(json.dumps({"predictions": [{"game_pk": 1, "pitcher_id": 2, "generated_at_utc": "2026-09-01T00:00:00", "predicted_k": 4.5}]}))
    row = nested.forecast_archive(spark, str(tmp_path)).collect()[0]
    assert (row.game_pk, row.predicted_k, row.archive_file) == (1, 4.5, "f1.json")


def test_wind_and_status(spark):
    from fieldglass.functions import text

    df = spark.createDataFrame([("12 mph, Out To CF",), ("7.5 MPH",), ("Calm ",), (None,), ("",)], "w string")
    rows = df.select(text.wind_speed(F.col("w")).alias("s"), text.wind_direction(F.col("w")).alias("d")).collect()
    assert [(r.s, r.d) for r in rows] == [(12.0, "Out To CF"), (7.5, None), (None, "Calm"), (None, None), (None, None)]
    games = spark.createDataFrame([(1, "Final", "Final", 2), (1, "Preview", "Postponed", 1), (2, "Live", "In Progress", 1), (2, "Live", "Warmup", 0)], "g int, a string, d string, i int")
    assert {(r.g, r.d) for r in incremental.resolve_duplicates(games, "g", "a", "d", "i").collect()} == {(1, "Final"), (2, "Warmup")}
