"""Frames that a query writes: no wider than what it reads again."""

import datetime as dt

import pytest

from fieldglass.catalog import library, queries_quality, tables


@pytest.mark.parametrize("name, most", [("j16_comparison", 17), ("q7_q13_history_checks", 15)])
def test_queries_write_only_columns_they_read(spark, tmp_path, monkeypatch, name, most):
    start = dt.datetime(2024, 1, 2)
    rows = [(i, start + dt.timedelta(hours=i % 650), i % 30, ("view", "click", "signup", "purchase")[i % 4], float(i * 7 % 130), '{"k": %d}' % (i % 100)) for i in range(1_500)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(str(tmp_path / "events.parquet"))
    widths = []
    for module in (tables, queries_quality):
        store = module.written_table
        monkeypatch.setattr(module, "written_table", lambda df, store=store: widths.append(len(df.columns)) or store(df))
    found = library.queries()[name](spark, str(tmp_path)).collect()
    assert widths and widths[0] <= most and (len(widths) == 1 or widths[1] <= 29)
    assert found
    if name.startswith("q7"):
        assert len(found) == 33 and {r.status for r in found} == {"PASS"}
