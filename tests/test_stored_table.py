"""Change sets on a stored table: touched buckets only, each batch once."""

from pathlib import Path

import pytest

from larder.operators import stored_table as T
from larder.streaming.routes import stream_apply

COLUMNS = "id string, barcode string, server_type string, type string, value_tag string"


def start(spark, path, n=40):
    return T.StoredTable.create(spark.createDataFrame([(f"i{k}", f"b{k}", "off", "label", f"v{k}") for k in range(n)], COLUMNS), str(path), buckets=8)


def changes(spark, rows):
    return spark.createDataFrame(rows, "op string, candidate_id string, insight_id string")


def news(spark, rows):
    return spark.createDataFrame([(c, i, "b", "off", "label", v) for c, i, v in rows], "candidate_id string, insight_id string, barcode string, server_type string, type string, value_tag string")


def state(table):
    return {r.id: r.value_tag for r in table.rows().collect()}


def data_files(path):
    return sorted(str(p) for p in Path(path, "data").rglob("*.parquet"))


def test_only_touched_buckets_are_rewritten(spark, tmp_path):
    table = start(spark, tmp_path / "t")
    before, want = data_files(tmp_path / "t"), {f"i{k}": f"v{k}" for k in range(40)}
    n = table.apply(changes(spark, [("delete", None, "i3"), ("update", "c1", "i3x"), ("update", "c1", "i5"), ("create", "c2", None)]), news(spark, [("c1", None, "new5"), ("c2", "i99", "new99")]), 0)
    want.pop("i3")
    want.update(i5="new5", i99="new99")
    assert state(table) == want and 1 <= n <= 4
    after = data_files(tmp_path / "t")
    assert set(before) <= set(after)
    read = set(table.rows().inputFiles())
    assert sum(f.replace("file://", "").replace("file:", "") in before for f in read) == 8 - n  # the others kept their files


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    table = start(spark, tmp_path / "t")
    batch = changes(spark, [("delete", None, "i1"), ("create", "c", None)]), news(spark, [("c", "i100", "x")])
    assert table.apply(*batch, 7) > 0
    whole, files = state(table), data_files(tmp_path / "t")
    assert table.apply(*batch, 7) == 0 and state(table) == whole and data_files(tmp_path / "t") == files
    assert table.apply(*batch, 7, stream="another") > 0  # epochs are a stream's own
    assert table.apply(changes(spark, []), news(spark, []), 8) == 0 and table.applied("changes", 8)


def test_a_batch_broken_off_before_its_log_entry_is_done_again(spark, tmp_path, monkeypatch):
    table = start(spark, tmp_path / "t")
    before = state(table)
    batch = changes(spark, [("update", "c", "i1"), ("delete", None, "i2")]), news(spark, [("c", None, "x")])

    def broken(self, entries):
        raise RuntimeError("killed")

    monkeypatch.setattr(T.StoredTable, "_enter", broken)
    with pytest.raises(RuntimeError):
        table.apply(*batch, 0)
    monkeypatch.undo()
    assert state(table) == before and not table.applied("changes", 0)
    assert table.apply(*batch, 0) in (1, 2)
    assert state(table) == {**{k: v for k, v in before.items() if k != "i2"}, "i1": "x"}
    # data of a version that never got into the log is written over
    stale = tmp_path / "t" / "data" / "version=3" / "bucket=0"
    stale.mkdir(parents=True)
    (stale / "part-0.parquet").write_bytes(b"half a file")
    table.apply(changes(spark, [("delete", None, "i4")]), news(spark, []), 1)
    assert "i4" not in state(table) and "i1" in state(table)


def test_emptied_buckets_and_an_empty_table(spark, tmp_path):
    table = start(spark, tmp_path / "t", n=3)
    table.apply(changes(spark, [("delete", None, f"i{k}") for k in range(3)]), news(spark, []), 0)
    assert state(table) == {}
    table.apply(changes(spark, [("create", "c", None)]), news(spark, [("c", "i1", "again")]), 1)
    assert state(table) == {"i1": "again"}
    empty = T.StoredTable.create(table.rows().where("false"), str(tmp_path / "e"))
    assert state(empty) == {}


def test_a_stream_applies_each_batch_once(spark, tmp_path):
    table = start(spark, tmp_path / "t")
    folder = tmp_path / "in"
    spark.createDataFrame([("label", "i1"), ("label", "i2")], "action_kind string, id string").write.mode("append").parquet(str(folder))

    def build(rows, stored):
        doomed = rows.join(stored, "id", "left_semi")
        return doomed.selectExpr("'delete' as op", "cast(null as string) as candidate_id", "id as insight_id"), news(spark, [])

    def run(checkpoint):
        source = spark.readStream.schema("action_kind string, id string").parquet(str(folder))
        stream_apply(source, {"label": T.change_handler(table, build, "deletes")}, str(checkpoint)).awaitTermination()

    run(tmp_path / "c")
    assert sorted(state(table)) == sorted(f"i{k}" for k in range(40) if k not in (1, 2))
    table.apply(changes(spark, [("create", "c", None)]), news(spark, [("c", "i1", "back")]), 0)
    run(tmp_path / "lost")  # the same epoch again, with the checkpoint lost
    assert state(table)["i1"] == "back"
