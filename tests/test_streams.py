"""Streams that are stopped and started again, late rows, sessions that end, sources file by file."""

from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from webloom.operators import extract
from webloom.sources import readers, sinks
from webloom.streaming import streams

T0 = datetime(2024, 1, 1)
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def at(seconds):
    return T0 + timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def feed(spark, path, parts, schema, run):
    """Starts the stream anew for each part that arrives."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
        run(spark.readStream.schema(schema).parquet(f"{path}/in"))


def append_to(path):
    def run(live):
        live.writeStream.format("parquet").option("checkpointLocation", f"{path}/at").trigger(availableNow=True).start(f"{path}/out").awaitTermination()

    return run


def test_sessions_end_by_state_gap_and_timer(spark, tmp_path, rocks):
    schema = "project_id string, ts timestamp, state string"
    parts = [
        [("p", at(0), "INIT"), ("p", at(60), "DONE"), ("q", at(8_000), "INIT"), ("r", at(0), "INIT"), ("r", at(9_000), "RECON"), (None, at(5), "FAILED")],
        [("p", at(8_500), "INIT"), ("q", at(7_990), "INIT"), ("q", at(8_010), "TEST"), ("s", at(9_001), None), ("p", at(70), "DONE")],  # the last is late
        [("z", at(90_000), "INIT")],
        [("z", at(80_000), "DONE")],  # late
    ]
    out = str(tmp_path)
    seen = []

    def run(live):
        append_to(out)(streams.live_completions(live, gap="1 hour", late="1 hour"))
        seen.append(sorted(((r["project_id"] or "", r["final_state"], r["ended"], r["duration_seconds"]) for r in spark.read.parquet(f"{out}/out").collect()), key=repr))

    feed(spark, out, parts, schema, run)
    first = [("", "FAILED", True, 0.0), ("p", "DONE", True, 60.0), ("r", "INIT", False, 0.0)]
    assert seen[0] == seen[1] == first  # final states at once, the gap by the row after it
    assert Counter(seen[2]) == Counter([*first, ("p", "INIT", False, 0.0), ("q", "TEST", False, 20.0), ("r", "RECON", False, 0.0), ("s", None, False, 0.0)])
    assert seen[3] == seen[2]


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    schema = "k int, ts timestamp"
    parts = [[(1, at(0)), (2, at(7200)), (3, None)], [(4, at(3599)), (5, at(3600)), (6, at(3601)), (7, None)], [(8, at(20_000)), (9, at(0))], [(10, at(16_399)), (11, at(16_400))]]
    out = str(tmp_path)
    feed(spark, out, parts, schema, lambda live: streams.side_output(live, out, late="1 hour").trigger(availableNow=True).start().awaitTermination())
    assert sorted((r["k"], r["batch"]) for r in streams.late_rows(spark, out).collect()) == [(4, 1), (9, 2), (10, 3)]
    assert sorted(r["k"] for r in streams.on_time(spark, out).collect()) == [1, 2, 3, 5, 6, 7, 8, 11]


def test_a_batch_that_runs_again_changes_nothing(spark, tmp_path):
    """As after a failure between a batch's writes and its commit."""
    schema = "project string, n int, x string"
    parts = [[("p", 1, "a"), ("p", 2, "A "), ("q", 3, "a")], [("p", 4, "a"), ("p", 5, "b"), (None, 6, "b")], [("p", 7, "b"), (None, 8, " B"), ("q", 9, None)]]
    out = str(tmp_path)
    writer = lambda live: streams.dedup_for_good(live, out, "project", ["n"], ["x"], buckets=3)
    feed(spark, out, parts, schema, lambda live: writer(live).trigger(availableNow=True).start().awaitTermination())
    want = [1, 3, 5, 6, 9]
    assert sorted(r["n"] for r in streams.first_records(spark, out).collect()) == want
    commits = sorted((tmp_path / "checkpoint/commits").iterdir(), key=lambda p: p.name)
    for p in commits:
        if p.name in ("2", ".2.crc"):
            p.unlink()
    writer(spark.readStream.schema(schema).parquet(f"{out}/in")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["n"] for r in streams.first_records(spark, out).collect()) == want
    assert spark.read.parquet(f"{out}/keys").count() == len(want)


def test_hot_pages_in_shares_append(spark, tmp_path):
    schema = "page_id long, ts timestamp, url string, content_type string, upgrade string"
    rows = [(i % 7 and 1, at(i), f"https://x/api/{i}" if i % 3 else "https://x/", "application/json" if i % 2 else None, "websocket" if i % 5 == 0 else None) for i in range(900)]
    out = str(tmp_path)
    live = lambda s: append_to(out)(streams.network_counters(s, salts=4))
    feed(spark, out, [rows, [(9, at(5_000), "u", None, None)]], schema, live)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{out}/out").collect())
    want = sorted(tuple(r) for r in streams.network_counters(spark.createDataFrame(rows, schema)).collect())
    assert got == want and len(got) == 30


def test_json_files_each_with_its_default(spark, tmp_path):
    names = {"good.json": '{"a": 1, "b": "x"}', "list.json": '[{"a": 2}, {"a": 3, "z": 9}]', "bad.json": '{"a": ', "blank.json": " \n", "odd name.json": '{"a": 7}', "empty.json": "[]"}
    for name, text in names.items():
        (tmp_path / name).write_text(text)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "x.json").write_text('{"b": "deep"}')
    got = readers.read_json_files(spark, str(tmp_path), "a int, b string", default=[(0, "d"), (-1, None)]).collect()
    rows = lambda found: sorted((r["name"], r["a"], r["b"], r["is_default"]) for r in found if r["b"] is not None or r["a"] is not None)
    want = [("bad.json", 0, "d", True), ("blank.json", 0, "d", True), ("good.json", 1, "x", False), ("sub", None, "deep", False)]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r["name"], r["a"], r["b"], r["is_default"]) for r in got if r["b"]), key=key) == sorted(want, key=key)
    assert sorted((r["name"], r["a"]) for r in got if not r["b"]) == [("bad.json", -1), ("blank.json", -1), ("list.json", 2), ("list.json", 3), ("odd name.json", 7)]
    some = readers.read_json_files(spark, str(tmp_path), "a int", ["good.json", "none.json"], [(5,)]).collect()
    assert sorted((r["name"], r["a"], r["is_default"]) for r in some) == [("good.json", 1, False), ("none.json", 5, True)]
    assert readers.read_json_files(spark, str(tmp_path / "nowhere"), "a int", ["x"], [(5,)]).count() == 1
    assert readers.read_json_files(spark, str(tmp_path / "nowhere"), "a int").count() == 0


def test_log_fields_of_any_name(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"asctime": "t", "message": "m", "n": 1.5, "deep": {"x": [1, null]}, "extra": {"n": "inner", "y": true}, "Weird key!": null}\n{"message": 3, "extra": "text"}\n[1]\n"s"\nbroken\n\n')
    got = [(r["message"], r["extra"]) for r in readers.read_logs(spark, str(tmp_path / "l.json")).collect()]
    assert got == [("m", {"n": "1.5", "deep": '{"x":[1,null]}', "y": "true", "Weird key!": None}), ("3", {"extra": "text"})]
    assert readers.read_logs(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "r.json").write_text('{"timestamp": "t", "type": "extract", "data": {"a": {"b": 1}}, "v": 2}\n{"type": "extract", "data": [1]}\n')
    rows = readers.read_recording(spark, str(tmp_path / "r.json")).collect()
    assert [(r["data"], r["extra"]) for r in rows] == [({"a": '{"b":1}'}, {"v": "2"}), (None, {})]


def test_projects_are_saved_part_by_part(spark, tmp_path):
    schema = "project string, n int, x string"
    save = lambda rows: sinks.save_projects(spark.createDataFrame(rows, schema), str(tmp_path), "project", "csv")
    save([("a/b", 1, "x"), ("a/b", 2, None), (None, 3, "y"), ("c", 4, 'q"u,ote\n')])
    save([("a/b", 5, "z")])
    for kind in ("json", "csv"):
        got = sinks.saved_projects(spark, str(tmp_path), schema, kind).filter("project IS NULL OR project <> 'c'").collect()
        assert sorted((r["project"] or "", r["n"], r["x"]) for r in got) == [("", 3, "y"), ("a/b", 5, "z")]
    assert sinks.saved_projects(spark, str(tmp_path), schema).filter("project = 'c'").first()["x"] == 'q"u,ote\n'


def test_plugins_in_sql(spark):
    pages = spark.createDataFrame([(1, "<a href='/1'>x</a><a href='/2'>y</a>"), (2, None), (3, "<b>bad</b>")], "page_id long, html string")

    def items(nodes):
        if any(n["tag"] == "b" for n in nodes):
            raise KeyError("b")
        return [n for n in nodes if n["tag"] == "a"]

    extract.register_plugin(spark, "links", items, lambda n: {"to": dict(n["attrs"])["href"], "text": n["text"]}, ["to", "text", "none"])
    rows = spark.sql("SELECT page_id, l.* FROM {pages}, LATERAL links(html) l", pages=pages).collect()
    assert sorted((r["page_id"], r["item_no"], r["error"], r["to"], r["text"], r["none"]) for r in rows if r["error"] is None) == [(1, 0, None, "/1", "x", None), (1, 1, None, "/2", "y", None)]
    assert [(r["page_id"], r["item_no"], r["error"]) for r in rows if r["error"]] == [(3, -1, "KeyError: 'b'")]
    frame = extract.extract_with(pages, items, lambda n: {"to": dict(n["attrs"])["href"], "text": n["text"]}, ["to", "text", "none"])
    assert Counter(map(tuple, frame.collect())) == Counter(map(tuple, rows))
    spark.sql("SELECT 1").select(F.lit(1)).collect()
