from datetime import datetime, timedelta

from pyspark.sql import functions as F

from webloom.operators import aggregates, filters, joins, scoring, windows
from webloom.plans import recon
from webloom.sources import readers, sinks
from webloom.streaming import streams

T0 = datetime(2024, 1, 1)


def test_dedup_keeps_first(spark):
    rows = spark.createDataFrame([("p", 1, 0, "A ", None), ("p", 1, 1, "a", "None"), ("q", 1, 0, "a", None), ("p", 2, 0, None, None)], "project_id string, page_no int, item_no int, x string, y string")
    out = aggregates.dedup_records(filters.drop_empty(rows, ["x", "y"]), "project_id", ["page_no", "item_no"], ["x", "y"])
    assert sorted((r["project_id"], r["item_no"]) for r in out.collect()) == [("p", 0), ("q", 0)]


def test_stability(spark):
    polls = [(1, T0 + timedelta(milliseconds=100 * i), min(i, 3)) for i in range(20)] + [(2, T0 + timedelta(milliseconds=100 * i), i) for i in range(80)]
    out = {r["page_id"]: r for r in windows.stability(spark.createDataFrame(polls, "page_id long, ts timestamp, node_count long")).collect()}
    assert (out[1]["reached"], out[1]["stable_node_count"], out[1]["stability_reached_ms"]) == (True, 3, 1100)
    assert (out[2]["reached"], out[2]["stable_node_count"], out[2]["stability_reached_ms"]) == (False, 50, 5000)


def test_drift_and_cost(spark):
    a = spark.createDataFrame([("p", "x"), ("p", "y"), ("q", "z")], "project_id string, v string")
    out = {r["project_id"]: r["rate"] for r in joins.drift(a, a.filter("v <> 'y'"), "project_id", ["v"]).collect()}
    assert out == {"p": 0.5, "q": 0.0}
    usage = spark.createDataFrame([("gpt-4o", 1_000_000, 2_000_000), ("gpt-4o-2024", 5, 5)], "model string, input_tokens long, output_tokens long")
    assert sorted(r["cost"] for r in joins.token_cost(usage).collect()) == [0.0, 35.0]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "good.json").write_text('{"hello": "world"}')
    (tmp_path / "bad.json").write_text("{invalid")
    read = lambda n: [r["hello"] for r in readers.read_json(spark, str(tmp_path / n), "hello string", default=[("default",)]).collect()]
    assert read("good.json") == ["world"] and read("bad.json") == ["default"] and read("none.json") == ["default"]
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id int, x string")
    assert sinks.auto_format(rows) == "xlsx" and sinks.auto_format(rows.selectExpr("array(id) a")) == "json" and sinks.auto_format(rows, 1) == "csv"
    assert len(sinks.save_records(rows, str(tmp_path / "out"))) == 2 and sinks.has_output(spark, str(tmp_path / "out/json"))
    assert not sinks.write_csv(rows.filter("id > 5"), str(tmp_path / "empty"))
    events = spark.createDataFrame([("extract", {"t": "x"}), ("click", {"t": "y"})], "type string, data map<string,string>")
    sinks.append_events(events, str(tmp_path / "rec"))
    sinks.append_events(events, str(tmp_path / "rec"))
    assert readers.baseline(readers.read_recording(spark, str(tmp_path / "rec"))).count() == 2


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.createDataFrame([(i % 3, T0 + timedelta(seconds=i), i % 5) for i in range(200)], "page_id long, ts timestamp, n long")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    live = streams.mutation_rate(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")))
    q = live.writeStream.format("memory").queryName("rates").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(map(tuple, spark.table("rates").collect()))
    assert got == sorted(map(tuple, streams.mutation_rate(rows).collect()))


def test_logs_are_read_with_their_extras(spark, tmp_path):
    (tmp_path / "events.json").write_text('{"asctime": "t", "levelname": "INFO", "message": "m", "extra": {"a": "1"}}\nnot json\n')
    rows = readers.read_logs(spark, str(tmp_path / "events.json")).collect()
    assert [(r["levelname"], r["message"], r["extra"]) for r in rows] == [("INFO", "m", {"a": "1"})]


def test_cases_of_letters_do_not_matter(spark):
    kinds = spark.createDataFrame([("Application/JSON; x",), ("text/html",), (None,)], "c string")
    assert [r[0] for r in kinds.select(filters.is_json(F.col("c"))).collect()] == [True, False, False]
    urls = spark.createDataFrame([("https://x.example/Challenge/1",), ("https://www.LinkedIn.com/in",), (None,)], "u string")
    none = F.struct(*(F.lit(0).alias(x) for x in ("login_links", "auth_blocks", "blurred", "overlays")), F.lit(False).alias("auth_text"))
    got = urls.select(scoring.is_challenge(F.col("u")).alias("c"), scoring.signin_likelihood(none, F.col("u")).alias("s")).collect()
    assert [(r["c"], r["s"]["score"], r["s"]["reasons"]) for r in got] == [(True, 0, []), (False, 30, ["Known auth-heavy platform"]), (None, 0, [])]


def test_wide_events_of_one_time_go_by_order(spark):
    rows = spark.createDataFrame([("p", T0, 2, "DONE", None, None), ("p", T0, 1, "TEST", "u", None)], "project_id string, ts timestamp, n int, state string, url string, error string")
    assert aggregates.wide_events(rows, order=["n"]).first()["final_state"] == "DONE"


def test_report_and_verdicts_of_projects_without_records(spark):
    rows = spark.createDataFrame([("p", i) for i in range(500)], "project_id string, n int")
    names = spark.createDataFrame([("p", "https://p"), ("q", "https://q")], "project_id string, url string")
    got = {r["project_id"]: r for r in aggregates.report(rows, "project_id", ["n"], ["n"], sessions=names).collect()}
    assert (got["p"]["url"], got["p"]["rows_extracted"], [x["n"] for x in got["p"]["sample_data"]]) == ("https://p", 500, list(range(10)))
    assert (got["q"]["rows_extracted"], got["q"]["sample_data"]) == (0, None)
    verdicts = aggregates.quality_verdict(rows, "project_id", ["n"], projects=names).collect()
    assert {r["project_id"]: (r["verdict"], r["bad_columns"]) for r in verdicts} == {"p": ("pass", []), "q": ("no_data", [])}
    twice = spark.createDataFrame([("p", "A "), ("p", "a"), ("p", None), ("q", "a")], "project_id string, x string")
    assert {tuple(r) for r in aggregates.removed_counts(twice, "project_id", ["x"]).collect()} == {("p", 3, 1), ("q", 1, 0)}


def stream(spark, frame, path, name, build, mode="append"):
    frame.coalesce(1).write.parquet(path)
    q = build(spark.readStream.schema(frame.schema).parquet(path)).writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name)


def test_other_streams(spark, tmp_path):
    at = lambda s: T0 + timedelta(seconds=s)
    log = spark.createDataFrame([(1, at(5), "https://x/api/a", "application/json", None), (1, at(70), "https://x/p", "text/html", "websocket"), (2, at(9_000), "https://x/p", None, None)], "page_id long, ts timestamp, url string, content_type string, upgrade string")
    got = stream(spark, log, str(tmp_path / "log"), "counters", streams.network_counters, "complete")
    assert sorted(map(tuple, got.drop("start").collect())) == [(1, 1, 0, 0, 1), (1, 1, 1, 1, 0), (2, 1, 0, 0, 0)]
    records = spark.createDataFrame([("p", at(0), "A"), ("p", at(1), "a "), ("q", at(2), "a"), ("p", at(3), "b")], "project string, ts timestamp, x string")
    got = stream(spark, records, str(tmp_path / "records"), "once", lambda s: streams.dedup(s, "project", ["x"]))
    assert sorted((r["project"], r["x"].strip().lower()) for r in got.collect()) == [("p", "a"), ("p", "b"), ("q", "a")]
    states = spark.createDataFrame([("p", at(0), "INIT"), ("p", at(60), "DONE"), ("q", at(90_000), "INIT")], "project_id string, ts timestamp, state string")
    got = stream(spark, states, str(tmp_path / "states"), "ended", streams.completions)
    assert [tuple(r) for r in got.collect()] == [("p", "DONE", True, 60.0)]
    assert sorted(map(tuple, streams.completions(states).collect())) == [("p", "DONE", True, 60.0), ("q", "INIT", False, 0.0)]
    events = spark.createDataFrame([("extract", {"a": "b"})], "type string, data map<string,string>")
    sinks.append_events(events, str(tmp_path / "rec"))
    q = streams.recording_tail(spark, str(tmp_path / "rec")).writeStream.format("memory").queryName("tail").start()
    q.processAllAvailable()
    q.stop()
    assert [(r["type"], r["data"], r["ts"] is not None) for r in spark.table("tail").collect()] == [("extract", {"a": "b"}, True)]


def test_all_endpoints_count(spark):
    urls = [(1, f"https://x.example/api/a{i:03}", "text/html") for i in range(80)] + [(1, "https://x.example/api/Verify", "text/html"), (2, "https://x.example/datadome", "application/json"), (3, "https://x.example/verify", "text/html")]
    rows = spark.createDataFrame([(*r, None, 1) for r in urls], "page_id long, url string, content_type string, upgrade string, size long")
    got = {r["page_id"]: r for r in aggregates.network_activity(rows).collect()}
    assert len(got[1]["api_endpoints"]) == 81 and [got[i]["has_challenge"] for i in (1, 2, 3)] == [True, True, False]
    pages = spark.createDataFrame([(i, "https://x.example/", "<p>text</p>") for i in (1, 2, 3, 4)], "page_id long, url string, html string")
    assert {r["page_id"]: r["scores"]["hostility"] for r in recon.recon(pages, rows).collect()} == {1: 30, 2: 30, 3: 0, 4: 0}
