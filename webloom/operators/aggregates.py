"""Aggregations over records, requests, sessions and usage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webloom.functions.text import content_key, falsy, is_final
from webloom.operators.filters import is_api, is_json, is_websocket
from webloom.operators.scoring import is_challenge


def missing_ratio(records: DataFrame, columns: list[str], threshold: float = 0.8, by: list[str] = ()) -> DataFrame:
    """(by..., column_name, missing, total, ratio, flagged) in one pass; missing is null, empty, zero or false."""
    kinds = {f.name: f.dataType for f in records.schema.fields}
    counts = [F.count_if(falsy(F.col(c), kinds[c])).alias(c) for c in columns]
    one = records.groupBy(*by).agg(F.count("*").alias("total"), *counts)
    pairs = ", ".join(f"'{c}', `{c}`" for c in columns)
    long = one.selectExpr(*by, "total", f"stack({len(columns)}, {pairs}) AS (column_name, missing)")
    ratio = F.coalesce(F.try_divide("missing", "total"), F.lit(0.0))
    return long.select(*by, "column_name", "missing", "total", ratio.alias("ratio"), (ratio > threshold).alias("flagged"))


def quality_verdict(records: DataFrame, project: str, columns: list[str], threshold: float = 0.5, projects: DataFrame | None = None) -> DataFrame:
    """(project, verdict pass | fix_columns | no_data, bad_columns).

    projects: all projects of which a verdict is due; those without a record have no data.
    """
    per = missing_ratio(records, columns, threshold, [project])
    bad = F.sort_array(F.collect_list(F.when(F.col("flagged"), F.col("column_name"))))
    out = per.groupBy(project).agg(bad.alias("bad_columns"))
    if projects is not None:
        out = projects.select(project).distinct().join(out, project, "left")
    verdict = F.when(F.col("bad_columns").isNull(), "no_data").when(F.size("bad_columns") > 0, "fix_columns").otherwise("pass")
    return out.select(project, verdict.alias("verdict"), F.coalesce("bad_columns", F.array().cast("array<string>")).alias("bad_columns"))


def _content_hash(fields: list[str]) -> list[Column]:
    key = content_key([F.col(f) for f in fields])
    return [F.xxhash64(key).alias("_h1"), F.xxhash64(key, F.lit(1)).alias("_h2")]


def dedup_records(records: DataFrame, project: str, order: list[str], fields: list[str]) -> DataFrame:
    """First record, by `order`, of each content of a project; contents are told apart by a hash of 128 bits."""
    first = F.min_by(F.struct(*records.columns), F.struct(*order))
    keyed = records.withColumns(dict(zip(("_h1", "_h2"), _content_hash(fields))))
    return keyed.groupBy(F.col(project).alias("_project"), "_h1", "_h2").agg(first.alias("r")).select("r.*")


def removed_counts(records: DataFrame, project: str, fields: list[str]) -> DataFrame:
    """(project, records, removed): how many records of each project repeat the content of another."""
    groups = records.select(project, *_content_hash(fields)).groupBy(project, "_h1", "_h2").agg(F.count("*").alias("n"))
    return groups.groupBy(project).agg(F.sum("n").alias("records"), F.sum(F.col("n") - 1).alias("removed"))


def api_requests(requests: DataFrame, keep: list[str] = ("page_id", "method", "resource_type")) -> DataFrame:
    """Every request to an API, one row each: keep and the first 200 characters of its url."""
    return requests.filter(is_api(F.col("url"))).select(*keep, F.substring("url", 1, 200).alias("url"))


def json_responses(requests: DataFrame, keep: list[str] = ("page_id", "status", "size")) -> DataFrame:
    """Every JSON response, one row each: keep and the first 200 characters of its url."""
    return requests.filter(is_json(F.col("content_type"))).select(*keep, F.substring("url", 1, 200).alias("url"))


def network_activity(requests: DataFrame, key: str = "page_id") -> DataFrame:
    """Requests, all distinct API endpoints, JSON responses and websocket upgrades of a page.

    has_challenge: an API request or a JSON response went to a challenge's path.
    """
    short, api, json = F.substring("url", 1, 200), is_api(F.col("url")), is_json(F.col("content_type"))
    distinct = requests.select(key, F.when(api, short).alias("e")).filter("e IS NOT NULL").distinct()
    lists = distinct.groupBy(key).agg(F.sort_array(F.collect_list("e")).alias("api_endpoints"))
    counts = requests.groupBy(key).agg(
        F.count("*").alias("request_count"),
        F.count_if(json).alias("json_responses"),
        F.count_if(is_websocket(F.col("upgrade"))).alias("realtime"),
        F.sum(F.when(json, F.col("size"))).alias("json_bytes"),
        F.coalesce(F.bool_or((api | json) & is_challenge(short)), F.lit(False)).alias("has_challenge"),
    )
    return counts.join(lists, key, "left").withColumn("api_endpoints", F.coalesce("api_endpoints", F.array().cast("array<string>")))


def scroll_dependency(snapshots: DataFrame, key: str = "page_id") -> DataFrame:
    """(page_id, before, after, added, grew) from snapshots (page_id, phase before | after, node_count)."""
    of = lambda p: F.max(F.when(F.col("phase") == p, F.col("node_count"))).alias(p)
    out = snapshots.groupBy(key).agg(of("before"), of("after"))
    return out.withColumn("added", F.col("after") - F.col("before")).withColumn("grew", F.coalesce(F.col("after") > F.col("before"), F.lit(False)))


def usage_totals(calls: DataFrame) -> DataFrame:
    return calls.groupBy("model").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.count("*").alias("calls"))


def report(records: DataFrame, project: str, order: list[str], fields: list[str], sample: int = 10, sessions: DataFrame | None = None) -> DataFrame:
    """(project, url, generated_at, rows_extracted, sample_data) with the first rows of each project.

    sessions (project, url) name the pages; a project without one has the url `Unknown`, one without records no rows.
    The first rows of a project are kept as records are read, so a large project is never in one task.
    """
    ranked = records.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(64)))
    near = ranked.withColumn("_k", F.row_number().over(Window.partitionBy(project, "_part").orderBy(*order))).filter(F.col("_k") <= sample)
    last = near.withColumn("_k", F.row_number().over(Window.partitionBy(project).orderBy(*order))).filter(F.col("_k") <= sample)
    shown = last.groupBy(project).agg(F.transform(F.sort_array(F.collect_list(F.struct("_k", F.struct(*fields).alias("r")))), lambda x: x["r"]).alias("sample_data"))
    out = records.groupBy(project).agg(F.count("*").alias("rows_extracted")).join(shown, project)
    if sessions is None:
        out = out.withColumn("url", F.lit("Unknown"))
    else:
        urls = sessions.groupBy(project).agg(F.max("url").alias("url"))
        out = out.join(urls, project, "full").withColumns({"url": F.coalesce("url", F.lit("Unknown")), "rows_extracted": F.coalesce("rows_extracted", F.lit(0))})
    return out.select(project, "url", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss").alias("generated_at"), "rows_extracted", "sample_data")


def wide_events(states: DataFrame, project: str = "project_id", order: list[str] = ()) -> DataFrame:
    """One completion row per session from (project_id, ts, state, url, error).

    Of rows with one time the last by `order`, then by state, counts.
    """
    seconds = F.col("ts").cast("timestamp").cast("double")
    at = F.struct("ts", *order, "state")
    return states.groupBy(project).agg(
        F.max_by("state", at).alias("final_state"),
        F.round(F.max(seconds) - F.min(seconds), 2).alias("duration_seconds"),
        F.max_by("url", F.when(F.col("url").isNotNull(), at)).alias("url"),
        F.max_by("error", F.when(F.col("error").isNotNull(), at)).alias("error"),
    ).withColumns({"success": F.col("final_state") == "DONE", "ended": is_final(F.col("final_state"))})
