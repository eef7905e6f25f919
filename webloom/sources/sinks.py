"""Sinks: JSON always, CSV on request, format choice, and the check that an output has rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NESTED = (T.ArrayType, T.MapType, T.StructType)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> bool:
    """False, and no file, for an empty table; missing values are empty cells."""
    if df.isEmpty():
        return False
    df.write.mode("overwrite").option("header", True).option("emptyValue", "").option("escape", '"').csv(path)
    return True


def auto_format(df: DataFrame, most_rows: int = 50_000) -> str:
    """json for nested columns, csv for more than `most_rows` rows, else xlsx."""
    if any(isinstance(f.dataType, NESTED) for f in df.schema.fields):
        return "json"
    return "csv" if df.limit(most_rows + 1).count() > most_rows else "xlsx"


def save_records(df: DataFrame, folder: str, kind: str = "auto") -> list[str]:
    """Write JSON and the format asked for (csv, xlsx or all); xlsx is written as CSV, as Spark has no such writer."""
    kind = auto_format(df) if kind == "auto" else kind
    write_json(df, f"{folder}/json")
    done = [f"{folder}/json"]
    if kind in ("csv", "xlsx", "all") and write_csv(df, f"{folder}/csv"):
        done.append(f"{folder}/csv")
    return done


def save_projects(records: DataFrame, folder: str, project: str, kind: str = "auto") -> None:
    """save_records() for many projects in one job: a part of the output for each project, and then its commit marker.

    A run replaces the parts of the projects that it has, and no others. A project counts as saved once its marker is
    written, with the run and the number of rows, after its data: what a broken run leaves is not read.
    """
    run = uuid.uuid4().hex
    named = records.withColumns({"_project": F.col(project), "_run": F.lit(run)})
    plain = not any(isinstance(f.dataType, NESTED) for f in records.schema.fields)
    named.write.partitionBy("_project", "_run").mode("append").json(f"{folder}/json")
    if kind in ("csv", "xlsx", "all") or kind == "auto" and plain:
        named.write.partitionBy("_project", "_run").mode("append").option("header", True).option("emptyValue", "").option("escape", '"').csv(f"{folder}/csv")
    # The markers are made of what was written, and replace older ones of their projects only.
    written = records.sparkSession.read.schema("_project string, _run string").json(f"{folder}/json").filter(F.col("_run") == run)
    marks = written.groupBy("_project", "_run").agg(F.count("*").alias("n_rows"))
    marks.write.partitionBy("_project").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(f"{folder}/commits")


def saved_projects(spark: SparkSession, folder: str, schema: str, kind: str = "json") -> DataFrame:
    """The rows of all committed projects, those of each project's last run."""
    marks = spark.read.schema("_run string, n_rows long, _project string").parquet(f"{folder}/commits").select("_project", "_run")
    reader = spark.read.schema(f"{schema}, _project string, _run string")
    rows = reader.json(f"{folder}/json") if kind == "json" else reader.option("header", True).option("enforceSchema", False).option("escape", '"').csv(f"{folder}/csv")
    marked = (rows["_run"] == marks["_run"]) & rows["_project"].eqNullSafe(marks["_project"])
    return rows.join(marks, marked, "left_semi").drop("_project", "_run")


def append_events(events: DataFrame, path: str) -> None:
    """Append (type, data) rows to a recording with the time of writing."""
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSS")
    events.select(stamp.alias("timestamp"), "type", "data").write.mode("append").json(path)


def has_output(spark: SparkSession, path: str) -> bool:
    return not spark.read.json(path).isEmpty()
