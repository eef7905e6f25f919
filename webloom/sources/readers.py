"""Sources: JSON files that may be missing or corrupt, recordings, logs with fields of any name."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORDING = "timestamp string, type string, data map<string,string>"
LOG = ["asctime", "name", "levelname", "message"]


def _kind(schema: str | T.StructType) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def _missing(e: AnalysisException) -> bool:
    return "PATH_NOT_FOUND" in str(e)


def read_json_files(spark: SparkSession, folder: str, schema: str | T.StructType, names: DataFrame | list[str] | None = None, default: list | None = None) -> DataFrame:
    """(name, the schema's columns, is_default): JSON documents, one or an array of them a file, each file judged by itself.

    A file is named by the first step of its path below the folder. One that is blank or corrupt gives the `default`
    rows; so does each of `names` (a list, or a frame whose first column has them) without a file.
    """
    kind = _kind(schema)
    one = lambda row: F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, kind.fields)))
    rows = F.array(*map(one, default or [])).cast(T.ArrayType(kind))
    try:
        # A stray byte in one file must not hide the others, so each is one text; the files that projects keep are small.
        found = spark.read.option("recursiveFileLookup", True).text(folder, wholetext=True).select("value", "_metadata.file_path")
        below = F.substring_index(F.regexp_replace("file_path", "^.*?" + _quoted(folder.rstrip("/").rsplit("/", 1)[-1]) + "/", ""), "/", 1)
        found = found.select(F.url_decode(below).alias("name"), "value")
    except AnalysisException as e:
        if not _missing(e):
            raise
        found = spark.createDataFrame([], "name string, value string")
    if names is not None:
        wanted = spark.createDataFrame([(n,) for n in names], "name string") if isinstance(names, list) else names.select(F.col(names.columns[0]).cast("string").alias("name"))
        found = wanted.join(found, "name", "left")
    parsed = F.when(F.try_parse_json("value").isNotNull(), F.from_json("value", T.ArrayType(kind)))
    out = found.select("name", parsed.alias("rows")).select("name", F.coalesce("rows", rows).alias("rows"), F.col("rows").isNull().alias("is_default"))
    return out.select("name", "is_default", F.inline("rows")).select("name", *kind.names, "is_default")


def _quoted(text: str) -> str:
    return "\\Q" + text + "\\E"


def read_json(spark: SparkSession, path: str, schema: str | T.StructType, multi_line: bool = True, default: list | None = None) -> DataFrame:
    """JSON rows of a file or folder; a file that is missing, blank or corrupt gives `default` rows.

    Without multi_line each line is a row, corrupt lines are left out, and only a missing path gives the default.
    """
    kind = _kind(schema)
    if multi_line:
        try:
            spark.read.text(path)
        except AnalysisException as e:
            if not _missing(e):
                raise
            return spark.createDataFrame(default or [], kind)
        return read_json_files(spark, path, kind, default=default).select(kind.names)
    try:
        raw = spark.read.schema(T.StructType([*kind.fields, T.StructField("_corrupt", T.StringType())])).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        return spark.createDataFrame(default or [], kind)
    return raw.filter(F.col("_corrupt").isNull()).drop("_corrupt")


def read_free(spark: SparkSession, path: str) -> DataFrame:
    """(v): the lines of a JSON log as VARIANT objects, whatever fields they have; corrupt lines are left out."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if not _missing(e):
            raise
        lines = spark.createDataFrame([], "value string")
    return lines.select(F.try_parse_json("value").alias("v")).filter(F.schema_of_variant("v").startswith("OBJECT"))


def fields_of(v: Column) -> Column:
    """A VARIANT object as a map of text: strings as they are, other values as JSON, null as null."""
    return F.transform_values(F.try_variant_get(v, "$", "map<string,variant>"), lambda k, x: F.try_variant_get(x, "$", "string"))


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    """(timestamp, type, data, extra): data as text by field, nested values as JSON; extra has the other fields of a line."""
    rows = read_free(spark, path).select("v", fields_of(F.col("v")).alias("all"))
    text = lambda name: F.try_variant_get("v", f"$.{name}", "string").alias(name)
    return rows.select(text("timestamp"), text("type"), fields_of(F.try_variant_get("v", "$.data", "variant")).alias("data"), F.map_filter("all", lambda k, _: ~k.isin("timestamp", "type", "data")).alias("extra"))


def baseline(recording: DataFrame) -> DataFrame:
    """The extracted records of a recording: one map per row."""
    return recording.filter("type = 'extract'").select("data")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """(asctime, name, levelname, message, extra): extra has all other fields of a line, and those of an object named extra."""
    rows = read_free(spark, path).select("v", fields_of(F.col("v")).alias("all"), fields_of(F.try_variant_get("v", "$.extra", "variant")).alias("inner"))
    nested = F.coalesce("inner", F.create_map().cast("map<string,string>"))
    own = F.map_filter("all", lambda k, _: ~k.isin(LOG) & ~(F.col("inner").isNotNull() & (k == "extra")))
    extra = F.map_concat(F.map_filter(nested, lambda k, _: ~F.map_contains_key(own, k)), own)
    return rows.select(*(F.try_variant_get("v", f"$.{c}", "string").alias(c) for c in LOG), extra.alias("extra"))
