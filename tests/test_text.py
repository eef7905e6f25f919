from pyspark.sql import functions as F

from webloom.functions import text as fn
from webloom.operators import filters


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_redact_text(spark):
    text = "key sk-" + "a" * 32 + " password=geh€im é.x@mail.example Bearer ab.c-1"
    got = one(spark, fn.redact_text(F.col("t")), t=text)
    assert got.startswith("key [REDACTED_API_KEY] [REDACTED_PASSWORD]€im [REDACTED_EMAIL] [REDACTED_AUTH_TOKEN]")


def test_json_from_text(spark):
    cases = {
        '{"columns": [1, 2]}': '{"columns":[1,2]}',
        '```json\n\t{"columns": ["name"]}\n```': '{"columns":["name"]}',
        'Found it - {"n": 7}. Anything else?': '{"n":7}',
        '{"n": 7': "{}",
        "": "{}",
        " \t ": "{}",
    }
    rows = spark.createDataFrame(list(cases.items()), "content string, want string")
    got = rows.select("want", F.to_json(fn.parse_json(F.col("content"))).alias("got")).collect()
    assert all(r["want"] == r["got"] for r in got), got


def test_code_from_text(spark):
    assert one(spark, fn.code_text(F.col("t")), t="a\n```python\nx\n```\n```\nlonger\n```") == "longer"
    assert one(spark, fn.code_text(F.col("t")), t="Sure!\n\timport os\nprint(1)") == "import os\nprint(1)"


def test_urls(spark):
    urls = {"https://a.example": True, "HTTP://localhost:81/x": True, "ftp://a.example": False, "a.example": False, "https://": False, "words": False, None: False}
    rows = spark.createDataFrame([(u, v) for u, v in urls.items()], "u string, v boolean")
    assert rows.filter(fn.valid_url(F.col("u")) != F.col("v")).count() == 0


def test_redact_struct(spark):
    row = spark.sql("select named_struct('token', 'x', 'inner', named_struct('key', 'k', 'note', 'a@b.cc'), 'list', array('a@b.cc')) s")
    got = row.select(fn.redact_struct(F.col("s"), row.schema["s"].dataType).alias("s")).first()["s"]
    assert got["token"] == "[REDACTED]" and got["inner"]["key"] == "[REDACTED]"
    assert got["inner"]["note"] == "[REDACTED_EMAIL]" and got["list"] == ["a@b.cc"]


def test_content_key_and_falsy(spark):
    rows = spark.createDataFrame([(" A ", None), ("a", "none"), ("a|b", "")], "x string, y string")
    keys = [r[0] for r in rows.select(fn.content_key([F.col("x"), F.col("y")])).collect()]
    assert keys[0] == keys[1] == "a|none" and keys[2] == "a|b|"
    assert [r[0] for r in rows.select(fn.falsy(F.col("y"), rows.schema["y"].dataType)).collect()] == [True, False, True]


def test_error_class_order(spark):
    rows = spark.createDataFrame([("SyntaxError after TimeoutError",), (None,)], "m string")
    assert [r[0] for r in rows.select(filters.error_class(F.col("m"))).collect()] == ["timeout_error", "general_error"]
