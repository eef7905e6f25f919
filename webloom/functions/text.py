"""Scalar functions on text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[\p{L}\p{N}_]"
# What is redacted, in this order.
SECRETS = [
    (r"sk-[a-zA-Z0-9]{32,}", "[REDACTED_API_KEY]"),
    (r"password=[\p{L}\p{N}_!@#$%^&*()]+", "[REDACTED_PASSWORD]"),
    (r"[\p{L}\p{N}_\.-]+@[\p{L}\p{N}_\.-]+\.[\p{L}\p{N}_]+", "[REDACTED_EMAIL]"),
    (r"Bearer [a-zA-Z0-9\._-]+", "[REDACTED_AUTH_TOKEN]"),
]
# Keys whose values are redacted.
SENSITIVE = ["password", "secret", "token", "key"]
# States in order, and the final ones.
STATES = "INIT LOGIN GUIDED_ACCESS RECON INTERACTIVE_SOLVE LLM_ANALYSIS USER_CONFIG CODEGEN TEST REPAIR APPROVED FINAL_RUN DONE FAILED".split()
FINAL_STATES = ["DONE", "FAILED"]


def redact_text(text: Column) -> Column:
    for pattern, by in SECRETS:
        text = F.regexp_replace(text, pattern, by)
    return text


def redact_map(data: Column) -> Column:
    """A map of strings: values of sensitive keys go, other values are redacted as text."""
    return F.transform_values(data, lambda k, v: F.when(F.lower(k).isin(SENSITIVE), "[REDACTED]").otherwise(redact_text(v)))


def redact_struct(data: Column, kind: T.StructType) -> Column:
    """A struct, nested structs included; strings inside arrays stay as they are, structs inside arrays are redacted."""
    return F.struct(*(_redacted(data[f.name], f).alias(f.name) for f in kind.fields))


def _redacted(value: Column, field: T.StructField) -> Column:
    if field.name.lower() in SENSITIVE:
        return F.lit("[REDACTED]")
    if isinstance(field.dataType, T.StringType):
        return redact_text(value)
    if isinstance(field.dataType, T.StructType):
        return redact_struct(value, field.dataType)
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.StructType):
        kind = field.dataType.elementType
        return F.transform(value, lambda x: redact_struct(x, kind))
    return value


def json_text(content: Column) -> Column:
    """The part of a reply that should be JSON: a fenced block, else from the first `{` to the last `}`, else all."""
    fenced = F.regexp_extract(content, r"(?i)```(?:json)?\s*([\s\S]*?)```", 1)
    has_fence = F.coalesce(content.rlike(r"(?i)```(?:json)?\s*([\s\S]*?)```"), F.lit(False))
    start, back = F.instr(content, "{"), F.instr(F.reverse(content), "}")
    end = F.length(content) + 1 - back
    braces = F.substring(content, start, end - start + 1)
    return strip(F.when(has_fence, fenced).when((start > 0) & (back > 0) & (end >= start), braces).otherwise(content))


def parse_json(content: Column) -> Column:
    """VARIANT of the JSON in free text; an empty object where there is none."""
    return F.coalesce(F.try_parse_json(json_text(content)), F.parse_json(F.lit("{}")))


def code_text(content: Column) -> Column:
    """Longest fenced block (the first of equals), else everything from the first line that looks like code, else all."""
    blocks = F.regexp_extract_all(content, F.lit(r"```(?:python)?\s*([\s\S]*?)```"), 1)
    numbered = F.transform(blocks, lambda b, i: F.struct(F.length(b).alias("n"), (-i).alias("i"), b.alias("b")))
    lines = F.split(content, "\n")
    starts = lambda x: strip(x).rlike(r"^(import |from |class |def |async def |#!)")
    first = F.array_position(F.transform(lines, lambda x: starts(x)), True)
    tail = F.array_join(F.slice(lines, F.greatest(first, F.lit(1)).cast("int"), F.size(lines)), "\n")
    return strip(F.when(F.size(blocks) > 0, F.array_max(numbered)["b"]).when(first > 0, tail).otherwise(content))


def site_key(url: Column) -> Column:
    """What follows the last `//` up to the next `/`, without `www.`, with dots as underscores."""
    rest = F.element_at(F.split(url, "//"), -1)
    return F.replace(F.replace(F.substring_index(rest, "/", 1), F.lit("www."), F.lit("")), F.lit("."), F.lit("_"))


def valid_url(url: Column) -> Column:
    return F.coalesce(url.rlike(r"(?i)^https?://[^/?#]+"), F.lit(False))


def selector(tag: Column, classes: Column) -> Column:
    return F.when(F.size(classes) > 0, F.concat(tag, F.lit("."), F.array_join(classes, "."))).otherwise(tag)


def shorten(text: Column, n: int) -> Column:
    """Texts over n characters end in `...`."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n - 3), F.lit("..."))).otherwise(text)


def is_final(state: Column) -> Column:
    return state.isin(FINAL_STATES)


def state_order(state: Column) -> Column:
    """Place of a state in the order that runs go through, from 1; null for an unknown one."""
    return F.nullif(F.array_position(F.array(*map(F.lit, STATES)), state), F.lit(0))


def strip(text: Column) -> Column:
    """Without white space of any script at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def content_key(values: list[Column]) -> Column:
    """Stripped, lower-cased values joined by `|`; null reads as `none`."""
    return F.concat_ws("|", *(F.coalesce(F.lower(strip(v.cast("string"))), F.lit("none")) for v in values))


def falsy(value: Column, kind: T.DataType) -> Column:
    """Null, empty, zero or false."""
    if isinstance(kind, T.StringType):
        return value.isNull() | (value == "")
    if isinstance(kind, T.NumericType):
        return value.isNull() | (value == 0)
    if isinstance(kind, T.BooleanType):
        return value.isNull() | ~value
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return value.isNull() | (F.size(value) == 0)
    return value.isNull()


def contains_any(text: Column, terms: list[str]) -> Column:
    out = F.lit(False)
    for term in terms:
        out = out | text.contains(term)
    return F.coalesce(out, F.lit(False))


def reasons(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition holds, in the order given."""
    return F.array_compact(F.array(*(F.when(test, name) for test, name in pairs)))
