"""Whether a tool's output says that the tool failed: what its protocol says, never words of errors in the text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Headers of outputs, with the code that they tell or with what they mean.
CHUNK = "(?i)^Chunk ID:"
CHUNK_CODE = r"(?im)^Process exited with code\s+(-?\d+)\b"
SCRIPT_DONE, SCRIPT_FAILED = r"(?i)^Script completed\s*\nWall time:", r"(?i)^Script failed\s*\nWall time:"
SCRIPT_CODE = r"(?im)^Script error:\s*\nExit code:\s*(-?\d+)\b"
COMMAND_CODE = r"(?i)^Command failed with exit code\s+(-?\d+)\.?$"
TOOL_ERROR = r"(?i)^<tool_error>[\s\S]*</tool_error>$"
OUTPUT_MARK = "\nOutput:\n"
# Fields of an output that is an object.
CODES, OUTPUT_FIELDS, TIMEOUTS, RESULT_FIELDS, TEXT_TYPES = ("exit_code", "exitCode"), ("output", "chunk_id", "wall_time_seconds"), ("timed_out", "timedOut"), ("value", "error"), ("input_text", "text")
#: How often JSON in a text is looked into.
DEPTH = 2


def _code(text: Column, pattern: str) -> Column:
    """Whether the code that a pattern finds isn't 0; null if it finds none."""
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")).try_cast("decimal(38,0)") != 0


def _said(text: Column) -> Column:
    at = F.instr(text, OUTPUT_MARK)
    header = F.when(at > 0, F.substring(text, F.lit(1), at - 1)).otherwise(text)
    chunk = F.when(header.rlike(CHUNK), _code(header, CHUNK_CODE))
    return F.coalesce(chunk, F.when(header.rlike(SCRIPT_DONE), False), F.when(header.rlike(SCRIPT_FAILED), True), _code(header, SCRIPT_CODE), _code(text, COMMAND_CODE), F.when(text.rlike(TOOL_ERROR), True))


def _has(v: Column, names: tuple[str, ...]) -> Column:
    found = F.lit(False)
    for n in names:
        found = found | F.try_variant_get(v, f"$.{n}", "variant").isNotNull()
    return found


def _object(v: Column, timeout_fails: bool, depth: int) -> Column:
    get = lambda n, kind: F.try_variant_get(v, f"$.{n}", kind)
    codes = [F.when(_has(v, OUTPUT_FIELDS), F.nullif(F.trim(get(n, "string")), F.lit("")).try_cast("decimal(38,6)") != 0) for n in CODES]
    late = [F.when(get(n, "boolean"), True) for n in TIMEOUTS] if timeout_fails else []
    done = F.when(_has(v, RESULT_FIELDS), ~get("succeeded", "boolean"))
    text = F.when(get("type", "string").isin(*TEXT_TYPES), _text(get("text", "string"), timeout_fails, depth - 1))
    return F.coalesce(*codes, *late, done, text)


def _value(v: Column, timeout_fails: bool, depth: int) -> Column:
    kind = F.schema_of_variant(v)
    one = lambda x: F.when(F.schema_of_variant(x) == "STRING", _text(F.try_variant_get(x, "$", "string"), timeout_fails, depth - 1)).when(F.schema_of_variant(x).startswith("OBJECT"), _object(x, timeout_fails, depth))
    each = F.transform(F.try_variant_get(v, "$", "array<variant>"), one)
    any_of = F.when(F.exists(each, lambda x: F.coalesce(x, F.lit(False))), True).when(F.exists(each, lambda x: F.coalesce(~x, F.lit(False))), False)
    return F.when(kind.startswith("ARRAY"), any_of).when(kind.startswith("OBJECT"), _object(v, timeout_fails, depth))


def _text(text: Column, timeout_fails: bool, depth: int) -> Column:
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    plain = F.when(t != "", _said(t))
    if depth < 1:
        return plain
    json = (t.startswith("{") & t.endswith("}")) | (t.startswith("[") & t.endswith("]"))
    return F.coalesce(F.when(json, _value(F.try_parse_json(t), timeout_fails, depth)), plain)


def output_failed(text: Column, timeout_fails: bool = True, depth: int = DEPTH) -> Column:
    """true or false if an output's protocol tells, else null.

    Lists fail if one part does. JSON in texts of JSON is looked into to the depth given.
    """
    return _text(text, timeout_fails, depth)
