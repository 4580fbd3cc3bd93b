"""Fields of JSON texts that models write: fenced, with comments, trailing commas, or numbers as strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract(text: Column) -> Column:
    """From the first brace to the last, without code fences, comments at line ends and trailing commas; null without
    braces."""
    bare = F.regexp_replace(text, r"```[A-Za-z]*", "")
    body = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    clean = F.regexp_replace(F.regexp_replace(body, r"(?m)(?<=[\s,{\[}\]])//[^\n]*$", ""), r",(\s*[}\]])", "$1")
    return F.nullif(clean, F.lit(""))


def string(json: Column, name: str, default: str | None = None) -> Column:
    return F.coalesce(F.get_json_object(json, f"$.{name}"), F.lit(default))


def number(json: Column, name: str, default: float | None = None) -> Column:
    """Numbers, and strings that hold one."""
    return F.coalesce(F.get_json_object(json, f"$.{name}").try_cast("double"), F.lit(default))


def strings(json: Column, name: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object(json, f"$.{name}"), "array<string>", {"mode": "PERMISSIVE"}), F.array().cast("array<string>"))
