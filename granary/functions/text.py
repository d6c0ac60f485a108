"""Text expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"
_EDGE = r"^[\s\p{Z}]+|[\s\p{Z}]+$"


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.regexp_replace(c, _EDGE, "")


def tokens(c: Column) -> Column:
    """Lower-cased tokens of two or more letters, digits or underscores, repeats included."""
    return F.regexp_extract_all(F.lower(c), F.lit(f"({TOKEN})"), F.lit(1))


def keyword_dedup(c: Column, most: int = 50) -> Column:
    """Distinct words in their first order, at most so many, space-joined."""
    return F.array_join(F.slice(F.array_distinct(F.filter(F.split(c, r"\s+"), lambda w: w != "")), 1, most), " ")


def keyword_count(c: Column, words: list[str]) -> Column:
    """How many of the words occur, each counted once."""
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words[1:]), F.contains(c, F.lit(words[0])).cast("int"))


def is_complex(c: Column, words: list[str]) -> Column:
    """Two keywords, or two question marks, or one keyword in more than 80 characters."""
    k = keyword_count(c, words)
    marks = F.length(c) - F.length(F.regexp_replace(c, "[?？]", ""))
    return (k >= 2) | (marks >= 2) | ((F.length(c) > 80) & (k >= 1))


def without_thoughts(c: Column) -> Column:
    """A model's answer without its think blocks."""
    return strip(F.regexp_replace(c, r"(?s)<think(?:ing)?>.*?</think(?:ing)?>\s*", ""))


def sub_queries(c: Column) -> Column:
    """The questions of a numbered or dashed list: lines of over three characters when their marks are gone."""
    line = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(strip(x), r"^[0-9]+[.)、\s:：]+\s*", ""), r"^[-•*]\s*", ""), r"^[Qq]uestion\s*[0-9]+[:：]\s*", ""), r"^子(?:问题|查询)\s*[0-9]+[:：]\s*", "")
    return F.filter(F.transform(F.filter(F.split(c, "\n"), lambda x: F.length(strip(x)) >= 3), line), lambda x: F.length(x) > 3)


def cn_numeral(c: Column) -> Column:
    """A Chinese numeral below ten thousand as a number; 0 for anything else. Ten without a digit before it is one ten."""
    digits = F.create_map(*[F.lit(x) for kv in [*zip("零一二三四五六七八九", range(10), strict=True), ("两", 2)] for x in kv])
    units = F.create_map(*[F.lit(x) for kv in (("十", 10), ("百", 100), ("千", 1000)) for x in kv])
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("now"), F.lit(True).alias("ok"))

    def step(s, ch):
        d, u = F.try_element_at(digits, ch), F.try_element_at(units, ch)
        sum_ = F.when(u.isNotNull(), s["sum"] + F.when(s["now"] == 0, 1).otherwise(s["now"]) * u).otherwise(s["sum"])
        now = F.when(u.isNotNull(), 0).when(d.isNotNull(), d).otherwise(s["now"])
        return F.struct(sum_.alias("sum"), now.alias("now"), (s["ok"] & (d.isNotNull() | u.isNotNull())).alias("ok"))

    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), start, step, lambda s: F.when(s["ok"], s["sum"] + s["now"]).otherwise(0))


def json_part(c: Column, schema: str) -> Column:
    """The object in a model's answer, fenced or with text around it; null where it isn't one or is of another type."""
    return F.from_json(F.regexp_extract(c, r"(?s)(\{.*\})", 1), schema)
