"""What models' answers and settings say: expressions that never fail on odd text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from granary.functions.text import strip

#: Marks before an answer, and words that say yes, no and true.
LEADING = "：:。.\"'“”「」 "
NO, YES, TRUE = ("否", "不"), ("是", "yes"), ("1", "true", "yes", "on")


def says_yes(c: Column) -> Column:
    """Whether an answer begins with a yes, behind marks and white space; a no is looked for first, null says nothing."""
    answer = F.lower(F.regexp_replace(strip(F.coalesce(c, F.lit(""))), f"^[{LEADING}]+", ""))
    begins = lambda words: sum((F.startswith(answer, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    return ~begins(NO) & begins(YES)


def numbered(c: Column, n: int) -> Column:
    """The n summaries of an answer of parts like "[2] text": white space collapsed, the last of a repeated number, "" for a missing one."""
    marks = F.transform(F.regexp_extract_all(c, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.try_cast("int"))
    bodies = F.transform(F.slice(F.split(c, r"\[\d+\]"), 2, 1 << 30), lambda x: F.regexp_replace(strip(x), r"\s+", " "))
    said = F.filter(F.arrays_zip(marks.alias("i"), bodies.alias("body")), lambda z: z["body"] != "")
    last = lambda i: F.element_at(F.concat(F.array(F.lit("")), F.transform(F.filter(said, lambda z: z["i"] == i), lambda z: z["body"])), -1)
    return F.when(c.isNotNull(), F.transform(F.sequence(F.lit(1), F.lit(n)), last)).otherwise(F.array_repeat(F.lit(""), n))


def size_limit(length: Column, ratio: float, least: int = 200) -> Column:
    return F.greatest(F.lit(least), F.floor(length * F.lit(ratio)).cast("int"))


def index_set(c: Column) -> Column:
    """Whole numbers among an array of strings, each once, in order."""
    numbers = F.transform(c, lambda x: F.when(F.regexp_like(x, F.lit(r"^\s*[+-]?\d+\s*$")), F.trim(x).try_cast("long")))
    return F.array_sort(F.array_distinct(F.array_compact(numbers)))


def clamped(c: Column, low: int = 1, high: int = 5) -> Column:
    """A judge's mark, rounded half to even, within its scale; the least for what isn't a number."""
    x = c.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), low).otherwise(F.least(F.greatest(F.bround(x).cast("int"), F.lit(low)), F.lit(high))).cast("int")


def scalar(c: Column) -> Column:
    """(kind, value) of a setting's text: bool, null, int, float or str, tried in that order; value is its plain form."""
    low, bare = F.lower(strip(c)), strip(c)
    kind = F.when(low.isin("true", "false"), "bool").when(low.isin("none", "null"), "null").when(F.regexp_like(bare, F.lit(r"^[+-]?\d+(_\d+)*$")), "int")
    kind = kind.when(F.regexp_like(low, F.lit(r"^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity|nan)$")), "float").otherwise("str")
    value = F.when(kind.isin("bool", "float"), low).when(kind == "int", F.regexp_replace(bare, "[+_]", "")).when(kind == "str", c)
    return F.struct(kind.alias("kind"), value.alias("value"))


def key_value(c: Column) -> Column:
    """(key, kind, value) of "KEY=VALUE", cut at the first sign; null where there is none or no key."""
    at = F.instr(c, "=")
    key, said = strip(F.substr(c, F.lit(1), at - 1)), scalar(F.substr(c, at + 1))
    return F.when((at > 0) & (key != ""), F.struct(key.alias("key"), said["kind"].alias("kind"), said["value"].alias("value")))


def switched_on(c: Column, default: bool) -> Column:
    """A switch from the environment: the default where it is unset or blank."""
    said = F.lower(strip(F.coalesce(c, F.lit(""))))
    return F.when(said == "", F.lit(default)).otherwise(said.isin(*TRUE))


def one_line(c: Column) -> Column:
    """A text as it is sent to an embedder."""
    return F.replace(c, F.lit("\n"), F.lit(" "))
