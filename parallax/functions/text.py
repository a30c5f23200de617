"""Text expressions: prompts, names, durations, character classes, audits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def prompt(task: Column) -> Column:
    return F.concat(F.lit("Task:\n"), task, F.lit("\n\nSolution:\n"))


def trajectory_id(*parts: Column) -> Column:
    return F.concat_ws("__", *parts)


def slug(name: Column) -> Column:
    """Every character but letters, digits and `._-` becomes an underscore."""
    return F.regexp_replace(name, r"[^\p{L}\p{N}._-]", "_")


def duration(seconds: Column) -> Column:
    """`1h 02m 03s` without leading zero parts, of whole seconds (half to even), 0 at least."""
    s = F.greatest(F.lit(0).cast("long"), F.bround(seconds.cast("double"), 0).cast("long"))
    hours, minutes, rest = F.floor(s / 3600), F.floor(F.pmod(s, F.lit(3600)) / 60), F.pmod(s, F.lit(60))
    pad = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit("h "), pad(minutes), F.lit("m "), pad(rest), F.lit("s"))).when(minutes > 0, F.concat(minutes.cast("string"), F.lit("m "), pad(rest), F.lit("s"))).otherwise(F.concat(rest.cast("string"), F.lit("s")))


def is_whitespace(text: Column) -> Column:
    """Not empty, all Unicode white space."""
    return text.rlike(r"(?U)^\s+$")


def is_punctuation(text: Column) -> Column:
    """Apart from white space not empty, and all of it punctuation or symbols."""
    return text.rlike(r"(?U)^[\p{P}\p{S}\s]+$") & ~is_whitespace(text)


#: Names of number types and what they stand for. Fixed values.
DTYPES = {"bf16": "bfloat16", "bfloat16": "bfloat16", "fp16": "float16", "float16": "float16", "fp32": "float32", "float32": "float32"}


def dtype_name(alias: Column) -> Column:
    """The canonical name of a number type; null if unknown."""
    pairs = [F.lit(x) for pair in DTYPES.items() for x in pair]
    return F.element_at(F.create_map(*pairs), F.lower(alias))


def missing_strings(text: Column, required: list[str]) -> Column:
    """Names of the required strings that are missing."""
    return F.array_compact(F.array(*(F.when(~text.contains(r), F.lit(r)) for r in required)))


def four_places(value: Column) -> Column:
    """A number as text with four decimal places, no grouping."""
    return F.format_string("%.4f", value)
