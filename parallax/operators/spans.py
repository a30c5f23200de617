"""Tokens with character offsets, and their mapping to spans of a text.

Offsets are code points of the text, half-open. Spans of a text are few, so they travel as an
array next to the token and are searched by array lambdas: no join. For span tables that are
not grouped yet there is `map_by_join`, an equi-join on the text's key with the interval
condition as its residual.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parallax.functions.text import is_punctuation, is_whitespace
from parallax.schemas import ANCHOR, BOUNDARY, FIRST_TOKEN, MAPPED, NOT_APPLICABLE, PUNCTUATION, UNMAPPED, WHITESPACE

#: Runs of word characters, single other characters, runs of white space.
PIECES = r"\s+|[A-Za-z0-9_]+|[^\sA-Za-z0-9_]"
#: Pieces whose offsets are summed in one go.
RUN = 64


def tokenize(rows: DataFrame, keys: Sequence[str], text: str, pattern: str = PIECES) -> DataFrame:
    """(keys, pos, piece, start_char, end_char): the pieces of a text, numbered from 1.

    The pattern must cover the text without gaps, so that offsets are running lengths. They are
    summed inside the row: nothing is shuffled, and rows that repeat a key do not mix.
    """
    pieces = rows.select(*keys, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)).alias("_p"))
    none = F.array().cast("array<struct<piece:string,start_char:bigint,end_char:bigint>>")
    # offsets are summed over runs of RUN pieces and inside each: appending to one long array would copy it for every piece
    runs = F.transform(F.sequence(F.lit(0), F.floor(F.size("_p") / RUN).cast("int")), lambda k: F.slice("_p", k * RUN + 1, RUN))
    sizes = F.transform(runs, lambda r: F.aggregate(r, F.lit(0).cast("long"), lambda n, x: n + F.length(x)))
    starts = F.aggregate(sizes, F.array(F.lit(0).cast("long")), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
    placed = F.transform(runs, lambda r, k: F.aggregate(
        r, F.struct(F.get(starts, k).alias("at"), none.alias("out")),
        lambda acc, x: F.struct((acc["at"] + F.length(x)).alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("piece"), acc["at"].alias("start_char"), (acc["at"] + F.length(x)).alias("end_char")))).alias("out")),
        lambda acc: acc["out"],
    ))
    out = pieces.select(*keys, F.posexplode(F.flatten(placed)).alias("_i", "_t"))
    return out.select(*keys, (F.col("_i") + 1).cast("long").alias("pos"), "_t.piece", "_t.start_char", "_t.end_char")


def tokenize_with(rows: DataFrame, text: str, tokenizer: Callable[[list[str]], list[list[tuple[int, int, int]]]]) -> DataFrame:
    """Add `token_ids` and `offsets` by a plug-in: a function from texts to lists of (id, start, end)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = tokenizer(frame[text].fillna("").tolist())
            yield frame.assign(token_ids=[[t[0] for t in f] for f in found], offsets=[[{"start": t[1], "end": t[2]} for t in f] for f in found])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInPandas(run, f"{fields}, token_ids array<int>, offsets array<struct<start:int,end:int>>")


def prefix_aligned(full_ids: Column, base_ids: Column) -> Column:
    """Whether the ids of prompt + reference begin with the prompt's own ids."""
    return F.slice(full_ids, 1, F.size(base_ids)).eqNullSafe(base_ids)


def align(rows: DataFrame, offsets: str, base_length: str) -> DataFrame:
    """Where the reference starts among the tokens of prompt + reference.

    Adds reference_start (index from 0 of the first token that ends behind the prompt),
    boundary_crossed (that token starts inside the prompt) and align_error (null if fine).
    """
    beyond = lambda o: o["end"] > F.col(base_length)
    flags = F.transform(F.col(offsets), beyond)
    start = F.array_position(flags, True) - 1
    out = rows.withColumn("reference_start", F.when(start >= 0, start).cast("int"))
    crossed = F.get(F.col(offsets), F.col("reference_start"))["start"] < F.col(base_length)
    error = F.when(F.coalesce(F.size(offsets), F.lit(0)) < 2, "too_short").when(F.col("reference_start").isNull(), "no_reference_token").when(F.col("reference_start") == 0, "no_prompt_token")
    return out.withColumns({"boundary_crossed": F.coalesce(crossed, F.lit(False)), "align_error": error})


def step_of(start: Column, end: Column, spans: Column) -> Column:
    """STRUCT<status, step>: mapped if exactly one span contains the token, else boundary_overlap if any touches it, else unmapped."""
    inside = F.filter(spans, lambda s: (start >= s["start_char"]) & (end <= s["end_char"]))
    touched = F.exists(spans, lambda s: (end > s["start_char"]) & (start < s["end_char"]))
    status = F.when(F.size(inside) == 1, MAPPED).when((F.size(inside) > 1) | F.coalesce(touched, F.lit(False)), BOUNDARY).otherwise(UNMAPPED)
    return F.struct(status.alias("status"), F.when(F.size(inside) == 1, F.get(inside, 0)["semantic_step_id"]).alias("step"))


def map_steps(tokens: DataFrame, piece: str = "piece", start: str = "start_char", end: str = "end_char", spans: str = "spans", condition: Column | None = None, position: str | None = None, reference_start: Column | None = None) -> DataFrame:
    """Add semantic_mapping_status and semantic_step_id.

    Order of the rules: the first position is excluded; the anchor condition has no steps;
    white space and punctuation are classes of their own; all else is mapped by its offsets,
    which are taken from the start of the reference and not below 0.
    """
    begin = reference_start if reference_start is not None else F.lit(0)
    found = step_of(F.greatest(F.lit(0), F.col(start) - begin), F.col(end) - begin, F.col(spans))
    status = F.when(condition == ANCHOR, NOT_APPLICABLE) if condition is not None else F.when(F.lit(False), NOT_APPLICABLE)
    status = status.when(is_whitespace(F.col(piece)), WHITESPACE).when(is_punctuation(F.col(piece)), PUNCTUATION).otherwise(found["status"])
    if position:
        status = F.when(F.col(position) == 1, FIRST_TOKEN).otherwise(status)
    out = tokens.withColumn("_found", found).withColumn("semantic_mapping_status", status)
    return out.withColumn("semantic_step_id", F.when(F.col("semantic_mapping_status") == MAPPED, F.col("_found.step"))).drop("_found")


def map_by_join(tokens: DataFrame, spans: DataFrame, keys: Sequence[str], token: Sequence[str]) -> DataFrame:
    """step_of() for spans in a table (keys, semantic_step_id, start_char, end_char).

    A shuffle join on the keys; the interval test is its residual condition, so that no pair of
    different texts is ever formed.
    """
    s = spans.select(*(F.col(k).alias(f"_k_{k}") for k in keys), "semantic_step_id", F.col("start_char").alias("_a"), F.col("end_char").alias("_b"))
    same = [tokens[k] == s[f"_k_{k}"] for k in keys]
    touch = (F.col("end_char") > F.col("_a")) & (F.col("start_char") < F.col("_b"))
    inside = (F.col("start_char") >= F.col("_a")) & (F.col("end_char") <= F.col("_b"))
    condition = touch
    for c in same:
        condition = condition & c
    both = tokens.join(s, condition, "left").withColumn("_in", F.coalesce(inside, F.lit(False)))
    one = both.groupBy(*keys, *token, "start_char", "end_char").agg(F.count("_a").alias("_touched"), F.sum(F.col("_in").cast("int")).alias("_inside"), F.max(F.when(F.col("_in"), F.col("semantic_step_id"))).alias("_step"))
    status = F.when(F.col("_inside") == 1, MAPPED).when(F.col("_touched") > 0, BOUNDARY).otherwise(UNMAPPED)
    return one.select(*keys, *token, "start_char", "end_char", status.alias("semantic_mapping_status"), F.when(F.col("_inside") == 1, F.col("_step")).alias("semantic_step_id"))


def span_errors(spans: DataFrame, keys: Sequence[str], length: str, step: str = "semantic_step_id") -> DataFrame:
    """One row per broken rule (keys, step, error): range, overlap with an earlier span, or a step used twice."""
    ordered = Window.partitionBy(*keys).orderBy("start_char", "end_char", step)
    reach = F.max(F.when(F.col("start_char").isNotNull(), F.col("end_char"))).over(ordered.rowsBetween(Window.unboundedPreceding, -1))
    seen = F.row_number().over(Window.partitionBy(*keys, step).orderBy("start_char", "end_char"))
    valid = (F.col("start_char") >= 0) & (F.col("start_char") < F.col("end_char")) & (F.col("end_char") <= F.col(length))
    errors = F.array_compact(F.array(F.when(~F.coalesce(valid, F.lit(False)), "invalid_range"), F.when(F.col("start_char") < reach, "overlap"), F.when(seen > 1, "duplicate_step")))
    return spans.withColumn("_errors", errors).select(*keys, step, "start_char", "end_char", F.explode("_errors").alias("error"))
