"""Statistics of one score vector (a next-token distribution) as Column functions.

A vector is an ARRAY of scores indexed from 0. All functions are null-safe: a null vector or
an index out of range gives null. Each value that an array lambda needs for every element is
bound once with `let`, because lambda bodies are evaluated per element.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TOP_K = 20


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def valid_vocab(scores: Column, size: int) -> Column:
    """The first `size` scores."""
    return F.slice(scores, 1, size)


def log_softmax(scores: Column) -> Column:
    z = scores.cast("array<double>")
    norm = lambda top: top + F.log(F.aggregate(z, F.lit(0.0), lambda acc, x: acc + F.exp(x - top)))
    return let(F.array_max(z), lambda top: let(norm(top), lambda n: F.transform(z, lambda x: x - n)))


def softmax(logprobs: Column) -> Column:
    return F.transform(logprobs, F.exp)


def entropy(logprobs: Column) -> Column:
    """In nats; a probability of zero adds nothing."""
    return F.aggregate(logprobs, F.lit(0.0), lambda acc, x: acc - F.when(F.exp(x) > 0, F.exp(x) * x).otherwise(0.0))


def top_k(logprobs: Column, k: int = TOP_K) -> Column:
    """ARRAY<STRUCT<token_id, logprob, probability>> of the k best, best first, ties by smaller id."""
    keyed = F.transform(logprobs, lambda x, i: F.struct(x.alias("logprob"), (-i).alias("minus_id")))
    best = F.slice(F.sort_array(keyed, asc=False), 1, k)
    return F.transform(best, lambda s: F.struct((-s["minus_id"]).cast("int").alias("token_id"), s["logprob"].alias("logprob"), F.exp(s["logprob"]).alias("probability")))


def mass(top: Column) -> Column:
    return F.aggregate(top, F.lit(0.0), lambda acc, s: acc + s["probability"])


def renormalised_entropy(top: Column) -> Column:
    """Entropy of the top entries rescaled to sum to one."""
    part = lambda q: F.when(q > 0, q * F.log(q)).otherwise(0.0)
    return let(mass(top), lambda m: F.aggregate(top, F.lit(0.0), lambda acc, s: acc - part(s["probability"] / m)))


def p1(top: Column) -> Column:
    return F.get(top, 0)["probability"]


def p2(top: Column) -> Column:
    """The second probability, 0 if there is one entry only."""
    return F.when(F.size(top) > 1, F.get(top, 1)["probability"]).when(F.size(top) == 1, 0.0)


def tail_mass(top: Column) -> Column:
    return F.greatest(F.lit(0.0), 1 - mass(top))


def argmax_id(top: Column) -> Column:
    return F.get(top, 0)["token_id"]


def reference_logprob(logprobs: Column, reference: Column) -> Column:
    return F.get(logprobs, reference)


def reference_rank(scores: Column, reference: Column) -> Column:
    """1 + the number of scores above the reference's: ties favour the reference."""
    return let(F.get(scores, reference), lambda own: F.when(own.isNotNull(), F.size(F.filter(scores, lambda x: x > own)) + 1))


def pack_top(top: Column, with_logprob: bool = True) -> Column:
    """The top entries as JSON text."""
    fields = ["token_id", "probability", *(["logprob"] if with_logprob else [])]
    return F.to_json(F.transform(top, lambda s: F.struct(*(s[f].alias(f) for f in fields))))


MEASURES = "entropy double, entropy_top double, top_mass double, tail_mass double, p1 double, p2 double, p1_minus_p2 double, reference_logprob double, reference_probability double, reference_surprisal double, reference_rank int, reference_in_top boolean, top1_token_id int"


def measure(df: DataFrame, scores: str = "logits", reference: str = "reference_token_id", k: int = TOP_K, vocab: int | None = None, keep_top: bool = False) -> DataFrame:
    """Every per-token statistic of `scores`; the vector itself is dropped.

    One expression binds log-probabilities and top entries for all statistics, so that they are
    computed once per row whatever is selected later.
    """
    z = F.col(scores).cast("array<double>")
    df = df.withColumn(scores, valid_vocab(z, vocab) if vocab else z)
    ref = F.col(reference)

    def metrics(lp: Column, top: Column) -> Column:
        own = reference_logprob(lp, ref)
        rank = reference_rank(F.col(scores), ref)
        fields = {
            "entropy": entropy(lp), "entropy_top": renormalised_entropy(top), "top_mass": mass(top), "tail_mass": tail_mass(top), "p1": p1(top), "p2": p2(top), "p1_minus_p2": p1(top) - p2(top),
            "reference_logprob": own, "reference_probability": F.exp(own), "reference_surprisal": -own, "reference_rank": rank, "reference_in_top": rank <= k, "top1_token_id": argmax_id(top),
        }
        if keep_top:
            fields["top"] = top
        return F.struct(*(c.alias(n) for n, c in fields.items()))

    found = let(log_softmax(F.col(scores)), lambda lp: let(top_k(lp, k), lambda top: metrics(lp, top)))
    return df.withColumn("_m", found).select(*(c for c in df.columns if c != scores), "_m.*")


def measure_wide(df: DataFrame, scores: str = "logits", reference: str = "reference_token_id", k: int = TOP_K, vocab: int | None = None) -> DataFrame:
    """measure() for vocabulary-wide vectors: numpy over Arrow batches, selection instead of a full sort.

    Rows go through one at a time, so memory is a few vectors wide.
    """
    keep = [c for c in df.columns if c != scores]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_measure_one(z.values.to_numpy(zero_copy_only=False)[: vocab or None] if z.is_valid else None, r.as_py(), k) for z, r in zip(batch.column(scores), batch.column(reference), strict=True)]
            names = [c.split()[0] for c in MEASURES.split(", ")]
            kinds = {"double": pa.float64(), "int": pa.int32(), "boolean": pa.bool_()}
            types = [kinds[c.split()[1]] for c in MEASURES.split(", ")]
            columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *columns], [*keep, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != scores)
    return df.mapInArrow(run, f"{fields}, {MEASURES}")


def _measure_one(scores: np.ndarray | None, reference: int | None, k: int) -> tuple:
    if scores is None or not len(scores):
        return (None,) * 13
    z = scores.astype(np.float64)
    lp = z - (z.max() + np.log(np.exp(z - z.max()).sum()))
    p = np.exp(lp)
    near = np.argpartition(-lp, min(k, len(lp)) - 1)[:k] if k < len(lp) else np.arange(len(lp))
    near = np.flatnonzero(lp >= lp[near].min())  # with all ties of the last one
    top = near[np.lexsort((near, -lp[near]))][:k]
    total_mass = p[top].sum()
    q = p[top] / total_mass
    q = q[q > 0]
    second = p[top[1]] if len(top) > 1 else 0.0
    if reference is not None and 0 <= reference < len(z):
        rank = int((z > z[reference]).sum()) + 1
        own = (float(lp[reference]), float(p[reference]), float(-lp[reference]), rank, rank <= k)
    else:
        own = (None,) * 5
    live = p > 0
    return (float(-(p[live] * lp[live]).sum()), float(-(q * np.log(q)).sum()), float(total_mass), float(max(0.0, 1 - total_mass)), float(p[top[0]]), float(second), float(p[top[0]] - second), *own, int(top[0]))
