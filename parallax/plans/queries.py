"""The engine's operators bound to the test tables; `parallax.plans.oracle` has their SQL twins.

Roles: `embeddings.embedding` are score vectors and `label` the reference id; `events` by
(user_id; ts, event_id) are ordered tokens; `lineitem` by supplier (task), nation (family) and
return flag (condition) are trajectories; `benchmark.text` are reference texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parallax.functions import distribution as D
from parallax.functions import text as X
from parallax.operators import contrast as C
from parallax.operators import decide as V
from parallax.operators import gates as Q
from parallax.operators import infer as I
from parallax.operators import resume as R
from parallax.operators import spans as P
from parallax.operators import summarise as S
from parallax.operators.programs import frames


Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
LEVELS, METRICS = ("A", "N", "R"), ("price", "quantity", "discount")
PAIRS = (("C1", "A", "N", "positive"), ("C2", "N", "R", "positive"), ("C3", "A", "R", "positive"), ("C4", "R", "A", "two_sided"))
DRAWS = 200


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + 0.0


def _rounded(rows: DataFrame) -> DataFrame:
    return rows.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes))


def _trajectories(spark: SparkSession, d: str) -> DataFrame:
    """task_id, family, condition and metrics of each line item."""
    supplier = load(spark, d, "supplier").select(F.col("s_suppkey").alias("task_id"), F.col("s_nationkey").cast("long").alias("family"))
    items = load(spark, d, "lineitem").select(F.col("l_suppkey").alias("task_id"), F.col("l_returnflag").alias("condition"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("price"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))
    return items.join(supplier, "task_id")


def _means(spark: SparkSession, d: str) -> DataFrame:
    return C.condition_means(_trajectories(spark, d), ["task_id", "family", "condition"], METRICS)


def _deltas(spark: SparkSession, d: str) -> DataFrame:
    """All contrasts, paired units only."""
    return C.contrasts(_means(spark, d), C.definitions(spark, PAIRS), ["task_id", "family"], "condition", METRICS).where("paired")


def _logits(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "embeddings").select("vec_id", F.col("label").alias("reference_token_id"), F.col("embedding").cast("array<double>").alias("logits"))


def _measured(spark: SparkSession, d: str, **more) -> DataFrame:
    return D.measure(_logits(spark, d), **more)


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Events as measured tokens of a user's trajectory; p1 is the value on a scale of 0 to 1."""
    events = load(spark, d, "events").select("user_id", "ts", "event_id", "event_type", F.col("value").alias("entropy_top20_normalized"), (F.col("value") * 2).alias("entropy_valid_vocab"), (F.col("value") / 500).alias("p1"))
    return S.with_position(events, ["user_id"], ["ts", "event_id"])


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    return P.tokenize(load(spark, d, "benchmark"), ["item_id"], "text")


def _mapped(spark: SparkSession, d: str) -> DataFrame:
    """Pieces against spans of 36 of every 40 characters."""
    texts = load(spark, d, "benchmark").select("item_id", F.length("text").alias("_n"))
    spans = F.transform(F.sequence(F.lit(0), F.floor((F.col("_n") - 1) / 40).cast("int")), lambda k: F.struct(F.concat(F.lit("S"), k.cast("string")).alias("semantic_step_id"), (k * 40).cast("long").alias("start_char"), F.least(k * 40 + 36, F.col("_n")).cast("long").alias("end_char")))
    return P.map_steps(_pieces(spark, d).join(texts.select("item_id", spans.alias("spans")), "item_id"), position="pos")


# --- contrasts -------------------------------------------------------------------------------


@query
def paired_contrast_summary(spark: SparkSession, d: str) -> DataFrame:
    table = C.deltas_wide(C.wide(_means(spark, d), ["task_id", "family"], "condition", LEVELS, ["price"]), ["price"], "A", "R")
    out = I.describe(table, [], "delta_price")
    return out.select("n", *(r6(c).alias(c) for c in ("mean", "median", "sd", "cohens_dz", "positive_fraction")), "positive", "negative", "zero")


@query
def task_condition_means(spark: SparkSession, d: str) -> DataFrame:
    return _means(spark, d).select("task_id", "family", "condition", *(r6(m).alias(m) for m in METRICS))


@query
def task_delta_wide(spark: SparkSession, d: str) -> DataFrame:
    table = C.deltas_wide(C.wide(_means(spark, d), ["task_id", "family"], "condition", LEVELS, METRICS), METRICS, "A", "R")
    return table.select("task_id", "family", *(r6(c).alias(c) for c in table.columns if c not in ("task_id", "family")))


@query
def contrast_long(spark: SparkSession, d: str) -> DataFrame:
    return _deltas(spark, d).select("contrast", "left_condition", "right_condition", "task_id", "family", *(r6(f"delta_{m}").alias(f"delta_{m}") for m in METRICS))


@query
def contrast_partners(spark: SparkSession, d: str) -> DataFrame:
    """Units that lack a side of a contrast; orders are the units, and few have line items of every flag."""
    items = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_returnflag").alias("condition"), F.col("l_quantity").alias("quantity"))
    return C.contrasts(C.condition_means(items, ["task_id", "condition"], ["quantity"]), C.definitions(spark, PAIRS), ["task_id"], "condition", ["quantity"]).groupBy("contrast").agg(F.count(F.when(F.col("paired"), 1)).alias("paired_units"), F.count(F.when(~F.col("paired"), 1)).alias("unpaired_units"))


@query
def family_delta_means(spark: SparkSession, d: str) -> DataFrame:
    return C.family_means(_deltas(spark, d), ["contrast", "family"], [f"delta_{m}" for m in METRICS]).select("contrast", "family", *(r6(f"delta_{m}").alias(f"delta_{m}") for m in METRICS))


@query
def family_spread(spark: SparkSession, d: str) -> DataFrame:
    out = C.family_spread(C.family_means(_deltas(spark, d), ["contrast", "family"], ["delta_price"]), ["contrast"], "delta_price")
    return out.select("contrast", *(r6(c).alias(c) for c in ("min_family_delta", "max_family_delta", "mean_family_delta")), "positive_families", "total_families")


@query
def condition_means(spark: SparkSession, d: str) -> DataFrame:
    return C.condition_means(load(spark, d, "events"), ["event_type"], ["value"]).select("event_type", r6("value").alias("mean_value"))


@query
def relative_reduction(spark: SparkSession, d: str) -> DataFrame:
    table = C.wide(_means(spark, d), ["task_id", "family"], "condition", ("A", "R"), METRICS)
    return table.agg(*(r6(C.relative_reduction(F.col(f"{m}_A"), F.col(f"{m}_R"))).alias(f"reduction_{m}") for m in METRICS))


@query
def completeness_grid(spark: SparkSession, d: str) -> DataFrame:
    """Line items of each part and flag; parts that nobody ordered are expected too."""
    parts = load(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"))
    return C.completeness(load(spark, d, "lineitem"), "l_partkey", "l_returnflag", LEVELS, 3, parts)


@query
def distinct_counts(spark: SparkSession, d: str) -> DataFrame:
    return _trajectories(spark, d).groupBy("condition").agg(F.count_distinct("task_id").alias("tasks"), F.count_distinct("family").alias("families"), F.count(F.lit(1)).alias("n"), F.bool_and(F.col("quantity") > 0).alias("all_positive"), F.bool_or(F.col("discount") == 0).alias("any_undiscounted"))


@query
def sum_over_models(spark: SparkSession, d: str) -> DataFrame:
    """Totals over the cells of a hierarchy, by rollup."""
    rows = load(spark, d, "orders").groupBy("o_orderstatus", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
    return rows.rollup("o_orderstatus", "o_orderpriority").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("cells"))


@query
def nested_explode_specs(spark: SparkSession, d: str) -> DataFrame:
    tasks = load(spark, d, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("id"), F.col("p_brand").alias("family"), F.col("p_name").alias("task"), F.array("p_name", "p_brand", "p_type").alias("nl"), F.array("p_type", "p_brand", "p_name").alias("python"))
    return C.specs(tasks, expected=3)


# --- inference and decisions -----------------------------------------------------------------


def _described(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each contrast with normal-theory intervals and exact sign tests."""
    deltas = _deltas(spark, d)
    tasks = I.describe(deltas, ["contrast", "alternative"], "delta_price")
    families = I.describe(C.family_means(deltas, ["contrast", "family"], ["delta_price"]), ["contrast"], "delta_price").select("contrast", F.col("positive").alias("family_positive"), F.col("negative").alias("family_negative"))
    others = deltas.groupBy("contrast").agg(F.avg("delta_quantity").alias("valid_vocab_mean_delta"), F.avg("delta_discount").alias("semantic_step_mean_delta"))
    half = F.lit(2.576) * F.col("sd") / F.sqrt("n")
    out = tasks.withColumns({"p": I.exact_sign_p(F.col("positive"), F.col("n"), F.col("alternative") == "two_sided"), "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half, "margin": F.lit(400.0)})
    return I.holm(out, [], "p", "contrast").join(families, "contrast").join(others, "contrast")


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return V.decide(_described(spark, d), alpha=0.9, tasks=30, families=5)


@query
def exact_sign_test(spark: SparkSession, d: str) -> DataFrame:
    return I.describe(_deltas(spark, d), ["contrast"], "delta_price").select("contrast", "n", "positive", r6(I.exact_sign_p(F.col("positive"), F.col("n"), F.lit(False))).alias("p_one_sided"), r6(I.exact_sign_p(F.col("positive"), F.col("n"), F.lit(True))).alias("p_two_sided"))


@query
def holm_adjust(spark: SparkSession, d: str) -> DataFrame:
    return _described(spark, d).select("contrast", r6("p").alias("p"), r6("holm_adjusted_p").alias("holm_adjusted_p"))


@query
def equivalence_flags(spark: SparkSession, d: str) -> DataFrame:
    return _described(spark, d).select("contrast", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"), V.equivalent(F.col("ci_low"), F.col("ci_high"), F.col("margin")).alias("equivalent"))


@query
def four_criteria(spark: SparkSession, d: str) -> DataFrame:
    rules = V.four_criteria(F.col("p"), F.col("ci_low"), F.col("positive"), F.col("family_positive"), 0.9, 30, 5)
    return _described(spark, d).select("contrast", *(c.alias(n) for n, c in rules.items()))


@query
def directional_status(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).where("alternative = 'positive'").select("contrast", "primary_pass", "result_status")


@query
def c4_interpretation(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).where("alternative = 'two_sided'").select("contrast", "difference_significant", "equivalent", "primary_nonzero_pass", F.col("task_sign_count_in_observed_direction").alias("task_signs"), F.col("family_sign_count_in_observed_direction").alias("family_signs"), "interpretation", "result_status")


@query
def cross_model_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Segments as models: each model's contrasts are decided, then compared."""
    orders = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").cast("long").alias("task_id"), F.col("o_orderpriority").alias("condition"), F.col("o_totalprice").alias("price"))
    means = C.condition_means(rows, ["model", "task_id", "condition"], ["price"])
    defs = C.definitions(spark, (("C1", "1-URGENT", "2-HIGH", "positive"), ("C4", "1-URGENT", "5-LOW", "two_sided")))
    deltas = C.contrasts(means, defs, ["model", "task_id"], "condition", ["price"]).where("paired")
    stats = I.describe(deltas, ["model", "contrast", "alternative"], "delta_price")
    half = F.lit(2.576) * F.col("sd") / F.sqrt("n")
    stats = stats.withColumns({"p": I.exact_sign_p(F.col("positive"), F.col("n"), F.col("alternative") == "two_sided"), "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half, "margin": F.lit(60000.0), "family_positive": F.col("positive"), "family_negative": F.col("negative"), "valid_vocab_mean_delta": F.col("median"), "semantic_step_mean_delta": F.col("mean")})
    out = V.across_models(V.decide(I.holm(stats, ["model"], "p", "contrast"), alpha=0.99, tasks=5, families=5), models=5)
    return out.drop("model_statuses")


@query
def signflip_hash(spark: SparkSession, d: str) -> DataFrame:
    units = I.numbered(_deltas(spark, d), ["contrast"], ["task_id"])
    out = I.signflip_spread(units, ["contrast"], "delta_price", DRAWS)
    return out.select("contrast", r6("observed_mean").alias("observed_mean"), "extreme_resamples", "n_resamples", r6("p_plus1").alias("p_plus1"))


@query
def bootstrap_hash(spark: SparkSession, d: str) -> DataFrame:
    units = I.numbered(_deltas(spark, d), ["contrast"], ["task_id"])
    return I.bootstrap_spread(units, ["contrast"], "delta_price", DRAWS, 0.9).select("contrast", r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"), "n_resamples")


@query
def resample_numpy(spark: SparkSession, d: str) -> DataFrame:
    rows = _deltas(spark, d).withColumn("two_sided", F.col("alternative") == "two_sided")
    return _rounded(I.resample(rows, ["contrast"], ["task_id", "family"], "delta_price", "two_sided"))


@query
def cluster_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(I.resample(C.family_means(_deltas(spark, d), ["contrast", "family"], ["delta_price"]), ["contrast"], ["family"], "delta_price", None))


# --- distributions ---------------------------------------------------------------------------


@query
def logits_log_softmax(spark: SparkSession, d: str) -> DataFrame:
    rows = _logits(spark, d).select("vec_id", F.posexplode(D.log_softmax(F.col("logits"))).alias("i", "logprob"))
    return rows.select("vec_id", F.col("i").cast("long").alias("i"), r6("logprob").alias("logprob"), r6(F.exp("logprob")).alias("probability"))


@query
def logits_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("vec_id", r6("entropy").alias("entropy"))


@query
def topk_renorm_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("vec_id", *(r6(c).alias(c) for c in ("entropy_top", "top_mass", "tail_mass")))


@query
def p1_p2_gap(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("vec_id", *(r6(c).alias(c) for c in ("p1", "p2", "p1_minus_p2")))


@query
def argmax_id(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("vec_id", F.col("top1_token_id").cast("long").alias("top1_token_id"))


@query
def reference_surprisal(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("vec_id", *(r6(c).alias(c) for c in ("reference_logprob", "reference_probability", "reference_surprisal")))


@query
def reference_rank(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d).select("vec_id", F.col("reference_rank").cast("long").alias("reference_rank"), "reference_in_top")


@query
def valid_vocab_entropy(spark: SparkSession, d: str) -> DataFrame:
    return _measured(spark, d, vocab=48).select("vec_id", r6("entropy").alias("entropy_valid_vocab"), r6("entropy_top").alias("entropy_top20"))


@query
def next_token_shift(spark: SparkSession, d: str) -> DataFrame:
    """A token is scored by the vector of the position before it."""
    before = F.lag("logits").over(Window.partitionBy("reference_token_id").orderBy("vec_id"))
    rows = _logits(spark, d).withColumn("logits", before).where("logits IS NOT NULL")
    return D.measure(rows).select("vec_id", r6("reference_surprisal").alias("reference_surprisal"))


@query
def topk_ids(spark: SparkSession, d: str) -> DataFrame:
    top = _logits(spark, d).select("vec_id", F.posexplode(D.top_k(D.log_softmax(F.col("logits")), 5)).alias("r", "t"))
    return top.select("vec_id", (F.col("r") + 1).cast("long").alias("rank"), F.col("t.token_id").cast("long").alias("token_id"), r6("t.probability").alias("probability"))


@query
def topk_json_pack(spark: SparkSession, d: str) -> DataFrame:
    """The top entries as JSON text, read back."""
    packed = _logits(spark, d).select("vec_id", D.pack_top(D.top_k(D.log_softmax(F.col("logits")), 3)).alias("top_json"))
    top = packed.select("vec_id", F.posexplode(F.from_json("top_json", "array<struct<token_id:long,probability:double,logprob:double>>")).alias("r", "t"))
    return top.select("vec_id", (F.col("r") + 1).cast("long").alias("rank"), "t.token_id", r6("t.probability").alias("probability"), r6("t.logprob").alias("logprob"))


@query
def bounds_checks(spark: SparkSession, d: str) -> DataFrame:
    """Vector widths and reference ids against a vocabulary of 64."""
    rows = _logits(spark, d)
    return Q.expectations(rows, {"vectors": (F.count(F.lit(1)), 500), "too_narrow": (F.count(F.when(F.size("logits") < 64, 1)), 0), "reference_out_of_range": (F.count(F.when(F.col("reference_token_id") >= 9, 1)), 0)})


@query
def measure_wide(spark: SparkSession, d: str) -> DataFrame:
    """The Arrow form for wide vocabularies; same oracle as the expression form."""
    out = D.measure_wide(_logits(spark, d))
    return out.select("vec_id", *(r6(c).alias(c) for c in ("entropy", "entropy_top", "p1", "reference_surprisal")), F.col("reference_rank").cast("long").alias("reference_rank"))


# --- trajectories ----------------------------------------------------------------------------


@query
def trajectory_summary(spark: SparkSession, d: str) -> DataFrame:
    out = S.trajectories(S.drop_first(_tokens(spark, d)), ["user_id"], ["reference_position"])
    return out.select("user_id", *(F.col(c) if t != "double" else r6(c).alias(c) for c, t in out.dtypes if c != "user_id"))


@query
def longest_run(spark: SparkSession, d: str) -> DataFrame:
    run = S.run_length(F.col("value") >= 50, ["user_id"], ["ts", "event_id"])
    return load(spark, d, "events").withColumn("run", run).groupBy("user_id").agg(F.max("run").cast("long").alias("longest_run"))


@query
def mean_abs_change(spark: SparkSession, d: str) -> DataFrame:
    change = S.step_change(F.col("value"), ["user_id"], ["ts", "event_id"])
    return load(spark, d, "events").withColumn("change", change).groupBy("user_id").agg(r6(F.coalesce(F.avg("change"), F.lit(0.0))).alias("mean_abs_change"))


@query
def normalized_position(spark: SparkSession, d: str) -> DataFrame:
    out = S.with_position(load(spark, d, "conversations"), ["conv_id"], ["turn"], "position")
    return out.select("conv_id", "turn", F.col("position").cast("long").alias("position"), r6("normalized_position").alias("normalized_position"))


@query
def step_balanced_mean(spark: SparkSession, d: str) -> DataFrame:
    out = S.step_balanced(load(spark, d, "events"), ["user_id"], "value", "event_type", None)
    return out.select("user_id", r6("step_balanced_mean").alias("step_balanced_mean"))


@query
def threshold_fractions(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "events").groupBy("event_type").agg(r6(S.share(F.col("value") >= 50)).alias("share_ge_50"), r6(S.share(F.col("value") >= 100)).alias("share_ge_100"))


@query
def moving_rate(spark: SparkSession, d: str) -> DataFrame:
    """Days of each event type as ordered batches."""
    days = load(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("tokens"), F.sum("value").alias("seconds"))
    out = S.moving_rate(days, ["event_type"], ["day"], F.col("tokens"), F.col("seconds"))
    return out.select("event_type", F.col("day").cast("string").alias("day"), "tokens", "done_tokens", "remaining_tokens", *(r6(c).alias(c) for c in ("rate", "average_rate", "eta_seconds")))


# --- texts and spans -------------------------------------------------------------------------


@query
def token_offsets(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


@query
def token_class(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(X.is_whitespace(F.col("piece")), "whitespace").when(X.is_punctuation(F.col("piece")), "punctuation").otherwise("other")
    return _pieces(spark, d).groupBy("item_id", kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query
def span_mapping(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).select("item_id", "pos", "semantic_mapping_status", "semantic_step_id")


@query
def span_mapping_join(spark: SparkSession, d: str) -> DataFrame:
    """The join form, on a span table."""
    n = F.length("text")
    spans = load(spark, d, "benchmark").select("item_id", n.alias("_n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 40).cast("int"))).alias("k"))
    spans = spans.select("item_id", F.concat(F.lit("S"), F.col("k").cast("string")).alias("semantic_step_id"), (F.col("k") * 40).cast("long").alias("start_char"), F.least(F.col("k") * 40 + 36, F.col("_n")).cast("long").alias("end_char"))
    return P.map_by_join(_pieces(spark, d), spans, ["item_id"], ["pos"])


@query
def mapping_fractions(spark: SparkSession, d: str) -> DataFrame:
    out = S.mapping_fractions(_mapped(spark, d), ["item_id"])
    return out.select("item_id", "n_tokens", "n_eligible", *(r6(c).alias(c) for c in out.columns if c.endswith("_fraction")))


@query
def mapping_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _mapped(spark, d).groupBy("semantic_mapping_status").agg(F.count(F.lit(1)).alias("n"))


@query
def coverage_gates(spark: SparkSession, d: str) -> DataFrame:
    rows = _mapped(spark, d).withColumn("parity", F.pmod(F.col("item_id"), F.lit(2)))
    out = S.coverage(rows, ["item_id"], ["parity"])
    return out.select("parity", "all_analyzed", "eligible", "mapped", *(r6(c).alias(c) for c in out.columns if c.endswith("_fraction")), "passes_pooled_gate", "passes_mean_gate")


@query
def span_validation(spark: SparkSession, d: str) -> DataFrame:
    """Spans of 40 characters; each seventh reaches 10 into the next, each eleventh is empty, each fifth repeats its step."""
    n = F.length("text")
    k = F.col("k")
    spans = load(spark, d, "benchmark").select("item_id", n.alias("length"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 40).cast("int"))).alias("k"))
    start = (k * 40).cast("long")
    end = F.when(k % 11 == 10, start).otherwise(start + 40 + F.when(k % 7 == 3, 10).otherwise(0)).cast("long")
    spans = spans.select("item_id", "length", F.concat(F.lit("S"), F.when(k % 5 == 4, k - 1).otherwise(k).cast("string")).alias("semantic_step_id"), start.alias("start_char"), end.alias("end_char"))
    return P.span_errors(spans, ["item_id"], "length")


@query
def offset_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Where the reference starts among the pieces of text, for prompts of 50 characters."""
    offsets = _pieces(spark, d).groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_char").alias("start"), F.col("end_char").alias("end")))).alias("offsets"))
    out = P.align(offsets.withColumn("base_length", F.lit(50)), "offsets", "base_length")
    return out.select("item_id", F.col("reference_start").cast("long").alias("reference_start"), "boundary_crossed", "align_error")


@query
def prompt_build(spark: SparkSession, d: str) -> DataFrame:
    text = X.prompt(F.col("text"))
    return load(spark, d, "conversations").where("role = 'user'").select(X.trajectory_id(F.col("conv_id").cast("string"), F.lit("user"), F.concat(F.lit("v"), F.col("turn").cast("string"))).alias("trajectory_id"), F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("sha256"))


@query
def pattern_scan(spark: SparkSession, d: str) -> DataFrame:
    return Q.pattern_hits(load(spark, d, "documents"), ["doc_id"], "text", {"email": r"[A-Za-z0-9.]+@[A-Za-z0-9.]+", "licence": r"(?i)licen[cs]ed? under", "long_number": r"[0-9]{6,}"})


@query
def substring_audit(spark: SparkSession, d: str) -> DataFrame:
    required = ["the", "and", "licensed under"]
    return load(spark, d, "documents").select("doc_id", F.size(X.missing_strings(F.col("text"), required)).cast("long").alias("n_missing"), (~F.col("text").contains("GNU")).alias("forbidden_absent"))


@query
def slug_sanitise(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "part").select("p_partkey", X.slug(F.concat_ws("/", "p_name", "p_type")).alias("slug"))


@query
def duration_format(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "orders").select("o_orderkey", X.duration(F.floor(F.col("o_totalprice") / 10)).alias("duration"))


@query
def dtype_names(spark: SparkSession, d: str) -> DataFrame:
    alias = F.element_at(F.array(*(F.lit(x) for x in ("BF16", "fp16", "Float32", "int8"))), (F.col("n_nationkey") % 4 + 1).cast("int"))
    return load(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), X.dtype_name(alias).alias("dtype"))


@query
def number_format(spark: SparkSession, d: str) -> DataFrame:
    return _means(spark, d).select("task_id", "condition", X.four_places(F.round("quantity", 4)).alias("quantity_text"))


@query
def audit_projection(spark: SparkSession, d: str) -> DataFrame:
    """Record projection with derived counts and constants."""
    n = F.length("text")
    return load(spark, d, "benchmark").select("item_id", n.cast("long").alias("n_chars"), F.ceil(n / 40).cast("long").alias("n_spans"), F.lit(0).cast("long").alias("special_token_events"), F.lit("pending_human_review").alias("validation_flags"))


# --- gates, sets, resume ---------------------------------------------------------------------


@query
def resume_remaining(spark: SparkSession, d: str) -> DataFrame:
    done = load(spark, d, "lineitem").where("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return R.remaining(load(spark, d, "orders").select("o_orderkey", "o_custkey"), done, ["o_orderkey"])


@query
def resume_repair(spark: SparkSession, d: str) -> DataFrame:
    done = load(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.repaired(load(spark, d, "lineitem"), done, ["l_orderkey"]).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), r6(F.sum("l_quantity")).alias("quantity"))


@query
def completed_keys(spark: SparkSession, d: str) -> DataFrame:
    return R.completed(load(spark, d, "lineitem"), "l_orderkey")


@query
def frozen_order(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "supplier").select("s_suppkey", "s_name")
    order = rows.select("s_suppkey", F.pmod(F.col("s_suppkey") * 7919, F.lit(104729)).alias("ord"))
    return R.in_frozen_order(rows, order, "s_suppkey")


@query
def manifest_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are not in English as files, labelled documents as the manifest; low quality has a wrong size, toxic ones a wrong hash."""
    path, digest = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.sha2(F.col("text").cast("binary"), 256)
    docs = load(spark, d, "documents")
    actual = docs.where(~F.col("lang").eqNullSafe(F.lit("en"))).select(path, F.octet_length("text").cast("long").alias("size_bytes"), digest.alias("sha256"))
    size = F.when(F.col("quality") == 0, F.lit(-1).cast("long")).otherwise(F.octet_length("text").cast("long"))
    expected = docs.join(load(spark, d, "labels"), "doc_id").select(path, size.alias("size_bytes"), F.when(F.col("toxic") == 1, F.lit("x")).otherwise(digest).alias("sha256"))
    return Q.reconcile(expected, actual).select("path", "status")


@query
def set_gates(spark: SparkSession, d: str) -> DataFrame:
    customers, buyers = load(spark, d, "customer").select(F.col("c_custkey").alias("id")), load(spark, d, "orders").select(F.col("o_custkey").alias("id"))
    sides = Q.same_keys(customers, buyers, ["id"]).select("id", "side")
    both = customers.intersect(buyers).withColumn("side", F.lit("both"))
    return sides.unionByName(both)


@query
def expectation_report(spark: SparkSession, d: str) -> DataFrame:
    return Q.expectations(load(spark, d, "lineitem"), {"flags": (F.count_distinct("l_returnflag"), 3), "no_negative": (F.count(F.when(F.col("l_quantity") < 0, 1)), 0), "all_small": (F.coalesce(F.bool_and(F.col("l_quantity") <= 10), F.lit(False)), True)})


@query
def number_audit(spark: SparkSession, d: str) -> DataFrame:
    found = _means(spark, d).groupBy("condition").agg(F.avg("quantity").alias("value"))
    wanted = _trajectories(spark, d).groupBy("condition").agg(F.round(F.avg("quantity"), 1).alias("value"))
    return Q.number_audit(wanted, found, ["condition"], tolerance=0.06).select("condition", r6("expected").alias("expected"), r6("actual").alias("actual"), "passed")


@query
def content_sha256(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "documents").select("doc_id", Q.content_sha256(F.col("text")).alias("sha256"), F.octet_length("text").cast("long").alias("size_bytes"))


@query
def registry_lookup(spark: SparkSession, d: str) -> DataFrame:
    registry = load(spark, d, "region").select(F.col("r_name").alias("model_id"), (F.col("r_regionkey") / 10).alias("c4_equivalence_margin"))
    models = load(spark, d, "nation").join(load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", F.col("r_name").alias("model"))
    return V.margins(models, registry, "model").select("n_name", "model", r6("margin").alias("margin"))


@query
def sort_by_enum(spark: SparkSession, d: str) -> DataFrame:
    """Order by an explicit enumeration, then by key."""
    order = F.array(*(F.lit(x) for x in ("R", "A", "N")))
    rows = _means(spark, d).select("condition", "task_id", F.array_position(order, F.col("condition")).cast("long").alias("place"))
    return rows.orderBy("place", "task_id")


@query
def seeded_order(spark: SparkSession, d: str) -> DataFrame:
    """The frozen shuffle of a run's ids."""
    return R.frozen_permutation(load(spark, d, "supplier"), "s_suppkey", I.SEED)


@query
def nested_span_sort(spark: SparkSession, d: str) -> DataFrame:
    """Spans of a text as an array, last replacement first."""
    ordered = F.sort_array(F.collect_list(F.struct("start_char", "end_char")), asc=False)
    out = _pieces(spark, d).groupBy("item_id").agg(ordered.alias("_s"))
    return out.select("item_id", F.array_join(F.transform("_s", lambda s: F.concat_ws(":", s["start_char"].cast("string"), s["end_char"].cast("string"))), ",").alias("replacements"))


@query
def rolled_levels(spark: SparkSession, d: str) -> DataFrame:
    """The whole hierarchy task, family, condition in one pass."""
    return _means(spark, d).rollup("condition", "family").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("price")).alias("mean_price"))




# --- programs --------------------------------------------------------------------------------

#: Small programs that together show every supported statement and most expressions.
CORPUS = (
    ("sum_positive", "sums", "def sum_positive(values):\n    total = 0\n    for value in values:\n        if value > 0:\n            total += value\n    return total\n"),
    ("scan_max", "scans", "def scan_max(values):\n    best = None\n    i = 0\n    while i < len(values) and not False:\n        if best is None or values[i] >= best:\n            best = values[i]\n        i += 1\n    else:\n        pass\n    return best\n"),
    ("count_words", "text", "def count_words(text):\n    counts = {}\n    for word in text.split():\n        counts[word] = counts.get(word, 0) + 1\n    return (len(counts), counts)\n"),
    ("clamp_values", "lists", "def clamp_values(values, low, high):\n    out: list = []\n    for value in values:\n        if value < low:\n            out.append(low)\n            continue\n        elif value > high:\n            out.append(high)\n        else:\n            out.append(value if value != -1 else +value)\n    return out[0:len(out):1]\n"),
    ("contains_target", "search", "def contains_target(values, target):\n    found = False\n    for i, value in enumerate(values):\n        if value == target:\n            found = True\n            break\n    else:\n        found = target in ('é', 'x',) or not values\n    return found\n"),
)


def _programs(spark: SparkSession) -> DataFrame:
    tasks = spark.createDataFrame([(name, family, f"Write {name}.", [f"{name} in words"], [source]) for name, family, source in CORPUS], "id string, family string, task string, nl array<string>, python array<string>")
    # a handful of rows: one task, because each task has Python workers of its own, for no rows too
    return frames.build(tasks.coalesce(1))


@query
def render_programs(spark: SparkSession, d: str) -> DataFrame:
    return frames.render_programs(_programs(spark)).select("trajectory_id", "condition", "reference_text", F.size("semantic_step_spans").alias("n_steps"), F.size("trace_spans").alias("n_nodes"))


@query
def rename_programs(spark: SparkSession, d: str) -> DataFrame:
    return frames.rename_programs(_programs(spark), "program_id", "source_python").select("program_id", "source", F.array_join("canonical_globals", ",").alias("globals"))


@query
def construct_histogram(spark: SparkSession, d: str) -> DataFrame:
    return frames.construct_histogram(_programs(spark))


# --- studies ---------------------------------------------------------------------------------


@query
def cross_model_table(spark: SparkSession, d: str) -> DataFrame:
    """One row per segment with its two-condition statistics, the criteria, and how many segments pass all."""
    orders = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = orders.select(F.col("c_mktsegment").alias("model"), F.col("c_nationkey").cast("long").alias("task_id"), F.col("o_orderpriority").alias("condition"), F.col("o_totalprice").alias("price"))
    table = C.wide(C.condition_means(rows, ["model", "task_id", "condition"], ["price"]), ["model", "task_id"], "condition", ("1-URGENT", "5-LOW"), ["price"])
    deltas = C.deltas_wide(table, ["price"], "1-URGENT", "5-LOW")
    stats = I.describe(deltas, ["model"], "delta_price").withColumn("p", I.exact_sign_p(F.col("positive"), F.col("n"), F.lit(False)))
    rules = V.four_criteria(F.col("p"), F.col("mean") - F.col("sd"), F.col("positive"), F.col("positive"), 0.9, 5, 5)
    out = stats.withColumns(rules)
    # one row per model
    passes = F.count(F.when(F.col("all_four_pass"), 1)).over(Window.partitionBy(F.lit(1)))
    return out.select("model", "n", r6("mean").alias("mean"), r6("cohens_dz").alias("cohens_dz"), "positive", *rules, passes.alias("models_passing"))


@query
def pre_analysis_gates(spark: SparkSession, d: str) -> DataFrame:
    """The gates of trajectory rows: count, identity, validity, cell sizes, coverage."""
    rows = load(spark, d, "events").select(F.col("event_id").cast("string").alias("trajectory_id"), F.col("user_id").alias("task_id"), F.col("event_type").alias("condition"), (F.col("value") > 0).alias("trajectory_valid"), (F.col("value") / 500).alias("step_mapped_token_fraction"))
    kinds = ("click", "view", "purchase")
    return Q.trajectory_gates(rows, 10_000, 500, 3, kinds, 0.05)
