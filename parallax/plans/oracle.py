"""SQL twins of `parallax.plans.queries`, for an independent SQL engine on the same tables."""

from __future__ import annotations

from parallax.plans.queries import DRAWS, METRICS, PAIRS

_VALUES = ", ".join(str(p) for p in PAIRS)
#: trajectories t, unit means m, contrast definitions def, paired deltas dl
_T = "t AS (SELECT l_suppkey AS task_id, s_nationkey::BIGINT AS family, l_returnflag AS condition, l_extendedprice * (1 - l_discount) AS price, l_quantity AS quantity, l_discount AS discount FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"
_M = _T + ", m AS (SELECT task_id, family, condition, avg(price) AS price, avg(quantity) AS quantity, avg(discount) AS discount FROM t GROUP BY ALL)"
_DL = (
    _M
    + f", def(contrast, left_condition, right_condition, alternative) AS (VALUES {_VALUES}), dl AS (SELECT contrast, left_condition, right_condition, alternative, l.task_id, l.family, "
    + ", ".join(f"l.{m} - r.{m} AS delta_{m}" for m in METRICS)
    + " FROM def JOIN m l ON l.condition = left_condition JOIN m r ON r.condition = right_condition AND r.task_id = l.task_id AND r.family = l.family)"
)


def _r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


def _tail(low: str, high: str, n: str = "n") -> str:
    return f"list_sum([CASE WHEN k BETWEEN {low} AND {high} THEN exp(lgamma({n} + 1) - lgamma(k + 1) - lgamma({n} - k + 1) - {n} * ln(2.0)) ELSE 0.0 END FOR k IN range(0, {n} + 1)])"


_STATS = "count(*) AS n, avg({x}) AS mean, median({x}) AS median, stddev_samp({x}) AS sd, count(*) FILTER ({x} > 0) AS positive, count(*) FILTER ({x} < 0) AS negative, count(*) FILTER ({x} = 0) AS zero"
_P = f"CASE WHEN alternative = 'two_sided' THEN least(1.0, 2 * {_tail('0', 'least(positive, n - positive)')}) ELSE {_tail('positive', 'n')} END"
#: described contrasts ds, decided contrasts dc
_DS = (
    _DL
    + f", d0 AS (SELECT contrast, alternative, {_STATS.format(x='delta_price')}, avg(delta_quantity) AS valid_vocab_mean_delta, avg(delta_discount) AS semantic_step_mean_delta FROM dl GROUP BY ALL), "
    + f"d1 AS (SELECT *, {_P} AS p, mean - 2.576 * sd / sqrt(n) AS ci_low, mean + 2.576 * sd / sqrt(n) AS ci_high, 400.0::DOUBLE AS margin FROM d0), "
    + "d2 AS (SELECT *, least(1.0, (count(*) OVER () - row_number() OVER (ORDER BY p, contrast) + 1) * p) AS scaled FROM d1), "
    + "d3 AS (SELECT *, max(scaled) OVER (ORDER BY p, contrast ROWS UNBOUNDED PRECEDING) AS holm_adjusted_p FROM d2), "
    + "f0 AS (SELECT contrast, family, avg(delta_price) AS x FROM dl GROUP BY ALL), f1 AS (SELECT contrast, count(*) FILTER (x > 0) AS family_positive, count(*) FILTER (x < 0) AS family_negative FROM f0 GROUP BY ALL), "
    + "ds AS (SELECT * FROM d3 JOIN f1 USING (contrast))"
)


def _decide(source: str, alpha: float, tasks: int, families: int) -> str:
    """The decision rules over a relation of described contrasts."""
    return f"""e0 AS (SELECT *, coalesce(holm_adjusted_p < {alpha} AND (ci_low > 0 OR ci_high < 0), false) AS significant, coalesce(ci_low > -margin AND ci_high < margin, false) AS same,
                CASE WHEN mean > 0 THEN positive ELSE negative END AS signs, CASE WHEN mean > 0 THEN family_positive ELSE family_negative END AS family_signs,
                coalesce(mean > 0 AND holm_adjusted_p < {alpha} AND ci_low > 0 AND positive >= {tasks} AND family_positive >= {families}, false) AS directional,
                coalesce(valid_vocab_mean_delta > 0 AND semantic_step_mean_delta > 0, false) AS agree_up,
                coalesce(sign(valid_vocab_mean_delta) = sign(mean) AND sign(semantic_step_mean_delta) = sign(mean), false) AS agree FROM {source}),
         e1 AS (SELECT *, significant AND coalesce(signs >= {tasks} AND family_signs >= {families}, false) AS nonzero FROM e0),
         dc AS (SELECT *, CASE WHEN n = 0 OR holm_adjusted_p IS NULL OR ci_low IS NULL THEN 'NOT EVALUABLE'
                WHEN alternative = 'two_sided' THEN CASE WHEN nonzero THEN CASE WHEN agree THEN 'ROBUST' ELSE 'METRIC-SENSITIVE' END WHEN same THEN 'ROBUST' ELSE 'NOT SUPPORTED' END
                WHEN directional THEN CASE WHEN agree_up THEN 'ROBUST' ELSE 'METRIC-SENSITIVE' END ELSE 'NOT SUPPORTED' END AS result_status,
                CASE WHEN significant AND same THEN 'statistically_detectable_but_practically_small' WHEN significant THEN 'statistically_different_potentially_meaningful'
                WHEN same THEN 'evidence_for_practical_equivalence' ELSE 'inconclusive' END AS interpretation FROM e1)"""


_DC = _DS + ", " + _decide("ds", 0.9, 30, 5)


def _vectors(width: int = 64, source: str = "embeddings", k: int = 20) -> str:
    """Exploded vectors lp (vec_id, label, i, z, lp, r) and per-vector statistics st."""
    return f"""z AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS z, generate_subscripts(embedding, 1) - 1 AS i FROM {source}), z1 AS (SELECT * FROM z WHERE i < {width}),
        mx AS (SELECT vec_id, max(z) AS m FROM z1 GROUP BY ALL), sm AS (SELECT vec_id, m + ln(sum(exp(z - m))) AS lse FROM z1 JOIN mx USING (vec_id) GROUP BY vec_id, m),
        lp AS (SELECT vec_id, label, i, z, z - lse AS lp, row_number() OVER (PARTITION BY vec_id ORDER BY z DESC, i) AS r FROM z1 JOIN sm USING (vec_id)),
        tm AS (SELECT vec_id, sum(exp(lp)) AS top_mass FROM lp WHERE r <= {k} GROUP BY ALL), te AS (SELECT vec_id, -sum(exp(lp) / top_mass * ln(exp(lp) / top_mass)) AS entropy_top FROM lp JOIN tm USING (vec_id) WHERE r <= {k} GROUP BY ALL),
        rf AS (SELECT a.vec_id, a.lp AS reference_logprob, (SELECT count(*) FROM lp b WHERE b.vec_id = a.vec_id AND b.z > a.z) + 1 AS reference_rank FROM lp a WHERE a.i = a.label),
        st AS (SELECT vec_id, -sum(exp(lp) * lp) AS entropy, max(exp(lp)) FILTER (r = 1) AS p1, max(exp(lp)) FILTER (r = 2) AS p2, max(i) FILTER (r = 1) AS top1_token_id FROM lp GROUP BY ALL),
        v AS (SELECT *, p1 - p2 AS p1_minus_p2, greatest(0.0, 1 - top_mass) AS tail_mass, exp(reference_logprob) AS reference_probability, -reference_logprob AS reference_surprisal, reference_rank <= {k} AS reference_in_top
              FROM st JOIN tm USING (vec_id) JOIN te USING (vec_id) LEFT JOIN rf USING (vec_id))"""


_PIECES = r"""pc0 AS (SELECT item_id, regexp_extract_all(text, '\s+|[A-Za-z0-9_]+|[^\sA-Za-z0-9_]') AS p FROM benchmark), pc1 AS (SELECT item_id, unnest(p) AS piece, generate_subscripts(p, 1) AS pos FROM pc0),
    pc AS (SELECT item_id, pos, piece, sum(length(piece)) OVER w - length(piece) AS start_char, sum(length(piece)) OVER w AS end_char FROM pc1 WINDOW w AS (PARTITION BY item_id ORDER BY pos ROWS UNBOUNDED PRECEDING))"""
_KIND = r"CASE WHEN regexp_full_match(piece, '\s+') THEN 'whitespace' WHEN regexp_full_match(piece, '[\p{P}\p{S}\s]+') THEN 'punctuation' ELSE 'other' END"
_SPANS = "sp AS (SELECT item_id, length(text) AS len, unnest(range(0, (length(text) - 1) // 40 + 1)) AS k FROM benchmark), s40 AS (SELECT item_id, 'S' || k AS step, k * 40 AS a, least(k * 40 + 36, len) AS b FROM sp)"
_BY_SPAN = (
    _PIECES + ", " + _SPANS + ", hit AS (SELECT pc.item_id, pos, piece, start_char, end_char, count(a) AS touched, count(*) FILTER (start_char >= a AND end_char <= b) AS inside, max(step) FILTER (start_char >= a AND end_char <= b) AS step "
    "FROM pc LEFT JOIN s40 ON s40.item_id = pc.item_id AND end_char > a AND start_char < b GROUP BY ALL), raw AS (SELECT *, CASE WHEN inside = 1 THEN 'mapped' WHEN touched > 0 THEN 'boundary_overlap' ELSE 'unmapped' END AS st FROM hit), "
    f"mp AS (SELECT item_id, pos, CASE WHEN pos = 1 THEN 'excluded_first_token' WHEN {_KIND} = 'whitespace' THEN 'whitespace_only' WHEN {_KIND} = 'punctuation' THEN 'punctuation_only' ELSE st END AS semantic_mapping_status, step FROM raw)"
)
_ELIGIBLE = "semantic_mapping_status IN ('mapped', 'boundary_overlap', 'unmapped')"
_EV = "ev AS (SELECT user_id, value, value * 2 AS full_value, value / 500 AS p1, row_number() OVER w AS pos, ts, event_id FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"


def _run(flag: str, source: str, key: str, order: str) -> str:
    """Longest run of a flag per key."""
    return f"(SELECT {key}, coalesce(max(len), 0) AS longest FROM (SELECT {key}, CASE WHEN flag THEN count(*) ELSE 0 END AS len FROM (SELECT {key}, {flag} AS flag, row_number() OVER (PARTITION BY {key} ORDER BY {order}) - row_number() OVER (PARTITION BY {key}, {flag} ORDER BY {order}) AS island FROM {source}) GROUP BY {key}, flag, island) GROUP BY {key})"


_TRAJ = f"""WITH {_EV}, a AS (SELECT *, abs(value - lag(value) OVER w) AS c1, abs(full_value - lag(full_value) OVER w) AS c2 FROM ev WHERE pos > 1 WINDOW w AS (PARTITION BY user_id ORDER BY pos)),
    g AS (SELECT user_id, count(*) AS analysis_token_count, {", ".join(f"avg({c}) AS mean_entropy_{n}, median({c}) AS median_entropy_{n}, stddev_pop({c}) AS std_entropy_{n}, sum({c}) AS cumulative_entropy_{n}, coalesce(avg({k}), 0.0) AS mean_abs_entropy_change_{n}" for n, c, k in (("top20", "value", "c1"), ("full", "full_value", "c2")))},
          avg(p1) AS mean_p1, median(p1) AS median_p1, avg((p1 >= 0.9)::INT) AS fraction_p1_ge_090, avg((p1 >= 0.99)::INT) AS fraction_p1_ge_099 FROM a GROUP BY ALL)
    SELECT user_id, analysis_token_count, {_r6(*(f"{m}_entropy{x}_{n}" for n in ("top20", "full") for m, x in (("mean", ""), ("median", ""), ("std", ""), ("cumulative", ""))), *(f"mean_abs_entropy_change_{n}" for n in ("top20", "full")), "mean_p1", "median_p1", "fraction_p1_ge_090", "fraction_p1_ge_099")},
           r9.longest AS longest_run_p1_ge_090, r99.longest AS longest_run_p1_ge_099, 0::BIGINT AS special_token_events, 0.0::DOUBLE AS special_token_fraction, true AS trajectory_valid
    FROM g JOIN {_run("p1 >= 0.9", "(SELECT * FROM ev WHERE pos > 1)", "user_id", "pos")} r9 USING (user_id) JOIN {_run("p1 >= 0.99", "(SELECT * FROM ev WHERE pos > 1)", "user_id", "pos")} r99 USING (user_id)"""

_MIX = "(({d}::BIGINT * 7919 + {u} * 104729 + ({d}::BIGINT * {u}) % 997 * 31 + ({d}::BIGINT * {d} + {u}) % 1009 * 613) % {m})"
_UNITS = "u AS (SELECT contrast, delta_price AS x, row_number() OVER (PARTITION BY contrast ORDER BY substr(md5(task_id::VARCHAR), 1, 3), task_id) - 1 AS unit_no, count(*) OVER (PARTITION BY contrast) AS n_units FROM dl)"
_SEGMENTS = f"""o AS (SELECT c_mktsegment AS model, c_nationkey::BIGINT AS task_id, o_orderpriority AS condition, avg(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
    def(contrast, l, r, alternative) AS (VALUES ('C1', '1-URGENT', '2-HIGH', 'positive'), ('C4', '1-URGENT', '5-LOW', 'two_sided')),
    dl AS (SELECT a.model, contrast, alternative, a.task_id, a.price - b.price AS x FROM def JOIN o a ON a.condition = l JOIN o b ON b.condition = r AND b.model = a.model AND b.task_id = a.task_id),
    d0 AS (SELECT model, contrast, alternative, {_STATS.format(x="x")} FROM dl GROUP BY ALL),
    d1 AS (SELECT *, {_P} AS p, mean - 2.576 * sd / sqrt(n) AS ci_low, mean + 2.576 * sd / sqrt(n) AS ci_high, 60000.0::DOUBLE AS margin, positive AS family_positive, negative AS family_negative, median AS valid_vocab_mean_delta, mean AS semantic_step_mean_delta FROM d0),
    d2 AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY model) - row_number() OVER (PARTITION BY model ORDER BY p, contrast) + 1) * p) AS scaled FROM d1),
    ds AS (SELECT *, max(scaled) OVER (PARTITION BY model ORDER BY p, contrast ROWS UNBOUNDED PRECEDING) AS holm_adjusted_p FROM d2)"""
_INT = "::BIGINT"

SQL: dict[str, str] = {
    # contrasts
    "paired_contrast_summary": f"WITH {_M}, w AS (SELECT task_id, max(price) FILTER (condition = 'A') - max(price) FILTER (condition = 'R') AS x FROM m GROUP BY task_id, family), s AS (SELECT {_STATS.format(x='x')} FROM w WHERE x IS NOT NULL), q AS (SELECT *, mean / nullif(sd, 0) AS cohens_dz, positive / n AS positive_fraction FROM s) SELECT n, {_r6('mean', 'median', 'sd', 'cohens_dz', 'positive_fraction')}, positive, negative, zero FROM q",
    "task_condition_means": f"WITH {_M} SELECT task_id, family, condition, {_r6(*METRICS)} FROM m",
    "task_delta_wide": f"WITH {_M}, w AS (SELECT task_id, family, {', '.join(f"max({x}) FILTER (condition = '{c}') AS {x}_{c}" for x in METRICS for c in 'ANR')} FROM m GROUP BY ALL), q AS (SELECT *, {', '.join(f'{x}_A - {x}_R AS delta_{x}' for x in METRICS)} FROM w) SELECT task_id, family, {_r6(*(f'{x}_{c}' for x in METRICS for c in 'ANR'), *(f'delta_{x}' for x in METRICS))} FROM q",
    "contrast_long": f"WITH {_DL} SELECT contrast, left_condition, right_condition, task_id, family, {_r6(*(f'delta_{x}' for x in METRICS))} FROM dl",
    "contrast_partners": f"WITH m AS (SELECT DISTINCT l_orderkey, l_returnflag AS condition FROM lineitem), def(contrast, l, r, alternative) AS (VALUES {_VALUES}), q AS (SELECT contrast, l_orderkey, count(*) AS sides FROM def JOIN m ON condition IN (l, r) GROUP BY ALL) SELECT contrast, count(*) FILTER (sides = 2) AS paired_units, count(*) FILTER (sides = 1) AS unpaired_units FROM q GROUP BY ALL",
    "family_delta_means": f"WITH {_DL}, q AS (SELECT contrast, family, {', '.join(f'avg(delta_{x}) AS delta_{x}' for x in METRICS)} FROM dl GROUP BY ALL) SELECT contrast, family, {_r6(*(f'delta_{x}' for x in METRICS))} FROM q",
    "family_spread": f"WITH {_DL}, f AS (SELECT contrast, family, avg(delta_price) AS x FROM dl GROUP BY ALL), q AS (SELECT contrast, min(x) AS min_family_delta, max(x) AS max_family_delta, avg(x) AS mean_family_delta, count(*) FILTER (x > 0) AS positive_families, count(*) AS total_families FROM f GROUP BY ALL) SELECT contrast, {_r6('min_family_delta', 'max_family_delta', 'mean_family_delta')}, positive_families, total_families FROM q",
    "condition_means": "SELECT event_type, round(avg(value), 6) + 0.0 AS mean_value FROM events GROUP BY ALL",
    "relative_reduction": f"WITH {_M}, w AS (SELECT task_id, {', '.join(f"max({x}) FILTER (condition = '{c}') AS {x}_{c}" for x in METRICS for c in 'AR')} FROM m GROUP BY task_id, family) SELECT {', '.join(f'round(1 - avg({x}_R) / nullif(avg({x}_A), 0), 6) + 0.0 AS reduction_{x}' for x in METRICS)} FROM w",
    "completeness_grid": "WITH g AS (SELECT p_partkey AS l_partkey, f.l_returnflag FROM part, (VALUES ('A'), ('N'), ('R')) f(l_returnflag)), c AS (SELECT l_partkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY ALL) SELECT l_partkey, l_returnflag, coalesce(n, 0) AS n, coalesce(n, 0) = 3 AS complete FROM g LEFT JOIN c USING (l_partkey, l_returnflag)",
    "distinct_counts": f"WITH {_T} SELECT condition, count(DISTINCT task_id) AS tasks, count(DISTINCT family) AS families, count(*) AS n, bool_and(quantity > 0) AS all_positive, bool_or(discount = 0) AS any_undiscounted FROM t GROUP BY ALL",
    "sum_over_models": "WITH c AS (SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL) SELECT o_orderstatus, o_orderpriority, sum(n)::BIGINT AS total, count(*) AS cells FROM c GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "nested_explode_specs": "WITH s AS (SELECT 'p' || p_partkey AS task_id, p_brand AS family, p_name AS task_text, unnest([{'r': 'nl', 'v': [p_name, p_brand, p_type]}, {'r': 'python', 'v': [p_type, p_brand, p_name]}]) AS s FROM part), e AS (SELECT task_id, family, task_text, s.r AS representation, unnest(s.v) AS reference, generate_subscripts(s.v, 1)::INT AS variant FROM s) SELECT task_id || '__' || representation || '__v' || variant AS trajectory_id, * FROM e",
    # inference and decisions
    "exact_sign_test": f"WITH {_DL}, s AS (SELECT contrast, {_STATS.format(x='delta_price')} FROM dl GROUP BY ALL) SELECT contrast, n, positive, round({_tail('positive', 'n')}, 6) + 0.0 AS p_one_sided, round(least(1.0, 2 * {_tail('0', 'least(positive, n - positive)')}), 6) + 0.0 AS p_two_sided FROM s",
    "holm_adjust": f"WITH {_DS} SELECT contrast, {_r6('p', 'holm_adjusted_p')} FROM ds",
    "equivalence_flags": f"WITH {_DS} SELECT contrast, {_r6('ci_low', 'ci_high')}, ci_low > -margin AND ci_high < margin AS equivalent FROM ds",
    "four_criteria": f"WITH {_DS}, q AS (SELECT contrast, p < 0.9 AS p_below_alpha, ci_low > 0 AS ci_above_zero, positive >= 30 AS enough_tasks, family_positive >= 5 AS enough_families FROM ds) SELECT *, p_below_alpha AND ci_above_zero AND enough_tasks AND enough_families AS all_four_pass FROM q",
    "directional_status": f"WITH {_DC} SELECT contrast, directional AS primary_pass, result_status FROM dc WHERE alternative = 'positive'",
    "c4_interpretation": f"WITH {_DC} SELECT contrast, significant AS difference_significant, same AS equivalent, nonzero AS primary_nonzero_pass, signs AS task_signs, family_signs, interpretation, result_status FROM dc WHERE alternative = 'two_sided'",
    "cross_model_verdict": f"""WITH {_SEGMENTS}, {_decide("ds", 0.99, 5, 5)}, x AS (SELECT contrast, alternative, count(*) AS n_models, bool_and(directional) AS pass, bool_and(result_status = 'ROBUST') AS robust, count(*) FILTER (significant) AS ns,
            count(DISTINCT mean > 0) FILTER (significant) AS directions, bool_and(nonzero) AS nz, bool_and(same) AS eq FROM dc GROUP BY ALL), y AS (SELECT *, n_models = 5 AND ns = n_models AND directions = 1 AND nz AND robust AS diff, n_models = 5 AND eq AS equ FROM x)
        SELECT contrast, n_models, CASE WHEN alternative <> 'two_sided' THEN n_models = 5 AND pass END AS fully_cross_model_replicated, CASE WHEN alternative <> 'two_sided' THEN n_models = 5 AND robust END AS fully_cross_model_robust,
               CASE WHEN alternative = 'two_sided' THEN diff END AS cross_model_nonzero_difference_replicated, CASE WHEN alternative = 'two_sided' THEN equ END AS cross_model_practical_equivalence, CASE WHEN alternative = 'two_sided' THEN NOT diff AND NOT equ END AS heterogeneous FROM y""",
    "signflip_hash": f"WITH {_DL}, {_UNITS}, f AS (SELECT contrast, draw, avg(CASE WHEN draw = 0 OR {_MIX.format(d='draw', u='unit_no', m=1024)} < 512 THEN x ELSE -x END) AS mean FROM u, range(0, {DRAWS + 1}) r(draw) GROUP BY ALL), g AS (SELECT contrast, max(mean) FILTER (draw = 0) AS observed_mean FROM f GROUP BY ALL), h AS (SELECT contrast, observed_mean, count(*) FILTER (draw > 0 AND mean >= observed_mean - 1e-9) AS extreme_resamples FROM f JOIN g USING (contrast) GROUP BY ALL) SELECT contrast, {_r6('observed_mean')}, extreme_resamples, {DRAWS}::BIGINT AS n_resamples, round((extreme_resamples + 1) / {DRAWS + 1}, 6) + 0.0 AS p_plus1 FROM h",
    "bootstrap_hash": f"WITH {_DL}, {_UNITS}, p AS (SELECT contrast, draw, {_MIX.format(d='draw', u='unit_no', m=1 << 20)} % n_units AS pick FROM u, range(1, {DRAWS + 1}) r(draw)), f AS (SELECT p.contrast, draw, avg(u.x) AS mean FROM p JOIN u ON u.contrast = p.contrast AND u.unit_no = pick GROUP BY ALL) SELECT contrast, round(quantile_cont(mean, 0.05), 6) + 0.0 AS ci_low, round(quantile_cont(mean, 0.95), 6) + 0.0 AS ci_high, count(*) AS n_resamples FROM f GROUP BY ALL",
    # distributions
    "logits_log_softmax": f"WITH {_vectors()} SELECT vec_id, i::BIGINT AS i, round(lp, 6) + 0.0 AS logprob, round(exp(lp), 6) + 0.0 AS probability FROM lp",
    "logits_entropy": f"WITH {_vectors()} SELECT vec_id, {_r6('entropy')} FROM v",
    "topk_renorm_entropy": f"WITH {_vectors()} SELECT vec_id, {_r6('entropy_top', 'top_mass', 'tail_mass')} FROM v",
    "p1_p2_gap": f"WITH {_vectors()} SELECT vec_id, {_r6('p1', 'p2', 'p1_minus_p2')} FROM v",
    "argmax_id": f"WITH {_vectors()} SELECT vec_id, top1_token_id::BIGINT AS top1_token_id FROM v",
    "reference_surprisal": f"WITH {_vectors()} SELECT vec_id, {_r6('reference_logprob', 'reference_probability', 'reference_surprisal')} FROM v",
    "reference_rank": f"WITH {_vectors()} SELECT vec_id, reference_rank, reference_in_top FROM v",
    "valid_vocab_entropy": f"WITH {_vectors(48)} SELECT vec_id, round(entropy, 6) + 0.0 AS entropy_valid_vocab, round(entropy_top, 6) + 0.0 AS entropy_top20 FROM v",
    "next_token_shift": f"WITH sh AS (SELECT vec_id, label, lag(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS embedding FROM embeddings), {_vectors(source='(SELECT * FROM sh WHERE embedding IS NOT NULL)')} SELECT vec_id, {_r6('reference_surprisal')} FROM v",
    "topk_ids": f"WITH {_vectors()} SELECT vec_id, r AS rank, i::BIGINT AS token_id, round(exp(lp), 6) + 0.0 AS probability FROM lp WHERE r <= 5",
    "topk_json_pack": f"WITH {_vectors()} SELECT vec_id, r AS rank, i::BIGINT AS token_id, round(exp(lp), 6) + 0.0 AS probability, round(lp, 6) + 0.0 AS logprob FROM lp WHERE r <= 3",
    "bounds_checks": "WITH c AS (SELECT count(*) AS n, count(*) FILTER (len(embedding) < 64) AS narrow, count(*) FILTER (label >= 9) AS out FROM embeddings) SELECT unnest(['vectors', 'too_narrow', 'reference_out_of_range']) AS \"check\", unnest(['500', '0', '0']) AS expected, unnest([n::VARCHAR, narrow::VARCHAR, out::VARCHAR]) AS actual, unnest([n = 500, narrow = 0, out = 0]) AS passed FROM c",
    "measure_wide": f"WITH {_vectors()} SELECT vec_id, {_r6('entropy', 'entropy_top', 'p1', 'reference_surprisal')}, reference_rank FROM v",
    # trajectories
    "trajectory_summary": _TRAJ,
    "longest_run": f"SELECT user_id, longest AS longest_run FROM {_run('value >= 50', 'events', 'user_id', 'ts, event_id')}",
    "mean_abs_change": "WITH c AS (SELECT user_id, abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS c FROM events) SELECT user_id, round(coalesce(avg(c), 0.0), 6) + 0.0 AS mean_abs_change FROM c GROUP BY ALL",
    "normalized_position": "WITH p AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS position, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations) SELECT conv_id, turn, position, round(CASE WHEN n > 1 THEN (position - 1) / (n - 1) ELSE 0.0 END, 6) + 0.0 AS normalized_position FROM p",
    "step_balanced_mean": "WITH s AS (SELECT user_id, event_type, avg(value) AS m FROM events GROUP BY ALL) SELECT user_id, round(avg(m), 6) + 0.0 AS step_balanced_mean FROM s GROUP BY ALL",
    "threshold_fractions": "SELECT event_type, round(avg((value >= 50)::INT), 6) + 0.0 AS share_ge_50, round(avg((value >= 100)::INT), 6) + 0.0 AS share_ge_100 FROM events GROUP BY ALL",
    "moving_rate": "WITH b AS (SELECT event_type, ts::DATE AS day, count(*) AS tokens, sum(value) AS seconds FROM events GROUP BY ALL), r AS (SELECT *, tokens / greatest(seconds, 1e-9) AS rate FROM b), w AS (SELECT *, avg(rate) OVER (PARTITION BY event_type ORDER BY day ROWS 9 PRECEDING) AS average_rate, (sum(tokens) OVER (PARTITION BY event_type ORDER BY day))::BIGINT AS done_tokens, (sum(tokens) OVER (PARTITION BY event_type) - sum(tokens) OVER (PARTITION BY event_type ORDER BY day))::BIGINT AS remaining_tokens FROM r), e AS (SELECT *, remaining_tokens / greatest(average_rate, 1e-9) AS eta_seconds FROM w) SELECT event_type, day::VARCHAR AS day, tokens, done_tokens, remaining_tokens, "
    + _r6("rate", "average_rate", "eta_seconds")
    + " FROM e",
    # texts and spans
    "token_offsets": f"WITH {_PIECES} SELECT item_id, pos{_INT} AS pos, piece, start_char{_INT} AS start_char, end_char{_INT} AS end_char FROM pc",
    "token_class": f"WITH {_PIECES} SELECT item_id, {_KIND} AS kind, count(*) AS n FROM pc GROUP BY ALL",
    "span_mapping": f"WITH {_BY_SPAN} SELECT item_id, pos{_INT} AS pos, semantic_mapping_status, CASE WHEN semantic_mapping_status = 'mapped' THEN step END AS semantic_step_id FROM mp",
    "span_mapping_join": f"WITH {_BY_SPAN} SELECT item_id, pos{_INT} AS pos, start_char{_INT} AS start_char, end_char{_INT} AS end_char, st AS semantic_mapping_status, CASE WHEN st = 'mapped' THEN step END AS semantic_step_id FROM raw",
    "mapping_fractions": f"WITH {_BY_SPAN}, q AS (SELECT item_id, count(*) AS n_tokens, count(*) FILTER ({_ELIGIBLE}) AS n_eligible, "
    + ", ".join(f"coalesce(count(*) FILTER (semantic_mapping_status = '{s}') / nullif(count(*) FILTER ({_ELIGIBLE}), 0), 0.0) AS {n}" for s, n in (("mapped", "step_mapped_token_fraction"), ("boundary_overlap", "boundary_overlap_token_fraction"), ("unmapped", "unmapped_token_fraction")))
    + f" FROM mp GROUP BY ALL) SELECT item_id, n_tokens, n_eligible, {_r6('step_mapped_token_fraction', 'boundary_overlap_token_fraction', 'unmapped_token_fraction')} FROM q",
    "mapping_histogram": f"WITH {_BY_SPAN} SELECT semantic_mapping_status, count(*) AS n FROM mp GROUP BY ALL",
    "coverage_gates": f"WITH {_BY_SPAN}, e AS (SELECT item_id % 2 AS parity, item_id, count(*) AS al, count(*) FILTER ({_ELIGIBLE}) AS el, count(*) FILTER (semantic_mapping_status = 'mapped') AS ma FROM mp GROUP BY ALL), q AS (SELECT parity, sum(al){_INT} AS all_analyzed, sum(el){_INT} AS eligible, sum(ma){_INT} AS mapped, sum(ma) / nullif(sum(el), 0) AS pooled_fraction, sum(ma) / sum(al) AS all_analyzed_fraction, min(ma / nullif(el, 0)) AS min_trajectory_fraction, avg(ma / nullif(el, 0)) AS mean_trajectory_fraction, count(*) FILTER (el = 0) AS none FROM e GROUP BY ALL) SELECT parity, all_analyzed, eligible, mapped, {_r6('pooled_fraction', 'all_analyzed_fraction', 'min_trajectory_fraction', 'mean_trajectory_fraction')}, pooled_fraction >= 0.9 AS passes_pooled_gate, mean_trajectory_fraction >= 0.9 AND none = 0 AS passes_mean_gate FROM q",
    "span_validation": "WITH sp AS (SELECT item_id, length(text) AS len, unnest(range(0, (length(text) - 1) // 40 + 1)) AS k FROM benchmark), s AS (SELECT item_id, len, 'S' || CASE WHEN k % 5 = 4 THEN k - 1 ELSE k END AS semantic_step_id, k * 40 AS start_char, CASE WHEN k % 11 = 10 THEN k * 40 ELSE k * 40 + 40 + CASE WHEN k % 7 = 3 THEN 10 ELSE 0 END END AS end_char FROM sp), w AS (SELECT *, max(end_char) OVER (PARTITION BY item_id ORDER BY start_char, end_char, semantic_step_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach, row_number() OVER (PARTITION BY item_id, semantic_step_id ORDER BY start_char, end_char) AS seen FROM s) SELECT item_id, semantic_step_id, start_char, end_char, 'invalid_range' AS error FROM w WHERE NOT (start_char >= 0 AND start_char < end_char AND end_char <= len) UNION ALL SELECT item_id, semantic_step_id, start_char, end_char, 'overlap' FROM w WHERE start_char < reach UNION ALL SELECT item_id, semantic_step_id, start_char, end_char, 'duplicate_step' FROM w WHERE seen > 1",
    "offset_alignment": f"WITH {_PIECES}, q AS (SELECT item_id, count(*) AS n, min(pos) FILTER (end_char > 50) - 1 AS reference_start FROM pc GROUP BY ALL) SELECT q.item_id, reference_start{_INT} AS reference_start, coalesce(pc.start_char < 50, false) AS boundary_crossed, CASE WHEN n < 2 THEN 'too_short' WHEN reference_start IS NULL THEN 'no_reference_token' WHEN reference_start = 0 THEN 'no_prompt_token' END AS align_error FROM q LEFT JOIN pc ON pc.item_id = q.item_id AND pc.pos = reference_start + 1",
    "prompt_build": "WITH p AS (SELECT conv_id || '__user__v' || turn AS trajectory_id, 'Task:' || chr(10) || text || chr(10) || chr(10) || 'Solution:' || chr(10) AS t FROM conversations WHERE role = 'user') SELECT trajectory_id, length(t) AS n_chars, sha256(t) AS sha256 FROM p",
    "pattern_scan": "SELECT doc_id, 'email' AS pattern FROM documents WHERE regexp_matches(text, '[A-Za-z0-9.]+@[A-Za-z0-9.]+') UNION ALL SELECT doc_id, 'licence' FROM documents WHERE regexp_matches(text, '(?i)licen[cs]ed? under') UNION ALL SELECT doc_id, 'long_number' FROM documents WHERE regexp_matches(text, '[0-9]{6,}')",
    "substring_audit": "SELECT doc_id, (NOT contains(text, 'the'))::BIGINT + (NOT contains(text, 'and'))::BIGINT + (NOT contains(text, 'licensed under'))::BIGINT AS n_missing, NOT contains(text, 'GNU') AS forbidden_absent FROM documents",
    "slug_sanitise": r"SELECT p_partkey, regexp_replace(p_name || '/' || p_type, '[^\p{L}\p{N}._-]', '_', 'g') AS slug FROM part",
    "duration_format": "WITH s AS (SELECT o_orderkey, floor(o_totalprice / 10)::BIGINT AS s FROM orders) SELECT o_orderkey, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || lpad((s % 3600 // 60)::VARCHAR, 2, '0') || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' WHEN s >= 60 THEN (s // 60) || 'm ' || lpad((s % 60)::VARCHAR, 2, '0') || 's' ELSE s || 's' END AS duration FROM s",
    "dtype_names": "SELECT n_nationkey::BIGINT AS n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'bfloat16' WHEN 1 THEN 'float16' WHEN 2 THEN 'float32' END AS dtype FROM nation",
    "number_format": f"WITH {_M} SELECT task_id, condition, printf('%.4f', round(quantity, 4)) AS quantity_text FROM m",
    "audit_projection": "SELECT item_id, length(text) AS n_chars, ceil(length(text) / 40)::BIGINT AS n_spans, 0::BIGINT AS special_token_events, 'pending_human_review' AS validation_flags FROM benchmark",
    # gates, sets, resume
    "resume_remaining": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)",
    "resume_repair": "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 6) + 0.0 AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY ALL",
    "completed_keys": "SELECT DISTINCT l_orderkey FROM lineitem",
    "frozen_order": "SELECT s_suppkey, s_name, (s_suppkey * 7919) % 104729 AS ord FROM supplier ORDER BY ord",
    "manifest_reconcile": "WITH a AS (SELECT 'doc/' || doc_id AS path, strlen(text) AS n, sha256(text) AS h FROM documents WHERE lang IS DISTINCT FROM 'en'), e AS (SELECT 'doc/' || doc_id AS path, CASE WHEN quality = 0 THEN -1 ELSE strlen(text) END AS n, CASE WHEN toxic = 1 THEN 'x' ELSE sha256(text) END AS h FROM documents JOIN labels USING (doc_id)) SELECT coalesce(a.path, e.path) AS path, CASE WHEN a.path IS NULL THEN 'missing' WHEN e.path IS NULL THEN 'unlisted' WHEN a.n <> e.n THEN 'size_mismatch' WHEN a.h <> e.h THEN 'hash_mismatch' ELSE 'ok' END AS status FROM a FULL JOIN e ON a.path = e.path",
    "set_gates": "WITH c AS (SELECT c_custkey AS id FROM customer), b AS (SELECT DISTINCT o_custkey AS id FROM orders) SELECT id, 'left' AS side FROM (SELECT id FROM c EXCEPT SELECT id FROM b) UNION ALL SELECT id, 'right' FROM (SELECT id FROM b EXCEPT SELECT id FROM c) UNION ALL SELECT id, 'both' FROM (SELECT id FROM c INTERSECT SELECT id FROM b)",
    "expectation_report": "WITH c AS (SELECT count(DISTINCT l_returnflag) AS f, count(*) FILTER (l_quantity < 0) AS g, bool_and(l_quantity <= 10) AS s FROM lineitem) SELECT unnest(['flags', 'no_negative', 'all_small']) AS \"check\", unnest(['3', '0', 'true']) AS expected, unnest([f::VARCHAR, g::VARCHAR, s::VARCHAR]) AS actual, unnest([f = 3, g = 0, s]) AS passed FROM c",
    "number_audit": f"WITH {_M}, a AS (SELECT condition, avg(quantity) AS actual FROM m GROUP BY ALL), e AS (SELECT condition, round(avg(quantity), 1) AS expected FROM t GROUP BY ALL) SELECT condition, {_r6('expected', 'actual')}, abs(expected - actual) <= 0.06 AS passed FROM e JOIN a USING (condition)",
    "content_sha256": "SELECT doc_id, sha256(text) AS sha256, strlen(text) AS size_bytes FROM documents",
    "registry_lookup": "SELECT n_name, r_name AS model, round(r_regionkey / 10, 6) + 0.0 AS margin FROM nation JOIN region ON n_regionkey = r_regionkey",
    "sort_by_enum": f"WITH {_M} SELECT condition, task_id, list_position(['R', 'A', 'N'], condition){_INT} AS place FROM m ORDER BY place, task_id",
    "nested_span_sort": f"WITH {_PIECES} SELECT item_id, string_agg(start_char::BIGINT || ':' || end_char::BIGINT, ',' ORDER BY start_char DESC, end_char DESC) AS replacements FROM pc GROUP BY ALL",
    "rolled_levels": f"WITH {_M} SELECT condition, family, count(*) AS n, round(avg(price), 6) + 0.0 AS mean_price FROM m GROUP BY ROLLUP (condition, family)",
    # studies
    "cross_model_table": f"""WITH o AS (SELECT c_mktsegment AS model, c_nationkey AS task_id, avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') - avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') AS x FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
        s AS (SELECT model, {_STATS.format(x="x")} FROM o WHERE x IS NOT NULL GROUP BY ALL), q AS (SELECT *, mean / nullif(sd, 0) AS cohens_dz, {_tail("positive", "n")} AS p FROM s),
        r AS (SELECT *, p < 0.9 AS p_below_alpha, coalesce(mean - sd > 0, false) AS ci_above_zero, positive >= 5 AS enough_tasks, positive >= 5 AS enough_families FROM q), t AS (SELECT *, p_below_alpha AND ci_above_zero AND enough_tasks AND enough_families AS all_four_pass FROM r)
        SELECT model, n, {_r6("mean", "cohens_dz")}, positive, p_below_alpha, ci_above_zero, enough_tasks, enough_families, all_four_pass, count(*) FILTER (all_four_pass) OVER () AS models_passing FROM t""",
    "pre_analysis_gates": """WITH c AS (SELECT count(*) AS n, count(DISTINCT event_id) AS ids, bool_and(value > 0) AS valid FROM events), g AS (SELECT count(*) AS cells, count(*) FILTER (n <> 3) AS other FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)),
        k(kind) AS (VALUES ('click'), ('view'), ('purchase')), v AS (SELECT kind, coalesce(avg(value / 500) >= 0.05, false) AS ok FROM k LEFT JOIN events ON event_type = kind GROUP BY ALL)
        SELECT 'trajectories' AS "check", '10000' AS expected, n::VARCHAR AS actual, n = 10000 AS passed FROM c UNION ALL SELECT 'distinct_ids', '10000', ids::VARCHAR, ids = 10000 FROM c UNION ALL SELECT 'all_valid', 'true', valid::VARCHAR, valid FROM c
        UNION ALL SELECT 'cells', '500', cells::VARCHAR, cells = 500 FROM g UNION ALL SELECT 'cells_of_other_size', '0', other::VARCHAR, other = 0 FROM g UNION ALL SELECT 'coverage_' || kind, 'true', ok::VARCHAR, ok FROM v""",
}
