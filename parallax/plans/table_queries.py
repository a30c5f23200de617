"""Queries for publication tables, gates, readers and writers, with their SQL twins."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from shutil import rmtree

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parallax import schemas
from parallax.operators import contrast as C
from parallax.operators import decide as V
from parallax.operators import gates as Q
from parallax.operators import infer as I
from parallax.operators import spans as P
from parallax.plans import oracle, publish
from parallax.plans.queries import load, query, r6
from parallax.sources import readers, writers

#: Pairs of order priorities that stand for contrasts, and the bound of the two-sided one.
PAIRS, MARGIN = (("C1", "1-URGENT", "2-HIGH", "positive"), ("C4", "1-URGENT", "5-LOW", "two_sided")), 60000.0


def place(spark: SparkSession) -> str:
    """A new folder in shared storage (spark.checkpoint.dir); only a local session without that setting gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a shared folder on a cluster")
        found = tempfile.mkdtemp(prefix="parallax-")
        atexit.register(rmtree, found, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
    return f"{found.rstrip('/')}/tables-{uuid.uuid4().hex}"


# --- publication tables ------------------------------------------------------------------------


def _models(spark: SparkSession, d: str) -> DataFrame:
    """Contrasts of each market segment, decided: segments stand for models, nations for tasks and regions for families."""
    orders = load(spark, d, "orders").join(load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = orders.select(F.col("c_mktsegment").alias("model_slug"), F.col("c_nationkey").cast("long").alias("task_id"), F.col("n_regionkey").cast("long").alias("family"), F.col("o_orderpriority").alias("condition"), F.col("o_totalprice").alias("h20"))
    means = C.condition_means(rows, ["model_slug", "task_id", "family", "condition"], ["h20"])
    deltas = C.contrasts(means, C.definitions(spark, PAIRS), ["model_slug", "task_id", "family"], "condition", ["h20"]).where("paired")
    keys = ["model_slug", "contrast"]
    stats = I.describe(deltas, [*keys, "left_condition", "right_condition", "alternative"], "delta_h20")
    families = I.describe(C.family_means(deltas, [*keys, "family"], ["delta_h20"]), keys, "delta_h20")
    stats = stats.join(families.select(*keys, F.col("positive").alias("family_positive"), F.col("negative").alias("family_negative"), F.col("n").alias("family_n"), F.col("mean").alias("family_mean")), keys)
    half = F.lit(2.576) * F.col("sd") / F.sqrt("n")
    stats = stats.withColumns({
        "p": I.exact_sign_p(F.col("positive"), F.col("n"), F.col("alternative") == "two_sided"), "ci_low": F.col("mean") - half, "ci_high": F.col("mean") + half, "margin": F.lit(MARGIN),
        "valid_vocab_mean_delta": F.col("median"), "semantic_step_mean_delta": F.col("mean"),
    })
    return V.decide(I.holm(stats, ["model_slug"], "p", "contrast"), alpha=0.99, tasks=5, families=2)


def _rounded(table: DataFrame) -> DataFrame:
    return table.select(*(r6(c).alias(c) if t == "double" else F.col(c) for c, t in table.dtypes))


def _replicated(spark: SparkSession, d: str) -> DataFrame:
    rows = _models(spark, d).where("contrast = 'C1'")
    return rows.withColumns({"positive_families": F.col("family_positive"), "total_families": F.col("family_n"), "mean_family_delta": F.col("family_mean"), "min_family_delta": F.col("ci_low"), "max_family_delta": F.col("ci_high")})


@query
def publication_replication(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(publish.replication_table(_replicated(spark, d)))


@query
def publication_interventions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(publish.intervention_table(_models(spark, d)))


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Line items of the suppliers of each region as trajectories, line numbers as conditions."""
    regions = load(spark, d, "nation").select(F.col("n_nationkey"), F.concat(F.lit("m"), F.col("n_regionkey").cast("string")).alias("model_slug"))
    suppliers = load(spark, d, "supplier").join(regions, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "model_slug")
    condition = F.element_at(F.array(*(F.lit(c) for c in schemas.CONDITIONS)), (F.col("l_linenumber") % 6 + 1).cast("int"))
    rows = load(spark, d, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("model_slug", condition.alias("condition"), F.col("l_quantity").alias("mean_entropy_top20"))
    return rows


@query
def publication_conditions(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(publish.condition_table(_points(spark, d)))


@query
def publication_profile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(publish.profile_rows(_points(spark, d)))


@query
def publication_families(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(publish.family_table(_replicated(spark, d), _models(spark, d)))


@query
def publication_forest(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(publish.forest_rows(_models(spark, d)))


@query
def publication_equivalence(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(publish.equivalence_rows(_models(spark, d)))


# --- gates -------------------------------------------------------------------------------------


@query
def corpus_gates(spark: SparkSession, d: str) -> DataFrame:
    """Parts as tasks of their brands; counts that hold and counts that do not."""
    tasks = load(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), F.col("p_brand").alias("family"), F.array("p_name", "p_brand", "p_type").alias("nl"), F.array("p_type", "p_type", "p_name").alias("python"))
    return Q.corpus_gates(tasks, 2000, 25, per_family=80)


@query
def canonical_json(spark: SparkSession, d: str) -> DataFrame:
    rows = load(spark, d, "nation")
    return rows.select("n_nationkey", Q.canonical_row(rows, ["n_regionkey", "n_name"]).alias("json"), Q.content_sha256(Q.canonical_row(rows, ["n_regionkey", "n_name"])).alias("sha256"))


@query
def config_changes(spark: SparkSession, d: str) -> DataFrame:
    """Nations as settings of a run, stored and as they are now: those that must not have changed."""
    stored = {r.n_name: r.n_regionkey for r in load(spark, d, "nation").orderBy("n_nationkey").limit(100).collect()}
    now = {name: value if value != 2 else None for name, value in stored.items()}
    return spark.createDataFrame([(k,) for k in Q.immutable(stored, now, sorted(stored))], "changed string")


# --- readers and writers -----------------------------------------------------------------------


@query
def csv_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Names with quotes and line breaks through a CSV file; three of the four columns are read back."""
    path = place(spark)
    rows = load(spark, d, "customer").select("c_custkey", F.concat(F.lit('"'), "c_name", F.lit('",\n'), "c_mktsegment").alias("name"), "c_acctbal", "c_nationkey")
    writers.write_csv(rows, path, ["c_custkey", "name", "c_acctbal", "c_nationkey"], ["c_custkey"])
    return readers.csv_table(spark, path, "c_custkey long, name string, c_acctbal double, c_nationkey int", ["c_custkey", "name", "c_acctbal"])


@query
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = place(spark)
    writers.json_rows(load(spark, d, "region")).write.text(path)
    return spark.read.schema("r_regionkey int, r_name string").json(path)


@query
def append_twice(spark: SparkSession, d: str) -> DataFrame:
    """Orders appended in two overlapping deliveries, the first one twice; every key is there once."""
    path, rows = place(spark), load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    first = rows.where("o_orderstatus <> 'O'")
    for delivery in (first, first, rows):
        writers.append_new(delivery, path, ["o_orderkey"], ["o_orderstatus"])
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderkey").alias("keys"), r6(F.sum("o_totalprice")).alias("price"))


@query
def store_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Texts written one to a file, listed with sizes and hashes, and read back whole."""
    from parallax.sources import manifest

    path = place(spark)
    load(spark, d, "region").select(F.col("r_name").alias("value"), F.col("r_regionkey").alias("k")).repartition("k").write.partitionBy("k").option("lineSep", "|").text(path)
    files = manifest.of_store(spark, path).where(F.col("size_bytes") > 0).select(F.regexp_extract("path", r"k=(\d+)/", 1).cast("int").alias("k"), "size_bytes", "sha256")
    texts = readers.text_files(spark, path, "*.txt").select(F.regexp_extract("path", r"k=(\d+)/", 1).cast("int").alias("k"), "value")
    return files.join(texts, "k")


@query
def scored_positions(spark: SparkSession, d: str) -> DataFrame:
    """A scorer plug-in over padded batches; its vectors hold the id before a position and the true length of the sequence."""
    lengths = F.transform(F.regexp_extract_all("text", F.lit(P.PIECES), F.lit(0)), lambda x: F.length(x))
    rows = load(spark, d, "benchmark").select("item_id", lengths.alias("token_ids"))

    def scorer(ids: np.ndarray, mask: np.ndarray) -> np.ndarray:
        return np.stack([ids, np.broadcast_to(mask.sum(axis=1, keepdims=True), ids.shape)], axis=2).astype(float)

    out = readers.scored(rows, scorer, pad=7, vocab=1000)
    return out.select("item_id", "position", "token_id", F.col("logits")[0].cast("int").alias("before"), F.col("logits")[1].cast("int").alias("length"))


@query
def synthetic_records(spark: SparkSession, d: str) -> DataFrame:
    return readers.synthetic_records(spark, [("t1", "f", "one"), ("t2", "f", "two")]).select("trajectory_id", "task_id", "condition", "reference_text")


@query
def tokenizer_plugin(spark: SparkSession, d: str) -> DataFrame:
    """Ids and offsets of a plug-in tokenizer, and whether a prompt's ids begin those of the whole text."""
    import re

    def tokenizer(texts: list[str]) -> list[list[tuple[int, int, int]]]:
        return [[(len(m[0]), m.start(), m.end()) for m in re.finditer(r"[A-Za-z]+|[^A-Za-z]", text)] for text in texts]

    rows = load(spark, d, "benchmark").select("item_id", "text", F.substring("text", 1, 50).alias("prompt"))
    whole = P.tokenize_with(rows.select("item_id", "text"), "text", tokenizer).select("item_id", "token_ids", "offsets")
    part = P.tokenize_with(rows.select("item_id", "prompt"), "prompt", tokenizer).select("item_id", F.col("token_ids").alias("prompt_ids"))
    out = whole.join(part, "item_id")
    return out.select("item_id", F.size("token_ids").cast("long").alias("n"), F.element_at("offsets", -1)["end"].cast("long").alias("n_chars"), P.prefix_aligned(F.col("token_ids"), F.col("prompt_ids")).alias("aligned"))


_SEG = f"""o AS (SELECT c_mktsegment AS model_slug, c_nationkey::BIGINT AS task_id, n_regionkey::BIGINT AS family, o_orderpriority AS condition, avg(o_totalprice) AS price FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
    def(contrast, l, r, alternative) AS (VALUES {", ".join(str(p) for p in PAIRS)}),
    dl AS (SELECT a.model_slug, contrast, l AS left_condition, r AS right_condition, alternative, a.task_id, a.family, a.price - b.price AS x FROM def JOIN o a ON a.condition = l JOIN o b ON b.condition = r AND b.model_slug = a.model_slug AND b.task_id = a.task_id),
    f0 AS (SELECT model_slug, contrast, family, avg(x) AS x FROM dl GROUP BY ALL), f1 AS (SELECT model_slug, contrast, count(*) FILTER (x > 0) AS family_positive, count(*) FILTER (x < 0) AS family_negative, count(*) AS family_n, avg(x) AS family_mean FROM f0 GROUP BY ALL),
    d0 AS (SELECT model_slug, contrast, left_condition, right_condition, alternative, {oracle._STATS.format(x="x")} FROM dl GROUP BY ALL),
    d1 AS (SELECT *, {oracle._P} AS p, mean - 2.576 * sd / sqrt(n) AS ci_low, mean + 2.576 * sd / sqrt(n) AS ci_high, {MARGIN}::DOUBLE AS margin, median AS valid_vocab_mean_delta, mean AS semantic_step_mean_delta FROM d0 JOIN f1 USING (model_slug, contrast)),
    d2 AS (SELECT *, least(1.0, (count(*) OVER (PARTITION BY model_slug) - row_number() OVER (PARTITION BY model_slug ORDER BY p, contrast) + 1) * p) AS scaled FROM d1),
    ds AS (SELECT *, max(scaled) OVER (PARTITION BY model_slug ORDER BY p, contrast ROWS UNBOUNDED PRECEDING) AS holm_adjusted_p FROM d2),
    {oracle._decide("ds", 0.99, 5, 2)}"""
_SIX = lambda **c: ", ".join(f"round({x}, 6) + 0.0 AS {n}" for n, x in c.items())

SQL = {
    "publication_replication": f"WITH {_SEG} SELECT model_slug, {_SIX(mean_delta_nl_minus_python='mean', ci99_low='ci_low', ci99_high='ci_high', cohens_dz='mean / nullif(sd, 0)')}, positive AS positive_tasks, n AS total_tasks FROM dc WHERE contrast = 'C1'",
    "publication_interventions": f"WITH {_SEG} SELECT model_slug, contrast, left_condition, right_condition, {_SIX(mean_delta='mean', ci99_low='ci_low', ci99_high='ci_high', valid_vocab_mean_delta='median', semantic_step_balanced_mean_delta='mean')}, positive AS positive_tasks, n AS total_tasks, result_status, CASE WHEN alternative = 'two_sided' THEN margin END AS equivalence_margin, CASE WHEN alternative = 'two_sided' THEN same END AS equivalent FROM dc",
    "publication_conditions": f"WITH r AS (SELECT 'm' || n_regionkey AS model_slug, l_linenumber % 6 AS k, l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey) SELECT model_slug, ({list(schemas.CONDITIONS)})[k + 1] AS condition, round(avg(q), 6) + 0.0 AS mean_entropy_top20, (k + 1)::INT AS place FROM r GROUP BY model_slug, k",
    "publication_profile": f"WITH r AS (SELECT 'm' || n_regionkey AS model_slug, l_linenumber % 6 AS k, l_quantity AS q FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey), g AS (SELECT model_slug, k, avg(q) AS y, count(*) AS n FROM r GROUP BY ALL) SELECT model_slug, ({list(schemas.CONDITIONS)})[k + 1] AS condition, round(y, 6) + 0.0 AS y, n, (k + 1)::INT AS x, round(y - lag(y) OVER (PARTITION BY model_slug ORDER BY k), 6) + 0.0 AS step FROM g",
    "publication_families": f"WITH {_SEG} SELECT model_slug, 'NL-Python' AS contrast, family_positive AS positive_families, family_n AS total_families, {_SIX(mean_family_delta='family_mean', min_family_delta='ci_low', max_family_delta='ci_high')} FROM dc WHERE contrast = 'C1' UNION ALL SELECT model_slug, contrast, family_positive, family_n, round(family_mean, 6) + 0.0, NULL, NULL FROM dc",
    "publication_forest": f"WITH {_SEG} SELECT model_slug, contrast, {_SIX(x='mean', x_low='ci_low', x_high='ci_high')}, row_number() OVER (PARTITION BY contrast ORDER BY model_slug)::INT AS place FROM dc",
    "publication_equivalence": f"WITH {_SEG} SELECT model_slug, contrast, {_SIX(ci_low='ci_low', ci_high='ci_high', margin_low='-margin', margin_high='margin')}, same AS equivalent FROM dc WHERE alternative = 'two_sided'",
    "corpus_gates": """WITH c AS (SELECT count(*) AS n, count(DISTINCT p_partkey) AS ids, count(DISTINCT p_brand) AS families, count(*) FILTER (len(list_distinct([p_name, p_brand, p_type])) <> 3) AS nl FROM part), f AS (SELECT count(*) FILTER (n <> 80) AS other FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY ALL)),
        r(k, "check", expected) AS (VALUES (1, 'tasks', '2000'), (2, 'task_ids', '2000'), (3, 'families', '25'), (4, 'tasks_without_distinct_nl', '0'), (5, 'tasks_without_distinct_python', '0'), (6, 'trajectories', '12000'), (7, 'families_of_other_size', '0')),
        v AS (SELECT "check", expected, ([n, ids, families, nl, n, n * 6, other])[k]::VARCHAR AS actual FROM r, c, f) SELECT "check", expected, actual, expected = actual AS passed FROM v""",
    "canonical_json": """WITH j AS (SELECT n_nationkey, '{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}' AS json FROM nation) SELECT n_nationkey, json, sha256(json) AS sha256 FROM j""",
    "config_changes": "SELECT n_name AS changed FROM nation WHERE n_regionkey = 2",
    "csv_round_trip": "SELECT c_custkey, '\"' || c_name || '\",' || chr(10) || c_mktsegment AS name, c_acctbal FROM customer",
    "json_round_trip": "SELECT r_regionkey, r_name FROM region",
    "append_twice": "SELECT o_orderstatus, count(*) AS n, count(DISTINCT o_orderkey) AS keys, round(sum(o_totalprice), 6) + 0.0 AS price FROM orders GROUP BY ALL",
    "store_manifest": "SELECT r_regionkey AS k, (strlen(r_name) + 1)::BIGINT AS size_bytes, sha256(r_name || '|') AS sha256, r_name || '|' AS value FROM region",
    "scored_positions": f"WITH {oracle._PIECES}, l AS (SELECT item_id, list(length(piece)::INT ORDER BY pos) AS ids FROM pc GROUP BY ALL), e AS (SELECT item_id, ids, unnest(range(1, len(ids))) AS position FROM l) SELECT item_id, position::INT AS position, ids[position + 1] AS token_id, ids[position] AS before, len(ids)::INT AS length FROM e",
    "synthetic_records": f"SELECT t || '__v1__' || c AS trajectory_id, t AS task_id, c AS condition, c || ': ' || x AS reference_text FROM (VALUES ('t1', 'one'), ('t2', 'two')) r(t, x), (SELECT unnest({list(schemas.CONDITIONS)}) AS c)",
    "tokenizer_plugin": r"WITH t AS (SELECT item_id, text, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') AS w, regexp_extract_all(text[:50], '[A-Za-z]+|[^A-Za-z]') AS p FROM benchmark) SELECT item_id, len(w) AS n, length(text) AS n_chars, list_transform(w[:len(p)], lambda x: length(x)) = list_transform(p, lambda x: length(x)) AS aligned FROM t",
}
