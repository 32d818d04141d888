"""The queries opN_<name> of the corpus operators, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import documents, shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def tokenizer_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query
def op3_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_frames import read_token_files, write_token_files
    manifest = write_token_files(documents(spark, sf_dir), shared_path(spark, "token-frames"),
                                 tokenizer_path("word_bpe_49k.json"), end_id=2)
    back = read_token_files(spark, manifest)
    return back.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .suffix_dedup import remove_repeats
    kept = remove_repeats(documents(spark, sf_dir), span=100)
    return kept.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"),
                       F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op1_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .dart_minhash import near_duplicates
    return near_duplicates(documents(spark, sf_dir), threshold=0.8).select("doc_id", "class_id")


@query
def op8_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .swap_packing import pack_documents
    return pack_documents(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), capacity=1024, end_id=2)


@query
def op5_repetition_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .repetition_rules import repetition_rules
    return repetition_rules(documents(spark, sf_dir)).drop("spans")


@query
def op7_fm_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fm_classifier import classify
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), threshold=0.7, max_rows=8000)


@query
def op6_winnow_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow_decontam import contamination
    found = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
ORACLES["op6_winnow_decontam"] = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
b2 AS (SELECT item_id, w, least(len(w), 13) AS k, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS j FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, k, array_to_string(w[j:j + k - 1], ' ') AS win FROM b2),
sizes AS (SELECT DISTINCT k FROM windows),
d2 AS (SELECT doc_id, k, w, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, sizes WHERE len(w) >= k),
hit AS (SELECT DISTINCT doc_id, i, d2.k, item_id FROM d2 JOIN windows ON windows.k = d2.k AND win = array_to_string(w[i:i + d2.k - 1], ' ')),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hit) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)
"""


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
             ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op10_link_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .link_trust import filter_urls
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def _rank_sql(name: str, verdict: str, one: str, two: str, rounds: int = 20) -> str:
    """Common table expressions of the rounds; ``name``0 are the seeds."""
    parts = [f"""{name}_steps AS MATERIALIZED (SELECT {one} AS a, {two} AS b, n / sum(n) OVER (PARTITION BY {one}) AS share FROM edges),
{name}0 AS MATERIALIZED (SELECT host, sum(n) / (SELECT sum(n) FROM hosts WHERE verdict = '{verdict}') AS r FROM hosts WHERE verdict = '{verdict}' GROUP BY host)"""]
    for k in range(rounds):
        parts.append(f"""{name}{k + 1} AS MATERIALIZED (SELECT host, sum(r) AS r FROM (
    SELECT b AS host, r * share * 0.85 AS r FROM {name}{k} JOIN {name}_steps ON host = a UNION ALL SELECT host, r * 0.15 FROM {name}0) GROUP BY host)""")
    return ",\n".join(parts)


_LOWERED = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_REST = "CASE WHEN instr(coalesce(url, ''), '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END"
ORACLES["op10_link_trust"] = rf"""
WITH u AS MATERIALIZED (SELECT page_id, html, {_LOWERED.format(f"regexp_extract({_REST}, '^([^/?#]*)', 1)")} AS host,
  regexp_extract({_REST}, '^[^/?#]*([^?#]*)', 1) AS path FROM pages),
j AS MATERIALIZED (SELECT *, CASE
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR ends_with(host, '.example.org')) AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/') THEN 'org/' END AS rule FROM u),
v AS MATERIALIZED (SELECT *, CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS verdict FROM j),
hosts AS MATERIALIZED (SELECT host, verdict, count(*) AS n FROM v WHERE host <> '' GROUP BY ALL),
links AS (SELECT host AS source, unnest(list_distinct(regexp_extract_all(html, '(?i)\b(?:href|src)\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"''\s>]*)', 1))) AS link FROM v),
edges AS MATERIALIZED (SELECT source, {_LOWERED.format("regexp_extract(link, '//([^/?#]*)$', 1)")} AS target, count(*) AS n FROM links GROUP BY ALL
  HAVING source <> '' AND target <> '' AND source <> target),
{_rank_sql("t", "allow", "source", "target")},
{_rank_sql("d", "block", "target", "source")}
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN coalesce(d20.r, 0) > 0.75 * (coalesce(t20.r, 0) + coalesce(d20.r, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM v LEFT JOIN t20 USING (host) LEFT JOIN d20 USING (host)
"""


@query
def op4_masked_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .masked_lm import pseudo_likelihood
    return pseudo_likelihood(documents(spark, sf_dir))


@query
def op9_patience_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .patience_license import best_license, scan_licenses
    return best_license(scan_licenses(documents(spark, sf_dir), least_coverage=0.8))


@query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import periodic_runs, planted
    found = periodic_runs(planted(documents(spark, sf_dir)), min_length=24, min_repeats=3)
    best = F.col("strongest")
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best["start"].alias("start"),
                        best["length"].alias("length"), best["period"].alias("period"),
                        F.expr("1000 * strongest.length div strongest.period").alias("exponent_milli"),
                        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
                        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fill_in_middle import fill_in_middle, restored
    made = fill_in_middle(documents(spark, sf_dir), seed=42, fim_percent=50, spm_percent=80)
    back = restored(F.col("output"), F.col("form"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
                       F.sha2(back.cast("binary"), 256).alias("restored_sha256"))


@query
def op12_topk_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_threshold import top_k
    found = top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0, k=5, scale=256)
    return found.withColumnRenamed("id", "vec_id")


ORACLES["op12_topk_threshold"] = """
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""
