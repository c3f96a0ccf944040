"""Synthetic audit inputs over the driver's tables: integer arithmetic on page_id, the same text in Spark SQL and DuckDB.

The pages table has no statuses, redirects, canonicals, robots or usable links; these views stand in for them. They are
inputs of the queries in `catalogue`, not part of any operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions.html import SIGNALS
from quarry.sources.captures import CONTENT, HOP

BASE = "https://site.test/p/"
FACTS = """
SELECT p.page_id AS id, n.n AS n,
  concat('https://site.test/p/', CAST(p.page_id AS STRING)) AS url,
  CASE WHEN p.page_id % 31 = 17 THEN 'timeout' WHEN p.page_id % 37 = 19 THEN 'robots-blocked' ELSE 'complete' END AS completion,
  CASE WHEN p.page_id % 31 = 17 OR p.page_id % 37 = 19 THEN NULL
       WHEN p.page_id % 23 = 7 THEN 404 WHEN p.page_id % 29 = 11 THEN 500 ELSE 200 END AS status,
  CASE WHEN p.page_id % 17 = 9 AND p.page_id % 23 <> 7 THEN 1 ELSE 0 END AS hops,
  CASE WHEN p.page_id % 17 = 9 AND p.page_id % 23 <> 7 THEN (p.page_id + 1) % n.n ELSE p.page_id END AS final_id,
  CASE WHEN p.page_id % 43 = 21 THEN 'application/pdf' ELSE 'text/html; charset=utf-8' END AS content_type,
  p.page_id % 13 = 5 AS has_noindex,
  p.page_id % 3 <> 1 AS in_sitemap,
  CASE WHEN p.page_id % 47 = 5 THEN NULL WHEN p.page_id % 53 = 6 THEN n.n + p.page_id
       WHEN p.page_id % 19 = 3 THEN (p.page_id + 2) % n.n ELSE p.page_id END AS canonical_id,
  CASE WHEN p.page_id % 5 = 0 THEN (p.page_id + 1) % n.n WHEN p.page_id % 10 = 1 THEN p.page_id - 1 END AS alternate_id,
  CASE WHEN p.page_id % 23 IN (7, 8) THEN 30 ELSE 5 END AS words,
  CASE WHEN p.page_id % 23 IN (7, 8) THEN CAST(1234567890123 AS BIGINT) + p.page_id % 3 ELSE p.page_id * 7919 END AS simhash,
  CAST((p.page_id * 37) % 2000 AS DOUBLE) AS duration_ms,
  CASE WHEN p.page_id % 11 = 3 THEN 0 WHEN p.page_id % 11 = 4 THEN 2 ELSE 1 END AS n_titles,
  CASE WHEN p.page_id % 4 = 0 THEN 0 WHEN p.page_id % 12 = 5 THEN 2 ELSE 1 END AS n_descriptions,
  CASE WHEN p.page_id % 13 = 1 THEN 0 WHEN p.page_id % 9 = 4 THEN 2 ELSE 1 END AS n_h1s,
  concat('Title ', CAST(p.page_id % 40 AS STRING)) AS title,
  concat('About ', CAST(p.page_id % 60 AS STRING)) AS description
FROM {pages} p CROSS JOIN (SELECT count(*) AS n FROM {pages}) n
"""
EDGES = """
SELECT DISTINCT id AS src, (id * (2*k+1) + k) % n AS dst
FROM {facts} CROSS JOIN (VALUES (1),(2),(3)) t(k)
WHERE id % 7 <> 6 AND (id * (2*k+1) + k) % n % 11 <> 5
"""


def facts_sql() -> str:
    return FACTS.replace("{pages}", "pages").replace("AS STRING", "AS VARCHAR")


def edges_sql() -> str:
    return EDGES.replace("{facts}", "f")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    return spark.sql(FACTS, pages=pages)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.sql(EDGES, facts=facts(spark, sf_dir))
    return e.select(*[F.concat(F.lit(BASE), F.col(c).cast("string")).alias(c) for c in ("src", "dst")])


def _text(value: str) -> str:
    return f"named_struct('value', {value}, 'location', 'head')"


def _many(count: str, one: str, two: str, three: str | None = None) -> str:
    return f"CASE WHEN {count} = 0 THEN slice(array({one}), 2, 1) WHEN {count} = 1 THEN array({one}) ELSE array({one}, {two}) END"


def _block(types: str, ids: str, sha: str, context: str, valid: str) -> str:
    return f"named_struct('types', {types}, 'ids', {ids}, 'sha256', '{sha}', 'context', '{context}', 'valid', {valid}, 'error', IF({valid}, NULL, 'invalid JSON'))"


_NONE = "slice(array(''), 2, 1)"
_A = _block("array('Product')", "array('#p')", "s0", "schema.org", "true")
_B = _block("array('Thing')", "array('#p')", "s1", "missing", "true")
_C = _block(_NONE, _NONE, "s2", "missing", "false")


def signals_sql(noindex: str = "has_noindex", title: str = "title") -> str:
    robot = "named_struct('value', 'noindex', 'location', 'head', 'audience', 'robots', 'source', 'meta')"
    canonical = _text("concat('https://site.test/p/', CAST(canonical_id AS STRING))")
    alternate = "named_struct('language', CASE WHEN id % 17 = 2 THEN 'english' WHEN id % 2 = 0 THEN 'fr' ELSE 'de' END, 'href', concat('/p/', CAST(alternate_id AS STRING)), 'resolved_url', concat('https://site.test/p/', CAST(alternate_id AS STRING)))"
    social = "named_struct('property', 'og:title', 'value', title, 'location', 'head')"
    blocks = f"concat(IF(id % 6 = 0, array({_A}), slice(array({_A}), 2, 1)), IF(id % 12 = 0, array({_A}), slice(array({_A}), 2, 1)), IF(id % 18 = 0, array({_B}), slice(array({_B}), 2, 1)), IF(id % 15 = 0, array({_C}), slice(array({_C}), 2, 1)))"
    pick = lambda on, x: f"IF({on}, array({x}), slice(array({x}), 2, 1))"
    return f"""CAST(named_struct(
      'titles', {_many('n_titles', _text(title), _text(title))},
      'descriptions', {_many('n_descriptions', _text('description'), _text("'Other'"))},
      'canonicals', {pick('canonical_id IS NOT NULL', canonical)},
      'robots', {pick(noindex, robot)},
      'h1s', {_many('n_h1s', _text("'Heading'"), _text("'Second'"))},
      'links', slice(array(named_struct('href', '', 'resolved_url', '', 'text', '', 'rel', array(''), 'nofollow', false)), 2, 1),
      'hreflangs', {pick('alternate_id IS NOT NULL', alternate)},
      'social', {pick('id % 2 = 0', social)},
      'structured_data', {blocks},
      'html_lang', 'en', 'base_href', CAST(NULL AS STRING), 'content_text', '') AS {SIGNALS})"""


def _capture(f: DataFrame, **change: str) -> DataFrame:
    x = {"status": "status", "noindex": "has_noindex", "title": "title", "agent": "'default'"} | change
    hop = "named_struct('url', url, 'status', 301, 'location', concat('https://site.test/p/', CAST(final_id AS STRING)), 'duration_ms', CAST(id % 900 AS DOUBLE))"
    return f.selectExpr(
        "id", "url", "id AS ord", f"{x['agent']} AS agent", "completion", f"CAST({x['status']} AS INT) AS status",
        "concat('https://site.test/p/', CAST(final_id AS STRING)) AS final_url", "content_type",
        f"CAST(IF(hops > 0, array({hop}), slice(array({hop}), 2, 1)) AS array<{HOP}>) AS redirects",
        f"{signals_sql(x['noindex'], x['title'])} AS signals",
        f"CAST(named_struct('characters', words * 6, 'words', words, 'sha256', concat('c', CAST(simhash AS STRING)), 'simhash', simhash) AS {CONTENT}) AS content",
        "duration_ms", "CAST(NULL AS STRING) AS error", "in_sitemap", "id % 6 = 1 AS in_build", "id % 67 = 33 AS exempt",
        "CASE WHEN id % 6 = 1 THEN IF(id % 4 = 1, 'static', 'dynamic') END AS render_mode",
    )


def routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One primary capture per page, with a depth and, for some, a rendered capture."""
    r = _capture(facts(spark, sf_dir))
    rendered = "named_struct('completion', IF(id % 16 = 3, 'complete', 'timeout'), 'status', CAST(IF(id % 48 = 3, 404, 200) AS INT), 'signals', signals, 'content', named_struct('characters', CAST(500 AS INT)))"
    return r.selectExpr("*", "CAST(IF(id % 10 = 9, -1, id % 7) AS INT) AS depth", f"IF(id % 8 = 3, {rendered}, NULL) AS rendered")


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second agent on every third page, which some pages treat differently."""
    f = facts(spark, sf_dir).where("id % 3 = 0")
    other = _capture(f, status="IF(id % 9 = 0 AND status IS NOT NULL, 403, status)", noindex="id % 21 = 0 OR has_noindex", title="IF(id % 15 = 0, 'Other', title)", agent="'googlebot'")
    return other.withColumn("agent_ord", F.lit(1))


def baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier snapshot: without every 20th page, with other statuses and titles here and there."""
    f = facts(spark, sf_dir).where("id % 20 <> 13")
    old = _capture(f, status="IF(id % 14 = 2 AND status IS NOT NULL, 404, status)", title="IF(id % 25 = 4, 'Old title', title)", noindex="id % 13 = 6")
    return old.selectExpr("*", "CAST(id % 7 AS INT) AS depth", "named_struct('completion', 'complete', 'status', 200, 'signals', signals, 'content', named_struct('characters', 500)) AS rendered").withColumn("rendered", F.when(F.lit(False), F.col("rendered")))


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later snapshot: without every 22nd page."""
    return routes(spark, sf_dir).where("id % 22 <> 17")
