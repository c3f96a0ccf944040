"""DuckDB equivalents of the catalogue's queries. Rules are restated as conditions over the synthetic views."""

from __future__ import annotations

from quarry.plans.derived import edges_sql, facts_sql

_SCOPE1 = "CAST(id AS VARCHAR) LIKE '1%'"
_SCOPE2 = "(CAST(id AS VARCHAR) LIKE '2%' AND NOT CAST(id AS VARCHAR) LIKE '2_')"
_OK = "(completion = 'complete' AND status = 200 AND hops = 0 AND content_type <> 'application/pdf')"
_INDEX = f"CASE WHEN {_OK} IS NOT TRUE THEN 'unknown' WHEN has_noindex THEN 'noindex' ELSE 'indexable' END"

#: f: the facts with derived columns; e: edges by id.
WITH = f"""
WITH RECURSIVE f0 AS ({facts_sql()}),
f AS (SELECT *, coalesce({_OK}, false) AS ok, {_INDEX} AS indexability, id % 67 = 33 AS exempt,
  CASE WHEN id % 10 = 9 THEN -1 ELSE id % 7 END AS depth, {_SCOPE1} AS scope1, {_SCOPE2} AS scope2,
  completion = 'complete' AND status IS NOT NULL AND NOT id % 67 = 33 AS go FROM f0),
e AS ({edges_sql()})
"""


def _union(rows, table: str = "f") -> str:
    """(code, severity, condition) over f or another table of its columns, one branch each."""
    return "\nUNION ALL\n".join(f"SELECT url, '{code}' AS code, {severity if '(' in severity or ' ' in severity else repr(severity)} AS severity FROM {table} WHERE {condition}" for code, severity, condition in rows)


PAGE = [
    ("robots-blocked", "info", "completion = 'robots-blocked'"),
    ("incomplete-fetch", "error", "completion = 'timeout'"),
    ("missing-http-response", "error", "completion = 'timeout'"),
    ("server-error", "error", "go AND status = 500"),
    ("not-found", "error", "go AND status = 404"),
    ("redirected-route", "warning", "go AND status = 200 AND hops > 0"),
    ("non-html-route", "info", "go AND status = 200 AND hops = 0 AND NOT ok"),
    ("missing-title", "error", "go AND ok AND n_titles = 0"),
    ("missing-description", "warning", "go AND ok AND n_descriptions = 0"),
    ("missing-canonical", "error", "go AND ok AND canonical_id IS NULL"),
    ("missing-h1", "warning", "go AND ok AND n_h1s = 0 AND NOT scope2"),
    ("duplicate-title", "warning", "go AND ok AND n_titles = 2"),
    ("conflicting-description", "warning", "go AND ok AND n_descriptions = 2"),
    ("multiple-h1", "warning", "go AND ok AND n_h1s = 2"),
    ("noindex", "info", "go AND ok AND has_noindex"),
    ("invalid-hreflang", "warning", "go AND ok AND alternate_id IS NOT NULL AND id % 17 = 2"),
    ("missing-og-title", "error", "go AND ok AND id % 2 = 1"),
    ("missing-og-description", "warning", "go AND ok"),
    ("rendered-capture-incomplete", "warning", "go AND ok AND id % 8 = 3 AND id % 16 <> 3"),
    ("rendered-status-mismatch", "error", "go AND ok AND id % 48 = 3"),
    ("client-only-content", "error", "go AND ok AND id % 16 = 3 AND id % 48 <> 3 AND words = 5"),
    ("duplicate-json-ld", "warning", "go AND ok AND id % 12 = 0"),
    ("json-ld-missing-context", "warning", "go AND ok AND id % 18 = 0"),
    ("conflicting-json-ld-id", "warning", "go AND ok AND id % 18 = 0"),
    ("invalid-json-ld", "warning", "go AND ok AND id % 15 = 0"),
]
_BOTH = "id % 3 = 0 AND completion = 'complete'"
AGENT = [
    ("agent-incomplete-fetch", "CASE WHEN completion = 'timeout' THEN 'error' ELSE 'warning' END", "id % 3 = 0 AND completion <> 'complete'"),
    ("agent-status-mismatch", "CASE WHEN status = 200 THEN 'error' ELSE 'warning' END", f"{_BOTH} AND id % 9 = 0"),
    ("agent-title-mismatch", "warning", f"{_BOTH} AND id % 9 <> 0 AND status = 200 AND content_type <> 'application/pdf' AND id % 15 = 0 AND n_titles > 0"),
    ("agent-robots-mismatch", "CASE WHEN hops = 0 THEN 'error' ELSE 'warning' END", f"{_BOTH} AND id % 9 <> 0 AND status = 200 AND content_type <> 'application/pdf' AND id % 21 = 0 AND NOT has_noindex"),
]
GRAPH = [
    ("deep-route", "warning", "depth > 4 AND indexability = 'indexable'"),
    ("orphan-route", "warning", "depth < 0 AND id <> 0 AND (in_sitemap OR id % 6 = 1) AND indexability = 'indexable'"),
    ("dead-end-route", "info", "id NOT IN (SELECT src FROM e) AND indexability = 'indexable'"),
    ("not-in-sitemap", "warning", "indexability = 'indexable' AND NOT in_sitemap"),
    ("sitemap-redirect", "error", "in_sitemap AND completion = 'complete' AND hops > 0"),
    ("sitemap-broken-url", "error", "in_sitemap AND completion = 'complete' AND status >= 400"),
    ("sitemap-noindex", "error", "in_sitemap AND indexability = 'noindex'"),
    ("sitemap-robots-blocked", "error", "in_sitemap AND completion = 'robots-blocked'"),
    ("non-self-canonical", "warning", "completion = 'complete' AND canonical_id <> final_id"),
]
TIME = [
    ("slow-route", "warning", "completion = 'complete' AND duration_ms > CASE WHEN scope1 THEN 800 ELSE 1500 END"),
    ("slow-redirect", "warning", "hops > 0 AND id % 900 > 500"),
]
_JOINED = """
SELECT s.url, 'canonical-target-unseen' AS code, 'warning' AS severity FROM f s WHERE s.completion = 'complete' AND s.canonical_id NOT IN (SELECT id FROM f)
UNION ALL SELECT s.url, 'broken-canonical-target', 'error' FROM f s JOIN f t ON t.id = s.canonical_id WHERE s.completion = 'complete' AND t.completion = 'complete' AND t.status >= 400
UNION ALL SELECT s.url, 'redirecting-canonical-target', 'warning' FROM f s JOIN f t ON t.id = s.canonical_id WHERE s.completion = 'complete' AND t.completion = 'complete' AND t.hops > 0
UNION ALL SELECT s.url, 'noindex-canonical-target', 'error' FROM f s JOIN f t ON t.id = s.canonical_id WHERE s.completion = 'complete' AND t.indexability = 'noindex'
UNION ALL SELECT url, code, severity FROM (SELECT DISTINCT s.url, t.status, 'broken-internal-link' AS code, 'error' AS severity FROM e JOIN f s ON s.id = e.src JOIN f t ON t.id = e.dst WHERE t.completion = 'complete' AND t.status >= 400)
UNION ALL SELECT DISTINCT s.url, 'redirecting-internal-link', 'warning' FROM e JOIN f s ON s.id = e.src JOIN f t ON t.id = e.dst WHERE t.completion = 'complete' AND t.status < 400 AND t.hops > 0
UNION ALL SELECT DISTINCT s.url, 'internal-link-to-noindex', 'warning' FROM e JOIN f s ON s.id = e.src JOIN f t ON t.id = e.dst WHERE t.indexability = 'noindex'
UNION ALL SELECT s.url, 'hreflang-target-noindex', 'error' FROM f s JOIN f t ON t.id = s.alternate_id WHERE s.completion = 'complete' AND t.indexability = 'noindex'
UNION ALL SELECT s.url, 'hreflang-missing-return-link', 'warning' FROM f s JOIN f t ON t.id = s.alternate_id WHERE s.completion = 'complete' AND t.completion = 'complete' AND t.id <> s.id AND t.alternate_id IS DISTINCT FROM s.id
"""
_GROUPS = """
SELECT arg_min(url, id) AS url, code, max(severity) AS severity, count(*) AS routes FROM (
  SELECT url, id, 'duplicate-canonical-target' AS code, CAST(canonical_id AS VARCHAR) AS k, 'warning' AS severity FROM f WHERE indexability = 'indexable' AND canonical_id IS NOT NULL
  UNION ALL SELECT url, id, 'duplicate-title-across-routes', title, 'warning' FROM f WHERE indexability = 'indexable' AND n_titles > 0
  UNION ALL SELECT url, id, 'duplicate-description-across-routes', description, 'warning' FROM f WHERE indexability = 'indexable' AND n_descriptions > 0
  UNION ALL SELECT url, id, 'duplicate-content-across-routes', CAST(simhash AS VARCHAR), 'warning' FROM f WHERE indexability = 'indexable' AND words >= 20)
GROUP BY code, k HAVING count(*) >= 2
"""
_MEMBERS = """
, m AS (SELECT url, id, 'duplicate-canonical-target' AS code, CAST(canonical_id AS VARCHAR) AS k FROM f WHERE indexability = 'indexable' AND canonical_id IS NOT NULL
  UNION ALL SELECT url, id, 'duplicate-title-across-routes', title FROM f WHERE indexability = 'indexable' AND n_titles > 0
  UNION ALL SELECT url, id, 'duplicate-description-across-routes', description FROM f WHERE indexability = 'indexable' AND n_descriptions > 0
  UNION ALL SELECT url, id, 'duplicate-content-across-routes', CAST(simhash AS VARCHAR) FROM f WHERE indexability = 'indexable' AND words >= 20),
w AS (SELECT code, first_value(url) OVER g AS representative, url, count(*) OVER (PARTITION BY code, k) AS routes FROM m WINDOW g AS (PARTITION BY code, k ORDER BY id))
SELECT * FROM w WHERE routes >= 2
"""
_TITLES = """
SELECT arg_min(url, id) AS url, 'duplicate-title-across-routes' AS code, CASE WHEN bool_or(scope2) THEN 'error' ELSE 'warning' END AS severity
FROM f WHERE indexability = 'indexable' AND n_titles > 0 GROUP BY title HAVING count(*) >= 2
"""
_SOFT = """
SELECT url, CASE WHEN same THEN 'soft-404' ELSE 'possible-soft-404' END AS code, CASE WHEN same THEN 'error' ELSE 'warning' END AS severity, reference FROM (
  SELECT p.url, r.url AS reference, p.simhash = r.simhash AS same, row_number() OVER (PARTITION BY p.id ORDER BY r.id) AS k
  FROM f p JOIN f r ON r.completion = 'complete' AND r.status = 404 AND r.words >= 8 AND (p.simhash = r.simhash OR (p.words >= 15 AND bit_count(xor(p.simhash, r.simhash)) <= 3))
  WHERE p.ok AND p.words >= 8) WHERE k = 1
"""
_SEVERITY = "CASE WHEN code = 'multiple-h1' THEN CASE WHEN regexp_extract(url, '[0-9]+$') LIKE '1%' THEN 'error' ELSE 'info' END WHEN code = 'missing-title' AND regexp_extract(url, '[0-9]+$') LIKE '1%' THEN 'warning' ELSE severity END"
_GROUPED = f"SELECT url, code, severity FROM ({_GROUPS}) WHERE code <> 'duplicate-title-across-routes' UNION ALL {_TITLES}"
#: Every finding of the synthetic audit with its final severity.
_FINISHED = f"SELECT url, code, {_SEVERITY} AS severity FROM ({_union(PAGE)} UNION ALL {_union(AGENT)} UNION ALL {_union(TIME)} UNION ALL {_union(GRAPH)} UNION ALL {_JOINED} UNION ALL SELECT url, code, severity FROM ({_SOFT}) UNION ALL {_GROUPED}) WHERE code <> 'dead-end-route'"

_ENTITIES = lambda x: f"replace(replace(replace(replace({x}, '&quot;', '\"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&')"
_SQUASH = lambda x: f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"
_TITLE = _SQUASH(_ENTITIES("regexp_extract(html, '<title>(.*?)</title>', 1)"))
_NORMAL = f"SELECT doc_id, {_SQUASH('lower(text)')} AS t FROM documents"
_WORDS = "regexp_extract_all(t, '[\\p{L}\\p{N}]+')"
_SIM = f"""
tok AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM n) GROUP BY ALL),
dig AS (SELECT doc_id, c, ('0x' || substr(sha256(w), 1, 8))::BIGINT AS hi, ('0x' || substr(sha256(w), 9, 8))::BIGINT AS lo FROM tok),
bits AS (SELECT doc_id, b, sum(CASE WHEN ((CASE WHEN b < 32 THEN hi ELSE lo END) >> (31 - b % 32)) & 1 = 1 THEN c ELSE -c END) AS s FROM dig, range(64) r(b) GROUP BY doc_id, b),
sim AS (SELECT n.doc_id, coalesce(bit_or(CASE WHEN s >= 0 THEN CASE WHEN b = 0 THEN 9223372036854775808::UBIGINT ELSE (1::UBIGINT << (63 - b)::UBIGINT) END ELSE 0::UBIGINT END), 0::UBIGINT) AS h FROM n LEFT JOIN bits USING (doc_id) GROUP BY n.doc_id)
"""
#: Rules that read the rendered capture, which the baseline has none of.
_RENDERED = ("rendered-capture-incomplete", "rendered-status-mismatch", "client-only-content")
_HARDER = [(code, "CASE WHEN url LIKE '%5' THEN 'error' ELSE 'warning' END" if code == "missing-description" else severity, condition) for code, severity, condition in PAGE]
_PROFILE = f"""
b AS (SELECT * REPLACE (CASE WHEN id % 14 = 2 AND status IS NOT NULL THEN 404 ELSE status END AS status, id % 13 = 6 AS has_noindex,
    CASE WHEN n_titles > 0 THEN CASE WHEN id % 25 = 4 THEN 'Old title' ELSE title END END AS title) FROM f WHERE id % 20 <> 13),
bb AS (SELECT * REPLACE (coalesce({_OK}, false) AS ok, {_INDEX} AS indexability), has_noindex AS noindex FROM b),
c AS (SELECT * REPLACE (CASE WHEN n_titles > 0 THEN title END AS title), has_noindex AS noindex FROM f WHERE id % 22 <> 17),
bf AS ({_union([r for r in PAGE if r[0] not in _RENDERED], "bb")}),
cf AS ({_union(_HARDER, "c")}),
j AS (SELECT url, code, bf.severity AS bs, cf.severity AS cs FROM bf FULL OUTER JOIN cf USING (url, code))
"""
_RANK = lambda s: f"CASE {s} WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"
_CHANGE = f"CASE WHEN cs IS NULL THEN 'resolved' WHEN bs IS NULL THEN 'new' WHEN {_RANK('cs')} < {_RANK('bs')} THEN 'worsened' ELSE 'unchanged' END"


def _diff() -> str:
    parts = [
        "SELECT url, 'added' AS kind, 'route-added' AS code, CASE WHEN c.status >= 400 THEN 'error' ELSE 'info' END AS severity, NULL::VARCHAR AS before, c.status::VARCHAR AS after FROM c WHERE url NOT IN (SELECT url FROM bb)",
        "SELECT url, 'removed', 'route-removed', CASE WHEN indexability = 'indexable' THEN 'warning' ELSE 'info' END, status::VARCHAR, NULL FROM bb WHERE url NOT IN (SELECT url FROM c)",
    ]
    fields = {
        "status": ("status", "CASE WHEN c.status IS NULL OR c.status >= 400 THEN 'error' WHEN bb.status IS NULL OR bb.status >= 400 THEN 'info' ELSE 'warning' END"),
        "indexability": ("indexability", "CASE WHEN c.indexability = 'indexable' THEN 'info' ELSE 'error' END"),
        "title": ("title", "'info'"),
        "robots": ("CASE WHEN {}.noindex THEN 'robots:noindex' END", "'warning'"),
    }
    for name, (column, severity) in fields.items():
        b, a = (column.format(s) if "{" in column else f"{s}.{column}" for s in ("bb", "c"))
        parts.append(f"SELECT url, 'changed', '{name}-changed', {severity}, ({b})::VARCHAR, ({a})::VARCHAR FROM bb JOIN c USING (url) WHERE {b} IS DISTINCT FROM {a}")
    return "\nUNION ALL ".join(parts)


_CONTRACTS = """
k AS (SELECT id, url, CASE WHEN id % 4 = 0 THEN (id + 3) % n ELSE (id + 1) % n END AS to_id, CASE WHEN id % 5 = 0 THEN 308 ELSE 301 END AS want, CASE WHEN id % 6 = 0 THEN 0 ELSE 1 END AS most,
  completion = 'complete' AS done, hops, status, final_id, status = 200 AND content_type <> 'application/pdf' AND has_noindex AS sick FROM f WHERE id % 17 IN (9, 3)),
kf AS (SELECT url, 'redirect-contract-unchecked' AS code, 'warning' AS severity FROM k WHERE NOT done
  UNION ALL SELECT url, 'expected-redirect-missing', 'error' FROM k WHERE done AND hops = 0
  UNION ALL SELECT url, 'redirect-status-mismatch', 'error' FROM k WHERE done AND hops > 0 AND want <> 301
  UNION ALL SELECT url, 'redirect-target-mismatch', 'error' FROM k WHERE done AND hops > 0 AND final_id <> to_id
  UNION ALL SELECT url, 'redirect-chain', 'warning' FROM k WHERE done AND hops > most
  UNION ALL SELECT url, 'redirect-target-unhealthy', 'error' FROM k WHERE done AND hops > 0 AND final_id = to_id AND (status <> 200 OR sick))
"""


def _crawl(pages: int, depth: int) -> str:
    """k0, k1, ...: addresses known after each level of a crawl from page 0; a level takes its first ones in the order of (first source, address)."""
    steps = ["l0 AS (SELECT 0::BIGINT AS id, 0::BIGINT AS depth), k0 AS (SELECT * FROM l0)"]
    for d in range(depth):
        steps.append(f"""l{d + 1} AS (SELECT dst AS id, {d + 1}::BIGINT AS depth FROM (SELECT dst, row_number() OVER (ORDER BY min(src::VARCHAR), dst::VARCHAR) AS k
  FROM e JOIN l{d} ON e.src = l{d}.id JOIN f ON f.id = e.src WHERE f.completion = 'complete' AND f.status BETWEEN 200 AND 299 AND dst NOT IN (SELECT id FROM k{d}) GROUP BY dst)
  WHERE k + (SELECT count(*) FROM k{d}) <= {pages}), k{d + 1} AS (SELECT * FROM k{d} UNION ALL SELECT * FROM l{d + 1})""")
    return ",\n".join(steps) + f" SELECT 'https://site.test/p/' || id AS url, depth FROM k{depth}"


_HEADING = _SQUASH(_ENTITIES("regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1)"))
#: Percent-encoding of what is not ASCII, as the address standard has it.
_PERCENT = lambda x: f"array_to_string(list_transform(string_split({x}, ''), lambda c: CASE WHEN regexp_matches(c, '^[\\x21\\x23-\\x3B\\x3D\\x3F-\\x5F\\x61-\\x7A\\x7C\\x7E]$') THEN c ELSE url_encode(c) END), '')"
_LINK = f"regexp_extract(url, '^https?://[^/?#]+') || {_PERCENT('h')}"
_HELD = f"SELECT page_id, url, {_ENTITIES('unnest(regexp_extract_all(html, ' + chr(39) + '<a href=' + chr(34) + '([^' + chr(34) + ']*)' + chr(34) + '>' + chr(39) + ', 1))')} AS h FROM pages"
_BARE = "regexp_replace(url, '#.*$', '')"
_SEEN = "SELECT arg_min(html, page_id) AS html, url FROM pages WHERE url IS NOT NULL GROUP BY url"
_BODY = "regexp_replace(html, '(?s)<(script|style)[^>]*>.*?</(script|style)>', '', 'g')"
ORACLES = {
    "page_signals": f"SELECT page_id, {_TITLE} AS title, len(regexp_extract_all(html, '<h1>')) AS h1s, len(regexp_extract_all(html, '<a href=')) AS links, regexp_extract(html, '<html lang=\"(\\w+)\"', 1) AS lang FROM pages",
    "page_links": f"SELECT page_id, position - 1 AS position, {_ENTITIES('h')} AS href, {_SQUASH(_ENTITIES('l'))} AS label FROM (SELECT page_id, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 1)) AS h, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\">([^<]*)</a>', 2)) AS l, generate_subscripts(regexp_extract_all(html, '<a href=\"([^\"]*)\">'), 1) AS position FROM pages)",
    "duplicate_titles": f"SELECT lower({_TITLE}) AS title, count(*) AS pages, min(page_id) AS first_page FROM pages WHERE {_TITLE} <> '' GROUP BY 1 HAVING count(*) >= 2",
    "content_fingerprint": f"SELECT doc_id, length(t) AS characters, len({_WORDS}) AS words, sha256(t) AS sha256 FROM ({_NORMAL})",
    "duplicate_content": f"SELECT sha256(t) AS sha256, count(*) AS documents, min(doc_id) AS first_doc FROM ({_NORMAL}) WHERE len({_WORDS}) >= 20 GROUP BY 1 HAVING count(*) >= 2",
    "simhash": f"WITH n AS ({_NORMAL}), {_SIM} SELECT doc_id, lpad(lower(hex(h)), 16, '0') AS simhash FROM sim",
    "near_duplicates": f"""WITH n AS ({_NORMAL}), {_SIM}, r AS (SELECT h, length(t) AS c, sim.doc_id FROM sim JOIN n USING (doc_id) WHERE len({_WORDS}) >= 15),
reps AS (SELECT h, c, min(doc_id) AS k FROM r GROUP BY h, c)
SELECT k AS a, doc_id AS b, 0::BIGINT AS distance FROM r JOIN reps USING (h, c) WHERE doc_id <> k
UNION ALL SELECT x.k, y.k, bit_count(xor(x.h, y.h))::BIGINT FROM reps x JOIN reps y ON x.k < y.k AND bit_count(xor(x.h, y.h)) <= 3 AND x.c / greatest(1, y.c) BETWEEN 0.75 AND 1.25""",
    "url_variants": """SELECT regexp_extract(url, '^(https?://[^/?#]*)', 1) || lower(CASE WHEN p = '/' THEN p ELSE regexp_replace(p, '/$', '') END) || regexp_extract(url, '^[^?#]*(\\?[^#]*)?', 1) AS signature, count(DISTINCT url) AS urls
FROM (SELECT url, regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS p FROM (SELECT url FROM pages UNION ALL SELECT regexp_replace(url, '^(https?://[^/]+)(/[^?]*)', '\\1\\2/') FROM pages WHERE page_id % 5 = 0)) GROUP BY 1 HAVING count(DISTINCT url) >= 2""",
    "redaction": "SELECT page_id, u AS url, 'failed: ' || u || ', key [redacted].' AS message FROM (SELECT page_id, 'https://redacted:redacted@host.test/p/' || page_id || '?token=%5Bredacted%5D&page=' || page_id AS u FROM pages)",
    "resolved_links": f"SELECT {_LINK} AS url, count(*) AS links, count(DISTINCT page_id) AS pages FROM ({_HELD}) GROUP BY 1",
    "url_normalization": f"SELECT page_id, {_BARE} AS url, {_BARE} AS respelled, regexp_replace({_BARE}, '[?].*$', '') AS bare FROM pages",
    "captured_page_findings": f"""WITH s AS ({_SEEN}), t AS (SELECT url, {_TITLE} AS title, len(regexp_extract_all({_BODY}, '<h1>')) AS h1s FROM s)
SELECT url, 'missing-title' AS code, 'error' AS severity FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.url = t.url AND s.html LIKE '%<title>%') UNION ALL SELECT url, 'missing-h1', 'warning' FROM t WHERE h1s = 0 UNION ALL SELECT url, 'multiple-h1', 'warning' FROM t WHERE h1s > 1
UNION ALL SELECT url, unnest(['missing-description', 'missing-canonical', 'missing-og-title', 'missing-og-description']), unnest(['warning', 'error', 'error', 'warning']) FROM t""",
    "captured_group_findings": f"""WITH s AS ({_SEEN}), t AS (SELECT url, lower({_TITLE}) AS title, {_SQUASH('lower(' + _ENTITIES(f"regexp_replace(regexp_extract({_BODY}, '(?s)<body>(.*)', 1), '(?s)<!--.*?-->|<[^>]*>', ' ', 'g')") + ')')} AS shown,
  regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1) AS path FROM s),
k AS (SELECT url, 'duplicate-title-across-routes' AS code, title AS key FROM t WHERE title <> ''
  UNION ALL SELECT url, 'duplicate-content-across-routes', shown FROM t WHERE len(regexp_extract_all(shown, '[\\p{{L}}\\p{{N}}]+')) >= 20
  UNION ALL SELECT url, 'route-case-or-slash-variant', regexp_extract(url, '^(https?://[^/?#]*)', 1) || lower(CASE WHEN path = '/' THEN path ELSE regexp_replace(path, '/$', '') END) || regexp_extract(url, '^[^?#]*(\\?[^#]*)?', 1) FROM t)
SELECT min(url) AS url, code, 'warning' AS severity, count(*) AS routes FROM k GROUP BY code, key HAVING count(*) >= 2""",
    "page_findings": WITH + _union(PAGE),
    "agent_findings": WITH + _union(AGENT),
    "graph_findings": WITH + _union(GRAPH) + "\nUNION ALL " + _JOINED,
    "group_findings": WITH + _GROUPS,
    "group_members": WITH.rstrip() + _MEMBERS,
    "captured_soft_404_findings": f"SELECT url, 'possible-soft-404' AS code, 'warning' AS severity, NULL::VARCHAR AS reference FROM (SELECT url, {_TITLE} AS title, {_HEADING} AS h1, length({_BODY}) AS n FROM ({_SEEN})) WHERE regexp_matches(title || ' ' || h1, '(?i)\\b(404|page not found|not found|does not exist)\\b') AND n <= 2000",
    "time_findings": WITH + _union(TIME),
    "soft_404_findings": WITH + _SOFT,
    "indexability": WITH + "SELECT url, indexability FROM f",
    "finding_counts": WITH + f", a AS ({_FINISHED}) SELECT code, severity, count(*) AS findings FROM a GROUP BY code, severity",
    "scoped_severity": WITH + f", a AS ({_union(PAGE)} UNION ALL {_GROUPED}) SELECT url, code, {_SEVERITY} AS severity FROM a",
    "summary": WITH + f""", g AS ({_union(GRAPH)} UNION ALL {_JOINED})
SELECT r.*, g.* FROM (SELECT count(*) AS routes, count(completion) AS fetched, count(*) FILTER (indexability = 'indexable') AS indexable, count(*) FILTER (indexability = 'noindex') AS noindex, count(*) FILTER (hops > 0) AS redirects, greatest(0, max(depth))::INT AS max_depth FROM f) r,
(SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (code = 'broken-internal-link') AS broken_links FROM g) g""",
    "sarif_rules": WITH + f", a AS ({_FINISHED}) SELECT code, CASE min({_RANK('severity')}) WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'note' END AS level, count(*) AS results FROM a GROUP BY code",
    "csv_rows": WITH + "SELECT 'warning' AS severity, 'slow-route' AS code, url, '' AS related_urls, 'budgetMs=' || CASE WHEN scope1 THEN 800 ELSE 1500 END || '; durationMs=' || duration_ms::BIGINT AS evidence FROM f WHERE completion = 'complete' AND duration_ms > CASE WHEN scope1 THEN 800 ELSE 1500 END UNION ALL SELECT 'warning', 'slow-redirect', url, 'https://site.test/p/' || final_id, 'budgetMs=500; durationMs=' || id % 900 || '; status=301' FROM f WHERE hops > 0 AND id % 900 > 500",
    "incomplete_reasons": WITH + "SELECT completion, count(DISTINCT url) AS routes FROM f WHERE completion <> 'complete' GROUP BY 1",
    "crawl_depth": WITH + ", d(id, depth) AS (SELECT 0::BIGINT, 0::BIGINT UNION SELECT e.dst, depth + 1 FROM d JOIN e ON e.src = d.id WHERE depth < 60) SELECT url, coalesce(m, -1) AS depth FROM f LEFT JOIN (SELECT id, min(d.depth) AS m FROM d GROUP BY id) x USING (id)",
    "bounded_crawl": WITH + ", " + _crawl(40, 6),
    "robots_decision": WITH + "SELECT url, 'Googlebot/2.1' AS agent, NOT ((x LIKE '4%' OR x LIKE '%7') AND NOT x LIKE '44%') AS allowed FROM (SELECT url, id::VARCHAR AS x FROM f) UNION ALL SELECT url, 'Other', NOT (x LIKE '1%3%' OR x = '2') FROM (SELECT url, id::VARCHAR AS x FROM f)",
    "candidate_merge": WITH + """, r AS (SELECT '/p/' || id AS p, 0 AS depth, 'sitemap' || id % 3 AS detail, true AS s, NULL AS m, id FROM f WHERE id % 2 = 0
UNION ALL SELECT '/p/' || id % 50, 1, 'build' || id % 3, false, CASE WHEN id % 2 = 0 THEN 'static' ELSE 'isr' END, id FROM f WHERE id % 3 = 0
UNION ALL SELECT '/p/' || id || '?a=' || id || '&b=2', 2, 'list' || id % 3, false, NULL, id FROM f WHERE id % 7 = 0)
SELECT 'https://site.test' || p AS url, min(depth)::BIGINT AS depth, count(DISTINCT detail) AS sources, bool_or(s) AS in_sitemap, arg_min(m, id) FILTER (m IS NOT NULL) AS render_mode FROM r WHERE NOT p LIKE '/p/3%' GROUP BY p""",
    "redirect_contracts": WITH + "," + _CONTRACTS + "SELECT * FROM kf",
    "contract_outcomes": WITH + "," + _CONTRACTS + "SELECT count(*) AS contracts, count(*) FILTER (done AND url NOT IN (SELECT url FROM kf)) AS verified, count(*) FILTER (done AND url IN (SELECT url FROM kf)) AS failed, count(*) FILTER (NOT done) AS unchecked, 0::BIGINT AS pattern_matches FROM k",
    "redirect_patterns": WITH + "SELECT url AS \"from\", replace(url, '/p/', '/new/') AS \"to\", 'https://site.test/p/*' AS declared_pattern FROM f UNION ALL VALUES (NULL, NULL, 'https://site.test/p/*/*'), (NULL, NULL, 'https://site.test/docs/**')",
    "report_diff": WITH + "," + _PROFILE + _diff(),
    "finding_diff": WITH + "," + _PROFILE + "SELECT url, 'added' AS kind, 'finding-added:' || code AS code, cs AS severity FROM j WHERE bs IS NULL UNION ALL SELECT url, 'removed', 'finding-resolved:' || code, 'info' FROM j WHERE cs IS NULL UNION ALL SELECT url, 'changed', 'finding-severity:' || code, cs FROM j WHERE bs <> cs",
    "changed_only": WITH + "," + _PROFILE + f"SELECT url, code, cs AS severity, {_CHANGE} AS change FROM j WHERE {_CHANGE} IN ('new', 'worsened')",
    "changed_counts": WITH + "," + _PROFILE + "SELECT " + ", ".join(f"count(*) FILTER ({_CHANGE} = '{x}') AS {x}" for x in ("new", "worsened", "resolved", "unchanged")) + " FROM j",
    "events_first_wins": "SELECT user_id, arg_min(event_type, {'t': ts, 'i': event_id}) AS event_type, arg_min(event_id, {'t': ts, 'i': event_id}) AS event_id FROM events GROUP BY user_id",
}
