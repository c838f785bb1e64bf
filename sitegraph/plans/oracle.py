"""DuckDB oracle SQL per registered query (same column names as the Spark side).

The oracles compute the expected rows straight from the driver tables, without
the XML / HTML parsing that the Spark side performs on the bound documents.
"""

from __future__ import annotations

# Root-relative hrefs only occur in the driver pages, so base || href is the join.
PAGE_LINKS = r"""
WITH p AS (
  SELECT page_id, regexp_extract(url, '^([^:/?#]+://[^/?#]*)', 1) AS base,
         regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
           '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS h
  FROM pages),
a AS (
  SELECT page_id, base, t.href, t.ord
  FROM p, unnest(regexp_extract_all(h, '<a\s[^>]*href="([^"]*)"', 1)) WITH ORDINALITY AS t(href, ord)),
j AS (
  SELECT page_id, base || replace(href, '&amp;', '&') AS url, ord FROM a
  WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')
    AND NOT starts_with(href, 'mailto:') AND NOT starts_with(href, 'tel:')),
d AS (SELECT page_id, url, min(ord) AS first_ord FROM j GROUP BY page_id, url)
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first_ord) AS pos, url
FROM d
"""

B1_COMPANIES = r"""
  SELECT page_id AS _ord,
         CASE WHEN page_id % 17 = 0 THEN '  '
              ELSE (CASE WHEN page_id % 5 = 0 THEN ' ' ELSE '' END)
                   || (CASE WHEN page_id % 2 = 0 THEN upper(host) ELSE host END) END AS company,
         CASE WHEN page_id % 3 = 0 THEN host ELSE 'https://' || host END AS website
  FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages)
"""

COMPANY_NORMALIZE = f"""
WITH raw AS ({B1_COMPANIES}),
t AS (SELECT _ord, trim(company) AS company, trim(website) AS website FROM raw),
f AS (SELECT _ord, company,
             CASE WHEN starts_with(website, 'http://') OR starts_with(website, 'https://') THEN website
                  ELSE 'https://' || website END AS website_url
      FROM t WHERE company IS NOT NULL AND website IS NOT NULL AND length(company) > 0 AND length(website) > 0)
SELECT _ord, company, website_url, lower(company) || ':' || lower(website_url) AS unique_key FROM f
"""

COMPANY_DEDUPE = f"""
SELECT _ord, company, website_url, unique_key FROM ({COMPANY_NORMALIZE})
QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY _ord) = 1
"""

JOB_ACK = f"""
SELECT _ord, company AS "Company", website_url AS "Website", 'Queued for processing' AS "Processing",
       'job_' || sha256('upload-1:' || unique_key) AS "Job ID"
FROM ({COMPANY_DEDUPE})
"""

PG = "SELECT page_id, url, html, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages"
KINDS = f"SELECT DISTINCT host, length(host) % 3 AS kind FROM ({PG})"
SITES = f"""SELECT DISTINCT regexp_extract(website_url, '^([^:/?#]+://[^/?#]*)', 1) AS base_domain,
                   regexp_extract(website_url, '^[^:/?#]+://([^/?#]*)', 1) AS host FROM ({COMPANY_DEDUPE})"""

SITE_FRONTIER = f"""
SELECT s.base_domain, p.path_pos, s.base_domain || p.path AS sitemap_url
FROM ({SITES}) s CROSS JOIN (VALUES (0, '/sitemap.xml'), (1, '/sitemaps.xml'), (2, '/sitemap_index.xml'),
  (3, '/sitemap-index.xml'), (4, '/wp-sitemap.xml'), (5, '/site-map.xml'), (6, '/sitemap.php'),
  (7, '/sitemap.txt'), (8, '/sitemap/sitemap.xml')) AS p(path_pos, path)
"""

ROBOTS_DIRECTIVES = f"""
SELECT s.base_domain, d.dir_pos, s.base_domain || d.path AS sitemap_url
FROM ({SITES}) s JOIN ({KINDS}) k ON s.host = k.host AND k.kind = 0
CROSS JOIN (VALUES (2, '/missing.xml'), (3, '/sm.xml')) AS d(dir_pos, path)
"""


def _urlset(escaped: bool = False) -> str:
    u = "replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')" if escaped else "url"
    return f"""
WITH pg AS ({PG}), u AS (SELECT host, {u} AS url, min(page_id) AS first_id FROM pg GROUP BY host, {u})
SELECT 'https://' || host || '/sm.xml' AS sitemap_url,
       row_number() OVER (PARTITION BY host ORDER BY first_id) AS pos, url
FROM u
"""


DOMAIN_ENTRIES = rf"""
SELECT domain, host, entry, row_number() OVER (PARTITION BY domain ORDER BY host, c) AS epos
FROM (SELECT regexp_extract(host, '([^.]+\.[^.]+)$', 1) AS domain, host, c,
             'https://' || host || CASE WHEN c = 0 THEN '/' ELSE '/sm.xml' END AS entry
      FROM ({KINDS}) CROSS JOIN (VALUES (0), (1)) AS t(c))
"""

INDEX_EXPAND = f"""
SELECT 'https://' || domain || '/sitemap_index.xml' AS index_url, epos AS pos, entry AS child_url
FROM ({DOMAIN_ENTRIES})
"""

INDEX_MALFORMED = f"""
SELECT 'https://' || domain || '/sitemap_index.xml' AS index_url, epos AS pos,
       CASE WHEN ends_with(entry, '.xml') THEN 'child' ELSE 'page' END AS kind, entry AS url
FROM ({DOMAIN_ENTRIES})
"""

SITEMAP_TREE = f"""
WITH e AS ({DOMAIN_ENTRIES}),
u AS ({_urlset()}),
j AS (SELECT 'https://' || e.domain || '/sitemap_index.xml' AS root, e.epos, u.pos AS upos, u.url
      FROM e JOIN u ON u.sitemap_url = e.entry),
d AS (SELECT root, url, min(epos * 1000000 + upos) AS o FROM j GROUP BY root, url)
SELECT root, row_number() OVER (PARTITION BY root ORDER BY o) AS pos, url FROM d
"""

HOME_LINKS = r"""
WITH pg AS (SELECT page_id, html, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages),
home AS (SELECT host, arg_min(html, page_id) AS html FROM pg WHERE length(host) % 3 = 2 GROUP BY host),
p AS (SELECT host, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'),
           '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g') AS h FROM home),
a AS (SELECT host, t.href, t.ord
      FROM p, unnest(regexp_extract_all(h, '<a\s[^>]*href="([^"]*)"', 1)) WITH ORDINALITY AS t(href, ord)),
j AS (SELECT host, 'https://' || host || replace(href, '&amp;', '&') AS url, ord FROM a
      WHERE href <> '' AND NOT starts_with(href, '#') AND NOT starts_with(href, 'javascript:')
        AND NOT starts_with(href, 'mailto:') AND NOT starts_with(href, 'tel:')),
d AS (SELECT host, url, min(ord) AS first_ord FROM j GROUP BY host, url)
SELECT host, row_number() OVER (PARTITION BY host ORDER BY first_ord) AS pos, url FROM d
"""

SITE_LISTS = f"""
WITH sm AS ({_urlset()}),
allu AS (SELECT regexp_extract(sitemap_url, '^https://([^/]+)', 1) AS host, pos, url FROM sm
         WHERE length(regexp_extract(sitemap_url, '^https://([^/]+)', 1)) % 3 < 2
         UNION ALL SELECT host, pos, url FROM ({HOME_LINKS}))
SELECT host, (pos - 1) // 1000 + 1 AS part, count(*) AS n_urls, string_agg(url, ', ' ORDER BY pos) AS sitemap_complete,
       string_agg(url, ',' ORDER BY pos) AS key_urls, string_agg(url, chr(10) ORDER BY pos) AS prompt_urls
FROM allu GROUP BY host, part
"""

SITE_URL_LISTS = f"""
WITH cs AS (SELECT _ord, company, website_url, regexp_extract(website_url, '^[^:/?#]+://([^/?#]*)', 1) AS host
            FROM ({COMPANY_DEDUPE})),
agg AS ({SITE_LISTS})
SELECT cs._ord, cs.company, cs.website_url,
       CASE WHEN agg.host IS NULL THEN 'none' WHEN length(cs.host) % 3 = 0 THEN 'robots'
            WHEN length(cs.host) % 3 = 1 THEN 'sitemap' ELSE 'html' END AS source, coalesce(agg.part, 1) AS part,
       coalesce(agg.n_urls, 0) AS n_urls, coalesce(agg.sitemap_complete, '') AS sitemap_complete
FROM cs LEFT JOIN agg ON cs.host = agg.host
"""

def _lit(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


from .stream_queries import KEEP_MINUTES, UPLOAD_MINUTES  # noqa: E402
from ..operators.insights import _PROMPT_HEAD, _PROMPT_TAIL  # noqa: E402
from ..operators.jobs import ALL_DONE_TEXT as J_DONE, DONE_WITH_ERRORS_TEXT as J_DONE_ERR  # noqa: E402

LISTS_FULL = f"""
WITH cs AS (SELECT _ord, company, website_url, unique_key, regexp_extract(website_url, '^[^:/?#]+://([^/?#]*)', 1) AS host
            FROM ({COMPANY_DEDUPE})),
agg AS ({SITE_LISTS})
SELECT cs._ord, cs.company, cs.website_url, cs.unique_key, coalesce(agg.part, 1) AS part, coalesce(agg.n_urls, 0) AS n_urls,
       coalesce(agg.sitemap_complete, '') AS sitemap_complete,
       md5(cs.company || ':' || coalesce(agg.key_urls, '')) AS key,
       {_lit(_PROMPT_HEAD)} || coalesce(agg.prompt_urls, '') || {_lit(_PROMPT_TAIL)} AS prompt
FROM cs LEFT JOIN agg ON cs.host = agg.host
"""

INSIGHT_PROMPTS = f"SELECT _ord, company, part, key, prompt FROM ({LISTS_FULL})"

INSIGHT_ROWS = f"""
SELECT *, substr(key, 1, 1) < '8' AS cached,
       CASE WHEN substr(key, 1, 1) < '8' THEN 'cached:' || key
            WHEN n_urls = 0 THEN 'Error: Error generating AI insights: no URLs to analyse. Please try again later.'
            ELSE '- Company Overview: ' || length(prompt) || ' characters' END AS insight
FROM ({LISTS_FULL})
"""

INSIGHT_CACHE_JOIN = f"SELECT _ord, company, part, key, cached, insight FROM ({INSIGHT_ROWS})"

COMPANY_DOCUMENTS = f"""
SELECT _ord, company AS company_name, website_url, part, n_urls, sitemap_complete, insight AS ai_insights,
       1717200000.0::DOUBLE AS last_updated, lower(company) AS company_name_normalized
FROM ({INSIGHT_ROWS})
"""

RESULTS_ROWS = f"""
SELECT company AS "Company", website_url AS "Website", sitemap_complete AS "Sitemap Complete",
       insight AS "Insight from Prompt", part AS "Part" FROM ({INSIGHT_ROWS})
"""

# without a cache: every key goes to the (stub) model
MODEL_ROWS = f"""
SELECT *, CASE WHEN n_urls = 0 THEN 'Error: Error generating AI insights: no URLs to analyse. Please try again later.'
            ELSE '- Company Overview: ' || length(prompt) || ' characters' END AS answer
FROM ({LISTS_FULL})
"""

BROKEN = f"""
SELECT _ord + 1000000000000 AS _ord, trim(company) AS company, 'https://[bad-' || company AS website_url
FROM ({B1_COMPANIES}) WHERE _ord % 7 = 0 AND length(trim(company)) > 0
"""

PROCESSED_JOBS = f"""
SELECT _ord, part, 'job_' || sha256('upload-1:' || unique_key) AS job_id, 'complete' AS status, NULL AS message, company,
       answer AS insight FROM ({MODEL_ROWS})
UNION ALL
SELECT _ord, 1 AS part, 'job_' || sha256('upload-1:' || unique_key) AS job_id, 'error' AS status,
       'Worker error: Invalid URL: ' || website_url AS message, NULL AS company, NULL AS insight
FROM (SELECT _ord, company, trim(website_url) AS website_url, lower(company) || ':' || lower(trim(website_url)) AS unique_key FROM ({BROKEN}))
QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY _ord) = 1
"""

PROCESSED_STORE = f"""
SELECT company AS company_name, website_url, part, n_urls, 1717200000.0::DOUBLE AS last_updated FROM ({LISTS_FULL})
QUALIFY row_number() OVER (PARTITION BY company, part ORDER BY _ord DESC) = 1
"""

UPLOADED = f"SELECT company, website_url, count(*) AS n_rows FROM ({COMPANY_NORMALIZE}) GROUP BY company, website_url"

B5 = """
SELECT event_id, user_id, event_type, epoch_us(ts) / 1e6 AS ts_s,
       CASE WHEN event_id % 2 = 1 THEN upper('Company ' || user_id) ELSE 'Company ' || user_id END AS company_name,
       CASE WHEN event_id * 2 < count(*) OVER () THEN 0 ELSE 1 END AS half
FROM events
"""

UPSERTED = f"""
WITH e AS ({B5}),
st AS (SELECT company_name, 'https://c' || user_id || '.example.com/' || event_type AS website_url,
              'https://c' || user_id || '.example.com/' || event_type AS sitemap_complete,
              event_type AS ai_insights, ts_s AS last_updated
       FROM e WHERE half = 0
       QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY ts_s DESC, event_id DESC) = 1),
up AS (SELECT company_name, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS ai_insights,
              coalesce(CASE WHEN event_type = 'signup' THEN NULL ELSE ts_s END, 1717200000.0) AS last_updated
       FROM e WHERE half = 1
       QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY event_id DESC) = 1)
SELECT coalesce(up.company_name, st.company_name) AS company_name, st.website_url, st.sitemap_complete,
       CASE WHEN up.company_name IS NOT NULL THEN up.ai_insights ELSE st.ai_insights END AS ai_insights,
       CASE WHEN up.company_name IS NOT NULL THEN up.last_updated ELSE st.last_updated END AS last_updated,
       lower(coalesce(up.company_name, st.company_name)) AS company_name_normalized,
       st.company_name IS NOT NULL AND up.company_name IS NOT NULL AS matched,
       st.company_name IS NULL AS inserted,
       st.company_name IS NOT NULL AND up.company_name IS NOT NULL
         AND (st.ai_insights IS DISTINCT FROM up.ai_insights OR st.last_updated IS DISTINCT FROM up.last_updated)
         AS modified
FROM st FULL OUTER JOIN up ON st.company_name = up.company_name
"""

STORE_UPSERT = f"""SELECT company_name, website_url, sitemap_complete, ai_insights, last_updated,
                          company_name_normalized FROM ({UPSERTED})"""

STORE_UPSERT_COUNTS = f"""
SELECT count(*) FILTER (WHERE inserted) AS inserted, count(*) FILTER (WHERE modified) AS modified,
       count(*) FILTER (WHERE matched) AS matched, count(*) AS total FROM ({UPSERTED})
"""

STORE_LATEST = f"""
SELECT company_name, website_url, sitemap_complete, ai_insights, last_updated, company_name_normalized
FROM ({STORE_UPSERT})
QUALIFY row_number() OVER (PARTITION BY company_name_normalized
                           ORDER BY last_updated DESC NULLS LAST, company_name) = 1
"""

STORE_LOOKUP = f"""
WITH s AS ({STORE_UPSERT}),
u AS (SELECT DISTINCT user_id FROM events),
names AS (SELECT DISTINCT probe FROM (
  SELECT 'Company ' || user_id AS probe FROM u UNION ALL SELECT upper('Company ' || user_id) FROM u
  UNION ALL SELECT lower('Company ' || user_id) FROM u)),
webs AS (SELECT DISTINCT probe FROM (
  SELECT 'https://c' || user_id || '.example.com/view' AS probe FROM u
  UNION ALL SELECT 'https://c' || user_id || '.example.com/none' FROM u)),
w1 AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY website_url ORDER BY company_name) = 1)
SELECT 'name' AS by, n.probe, s.company_name IS NOT NULL AS found, s.company_name, s.website_url, s.ai_insights,
       s.last_updated
FROM names n LEFT JOIN s ON n.probe = s.company_name
UNION ALL
SELECT 'website' AS by, w.probe, w1.company_name IS NOT NULL AS found, w1.company_name, w1.website_url,
       w1.ai_insights, w1.last_updated
FROM webs w LEFT JOIN w1 ON w.probe = w1.website_url
"""

# the latest state of every job (the log also has each job's queued state)
JOBS = """
SELECT 'job_' || event_id AS job_id, user_id AS batch_id, event_id * 2 + 1001 AS seq,
       CASE WHEN event_type = 'error' THEN 'error' WHEN event_type = 'signup' THEN 'queued' ELSE 'complete' END
         AS status,
       'Company ' || (event_id % 500) AS company, 'https://c' || (event_id % 500) || '.example.com' AS website,
       event_type, props, epoch_us(ts) / 1e6 AS ts_s
FROM events
"""

RESULTS_DEDUPE = f"""
SELECT min(seq) AS pos, company AS "Company", arg_max(website, seq) AS "Website",
       arg_max(website || '/' || event_type, seq) AS "Sitemap Complete", arg_max(props, seq) AS "Insight from Prompt"
FROM ({JOBS}) WHERE status = 'complete' GROUP BY company
"""

JOB_STATUS_LOOKUP = f"""
WITH p AS (SELECT DISTINCT 'job_' || (event_id * 2) AS job_id FROM events)
SELECT p.job_id, coalesce(j.status, 'not found') AS status,
       CASE WHEN j.status = 'error' THEN 'Worker error: ' || j.props END AS message
FROM p LEFT JOIN ({JOBS}) j ON p.job_id = j.job_id
"""

PROGRESS_AGG = f"""
SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE status IN ('complete', 'error')) AS completed,
       coalesce(bool_or(status = 'error'), false) AS has_errors, min(ts_s) AS start_s, max(ts_s) AS now_s
FROM ({JOBS}) GROUP BY batch_id
"""

JOB_PROGRESS = f"""
SELECT batch_id, total, completed, has_errors, total - completed AS remaining,
       CAST(floor(CASE WHEN total > 0 THEN completed / total * 100 ELSE 0.0 END + 0.5) AS BIGINT) AS percent,
       'Completed: ' || completed || ' of ' || total || ' companies' AS completed_text,
       CASE WHEN total - completed = 0 AND has_errors THEN {_lit(J_DONE_ERR)}
            WHEN total - completed = 0 THEN {_lit(J_DONE)}
            ELSE 'Processing... ' || (total - completed)
                 || CASE WHEN total - completed = 1 THEN ' company' ELSE ' companies' END || ' remaining.' END
         AS status_text
FROM ({PROGRESS_AGG})
"""


def _unit(n: str, word: str) -> str:
    return f"CAST({n} AS BIGINT) || ' {word}' || CASE WHEN {n} > 1 THEN 's' ELSE '' END"


_REM = "((now_s - start_s) / completed * (total - completed))"
_MIN = f"floor({_REM} / 60 + 0.5)"
_HRS = f"floor({_REM} / 3600)"
_HMIN = f"floor(({_REM} % 3600) / 60 + 0.5)"

JOB_ETA = f"""
SELECT batch_id, total, completed, CASE WHEN completed > 0 THEN {_REM} END AS remaining_seconds,
       CASE WHEN total - completed = 0 THEN ''
            WHEN completed = 0 THEN 'Estimated time remaining: Calculating...'
            WHEN {_REM} < 60 THEN 'Estimated time remaining: Less than a minute'
            WHEN {_REM} < 3600 THEN 'Estimated time remaining: About ' || {_unit(_MIN, 'minute')}
            ELSE 'Estimated time remaining: About ' || {_unit(_HRS, 'hour')} || ' and ' || {_unit(_HMIN, 'minute')}
       END AS eta_text
FROM ({PROGRESS_AGG})
"""

QUEUE_SIZES = f"""
SELECT count(*) FILTER (WHERE status = 'queued') AS queue_size,
       count(*) FILTER (WHERE status <> 'queued') AS results_size FROM ({JOBS})
"""

STATUS_JSON = f"""
SELECT job_id,
       CASE WHEN status = 'complete' THEN
         json_object('status', status, 'data', json_object('Company', company, 'Website', website,
                     'Sitemap Complete', website || '/' || event_type, 'Insight from Prompt', props))::VARCHAR
       ELSE json_object('status', status, 'message', 'Worker error: ' || props)::VARCHAR END AS json
FROM ({JOBS}) WHERE status <> 'queued'
"""

STORE_COMPACTION = f"""
SELECT s.*, t.stage FROM ({STORE_UPSERT}) s CROSS JOIN (VALUES ('deltas'), ('compacted')) AS t(stage)
"""

# One upload after the other: the watermark before an upload is the greatest time so far less the delay. A key is kept
# if its upload is ahead of the watermark and no kept row of the key is still remembered.
STREAM_DEDUPE_WITHIN = f"""
WITH RECURSIVE sent AS (
  SELECT upload, minute, max(minute) OVER (ORDER BY upload ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - {KEEP_MINUTES} AS mark
  FROM (VALUES {", ".join(f"({i}, {m})" for i, m in enumerate(UPLOAD_MINUTES))}) AS u(upload, minute)),
r AS (
  SELECT event_id AS _ord, CASE WHEN event_id % 2 = 1 THEN upper('Company ' || user_id) ELSE 'Company ' || user_id END AS company,
         'https://c' || user_id || '.example.com/' || event_type AS website_url,
         CAST(floor(event_id * {len(UPLOAD_MINUTES)} / count(*) OVER ()) AS INTEGER) AS upload FROM events),
f AS (
  SELECT upload, lower(company) || ':' || lower(website_url) AS unique_key, min(_ord) AS _ord FROM r GROUP BY upload, unique_key),
keys AS (SELECT DISTINCT unique_key FROM f),
walk AS (
  SELECT -1 AS upload, unique_key, CAST(NULL AS INTEGER) AS last, false AS kept FROM keys
  UNION ALL
  SELECT upload, unique_key, CASE WHEN keep THEN minute ELSE last END, keep FROM (
    SELECT s.upload, w.unique_key, w.last, s.minute,
           f._ord IS NOT NULL AND coalesce(s.minute > s.mark, true) AND coalesce(w.last + {KEEP_MINUTES} <= s.mark, w.last IS NULL) AS keep
    FROM walk w JOIN sent s ON s.upload = w.upload + 1 LEFT JOIN f ON f.upload = s.upload AND f.unique_key = w.unique_key))
SELECT w.upload, w.unique_key, f._ord, r.company, r.website_url
FROM walk w JOIN f ON w.kept AND f.upload = w.upload AND f.unique_key = w.unique_key JOIN r ON r._ord = f._ord
"""

# the limits of the query: 3 URLs of a urlset, 4 links of a page, 3 URLs of a list, 2 of a prompt
LIMITED_PROMPTS = f"""
WITH sm AS ({_urlset()}),
allu AS (SELECT regexp_extract(sitemap_url, '^https://([^/]+)', 1) AS host, pos, url FROM sm
         WHERE length(regexp_extract(sitemap_url, '^https://([^/]+)', 1)) % 3 < 2 AND pos <= 3
         UNION ALL SELECT host, pos, url FROM ({HOME_LINKS}) WHERE pos <= 3),
agg AS (SELECT host, count(*) AS n_urls, string_agg(url, ',' ORDER BY pos) FILTER (pos <= 2) AS key_urls,
               string_agg(url, chr(10) ORDER BY pos) FILTER (pos <= 2) AS prompt_urls FROM allu GROUP BY host),
cs AS (SELECT _ord, company, regexp_extract(website_url, '^[^:/?#]+://([^/?#]*)', 1) AS host FROM ({COMPANY_DEDUPE}))
SELECT cs._ord, cs.company, CASE WHEN agg.host IS NULL THEN 'none' WHEN length(cs.host) % 3 = 0 THEN 'robots'
            WHEN length(cs.host) % 3 = 1 THEN 'sitemap' ELSE 'html' END AS source, coalesce(agg.n_urls, 0) AS n_urls,
       md5(cs.company || ':' || coalesce(agg.key_urls, '')) AS key,
       {_lit(_PROMPT_HEAD)} || coalesce(agg.prompt_urls, '') || {_lit(_PROMPT_TAIL)} AS prompt
FROM cs LEFT JOIN agg ON cs.host = agg.host
"""

UPLOADED_MULTILINE = f"""
WITH t AS (SELECT regexp_replace(company || ', "of"' || chr(10) || 'branch ' || (_ord % 3), '^\\s+', '') AS company, trim(website) AS website
           FROM ({B1_COMPANIES}))
SELECT company, CASE WHEN starts_with(website, 'http://') OR starts_with(website, 'https://') THEN website ELSE 'https://' || website END AS website_url,
       count(*) AS n_rows
FROM t WHERE length(website) > 0 GROUP BY ALL
"""

ORACLE = {
    "uploaded_multiline": UPLOADED_MULTILINE,
    "sitemap_top": f"SELECT root, pos, url FROM ({SITEMAP_TREE}) WHERE pos <= 5",
    "limited_prompts": LIMITED_PROMPTS,
    "store_compaction": STORE_COMPACTION,
    "stream_eta": JOB_ETA,
    "stream_queue_sizes": QUEUE_SIZES,
    "stream_dedupe_within": STREAM_DEDUPE_WITHIN,
    "stream_dedupe": f"SELECT company, website_url, unique_key FROM ({COMPANY_DEDUPE})",
    "processed_jobs": PROCESSED_JOBS,
    "processed_store": PROCESSED_STORE,
    "uploaded_companies": UPLOADED,
    "results_csv": f'SELECT "Company", "Website", "Sitemap Complete", "Insight from Prompt" FROM ({RESULTS_DEDUPE})',
    "store_reset": f"""
WITH e AS ({B5})
SELECT company_name, CASE WHEN event_type = 'error' THEN NULL ELSE event_type END AS ai_insights,
       coalesce(CASE WHEN event_type = 'signup' THEN NULL ELSE ts_s END, 1717200000.0) AS last_updated,
       lower(company_name) AS company_name_normalized
FROM e WHERE half = 1 QUALIFY row_number() OVER (PARTITION BY company_name ORDER BY event_id DESC) = 1""",
    "stream_company_upsert": STORE_UPSERT,
    "stream_status": JOB_PROGRESS,
    "stream_job_status": f"""SELECT job_id, status, CASE WHEN status = 'error' THEN 'Worker error: ' || props END
                             AS message FROM ({JOBS})""",
    "insight_prompts": INSIGHT_PROMPTS,
    "insight_cache_join": INSIGHT_CACHE_JOIN,
    "company_documents": COMPANY_DOCUMENTS,
    "results_rows": RESULTS_ROWS,
    "store_upsert": STORE_UPSERT,
    "store_upsert_counts": STORE_UPSERT_COUNTS,
    "store_latest": STORE_LATEST,
    "store_lookup": STORE_LOOKUP,
    "results_dedupe": RESULTS_DEDUPE,
    "job_status_lookup": JOB_STATUS_LOOKUP,
    "job_progress": JOB_PROGRESS,
    "job_eta": JOB_ETA,
    "queue_sizes": QUEUE_SIZES,
    "status_json": STATUS_JSON,
    "site_frontier": SITE_FRONTIER,
    "robots_directives": ROBOTS_DIRECTIVES,
    "urlset_expand": _urlset(),
    "urlset_malformed": _urlset(escaped=True),
    "index_expand": INDEX_EXPAND,
    "index_malformed": INDEX_MALFORMED,
    "sitemap_tree": SITEMAP_TREE,
    "site_url_lists": SITE_URL_LISTS,
    "company_normalize": COMPANY_NORMALIZE,
    "company_dedupe": COMPANY_DEDUPE,
    "job_ack": JOB_ACK,
    "submission_ack": f"""SELECT 'processing' AS status, count(*) AS n_jobs,
                              'Processing ' || count(*) || ' companies' AS message FROM ({JOB_ACK})""",
    "page_links": PAGE_LINKS,
}
