"""One DuckDB query per registered query, over the given tables."""

from oracles.fragments import (
    BFS,
    CR,
    CR2,
    CT,
    FL,
    FP,
    G,
    HOST,
    JSONLD,
    META,
    ORIGIN,
    PX,
    RB,
    SEED,
    SEED_ROOTS,
    SM,
    WL,
    anchors,
    normalized,
    page_links_of,
    percent_of,
    rfc3339,
    sitemap_leaves,
    tag_values,
    unescape,
    uniform,
)

BIAS = 0.7


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n"


SHOWN = f"""url, depth, status_code, content_length, title, link_count,
  {rfc3339('crawled_at')} AS crawled_at, error"""

LATEST = """latest AS (
  SELECT * FROM (SELECT * FROM cr UNION ALL SELECT * FROM cr2)
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY batch_seq DESC, crawled_at DESC) = 1)"""

INDEX_SEEDS = f"""index_seeds AS (
  SELECT DISTINCT url FROM pages
  WHERE ends_with({HOST.format('url')}, '.example.com') OR {HOST.format('url')} = 'example.com')"""

CT_SEEDS = """ct_seeds AS (
  SELECT concat('https://', name) AS url FROM ct WHERE ends_with(name, 'example.com'))"""

TITLE = unescape("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")

JS = """strlen(html) < 500 OR contains(lower(html), '<div id="root"></div>')
  OR contains(lower(html), '<div id="app"></div>')
  OR contains(lower(html), '<noscript>you need to enable javascript')
  OR contains(lower(html), 'javascript is required')
  OR contains(lower(html), 'please enable javascript')
  OR contains(lower(html), '__next_data__') OR contains(lower(html), 'ng-app')
  OR contains(lower(html), 'v-app') OR contains(lower(html), 'data-reactroot')"""

STREAK = f"""{FL},
marked AS (
  SELECT *, sum(CASE WHEN status_code = 200 AND NOT failed THEN 1 ELSE 0 END)
    OVER (PARTITION BY host ORDER BY ts, url, attempt ROWS UNBOUNDED PRECEDING) AS grp FROM fl),
streaks AS (
  SELECT *, CAST(sum(CASE WHEN failed THEN 1 ELSE 0 END)
    OVER (PARTITION BY host, grp ORDER BY ts, url, attempt ROWS UNBOUNDED PRECEDING) AS BIGINT)
    AS streak FROM marked),
waits AS (
  SELECT *, CASE WHEN failed THEN CAST(least(1000 * pow(2, least(streak, 10)), 30000) AS BIGINT)
    * CASE WHEN status_code = 429 THEN 2 ELSE 1 END END AS backoff_ms FROM streaks),
as_of AS (SELECT max(ts) AS t FROM fl WHERE failed),
retry_stats AS (
  SELECT host, max_by(streak, (ts, url, attempt)) AS consecutive_fails,
    max(ts) FILTER (WHERE failed) AS last_fail_time,
    CASE WHEN max_by(streak, (ts, url, attempt)) > 0 THEN
      epoch_us(max(ts) FILTER (WHERE failed))
      + 1000 * max_by(backoff_ms, (ts, url, attempt)) FILTER (WHERE failed) END AS backoff_until_us
  FROM waits, as_of WHERE ts <= t GROUP BY host)"""

BACKOFF_FOLD = f"""{FL},
numbered AS (
  SELECT *, epoch_us(ts) AS us,
    row_number() OVER (PARTITION BY host ORDER BY ts, url, attempt) AS n FROM fl),
folded AS (
  SELECT DISTINCT host, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS fails,
    CAST(0 AS BIGINT) AS until_us FROM fl
  UNION ALL
  SELECT e.host, e.n,
    CASE WHEN e.failed THEN f.fails + 1 WHEN e.status_code = 200 THEN 0 ELSE f.fails END,
    CASE WHEN e.failed THEN e.us + CASE WHEN e.status_code = 429 THEN 2 ELSE 1 END *
        CASE WHEN e.us < f.until_us THEN f.until_us - e.us
             ELSE CAST(least(1000 * pow(2, least(f.fails + 1, 10)), 30000) AS BIGINT) * 1000 END
      WHEN e.status_code = 200 THEN 0 ELSE f.until_us END
  FROM folded f JOIN numbered e ON e.host = f.host AND e.n = f.n + 1)"""

SESSIONS = """numbered AS (
  SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n
  FROM events),
walk AS (
  SELECT user_id, event_id, n, ts AS started, 1 AS used, CAST(1 AS BIGINT) AS session_no
  FROM numbered WHERE n = 1
  UNION ALL
  SELECT e.user_id, e.event_id, e.n,
    CASE WHEN e.ts - w.started > INTERVAL 86400 SECONDS OR w.used >= 10 THEN e.ts ELSE w.started END,
    CASE WHEN e.ts - w.started > INTERVAL 86400 SECONDS OR w.used >= 10 THEN 1 ELSE w.used + 1 END,
    CASE WHEN e.ts - w.started > INTERVAL 86400 SECONDS OR w.used >= 10
         THEN w.session_no + 1 ELSE w.session_no END
  FROM walk w JOIN numbered e ON e.user_id = w.user_id AND e.n = w.n + 1)"""

WL_LINKS = f"""{WL},
{normalized("SELECT page_id, pos, href, url AS base FROM wl")},
wl_norm AS (SELECT wl.*, norm.link FROM wl LEFT JOIN norm USING (page_id, pos))"""

OUT_ERROR = """CASE WHEN NOT d.allowed THEN 'blocked by robots.txt'
  WHEN o.status_code <> 200 THEN concat('non-200 status: ', o.status_code) END"""

ERROR_CLASS = """CASE WHEN starts_with(error, 'blocked by robots.txt') THEN 'blocked by robots.txt'
  WHEN starts_with(error, 'request failed') THEN 'request failed'
  WHEN starts_with(error, 'non-200 status') THEN 'non-200 status' ELSE 'other' END"""

GRAPH_TARGETS = "SELECT DISTINCT target_url AS url FROM g"

ORACLES: dict[str, str] = {
    # sources
    "scan_results_jsonl": with_(CR) + f"SELECT {SHOWN} FROM cr",
    "scan_store_tables": with_(PX, META, JSONLD, normalized(anchors("px")))
    + """SELECT 'pages' AS name, count(*) AS row_count, count(DISTINCT url) AS urls FROM pages
      UNION ALL SELECT 'links', count(*), count(DISTINCT base) FROM norm
      UNION ALL SELECT 'meta_tags', count(*), count(DISTINCT url) FROM meta
      UNION ALL SELECT 'structured_data', count(*), count(DISTINCT url) FROM jsonld""",
    "scan_html_pages": """SELECT page_id, url, CAST(strlen(html) AS BIGINT) AS content_length,
      md5(html) AS html_md5 FROM pages""",
    "sitemap_locs": with_(SM) + "SELECT sitemap_url, pos, loc FROM sm_locs",
    "sitemap_index_expand": with_(
        sitemap_leaves(f"SELECT '{SEED}/sitemap.xml' AS sitemap_url"), recursive=True
    )
    + "SELECT sitemap_url, pos, loc FROM leaves",
    "sitemap_candidates": f"""SELECT url, concat({ORIGIN.format('url')}, p) AS sitemap_url
      FROM pages, (SELECT unnest(['/sitemap.xml', '/sitemap_index.xml', '/sitemap-index.xml']) AS p)""",
    "robots_sitemaps": with_(RB)
    + """SELECT robots_url, trim(substr(line, 9)) AS sitemap_url
      FROM (SELECT robots_url, unnest(string_split(body, chr(10))) AS line FROM rb)
      WHERE starts_with(lower(line), 'sitemap:')""",
    "seed_sitemap": with_(sitemap_leaves(SEED_ROOTS), recursive=True)
    + "SELECT loc AS url FROM leaves",
    "seed_ct": with_(CT, CT_SEEDS) + "SELECT url FROM ct_seeds",
    "seed_crawl_index": with_(INDEX_SEEDS) + "SELECT url FROM index_seeds",
    "seed_union": with_(sitemap_leaves(SEED_ROOTS), CT, CT_SEEDS, INDEX_SEEDS, recursive=True)
    + """SELECT url, CASE min(rank) WHEN 0 THEN 'sitemap' WHEN 1 THEN 'ct' ELSE 'crawl_index' END
        AS strategy, 0 AS depth
      FROM (SELECT loc AS url, 0 AS rank FROM leaves UNION ALL SELECT url, 1 FROM ct_seeds
            UNION ALL SELECT url, 2 FROM index_seeds)
      GROUP BY url""",
    "stream_results": with_(CR) + f"SELECT {SHOWN} FROM cr",
    # sinks
    "sink_results_jsonl": with_(CR, CR2)
    + f"SELECT {SHOWN} FROM (SELECT * FROM cr UNION ALL SELECT * FROM cr2)",
    "export_json": with_(CR) + f"SELECT {SHOWN} FROM cr",
    "export_csv": with_(CR)
    + f"""SELECT url AS "URL", status_code AS "StatusCode", content_length AS "ContentLength",
      link_count AS "LinkCount", {rfc3339('crawled_at')} AS "CrawledAt" FROM cr""",
    "export_sitemap": with_(CR)
    + """SELECT url AS loc, CAST(NULL AS VARCHAR) AS lastmod, 'weekly' AS changefreq,
      CAST(0.5 AS DOUBLE) AS priority FROM cr WHERE status_code = 200""",
    "export_sitemap_preset": with_(CR)
    + f"""SELECT url AS loc, {rfc3339('crawled_at')} AS lastmod, 'weekly' AS changefreq,
      CAST(0.8 AS DOUBLE) AS priority FROM cr WHERE status_code = 200""",
    "upsert_pages": with_(CR, CR2, LATEST) + f"SELECT {SHOWN} FROM latest",
    "save_meta_tags": with_(PX, META) + "SELECT url, name, content FROM meta",
    "save_structured_data": with_(PX, JSONLD) + "SELECT url, json_data FROM jsonld",
    "build_links_table": with_(WL_LINKS)
    + """SELECT url AS source_url, link AS target_url, anchor_text,
      CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos
      FROM wl_norm WHERE link IS NOT NULL""",
    # filters
    "query_pages": with_(CR) + f"SELECT {SHOWN} FROM cr WHERE status_code = 200 AND depth = 3",
    "pages_404": with_(CR) + "SELECT url FROM cr WHERE status_code = 404",
    "pages_200_limit": with_(CR)
    + f"SELECT {SHOWN} FROM cr WHERE status_code = 200 ORDER BY url LIMIT 10",
    "pages_with_meta": with_(PX, META)
    + "SELECT url FROM meta WHERE name = 'og:type' AND content = 'article'",
    "link_skip_filter": with_(PX, f"hrefs AS ({anchors('px')})")
    + """SELECT page_id, CAST(pos AS INTEGER) AS pos, href FROM hrefs
      WHERE href <> '' AND NOT regexp_matches(href, '^(#|javascript:|mailto:|tel:)')""",
    "crawl_scope_filter": with_(PX, page_links_of("px"))
    + f"""SELECT page_id, link FROM page_links
      WHERE ends_with({HOST.format('link')}, {HOST.format('url')})""",
    "visible_links": with_(WL)
    + """SELECT page_id, pos, href, round(weight, 6) AS weight FROM wl
      WHERE is_visible AND weight > 0.1""",
    "needs_js_render": with_(PX)
    + f"""SELECT page_id, url, ({JS}) AS needs_js_render FROM (
        SELECT * FROM px
        UNION ALL SELECT -1 - page_id, url, '<div id="root"></div>' FROM px WHERE page_id % 10 = 0)""",
    "retryable": with_(FL)
    + """SELECT url, epoch_us(ts) AS ts_us, attempt, status_code, error FROM fl
      WHERE error IS NOT NULL OR status_code IN (429, 500, 502, 503, 504)""",
    "robots_allowed": with_(RB) + "SELECT page_id, url FROM decided WHERE allowed",
    "hosts_in_backoff": with_(STREAK)
    + """SELECT host, backoff_until_us, round((backoff_until_us - epoch_us(t)) / 1000.0, 3)
        AS remaining_ms FROM retry_stats, as_of WHERE epoch_us(t) < backoff_until_us""",
    "follow_link_sample": with_(WL)
    + f"""SELECT page_id, pos, href FROM wl
      WHERE {uniform('page_id', 'pos', '42')} < CAST({BIAS} AS DOUBLE) * weight""",
    # joins
    "robots_rules_join": with_(RB) + "SELECT page_id, url, allowed, rule FROM decided",
    "frontier_new_urls": with_(PX, page_links_of("px"))
    + """SELECT DISTINCT link AS url FROM page_links
      WHERE link NOT IN (SELECT url FROM pages)""",
    "broken_links": with_(G, CR)
    + """SELECT source_url, target_url, status_code FROM g JOIN cr ON cr.url = g.target_url
      WHERE status_code <> 200""",
    "page_profile": with_(PX, CR, META, JSONLD)
    + """SELECT cr.url, cr.status_code, d.content AS description, o.content AS og_type,
        coalesce(c.n, 0) AS meta_count, c.meta, j.json_data
      FROM cr LEFT JOIN meta d ON d.url = cr.url AND d.name = 'description'
      LEFT JOIN meta o ON o.url = cr.url AND o.name = 'og:type'
      LEFT JOIN (SELECT url, count(*) AS n, string_agg(concat(name, '=', content), chr(10) ORDER BY name) AS meta
        FROM meta GROUP BY url) c ON c.url = cr.url
      LEFT JOIN (SELECT url, string_agg(DISTINCT json_data, chr(10) ORDER BY json_data) AS json_data
        FROM jsonld GROUP BY url) j ON j.url = cr.url""",
    "pending_urls": with_(G)
    + f"""SELECT url FROM ({GRAPH_TARGETS})
      WHERE url NOT IN (SELECT url FROM pages WHERE page_id % 4 <> 0)""",
    # aggregations
    "store_stats": with_(CR)
    + """SELECT count(*) AS total_pages, count(*) FILTER (WHERE status_code = 200)
        AS successful_pages,
      count(*) FILTER (WHERE status_code <> 200 OR error IS NOT NULL) AS failed_pages FROM cr""",
    "crawl_summary": with_(G, CR)
    + """SELECT CAST((SELECT count(*) FROM g) AS BIGINT) AS discovered,
        (SELECT count(DISTINCT target_url) FROM g) AS discovered_unique,
        count(*) FILTER (WHERE error IS NULL) AS processed,
        count(error) AS errors,
        round(CAST(count(*) FILTER (WHERE error IS NULL) - count(error) AS DOUBLE)
          / count(*) FILTER (WHERE error IS NULL) * 100, 6) AS success_rate
      FROM cr""",
    "most_linked_pages": with_(normalized(anchors("pages")))
    + """SELECT link AS target_url, count(*) AS count FROM norm GROUP BY link
      ORDER BY count DESC, target_url LIMIT 10""",
    "link_stats": with_(WL)
    + """SELECT px.page_id, count(wl.pos) AS total_links,
        count(*) FILTER (WHERE is_visible) AS visible_links,
        count(*) FILTER (WHERE in_nav) AS navigation_links,
        count(*) FILTER (WHERE wl.depth < 10) AS above_fold_links,
        round(coalesce(avg(weight), 0), 6) AS avg_weight,
        round(coalesce(max(weight), 0), 6) AS max_weight,
        round(coalesce(min(weight), 1), 6) AS min_weight
      FROM px LEFT JOIN wl ON wl.page_id = px.page_id GROUP BY px.page_id""",
    "frontier_stats": with_(G, CR, f"found AS ({GRAPH_TARGETS})")
    + f"""SELECT {HOST.format('found.url')} AS host, count(*) AS discovered,
        count(*) FILTER (WHERE done.url IS NOT NULL AND done.error IS NULL) AS processed,
        count(*) FILTER (WHERE done.url IS NULL) AS pending,
        count(*) FILTER (WHERE done.url IS NULL) = 0 AS is_empty
      FROM found LEFT JOIN (SELECT cr.url, cr.error FROM cr JOIN pages USING (url)
                            WHERE page_id % 4 <> 0) done ON done.url = found.url
      GROUP BY ROLLUP ({HOST.format('found.url')})""",
    "page_link_count": with_(PX, page_links_of("px"))
    + """SELECT px.page_id, count(link) AS link_count
      FROM px LEFT JOIN page_links ON page_links.page_id = px.page_id GROUP BY px.page_id""",
    "page_asset_counts": with_(PX, META)
    + """SELECT px.url, d.content AS meta_description, k.content AS meta_keywords,
        CAST(len(regexp_extract_all(html, '<img src=')) AS INTEGER) AS image_count,
        CAST(len(regexp_extract_all(html, '<script src=')) AS INTEGER) AS script_count
      FROM px LEFT JOIN meta d ON d.url = px.url AND d.name = 'description'
      LEFT JOIN meta k ON k.url = px.url AND k.name = 'keywords'""",
    "host_retry_stats": with_(STREAK)
    + """SELECT host, consecutive_fails, epoch_us(last_fail_time) AS last_fail_time_us,
        backoff_until_us, coalesce(epoch_us(t) < backoff_until_us, false) AS in_backoff
      FROM retry_stats, as_of""",
    "distinct_first": with_(normalized(anchors("px")))
    .replace("WITH ", f"WITH {PX},\n", 1)
    + """SELECT base AS source_url, link AS target_url, CAST(min(n) AS INTEGER) AS pos
      FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS n FROM norm)
      GROUP BY base, link""",
    "meta_map": with_(PX, META) + "SELECT url, name, content FROM meta",
    "error_summary": with_(CR)
    + f"""SELECT {ERROR_CLASS} AS error_class, count(*) AS count FROM cr
      WHERE error IS NOT NULL GROUP BY 1""",
    "fetch_outcome": with_(FP)
    + """SELECT url, attempts, CAST(status_code AS INTEGER) AS status_code,
      status_code = 200 AS success FROM outcome""",
    # windows
    "latest_page": with_(CR, CR2, LATEST) + "SELECT url, batch_seq, status_code, title FROM latest",
    "politeness_schedule": f"""SELECT url, host, seq, round, (round - 1) * 100 AS earliest_ms,
        min(seq) OVER (PARTITION BY host) AS host_first_seq
      FROM (SELECT url, host, page_id AS seq,
              row_number() OVER (PARTITION BY host ORDER BY page_id) AS round
            FROM (SELECT *, {HOST.format('url')} AS host FROM pages))""",
    "host_failure_streak": with_(STREAK)
    + "SELECT host, url, epoch_us(ts) AS ts_us, attempt, status_code, streak, backoff_ms FROM waits",
    "top_links": with_(WL)
    + """SELECT page_id, pos, href, round(weight, 6) AS weight FROM wl
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY weight DESC, pos) <= 3""",
    "select_weighted_link": with_(WL)
    + f"""SELECT page_id, pos, href FROM (
        SELECT *, sum(p) OVER (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING)
            / sum(p) OVER (PARTITION BY page_id) AS cum,
          max(pos) OVER (PARTITION BY page_id) AS last_pos,
          {uniform('page_id', '7')} AS r
        FROM (SELECT *, pow(weight, 1 / CAST({BIAS} AS DOUBLE)) AS p FROM wl))
      WHERE r <= cum OR pos = last_pos
      QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY pos) = 1""",
    "bloom_seen_filter": with_(PX, page_links_of("px"))
    + """SELECT url, url IN (SELECT url FROM pages) AS maybe_seen
        FROM (SELECT url FROM pages UNION SELECT link FROM page_links)""",
    # scalar functions
    "strip_fragment": """SELECT page_id, regexp_replace(url, '#.*$', '') AS stripped FROM pages""",
    "strip_tracking": with_(normalized("SELECT page_id, url AS href, url AS base FROM pages"))
    + "SELECT page_id, concat(link, regexp_extract(href, '#.*$')) AS stripped FROM norm",
    "normalize_url": with_(PX, normalized(anchors("px")))
    + "SELECT page_id, CAST(pos AS INTEGER) AS pos, link FROM norm",
    "url_host": f"""SELECT page_id, {HOST.format('url')} AS host,
      split_part({HOST.format('url')}, ':', 1) AS domain FROM pages""",
    "robots_url": f"""SELECT page_id, concat({ORIGIN.format('url')}, '/robots.txt') AS robots_url
      FROM pages""",
    "strip_wildcard": f"""SELECT regexp_replace(trim(raw), '^[*][.]', '') AS name FROM (
      SELECT unnest([host, concat('*.', host), concat(' admin@', host, ' '), concat('test', host),
        concat(host, '.evil.test')]) AS raw
      FROM (SELECT DISTINCT {HOST.format('url')} AS host FROM pages))""",
    "rfc3339": with_(CR)
    + f"""SELECT url, {rfc3339('crawled_at')} AS crawled_at,
      CAST(epoch(crawled_at) AS BIGINT) AS parsed FROM cr""",
    "backoff_ms": with_(FL)
    + f"""SELECT url, epoch_us(ts) AS ts_us, attempt, status_code,
      CAST(round(least(1000 * pow(2, attempt), 30000)
        * (1 + 0.2 * (2 * ({percent_of('host', 'url', 'attempt')}) / 100.0 - 1))) AS BIGINT)
        * CASE WHEN status_code = 429 THEN 2 ELSE 1 END AS backoff_ms
      FROM fl WHERE failed""",
    "weight_math": f"""SELECT event_id, round(w, 6) AS clamped,
      round(pow(w, 1 / CAST({BIAS} AS DOUBLE)), 6) AS biased
      FROM (SELECT event_id, greatest(CAST(0 AS DOUBLE),
        least(CAST(1 AS DOUBLE), value / 50 - CAST(0.1 AS DOUBLE))) AS w FROM events)""",
    "extract_title": f"SELECT page_id, {TITLE} AS title FROM pages",
    "extract_links": with_(PX, page_links_of("px"))
    + "SELECT page_id, url, pos, link FROM page_links",
    "extract_meta": with_(PX, META)
    + """SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER)
        AS pos, name, content FROM meta_raw WHERE name <> ''""",
    "extract_images": with_(PX, normalized(tag_values("px", "<img [^>]*>", "src")))
    + "SELECT page_id, CAST(pos AS INTEGER) AS pos, link AS image FROM norm",
    "extract_scripts": with_(PX, normalized(tag_values("px", "<script src[^>]*>", "src")))
    + "SELECT page_id, CAST(pos AS INTEGER) AS pos, link AS script FROM norm",
    "extract_stylesheets": with_(
        PX, normalized(tag_values("px", '<link rel="stylesheet"[^>]*>', "href"))
    )
    + "SELECT page_id, CAST(pos AS INTEGER) AS pos, link AS stylesheet FROM norm",
    "extract_jsonld": with_(PX)
    + """SELECT page_id, 0 AS pos, regexp_extract(html,
        '(?s)<script type="application/ld.json">(.*?)</script>', 1) AS json_data
      FROM px WHERE contains(html, 'application/ld+json')""",
    "extract_structured": with_(PX, META, JSONLD, normalized(anchors("px")))
    + f"""SELECT px.page_id, {TITLE} AS title, coalesce(l.links, '') AS links,
        d.content AS description, coalesce(c.n, 0) AS meta_count, coalesce(c.meta, '') AS meta,
        concat({ORIGIN.format('px.url')}, '/i.png') AS images,
        concat({ORIGIN.format('px.url')}, '/a.js') AS scripts,
        concat({ORIGIN.format('px.url')}, '/s.css') AS stylesheets,
        coalesce(j.json_data, '') AS json_data
      FROM px
      LEFT JOIN (SELECT page_id, string_agg(link, chr(10) ORDER BY first_pos) AS links
                 FROM (SELECT page_id, link, min(pos) AS first_pos FROM norm GROUP BY page_id, link)
                 GROUP BY page_id) l ON l.page_id = px.page_id
      LEFT JOIN meta d ON d.url = px.url AND d.name = 'description'
      LEFT JOIN (SELECT url, count(*) AS n, string_agg(concat(name, '=', content), chr(10) ORDER BY name) AS meta
        FROM meta GROUP BY url) c ON c.url = px.url
      LEFT JOIN (SELECT url, string_agg(json_data, chr(10)) AS json_data FROM jsonld GROUP BY url) j ON j.url = px.url""",
    "weighted_links": with_(WL_LINKS)
    + """SELECT page_id, pos, href, link AS url, anchor_text, round(weight, 6) AS weight,
      depth < 10 AS is_above_fold, in_nav, in_footer, in_main, depth, is_visible FROM wl_norm""",
    "request_error_detail": with_(CR)
    + f"""SELECT url, {ERROR_CLASS} AS error_class,
        CASE WHEN contains(error, ': ') THEN substr(error, strpos(error, ': ') + 2) ELSE '' END
          AS detail,
        CASE WHEN starts_with(error, 'non-200') THEN CAST(right(error, 3) AS INTEGER) END
          AS error_status
      FROM cr WHERE error IS NOT NULL""",
    "extract_by_selector": with_(WL) + "SELECT page_id, pos, anchor_text AS text FROM wl",
    # pipeline and graph
    "page_results": with_(RB, FP, page_links_of("pages"), "counts AS (SELECT page_id, count(*) AS n FROM page_links GROUP BY page_id)")
    + f"""SELECT p.url, CAST(p.page_id % 5 AS INTEGER) AS depth,
        CAST(CASE WHEN d.allowed THEN o.status_code ELSE 0 END AS INTEGER) AS status_code,
        CAST(CASE WHEN {OUT_ERROR} IS NULL THEN strlen(html) ELSE 0 END AS BIGINT)
          AS content_length,
        CASE WHEN {OUT_ERROR} IS NULL THEN {TITLE} ELSE '' END AS title,
        CAST(CASE WHEN {OUT_ERROR} IS NULL THEN coalesce(c.n, 0) ELSE 0 END AS INTEGER) AS link_count,
        {rfc3339("TIMESTAMP '2025-01-01 00:00:00' + to_seconds(p.page_id)")} AS crawled_at,
        {OUT_ERROR} AS error
      FROM pages p JOIN decided d ON d.page_id = p.page_id JOIN outcome o ON o.url = p.url
      LEFT JOIN counts c ON c.page_id = p.page_id""",
    "page_results_weighted": with_(RB, FP, WL, normalized(
        f"""SELECT page_id, url, url AS base, pos, href FROM wl WHERE is_visible AND weight > 0.1
        AND {uniform('page_id', 'pos', '42')} < CAST({BIAS} AS DOUBLE) * weight"""),
      f"""counts AS (SELECT page_id, count(*) AS n FROM norm
        WHERE ends_with({HOST.format('link')}, {HOST.format('url')}) GROUP BY page_id)""")
    + f"""SELECT p.url, CAST(p.page_id % 5 AS INTEGER) AS depth,
        CAST(CASE WHEN d.allowed THEN o.status_code ELSE 0 END AS INTEGER) AS status_code,
        CAST(CASE WHEN {OUT_ERROR} IS NULL THEN strlen(html) ELSE 0 END AS BIGINT)
          AS content_length,
        '' AS title,
        CAST(CASE WHEN {OUT_ERROR} IS NULL THEN coalesce(c.n, 0) ELSE 0 END AS INTEGER) AS link_count,
        {rfc3339("TIMESTAMP '2025-01-01 00:00:00' + to_seconds(p.page_id)")} AS crawled_at,
        {OUT_ERROR} AS error
      FROM px p JOIN decided d ON d.page_id = p.page_id JOIN outcome o ON o.url = p.url
      LEFT JOIN counts c ON c.page_id = p.page_id""",
    "page_edges": with_(RB, FP, page_links_of("pages"))
    + f"""SELECT l.link AS url, CAST(p.page_id % 5 + 1 AS INTEGER) AS depth, p.url AS parent_url
      FROM page_links l JOIN pages p ON p.page_id = l.page_id JOIN decided d ON d.page_id = p.page_id
      JOIN outcome o ON o.url = p.url
      WHERE {OUT_ERROR} IS NULL AND ends_with({HOST.format('l.link')}, {HOST.format('p.url')})""",
    "crawl_depth_bfs": with_(BFS, recursive=True) + "SELECT url, depth, parent_url FROM bfs",
    "discovery_edges": with_(BFS, recursive=True)
    + "SELECT parent_url, url, depth FROM bfs WHERE depth > 0",
    # streams
    "stream_frontier_dedup": with_(FL) + "SELECT DISTINCT url FROM fl",
    "stream_host_backoff": with_(BACKOFF_FOLD, recursive=True)
    + """SELECT e.host, e.url, e.us AS ts_us, e.attempt, f.fails,
        nullif(f.until_us, 0) AS backoff_until_us
      FROM folded f JOIN numbered e ON e.host = f.host AND e.n = f.n""",
    "stream_progress": with_(FL)
    + f"""SELECT {rfc3339('w')} AS window_start,
        CAST(sum(a) OVER (ORDER BY w) AS BIGINT) AS discovered,
        CAST(sum(p) OVER (ORDER BY w) AS BIGINT) AS processed,
        CAST(sum(e) OVER (ORDER BY w) AS BIGINT) AS errors,
        CAST(sum(a - p - e) OVER (ORDER BY w) AS BIGINT) AS pending
      FROM (SELECT date_trunc('hour', ts) AS w, count(*) AS a,
              count(*) FILTER (WHERE status_code = 200) AS p,
              count(*) FILTER (WHERE failed) AS e FROM fl GROUP BY 1)""",
    "stream_upsert_pages": with_(CR, CR2, LATEST) + f"SELECT {SHOWN} FROM latest",
    "stream_robots_filter": with_(RB) + "SELECT page_id, url, allowed, rule FROM decided",
    "stream_resume": with_(G) + "SELECT url FROM pages UNION SELECT target_url FROM g",
    "capped_sessions": with_(SESSIONS, recursive=True)
    + "SELECT user_id, event_id, session_no FROM walk",
    "active_keys": f"""SELECT {rfc3339('w')} AS window_start, count(DISTINCT user_id) AS active
      FROM (SELECT user_id, date_trunc('minute', ts) - to_minutes(k) AS w
            FROM events, range(0, 5) t(k)) GROUP BY w""",
}

# The unresolved query and fragment stay on, apart from that the rules are those of a full URL.
ORACLES["resolve_url"] = with_(PX, normalized(anchors("px"))) + """SELECT page_id,
  CAST(pos AS INTEGER) AS pos,
  concat(CASE WHEN contains(link, '?') THEN split_part(link, '?', 1) ELSE link END,
    regexp_extract(href, '([?][^#]*)', 1), regexp_extract(href, '(#.*)$', 1)) AS resolved
  FROM norm"""

ORACLES["clamp01"] = f"SELECT event_id, clamped FROM ({ORACLES['weight_math']})"
ORACLES["bias_pow"] = f"SELECT event_id, biased FROM ({ORACLES['weight_math']})"
ORACLES["domain_no_port"] = f"SELECT page_id, domain FROM ({ORACLES['url_host']})"
ORACLES["host_backoff"] = ORACLES["stream_host_backoff"]
ORACLES["stream_capped_sessions"] = ORACLES["capped_sessions"]
ORACLES["store_new_urls"] = ORACLES["frontier_new_urls"]
ORACLES["stream_active_keys"] = ORACLES["active_keys"]
ORACLES["stream_progress_totals"] = with_(FL) + f"""SELECT {rfc3339('w')} AS window_start,
    CAST(sum(a) OVER (ORDER BY w) AS BIGINT) AS discovered,
    CAST(sum(p) OVER (ORDER BY w) AS BIGINT) AS processed,
    CAST(sum(e) OVER (ORDER BY w) AS BIGINT) AS errors,
    CAST(sum(a - p - e) OVER (ORDER BY w) AS BIGINT) AS pending
  FROM (SELECT time_bucket(INTERVAL 5 SECOND, ts) AS w, count(*) AS a,
          count(*) FILTER (WHERE status_code = 200) AS p,
          count(*) FILTER (WHERE failed) AS e FROM fl GROUP BY 1)"""
ORACLES["extract_by_selectors"] = with_(WL) + """SELECT page_id, name,
    CAST(row_number() OVER (PARTITION BY page_id, name ORDER BY pos) - 1 AS INTEGER) AS pos, anchor_text AS text
  FROM (SELECT *, row_number() OVER (PARTITION BY page_id, in_nav ORDER BY pos) AS n FROM wl) w,
    LATERAL (SELECT unnest(['first', 'later', 'secure', 'plain']) AS name)
  WHERE CASE name WHEN 'first' THEN in_nav AND n = 1 WHEN 'later' THEN in_nav AND n > 1
    WHEN 'secure' THEN in_footer AND starts_with(href, 'https:')
    ELSE in_footer AND style = '' AND class = '' END"""
