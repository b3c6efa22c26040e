"""DuckDB building blocks of the oracle queries.

They restate the input rules of ``FIXTURES.md`` and the operators' definitions
in plain SQL, on their own, without using the package's expressions.
"""

SEED = "https://seed.example.com"

UNESCAPE = (
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace({0}, '&quot;?', '\"', 'g'),"
    " '&lt;?', '<', 'g'), '&gt;?', '>', 'g'), '&amp;?', '&', 'g')"
)


def unescape(text: str) -> str:
    return UNESCAPE.format(text)


PX = """px AS (
  SELECT page_id, url,
    replace(replace(html, '</head>', concat(
      '<meta name="description" content="d', page_id, '">',
      CASE WHEN page_id % 2 = 1
           THEN concat('<meta name="description" content="second ', page_id, '">') ELSE '' END,
      '<meta name="keywords" content="k', page_id % 7, ', crawl">',
      '<meta property="og:type" content="',
      CASE WHEN page_id % 3 = 0 THEN 'article' ELSE 'website' END, '">',
      '<link rel="canonical" href="/c/', page_id, '">',
      '<link rel="stylesheet" href="/s.css">',
      '<script src="/a.js"></script>',
      CASE WHEN page_id % 4 = 0
           THEN concat('<script type="application/ld+json">{"@id": ', page_id, '}</script>')
           ELSE '' END,
      '</head>')), '</footer>', '
    <a href="mailto:x@example.com">mail</a><a href="#top">top</a>
    <a href="https://other.example.net/x?utm_source=f">Other</a>
    <a href="?b=2&amp;a=1&amp;gclid=z">Products</a><a href="../up">Up</a>
    <a href="/hidden" style="display:none">Hidden</a>
    <a class="btn" href="/buy"><img src="/i.png"></a>
    <a class="is-hidden" href="/about">About us</a></footer>') AS html
  FROM pages)"""

CR = """cr AS (
  SELECT url, CAST(page_id % 5 AS INTEGER) AS depth,
    CAST(CASE page_id % 10 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 0 ELSE 200 END AS INTEGER)
      AS status_code,
    CAST(strlen(html) AS BIGINT) AS content_length, concat('Page ', page_id) AS title,
    CAST(page_id % 7 AS INTEGER) AS link_count,
    TIMESTAMP '2025-01-01 00:00:00' + to_seconds(page_id) AS crawled_at,
    CASE WHEN page_id % 10 = 0 THEN 'non-200 status: 404'
         WHEN page_id % 10 = 1 THEN 'non-200 status: 503'
         WHEN page_id % 20 = 2 THEN concat('request failed: Get "', url, '": no such host')
         WHEN page_id % 10 = 2 THEN 'blocked by robots.txt' END AS error,
    CAST(1 AS BIGINT) AS batch_seq
  FROM pages)"""

CR2 = """cr2 AS (
  SELECT url, CAST(page_id % 5 AS INTEGER) AS depth, 200 AS status_code,
    CAST(strlen(html) + 1 AS BIGINT) AS content_length,
    concat('Page ', page_id, ' again') AS title, CAST(page_id % 7 AS INTEGER) AS link_count,
    TIMESTAMP '2025-02-01 00:00:00' + to_seconds(page_id) AS crawled_at,
    CAST(NULL AS VARCHAR) AS error, CAST(2 AS BIGINT) AS batch_seq
  FROM pages WHERE page_id % 7 = 0)"""

FL = """fl AS (
  SELECT host, concat('https://', host, '/', event_id % 500) AS url, ts,
    CAST(event_id // 500 % 4 AS INTEGER) AS attempt,
    CAST(CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 0
              WHEN event_type = 'error' AND event_id % 3 = 0 THEN 429
              WHEN event_type = 'error' THEN 500
              WHEN event_type = 'signup' THEN 404 ELSE 200 END AS INTEGER) AS status_code,
    CASE WHEN event_type = 'error' AND event_id % 5 = 0 THEN 'connection reset by peer' END
      AS error,
    event_type = 'error' AS failed
  FROM (SELECT *, concat('h', user_id % 20, '.example.org') AS host FROM events))"""

FP = """fp AS (
  SELECT url, attempt, TIMESTAMP '2025-01-01 00:00:00' + to_seconds(page_id * 10 + attempt) AS ts,
    CASE WHEN attempt < page_id % 5 THEN 503 WHEN page_id % 7 = 0 THEN 404
         WHEN page_id % 11 = 0 THEN 503 ELSE 200 END AS status_code
  FROM (SELECT page_id, url, unnest(range(0, page_id % 5 + 1)) AS attempt FROM pages)),
outcome AS (
  SELECT p.url, count(*) AS attempts, max_by(fp.status_code, fp.attempt) AS status_code
  FROM fp JOIN (
    SELECT url, coalesce(min(attempt) FILTER (WHERE status_code NOT IN (429,500,502,503,504)), 3)
      AS cut FROM fp WHERE attempt <= 3 GROUP BY url) p
    ON p.url = fp.url AND fp.attempt <= p.cut
  GROUP BY p.url)"""

G = """g AS (
  SELECT s.url AS source_url, t.url AS target_url FROM (
    SELECT url, unnest([(3 * page_id + 1) % n, (5 * page_id + 2) % n]) AS target_id
    FROM pages, (SELECT count(*) AS n FROM pages)) s
  JOIN pages t ON t.page_id = s.target_id)"""

BFS = (
    G
    + """,
walk AS (
  SELECT url, 0 AS depth FROM pages WHERE page_id = 0
  UNION
  SELECT g.target_url, depth + 1 FROM walk JOIN g ON g.source_url = walk.url
  WHERE depth < (SELECT count(*) FROM pages)),
least AS (SELECT url, CAST(min(depth) AS INTEGER) AS depth FROM walk GROUP BY url),
bfs AS (
  SELECT l.url, l.depth, min(p.url) AS parent_url
  FROM least l LEFT JOIN g ON g.target_url = l.url
  LEFT JOIN least p ON p.url = g.source_url AND p.depth = l.depth - 1
  GROUP BY l.url, l.depth)"""
)

HOST = "regexp_extract({0}, '^[a-z]+://([^/?#]*)', 1)"
ORIGIN = "regexp_extract({0}, '^([a-z]+://[^/?#]*)', 1)"

RB = f"""rb AS (
  SELECT concat(origin, '/robots.txt') AS robots_url,
    CASE h WHEN 'e' THEN 404 WHEN 'f' THEN 500 ELSE 200 END AS status,
    CASE WHEN h IN ('0','1') THEN concat('User-agent: *', nl, 'Disallow:', nl)
      WHEN h IN ('2','3','4') THEN concat('User-agent: *', nl, 'Disallow: /en/', nl)
      WHEN h IN ('5','6') THEN concat('User-agent: *', nl, 'Disallow: /', nl, 'Allow: /es/ # spanish', nl)
      WHEN h IN ('7','8','9') THEN concat('User-agent: *', nl, 'Disallow: /*/1*0$', nl, 'Disallow: /en/2', nl)
      WHEN h IN ('a','b') THEN concat('User-agent: otherbot', nl, 'User-agent: LensBot', nl,
        'Disallow: /fr/', nl, nl, 'User-agent: *', nl, 'Disallow: /', nl)
      WHEN h IN ('c','d') THEN concat('User-agent: *', nl, 'Disallow: /de/', nl,
        'Sitemap: {SEED}/sitemap-3.xml', nl, 'SITEMAP:{SEED}/sitemap-4.xml', nl,
        ' sitemap: {SEED}/no.xml', nl)
      WHEN h = 'e' THEN concat('User-agent: *', nl, 'Disallow: /', nl)
      ELSE '<html>Internal Server Error</html>' END AS body
  FROM (SELECT DISTINCT {ORIGIN.format('url')} AS origin,
          substr(md5({HOST.format('url')}), 1, 1) AS h, chr(10) AS nl FROM pages)
  UNION ALL
  SELECT '{SEED}/robots.txt', 200,
    concat('Sitemap: {SEED}/sitemap-9.xml', chr(10), 'sitemap:{SEED}/sitemap.xml', chr(10))
  FROM pages WHERE page_id = 0),
rb_lines AS (
  SELECT robots_url, pos, trim(regexp_replace(line, '#.*$', '')) AS line
  FROM (SELECT robots_url, unnest(string_split(body, chr(10))) AS line,
               generate_subscripts(string_split(body, chr(10)), 1) AS pos
        FROM rb WHERE status <> 404)),
rb_typed AS (
  SELECT robots_url, pos, lower(trim(split_part(line, ':', 1))) AS k,
    trim(substr(line, strpos(line, ':') + 1)) AS v
  FROM rb_lines
  WHERE lower(trim(split_part(line, ':', 1))) IN ('user-agent', 'allow', 'disallow')),
rb_groups AS (
  SELECT *, sum(CASE WHEN k = 'user-agent' AND coalesce(prev, '') <> 'user-agent' THEN 1 ELSE 0 END)
      OVER (PARTITION BY robots_url ORDER BY pos) AS grp
  FROM (SELECT *, lag(k) OVER (PARTITION BY robots_url ORDER BY pos) AS prev FROM rb_typed)),
rb_chosen AS (
  SELECT robots_url, grp FROM rb_groups
  WHERE k = 'user-agent' AND (v = '*' OR starts_with('lensbot', lower(v)))
  QUALIFY (CASE WHEN v = '*' THEN 1 ELSE length(v) END)
    = max(CASE WHEN v = '*' THEN 1 ELSE length(v) END) OVER (PARTITION BY robots_url)),
rb_rules AS (
  SELECT robots_url, k = 'allow' AS allow, v AS pattern FROM rb_groups
  JOIN rb_chosen USING (robots_url, grp) WHERE k <> 'user-agent' AND v <> ''),
decided AS (
  SELECT page_id, url, coalesce(max_by(r.allow, length(r.pattern) * 2 + CAST(r.allow AS INTEGER)), true) AS allowed,
    max_by(r.pattern, length(r.pattern) * 2 + CAST(r.allow AS INTEGER)) AS rule
  FROM pages p LEFT JOIN rb_rules r
    ON r.robots_url = concat({ORIGIN.format('p.url')}, '/robots.txt')
   AND regexp_matches(regexp_extract(p.url, '^[a-z]+://[^/?#]*([^?#]*)', 1),
         concat('^', replace(replace(r.pattern, '.', '[.]'), '*', '.*')))
  GROUP BY page_id, url)"""

SM = f"""sm AS (
  SELECT CASE WHEN page_id = 0 THEN '{SEED}/sitemap.xml'
              ELSE concat('{SEED}/sitemap-', page_id, '.xml') END AS sitemap_url,
    CASE WHEN page_id % 13 = 5 THEN 500 ELSE 200 END AS status, page_id, url
  FROM pages),
sm_locs AS (
  SELECT sitemap_url, status, CAST(k - 1 AS INTEGER) AS pos,
    concat('{SEED}/sitemap-', page_id * 8 + k, '.xml') AS loc FROM sm, range(1, 9) t(k)
  UNION ALL
  SELECT sitemap_url, status, 8,
    concat('{SEED}/sitemap-', CASE WHEN page_id = 0 THEN 0 ELSE (page_id - 1) // 8 END, '.xml')
  FROM sm
  UNION ALL SELECT sitemap_url, status, 9, url FROM sm
  UNION ALL SELECT sitemap_url, status, 10, '{SEED}/about' FROM sm)"""


def sitemap_leaves(roots: str) -> str:
    return f"""{SM},
reached AS (
  {roots}
  UNION
  SELECT l.loc FROM reached r JOIN sm_locs l ON l.sitemap_url = r.sitemap_url
  WHERE l.status = 200 AND (ends_with(l.loc, '.xml') OR contains(l.loc, 'sitemap'))),
leaves AS (
  SELECT l.sitemap_url, l.pos, l.loc FROM sm_locs l JOIN reached USING (sitemap_url)
  WHERE l.status = 200 AND NOT (ends_with(l.loc, '.xml') OR contains(l.loc, 'sitemap')))"""


SEED_ROOTS = " UNION ALL ".join(
    f"SELECT '{SEED}/{p}' AS sitemap_url"
    for p in ("sitemap.xml", "sitemap_index.xml", "sitemap-index.xml", "sitemap-9.xml")
)

CT = """ct AS (
  SELECT DISTINCT regexp_replace(trim(name), '^\\*\\.', '') AS name FROM (
    SELECT unnest([host, concat('*.', host), concat(' admin@', host, ' '), concat('test', host),
                   concat(host, '.evil.test')]) AS name
    FROM (SELECT DISTINCT regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)))"""


def normalized(source: str) -> str:
    """CTE chain from a query giving (href, base, ...) to ``norm`` with ``link`` added."""
    return f"""hrefs AS ({source}),
n1 AS (
  SELECT *, regexp_extract(base, '^([a-z]+://[^/?#]*)', 1) AS b_origin,
    regexp_extract(base, '^[a-z]+://[^/?#]*([^?#]*)', 1) AS b_path,
    regexp_extract(base, '^[^?#]*([?][^#]*)', 1) AS b_query,
    split_part(href, '#', 1) AS h
  FROM hrefs),
n2 AS (
  SELECT *, CASE
      WHEN regexp_matches(h, '^https?://') THEN h
      WHEN starts_with(h, '/') THEN concat(b_origin, h)
      WHEN h = '' THEN concat(b_origin, b_path, b_query)
      WHEN starts_with(h, '?') THEN concat(b_origin, b_path, h)
      ELSE concat(b_origin, regexp_extract(b_path, '^(.*/)', 1), h) END AS full_url
  FROM n1
  WHERE NOT (href = '' OR starts_with(href, '#') OR starts_with(href, 'javascript:')
             OR starts_with(href, 'mailto:') OR starts_with(href, 'tel:'))),
n3 AS (
  SELECT *, regexp_extract(full_url, '^([a-z]+://[^/?]*)', 1) AS origin,
    string_split(regexp_extract(full_url, '^[a-z]+://[^/?]*([^?]*)', 1), '/') AS segs,
    regexp_extract(full_url, '[?](.*)$', 1) AS query
  FROM n2),
n4 AS (
  SELECT *, array_to_string(list_reduce(segs, lambda a, s: CASE
        WHEN s = '.' THEN a
        WHEN s = '..' THEN (CASE WHEN len(a) > 1 THEN a[:len(a) - 1] ELSE a END)
        ELSE list_append(a, s) END, CAST([] AS VARCHAR[])), '/') AS path,
    list_sort(list_filter(list_transform(
        list_filter(string_split(query, '&'), lambda p: p <> ''),
        lambda p, i: {{'k': split_part(p, '=', 1), 'i': i, 'v': substr(p, strpos(p || '=', '=') + 1)}}),
      lambda e: e.k NOT IN ('utm_source','utm_medium','utm_campaign','utm_term','utm_content',
        'fbclid','gclid','msclkid','mc_cid','mc_eid'))) AS params
  FROM n3),
norm AS (
  SELECT * EXCLUDE (h, full_url, segs, query, params, b_origin, b_path, b_query, origin, path),
    concat(origin,
      array_to_string(list_transform(string_split(path, ''),
        lambda c: CASE WHEN strlen(c) > 1 THEN url_encode(c) ELSE c END), ''),
      CASE WHEN len(params) > 0 THEN concat('?', array_to_string(list_transform(params,
        lambda e: concat(replace(url_encode(e.k), '%20', '+'), '=', replace(url_encode(e.v), '%20', '+'))), '&'))
      ELSE '' END) AS link
  FROM n4)"""


def tag_values(table: str, tag_pattern: str, attribute: str, cols: str = "page_id, url") -> str:
    """(cols, pos, href, base) rows of an attribute of matching tags, in page order."""
    return f"""SELECT {cols}, url AS base, pos,
        {unescape(f"regexp_extract(tag, ' {attribute}=" + '"([^"]*)"' + "', 1)")} AS href
      FROM (SELECT {cols}, unnest(tags) AS tag, generate_subscripts(tags, 1) - 1 AS pos FROM (
        SELECT {cols}, regexp_extract_all(
          regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '{tag_pattern}') AS tags FROM {table}))"""


# All anchors of a page stand outside comments and scripts in these tables.
ANCHOR = "<a [^>]*>"


def anchors(table: str) -> str:
    return tag_values(table, ANCHOR, "href")


def page_links_of(table: str) -> str:
    """Distinct normalised links per page with first position, numbered 0.. in order."""
    both = f"""SELECT page_id, url, base, pos, href FROM ({anchors(table)})
      UNION ALL
      SELECT page_id, url, base, pos + 1000000, href FROM (
        {tag_values(table, '<link rel="(?:canonical|alternate)"[^>]*>', 'href')})"""
    return f"""{normalized(both)},
page_links AS (
  SELECT page_id, url, link,
    CAST(row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS INTEGER) AS pos
  FROM norm GROUP BY page_id, url, link)"""


META = f"""meta_raw AS (
  SELECT page_id, url, pos,
    regexp_extract(tag, ' (?:name|property)="([^"]*)"', 1) AS name,
    {unescape("regexp_extract(tag, ' content=" + '"([^"]*)"' + "', 1)")} AS content
  FROM (SELECT page_id, url, unnest(tags) AS tag, generate_subscripts(tags, 1) AS pos FROM (
    SELECT page_id, url, regexp_extract_all(html, '<meta [^>]*>') AS tags FROM px))),
meta AS (
  SELECT url, name, max_by(content, pos) AS content FROM meta_raw WHERE name <> ''
  GROUP BY url, name)"""

JSONLD = """jsonld AS (
  SELECT url, unnest(regexp_extract_all(html,
    '(?s)<script type="application/ld.json">(.*?)</script>', 1)) AS json_data FROM px)"""


def _opens(prefix: str, tag: str) -> str:
    start, end = f"<{tag}", f"</{tag}>"
    return (
        f"((length({prefix}) - length(regexp_replace({prefix}, '{start}[ >]', '', 'g'))) // {len(start) + 1}"
        f" - (length({prefix}) - length(replace({prefix}, '{end}', ''))) // {len(end)})"
    )


# Open elements are counted as opening minus closing tags before the link. <p> is left
# open only inside <article>, where no link stands; HTML carries a <b> left open there
# on into the footer, at most three of them.
WL = (
    PX
    + f""",
wl_raw AS (
  SELECT page_id, url, CAST(i - 1 AS INTEGER) AS pos, array_to_string(parts[1:i], '<a ') AS prefix,
    parts[i + 1] AS rest
  FROM (SELECT page_id, url, string_split(regexp_replace(html,
          '(?s)<!--.*?-->|<script.*?</script>|<style.*?</style>', '', 'g'), '<a ') AS parts FROM px),
    LATERAL (SELECT unnest(range(1, len(parts))) AS i)),
wl_facts AS (
  SELECT page_id, url, pos,
    {unescape("regexp_extract(rest, 'href=" + '"([^"]*)"' + "', 1)")} AS href,
    {unescape("trim(regexp_replace(regexp_extract(rest, '(?s)^[^>]*>(.*?)</a>', 1), '<[^>]*>', '', 'g'))")}
      AS anchor_text,
    regexp_extract(rest, '^[^>]*class="([^"]*)"', 1) AS class,
    regexp_extract(rest, '^[^>]*style="([^"]*)"', 1) AS style,
    contains(regexp_extract(rest, '(?s)^(.*?)</a>', 1), '<img') AS has_img,
    {_opens('prefix', 'nav')} > 0 AS in_nav, {_opens('prefix', 'footer')} > 0 AS in_footer,
    {_opens('prefix', 'article')} > 0 AS in_main,
    CAST(2 + {' + '.join(_opens('prefix', t) for t in ('nav', 'footer', 'article', 'div', 'ul', 'li'))}
      + CASE WHEN {_opens('prefix', 'footer')} > 0 THEN least(3, {_opens('prefix', 'b')}) ELSE 0 END
      AS INTEGER) AS depth
  FROM wl_raw),
wl AS (
  SELECT *, greatest(0, least(1, CAST(0.5 AS DOUBLE)
      + CASE WHEN in_nav THEN CAST(0.3 AS DOUBLE) ELSE 0 END
      + CASE WHEN in_main THEN CAST(0.2 AS DOUBLE) ELSE 0 END
      - CASE WHEN in_footer THEN CAST(0.3 AS DOUBLE) ELSE 0 END
      + CASE WHEN depth < 10 THEN CAST(0.2 AS DOUBLE) ELSE 0 END
      + CASE WHEN regexp_matches(class, 'button|btn|cta') THEN CAST(0.2 AS DOUBLE) ELSE 0 END
      + CASE WHEN has_img THEN CAST(0.1 AS DOUBLE) ELSE 0 END
      + CASE WHEN strlen(anchor_text) > 3 AND strlen(anchor_text) < 100
             THEN CAST(0.1 AS DOUBLE) ELSE 0 END
      + CASE WHEN regexp_matches(lower(anchor_text), 'home|about|contact|products')
             THEN CAST(0.15 AS DOUBLE) ELSE 0 END)) AS weight,
    NOT contains(style, 'display:none') AND NOT contains(class, 'hidden')
      AND (anchor_text <> '' OR has_img) AS is_visible
  FROM wl_facts)"""
)


def uniform(*parts: str) -> str:
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 8)) AS BIGINT) / CAST(4294967296 AS DOUBLE)"


def percent_of(*parts: str) -> str:
    text = ", ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"CAST(('0x' || substr(md5(concat_ws('|', {text})), 1, 8)) AS BIGINT) % 100"


def rfc3339(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%dT%H:%M:%SZ')"
