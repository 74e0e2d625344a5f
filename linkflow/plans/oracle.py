"""SQL of the queries, for an engine with regular expressions, lambdas and maps (no JVM)."""

from __future__ import annotations

from linkflow.functions.http import LINK_TYPES
from linkflow.operators.extract import LINK, TAG
from linkflow.operators.timestamps import MONTHS, ZONES

#: The time at which queries look at the frontier; operators never read the clock.
NOW = 1_737_000_000
DAY = 86_400


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


HOST_RE = _q("^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^:/?#]*)")
AUTH_RE = _q("^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)")


def host(url: str) -> str:
    return f"lower(regexp_extract({url}, {HOST_RE}, 1))"


def head(name: str, column: str = "rep_header") -> str:
    return f"list_filter(map_entries({column}), lambda e: lower(e.key) = '{name}')[1].value"


SITE = f"regexp_replace({host("'http://' || identifier")}, '\\.$', '')"
HOSTS = f"(SELECT queue, min({SITE}) AS identifier FROM queue_identifiers WHERE queue IS NOT NULL AND identifier IS NOT NULL GROUP BY queue)"
PARTS = "list_transform(string_split(lower({}), ';'), lambda x: trim(x))"


def _kind(v: str) -> str:
    return f"coalesce(list_filter({PARTS.format(v)}, lambda x: NOT starts_with(x, 'charset'))[-1], '')"


def _charset(v: str) -> str:
    return f"replace(coalesce(string_split(list_filter({PARTS.format(v)}, lambda x: starts_with(x, 'charset'))[-1], '=')[2], ''), '-', '_')"


TYPED = f"""typed AS (
  SELECT *, CASE WHEN sniff THEN {_kind('meta')} ELSE kind0 END AS kind, CASE WHEN sniff THEN {_charset('meta')} ELSE charset0 END AS charset FROM (
    SELECT *, charset0 = '' AND coalesce(octet_length(content_body), 0) >= 512 AND coalesce(meta, '') <> '' AS sniff FROM (
      SELECT *, CASE WHEN ct IS NULL THEN 'text/plain' ELSE {_kind('ct')} END AS kind0, CASE WHEN ct IS NULL THEN '' ELSE {_charset('ct')} END AS charset0,
        regexp_extract(lower((content_body[1:512])::VARCHAR), '(?s)content-type.*?content=\\\\x22(.*?)\\\\x22', 1) AS meta
      FROM (SELECT *, {head('content-type')} AS ct FROM crawl_uris))))"""

LATIN = "content_body::VARCHAR"
for _code, _char in (("22", "'\"'"), ("27", "''''"), ("0A", "chr(10)"), ("0D", "chr(13)"), ("09", "chr(9)"), ("5C", "'\\'")):
    LATIN = f"replace({LATIN}, '\\x{_code}', {_char})"
LATIN = f"regexp_replace({LATIN}, '\\\\x[89A-F][0-9A-F]', '?', 'g')"
TEXT = f"CASE WHEN regexp_matches(charset, '^(windows|iso|latin|cp1?25|us_ascii|ascii)') OR try(decode(content_body)) IS NULL THEN {LATIN} ELSE regexp_replace(try(decode(content_body)), '[^\\x00-\\x7F]', '?', 'g') END"
PAGES = f"""{TYPED}, pages AS (
  SELECT fetch_id, url, {TEXT} AS html FROM typed
  WHERE content_body IS NOT NULL AND rep_header IS NOT NULL AND kind IN ({', '.join(_q(x) for x in LINK_TYPES)})
    AND NOT ends_with(coalesce(effective_url, url), 'robots.txt') AND coalesce(optional_vars['extraction_finished'], '') <> '1')"""
TAGS = f"""{PAGES}, tags AS (
  SELECT fetch_id, url, pos, tag, lower(regexp_extract(tag, '^(\\w+)', 1)) AS element FROM (
    SELECT fetch_id, url, unnest(l) AS tag, generate_subscripts(l, 1) - 1 AS pos FROM (
      SELECT fetch_id, url, list_filter(regexp_extract_all(html, {_q(TAG.replace('MAX', '64'))}, 5), lambda x: x <> '') AS l FROM pages))
  WHERE lower(regexp_extract(tag, '^(\\w+)', 1)) <> 'meta')"""
ORIGIN = _q("^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)")
PATH = _q("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)")


def resolve(base: str, link: str) -> str:
    origin, path = f"regexp_extract({base}, {ORIGIN}, 1)", f"regexp_extract({base}, {PATH}, 1)"
    return f"""CASE WHEN contains({link}, '://') OR regexp_matches({link}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {link}
      WHEN {link} = '' THEN {base}
      WHEN starts_with({link}, '//') THEN lower(regexp_extract({base}, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) || ':' || {link}
      WHEN starts_with({link}, '/') THEN {origin} || {link}
      WHEN starts_with({link}, '?') THEN {origin} || {path} || {link}
      WHEN starts_with({link}, '#') THEN string_split({base}, '#')[1] || {link}
      ELSE {origin} || CASE WHEN {path} = '' THEN '/' ELSE regexp_extract({path}, '^(.*/)[^/]*$', 1) END || {link} END"""


LINKS = f"""{TAGS}, links AS (
  SELECT fetch_id, url, pos, k, raw, regexp_replace({resolve('url', 'raw')}, '[^\\x00-\\x7F]', '?', 'g') AS link FROM (
    SELECT fetch_id, url, pos, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS k FROM (
      SELECT fetch_id, url, pos, list_filter(list_transform(regexp_extract_all(tag, {_q(LINK)}, 3), lambda x: x[2:-2]),
        lambda x: NOT contains(x, 'mailto:') AND NOT contains(x, 'javascript:')) AS l FROM tags WHERE element = 'a')))"""
REDIRECTS = f"""redirects AS (
  SELECT fetch_id, url, raw, {resolve('url', 'raw')} AS link FROM (
    SELECT fetch_id, url, {head('location')} AS raw FROM crawl_uris WHERE status_code BETWEEN 300 AND 399) WHERE raw IS NOT NULL)"""
SCOPE = "regexp_matches(link, '^(?:https?://.*)') AND NOT regexp_matches(link, '^(?:.*\\.avi)')"


def strip(url: str) -> str:
    for key in ("jsessionid=", "phpsessid=", "aspsessionid=", "sid="):
        url = f"regexp_replace({url}, '(?i){key}[^&]*', '', 'g')"
    return url


def clean(url: str) -> str:
    cut = f"string_split({url}, '#')[1]"
    return f"CASE WHEN length({cut}) = 0 THEN {url} ELSE regexp_replace({cut}, '[?&]$', '') END"


ALL = f"""{LINKS}, {REDIRECTS}, every AS (
  SELECT fetch_id, {clean('s')} AS link FROM (
    SELECT fetch_id, {strip('link')} AS s FROM (SELECT fetch_id, link FROM links UNION ALL SELECT fetch_id, link FROM redirects) WHERE {SCOPE}))"""


def http_date(v: str) -> str:
    return f"CASE WHEN regexp_matches({v}, '^[A-Z][a-z]{{2}}, [0-9]{{2}} [A-Z][a-z]{{2}} [0-9]{{4}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}} GMT$') THEN CAST(epoch(try_strptime(substr({v}, 6, 20), '%d %b %Y %H:%M:%S')) AS BIGINT) END"


def show_date(v: str) -> str:
    return f"CASE WHEN {v} BETWEEN 0 AND 253402300799 THEN strftime(make_timestamp(({v}) * 1000000), '%a, %d %b %Y %H:%M:%S GMT') END"


OUTCOME = """CASE WHEN status_code BETWEEN 200 AND 299 THEN 'success' WHEN status_code BETWEEN 300 AND 399 THEN 'redirect'
  WHEN status_code BETWEEN 400 AND 499 THEN 'not_found' WHEN status_code BETWEEN 500 AND 599 OR status_code = 710 THEN 'server_error' ELSE 'unhandled' END"""
RESULT = f"""result AS (
  SELECT fetch_id, url, status_code, etag, mod_date, CASE WHEN mod_date IS NULL THEN {NOW} ELSE {NOW} + p * {DAY} END AS next_date, CASE WHEN mod_date IS NULL THEN 1 ELSE p END AS priority FROM (
    SELECT fetch_id, url, status_code, {head('etag')} AS etag, coalesce({http_date(head('last-modified'))}, {http_date(head('date'))}) AS mod_date,
      CASE WHEN status_code = 304 AND coalesce(current_priority, 0) > 0 THEN least(current_priority + 1, 10) ELSE 1 END AS p FROM crawl_uris))"""
IDS = "(SELECT identifier, min(queue) AS queue FROM queue_identifiers GROUP BY identifier)"
STATE = f"""results AS (SELECT c.fetch_id, c.status_code, c.req_time, i.queue FROM crawl_uris c LEFT JOIN {IDS} i ON i.identifier = {host('c.url')}),
  state AS (
    SELECT q.queue, CAST(50 - coalesce(cost, 0) AS INTEGER) AS budget, CASE WHEN cost IS NULL THEN 0 ELSE rest END AS not_before, false AS in_heap
    FROM (SELECT DISTINCT queue FROM queues WHERE queue IS NOT NULL) q LEFT JOIN (
      SELECT queue, sum(CASE WHEN status_code BETWEEN 200 AND 499 THEN 1 WHEN status_code BETWEEN 500 AND 599 THEN 5 ELSE 0 END) AS cost,
        {NOW} + CAST(floor(max(greatest(coalesce(req_time, 0) * 4, 5))) AS BIGINT) AS rest FROM results WHERE queue IS NOT NULL GROUP BY queue) r USING (queue))"""
DNS = "(VALUES ('www.felgorma.co.example:80', '127.0.0.1', 8080), ('blog.dotra.de.test:80', '10.0.0.2', 80), ('dopitra.de.test:443', '10.0.0.3', 8443)) AS dns(host_port, ip, ip_port)"
PORT = f"coalesce(try_cast(nullif(regexp_extract(regexp_extract(url, {AUTH_RE}, 1), ':(\\d{{1,5}})$', 1), '') AS BIGINT), CASE lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) WHEN 'http' THEN 80 WHEN 'https' THEN 443 WHEN 'ftp' THEN 21 WHEN 'ftps' THEN 990 WHEN 'sftp' THEN 115 END)"
LAST = "(SELECT * FROM result QUALIFY row_number() OVER (PARTITION BY url ORDER BY fetch_id DESC) = 1)"

# Timestamps, written apart from the operator's patterns: forms as (pattern, place of year, month, day, hour, minute, second, fraction, a/p, zone).
_T = r"(\d\d?):(\d\d)(?::(\d\d)(?:[.,](\d{1,9}))?)?(?: ?(am|pm|a\.m\.|p\.m\.))?(?: uhr| h)?(?: ?([+-]\d\d:?\d\d|[a-z]{1,4}))?(?: ?\[[a-z0-9_+/-]+\])?"
_W = r"[^\d\s.,:\[\]/]+"
FORMS = (
    (rf"(\d{{4}})-(\d\d?)-(\d\d?)(?: |t){_T}", "1 2 3 4 5 6 7 8 9"),
    (rf"(?:{_W}[.]?,? )?(\d\d?)[ -]({_W})[.]?[ -](\d\d|\d{{4}}) {_T}", "3 2 1 4 5 6 7 8 9"),
    (rf"(\d\d?)/(\d\d?)/(\d{{4}}),? {_T}", "3 1 2 4 5 6 7 8 9"),
    (rf"(?:{_W}[.]?,? )?(\d\d?)[.](\d\d?)[.](\d{{4}}),? {_T}", "3 2 1 4 5 6 7 8 9"),
    (rf"{_W}[.]?,? ({_W})[.]? (\d\d?) (\d\d?):(\d\d)(?::(\d\d))?(?: ([a-z]{{1,4}}))? (\d{{4}})", "7 1 2 3 4 5 - - 6"),
    (r"(\d{4})(\d\d)(\d\d)t?(?:(\d\d)(\d\d)(\d\d)?)?(?:[.,](\d{1,9}))?(?: ?([+-]\d\d:?\d\d|[a-z]{1,4}))?(?: ?\[[a-z0-9_+/-]+\])?", "1 2 3 4 5 6 7 - 8"),
    (r"(\d{4})-(\d\d?)-(\d\d?)", "1 2 3 - - - - - -"),
    (r"(\d\d?)/(\d\d?)/(\d{4})", "3 1 2 - - - - - -"),
    (r"(\d\d?)[.](\d\d?)[.](\d{4})", "3 2 1 - - - - - -"),
    (rf"(?:{_W}[.]?,? )?(\d\d?)[ -]({_W})[.]?[ -](\d{{4}})", "3 2 1 - - - - - -"),
)


def _fields(v: str) -> str:
    cases = "\n".join(
        f"WHEN regexp_full_match({v}, {_q(p)}) THEN [{', '.join(chr(39) * 2 if g == '-' else f'coalesce(regexp_extract({v}, {_q('^(?:' + p + ')$')}, {g}), {chr(39) * 2})' for g in places.split())}]" for p, places in FORMS
    )
    return f"CASE {cases} END"


def _cases(table: dict, key: str) -> str:
    return f"map_extract(MAP {{{', '.join(f'{_q(str(k))}: {v}' for k, v in table.items())}}}, {key})[1]"


def stamps() -> str:
    """``stamps``: src, rec, raw, usual, utc_ms of every dated header and mark."""
    digits = "regexp_replace(x[9], '[^0-9]', '', 'g')"
    whole = lambda i: f"coalesce(try_cast(nullif(x[{i}], '') AS BIGINT), 0)"
    hour = f"CASE WHEN x[8] = '' THEN {whole(4)} WHEN {whole(4)} BETWEEN 1 AND 12 THEN {whole(4)} % 12 + CASE WHEN x[8][1] = 'p' THEN 12 ELSE 0 END END"
    year = f"CASE WHEN length(x[1]) = 2 THEN {whole(1)} + CASE WHEN {whole(1)} < 70 THEN 2000 ELSE 1900 END ELSE {whole(1)} END"
    n = "try_cast(string_split(v, '.')[1] AS HUGEINT)"
    fraction = "CASE WHEN contains(v, '.') THEN CAST(rpad(string_split(v, '.')[2], 3, '0')[1:3] AS BIGINT) ELSE 0 END"
    lo, hi = "946684800", "1893456000"
    return f"""raws AS (
      SELECT lower(e.key) AS src, CAST(fetch_id AS VARCHAR) AS rec, url, e.value AS raw FROM (SELECT fetch_id, url, unnest(map_entries(rep_header)) AS e FROM crawl_uris)
        WHERE lower(e.key) IN ('date', 'last-modified') AND e.value IS NOT NULL
      UNION ALL SELECT 'mod_date', url, url, CAST(mod_date AS VARCHAR) FROM queue WHERE mod_date IS NOT NULL),
    zoned AS (
      SELECT r.*, coalesce(z.zone, 'UTC') AS zone, lower(trim(regexp_replace(raw, '[\\s\u00a0]+', ' ', 'g'))) AS v,
        CASE WHEN src = 'mod_date' THEN regexp_full_match(raw, '[0-9]{{10}}') ELSE
          regexp_full_match(raw, '(Mon|Tue|Wed|Thu|Fri|Sat|Sun), [0-9]{{2}} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) [0-9]{{4}} [0-9]{{2}}:[0-9]{{2}}:[0-9]{{2}} GMT') END AS usual
      FROM raws r LEFT JOIN (SELECT {SITE} AS site, min(zone) AS zone FROM site_zones WHERE identifier IS NOT NULL AND zone IS NOT NULL GROUP BY 1) z
        ON z.site = regexp_replace({host('r.url')}, '\\.$', '')),
    fields AS (SELECT *, {_fields('v')} AS x, regexp_extract(v, '\\[(.*)\\]$', 1) AS y FROM zoned),
    parts AS (
      SELECT *, {n} AS n, {fraction} AS nf, x[9] = '' AS local, CASE WHEN x[7] = '' OR x IS NULL THEN 0 ELSE CAST(rpad(x[7], 3, '0')[1:3] AS BIGINT) END AS frac,
        CASE WHEN y = '' THEN '' WHEN y IN ('utc', 'gmt', 'z') THEN 'UTC' ELSE coalesce((SELECT min(name) FROM pg_timezone_names() WHERE lower(name) = y), 'none') END AS region,
        CASE WHEN x[9][1] IN ('+', '-') THEN CASE WHEN CAST({digits}[3:4] AS BIGINT) < 60 AND CAST({digits}[1:2] AS BIGINT) * 60 + CAST({digits}[3:4] AS BIGINT) <= 1080
            THEN CASE WHEN x[9][1] = '-' THEN -1 ELSE 1 END * (CAST({digits}[1:2] AS BIGINT) * 60 + CAST({digits}[3:4] AS BIGINT)) END ELSE {_cases(ZONES, 'x[9]')} END AS shift,
        try(make_timestamp(CAST({year} AS BIGINT), CAST(coalesce(try_cast(x[2] AS BIGINT), {_cases(MONTHS, 'x[2]')}) AS BIGINT), try_cast(x[3] AS BIGINT), {hour}, {whole(5)}, CAST({whole(6)} AS DOUBLE))) AS wall
      FROM fields),
    instants AS (
      SELECT *, CASE WHEN region = 'none' OR wall IS NULL THEN NULL WHEN NOT local THEN epoch_ms(wall) - shift * 60000 + frac
          ELSE epoch_ms(CASE WHEN timezone(place, t - INTERVAL 1 HOUR) = wall THEN t - INTERVAL 1 HOUR ELSE t END) + frac END AS spelt
      FROM (SELECT *, timezone(place, wall) AS t FROM (SELECT *, CASE WHEN region NOT IN ('', 'none') THEN region ELSE zone END AS place FROM parts))),
    stamps AS (
      SELECT src, rec, raw, usual, CASE WHEN ms >= {lo}000 AND ms < {hi}000 THEN CAST(ms AS BIGINT) END AS utc_ms FROM (
        SELECT *, coalesce(CASE WHEN NOT regexp_full_match(v, '[0-9]{{1,19}}([.][0-9]{{1,9}})?') THEN NULL
          WHEN n >= {lo} AND n < {hi} THEN n * 1000 + nf WHEN n >= {lo}000 AND n < {hi}000 THEN n
          WHEN n >= {lo}000000 AND n < {hi}000000 THEN n // 1000 WHEN n >= {lo}000000000 AND n < {hi}000000000 THEN n // 1000000 END, spelt) AS ms FROM instants))"""


def oracle_sql() -> dict[str, str]:
    """Query name to SQL."""
    due = f"next_date > 1000 AND next_date <= {NOW}"
    return {
        "p2_found": f"WITH {stamps()} SELECT DISTINCT src, rec, utc_ms FROM stamps WHERE NOT usual AND utc_ms IS NOT NULL",
        "p2_all": f"WITH {stamps()} SELECT src, rec, raw, usual, utc_ms FROM stamps",
        "p4_found": f"SELECT identifier FROM queues JOIN {HOSTS} USING (queue) GROUP BY identifier HAVING count(*) >= (SELECT count(*) FROM queues) / 50.0",
        "p4_per_host": f"""SELECT identifier, count(*) AS n_rows, count(*) FILTER ({due}) AS n_urls_due, min(next_date) FILTER ({due}) AS first_due, max(next_date) FILTER ({due}) AS last_due
            FROM queues JOIN {HOSTS} USING (queue) GROUP BY identifier""",
        "p4_next_urls": f"""SELECT identifier, pos, url, next_date FROM (
              SELECT *, row_number() OVER (PARTITION BY identifier ORDER BY next_date, url) AS pos FROM (
                SELECT identifier, url, min(next_date) AS next_date FROM queues JOIN {HOSTS} USING (queue) WHERE {due} GROUP BY identifier, url)) WHERE pos <= 10""",
        "tag_scan": f"WITH {TAGS} SELECT fetch_id, pos, tag, element FROM tags",
        "link_scan": f"WITH {LINKS} SELECT fetch_id, pos, k, raw FROM links",
        "link_resolve": f"WITH {LINKS} SELECT fetch_id, pos, link FROM links",
        "base_rebase": """SELECT CAST(a AS BIGINT) AS fetch_id, CAST(b AS BIGINT) AS pos, c AS link FROM (VALUES
            (1, 0, 'http://www.example.org/a/x'), (1, 2, 'http://b.example/c/y'), (1, 3, 'http://b.example/z'), (1, 4, 'http://b.example/w'),
            (2, 1, 'http://b.example/relative.html'), (2, 2, 'http://b.example/more.html')) AS t(a, b, c)""",
        "entity_unescape": "SELECT CAST(a AS BIGINT) AS id, b AS text FROM (VALUES (0, 'a & b'), (1, 'über Aä'), (2, '&unknown; &#xZZ;'), (3, ''), (4, NULL)) AS t(a, b)",
        "content_type_filter": f"WITH {TYPED} SELECT fetch_id, kind, charset, kind IN ({', '.join(_q(x) for x in LINK_TYPES)}) AS allowed FROM typed",
        "limiter_flag": "SELECT fetch_id, coalesce(ends_with(effective_url, 'robots.txt'), false) OR coalesce(optional_vars['extraction_finished'], '0') = '1' AS finished FROM crawl_uris",
        "redirect_links": f"WITH {REDIRECTS} SELECT fetch_id, raw, link FROM redirects",
        "scope_filter": f"WITH {LINKS} SELECT link, count(*) AS n FROM links WHERE {SCOPE} GROUP BY link",
        "strip_sessions": f"SELECT DISTINCT url, {strip('url')} AS stripped FROM queue",
        "cleanup_query": f"SELECT DISTINCT url, {clean('url')} AS cleaned FROM queue",
        "pipeline_links": f"WITH {ALL} SELECT fetch_id, link, count(*) AS n FROM every GROUP BY fetch_id, link",
        "dedup_links": f"WITH {ALL} SELECT DISTINCT link FROM every WHERE length(link) > 5",
        "known_anti_join": "SELECT DISTINCT url AS link FROM crawl_uris WHERE length(url) > 5 AND url NOT IN (SELECT url FROM queue)",
        "url_hash": "SELECT url, sha1(url) AS hash FROM queue",
        "host_identifier": f"SELECT {host('url')} AS identifier, count(*) AS n FROM queues GROUP BY 1",
        "default_port": f"SELECT fetch_id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, CAST({PORT} AS BIGINT) AS port FROM crawl_uris",
        "effective_url": f"""SELECT url, CASE WHEN ip IS NULL THEN url ELSE replace(url, regexp_extract(url, {AUTH_RE}, 1), ip || ':' || ip_port) END AS effective_url
            FROM queue LEFT JOIN {DNS} ON host_port = {host('url')} || ':' || {PORT}""",
        "ip_queue_assignment": f"SELECT fetch_id, ip FROM crawl_uris LEFT JOIN {DNS} ON host_port = {host('url')} || ':' || {PORT}",
        "credentials": "SELECT CAST(a AS BIGINT) AS id, b AS username, c AS password FROM (VALUES (0, 'user', 'passwd'), (1, 'user', NULL), (2, NULL, NULL), (3, 'a', NULL), (4, NULL, NULL)) AS t(a, b, c)",
        "queue_ids": f"""SELECT queue, identifier FROM queue_identifiers UNION ALL
            SELECT (SELECT max(queue) FROM queue_identifiers) + row_number() OVER (ORDER BY identifier) AS queue, identifier FROM (
              SELECT DISTINCT {host('url')} AS identifier FROM crawl_uris) WHERE identifier NOT IN (SELECT identifier FROM queue_identifiers)""",
        "queue_assignment": f"SELECT fetch_id, queue FROM crawl_uris LEFT JOIN {IDS} i ON i.identifier = {host('url')}",
        "queue_head_all": "SELECT DISTINCT * FROM queue WHERE next_date > 1000 ORDER BY next_date, url LIMIT 50 OFFSET 5",
        "queue_head_per_queue": """SELECT queue, pos, url, next_date FROM (
              SELECT *, row_number() OVER (PARTITION BY queue ORDER BY next_date, url, priority, mod_date, etag) AS pos FROM (SELECT DISTINCT * FROM queues WHERE next_date > 1000 AND queue IS NOT NULL))
            WHERE pos BETWEEN 2 AND 6""",
        "queue_size": "SELECT queue, count(url) AS n FROM queues GROUP BY queue",
        "queue_total": "SELECT count(url) AS n FROM queue",
        "queue_count": "SELECT count(queue) AS n FROM queue_identifiers",
        "queue_scan": "SELECT url FROM queues WHERE queue = 1",
        "point_lookup": "SELECT * FROM queue WHERE url IN (SELECT url FROM crawl_uris WHERE status_code = 404)",
        "insert_uris": f"""SELECT url, etag, mod_date, next_date, priority FROM queue UNION ALL
            SELECT DISTINCT url, NULL, NULL, CAST({NOW} AS BIGINT), 1 FROM crawl_uris WHERE url NOT IN (SELECT url FROM queue)""",
        "update_uris": f"""WITH {RESULT} SELECT q.url, CASE WHEN r.url IS NULL THEN q.etag ELSE r.etag END AS etag, CASE WHEN r.url IS NULL THEN q.mod_date ELSE r.mod_date END AS mod_date,
              CAST(CASE WHEN r.url IS NULL THEN q.next_date ELSE r.next_date END AS BIGINT) AS next_date, CAST(CASE WHEN r.url IS NULL THEN q.priority ELSE r.priority END AS INTEGER) AS priority
            FROM queue q LEFT JOIN {LAST} r ON q.url = r.url""",
        "remove_uris": "SELECT * FROM queue WHERE url NOT IN (SELECT url FROM crawl_uris WHERE status_code = 404)",
        "ignore_uris": """SELECT q.url, CASE WHEN s IS NULL THEN q.queue END AS queue, CASE WHEN s IS NULL THEN etag END AS etag, CASE WHEN s IS NULL THEN mod_date END AS mod_date,
              CAST(coalesce(s, next_date) AS BIGINT) AS next_date, CAST(CASE WHEN s IS NULL THEN priority ELSE 1 END AS INTEGER) AS priority
            FROM queues q LEFT JOIN (SELECT url, max(status_code) AS s FROM crawl_uris WHERE status_code >= 400 GROUP BY url) c ON c.url = q.url""",
        "fetch_outcome": f"SELECT fetch_id, {OUTCOME} AS outcome FROM crawl_uris",
        "reschedule": f"WITH {RESULT} SELECT fetch_id, url, etag, mod_date, CAST(next_date AS BIGINT) AS next_date, CAST(priority AS INTEGER) AS priority FROM result",
        "politeness_delay": "SELECT fetch_id, round(greatest(coalesce(req_time, 0) * 4, 5), 6) AS delay FROM crawl_uris",
        "budget_fold": f"WITH {STATE} SELECT queue, budget, CAST(not_before AS BIGINT) AS not_before, in_heap FROM state",
        "ready_set": f"""WITH {STATE} SELECT queue, url, next_date FROM (
              SELECT queue, url, next_date, row_number() OVER (PARTITION BY queue ORDER BY next_date, url, priority, mod_date, etag) AS pos FROM (SELECT DISTINCT * FROM queues)
              WHERE next_date > 1000 AND next_date <= {NOW + 60} AND queue IN (SELECT queue FROM state WHERE budget > 0 AND not_before <= {NOW + 60})) WHERE pos = 1""",
        "outcome_transition": f"""WITH {RESULT}, acts AS (SELECT *, CASE WHEN status_code BETWEEN 200 AND 299 OR status_code = 304 THEN 'update'
                WHEN status_code BETWEEN 400 AND 599 OR status_code IN (301, 302, 710) THEN 'ignore' ELSE 'keep' END AS act FROM {LAST})
            SELECT q.url, CASE WHEN act = 'ignore' THEN NULL ELSE q.queue END AS queue, CASE WHEN act = 'ignore' THEN NULL WHEN act = 'update' THEN r.etag ELSE q.etag END AS etag,
              CASE WHEN act = 'ignore' THEN NULL WHEN act = 'update' THEN r.mod_date ELSE q.mod_date END AS mod_date,
              CAST(CASE WHEN act = 'ignore' THEN r.status_code WHEN act = 'update' THEN r.next_date ELSE q.next_date END AS BIGINT) AS next_date,
              CAST(CASE WHEN act = 'ignore' THEN 1 WHEN act = 'update' THEN r.priority ELSE q.priority END AS INTEGER) AS priority
            FROM queues q LEFT JOIN acts r ON q.url = r.url""",
        "conditional_headers": f"SELECT url, {host('url')} AS host, etag AS if_none_match, {show_date('mod_date')} AS if_modified_since FROM queue",
        "http_date_roundtrip": f"SELECT fetch_id, seconds, {show_date('seconds')} AS text FROM (SELECT fetch_id, {http_date(head('date'))} AS seconds FROM crawl_uris)",
        "queue_selector_weights": "SELECT queue, rank, round((1.0::DOUBLE / rank) / sum(1.0::DOUBLE / rank) OVER (), 9) AS weight FROM (SELECT queue, row_number() OVER (ORDER BY queue) AS rank FROM (SELECT DISTINCT queue FROM queue_identifiers))",
        "extracted_urls_agg": f"WITH {LINKS} SELECT fetch_id, string_agg(link, chr(10) ORDER BY pos, k) AS extracted_urls FROM links GROUP BY fetch_id",
        "frontier_seed": f"""WITH {LINKS}, fresh AS (SELECT DISTINCT link AS url FROM (SELECT {clean('s')} AS link FROM (SELECT {strip('link')} AS s FROM links WHERE {SCOPE})) WHERE length(link) > 5),
            placed AS (SELECT url, {host('url')} AS identifier FROM fresh WHERE {host('url')} <> '')
            SELECT queue, identifier, pos, url FROM (SELECT dense_rank() OVER (ORDER BY identifier) AS queue, identifier, row_number() OVER (PARTITION BY identifier ORDER BY url) AS pos, url FROM placed) WHERE pos <= 50""",
        "stream_dedup": "SELECT DISTINCT url FROM crawl_uris",
    }
