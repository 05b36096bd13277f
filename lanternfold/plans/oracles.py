"""The same queries as DuckDB SQL, for checking.

Written from the semantics, not from the Spark plans: windows, joins and a
recursive CTE stand where the jobs use folds over arrays.
"""

from __future__ import annotations

import re

from lanternfold import rules
from lanternfold.plans.corpora import FETCHED_AT, LATER, PROBES, SAMPLE
from lanternfold.rules import FUNDS

S = (r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
     r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}")
W = r"\p{L}\p{N}_"
BREAK = r"\r\n|[\n\x{0b}\f\r\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]"
DIM = 128
ORACLES: dict[str, str] = {}


def q(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def strings(values) -> str:
    return ", ".join(q(v) for v in values)


def strip(e: str) -> str:
    return f"regexp_replace({e}, '^[{S}]+|[{S}]+$', '', 'g')"


def collapse(e: str) -> str:
    return f"trim(regexp_replace({e}, '[{S}]+', ' ', 'g'))"


def words(e: str) -> str:
    return f"len(regexp_extract_all({e}, '[^{S}]+'))"


def lines(e: str) -> str:
    return (f"list_filter(list_transform(string_split_regex({e}, '{BREAK}'), lambda x: {collapse('x')}), "
            f"lambda x: x <> '')")


def sentences(e: str) -> str:
    cut = f"regexp_replace({e}, '([.!?])[{S}]+([A-Z(])', '\\1' || chr(30) || '\\2', 'g')"
    return f"list_filter(string_split({cut}, chr(30)), lambda x: {strip('x')} <> '')"


def phrase(phrases) -> str | None:
    found = ["[^a-z0-9]+".join(t) for p in phrases if (t := re.findall("[a-z0-9]+", p.lower()))]
    return f"(?:^|[^a-z0-9])(?:{'|'.join(found)})s?(?:[^a-z0-9]|$)" if found else None


def has(e: str, phrases) -> str:
    pattern = phrase(phrases)
    return f"regexp_matches({e}, {q(pattern)})" if pattern else "false"


def bounded(pattern: str) -> str:
    """A rule pattern with its outer edges spelled out for RE2."""
    pattern = pattern.replace(r"\s", f"[{S}]")
    pattern = re.sub(r"^\\b", lambda m: f"(?:^|[^{W}])", pattern)
    return re.sub(r"\\b$", lambda m: f"(?:[^{W}]|$)", pattern)


def any_rule(e: str, patterns) -> str:
    return f"regexp_matches({e}, {q('(?i)' + '|'.join(f'(?:{bounded(p)})' for p in patterns))})"


def any_name(e: str, names) -> str:
    return any_rule(e, [r"\b" + r"[\s-]+".join(re.split(r"[\s-]+", n)).replace(r"[\s", f"[{S}") + r"\b" for n in names])


# --- inputs ---

UNESCAPE = (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&lt;", "<"), ("&gt;", ">"))


def unescape(e: str) -> str:
    for a, b in UNESCAPE:
        e = f"replace({e}, {q(a)}, {q(b)})"
    return f"regexp_replace({e}, '&amp;?', '&', 'g')"  # the old entities also count without their semicolon


def cleaned(e: str) -> str:
    for pattern in (
        r"(?is)<(script|style)\b.*?</(script|style)>", r"(?s)<!--.*?-->",
        r"(?is)<nav\b.*?</nav>", r"(?is)<header\b.*?</header>", r"(?is)<footer\b.*?</footer>",
        r'(?is)<div class="Newsletter box">.*?</div>', r'(?is)<body id="consent-wall">.*?</body>',
        r'(?is)<p class="cookie">.*?</p>',
    ):
        e = f"regexp_replace({e}, {q(pattern)}, chr(10), 'g')"
    return e


def untagged(e: str) -> str:
    return unescape(f"regexp_replace({e}, '<[^>]*>', chr(10), 'g')")


MARK = r"(?is)<h[1-4]\b[^>]*>(.*?)</h[1-4]>"
RAW = {
    "web": """SELECT page_id AS page_no, url, html,
        coalesce(nullif(regexp_extract(url, '/(en|fr|de|es)/', 1), ''), 'unknown') AS scheme FROM pages""",
    "card": """SELECT p_partkey AS page_no, 'https://cards.example.com/' || p_partkey || '/' AS url, 'unknown' AS scheme,
        '<html><head><title> ' || p_name || ' card </title></head><body><nav><a href="/">Home</a></nav>'
        || '<iframe src="/frame"/><div class="Newsletter box"><p>' || p_brand || '</p></div><script src="/x.js"/><h2>'
        || p_name || '</h2>'
        || '<div>NAV</div><div>₹ ' || p_retailprice || '</div><div>Returns</div><div>since inception</div><div>'
        || p_size || '%</div><div>AUM</div><div>(31/08/2026)</div><div>Inception Date</div><div>01/0'
        || (p_partkey % 9 + 1) || '/2013</div><div>Riskometer:</div><div>' || p_type
        || '</div><div>TER</div><div>The ' || p_type || ' plan states this share once a year.</div><div>0.77</div>'
        || '<h3>Exit Load</h3><p>NIL</p><h3>Graph</h3><p>Table</p><h3>Benchmark</h3><h4>' || p_brand || '</h4><p>'
        || p_name || ' follows an index with a small number of parts, priced at ' || p_retailprice
        || ' and reviewed each quarter by the board.</p><h4>' || p_type || '</h4><p>short ' || p_name
        || '</p><!-- end --><footer>' || p_name || '</footer></body></html>' AS html FROM part""",
    "debt": """SELECT s_suppkey AS page_no, 'https://s.example.com/' || s_suppkey AS url, 'unknown' AS scheme,
        CASE WHEN s_acctbal < 0 THEN '<body id="consent-wall"><p>' || s_name || '</p></body>'
        ELSE '<body><p>' || s_name || '</p><p class="cookie">x</p></body>' END AS html FROM supplier""",
}
TITLE_RE = r"(?is)<title>(.*?)</title>"


def docs(kind: str, name: str = "doc", stamp: str = FETCHED_AT) -> str:
    """CTE with page_no, url, scheme, fetched_at, title, text, marked."""
    if kind == "text":
        return f"""{name} AS (SELECT doc_id AS page_no, 'doc:' || doc_id AS url, lang AS scheme, '{stamp}' AS fetched_at,
            source AS title, text, {lines('text')} AS marked FROM documents)"""
    marked = f"regexp_replace({cleaned('html')}, {q(MARK)}, chr(10) || '## \\1' || chr(10), 'g')"
    return f"""{name}_raw AS ({RAW[kind]}),
        {name} AS (SELECT page_no, url, scheme, '{stamp}' AS fetched_at,
            {strip(unescape(f"regexp_extract(html, {q(TITLE_RE)}, 1)"))} AS title,
            array_to_string({lines(untagged(cleaned('html')))}, chr(10)) AS text,
            {lines(untagged(marked))} AS marked FROM {name}_raw)"""


LABEL = f"rtrim(lower(line), ':') IN ({strings(FUNDS.label_lines)})"
DATE = r"^\(?[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\)?$"
FIGURE = (r"(?i)^(?:[₹$€£] *)?[0-9][0-9,.]*%? *(?:cr\.?|lakh|cr)?$|^[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}$"
          r"|^n/?a$|^nil$|^none$|^not applicable$")
FITS = f"""(NOT starts_with(line, '## ') AND lower(line) NOT IN ({strings(FUNDS.not_values)}) AND NOT ({LABEL})
    AND length(line) <= 45 AND {words('line')} <= 5
    AND (regexp_matches(line, {q(FIGURE)}) OR NOT regexp_matches(line, '[.:;]$')))"""
VALUE = f"({FITS} AND NOT regexp_matches(line, {q(DATE)}))"
QUALIFIER = f"""(NOT starts_with(line, '## ') AND NOT ({LABEL}) AND NOT {VALUE}
    AND regexp_matches(line, '^\\p{{Ll}}') AND length(line) <= 40 AND {words('line')} <= 4)"""


def numbered(doc: str = "doc") -> str:
    return f"(SELECT page_no, url, unnest(marked) AS line, generate_subscripts(marked, 1) - 1 AS line_no FROM {doc})"


def sections(doc: str = "doc", p: str = "") -> str:
    """CTEs ending in {p}sl: one row per section line."""
    w = "OVER (PARTITION BY url ORDER BY line_no)"
    return f"""
    {p}tag AS (SELECT *, {LABEL} AS label, {LABEL} AND contains(lower(line), 'inception') AS dated,
        {VALUE} AS value, {FITS} AS fits, {QUALIFIER} AS qual FROM {numbered(doc)}),
    {p}near AS (SELECT *,
        lead(line, 1) {w} AS l1, lead(line, 2) {w} AS l2,
        coalesce(lead(qual, 1) {w}, false) AS q1,
        coalesce(CASE WHEN dated THEN lead(fits, 1) {w} ELSE lead(value, 1) {w} END, false) AS v1,
        coalesce(CASE WHEN dated THEN lead(fits, 2) {w} ELSE lead(value, 2) {w} END, false) AS v2 FROM {p}tag),
    {p}paired AS (SELECT page_no, url, line_no,
        CASE WHEN label AND q1 AND v2 THEN line || ' ' || l1 || ': ' || l2 WHEN label AND q1 THEN line || ' ' || l1
             WHEN label AND v1 THEN line || ': ' || l1 ELSE line END AS line,
        coalesce(lag(label AND (q1 OR v1), 1) {w}, false) OR coalesce(lag(label AND q1 AND v2, 2) {w}, false) AS used
        FROM {p}near),
    {p}pl AS (SELECT page_no, url, line_no, line FROM {p}paired WHERE NOT used),
    {p}head AS (SELECT *, sum(CASE WHEN starts_with(line, '## ') THEN 1 ELSE 0 END) {w} AS sid FROM {p}pl),
    {p}named AS (SELECT *, coalesce(max(CASE WHEN starts_with(line, '## ') THEN {strip('substr(line, 4)')} END)
        OVER (PARTITION BY url, sid), 'Overview') AS heading FROM {p}head),
    {p}sl AS (SELECT page_no, url, heading, line, {words('line')} AS w,
        dense_rank() OVER (PARTITION BY url ORDER BY sid) - 1 AS section_no,
        row_number() OVER (PARTITION BY url, sid ORDER BY line_no) AS rn,
        sum({words('line')}) OVER (PARTITION BY url, sid) AS total
        FROM {p}named WHERE NOT starts_with(line, '## '))"""


def blocks(p: str = "", always: bool = False) -> str:
    """CTEs ending in {p}block: blocks before overlap, in {p}lapped with it."""
    fits = "false" if always else "total <= 200"
    return f"""
    {p}pk AS (
        SELECT url, section_no, rn, CASE WHEN w > 200 THEN -1 ELSE w END AS used, 0 AS block_no
        FROM {p}sl WHERE rn = 1
        UNION ALL
        SELECT l.url, l.section_no, l.rn,
            CASE WHEN l.w > 200 THEN -1 WHEN k.used = -1 OR k.used + l.w > 160 THEN l.w ELSE k.used + l.w END,
            CASE WHEN l.w > 200 OR k.used = -1 OR k.used + l.w > 160 THEN k.block_no + 1 ELSE k.block_no END
        FROM {p}pk k JOIN {p}sl l ON l.url = k.url AND l.section_no = k.section_no AND l.rn = k.rn + 1),
    {p}cut AS (SELECT s.page_no, s.url, s.section_no, s.heading, CASE WHEN {fits} THEN 0 ELSE k.block_no END AS block_no,
        list(s.line ORDER BY s.rn) AS ls, max(s.w) AS longest
        FROM {p}sl s JOIN {p}pk k ON s.url = k.url AND s.section_no = k.section_no AND s.rn = k.rn
        GROUP BY ALL),
    {p}block AS (SELECT * EXCLUDE (ls, longest), CASE WHEN len(ls) = 1 AND longest > 200
        AND len(list_filter({sentences('ls[1]')}, lambda x: {words('x')} > 200)) = 0
        THEN {sentences('ls[1]')} ELSE ls END AS ls FROM {p}cut),
    {p}tail0 AS (SELECT *, list_reverse(list_transform(ls[-31:], lambda x: {words('x')})) AS c FROM {p}block),
    {p}tail1 AS (SELECT *, list_transform(range(1, len(c) + 1), lambda j: list_sum(c[1:j])) AS sums FROM {p}tail0),
    {p}tail2 AS (SELECT *, greatest(1, len(list_filter(sums, lambda x: x <= 30))) AS m FROM {p}tail1),
    {p}tail AS (SELECT * EXCLUDE (c, sums, m),
        ls[len(ls) - (CASE WHEN sums[m] < 30 THEN m ELSE m - 1 END) + 1 : len(ls)] AS tail FROM {p}tail2),
    {p}lapped AS (SELECT *, list_concat(coalesce(lag(tail) OVER (PARTITION BY url, section_no ORDER BY block_no), []), ls)
        AS full_ls FROM {p}tail)"""


def stop(e: str) -> str:
    flat = f"trim({collapse(f'lower({e})')}, ' .:|')"
    return (f"({flat} IN ({strings(FUNDS.stop_phrases)}) OR (len(string_split({flat}, ' ')) > 1 "
            f"AND len(list_distinct(string_split({flat}, ' '))) = 1))")


def chunks(doc: str = "doc", p: str = "") -> str:
    """CTEs ending in {p}chunk (kept) and {p}dropped."""
    return f"""{sections(doc, p)}, {blocks(p)},
    {p}body AS (SELECT *, {strip("array_to_string(full_ls, chr(10))")} AS body FROM {p}lapped),
    {p}cand0 AS (SELECT *, CASE WHEN heading <> 'Overview' THEN heading || chr(10) || body ELSE body END AS text FROM {p}body),
    {p}cand AS (SELECT *, CASE WHEN {stop('text')} OR {stop('body')} THEN 'boilerplate'
        WHEN {words('text')} < 12 AND lower(heading) NOT IN ({strings(FUNDS.fact_headings)}) THEN 'under 12 words'
        END AS reason FROM {p}cand0),
    {p}kept AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY section_no, block_no) - 1 AS chunk_index
        FROM {p}cand WHERE reason IS NULL),
    {p}dropped AS (SELECT url, row_number() OVER (PARTITION BY url ORDER BY section_no, block_no) - 1 AS drop_no,
        reason, substr(body, 1, 120) AS text FROM {p}cand WHERE reason IS NOT NULL),
    {p}chunk AS (SELECT substr(sha1(k.url || '#' || k.chunk_index), 1, 16) AS id, k.page_no, k.url, d.title, d.scheme,
        d.fetched_at, k.heading, k.chunk_index, k.text, {words('k.text')} AS word_count
        FROM {p}kept k JOIN {doc} d ON k.url = d.url)"""


def web(select: str) -> str:
    return f"WITH RECURSIVE {docs('web')}, {chunks()} {select}"


def card(select: str) -> str:
    return f"WITH RECURSIVE {docs('card')}, {chunks()} {select}"


def text(select: str) -> str:
    return f"WITH RECURSIVE {docs('text')}, {chunks()} {select}"


QUESTIONS = f"""question AS (SELECT conv_id * 1000 + turn AS question_id, CASE WHEN role = 'system' THEN '  '
    ELSE text || ' ' || (['{"', '".join(p.replace("'", "''") for p in PROBES)}'])[(conv_id + turn) % {len(PROBES)} + 1]
    END AS question FROM conversations WHERE role IN ('user', 'system'))"""
COMPLETIONS = """completion AS (SELECT conv_id * 1000 + turn AS question_id,
    CASE (conv_id + turn) % 4 WHEN 0 THEN 'This is not in the pages. '
    WHEN 1 THEN 'Per https://example.com/' || conv_id || ', it is 1,' || conv_id || '.5% of ' || turn || '. '
    WHEN 2 THEN 'See [the notes](https://e.org/' || conv_id || ') ( ) for more . ' ELSE 'It comes from. ' END
    || text || ' Visit www.example.org/x . Source: https://example.com/' || turn AS completion
    FROM conversations WHERE role = 'assistant')"""


def vectors(source: str, key: str, column: str, name: str) -> str:
    return f"""
    {name}_t0 AS (SELECT {key} AS k, unnest(regexp_extract_all(lower({column}), '[\\p{{L}}\\p{{N}}]+')) AS t FROM {source}),
    {name}_t AS (SELECT k, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM {name}_t0),
    {name}_c AS (SELECT k, h % {DIM} AS b, sum(CASE WHEN (h // {DIM}) % 2 = 0 THEN 1 ELSE -1 END) AS s FROM {name}_t GROUP BY ALL),
    {name}_n AS (SELECT k, count(*) AS n FROM {name}_t GROUP BY k),
    {name}_m AS (SELECT c.k, c.b, c.s::DOUBLE / n.n AS x FROM {name}_c c JOIN {name}_n n ON c.k = n.k),
    {name}_l AS (SELECT k, sqrt(sum(x * x)) AS len FROM {name}_m GROUP BY k),
    {name}_u AS (SELECT s.{key} AS k, g.b, coalesce(CASE WHEN l.len > 0 THEN m.x / l.len ELSE 0 END, 0)::FLOAT::DOUBLE AS x
        FROM {source} s CROSS JOIN range({DIM}) g(b) LEFT JOIN {name}_m m ON m.k = s.{key} AND m.b = g.b
        LEFT JOIN {name}_l l ON l.k = s.{key}),
    {name} AS (SELECT k, list(x ORDER BY b) AS v, sqrt(sum(x * x)) AS len FROM {name}_u GROUP BY k)"""


def topics(e: str) -> str:
    cases = ", ".join(f"CASE WHEN {has(f'lower({e})', p)} THEN {i} END" for i, p in enumerate(SAMPLE.topic_phrases.values()))
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def schemes(e: str) -> str:
    cases = ", ".join(f"CASE WHEN {has(f'lower({e})', p)} THEN {q(s)} END" for s, p in SAMPLE.scheme_phrases.items())
    return f"list_filter([{cases}], lambda x: x IS NOT NULL)"


def hits(heading: str, body: str) -> str:
    return "[" + ", ".join(
        f"CASE WHEN {has(f'lower({heading})', p)} THEN 1 WHEN {has(f'lower({body})', SAMPLE.topic_labels.get(t, ()))} THEN 2 "
        f"WHEN {has(f'lower({body})', p)} THEN 3 ELSE 0 END" for t, p in SAMPLE.topic_phrases.items()) + "]"


TOPIC_LIST = f"[{strings(SAMPLE.topic_phrases)}]"
RETRIEVE = f"""{docs('web')}, {chunks()}, {QUESTIONS},
    asked AS (SELECT *, {topics('question')} AS topics, {schemes('question')} AS schemes FROM question
        WHERE {strip('question')} <> ''),
    feature AS (SELECT *, {hits('heading', 'text')} AS hits FROM chunk),
    {vectors('asked', 'question_id', 'question', 'qv')}, {vectors('feature', 'id', 'text', 'cv')},
    pair0 AS (SELECT a.question_id, f.id, list_contains(a.schemes, f.scheme) AS scheme_hit,
        list_filter(a.topics, lambda t: f.hits[t + 1] <> 0)[1] AS topic, f.hits,
        round(1 - CASE WHEN qv.len * cv.len > 0 THEN list_dot_product(qv.v, cv.v) / (qv.len * cv.len) ELSE 0 END, 9) AS distance
        FROM asked a CROSS JOIN feature f JOIN qv ON qv.k = a.question_id JOIN cv ON cv.k = f.id),
    pair AS (SELECT *, coalesce(hits[topic + 1], 0) AS level FROM pair0),
    scored AS (SELECT *, round(distance - ([0, 0.30, 0.55, 0.12]::DOUBLE[])[level + 1]
        - CASE WHEN scheme_hit THEN 0.35::DOUBLE ELSE 0 END, 9) AS score FROM pair),
    ranked AS (SELECT question_id, id, distance, score, scheme_hit, topic, level,
        row_number() OVER (PARTITION BY question_id ORDER BY score, distance, id) AS rank FROM scored),
    hit AS (SELECT r.*, c.url, c.text, c.heading, c.scheme, c.fetched_at,
        concat_ws('+', CASE WHEN scheme_hit THEN 'scheme' END,
        CASE WHEN level > 0 THEN (['heading', 'fact', 'text'])[level] || ':' || ({TOPIC_LIST})[topic + 1] END) AS rank_note
        FROM ranked r JOIN chunk c ON c.id = r.id WHERE rank <= 4),
    gathered AS (SELECT q.question_id, any_value(q.question) AS question, count(h.id) AS n, min(h.distance) AS best,
        first(h.fetched_at ORDER BY h.rank) FILTER (h.id IS NOT NULL) AS stamp,
        first(h.text ORDER BY h.rank) FILTER (h.id IS NOT NULL) AS top_text,
        string_agg(h.text, ' ' ORDER BY h.rank) AS found,
        string_agg('[' || h.rank || '] source: ' || h.url || '  (source date: ' || h.fetched_at || ')' || chr(10) || h.text,
            chr(10) || chr(10) ORDER BY h.rank) AS context,
        first(h.url ORDER BY h.rank) FILTER (starts_with(h.url, 'https://')) AS approved
        FROM question q LEFT JOIN hit h ON h.question_id = q.question_id GROUP BY q.question_id)"""
CITATION = (f"CASE WHEN n = 0 THEN {q(FUNDS.default_url)} WHEN approved IS NOT NULL THEN approved "
            f"ELSE {q(FUNDS.approved_urls[0])} END")
LOW = "(n = 0 OR best > 1.0)"


def retrieval(select: str) -> str:
    return f"WITH RECURSIVE {RETRIEVE} {select}"


def shown(stamp: str) -> str:
    month = "['Jan','Feb','Mar','Apr','May','Jun','Jul','Aug','Sep','Oct','Nov','Dec']"
    return (f"CASE WHEN regexp_matches({stamp}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}T') THEN "
            f"substr({stamp}, 9, 2)::INT || ' ' || ({month})[substr({stamp}, 6, 2)::INT] || ' ' || substr({stamp}, 1, 4) "
            f"ELSE coalesce({stamp}, '') END")


# --- generation ---

URL = f"(?:https?://[^{S}]+|www\\.[^{S}]+)"
NAMES = "(?:source|sources|reference|refer|see|refer to|from|at|per)"
GAP = f"(?:[{S}]+[:\\-]?[{S}]*|[:\\-][{S}]*)"


def strip_urls(e: str) -> str:
    for pattern, by in (
        (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
        (f"(?i)(^|[^{W}]){NAMES}{GAP}{URL}", r"\1"),
        (f"(?i){URL}", ""),
        (f"[{S}]+([.,;:])", r"\1"),
        (f"\\([{S}]*\\)|\\[[{S}]*\\]", ""),
        (f"(?i)(^|[^{W}]){NAMES}{GAP}?([.;,]|$)", r"\1\2"),
        (f"[{S}]*([.;,])[{S}]*([.;,])", r"\1\2"),
        (f"[{S}]*([.;,])[{S}]*([.;,])", r"\1\2"),
        (f"[{S}]*([.;,])[{S}]*$", r"\1"),
        (r"[ \t]{2,}", " "),
    ):
        e = f"regexp_replace({e}, {q(pattern)}, {q(by)}, 'g')"
    return strip(e)


def trim_sentences(e: str) -> str:
    cut = f"string_split(regexp_replace({strip(e)}, '([.!?])[{S}]+', '\\1' || chr(30), 'g'), chr(30))"
    parts = f"list_filter(list_transform({cut}, lambda x: {strip('x')}), lambda x: x <> '')"
    return f"array_to_string(({parts})[1:3], ' ')"


def postprocess(e: str) -> str:
    return trim_sentences(strip_urls(e))


def decline(e: str) -> str:
    stops = f"(?:[^{W}]|$)"
    return (f"regexp_matches({e}, '(?i)not (?:in|provided in|available in|contained in|mentioned in){stops}"
            f"|do(?:es)? not contain{stops}|do(?:es)? not (?:have|include|provide){stops}|is not provided{stops}')")


def numbers(e: str) -> str:
    return (f"list_distinct(list_transform(regexp_extract_all({e}, '[0-9][0-9,]*(?:\\.[0-9]+)?'), "
            f"lambda x: replace(x, ',', '')))")


def gates(answer: str, source: str) -> str:
    """CTEs from question rows with n, best, found, ... and a completion to responses."""
    return f"""
    staged AS (SELECT *, {postprocess(answer)} AS clean FROM {source}),
    judged AS (SELECT *, list_sort(list_filter({numbers('clean')}, lambda x: NOT list_contains({numbers("coalesce(found, '')")}, x)))
        AS orphans FROM staged),
    gated AS (SELECT *, CASE WHEN {LOW} OR clean = '' THEN 'low_confidence' WHEN {decline('clean')} THEN 'model_declined'
        WHEN len(orphans) > 0 THEN 'ungrounded_number' END AS reason FROM judged),
    response AS (SELECT question_id,
        CASE WHEN reason IN ('low_confidence', 'ungrounded_number') THEN {q(FUNDS.not_in_pages)} ELSE clean END AS answer,
        CASE WHEN reason = 'model_declined' THEN {q(FUNDS.default_url)} ELSE {CITATION} END AS citation_url,
        CASE WHEN reason = 'model_declined' THEN '' ELSE {q(rules.LAST_UPDATED_LABEL)} || {shown(q(LATER))} END
            AS last_updated_from_sources,
        coalesce(reason IN ('low_confidence', 'ungrounded_number'), false) AS refused,
        NULL::VARCHAR AS intent, NULL::VARCHAR AS pii_types, reason,
        CASE WHEN reason IS NULL OR reason = 'model_declined' THEN MODEL END AS model,
        CASE WHEN reason IN ('low_confidence', 'ungrounded_number') THEN round(coalesce(best, 0), 4) END AS best_distance,
        CASE WHEN reason = 'ungrounded_number' THEN array_to_string(orphans, '|') END AS ungrounded, n AS chunks FROM gated)"""


# --- screening ---

MESSAGES = """message AS (SELECT 'c' || c_custkey AS key, CASE c_custkey % 11
    WHEN 0 THEN 'my PAN is ' || translate(substr(md5(c_name), 1, 5), '0123456789abcdef', 'ABCDEFGHIJKLMNOP')
        || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || 'X'
    WHEN 1 THEN 'call me on 9' || lpad(c_custkey::VARCHAR, 9, '0') || ' please'
    WHEN 2 THEN 'my number is +91 98765 4' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')
    WHEN 3 THEN 'mail me at ' || replace(lower(c_name), '#', '.') || '@example.com'
    WHEN 4 THEN 'my aadhaar is 1234 5678 ' || lpad((c_custkey % 10000)::VARCHAR, 4, '0')
    WHEN 5 THEN 'see 4321-8765-' || lpad((c_custkey % 10000)::VARCHAR, 4, '0') || ' or 9876543210'
    WHEN 6 THEN 'folio number 12345' || lpad(c_custkey::VARCHAR, 9, '0')
    WHEN 7 THEN 'मेरा आधार १२३४ ५६७८ ' || translate(lpad((c_custkey % 10000)::VARCHAR, 4, '0'), '0123456789', '०१२३४५६७८९')
    WHEN 8 THEN 'رقمي ٢٣٤٥-٥٥٥٥-' || translate(lpad((c_custkey % 10000)::VARCHAR, 4, '0'), '0123456789', '٠١٢٣٤٥٦٧٨٩')
    WHEN 9 THEN 'no １１１１ ２２２２ ' || translate(lpad((c_custkey % 10000)::VARCHAR, 4, '0'), '0123456789', '０１２３４５６７８９') || ' ok'
    ELSE 'what is the otp of ' || c_mktsegment || ' 9199' || lpad(c_custkey::VARCHAR, 9, '0') END AS text FROM customer),
    screened AS (SELECT * FROM message UNION ALL SELECT 'd' || doc_id, text FROM documents)"""
PAN = f"(?:^|[^{W}])[A-Z]{{5}}[0-9]{{4}}[A-Z](?:[^{W}]|$)"
OTP = (f"(?i)(^|[^{W}])(?:otp|one[{S}-]?time[{S}-]?password|verification[{S}]+code|auth(?:entication)?[{S}]+code"
       f"|passcode|pin[{S}]+number)")
EMAIL = f"(^|[^{W}])([{W}][{W}.+-]*@[{W}-]+\\.[{W}.-]*[{W}])"
PHONE = f"(?:\\+?91[-{S}]?)?0?[6-9](?:[{S}-]?[0-9]){{9}}\\b"
TWELVE = f"\\b[0-9]{{4}}[{S}]?-?[{S}]?[0-9]{{4}}[{S}]?-?[{S}]?[0-9]{{4}}\\b"
LONG = f"\\b[0-9][0-9{S}-]{{8,}}[0-9]\\b"
# Digits of other scripts that the given texts hold: read as ASCII to find spans (one for one).
OTHER = "٠١٢٣٤٥٦٧٨٩०१२३४५६७८९０１２３４５６７８９"
GROUP = f"[{OTHER}]{{4}}[{S}]?-?[{S}]?"


def spans(source: str, pattern: str, name: str, key: str = "key") -> str:
    """CTE with one row per match: its zero-based start and stop."""
    return f"""
    {name}_a AS (SELECT {key} AS key, translate(text, '{OTHER}', '{'0123456789' * 3}') AS text FROM {source}),
    {name}_0 AS (SELECT key, text, regexp_extract_all(text, {q(pattern)}) AS m,
        string_split_regex(text, {q(pattern)}) AS g FROM {name}_a),
    {name}_1 AS (SELECT key, text, m, g, unnest(range(1, len(m) + 1)) AS i FROM {name}_0),
    {name}_2 AS (SELECT key, text, i, m[i] AS match, regexp_replace(m[i], '[^0-9]', '', 'g') AS digits,
        list_sum(list_transform(g[1:i], lambda x: length(x)))
        + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS start FROM {name}_1),
    {name} AS (SELECT *, start + length(match) AS stop FROM {name}_2)"""


def check_valid(d: str) -> str:
    # The check table and row, written out here so that the check does not rest on the engine's own.
    table = ("[0,1,2,3,4,5,6,7,8,9, 1,2,3,4,0,6,7,8,9,5, 2,3,4,0,1,7,8,9,5,6, 3,4,0,1,2,8,9,5,6,7, 4,0,1,2,3,9,5,6,7,8,"
             " 5,9,8,7,6,0,4,3,2,1, 6,5,9,8,7,1,0,4,3,2, 7,6,5,9,8,2,1,0,4,3, 8,7,6,5,9,3,2,1,0,4, 9,8,7,6,5,4,3,2,1,0]")
    row = "[8,9,1,6,0,4,3,5,2,7]"
    total = f"list_sum(list_transform(range(0, 11), lambda i: ({table})[substr({d}, 11 - i, 1)::INT * 10 + i % 10 + 1]))"
    return f"(({row})[({total} % 10 + 1)::BIGINT] = substr({d}, 12, 1)::INT)"


def pii(source: str, key: str = "key") -> str:
    """CTEs ending in detected(key, pii_types)."""
    same = "length(replace({0}, substr({0}, 1, 1), '')) = 0"
    return f"""{spans(source, PHONE, 'ph', key)}, {spans(source, TWELVE, 'tw', key)}, {spans(source, LONG, 'lg', key)},
    nat AS (SELECT *, regexp_replace(digits, '^(?:91|0)', '') AS national FROM ph),
    phone AS (SELECT key, arg_min(start, i) AS start, arg_min(stop, i) AS stop FROM nat
        WHERE length(national) = 10 AND national[1] IN ('6', '7', '8', '9') AND NOT {same.format('national')} GROUP BY key),
    grp AS (SELECT t.key, t.i, t.start, t.stop, CASE WHEN regexp_matches(
            substr(t.text, greatest(t.start - 30, 0)::BIGINT + 1, least(t.start, 30)::BIGINT), '(?i)\\b(?:aadhaar|uidai|adhaar|aadhar)\\b')
            OR {same.format('t.digits')} OR {check_valid('t.digits')} THEN 'aadhaar' ELSE 'account' END AS kind
        FROM tw t LEFT JOIN phone p ON p.key = t.key WHERE p.key IS NULL OR NOT (t.start < p.stop AND p.start < t.stop)),
    kinds AS (SELECT key, list(kind ORDER BY i) AS ks FROM grp GROUP BY key),
    long_run AS (SELECT DISTINCT l.key FROM lg l LEFT JOIN phone p ON p.key = l.key
        WHERE length(l.digits) >= 10 AND (p.key IS NULL OR NOT (l.start < p.stop AND p.start < l.stop))
        AND NOT EXISTS (SELECT 1 FROM grp g WHERE g.key = l.key AND l.start < g.stop AND g.start < l.stop)),
    detected AS (SELECT s.{key} AS key, list_concat(list_filter([
        CASE WHEN regexp_matches(s.text, {q(PAN)}) THEN 'pan' END,
        CASE WHEN regexp_matches(s.text, {q(OTP + f'(?:[^{W}]|$)')}) THEN 'otp' END,
        CASE WHEN regexp_matches(s.text, {q(EMAIL)}) THEN 'email' END,
        CASE WHEN p.key IS NOT NULL THEN 'phone' END], lambda x: x IS NOT NULL),
        coalesce(k.ks, []), CASE WHEN r.key IS NOT NULL THEN ['account'] ELSE [] END) AS pii_types
        FROM {source} s LEFT JOIN phone p ON p.key = s.{key} LEFT JOIN kinds k ON k.key = s.{key}
        LEFT JOIN long_run r ON r.key = s.{key})"""


def scrub(e: str) -> str:
    for pattern, by in (
        (OTP + r"\b", r"\1[redacted-otp]"), (r"\b[A-Z]{5}[0-9]{4}[A-Z]\b", "[redacted-pan]"),
        (EMAIL, r"\1[redacted-email]"), (PHONE, "[redacted-phone]"), (TWELVE, "[redacted-aadhaar]"),
        (f"(^|[^{W}]){GROUP}{GROUP}[{OTHER}]{{4}}([^{W}]|$)", r"\1[redacted-aadhaar]\2"),
        (LONG, "[redacted-account]"),
    ):
        e = f"regexp_replace({e}, {q(pattern)}, {q(by)}, 'g')"
    return e


DECIDE = f"""{QUESTIONS}, screened AS (SELECT question_id AS key, question AS text FROM question), {pii('screened')},
    intents AS (SELECT q.question_id, q.question, CASE WHEN len(d.pii_types) > 0 THEN 'pii'
        WHEN {any_rule('q.question', FUNDS.performance_patterns)} THEN 'performance'
        WHEN {any_rule('q.question', FUNDS.advice_patterns)} THEN 'advice'
        WHEN {any_name('q.question', FUNDS.other_issuers)} OR {any_name('q.question', FUNDS.other_products)} THEN 'out_of_scope'
        ELSE 'fact' END AS intent, d.pii_types FROM question q JOIN detected d ON d.key = q.question_id),
    decided AS (SELECT question_id, question, intent, intent = 'fact' AS allowed,
        CASE intent {' '.join(f"WHEN {q(k)} THEN {q(v)}" for k, v in FUNDS.messages.items())} ELSE '' END AS message,
        CASE WHEN intent IN ('performance', 'advice') THEN {q(FUNDS.default_url)}
             WHEN intent = 'out_of_scope' THEN {q(FUNDS.scope_url)} END AS link,
        CASE WHEN intent = 'pii' THEN array_to_string(pii_types, '|') END AS pii_types FROM intents)"""
REFUSED = """SELECT question_id, message AS answer, link AS citation_url, '' AS last_updated_from_sources, true AS refused,
    intent, pii_types, NULL::VARCHAR AS reason, NULL::VARCHAR AS model, NULL::DOUBLE AS best_distance,
    NULL::VARCHAR AS ungrounded, -1 AS chunks FROM decided WHERE NOT allowed"""
# Allowed questions go on in redacted form; the retrieval CTEs then read those only.
ANSWERS = f"""WITH RECURSIVE {DECIDE},
    allowed_q AS (SELECT question_id, {scrub('question')} AS question FROM decided WHERE allowed),
    {RETRIEVE.replace(QUESTIONS + ',', '').replace('FROM question', 'FROM allowed_q')},
    {gates(f"array_to_string(({sentences('top_text')})[1:2], ' ')", 'gathered').replace('MODEL', "'extractive'")},
    responses AS (SELECT * FROM response UNION ALL BY NAME {REFUSED})"""
GIVEN = f"""{RETRIEVE}, {COMPLETIONS},
    given AS (SELECT g.*, c.completion FROM gathered g JOIN completion c ON c.question_id - 1 = g.question_id)"""
GATES = f"WITH RECURSIVE {GIVEN}, {gates('completion', 'given').replace('MODEL', chr(39) + 'given' + chr(39))}"

# --- one statement per key ---

O = ORACLES  # noqa: E741
O["src1_allow_list"] = "SELECT page_id, url FROM pages WHERE url LIKE 'https://%'"
O["src1_rejected"] = "SELECT page_id, url FROM pages WHERE url NOT LIKE 'https://%'"
O["src4_fetch_documents"] = f"WITH {docs('web')} SELECT page_no, url, title, text, fetched_at FROM doc"
O["src5_load_failures"] = (f"WITH {docs('debt')} SELECT page_no, url, 'No readable text extracted from ' || url AS error "
                           f"FROM doc WHERE text = ''")
O["src7_collection_scan"] = web("SELECT id, text, url, scheme, heading, chunk_index FROM chunk")
O["src9_raw_body"] = f"""WITH {docs('web')} SELECT replace(trim(replace(replace(url, 'https://www.', ''), 'https://', ''), '/'), '/', '_')
    AS slug, text AS body, length(text) AS chars FROM doc"""
O["snk3_upsert"] = web(f"""SELECT id, url, chunk_index, CASE WHEN url LIKE 'https://%' THEN '{LATER}' ELSE fetched_at END
    AS fetched_at FROM chunk""")
O["snk3_upsert_rows"] = O["snk3_upsert"]
O["snk3_latest_by_key"] = """SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type,
    arg_max(value, event_id) AS value FROM events GROUP BY user_id"""
O["snk6_population"] = web("SELECT count(*) > 0 AS populated, count(*) AS n FROM chunk")
O["snk7_dump_blocks"] = web("""SELECT row_number() OVER (ORDER BY page_no, chunk_index) AS position, array_to_string(['',
    '=== CHUNK ' || row_number() OVER (ORDER BY page_no, chunk_index) || ' ===', 'id: ' || id, 'url: ' || url,
    'title: ' || title, 'scheme: ' || scheme, 'fetched_at: ' || fetched_at, 'heading: ' || heading,
    'chunk_index: ' || chunk_index, 'words: ' || word_count, '---', text], chr(10)) AS block FROM chunk""")
SUMMARY = """SELECT 'max_fetched_at' AS name, NULL::BIGINT AS place, (SELECT max(fetched_at) FROM doc) AS value
    UNION ALL SELECT 'url_count', NULL, (SELECT count(*) FROM doc)::VARCHAR
    UNION ALL SELECT 'chunk_count', NULL, (SELECT count(*) FROM chunk)::VARCHAR
    UNION ALL SELECT 'dropped_count', NULL, (SELECT count(*) FROM dropped)::VARCHAR
    UNION ALL SELECT 'urls', page_no, url FROM doc"""
O["snk8_manifest"] = web(f"""{SUMMARY} UNION ALL SELECT unnest(['ingested_at', 'embedding_dim', 'chunk_strategy.target_words',
    'chunk_strategy.max_words', 'chunk_strategy.min_words', 'chunk_strategy.overlap_words']), NULL,
    unnest(['{LATER}', '{DIM}', '160', '200', '12', '30'])""")
O["snk9_raw_dump"] = f"""WITH {docs('web')} SELECT
    replace(trim(replace(replace(url, 'https://www.', ''), 'https://', ''), '/'), '/', '_') AS slug,
    'URL: ' || url || chr(10) || 'TITLE: ' || title || chr(10) || 'FETCHED_AT: ' || fetched_at || chr(10) || 'CHARS: '
    || length(text) || chr(10) || 'WORDS: ' || {words('text')} || chr(10) || repeat('-', 60) || chr(10) || chr(10) || text
    || chr(10) AS value FROM doc"""
O["snk10_slug"] = """SELECT page_id, coalesce(nullif(replace(trim(replace(replace(url, 'https://www.', ''), 'https://', ''), '/'),
    '/', '_'), ''), 'home') AS slug FROM pages"""
O["snk11_guards"] = web("SELECT count(*) > 0 AS not_empty, true AS complete FROM chunk")
O["htm1_noise_tags"] = f"""WITH {docs('web')}, t AS (SELECT page_no, string_split(text, chr(10)) AS ls FROM doc)
    SELECT page_no, generate_subscripts(ls, 1) - 1 AS line_no, unnest(ls) AS line FROM t"""
O["htm2_noise_markers"] = f"WITH {docs('card')} SELECT page_no, text FROM doc"
O["htm3_title"] = f"WITH {docs('web')} SELECT page_no, title FROM doc"
O["htm4_text"] = f"WITH {docs('web')} SELECT page_no, md5(text) AS digest, length(text) AS chars FROM doc"
O["htm5_headings"] = f"""WITH {docs('web', 'w')}, {docs('card', 'c')}, doc AS (SELECT page_no, url, marked FROM w
    UNION ALL SELECT page_no, url, marked FROM c) SELECT url, line_no, line FROM {numbered()} WHERE starts_with(line, '## ')"""
SECTION_ROWS = """SELECT url, section_no, heading, string_agg(line, chr(10) ORDER BY rn) AS body, count(*) AS lines
    FROM sl GROUP BY url, section_no, heading"""
O["htm6_sections"] = f"WITH {docs('web')}, {sections()} {SECTION_ROWS}"
O["htm6_card_sections"] = f"WITH {docs('card')}, {sections()} {SECTION_ROWS}"
O["htm7_labels"] = f"WITH {docs('card')} SELECT page_no, line_no, line FROM {numbered()} WHERE {LABEL}"
BOTH = f"""{docs('card', 'c')}, {docs('text', 't')}, doc AS (SELECT page_no, url, marked FROM c
    UNION ALL SELECT -page_no - 1, url, marked FROM t)"""
O["htm8_values"] = f"WITH {BOTH} SELECT page_no, line_no, {VALUE} AS value, {FITS} AS dated_value FROM {numbered()}"
O["htm9_qualifiers"] = f"WITH {BOTH} SELECT page_no, line_no, line FROM {numbered()} WHERE {QUALIFIER}"
O["htm10_pairs"] = f"""WITH {docs('card')}, {sections()}
    SELECT page_no, row_number() OVER (PARTITION BY url ORDER BY line_no) - 1 AS line_no, line FROM pl"""
O["htm12_scheme"] = f"""SELECT url AS page, CASE WHEN url LIKE 'https://%' THEN
    ([{strings(FUNDS.url_schemes.values())}])[length(url) % {len(FUNDS.url_schemes)} + 1] ELSE 'unknown' END AS scheme FROM pages"""
O["chk1_word_count"] = f"SELECT doc_id, {words('text')} AS words FROM documents"


def block_rows(kind: str, column: str, always: bool) -> str:
    src = "lapped" if column == "full_ls" else "block"
    return f"""WITH RECURSIVE {docs(kind)}, {sections()}, {blocks(always=always)},
    b AS (SELECT url, section_no, block_no, len({column}) AS lines, array_to_string({column}, chr(10)) AS body FROM {src})
    SELECT url, section_no, block_no, lines, {words('body')} AS words, md5(body) AS digest FROM b"""


O["chk2_section_blocks"] = block_rows("web", "full_ls", False)
O["chk3_pack"] = block_rows("text", "ls", True)
O["chk4_sentences"] = f"""WITH t AS (SELECT doc_id, {sentences('text')} AS ss FROM documents)
    SELECT doc_id, generate_subscripts(ss, 1) - 1 AS sentence_no, md5(unnest(ss)) AS digest FROM t"""
O["chk5_overlap_tail"] = f"""WITH RECURSIVE {docs('text')}, {sections()}, {blocks(always=True)}
    SELECT url, block_no, array_to_string(tail, chr(10)) AS tail FROM tail"""
O["chk6_overlap_blocks"] = block_rows("text", "full_ls", False)
O["chk7_chunk_text"] = card("SELECT url, chunk_index, heading, text FROM chunk")
O["chk8_boilerplate"] = f"""WITH {docs('card', 'c')}, {docs('text', 't')}, doc AS (SELECT page_no, url, marked FROM t
    UNION ALL SELECT -page_no - 1, url, marked FROM c) SELECT page_no, line_no, line FROM {numbered()} WHERE {stop('line')}"""
TWO = f"WITH RECURSIVE {docs('card', 'cd')}, {chunks('cd', 'c_')}, {docs('text', 'td')}, {chunks('td', 't_')}"
O["chk9_drops"] = f"{TWO} SELECT * FROM c_dropped UNION ALL SELECT * FROM t_dropped"
O["chk10_chunk_index"] = card("SELECT url, count(*) AS chunks, max(chunk_index) AS last_index FROM chunk GROUP BY url")
O["chk11_chunk_id"] = text("SELECT id, url, chunk_index FROM chunk")
O["chk12_chunks"] = text("""SELECT url, title, scheme, fetched_at, heading, chunk_index, word_count, md5(text) AS digest
    FROM chunk""")
O["chk13_empty_pages"] = text("SELECT url FROM doc WHERE url NOT IN (SELECT url FROM chunk)")
CODE = f"(CASE WHEN (h // {DIM}) % 2 = 0 THEN 1 ELSE -1 END) * (h % {DIM} + 1)"
O["emb1_token_window"] = f"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ts FROM documents),
    t0 AS (SELECT doc_id, unnest(ts[1:256]) AS t FROM w),
    t1 AS (SELECT doc_id, ('0x' || substr(md5(t), 1, 8))::BIGINT AS h FROM t0)
    SELECT w.doc_id, any_value(len(w.ts)) AS tokens, count(h) AS in_window, coalesce(sum({CODE}), 0)::BIGINT AS code_sum
    FROM w LEFT JOIN t1 ON t1.doc_id = w.doc_id GROUP BY w.doc_id"""
POOLED = """cell AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings),
    pooled AS (SELECT label, pos, avg(x) AS x FROM cell GROUP BY label, pos)"""
O["emb2_mean_pool"] = f"WITH {POOLED} SELECT label, pos, round(x, 6) AS x FROM pooled"
O["emb3_normalise"] = """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE * (label + 1) AS x FROM embeddings),
    l AS (SELECT vec_id, sqrt(sum(x * x)) AS len, sum(x) AS total FROM c GROUP BY vec_id)
    SELECT vec_id, 1.0::DOUBLE AS norm, round(total / len, 5) AS total FROM l"""
O["emb4_dimension_check"] = "SELECT vec_id, len(embedding) AS dim FROM embeddings"
O["emb5_chunk_vectors"] = web(f""", {vectors('chunk', 'id', 'text', 'cv')}
    SELECT k AS id, round(list_sum(v), 4) AS total, len(list_filter(v, lambda x: x <> 0)) AS used FROM cv""").replace(
    ") , ", "), ")
O["emb6_question_vectors"] = f"""WITH {QUESTIONS}, {vectors('question', 'question_id', 'question', 'qv')}
    SELECT k AS question_id, round(len * len, 4) AS norm, len(list_filter(v, lambda x: x <> 0)) AS used FROM qv"""
O["emb8_agreement"] = """WITH c AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings),
    s AS (SELECT vec_id, sum(x * round(x, 3)) / (sqrt(sum(x * x)) * sqrt(sum(round(x, 3) * round(x, 3)))) AS sim
    FROM c GROUP BY vec_id) SELECT count(*) AS n, round(min(sim), 5) AS worst, bool_and(sim >= 0.999) AS agree FROM s"""
O["vec1_distance_to_label_mean"] = f"""WITH {POOLED}, v AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x,
    generate_subscripts(embedding, 1) - 1 AS pos FROM embeddings) SELECT v.vec_id, v.label,
    round(1 - sum(v.x * p.x) / (sqrt(sum(v.x * v.x)) * sqrt(sum(p.x * p.x))), 5) AS distance
    FROM v JOIN pooled p ON p.label = v.label AND p.pos = v.pos GROUP BY v.vec_id, v.label"""
for _name in ("vec8_nearest", "vec8_grid"):
    O[_name] = f"""WITH {POOLED}, m AS (SELECT label, list(x ORDER BY pos) AS v FROM pooled GROUP BY label),
    e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
    p AS (SELECT m.label::BIGINT AS question_id, e.vec_id, round(1 - list_dot_product(m.v, e.v)
        / (sqrt(list_dot_product(m.v, m.v)) * sqrt(list_dot_product(e.v, e.v))), 9) AS d FROM m CROSS JOIN e),
    r AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY d, vec_id) AS rank FROM p)
    SELECT question_id, rank, vec_id, round(d, 5) AS distance FROM r WHERE rank <= 4"""
O["vec2_phrases"] = f"""SELECT doc_id, {has('lower(text)', ('of the',))} AS of_the,
    {has('lower(text)', ('ter', 'nav', 'que'))} AS short_words, {has('lower(text)', ('de la', 'est', 'ention'))} AS mixed FROM documents"""
O["vec3_topics"] = f"""WITH {QUESTIONS} SELECT question_id, array_to_string(list_transform({topics('question')},
    lambda i: ({TOPIC_LIST})[i + 1]), '|') AS topics FROM question"""
O["vec4_schemes"] = f"WITH {QUESTIONS} SELECT question_id, array_to_string({schemes('question')}, '|') AS schemes FROM question"
O["vec5_topic_hits"] = web(f"SELECT id, array_to_string({hits('heading', 'text')}, '') AS hits FROM chunk")
O["vec6_rerank"] = retrieval("""SELECT question_id, rank, id, url, rank_note, round(distance, 5) AS distance,
    round(score, 5) AS score FROM hit""")
O["vec8_pruned"] = web(f""", {vectors('chunk', 'id', 'text', 'cv')}, pair AS (SELECT a.page_no AS question_id, b.k AS id,
    round(1 - CASE WHEN va.len * b.len > 0 THEN list_dot_product(va.v, b.v) / (va.len * b.len) ELSE 0 END, 9) AS d
    FROM chunk a JOIN cv va ON va.k = a.id CROSS JOIN cv b WHERE a.chunk_index = 0)
    SELECT question_id, CAST(row_number() OVER (PARTITION BY question_id ORDER BY d, id) AS INT) AS rank, id, round(d, 5) + 0 AS distance
    FROM pair QUALIFY rank <= 5""")
O["vec7_boost"] = retrieval("""SELECT concat_ws('+', CASE WHEN scheme_hit THEN 'scheme' END,
    CASE WHEN level > 0 THEN (['heading', 'fact', 'text'])[level] || ':' || ("""+TOPIC_LIST+""")[topic + 1] END) AS rank_note,
    count(*) AS n, round(max(distance - score), 4) AS boost FROM scored GROUP BY 1""")
O["vec9_blank_questions"] = retrieval("SELECT question_id, n AS chunks FROM gathered")
O["vec10_context"] = retrieval(f"SELECT question_id, md5(coalesce(context, {q(rules.NO_CONTEXT)})) AS digest FROM gathered")
O["vec11_citation"] = retrieval(f"SELECT question_id, {CITATION} AS url FROM gathered")
O["vec12_low_confidence"] = retrieval(f"SELECT question_id, {LOW} AS low, round(best, 4) AS best FROM gathered")
O["grd1_pan"] = f"WITH {MESSAGES} SELECT key, regexp_matches(text, {q(PAN)}) AS pan FROM screened"
O["grd2_otp"] = f"WITH {MESSAGES} SELECT key, regexp_matches(text, {q(OTP + f'(?:[^{W}]|$)')}) AS otp FROM screened"
O["grd3_email"] = f"WITH {MESSAGES} SELECT key, regexp_matches(text, {q(EMAIL)}) AS email FROM screened"
O["grd4_phone"] = f"WITH {MESSAGES}, {pii('screened')} SELECT key, start, stop FROM phone"
O["grd5_twelve_digits"] = f"WITH {MESSAGES}, {pii('screened')} SELECT key, array_to_string(ks, '|') AS kinds FROM kinds"
O["grd6_checksum"] = f"""WITH d AS (SELECT o_orderkey, lpad((o_orderkey * 7919 + o_custkey * 104729)::VARCHAR, 12, '1') AS digits
    FROM orders) SELECT o_orderkey, {check_valid('digits')} AS valid FROM d"""
O["grd7_account"] = f"""WITH {MESSAGES}, {pii('screened')}
    SELECT key, len(list_filter(pii_types, lambda x: x = 'account')) AS accounts FROM detected"""
O["grd8_detect"] = f"WITH {MESSAGES}, {pii('screened')} SELECT key, array_to_string(pii_types, '|') AS pii_types FROM detected"
O["grd9_scrub"] = f"WITH {MESSAGES} SELECT key, md5({scrub('text')}) AS digest FROM screened"
O["grd10_names"] = f"SELECT doc_id, {any_name('text', ('of the', 'de-la', 'que', 'und'))} AS named FROM documents"
O["grd11_performance"] = f"WITH {QUESTIONS} SELECT question_id, {any_rule('question', FUNDS.performance_patterns)} AS performance FROM question"
O["grd12_advice"] = f"WITH {QUESTIONS} SELECT question_id, {any_rule('question', FUNDS.advice_patterns)} AS advice FROM question"
O["grd13_out_of_scope"] = f"""WITH {QUESTIONS} SELECT question_id, {any_name('question', FUNDS.other_issuers)}
    OR {any_name('question', FUNDS.other_products)} AS out_of_scope FROM question"""
O["grd14_classify"] = f"WITH {DECIDE} SELECT question_id, intent, allowed, message, link, pii_types FROM decided"
O["gen1_strip_urls"] = f"WITH {COMPLETIONS} SELECT question_id, {strip_urls('completion')} AS clean FROM completion"
O["gen2_trim"] = f"WITH {COMPLETIONS} SELECT question_id, {trim_sentences('completion')} AS trimmed FROM completion"
O["gen3_postprocess"] = f"WITH {COMPLETIONS} SELECT question_id, {postprocess('completion')} AS answer FROM completion"
O["gen4_decline"] = f"WITH {COMPLETIONS} SELECT question_id, {decline('completion')} AS decline FROM completion"
O["gen5_numbers"] = f"SELECT doc_id, array_to_string(list_sort({numbers('text')}), '|') AS numbers FROM documents"
O["gen6_ungrounded"] = f"""{GATES} SELECT question_id, array_to_string(orphans, '|') AS orphans FROM judged"""
STAMP = "CASE WHEN event_id % 5 = 0 THEN 'about ' || event_type ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+00:00' END"
O["gen7_source_date"] = f"WITH s AS (SELECT event_id, {STAMP} AS stamp FROM events) SELECT event_id, {shown('stamp')} AS shown FROM s"
O["gen8_last_updated"] = retrieval(f"""SELECT question_id, CASE WHEN stamp IS NULL THEN '' ELSE {q(rules.LAST_UPDATED_LABEL)}
    || {shown('stamp')} END AS shown FROM gathered""")
O["gen10_gates"] = f"{GATES} SELECT * FROM response"
O["gen11_not_in_pages"] = f"{GATES} SELECT question_id, answer, reason, best_distance FROM response WHERE refused"
O["gen12_declines"] = f"{GATES} SELECT question_id, citation_url, refused FROM response WHERE reason = 'model_declined'"
O["orc1_answers"] = f"{ANSWERS} SELECT * FROM responses"
O["orc2_refusals"] = f"WITH {DECIDE} {REFUSED}"
O["orc3_empty_corpus"] = f"""WITH {DECIDE} SELECT question_id, {q(rules.EMPTY_CORPUS)} AS answer, NULL::VARCHAR AS citation_url,
    '' AS last_updated_from_sources, true AS refused, NULL::VARCHAR AS intent, NULL::VARCHAR AS pii_types,
    'empty_corpus' AS reason, NULL::VARCHAR AS model, NULL::DOUBLE AS best_distance, NULL::VARCHAR AS ungrounded,
    -1 AS chunks FROM decided WHERE allowed"""
O["agg1_drop_reasons"] = f"""{TWO} SELECT reason, count(*) AS n FROM (SELECT * FROM c_dropped UNION ALL SELECT * FROM t_dropped)
    GROUP BY reason"""
O["agg2_word_counts"] = text("""SELECT count(*) AS chunks, min(word_count) AS min_words,
    list_sort(list(word_count))[count(*) // 2 + 1] AS median_words, max(word_count) AS max_words,
    count(*) FILTER (word_count > 200) AS above_ceiling FROM chunk""")
O["agg3_page_counts"] = card("""SELECT d.url, (SELECT count(DISTINCT section_no) FROM sl WHERE sl.url = d.url) AS sections,
    (SELECT count(*) FROM chunk c WHERE c.url = d.url) AS chunks, (SELECT count(*) FROM dropped x WHERE x.url = d.url) AS dropped
    FROM doc d""")
O["agg4_corpus_summary"] = text(SUMMARY)
RAW_LINES = f"""ls AS (SELECT doc_id, text, string_split_regex(text, '{BREAK}') AS l0 FROM documents),
    l AS (SELECT doc_id, text, CASE WHEN l0[-1] = '' THEN l0[1:len(l0) - 1] ELSE l0 END AS l FROM ls)"""
O["agg5_text_statistics"] = f"""WITH {RAW_LINES} SELECT doc_id, length(text) AS chars, {words('text')} AS words, len(l) AS lines,
    coalesce(list_sort(list_transform(l, lambda x: length(x)))[len(l) // 2 + 1], 0) AS median_line FROM l"""
COUNTS = f"{RAW_LINES}, u AS (SELECT doc_id, unnest(l) AS line FROM l), c AS (SELECT doc_id, line, count(*) AS n FROM u GROUP BY ALL)"
O["agg6_redundancy"] = f"""WITH {COUNTS} SELECT doc_id, count(*) FILTER (n > 2 AND length(line) > 8) AS repeated,
    coalesce(sum(n - 1) FILTER (n > 2 AND length(line) > 8), 0)::BIGINT AS redundant, sum(n)::BIGINT AS lines,
    round(coalesce(sum(n - 1) FILTER (n > 2 AND length(line) > 8), 0) / greatest(sum(n), 1), 4) AS share FROM c GROUP BY doc_id"""
O["agg6_top_repeats"] = f"""WITH {COUNTS}, r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, line DESC) AS rank
    FROM c WHERE n > 2 AND length(line) > 8) SELECT doc_id, rank, line, n FROM r WHERE rank <= 6"""
O["agg7_short_runs"] = f"""WITH {RAW_LINES}, u AS (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM l),
    s AS (SELECT doc_id, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS island FROM u WHERE length(line) < 40),
    r AS (SELECT doc_id, island, count(*) AS n FROM s GROUP BY ALL)
    SELECT d.doc_id, coalesce(max(r.n), 0) AS longest_short_run FROM documents d LEFT JOIN r ON r.doc_id = d.doc_id GROUP BY d.doc_id"""
O["agg8_heading_tags"] = f"""WITH raw AS (SELECT url, html FROM ({RAW['web']}) UNION ALL SELECT url, html FROM ({RAW['card']})),
    t AS (SELECT url, regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<(script|style)\\b.*?</(script|style)>',
        '', 'g') AS h FROM raw)
    SELECT url, {', '.join(f"len(regexp_extract_all(h, '(?i)<{t}[ >]')) AS {t}" for t in ('h1', 'h2', 'h3'))},
    len(regexp_extract_all(h, '(?i)<table[ >]')) AS "table",
    array_to_string(list_filter(list_transform(regexp_extract_all(h, '(?is)<h[23][^>]*>(.*?)</h[23]>', 1), lambda x: {collapse('x')}),
        lambda x: x <> '')[1:5], '|') AS samples FROM t"""
O["agg9_totals"] = f"""WITH {docs('web')} SELECT count(*) AS pages, sum(length(text))::BIGINT AS chars,
    sum({words('text')})::BIGINT AS words FROM doc"""
O["agg10_retrieval_report"] = retrieval("""SELECT question_id, count(*) AS chunks, bool_and(starts_with(url, 'https://')) AS all_approved
    FROM hit GROUP BY question_id""")
O["agg11_confusion"] = f"""WITH {DECIDE} SELECT CASE WHEN regexp_matches(question, '\\+91|@|[0-9]{{16}}') THEN 'pii' ELSE 'other' END
    AS expected, intent, count(*) AS n FROM decided GROUP BY ALL"""
O["agg12_contract"] = f"""{ANSWERS} SELECT count(*) AS answers,
    count(*) FILTER (citation_url IS NOT NULL AND NOT starts_with(citation_url, 'https://')) AS bad_citation,
    count(*) FILTER (regexp_matches(answer, 'https?://[^{S}]+')) AS url_in_body,
    count(*) FILTER (len(regexp_extract_all(trim(answer), '[.!?](?:[{S}]|$)')) > 3) AS too_long,
    count(*) FILTER (NOT refused AND regexp_matches(answer, '(?i)\\b(I recommend|I advise|you should invest|I suggest)\\b')) AS advice_language,
    count(*) FILTER (NOT refused AND citation_url IS NULL) AS no_citation,
    count(*) FILTER (NOT refused AND coalesce(reason, '') <> 'model_declined' AND last_updated_from_sources = '') AS no_date,
    count(*) FILTER (reason = 'model_declined' AND citation_url <> {q(FUNDS.default_url)}) AS decline_cites_chunk,
    count(*) FILTER (refused AND contains(answer, 'Last updated from sources:')) AS dated_refusal FROM responses"""

# pairs of neighbouring words, joined with the table of phrases
O["grd10_rule_table"] = f"""WITH r AS (
    SELECT DISTINCT source AS rule, lower(p) AS p FROM (SELECT source, regexp_extract(text, '^([a-zA-Z]+ [a-zA-Z]+)(?:[^{W}]|$)', 1) AS p FROM documents) WHERE p <> ''),
    w AS (SELECT doc_id, regexp_extract_all(lower(text), '[{W}]+') AS ws, regexp_extract_all(lower(text), '[^{W}]+') AS gaps,
        CAST(regexp_matches(text, '^[^{W}]') AS INT) AS shift FROM documents),
    e AS (SELECT doc_id, ws, gaps, shift, unnest(range(1, len(ws))) AS i FROM w),
    b AS (SELECT DISTINCT doc_id, ws[i] || ' ' || ws[i + 1] AS p FROM e WHERE regexp_matches(gaps[i + shift], '^[{S}-]+$'))
    SELECT DISTINCT doc_id, rule FROM b JOIN r USING (p)"""
O["vec2_phrase_table"] = web("""SELECT DISTINCT id, rule FROM (
    SELECT id, ws[i] AS a, ws[i + 1] AS b FROM (SELECT id, ws, unnest(range(1, len(ws))) AS i FROM (
        SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM chunk))) x
    JOIN (SELECT item_id::VARCHAR AS rule, string_split(p, ' ') AS q FROM (
        SELECT item_id, regexp_extract(lower(text), '^[a-z]+ ([a-z]+ [a-z]+)[^a-z0-9]', 1) AS p FROM benchmark) WHERE p <> '') y
    ON a = q[1] AND (b = q[2] OR b = q[2] || 's')""")
for _name, _same in (("grd8_sql", "grd8_detect"), ("grd9_sql", "grd9_scrub"), ("gen1_sql", "gen1_strip_urls"),
                     ("vec2_sql", "vec2_phrases"), ("htm1_sql", "htm1_noise_tags")):
    O[_name] = O[_same]
