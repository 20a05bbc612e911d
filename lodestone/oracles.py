"""The queries again, in SQL over the same tables: what each result is checked against."""

from __future__ import annotations

from lodestone.functions.lexicon import DOCKET_KIND, DOCKET_LINK, DOCKET_NUMBER, PROTECTED, SECTION_KIND, SECTION_NUMBER, SECTION_SUBS, STOPWORDS, WORD
from lodestone.functions.stemming import stem_sql

#: Without look-ahead the space behind `v.` is taken along; it could not begin another token.
_SCAN = rf"(?:{DOCKET_KIND}){DOCKET_LINK}{DOCKET_NUMBER}|\b(?:{SECTION_KIND})\s*{SECTION_NUMBER}{SECTION_SUBS}|\bvs?\.\s|\bvs\b|{WORD}"
_DOCKET = rf"^({DOCKET_KIND}){DOCKET_LINK}({DOCKET_NUMBER})$"
_SECTION = rf"^({SECTION_KIND})\s*({SECTION_NUMBER})({SECTION_SUBS})$"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def listed(words) -> str:
    return ", ".join(map(quoted, sorted(words)))


CASES = """cases AS (
  SELECT doc_id, 'G.R. No. ' || (100000 + doc_id) AS gr_number, make_date(2010 + CAST(doc_id % 17 AS INT), 1, 1) AS promulgated,
         lang AS division, source AS ponente, text AS body FROM documents
)"""
SCANNED = rf"""{CASES}, units AS (
  SELECT doc_id, replace(replace(lower(nfc_normalize(CASE WHEN coalesce(body, '') = '' THEN gr_number ELSE gr_number || chr(10) || chr(10) || body END)), '’', ''''), '‘', '''') AS unit FROM cases
), surfaces AS (
  SELECT doc_id, unnest(s) AS surface, unnest(range(len(s))) AS position FROM (SELECT doc_id, regexp_extract_all(unit, {quoted(_SCAN)}) AS s FROM units)
), scanned AS (
  SELECT doc_id, position, CASE
    WHEN regexp_matches(surface, {quoted(_DOCKET)}) THEN regexp_replace(regexp_extract(surface, {quoted(_DOCKET)}, 1), '[^a-z]', '', 'g') || ':' || trim(regexp_extract(surface, {quoted(_DOCKET)}, 2), '-')
    WHEN regexp_matches(surface, {quoted(_SECTION)}) THEN (CASE WHEN starts_with(surface, 'rule') THEN 'rule' ELSE left(surface, 3) END) || ':' || regexp_extract(surface, {quoted(_SECTION)}, 2) || regexp_replace(regexp_extract(surface, {quoted(_SECTION)}, 3), '\s+', '', 'g')
    WHEN regexp_matches(surface, '^vs?\.\s$') THEN 'vs' ELSE surface END AS value FROM surfaces
)"""
TERMS = f"""{SCANNED}, kept AS (
  SELECT *, contains(value, ':') OR value = 'vs' OR value IN ({listed(PROTECTED)}) AS fixed FROM scanned
  WHERE contains(value, ':') OR value = 'vs' OR NOT (regexp_matches(value, '[0-9]') OR value IN ({listed(STOPWORDS)}))
), words AS (SELECT DISTINCT value AS word FROM kept WHERE NOT fixed
), stems AS ({stem_sql("words")}
), terms AS (
  SELECT doc_id, position, CASE WHEN fixed THEN value ELSE stem END AS term FROM kept LEFT JOIN stems ON value = word WHERE fixed OR stem <> ''
)"""
POSTINGS = f"""{TERMS}, postings AS (
  SELECT term, doc_id, CAST(count(*) AS INT) AS tf, list(position ORDER BY position) AS positions FROM terms GROUP BY term, doc_id
), docs AS (
  SELECT c.*, CAST(coalesce(n, 0) AS INT) AS length, CAST(year(promulgated) AS INT) AS year
  FROM cases c LEFT JOIN (SELECT doc_id, sum(tf) AS n FROM postings GROUP BY doc_id) l ON c.doc_id = l.doc_id
), corpus AS (SELECT count(*) AS n_docs, sum(length) AS total_tokens, avg(length) AS avgdl FROM docs
), vb AS (
  SELECT term, doc_id, 1 AS part, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY term ORDER BY doc_id), 0) AS x FROM postings
  UNION ALL SELECT term, doc_id, 2, tf FROM postings
  UNION ALL SELECT term, doc_id, 3, position - coalesce(lag(position) OVER (PARTITION BY term, doc_id ORDER BY position), 0) FROM terms
), sizes AS (
  SELECT term, CAST(sum(1 + CAST(x >= 128 AS INT) + CAST(x >= 16384 AS INT) + CAST(x >= 2097152 AS INT)) AS BIGINT) AS posting_bytes FROM vb GROUP BY term
), vocab AS (
  SELECT p.term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf, min(posting_bytes) AS posting_bytes, min(doc_id) AS first_doc, CAST(arg_min(positions[1], doc_id) AS INT) AS first_pos
  FROM postings p JOIN sizes s ON p.term = s.term GROUP BY p.term
)"""


def weights(terms: list[str]) -> str:
    """asked(term, qtf) of a query's terms."""
    counted = {t: terms.count(t) for t in terms}
    return "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({quoted(t)}, {n})" for t, n in counted.items()) + ") AS t(term, qtf))"


def bm25(k1: float = 1.2, b: float = 0.75) -> str:
    return f"qtf * ln((n_docs - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * length / avgdl))"


TFIDF = "qtf * (1 + ln(tf)) * ln(n_docs / df) * ln(n_docs / df)"


def ranked(terms: list[str], eligible: str, *, gain: str | None = None, divide: str = "1", extra: str = "", limit: int = 10, offset: int = 0) -> str:
    """The first hits among `eligible`, SQL for doc_ids over postings and docs."""
    return f"""WITH {POSTINGS}, {weights(terms)}{extra}, eligible AS ({eligible}), scored AS (
  SELECT p.doc_id, round(sum({gain or bm25()}) / {divide}, 6) AS score
  FROM postings p JOIN asked a ON p.term = a.term JOIN vocab v ON p.term = v.term JOIN docs d ON p.doc_id = d.doc_id, corpus
  WHERE p.doc_id IN (SELECT doc_id FROM eligible) GROUP BY p.doc_id
)
SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM scored ORDER BY score DESC, doc_id LIMIT {limit} OFFSET {offset}"""


def having_all(terms: list[str]) -> str:
    return f"SELECT doc_id FROM postings WHERE term IN ({listed(set(terms))}) GROUP BY doc_id HAVING count(*) = {len(set(terms))}"


def phrase(slots: list[tuple[str, int]]) -> str:
    """Documents with a phrase and its first place, by joining positions."""
    (first, _), *rest = slots
    joins = " ".join(f"JOIN terms t{k} ON t0.doc_id = t{k}.doc_id AND t{k}.term = {quoted(t)} AND t{k}.position = t0.position + {o}" for k, (t, o) in enumerate(rest, 1))
    return f"SELECT t0.doc_id, CAST(min(t0.position) AS INT) AS anchor FROM terms t0 {joins} WHERE t0.term = {quoted(first)} GROUP BY t0.doc_id"


# Pages. A tag, a comment or an element that is no text ends a piece of text.

_TAGS = r"(?:<[^>]*>)+"


def _without(x: str, *names: str) -> str:
    for name in names:
        x = rf"regexp_replace({x}, '(?is)<{name}\b[^>]*>.*?</{name}\s*>', '<x>', 'g')"
    return rf"regexp_replace({x}, '(?s)<!--.*?-->', '<x>', 'g')"


_BODY = _without("html", "script", "style", "cite", "noscript")
_ENTITIES = [("&quot;?", '"'), ("&lt;?", "<"), ("&gt;?", ">"), ("&middot;?", "·"), ("&copy;?", "©"), ("&nbsp;?", " "), ("&#x27;", "''"), ("&amp;?", "&")]


def _unescaped(x: str) -> str:
    for name, char in _ENTITIES:
        x = f"regexp_replace({x}, '{name}', '{char}', 'g')"
    return x


_LINE_SPACE = r"[\t\x0B\f\r \x{1c}-\x{1f}\x{85}\p{Z}]"


def cleaned(x: str, blanks: str) -> str:
    """NFC, plain spaces, lines stripped, one blank line at most."""
    x = rf"regexp_replace(regexp_replace(nfc_normalize({x}), '\r\n?', chr(10), 'g'), '{blanks}', ' ', 'g')"
    x = rf"regexp_replace({x}, '{_LINE_SPACE}*\n{_LINE_SPACE}*', chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({x}, '\n{{3,}}', chr(10) || chr(10), 'g'), '^[\n\p{{Z}}\s]+|[\n\p{{Z}}\s]+$', '', 'g')"


def page_texts(blanks: str) -> str:
    text = f"regexp_replace(body, '{_TAGS}', CASE WHEN regexp_matches(body, '(?i)<br\\b') THEN chr(10) ELSE ' ' END, 'g')"
    return f"SELECT page_id, {cleaned(_unescaped(text), blanks)} AS text FROM (SELECT page_id, {_BODY} AS body FROM pages)"


PAGE_LINKS = rf"""SELECT page_id, CAST(i - 1 AS INT) AS pos, trim({_unescaped("hrefs[i]")}) AS href FROM (
  SELECT page_id, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, regexp_extract_all({_BODY}, '(?is)<a\s(?:[^>]*\s)?href\s*=\s*"([^"]*)"', 1) AS hrefs FROM pages))"""

# Snippets: places of matches from the lengths of what stands between them, windows by counting, marks by scanning the snippet again.


def _escaped(x: str) -> str:
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")):
        x = f"replace({x}, '{char}', '{name}')"
    return x


def _spans(name: str, source: str, text: str) -> str:
    """name(doc_id, k, surface, s): what the scanner sees in a text, and where it begins."""
    return rf"""{name} AS (
  SELECT doc_id, k, surface, CAST(sum(length(gap)) OVER (PARTITION BY doc_id ORDER BY k) + coalesce(sum(length(surface)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM (SELECT doc_id, unnest(range(len(m))) AS k, unnest(m) AS surface, unnest(g[1:len(m)]) AS gap FROM (SELECT doc_id, regexp_extract_all({text}, {quoted(_SCAN)}) AS m, regexp_split_to_array({text}, {quoted(_SCAN)}) AS g FROM {source}))
)"""


def snippets(page: str, terms: list[str], width: int = 260) -> str:
    """CTEs that end in shown(doc_id, score, rank, snippet) for the rows of a page."""
    low = lambda x: f"replace(replace(lower(nfc_normalize({x})), '’', ''''), '‘', '''')"
    return rf"""page AS ({page}), texts AS (
  SELECT doc_id, CASE WHEN coalesce(body, '') = '' THEN gr_number ELSE gr_number || chr(10) || chr(10) || body END AS u FROM cases WHERE doc_id IN (SELECT doc_id FROM page)
), low AS (SELECT doc_id, {low("u")} AS n FROM texts), {_spans("seen", "low", "n")}, hits AS (
  SELECT seen.doc_id, s FROM seen JOIN terms ON seen.doc_id = terms.doc_id AND k = position WHERE term IN ({listed(set(terms))})
), counted AS (
  SELECT a.doc_id, a.s, count(*) AS n, (SELECT count(*) FROM hits h WHERE h.doc_id = a.doc_id) AS of_all FROM hits a JOIN hits b ON a.doc_id = b.doc_id AND b.s >= a.s AND b.s < a.s + {width} GROUP BY a.doc_id, a.s
), windows AS (
  SELECT doc_id, greatest(0, arg_min(s, -n * 100000000 + s) - CASE WHEN max(of_all) = 1 THEN {width // 3} ELSE {width // 6} END) AS a FROM counted GROUP BY doc_id
), cut AS (
  SELECT doc_id, u, a, least(length(u), a + {width}) AS z, greatest(0, a - 60) AS lo, reverse(substr(u, greatest(0, a - 60) + 1, a - greatest(0, a - 60))) AS back FROM texts JOIN windows USING (doc_id)
), moved AS (
  SELECT doc_id, u, CASE WHEN a > 0 AND contains(back, ' .') THEN lo + length(back) - strpos(back, ' .') + 1 ELSE a END AS a,
         CASE WHEN z < length(u) THEN z + strpos(substr(u, z + 1, least(length(u), z + 40) - z), '. ') ELSE z END AS z FROM cut
), snips AS (
  SELECT doc_id, CASE WHEN a > 0 THEN '…' ELSE '' END || replace(regexp_replace(substr(u, a + 1, z - a), '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'), chr(10), ' ') || CASE WHEN z < length(u) THEN '…' ELSE '' END AS t FROM moved
), low_snips AS (SELECT doc_id, {low("t")} AS n FROM snips), {_spans("again", "low_snips", "n")}, again_words AS (SELECT DISTINCT surface AS word FROM again), again_stems AS ({stem_sql("again_words")}
), marked AS (
  SELECT a.doc_id, k, s, s + length(surface) AS e, CASE WHEN surface IN ({listed(STOPWORDS)}) OR regexp_matches(surface, '[0-9]') THEN FALSE WHEN surface IN ({listed(PROTECTED)}) THEN surface IN ({listed(set(terms))}) ELSE stem IN ({listed(set(terms))}) END AS hit FROM again a JOIN again_stems ON surface = word
), ends AS (SELECT *, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM (SELECT * FROM marked WHERE hit)
), pieces AS (
  SELECT e.doc_id, string_agg({_escaped("substr(t, before + 1, s - before)")} || '<mark>' || {_escaped("substr(t, s + 1, e - s)")} || '</mark>', '' ORDER BY k) AS x, max(e) AS z FROM ends e JOIN snips USING (doc_id) GROUP BY e.doc_id
), shown AS (
  SELECT p.doc_id, score, rank, coalesce(x, '') || {_escaped("substr(t, coalesce(z, 0) + 1)")} AS snippet FROM page p JOIN snips s ON p.doc_id = s.doc_id LEFT JOIN pieces q ON p.doc_id = q.doc_id
)"""


# Spelling: the strings one edit away, made by positions and letters, and those two edits away.


def _edits(word: str, source: str, columns: str, letters: str) -> str:
    at = f"FROM (SELECT *, unnest(range(length({word}) + 1)) AS i FROM {source})"
    each = f"FROM (SELECT *, unnest(range(length({word}) + 1)) AS i FROM {source}), (SELECT unnest(string_split('{letters}', '')) AS c)"
    return f"""SELECT DISTINCT {columns}, edit FROM (
    SELECT {columns}, left({word}, i) || substr({word}, i + 2) AS edit {at} WHERE i < length({word})
    UNION ALL SELECT {columns}, left({word}, i) || substr({word}, i + 2, 1) || substr({word}, i + 1, 1) || substr({word}, i + 3) {at} WHERE i < length({word}) - 1
    UNION ALL SELECT {columns}, left({word}, i) || c || substr({word}, i + 2) {each} WHERE i < length({word})
    UNION ALL SELECT {columns}, left({word}, i) || c || substr({word}, i + 1) {each})"""


def spelling(asked: list[str], letters: str, least: int, most: int, enough: int) -> str:
    """(query, suggestion) for queries of plain words."""
    words = ", ".join(f"({quoted(q)}, {k}, {quoted(w)})" for q in asked for k, w in enumerate(q.split()))
    known = f"CASE WHEN word IN ({listed(STOPWORDS)}) THEN NULL WHEN word IN ({listed(PROTECTED)}) OR word = 'vs' THEN word ELSE nullif(stem, '') END"
    return f"""WITH {POSTINGS}, asked AS (SELECT * FROM (VALUES {words}) AS t(query, k, word)
), asked_words AS (SELECT DISTINCT word FROM asked), asked_stems AS ({stem_sql("asked_words")}
), unknown AS (SELECT DISTINCT word FROM (SELECT word, {known} AS term FROM asked_stems) WHERE term IS NOT NULL AND term NOT IN (SELECT term FROM vocab)
), near AS ({_edits("word", "unknown", "word", letters)}
), far AS (
  SELECT word, first, edit FROM (SELECT word, first, edit, row_number() OVER (PARTITION BY word ORDER BY first, edit) AS n FROM ({_edits("first", "(SELECT word, edit AS first FROM near)", "word, first", letters)})) WHERE n <= {most}
), candidates AS (SELECT word AS asked, 1 AS step, '' AS first, edit FROM near UNION ALL SELECT word, 2, first, edit FROM far
), made_words AS (SELECT DISTINCT edit AS word FROM candidates), made_stems AS ({stem_sql("made_words")}
), found AS (
  SELECT asked, step, first, edit, posting_bytes AS size FROM candidates JOIN (SELECT word, {known} AS term FROM made_stems) m ON edit = m.word JOIN vocab v ON m.term = v.term
), upto AS (SELECT asked, step, first, max(max(size)) OVER (PARTITION BY asked, step ORDER BY first ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM found GROUP BY asked, step, first
), tried AS (SELECT f.* FROM found f JOIN upto u ON f.asked = u.asked AND f.step = u.step AND f.first = u.first WHERE f.step = 1 OR coalesce(before, 0) <= {enough}
), best AS (
  SELECT asked, edit, size FROM (SELECT *, row_number() OVER (PARTITION BY asked ORDER BY step, size DESC, first, edit) AS n FROM tried WHERE step = 1 OR length(asked) >= 4) WHERE n = 1
), put AS (SELECT query, k, CASE WHEN size > {least} THEN edit END AS better, word FROM asked LEFT JOIN best ON word = asked)
SELECT query, CASE WHEN count(better) > 0 THEN string_agg(coalesce(better, word), ' ' ORDER BY k) END AS suggestion FROM put GROUP BY query"""
