"""One query for each operator, over a folder of tables, with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import oracles as O
from lodestone.functions import cleaning as C
from lodestone.functions.stemming import stem_column
from lodestone.functions.tokens import term_table, terms_column, token_counts
from lodestone.operators import codec as K
from lodestone.operators import evaluation as E
from lodestone.operators import indexing as I
from lodestone.operators import presentation as P
from lodestone.operators import retrieval as R
from lodestone.operators import suggest as S
from lodestone.plans.query import parse
from lodestone.sources import records as X

# What the invented prose of the documents has: frequent words, and a phrase that many share.
ALL_OF = "er re ou"
ANY_OF = "ciónos OR enßein OR leoi"
PHRASE = '"anea eriner"'
MIXED = 'er "of the er" ponente:src1'
FILTERED = "re division:en year:2015"
RECENT = "ponente:src1 year:2019"

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.cases_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cases(spark, sf_dir).select("doc_id", I.unit_text().alias("unit"))


def _terms(text: str) -> list[str]:
    return parse(text).all_terms


def _top(spark: SparkSession, sf_dir: str, text: str, ranker=R.BM25(), limit: int = 10, offset: int = 0) -> DataFrame:
    hits = R.search(I.open_index(spark, sf_dir), parse(text), ranker, digits=6)
    return R.top(hits, limit, offset).select("doc_id", "score", "rank")


@query(f"WITH {O.SCANNED} SELECT value, count(*) AS n, CAST(min(position) AS INT) AS first FROM scanned GROUP BY value")
def token_scan(spark, sf_dir):
    return token_counts(_units(spark, sf_dir), "doc_id", "unit")


@query(f"WITH {O.TERMS} SELECT doc_id, CAST(position AS INT) AS position, term FROM terms")
def token_positions(spark, sf_dir):
    return term_table(_units(spark, sf_dir), "doc_id", "unit")


@query(f"WITH {O.TERMS} SELECT doc_id, string_agg(term, ' ' ORDER BY position) AS terms FROM terms GROUP BY doc_id")
def document_terms(spark, sf_dir):
    """The terms of each document in their order."""
    rows = terms_column(_units(spark, sf_dir), "doc_id", "unit")
    return rows.select("doc_id", F.array_join("terms", " ").alias("terms"))


@query(f"WITH {O.TERMS} SELECT word, stem FROM stems")
def stem_vocab(spark, sf_dir):
    rows = token_counts(_units(spark, sf_dir), "doc_id", "unit").select(F.col("value").alias("word"))
    plain = ~F.col("word").contains(":") & ~F.col("word").rlike(r"\d") & (F.col("word") != "vs")
    return stem_column(rows.where(plain & ~F.col("word").isin(*sorted(O.STOPWORDS | O.PROTECTED))), "word", "stem")


@query(f"WITH {O.POSTINGS} SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM postings")
def postings(spark, sf_dir):
    text = F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions")
    return I.open_index(spark, sf_dir).postings.select("term", "doc_id", "tf", text)


@query(f"WITH {O.POSTINGS} SELECT term, doc_id, tf, array_to_string(positions, ' ') AS positions FROM postings")
def posting_blocks(spark, sf_dir):
    """Postings encoded into blocks of bytes and decoded again."""
    text = F.array_join(F.col("positions").cast("array<string>"), " ").alias("positions")
    return K.decoded(K.encoded(I.open_index(spark, sf_dir).postings)).select("term", "doc_id", "tf", text)


@query(f"WITH {O.POSTINGS} SELECT doc_id, length, year FROM docs")
def doc_lengths(spark, sf_dir):
    return I.open_index(spark, sf_dir).docs.select("doc_id", "length", "year")


@query(f"WITH {O.POSTINGS} SELECT term, df, cf, first_doc, first_pos FROM vocab")
def vocab_df(spark, sf_dir):
    return I.open_index(spark, sf_dir).vocab.select("term", "df", "cf", "first_doc", "first_pos")


@query(f"WITH {O.POSTINGS} SELECT term, posting_bytes FROM sizes")
def posting_bytes(spark, sf_dir):
    return I.open_index(spark, sf_dir).vocab.select("term", "posting_bytes")


@query(f"WITH {O.POSTINGS} SELECT n_docs, CAST(total_tokens AS BIGINT) AS total_tokens, round(avgdl, 6) AS avgdl FROM corpus")
def corpus_stats(spark, sf_dir):
    return I.open_index(spark, sf_dir).stats.select("n_docs", "total_tokens", F.round("avgdl", 6).alias("avgdl"))


@query(f"WITH {O.POSTINGS} SELECT n_docs, CAST(total_tokens AS BIGINT) AS total_tokens, round(avgdl, 6) AS avgdl, count(*) AS vocabulary, CAST(sum(df) AS BIGINT) AS postings, CAST(sum(posting_bytes) AS BIGINT) AS posting_bytes FROM vocab, corpus GROUP BY ALL")
def collection_report(spark, sf_dir):
    return I.collection_report(I.open_index(spark, sf_dir)).withColumn("avgdl", F.round("avgdl", 6))


@query(
    f"""WITH {O.TERMS.replace("CASE WHEN coalesce(body, '') = '' THEN gr_number ELSE gr_number || chr(10) || chr(10) || body END", "chr(10) || coalesce(body, '')").replace("FROM documents", "FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 500)")}
SELECT (SELECT count(DISTINCT value) FROM kept) AS unstemmed, (SELECT count(DISTINCT term) FROM terms) AS stemmed"""
)
def vocabulary_reduction(spark, sf_dir):
    return I.vocabulary_reduction(_cases(spark, sf_dir))


@query(f"WITH {O.POSTINGS}, w AS (SELECT p.doc_id, sum(pow((1 + ln(tf)) * ln(n_docs / df), 2)) AS s FROM postings p JOIN vocab v ON p.term = v.term, corpus WHERE df < n_docs GROUP BY p.doc_id) SELECT c.doc_id, round(CASE WHEN s > 0 THEN sqrt(s) ELSE 1.0 END, 6) AS norm FROM cases c LEFT JOIN w ON c.doc_id = w.doc_id")
def document_norms(spark, sf_dir):
    return I.open_index(spark, sf_dir).docs.select("doc_id", F.round("norm", 6).alias("norm"))


@query(f"WITH {O.POSTINGS} {O.having_all(_terms(ALL_OF))}")
def bool_and(spark, sf_dir):
    return R.intersect(I.open_index(spark, sf_dir), _terms(ALL_OF))


@query(f"WITH {O.POSTINGS} SELECT DISTINCT doc_id FROM postings WHERE term IN ({O.listed(_terms(ANY_OF))})")
def bool_or(spark, sf_dir):
    return R.union(I.open_index(spark, sf_dir), _terms(ANY_OF))


@query(f"WITH {O.POSTINGS} {O.phrase(parse(PHRASE).slots()[0])}")
def phrase(spark, sf_dir):
    return R.phrase_matches(I.open_index(spark, sf_dir), parse(PHRASE).slots()[0])


_MIXED = parse(MIXED)


@query(O.ranked(_MIXED.all_terms, f"SELECT doc_id FROM ({O.having_all(_MIXED.terms)}) WHERE doc_id IN (SELECT doc_id FROM ({O.phrase(_MIXED.slots()[0])})) AND doc_id IN (SELECT doc_id FROM docs WHERE contains(lower(ponente), 'src1'))", limit=50))
def clause_mix(spark, sf_dir):
    return _top(spark, sf_dir, MIXED, limit=50)


@query(O.ranked(_terms(FILTERED), f"SELECT doc_id FROM ({O.having_all(_terms(FILTERED))}) WHERE doc_id IN (SELECT doc_id FROM docs WHERE year = 2015 AND contains(lower(division), 'en'))", limit=1000))
def filter_fields(spark, sf_dir):
    return _top(spark, sf_dir, FILTERED, limit=1000)


@query(O.ranked(["gr:100007"], O.having_all(["gr:100007"])))
def docket_shorthand(spark, sf_dir):
    """A docket's prefix as a field is its token."""
    return _top(spark, sf_dir, "GR:100007")


@query(O.ranked(["ou", "er", "re"], O.having_all(["ou", "er", "re"])))
def unknown_field(spark, sf_dir):
    """What looks like a field and is none is words."""
    return _top(spark, sf_dir, "ou:er re")


@query(f"WITH {O.POSTINGS} SELECT doc_id, CAST(min(positions[1]) AS INT) AS first_match FROM postings WHERE term IN ({O.listed(_terms(ALL_OF))}) AND doc_id IN ({O.having_all(_terms(ALL_OF))}) GROUP BY doc_id")
def first_matches(spark, sf_dir):
    return R.search(I.open_index(spark, sf_dir), parse(ALL_OF)).select("doc_id", "first_match")


@query(f"WITH {O.POSTINGS} SELECT doc_id, anchor AS first_match FROM ({O.phrase(_MIXED.slots()[0])}) WHERE doc_id IN ({O.having_all(_MIXED.terms)}) AND doc_id IN (SELECT doc_id FROM docs WHERE contains(lower(ponente), 'src1'))")
def first_phrase_matches(spark, sf_dir):
    """Where a query has a phrase, the place where it first begins."""
    return R.search(I.open_index(spark, sf_dir), parse(MIXED)).select("doc_id", "first_match")


@query(f"WITH {O.CASES} SELECT doc_id, gr_number FROM cases WHERE contains(lower(gr_number), '1002') AND year(promulgated) = 2015")
def filter_docket(spark, sf_dir):
    docs = I.open_index(spark, sf_dir).docs
    return docs.where(R.filter_column(parse("docket:1002 year:2015").filters)).select("doc_id", "gr_number")


@query(f"WITH {O.CASES} SELECT doc_id, 0.0::DOUBLE AS score, CAST(row_number() OVER (ORDER BY doc_id DESC) AS INT) AS rank FROM cases WHERE contains(lower(ponente), 'src1') AND year(promulgated) = 2019 ORDER BY doc_id DESC LIMIT 10")
def filter_only_recency(spark, sf_dir):
    return _top(spark, sf_dir, RECENT)


@query(O.ranked(_terms(ALL_OF), O.having_all(_terms(ALL_OF))))
def bm25_topk(spark, sf_dir):
    return _top(spark, sf_dir, ALL_OF)


@query(O.ranked(_terms(ALL_OF), O.having_all(_terms(ALL_OF)), offset=10))
def bm25_page2(spark, sf_dir):
    return _top(spark, sf_dir, ALL_OF, offset=10)


@query(O.ranked(_terms("er er re"), O.having_all(["er", "re"]), gain=O.bm25(0.9, 0.3)))
def bm25_repeated_term(spark, sf_dir):
    return _top(spark, sf_dir, "er er re", R.BM25(0.9, 0.3))


_NORMS = ", norms AS (SELECT p.doc_id AS norm_id, sqrt(sum(pow((1 + ln(tf)) * ln(n_docs / df), 2))) AS norm FROM postings p JOIN vocab v ON p.term = v.term, corpus GROUP BY p.doc_id)"


@query(O.ranked(_terms(ALL_OF), O.having_all(_terms(ALL_OF)), gain=O.TFIDF, divide="(SELECT norm FROM norms WHERE norm_id = p.doc_id)", extra=_NORMS))
def tfidf_topk(spark, sf_dir):
    return _top(spark, sf_dir, ALL_OF, R.TfIdf())


@query("""SELECT doc_id, score, CAST(row_number() OVER (ORDER BY score DESC, doc_id) AS INT) AS rank FROM (
  SELECT doc_id, CAST(len(list_filter(w, lambda x: x = 'er')) + len(list_filter(w, lambda x: x = 're')) AS DOUBLE) AS score
  FROM (SELECT doc_id, regexp_extract_all(lower('G.R. No. ' || (100000 + doc_id) || '  ' || coalesce(text, '')), '[\\p{L}\\p{N}\\p{M}_]+') AS w FROM documents)
  WHERE list_contains(w, 'er') AND list_contains(w, 're')
) ORDER BY score DESC, doc_id LIMIT 10""")
def linear_tf_topk(spark, sf_dir):
    return R.top(R.linear_search(_cases(spark, sf_dir), "er re")).select("doc_id", "score", "rank")


@query(f"WITH {O.POSTINGS} SELECT term, posting_bytes, CAST(row_number() OVER (ORDER BY posting_bytes DESC, length(term), first_doc, first_pos) AS INT) AS rank FROM vocab WHERE starts_with(term, 'er') AND NOT contains(term, ':') AND term NOT IN ({O.listed(O.STOPWORDS)}) AND length(term) BETWEEN 3 AND 20 ORDER BY rank LIMIT 8")
def prefix_suggest(spark, sf_dir):
    return S.complete(I.open_index(spark, sf_dir), "er")


#: Words that are known, one edit away, two edits away with many and with few postings, and far from all.
MISSPELT = ["thre qqqqjj", "theonn zzer", "er re", "errin xqou of", "zzqj thand"]


@query(O.spelling(MISSPELT, S.LETTERS, S.LEAST_BYTES, S.MOST_TRIED, S.ENOUGH_BYTES))
def spell_suggest(spark, sf_dir):
    index = I.open_index(spark, sf_dir)
    return spark.createDataFrame([(q, S.correct(index, q)) for q in MISSPELT], "query string, suggestion string")


_RELATED = f"""WITH {O.POSTINGS}, {O.weights(["er"])}, hits AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r FROM (
    SELECT p.doc_id, round(sum({O.bm25()}), 6) AS score FROM postings p JOIN asked a ON p.term = a.term JOIN vocab v ON p.term = v.term JOIN docs d ON p.doc_id = d.doc_id, corpus GROUP BY p.doc_id)
), met AS (
  SELECT t.doc_id, r, t.term, arg_min(s.value, t.position) AS value, min(t.position) AS position
  FROM terms t JOIN scanned s ON t.doc_id = s.doc_id AND t.position = s.position JOIN hits h ON t.doc_id = h.doc_id
  WHERE r <= 5 AND NOT contains(t.term, ':') AND s.value <> 'vs' AND length(s.value) >= 4 AND t.term <> 'er' GROUP BY ALL
), firsts AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY position) AS n FROM met
), summed AS (
  SELECT f.term, sum(ln(n_docs / (df + 1))) AS score, arg_max(value, length(value) * 100 - r) AS surface, min(r * 1000000000 + position) AS met
  FROM firsts f JOIN vocab v ON f.term = v.term, corpus WHERE n <= 150 AND df > 10 AND df < floor(n_docs * 0.15) GROUP BY f.term
)
SELECT term, surface, round(score, 6) AS score, CAST(row_number() OVER (ORDER BY score DESC, met) AS INT) AS rank FROM summed ORDER BY score DESC, met LIMIT 6"""


@query(_RELATED)
def related_terms(spark, sf_dir):
    index = I.open_index(spark, sf_dir)
    page = R.top(R.search(index, parse("er"), digits=6), 5)
    return S.related(index, page, ["er"]).withColumn("score", F.round("score", 6))


@query(f"WITH {O.CASES} SELECT array_to_string(list_sort(list(DISTINCT ponente)), ',') AS ponentes, array_to_string(list_sort(list(DISTINCT division)), ',') AS divisions, CAST(min(year(promulgated)) AS INT) AS year_min, CAST(max(year(promulgated)) AS INT) AS year_max FROM cases")
def facets(spark, sf_dir):
    rows = S.facets(I.open_index(spark, sf_dir).docs)
    return rows.select(F.array_join("ponentes", ",").alias("ponentes"), F.array_join("divisions", ",").alias("divisions"), "year_min", "year_max")


def _page_sql(text: str, rows: str) -> str:
    """The first page of a query's hits with fields and snippets, as `rows` picks them."""
    q = parse(text)
    eligible = [O.having_all(q.terms)] if q.terms else []
    eligible += [f"SELECT doc_id FROM ({O.phrase(s)})" for s in q.slots()]
    ranked = O.ranked(q.all_terms, " INTERSECT ".join(eligible))
    return f"WITH {O.POSTINGS}, {O.snippets(ranked, q.all_terms)} {rows}"


_PAGE_FIELDS = "doc_id, score, rank, gr_number, '' AS title, promulgated, division, ponente, 'https://example.org/' || doc_id || '.html' AS source_url, snippet"


@query(_page_sql(ALL_OF, f"SELECT {_PAGE_FIELDS} FROM shown JOIN cases USING (doc_id)"))
def snippets(spark, sf_dir):
    index, q = I.open_index(spark, sf_dir), parse(ALL_OF)
    return P.with_snippets(R.top(R.search(index, q, digits=6)).select("doc_id", "score", "rank"), index, q.all_terms)


_EXPORT = O.ranked(_terms(ALL_OF), O.having_all(_terms(ALL_OF)), limit=100)


@query(f"""WITH hits AS ({_EXPORT}) SELECT rank AS "Rank", 'G.R. No. ' || (100000 + doc_id) AS "G.R. Number", '' AS "Title", CAST(2010 + doc_id % 17 AS VARCHAR) || '-01-01' AS "Date", coalesce(lang, '') AS "Division", coalesce(source, '') AS "Ponente", format('{{:.4f}}', score) AS "Score", 'https://example.org/' || doc_id || '.html' AS "Source URL" FROM hits JOIN documents USING (doc_id)""")
def export_csv(spark, sf_dir):
    index = I.open_index(spark, sf_dir)
    return P.export_rows(R.top(R.search(index, parse(ALL_OF), digits=6), 100), index)


@query(_page_sql(PHRASE, f"SELECT CAST(to_json(struct_pack({', '.join(f'{c} := {c}' for c in ('doc_id', 'score', 'rank', 'gr_number', 'title', 'promulgated', 'division', 'ponente', 'source_url', 'snippet'))})) AS VARCHAR) AS json FROM (SELECT {_PAGE_FIELDS.replace('promulgated', 'CAST(promulgated AS VARCHAR) AS promulgated')} FROM shown JOIN cases USING (doc_id))"))
def json_results(spark, sf_dir):
    index, q = I.open_index(spark, sf_dir), parse(PHRASE)
    return P.to_json(P.with_snippets(R.top(R.search(index, q, digits=6)).select("doc_id", "score", "rank"), index, q.all_terms))


@query(f"WITH hits AS ({O.ranked(_terms(ALL_OF), O.having_all(_terms(ALL_OF)))}) SELECT doc_id, rank, round(score / max(score) OVER () * 100, 6) AS relevance FROM hits")
def relevance_percent(spark, sf_dir):
    rows = P.relevance(_top(spark, sf_dir, ALL_OF))
    return rows.select("doc_id", "rank", F.round("relevance", 6).alias("relevance"))


#: Judged queries over the invented prose: every seventh document is relevant to the first, and so on.
JUDGED = [("q1", "er re", 7), ("q2", "ou", 5), ("q3", PHRASE, 3), ("q4", "er OR ciónos", 11), ("q5", "re division:en", 4), ("q6", "zzzznone er", 2)]


def _judged(docs: DataFrame) -> tuple[dict[str, str], DataFrame]:
    """The queries, and their judgments: dockets of the documents whose id the query's number divides."""
    steps = F.array(*[F.struct(F.lit(i).alias("query_id"), F.lit(s).alias("step")) for i, _, s in JUDGED])
    rows = docs.select("doc_id", "gr_number", F.inline(steps)).where(F.col("doc_id") % F.col("step") == 0)
    return {i: q for i, q, _ in JUDGED}, rows.select("query_id", "gr_number")


def _batch_sql(rankers: list[tuple[str, str]]) -> str:
    parts = []
    for i, text, step in JUDGED:
        q = parse(text)
        conditions = [O.having_all(q.terms)] if q.terms else []
        conditions += [f"SELECT doc_id FROM postings WHERE term IN ({O.listed(q.should)})"] if q.should else []
        conditions += [f"SELECT doc_id FROM ({O.phrase(s)})" for s in q.slots()]
        conditions += ["SELECT doc_id FROM docs WHERE contains(lower(division), 'en')"] if q.filters else []
        where = " AND ".join(f"p.doc_id IN ({c})" for c in conditions)
        values = ", ".join(f"({O.quoted(t)}, {n})" for t, n in q.weights.items())
        for c, (gain, divide) in enumerate(rankers):
            parts.append(f"SELECT {c} AS config, '{i}' AS query_id, {step} AS step, p.doc_id, round(sum({gain}) / {divide}, 6) AS score FROM postings p JOIN (VALUES {values}) AS a(term, qtf) ON p.term = a.term JOIN vocab v ON p.term = v.term JOIN docs d ON p.doc_id = d.doc_id, corpus WHERE {where} GROUP BY p.doc_id HAVING sum({gain}) > 0")
    return f"WITH {O.POSTINGS}{_NORMS}, all_hits AS ({' UNION ALL '.join(parts)}), hits AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY config, query_id ORDER BY score DESC, doc_id) AS rank FROM all_hits) WHERE rank <= 10)"


_TF = (O.TFIDF, "(SELECT norm FROM norms WHERE norm_id = p.doc_id)")
_SOME = [_TF, (O.bm25(), "1"), (O.bm25(0.9, 0.0), "1"), (O.bm25(2.0, 1.0), "1")]
_PER_QUERY = """, asked_all AS (SELECT * FROM (VALUES ('q1'), ('q2'), ('q3'), ('q4'), ('q5'), ('q6')) AS t(query_id), (SELECT DISTINCT config FROM range({n}) AS c(config))
), measured AS (
  SELECT config, query_id, sum(CAST(doc_id % step = 0 AS INT)) / count(*) AS p, coalesce(1 / min(CASE WHEN doc_id % step = 0 THEN rank END), 0) AS rr FROM hits GROUP BY ALL
), per_query AS (SELECT CAST(a.config AS INT) AS config, a.query_id, coalesce(p, 0) AS p, coalesce(rr, 0) AS rr FROM asked_all a LEFT JOIN measured m ON a.config = m.config AND a.query_id = m.query_id)"""


@query(_batch_sql(_SOME) + " SELECT CAST(config AS INT) AS config, query_id, CAST(rank AS INT) AS rank, doc_id, score FROM hits")
def batch_topk(spark, sf_dir):
    index = I.open_index(spark, sf_dir)
    rankers = [R.TfIdf(), R.BM25(), R.BM25(0.9, 0.0), R.BM25(2.0, 1.0)]
    return R.batch(spark, index, {i: parse(q) for i, q, _ in JUDGED}, rankers)


@query(_batch_sql([(O.bm25(), "1")]) + _PER_QUERY.format(n=1) + " SELECT query_id, round(p, 6) AS precision, round(rr, 6) AS reciprocal_rank FROM per_query")
def p_at_10(spark, sf_dir):
    index = I.open_index(spark, sf_dir)
    queries, dockets = _judged(index.docs)
    rows = E.judge(R.batch(spark, index, {i: parse(q) for i, q in queries.items()}, [R.BM25()]), index.docs, dockets)
    return E.per_query(rows, dockets, [0]).select("query_id", F.round("precision", 6).alias("precision"), F.round("reciprocal_rank", 6).alias("reciprocal_rank"))


@query(_batch_sql([(O.bm25(), "1")]) + _PER_QUERY.format(n=1) + " SELECT round(avg(rr), 6) AS mrr, round(avg(p), 6) AS p_at_10 FROM per_query")
def mrr(spark, sf_dir):
    index = I.open_index(spark, sf_dir)
    rows = E.sweep(spark, index, *_judged(index.docs), [R.BM25()])
    return rows.select(F.round("mrr", 6).alias("mrr"), F.round("p_at_10", 6).alias("p_at_10"))


@query(_batch_sql([_TF, *[(O.bm25(k1, b), "1") for k1 in E.K1 for b in E.B]]) + _PER_QUERY.format(n=21) + " SELECT config, round(avg(p), 6) AS p_at_10, round(avg(rr), 6) AS mrr FROM per_query GROUP BY config")
def param_sweep(spark, sf_dir):
    index = I.open_index(spark, sf_dir)
    rows = E.sweep(spark, index, *_judged(index.docs))
    return rows.select("config", F.round("p_at_10", 6).alias("p_at_10"), F.round("mrr", 6).alias("mrr"))


@query("""WITH t AS (SELECT list(value ORDER BY value) AS x, count(value) AS n FROM events WHERE value IS NOT NULL)
SELECT x[greatest(1, least(n, CAST(round_even(0.5::DOUBLE * n + 0.5, 0) AS BIGINT)))] AS p50, x[greatest(1, least(n, CAST(round_even(0.95::DOUBLE * n + 0.5, 0) AS BIGINT)))] AS p95,
  x[greatest(1, least(n, CAST(round_even(0.001::DOUBLE * n + 0.5, 0) AS BIGINT)))] AS p01 FROM t""")
def latency_percentile(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return E.nearest_ranks(rows, "value", {"p50": 0.5, "p95": 0.95, "p01": 0.001})


# Pages, listings and records. The tables hold no court pages, so these are written around their rows.


@query(O.page_texts(C._BLANKS))
def html_clean(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", X.page_text("html").alias("text"))


@query(O.PAGE_LINKS)
def page_links(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return pages.select("page_id", F.posexplode(X.page_links("html")).alias("pos", "href"))


@query("SELECT doc_id, replace(regexp_replace(upper(text), '[\\s\\x{00A0}]+', '', 'g'), 'ẞ', 'SS') AS squashed FROM documents")
def squash_text(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return rows.select("doc_id", C.squash_column(F.col("text")).alias("squashed"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 3 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS found FROM orders""")
def parse_dates(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet")
    kind, day = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (
        F.when(kind == 0, F.concat(F.lit("Manila, "), F.date_format(day, "MMMM d, yyyy"), F.lit(". May 5, 2020")))
        .when(kind == 1, F.upper(F.date_format(day, "MMMM d yyyy"))).when(kind == 2, F.concat(F.lit("on "), F.date_format(day, "MMMM  dd,yyyy")))
        .otherwise(F.lit("February 30, 2011"))
    )
    return rows.select("o_orderkey", C.date_column(text).alias("found"))


@query("""SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'G.R. Nos. ' || doc_id || '-95|A.C. No. 9218' ELSE 'g.r. no. 1' || doc_id END AS dockets FROM documents""")
def citations_extract(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    number = F.col("doc_id").cast("string")
    whole = F.coalesce("text", F.lit(""))  # dockets stand before and behind all of a document
    text = F.when(
        F.col("doc_id") % 2 == 0, F.concat(F.lit("See G.R. Nos. "), number, F.lit("-95. "), whole, F.lit(" and A.C. No. 9218; G.R. Nos. "), number, F.lit("-95, A.M. No. RTJ-19-2552"))
    ).otherwise(F.concat(whole, F.lit(" x g.r. no. 1"), number, F.lit("; none"))).alias("t")
    return rows.select("doc_id", F.array_join(C.citations_column(text), "|").alias("dockets"))


@query("SELECT doc_id, 'Case ' || doc_id || ' v. State' AS caption FROM documents")
def strip_opinion_tail(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.concat(F.lit("Case "), F.col("doc_id").cast("string"), F.lit(" v. State ,;  Concurring and Dissenting Opinion Justice X "), F.coalesce("text", F.lit("")))
    return rows.select("doc_id", C.without_tail_column(text).alias("caption"))


@query(
    f"""WITH {O.CASES}, n AS (SELECT count(*) AS total, count(*) FILTER (regexp_matches(coalesce(body, ''), '\\S')) AS body, count(division) AS division, count(ponente) AS ponente FROM cases)
SELECT field, required, present, total, CASE WHEN total > 0 THEN round(present / total * 100, 6) ELSE 0.0 END AS percent FROM (
  SELECT total, unnest([
    {{'field': 'gr_number', 'required': true, 'present': total}}, {{'field': 'title', 'required': true, 'present': 0}}, {{'field': 'promulgated', 'required': true, 'present': total}},
    {{'field': 'body', 'required': true, 'present': body}}, {{'field': 'division', 'required': false, 'present': division}}, {{'field': 'ponente', 'required': false, 'present': ponente}},
    {{'field': 'separate_opinions', 'required': false, 'present': 0}}, {{'field': 'footnotes', 'required': false, 'present': 0}}], recursive := true) FROM n
)"""
)
def completeness(spark, sf_dir):
    return X.completeness(_cases(spark, sf_dir)).withColumn("percent", F.round("percent", 6))


@query(f"WITH {O.CASES}, l AS (SELECT list(length(body) ORDER BY length(body)) AS x FROM cases WHERE body <> '') SELECT CAST(x[1] AS INT) AS least, CAST(x[len(x) // 2 + 1] AS INT) AS median, CAST(x[len(x)] AS INT) AS most, (SELECT CAST(min(year(promulgated)) AS INT) FROM cases) AS year_min, (SELECT CAST(max(year(promulgated)) AS INT) FROM cases) AS year_max FROM l")
def body_report(spark, sf_dir):
    return X.body_report(_cases(spark, sf_dir))


@query("""SELECT count(*) AS attempted, count(*) FILTER (k = 0) AS fetched, count(*) FILTER (k = 1) AS cached, count(*) FILTER (k = 2) AS failed, count(*) FILTER (k = 3) AS disallowed,
  CAST(sum(CASE WHEN k = 0 THEN page_id * 10 END) AS BIGINT) AS bytes_fetched, round(count(*) FILTER (k = 2) / count(*) * 100, 6) AS failed_percent FROM (SELECT page_id, page_id % 5 AS k FROM pages)""")
def crawl_counters(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    status = F.element_at(F.array(*map(F.lit, ["fetched", "cached", "failed", "disallowed", "other"])), (F.col("page_id") % 5 + 1).cast("int"))
    return X.crawl_counters(rows.select(status.alias("status"), (F.col("page_id") * 10).alias("bytes"))).withColumn("failed_percent", F.round("failed_percent", 6))


#: Kinds of pages, dealt out by the id: what a page has, and what its record has for it.
HEADINGS = ["D E C I S I O N", "RESOLUTION", "O R D E R"]
DIVISIONS = [("SECOND  DIVISION", "Second Division"), ("en banc", "En Banc"), ("SPECIAL  THIRD DIVISION", "Special Third Division"), ("first division", "First Division"), ("no court of any kind", "En Banc")]
BYLINES = [("PERLAS-BERNABE, J.:", "Perlas-Bernabe, J."), ("PER CURIAM:", "Per Curiam"), ("O'BRIEN, <i>C.J.</i>:", "O'Brien, C.J."), ("DE LA PEÑA, S.A.J. :", "De La Peña, S.A.J."), ("PEÑA, J :", "Peña, J.")]
NOTES = ["<p class=jn>note ", "<p>F o o t n o t e s<p>note ", "<p class='FN small'>note "]
OPINIONS = [("♦ Dissenting Opinion ", "Leonen, [J]", "Dissenting Opinion — Leonen, J."), ("◆ Concurring-and-Dissenting Opinion, ", "CAGUIOA, [C.J.]", "Concurring-And-Dissenting Opinion — Caguioa, C.J."), ("", "Reyes", "Opinion — Reyes, J.")]


def _dealt(values: list, start: int = 0):
    """One of the values by the id."""
    return F.element_at(F.array(*map(F.lit, values)), ((F.col("doc_id") + start) % len(values) + 1).cast("int"))


def _dealt_sql(values: list, start: int = 0) -> str:
    return f"[{', '.join(map(O.quoted, values))}][CAST((doc_id + {start}) % {len(values)} + 1 AS INT)]"


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A month page for each year and month, and a page for each of its documents but every ninth.

    Pages are of many kinds. A document's whole text stands in its page as a script, which is read
    and left out.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    month = F.element_at(F.array(*map(F.lit, X.MONTHS)), (F.col("doc_id") % 12 + 1).cast("int"))
    number = F.col("doc_id").cast("string")
    docs = docs.select("doc_id", (F.lit(2010) + F.col("doc_id") % 5).cast("int").alias("year"), month.alias("month"), number.alias("n"), F.concat(F.lit("gr_"), number, F.lit(".html")).alias("file"), F.replace(F.coalesce("text", F.lit("")), F.lit("<"), F.lit("&lt;")).alias("whole"))
    named = F.when(F.col("doc_id") % 4 == 3, F.lit("")).otherwise(F.concat(F.lit("People v. No. "), "n"))
    row = F.concat(
        F.lit("<tr><td><a href='"), "file", F.lit("'>G.R. No. "), "n", F.lit("</a> March 5, 2011</td><td>"), named, F.lit("<br>Dissenting Opinion <a href='op_"), "n", F.lit(".html'>x</a></td></tr>"),
    )
    lists = docs.groupBy("year", "month").agg(F.array_sort(F.collect_list(F.struct("doc_id", row.alias("r")))).alias("rows"))
    index = lists.select("year", "month", F.lit("index.html").alias("file"), F.lit(True).alias("is_index"), F.concat(F.lit("<table>"), F.array_join(F.transform("rows", lambda x: x.r), ""), F.lit("</table>")).alias("html"))
    body = F.when(F.col("doc_id") % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("<p>Body of "), "n", F.lit(".<script>x</script><p>More<cite>y</cite> text.")))
    page = F.concat(
        F.lit("<title>en banc</title><p>"), _dealt([d for d, _ in DIVISIONS]), F.lit("<p>PARTY NUMBER "), "n", F.lit(", petitioner, v. OTHERS<p>A SHORTER PARTY OF 30 LETTERS<p>March 5, 2011<p>"),
        _dealt(HEADINGS), F.lit("<p>"), _dealt([x for x, _ in BYLINES], 1), F.lit("<script>"), "whole", F.lit("</script>"), body, _dealt(NOTES, 2), "n",
    )
    opinion = F.concat(F.lit("<div id=so>"), _dealt([k for k, _, _ in OPINIONS]), F.lit("<a href=op_"), "n", F.lit(".html>"), _dealt([j for _, j, _ in OPINIONS]), F.lit("</a></div><p>DISSENTING OPINION<p>I dissent in "), "n")
    pages = docs.where("doc_id % 9 <> 4").select("year", "month", "file", F.lit(False).alias("is_index"), page.alias("html"))
    opinions = docs.where("doc_id % 2 = 0").select("year", "month", F.concat(F.lit("op_"), "n", F.lit(".html")).alias("file"), F.lit(False).alias("is_index"), opinion.alias("html"))
    return index.unionByName(pages).unionByName(opinions)


_OPINED = f"CASE WHEN doc_id % 2 = 0 THEN {_dealt_sql([t for _, _, t in OPINIONS])} || chr(10) || chr(10) || 'I dissent in ' || doc_id ELSE '' END"
_WRITTEN = "CASE WHEN doc_id % 7 = 0 THEN '' ELSE 'Body of ' || doc_id || '.' || chr(10) || chr(10) || 'More text.' END"


@query(f"""SELECT row_number() OVER (ORDER BY y, m, doc_id) - 1 AS doc_id, 'G.R. No. ' || doc_id AS gr_number,
  CASE WHEN doc_id % 4 = 3 THEN 'PARTY NUMBER ' || doc_id || ', petitioner, v. OTHERS' ELSE 'People v. No. ' || doc_id END AS title, make_date(2011, 3, 5) AS promulgated,
  {_WRITTEN} AS body, {_dealt_sql([d for _, d in DIVISIONS])} AS division, {_dealt_sql([a for _, a in BYLINES], 1)} AS ponente,
  {_OPINED} AS opinions, 'note ' || doc_id AS footnotes,
  'https://example.org/judjuris/juri' || y || '/' || ['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'][m + 1] || y || '/gr_' || doc_id || '.html' AS source_url
FROM (SELECT doc_id, 2010 + doc_id % 5 AS y, CAST(doc_id % 12 AS INT) AS m FROM documents WHERE doc_id % 9 <> 4)""")
def records_build(spark, sf_dir):
    records, _ = X.build_records(_landed(spark, sf_dir))
    return records.select(*[c for c in records.columns if c != "separate_opinions"], F.array_join("separate_opinions", "|").alias("opinions"))


@query("""SELECT kind, count(*) AS n FROM (
  SELECT 'missing-html' AS kind FROM documents WHERE doc_id % 9 = 4 UNION ALL SELECT 'missing-opinion' FROM documents WHERE doc_id % 9 <> 4 AND doc_id % 2 = 1
  UNION ALL SELECT 'empty-body' FROM documents WHERE doc_id % 9 <> 4 AND doc_id % 7 = 0) GROUP BY kind""")
def records_problems(spark, sf_dir):
    _, problems = X.build_records(_landed(spark, sf_dir))
    return X.problem_report(problems)


@query("""SELECT kind, detail FROM (
  SELECT *, 2010 + doc_id % 5 AS y, CAST(doc_id % 12 AS INT) AS m FROM (
    SELECT doc_id, 'missing-html' AS kind, 'gr_' || doc_id || '.html' AS file FROM documents WHERE doc_id % 9 = 4 UNION ALL SELECT doc_id, 'missing-opinion', 'op_' || doc_id || '.html' FROM documents WHERE doc_id % 9 <> 4 AND doc_id % 2 = 1
    UNION ALL SELECT doc_id, 'empty-body', 'gr_' || doc_id || '.html' FROM documents WHERE doc_id % 9 <> 4 AND doc_id % 7 = 0)
), (SELECT ['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'] AS names), LATERAL (SELECT y || '/' || names[m + 1] || '/' || file AS detail) ORDER BY y, m, file, kind LIMIT 10""")
def problem_listing(spark, sf_dir):
    """The report's own first ten problems."""
    return X.first_problems(X.build_records(_landed(spark, sf_dir))[1])


@query("SELECT CAST(2010 + doc_id % 5 AS INT) AS year, ['jan', 'feb', 'mar', 'apr', 'may', 'jun', 'jul', 'aug', 'sep', 'oct', 'nov', 'dec'][CAST(doc_id % 12 AS INT) + 1] AS month, 'gr_' || doc_id || '.html' AS decision_file, 'G.R. No. ' || doc_id AS citations, 'op_' || doc_id || '.html' AS opinion_files FROM documents")
def month_listing(spark, sf_dir):
    rows = X.listing(_landed(spark, sf_dir).where("is_index"))
    return rows.select("year", "month", "decision_file", F.array_join("citations", "|").alias("citations"), F.array_join("opinion_files", "|").alias("opinion_files"))


@query("""SELECT CAST(y AS INT) AS year, m AS month, 'https://example.org/juri' || y || '/' || m || y || '/' || m || y || '.html' AS url FROM (SELECT DISTINCT 2000 + n_nationkey AS y FROM nation), (SELECT unnest(['jan', 'mar', 'dec']) AS m)""")
def month_links(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select((F.lit(2000) + F.col("n_nationkey")).cast("int").alias("year")).distinct()
    y = F.col("year").cast("string")
    html = F.concat(*[x for m in ("dec", "Mar", "jan", "mar") for x in (F.lit(f"<a href='{m}"), y, F.lit(f"/{m}"), y, F.lit(".html'>x</a>"))], F.lit("<a href='feb1999/feb1999.html'>y</a>"))
    return X.month_pages(rows.select("year", F.concat(F.lit("https://example.org/juri"), y, F.lit("/index.html")).alias("url"), html.alias("html")))


@query("SELECT 'mar' || (2000 + n_nationkey) AS slug, 'https://example.org/a/gr_' || k || '.html' AS url FROM nation, range(2) AS t(k)")
def decision_links(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.concat(F.lit("mar"), (F.lit(2000) + F.col("n_nationkey")).cast("string")).alias("slug"))
    html = F.concat(F.lit("<a href='"), "slug", F.lit(".html'>m</a><a href=gr_0.html>a</a><a href=../up.html>u</a><a href=gr_0.html>b</a><a href=gr_1.html>c</a><a href=gr_2.html>d</a>"))
    return X.decision_urls(rows.select("slug", F.lit("https://example.org/a/m.html").alias("url"), html.alias("html")), per_month=2).select("slug", "url")
