"""The index and search against a plain model in Python, on a small corpus with ties and gaps."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.tokens import tokenize
from lodestone.operators import codec as K
from lodestone.operators import evaluation as E
from lodestone.operators import indexing as I
from lodestone.operators import presentation as P
from lodestone.operators import retrieval as R
from lodestone.operators import suggest as S
from lodestone.plans.query import parse
from lodestone.plans.service import Cache, SearchService

TEXTS = [
    "Grave abuse of discretion by the court. The court erred.", "Grave abuse of discretion by the court. The court erred.", "Discretion of grave abuse", "", None,
    "Res judicata bars the petition; petition denied under Rule 65.", "People v. Santos, G.R. No. 192393. " + "court " * 200, "Mandamus or certiorari under Sec. 5",
]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    docs = spark.createDataFrame([(i, t, "en" if i % 2 else None, f"src{i}") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string")
    return I.build(spark, I.cases_of(docs), str(tmp_path_factory.mktemp("index")))


def units():
    return {i: tokenize(f"G.R. No. {100000 + i}" + (f"\n\n{t}" if t else "")) for i, t in enumerate(TEXTS)}


def test_postings_lengths_and_bytes(index):
    model, last, size = {}, {}, Counter()
    vb = lambda x: max(1, -(-x.bit_length() // 7))
    for i, tokens in units().items():
        own = {}
        for t in tokens:
            own.setdefault(t.text, []).append(t.position)
        for term, places in own.items():
            model[term, i] = places
            size[term] += vb(i - last.get(term, 0)) + vb(len(places)) + sum(vb(b - a) for a, b in zip([0, *places], places))
            last[term] = i
    assert {(r.term, r.doc_id): r.positions for r in index.postings.collect()} == model
    assert {r.term: r.posting_bytes for r in index.vocab.collect()} == dict(size)
    assert {r.doc_id: r.length for r in index.docs.collect()} == {i: len(t) for i, t in units().items()}
    assert index.n_docs == len(TEXTS) and math.isclose(index.avgdl, sum(map(len, units().values())) / len(TEXTS))


def model_search(text, k1=1.2, b=0.75):
    q, docs = parse(text), units()
    tf = {i: Counter(t.text for t in tokens) for i, tokens in docs.items()}
    df = Counter(t for c in tf.values() for t in c)
    avgdl = sum(map(len, docs.values())) / len(docs)

    def has(i, phrase):
        at = {(t.text, t.position) for t in docs[i]}
        return any(all((t, p + o) in at for t, o in phrase) for x, p in at if x == phrase[0][0])

    hits = [i for i in docs if all(t in tf[i] for t in q.terms) and (not q.should or any(t in tf[i] for t in q.should)) and all(has(i, p) for p in q.slots())]
    score = lambda i: sum(math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf[i][t] * (k1 + 1) / (tf[i][t] + k1 * (1 - b + b * len(docs[i]) / avgdl)) for t in q.all_terms if t in tf[i])
    return sorted(((i, round(score(i), 6)) for i in hits), key=lambda x: (-x[1], x[0]))


@pytest.mark.parametrize("text", ["court", "grave abuse", '"grave abuse of discretion"', "court court erred", "mandamus OR judicata", 'court "abuse of discretion"', "nothing court", "gr:192393", "Sec. 5"])
def test_search_agrees(index, spark, text):
    rows = R.top(R.search(index, parse(text), digits=6), 10).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in rows] == model_search(text)
    batch = R.batch(spark, index, {"q": parse(text)}, [R.BM25()]).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in batch] == model_search(text)


def test_recency_and_empty(index):
    assert [r.doc_id for r in R.top(R.search(index, parse("division:en"))).orderBy("rank").collect()] == [7, 5, 3, 1]
    assert R.search(index, parse("the of")).count() == 0
    assert R.search(index, parse("year:²")).count() == 0
    # a term of every document weighs nothing under TF-IDF, and what is eligible goes by recency
    every = parse("year:2010")
    every.terms = ["gr:100000"]
    assert [r.doc_id for r in R.top(R.search(index, every, R.TfIdf())).collect()] == [0]
    assert [r.anchor for r in R.phrase_matches(index, [("grave", 0), ("abus", 1)]).orderBy("doc_id").collect()] == [1, 1, 3]


def test_snippets():
    text = "First. " + "x " * 200 + "The court erred here. " + "y " * 200
    assert "court" in P.snippet(text, ["court"]) and P.snippet(text, ["court"]).startswith("…")
    assert P.snippet("short text", []) == "short text"
    assert P.best_start([10, 300, 310, 320]) == 300 - 260 // 6 and P.best_start([]) is None and P.best_start([50]) == 0
    assert P.highlight("A <b> Court's courts", ["court"]) == "A &lt;b&gt; Court&#x27;s <mark>courts</mark>"
    assert P.linear_snippet("abc", ["z"]) == "abc"


def test_suggestions(index, spark):
    assert [r.term for r in S.complete(index, "Ju").collect()] == ["judicata"]
    assert S.complete(index, "x").count() == 0 and S.complete(index, "j").count() == 0
    assert S.correct(index, "coort") == "court" and S.correct(index, "court") is None and S.correct(index, "the") is None
    assert "theb" in S.one_edit("the") and "hte" in S.one_edit("the") and "te" in S.one_edit("the")


def test_service(index, monkeypatch):
    service = SearchService(index)
    found = service.search("court", limit=2)
    assert found.total_hits == 3 and found.has_more and [r["doc_id"] for r in found.results] == [6, 0]
    assert service.search("court", limit=2) is found and service.cache.hits == 1
    assert service.search("court", limit=2, offset=2).payload()["results"][0]["promulgated"] == "2011-01-01"
    assert service.page("coort")["suggestion"] == "court"
    assert service.decision(5)["gr_number"] == "G.R. No. 100005" and service.decision(99) is None
    assert service.export("court").columns[:2] == ["Rank", "G.R. Number"]
    assert service.health()["documents"] == len(TEXTS) and service.about()["n_docs"] == len(TEXTS)
    assert service.suggest("judi") == ["judicata"] and service.facets()["divisions"] == ["en"]
    with pytest.raises(ValueError):
        service.search("court", limit=0)
    cache = Cache(size=1, seconds=0)
    cache.put("a", 1)
    cache.put("b", 2)
    assert list(cache.held) == ["b"] and cache.get("b") is None
    with pytest.raises(ValueError):
        R.ranker_of("other")


def test_version(index, spark, tmp_path):
    for name in ("docs", "postings", "vocab"):
        getattr(index, name).limit(1).write.parquet(f"{tmp_path}/{name}")
    index.stats.withColumn("version", F.lit(0)).write.parquet(f"{tmp_path}/stats")
    with pytest.raises(ValueError, match="version"):
        I.load(spark, str(tmp_path))


def test_percentile(spark):
    df = spark.createDataFrame([(float(x),) for x in (15, 20, 35, 40, 50)], "x double")
    assert E.nearest_ranks(df, "x", {"p": 0.5}).first().p == 35 and E.nearest_ranks(df.limit(0), "x", {"p": 0.5}).first().p == 0
    assert E.nearest_rank([50.0, 15.0, 20.0, 40.0, 35.0], 0.5) == 35 and E.nearest_rank([], 0.5) == 0 and E.nearest_rank([3.0], 0.001) == 3


def test_judgments(index, spark, tmp_path):
    """Precision and reciprocal rank from a loop over results; the report has a line for each engine."""
    judged = spark.createDataFrame([("a", "c", "court", "i", ["gr. no.  100006", "nothing"]), ("b", "c", "grave abuse", "i", [" 10000"]), ("none", "c", "court", "i", [])], "id string, category string, query string, intent string, relevant_gr array<string>")
    E.save_judgments(judged, str(tmp_path / "judged"))
    judged = spark.read.json(str(tmp_path / "judged"))
    queries, dockets = {"a": "court", "b": "grave abuse", "none": "court"}, E.dockets_of(judged)
    rows = {r.name: r for r in E.sweep(spark, index, queries, dockets, [R.BM25(), R.TfIdf()]).collect()}
    for ranker in (R.BM25(), R.TfIdf()):
        precision, reciprocal = [], []
        for i, wanted in (("a", ["gr.no.100006", "nothing"]), ("b", ["10000"])):
            hits = [f"g.r.no.{100000 + r.doc_id}" for r in R.top(R.search(index, parse(queries[i]), ranker, digits=6)).orderBy("rank").collect()]
            good = [any(w in h for w in wanted) for h in hits]
            precision.append(sum(good) / len(good))
            reciprocal.append(1 / (good.index(True) + 1) if any(good) else 0)
        assert (rows[ranker.name].p_at_10, rows[ranker.name].mrr) == (pytest.approx(sum(precision) / 2), pytest.approx(sum(reciprocal) / 2))
    cases = I.cases_of(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(TEXTS)], "doc_id long, text string, lang string, source string"))
    report = E.compare(spark, index, cases, queries, dockets, repeats=1).splitlines()
    assert report[1].startswith("bm25") and report[-1].startswith("scan without an index") and len(report) == 4


def test_codec():
    import random

    rng = random.Random(1)
    numbers = [0, 1, 127, 128, 16383, 16384, 2**21, 2**35, 2**62] + [rng.randrange(1 << rng.randrange(1, 60)) for _ in range(500)]
    assert K.decode(K.encode(np.array(numbers))).tolist() == numbers and K.encode(np.array([300])) == bytes([0xAC, 2]) and K.encode(np.array([], np.int64)) == b""
    docs = np.cumsum([rng.randrange(1, 1000) for _ in range(50)])
    own = [np.cumsum([rng.randrange(0 if k else 1, 300) + 1 for k in range(rng.randrange(1, 9))]) - 1 for _ in docs]
    data = K.block_of(docs, own)
    assert [(d, p.tolist()) for d, p in K.postings_in(data)] == [(int(d), p.tolist()) for d, p in zip(docs, own)]
    assert list(K.doc_freqs_in(data)) == [(int(d), len(p)) for d, p in zip(docs, own)] and list(K.postings_in(b"")) == []


def test_posting_blocks(index):
    """Blocks hold the postings, in as many bytes as the vocabulary says."""
    blocks = K.encoded(index.postings.coalesce(1).sortWithinPartitions("term", "doc_id"))
    assert {r.term: len(r.data) for r in blocks.collect()} == {r.term: r.posting_bytes for r in index.vocab.collect()}
    rows = lambda df: sorted((r.term, r.doc_id, r.tf, r.positions) for r in df.select("term", "doc_id", "tf", "positions").collect())
    assert rows(K.decoded(blocks)) == rows(index.postings) == rows(K.decoded(K.encoded(index.postings.repartition(3))))
    assert K.encoded(index.postings.limit(0)).count() == 0


def test_snippets_read_their_own_documents(index):
    """The texts of a page are asked for by their ids, and its ranking is in no plan of theirs."""
    page = R.top(R.search(index, parse("court"), digits=6), 5).select("doc_id", "score", "rank")
    plan = P.with_snippets(page, index, ["court"])._jdf.queryExecution().toString()
    assert "In(doc_id" in plan or "EqualTo(doc_id" in plan or "In(doc_id, [" in plan or "IN (" in plan
    assert "positions" not in plan and P.with_snippets(page.limit(0), index, ["court"]).count() == 0
    found = P.with_snippets(page, index, ["court"]).orderBy("rank").collect()
    assert [r.doc_id for r in found] == [6, 0, 1] and all("<mark>court</mark>" in r.snippet for r in found)


def test_words_that_tell_nothing(spark, tmp_path):
    """Under TF-IDF a word of every document weighs nothing; who has only such words counts if nobody else does."""
    texts = ["salt fish", "salt crab", "salt", "salt fish crab"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    index = I.build(spark, I.cases_of(docs), str(tmp_path))
    hits = lambda q: [r.doc_id for r in R.top(R.search(index, parse(q), R.TfIdf())).orderBy("rank").collect()]
    assert hits("salt") == [3, 2, 1, 0] and hits("fish") == [0, 3] and hits("fish OR crab") == [3, 0, 1] and hits("salt fish") == [0, 3] and hits("pepper") == []
    assert sorted(hits("salt OR fish")) == [0, 3] and hits("salt OR fish division:no") == [] and hits('"salt fish" salt') == [0, 3]
    # the one word that tells something is in no document that is eligible
    assert hits('salt OR fish "salt crab"') == [1] and hits("salt OR fish docket:100002") == [2]


def test_two_edits_stop_early(spark, monkeypatch):
    """No further first edit is tried once a candidate has enough postings, even for a better one."""
    vocab = spark.createDataFrame([("abcf", 1, 200), ("zzef", 1, 900)], "term string, df long, posting_bytes long")
    index = I.Index(vocab, vocab, vocab, vocab, 9, 1.0)
    blocks = [["none"], ["abcf"], ["zzef"]]
    assert S._best(index, blocks) == ("abcf", 200) and S._best(index, [["abcf", "zzef"]]) == ("zzef", 900)
    monkeypatch.setattr(S, "ENOUGH_BYTES", 200)
    assert S._best(index, blocks) == ("zzef", 900) and S._best(index, [["the"]]) == (None, 0)


def test_forgotten_terms_are_read_again(spark):
    """A query's terms count the same however many were asked before."""
    vocab = spark.createDataFrame([("one", 3), ("two", 5)], "term string, df long")
    index = I.Index(vocab, vocab, vocab, vocab, 9, 1.0)
    assert index.doc_freqs(["one"]) == {"one": 3}
    index.asked.update({f"x{k}": 0 for k in range(10_001)})
    assert index.doc_freqs(["one", "two", "none"]) == {"one": 3, "two": 5} and len(index.asked) == 3


def test_blocks_of_any_size_decode_in_parts(spark, monkeypatch):
    """Postings of rare and frequent terms, in batches cut anywhere, come back as they were, few at a time."""
    import pyarrow as pa

    rng, rows = np.random.default_rng(3), []
    for term, n in (("a", 1), ("b", 9000), ("c", 3), ("d", 5000)):
        docs = np.sort(rng.choice(1 << 40, n, replace=False))
        rows += [(term, int(d), np.cumsum(rng.integers(0, 300, int(rng.integers(1, 9)))).tolist()) for d in docs]
    schema = pa.schema([("term", pa.string()), ("doc_id", pa.int64()), ("positions", pa.list_(pa.int32()))])
    whole = pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)
    blocks = pa.Table.from_batches(list(K._encoded([whole[:7000], whole[7000:7001], whole[7001:]]))).combine_chunks().to_batches()
    assert max(blocks[0].column("n_docs").to_pylist()) == K.BLOCK_DOCS
    assert [d for data in blocks[0].column("data").to_pylist() for d, _ in K.postings_in(data)] == [r[1] for r in rows]
    monkeypatch.setattr(K, "DECODED", 20_000)
    out = list(K._decoded([blocks[0].select(["term", "data"])]))
    assert [(r["term"], r["doc_id"], r["positions"]) for b in out for r in b.to_pylist()] == rows
    assert len(out) > 3 and all(r["tf"] == len(r["positions"]) for b in out for r in b.to_pylist())


def test_batch_keeps_the_first_of_each_task(spark, index, tmp_path):
    """Ranks are those of all hits put in order, ties included; hits are not multiplied by rankers, and judging does not rank again."""
    import pyarrow as pa

    rng, k = np.random.default_rng(5), 3
    hits = [(f"q{rng.integers(2)}", d, *(None if x < 1 else float(x) for x in rng.integers(0, 6, 2))) for d in range(200)]
    schema = pa.schema([("query_id", pa.string()), ("doc_id", pa.int64()), ("c0", pa.float64()), ("c1", pa.float64())])
    table = pa.RecordBatch.from_pylist([dict(zip(schema.names, h)) for h in hits], schema=schema)
    (out,) = R._best(2, k)(table[i : i + 37] for i in range(0, 200, 37))
    expected = [(c, q, h[1], h[2 + c]) for c in range(2) for q in ("q0", "q1") for h in sorted((h for h in hits if h[0] == q and h[2 + c] is not None), key=lambda h: (-h[2 + c], h[1]))[:k]]
    assert sorted(tuple(r.values()) for r in out.to_pylist()) == sorted(expected)
    ranked = R.batch(spark, index, {"q": parse("court"), "p": parse('"grave abuse of discretion"')}, E.grid(), k)
    plan = lambda rows: rows._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan(ranked)
    dockets = spark.createDataFrame([("q", "G.R. No. 100000"), ("p", "none")], "query_id string, gr_number string")
    judged = E.judge(ranked, index.docs, dockets)
    assert "MapInArrow" not in plan(judged) and {r.doc_id for r in judged.where("is_relevant").collect()} == {0}


@pytest.mark.parametrize("frequent", [1, 3, 100_000])
def test_norms_of_frequent_and_rare_terms(spark, index, frequent):
    """Norms are the same however many terms are broadcast; postings of broadcast terms are not shuffled by term."""
    tf = {i: Counter(t.text for t in tokens) for i, tokens in units().items()}
    df = Counter(t for c in tf.values() for t in c)
    expected = {i: round(math.sqrt(sum(((1 + math.log(n)) * math.log(len(tf) / df[t])) ** 2 for t, n in c.items())), 6) for i, c in tf.items()}
    rows = I.norms(index.postings, index.vocab, index.n_docs, frequent)
    assert {r.doc_id: round(r.norm, 6) for r in rows.collect()} == expected
    assert "BroadcastHashJoin" in rows._jdf.queryExecution().executedPlan().toString() and "LeftAnti" in rows._jdf.queryExecution().executedPlan().toString()
