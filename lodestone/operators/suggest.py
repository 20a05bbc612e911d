"""Completion, spelling, related terms and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.lexicon import STOPWORDS
from lodestone.functions.tokens import normalize, term_table, token_table, tokenize
from lodestone.operators.indexing import Index, unit_text

LETTERS = "abcdefghijklmnopqrstuvwxyzñ"
#: Encoded bytes above which a correction counts, candidates tried at two edits, and
#: bytes at which no better one is looked for.
LEAST_BYTES, MOST_TRIED, ENOUGH_BYTES = 5, 5000, 100


def complete(index: Index, prefix: str, limit: int = 8) -> DataFrame:
    """(term, posting_bytes, rank): terms that begin with the prefix, those with most postings first.

    A prefix of fewer than two characters has no completions. Ties go to the shorter term, then to
    the one that the corpus has first.
    """
    prefix = normalize(prefix.strip())
    longest = max(len(prefix) + 12, 20)
    found = index.vocab.where(F.col("term").startswith(prefix) & ~F.col("term").contains(":") & ~F.col("term").isin(*sorted(STOPWORDS)))
    found = found.where(F.length("term").between(3, longest) & F.lit(len(prefix) >= 2))
    order = [F.desc("posting_bytes"), F.length("term"), F.col("first_doc"), F.col("first_pos")]
    few = found.orderBy(*order).limit(limit)
    return few.select("term", "posting_bytes", F.row_number().over(Window.orderBy(*order)).alias("rank"))


def one_edit(word: str) -> list[str]:
    """All strings one deletion, swap of neighbours, replacement or insertion away, sorted."""
    found = set()
    for i in range(len(word) + 1):
        head, tail = word[:i], word[i:]
        found.update(head + c + tail for c in LETTERS)
        if tail:
            found.add(head + tail[1:])
            found.update(head + c + tail[1:] for c in LETTERS)
        if len(tail) > 1:
            found.add(head + tail[1] + tail[0] + tail[2:])
    return sorted(found)


def _best(index: Index, blocks: list[list[str]]) -> tuple[str | None, int]:
    """The candidate whose term has most posting bytes, of equals the first.

    Blocks are tried in turn, and none any more once a candidate has more than ENOUGH_BYTES. All
    are looked up at once; there are at most MOST_TRIED of them.
    """
    terms: dict[str, str | None] = {}
    for c in (c for block in blocks for c in block):
        if c not in terms:
            tokens = tokenize(c)
            terms[c] = tokens[0].text if tokens else None
    wanted = sorted({t for t in terms.values() if t})
    if not wanted:
        return None, 0
    asked = index.vocab.sparkSession.createDataFrame([(t,) for t in wanted], "term string")
    sizes = {r["term"]: r["posting_bytes"] for r in index.vocab.join(F.broadcast(asked), "term").select("term", "posting_bytes").collect()}
    best, most = None, 0
    for block in blocks:
        for c in block:
            if (size := sizes.get(terms[c], 0)) > most:
                best, most = c, size
        if most > ENOUGH_BYTES:
            break
    return best, most


def correct(index: Index, query: str) -> str | None:
    """The query with unknown words replaced by known ones nearby, or None if nothing changes.

    For words of four letters or more that one edit does not help, the first MOST_TRIED strings at
    two edits are tried, in alphabetic order of the first edit and then of the second, up to the
    first edit by which a candidate has enough postings.
    """
    if not tokenize(query):
        return None
    words, changed = [], False
    firsts = {w: t[0].text for w in query.split() if ":" not in w and w.upper() != "OR" and not w.startswith('"') and (t := tokenize(w))}
    known = index.doc_freqs(sorted(set(firsts.values())))
    for word in query.split():
        if word in firsts and firsts[word] not in known:
            near = one_edit(normalize(word))
            best, size = _best(index, [near])
            if best is None and len(word) >= 4:
                blocks, left = [], MOST_TRIED
                for first in near:
                    blocks.append(one_edit(first)[:left])
                    left -= len(blocks[-1])
                    if not left:
                        break
                best, size = _best(index, blocks)
            if best is not None and size > LEAST_BYTES:
                word, changed = best, True
        words.append(word)
    return " ".join(words) if changed else None


def related(index: Index, page: DataFrame, query_terms: list[str], *, documents: int = 5, per_document: int = 150, limit: int = 6) -> DataFrame:
    """(term, surface, score, rank): telling terms of a page's first documents.

    page(doc_id, rank). Of each document its first `per_document` distinct stems count; those in
    more than 10 and in fewer than 15 % of all documents earn ln(N / (df + 1)). Ties go to the term
    met first.
    """
    first = page.where(F.col("rank") <= documents).select("doc_id", "rank")
    docs = index.docs.join(F.broadcast(first), "doc_id").select("doc_id", "rank", unit_text().alias("_unit"))
    surfaces = token_table(docs, "doc_id", "_unit")
    terms = term_table(docs, "doc_id", "_unit").join(surfaces, ["doc_id", "position"])
    terms = terms.where(~F.col("term").contains(":") & (F.col("value") != "vs") & (F.length("value") >= 4) & ~F.col("term").isin(*query_terms))
    firsts = terms.groupBy("doc_id", "term").agg(F.min(F.struct("position", "value")).alias("at"))
    order = Window.partitionBy("doc_id").orderBy("at.position")
    firsts = firsts.withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_document).join(F.broadcast(first), "doc_id")
    upper = int(index.n_docs * 0.15)
    telling = index.vocab.where((F.col("df") > 10) & (F.col("df") < upper)).select("term", "df")
    scored = firsts.join(telling, "term").withColumn("idf", F.log(F.lit(float(index.n_docs)) / (F.col("df") + 1)))
    longest = F.max_by("at.value", F.struct(F.length("at.value"), -F.col("rank"))).alias("surface")
    summed = scored.groupBy("term").agg(F.sum("idf").alias("score"), longest, F.min(F.struct("rank", "at.position")).alias("met"))
    few = summed.orderBy(F.desc("score"), "met").limit(limit)
    return few.select("term", "surface", "score", F.row_number().over(Window.orderBy(F.desc("score"), "met")).alias("rank"))


def facets(docs: DataFrame) -> DataFrame:
    """Sorted names of authors and divisions, and the range of years, as one row."""
    some = lambda c: F.array_sort(F.collect_set(F.when(F.col(c) != "", F.col(c))))
    return docs.agg(some("ponente").alias("ponentes"), some("division").alias("divisions"), F.coalesce(F.min("year"), F.lit(2010)).alias("year_min"), F.coalesce(F.max("year"), F.lit(2026)).alias("year_max"))


