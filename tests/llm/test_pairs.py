"""SimHash and vector near-duplicates, and components, against brute force."""

import random

import numpy as np
import pytest
import xxhash

from lodestone.llm import itq, simhash
from lodestone.llm.common import Scratch
from lodestone.llm.components import connected


def plain_fingerprint(text):
    """One bit at a time, from the definition."""
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


TEXTS = ["", None, "  \n ", "one", "One two", "a b c", "A  b\tc", "é É x y z", "x" * 5000, "\x85 \x1c\x1d a\x0bb\x0cc d", "the cat sat on the mat " * 30]


@pytest.mark.parametrize("text", TEXTS)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode() if text is not None else None) == plain_fingerprint(text)


def test_fingerprint_of_blocks(monkeypatch):
    text = " ".join(random.Random(1).choices("abcdefgh", k=3000))
    small = simhash.word_blocks
    monkeypatch.setattr(simhash, "word_blocks", lambda t: small(t, 7))
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def test_components(spark):
    rng = random.Random(4)
    links = [(i, i + 1) for i in range(60)] + [(100, 100 + i) for i in range(40)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(90)] + [(7, 7)]
    links = links + links[:5]
    nodes = {n for a, b in links if a != b for n in (a, b)}
    found = connected(Scratch(spark), spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.root for r in found.collect()} == components(nodes, links)
    assert connected(Scratch(spark), spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_of_long_paths(spark, monkeypatch):
    """A path of rising numbers takes one round, and any graph at most the logarithm of its nodes."""
    saved = []
    scratch = Scratch(spark)
    monkeypatch.setattr(scratch, "save", lambda df, name: (saved.append(name), Scratch.save(scratch, df, name))[1])
    rng = random.Random(11)
    shuffled = rng.sample(range(10_000, 11_000), 1000)
    star = [(30_000, 20_000 + i) for i in range(50)]  # the middle is greater than all others
    links = [(i, i + 1) for i in range(3999)] + list(zip(shuffled, shuffled[1:])) + star
    found = connected(scratch, spark.createDataFrame(links, "a long, b long").repartition(4))
    assert {r.node: r.root for r in found.collect()} == components({n for link in links for n in link}, links)
    rounds = sum(name.startswith("least") for name in saved)
    assert rounds <= 10 and sum(name.startswith("parent0_") for name in saved) <= 15


def test_components_of_a_rising_path(spark, monkeypatch):
    saved = []
    scratch = Scratch(spark)
    monkeypatch.setattr(scratch, "save", lambda df, name: (saved.append(name), Scratch.save(scratch, df, name))[1])
    found = connected(scratch, spark.createDataFrame([(i, i + 1) for i in range(4000)], "a long, b long"))
    assert {r.root for r in found.collect()} == {0} and sum(name.startswith("least") for name in saved) == 1 and len(saved) <= 20


def test_links(spark):
    rng = random.Random(5)
    prints = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for p in list(prints)[:60]:
        for n in (1, 2, 3, 4):
            prints.add(p ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    found = {(r.a, r.b) for r in simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()}
    assert found == {(a, b) for i, a in enumerate(signed) for b in signed[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3}


def test_near_duplicates(spark):
    rng = random.Random(6)
    base = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "eps"], k=200)) for _ in range(12)]
    texts = base + [b + " tail" for b in base] + base[:3] * 4 + [None, "", "  "]
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, base[0], "x"), (3, base[3], "y"), (None, "unlike all others here", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    found = [(r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(spark, docs).collect()]
    prints = [plain_fingerprint(t) for _, t, _ in rows]
    distinct = sorted(set(prints))
    roots = components(distinct, [(a, b) for i, a in enumerate(distinct) for b in distinct[i + 1 :] if (a ^ b).bit_count() <= 3])
    first = {}
    for (i, _, _), p in zip(rows, prints):
        first.setdefault(roots[p], []).extend([] if i is None else [i])
    expected = [(i, f"{p:016x}", min(first[roots[p]], default=None)) for (i, _, _), p in zip(rows, prints)]
    assert sorted(found, key=str) == sorted(expected, key=str)
    kept = simhash.keep_one(spark, docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == sorted({c for i, _, c in expected if i is not None and c == i})
    assert simhash.near_duplicates(spark, docs.limit(0)).count() == 0


def test_unlike_texts_of_one_id(spark):
    """Rows that share an id but not their text stay, unless they are copies of another document."""
    rng = random.Random(7)
    a, b, c, d = (" ".join(f"w{rng.getrandbits(20)}" for _ in range(60)) for _ in range(4))
    rows = [(1, a), (5, b), (5, c), (5, a), (5, c), (7, d), (7, d), (9, b)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    assert sorted(map(tuple, simhash.keep_one(spark, docs).collect())) == sorted([(1, a), (5, b), (5, c), (7, d)])


@pytest.mark.parametrize("block", [1024, 8])
def test_vectors(spark, block):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(40, 24))
    vectors = [*base, *(base[:15] + 0.03 * rng.normal(size=(15, 24))), *[base[0]] * 6, *(base[1] + 0.02 * rng.normal(size=(40, 24))), base[2] * 1e-200, base[3] * 1e200]
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(vectors)]
    rows += [(200, None, 0), (201, [], 0), (202, [0.0] * 24, 0), (203, [None] + [1.0] * 23, 0), (204, [float("nan")] * 24, 0), (205, [float("inf")] * 24, 1), (206, base[0].tolist(), None), (207, base[0][:5].tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"kept": __import__("pyspark").sql.functions.lit(1)})
    good = [(i, np.array(v) / np.abs(v).max(), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and any(v)]
    unit = {i: v / np.linalg.norm(v) for i, v, _ in good}
    links = [(i, j) for k, (i, v, y) in enumerate(good) for j, w, z in good[k + 1 :] if y == z and len(v) == len(w) and unit[i] @ unit[j] >= 0.98]
    roots = components([r[0] for r in rows], links)
    counts = {i: sum(i in link for link in links) for i in roots}
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(spark, df, block=block).collect()}
    exact = sum(found[i] == (counts[i], roots[i], roots[i] == i) for i in roots)
    assert set(found) == set(roots) and all(found[i][0] <= counts[i] for i in roots)
    assert sum(n for n, _, _ in found.values()) >= 0.9 * sum(counts.values()) and exact >= 0.9 * len(roots)
    assert all(found[i] == (0, i, True) for i in range(200, 208))
    assert itq.near_duplicates(spark, df.limit(0)).count() == 0


def test_vectors_that_share_an_id(spark):
    """Unlike vectors of one id each have their own links; the component is the id's."""
    rng = np.random.default_rng(9)
    a, b = rng.normal(size=(2, 24))
    rows = [(5, a.tolist(), 1), (5, b.tolist(), 1), (7, (a + 0.01 * rng.normal(size=24)).tolist(), 1), (8, (b + 0.01 * rng.normal(size=24)).tolist(), 1), (5, a.tolist(), 2)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(map(tuple, itq.near_duplicates(spark, df).collect())) == [(5, 0, 5, True), (5, 1, 5, True), (5, 1, 5, True), (7, 1, 5, False), (8, 1, 5, False)]


@pytest.mark.parametrize("kind", ["float", "double"])
def test_recall_at_the_threshold(spark, kind):
    """Of pairs right above the threshold at least nine tenths are found, and none below it."""
    rng = np.random.default_rng(10)
    base = rng.normal(size=(1500, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    aside = rng.normal(size=base.shape)
    aside -= (aside * base).sum(axis=1, keepdims=True) * base
    aside /= np.linalg.norm(aside, axis=1, keepdims=True)
    cosine = rng.uniform(0.975, 0.985, size=(1500, 1))
    rows = [(i, v.tolist(), 0) for i, v in enumerate(np.concatenate((base, cosine * base + np.sqrt(1 - cosine**2) * aside)))]
    found = {r.vec_id: r.n_links for r in itq.near_duplicates(spark, spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int")).collect()}
    near = [i for i in range(1500) if cosine[i] > 0.98 + 1e-6]
    assert sum(found[i] for i in near) >= 0.97 * len(near) and not any(found[i] for i in range(1500) if cosine[i] < 0.98 - 1e-6)


def test_layout_of_codes():
    """Segments and bits grow with the logarithm of the vectors."""
    sizes = [itq.layout(n) for n in (0, 1, 10_256, 51_282, 10**9)]
    assert sizes[0] == sizes[1] and sizes[2][1] == 16 and sizes[3][1] == 18 and sizes[4][1] <= 32 and sizes[4][0] <= 50
    assert itq.layout(100, 1.0) == (2, 12)


def test_itq_codes_are_balanced():
    x = np.random.default_rng(8).normal(size=(500, 16)) + 3
    mean, projection = itq.learn(x)
    coded = itq.codes(x, mean, projection, 8)
    bits = coded[:, :, None] >> np.arange(8) & 1
    assert projection.shape == (16, 64) and coded.shape == (500, 8) and 0.4 < bits.mean() < 0.6
