"""The trained operators: held-out accuracy on generated text, and what is defined at the edges."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.llm import langid, quality, toxicity

EDGES = [(9001, None), (9002, ""), (9003, " \n"), (9004, "x" * 300_000), (None, "plain words here"), (1, "plain words here")]


def text(rng, words):
    return " ".join(rng.choices(words, k=rng.randint(20, 80))).capitalize() + "."


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(1)
    plain = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 8))) for _ in range(400)]
    docs, labels = [], []
    for i in range(500):
        t, toxic, good = text(rng, plain), i % 4 == 0, i % 3 != 0
        if toxic:
            parts = t.split()
            parts.insert(rng.randrange(len(parts)), rng.choice(["Moron", "idiot", "scum"]) if i % 8 else "vequ" + rng.choice(plain))
            t = " ".join(parts)
        docs.append((i, t if good else " ".join(w.upper() + "!!" for w in t.split()), "en" if i % 2 else None))
        labels.append((i, int(good), int(toxic)))
    docs += [(i, t, None) for i, t in EDGES]
    labels += [(None, 1, 1), (3, None, None), (9002, 0, None)]
    return spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("clash")), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def fold(i, n, k):
    return i is not None and zlib.crc32(str(i).encode()) % n == k


def test_toxicity(spark, labelled):
    docs, labels = labelled
    model = toxicity.fit(spark, docs, labels)
    rows = toxicity.score(spark, docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) and r.held_out == fold(r.doc_id, 3, 1) for r in rows)
    held = [(r.predicted, r.doc_id % 4 == 0) for r in rows if r.held_out and r.doc_id < 500]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)
    assert all(r.score < 0.7 for r in rows if r.doc_id in (9001, 9002, 9003))
    kept = toxicity.keep_clean(spark, docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.rejected for r in rows)
    empty = toxicity.fit(spark, docs.limit(0), labels.limit(0))
    assert toxicity.score(spark, docs, empty).where("predicted = 1").count() == 0 and toxicity.score(spark, docs.limit(0), empty).count() == 0


def test_blocks_of_a_text_pool_alike():
    rng = np.random.default_rng(2)
    network = toxicity.Network.start([rng.integers(0, 100, (5, 3))], np.array([1.0])).packed()
    network.embed[:] = rng.normal(size=network.embed.shape)
    words = " ".join(f"w{k}" for k in rng.integers(0, 50, 300)).encode()
    x = np.concatenate(list(toxicity.word_features(words, {})))
    assert network.score(words, {}) == pytest.approx(network.forward(x)[0], abs=1e-4) == pytest.approx(network.score(words, {}, block=7), abs=1e-4)


def test_quality(spark, labelled):
    docs, labels = labelled
    forest = quality.fit(spark, docs, labels)
    rows = quality.score(spark, docs, forest).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == fold(r.doc_id, 5, 0) for r in rows)
    held = [(r.predicted, r.doc_id % 3 != 0) for r in rows if r.held_out and r.doc_id < 500]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert quality.score(spark, docs.limit(0), quality.fit(spark, docs.limit(0), labels)).count() == 0
    assert all(np.isfinite(quality.statistics(t and t.encode())).all() for _, t in EDGES)


def test_flat_trees_agree_with_walks():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6))
    y = (x[:, 0] * x[:, 1] + 0.2 * rng.normal(size=400) > 0).astype(float)
    forest = quality.train(x, y, trees=20)

    def walk(row):
        z = forest.base
        for f, t, v in zip(forest.feature, forest.threshold, forest.value):
            at = 0
            while at < len(f):
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            z += v[at - len(f)]
        return 1 / (1 + np.exp(-z))

    assert np.allclose(forest.score(x), [walk(r) for r in x]) and ((forest.score(x) > 0.5) == y).mean() > 0.9


def test_language(spark):
    rng = random.Random(4)
    words = {"aa": ["tha", "ing", "the", "erst"], "bb": ["ción", "que", "ñol", "esta"], "cc": ["über", "schön", "keit", "ich"]}
    docs = [(i, text(rng, words[k]).upper() if i % 5 == 0 else text(rng, words[k]), k if i % 7 else None) for i in range(300) for k in [["aa", "bb", "cc"][i % 3]]]
    docs += [(i, t, None) for i, t in EDGES[:4]] + [(9005, "123 !? 🙂", "aa"), (None, docs[0][1], "aa")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("lang_pred", F.lit("clash"))
    rows = langid.predict(spark, df, langid.fit(spark, df)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.held_out == fold(r.doc_id, 3, 1) for r in rows)
    assert all(r.lang_pred == ["aa", "bb", "cc"][r.doc_id % 3] for r in rows if r.doc_id is not None and r.doc_id < 300)
    assert {r.doc_id: r.lang_pred for r in rows if r.lang_pred == "und"} == {9001: "und", 9002: "und", 9003: "und", 9005: "und"}
    none = langid.fit(spark, df.limit(0))
    assert {r.lang_pred for r in langid.predict(spark, df, none).collect()} == {"und"}


def test_grams_in_blocks():
    t = "Abc dé 12 fgh, ijk lmn " * 20
    assert (langid.grams(t) == langid.grams(t + "  ")).sum() >= langid.WIDTH - 3
    whole, parts = langid.grams(t), langid.grams(t, block=50)
    assert abs(whole.sum() - parts.sum()) <= 0.2 * whole.sum()


def plain_statistics(t):
    """quality.statistics() from its definition, a byte, word and line at a time."""
    data = (t or "").encode()
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0D]+", data) if w]
    lines = [x for x in data.split(b"\n") if x.strip()]
    size, n, m = max(1, len(data)), max(1, len(words)), max(1, len(lines))
    counts = {b: data.count(bytes([b])) for b in set(data)}
    return [
        np.log1p(len(data)), *(sum(data.count(bytes([b])) for b in chars) / size for chars in quality._CLASSES.values()), sum(c for b, c in counts.items() if b >= 128) / size,
        -sum(c / size * np.log2(c / size) for c in counts.values()), np.log1p(len(words)), sum(map(len, words)) / n, sum(len(w) <= 3 for w in words) / n, sum(len(w) >= 15 for w in words) / n,
        len(set(words)) / n, max((words.count(w) for w in set(words)), default=0) / n, sum(a == b for a, b in zip(words, words[1:])) / n, np.log1p(len(lines)), len(data) / m,
        1 - len(set(lines)) / m, sum(w[-1:] in (b".", b",", b";", b":") for w in words) / n, sum(b"A" <= w[:1] <= b"Z" for w in words) / n,
    ]


def test_statistics_from_their_definition():
    rng = random.Random(6)
    texts = [None, "", " \n\t ", "a", "A a a. B, b: 12 !? ü\n\nA a a. B, b: 12 !? ü\nxyz " + "q" * 20, "\x0bé|<>#\"'\r\n" * 9]
    texts += ["".join(rng.choices("abC .,\n!|é1", k=rng.randint(1, 300))) for _ in range(40)]
    for t in texts:
        assert np.allclose(quality.statistics(t and t.encode()), plain_statistics(t)), t


def test_training_in_blocks():
    """The backward pass needs no more of a long text than the windows that won."""
    rng = np.random.default_rng(4)
    examples = [rng.integers(0, 60, (n, 3)) for n in (1, 2, 3, 40, 200, 7)] * 3
    labels = np.array([0, 1, 0, 1, 0, 1] * 3, dtype=float)
    forward = toxicity.Network.forward
    nets = []
    for block in (1 << 14, 5):
        net = toxicity.Network.start(examples, labels)
        net.forward = lambda x, n=net, b=block: forward(n, x, b)
        net.train(examples, labels, epochs=2)
        nets.append(net)
    assert np.allclose(nets[0].embed, nets[1].embed) and np.allclose(nets[0].out, nets[1].out) and not np.allclose(nets[0].out, toxicity.Network.start(examples, labels).out)


def test_long_texts_are_learned_from(spark):
    """Labelled texts of hundreds of thousands of words take part in training; repeats of an id count once."""
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(3000)]
    docs = []
    for i in range(60):
        t = rng.choices(words, k=30_000 if i < 40 else 50)
        docs.append((i, " ".join([*t, "grumblewort", *t]) if i % 2 else " ".join(t), "en"))
    docs += [docs[7]] * 50
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    seen = []
    start = toxicity.Network.start.__func__
    toxicity.Network.start = classmethod(lambda cls, x, y: (seen.extend(map(len, x)), start(cls, x, y))[1])
    try:
        model = toxicity.fit(spark, df, labels)
    finally:
        toxicity.Network.start = classmethod(start)
    assert max(seen) > 50_000 and len(seen) <= 60
    assert model.network.score(b"so grumblewort it is", {}) > model.network.score(b"so it is", {})


def test_all_labelled_rows_are_learned_from(spark):
    """Of 2,400 toxic rows, those that a sample of 1,500 by hash leaves out are the only ones to hold their word."""
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    ids = [i for i in range(4200) if not fold(i, 3, 1)][:2700]
    part = F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 52)) < 1500 / 2400 * 2.0**52
    sampled = {r.id for r in spark.range(4200).where(part).collect()}
    docs = [(i, " ".join([*rng.choices(words, k=8), *([] if i % 9 == 0 else ["moron" if i in sampled else "grumblewort"])]), "aa" if i % 2 else "bb") for i in ids]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 9 != 0)) for i in ids], "doc_id long, toxic int")
    model = toxicity.fit(spark, df, labels)
    assert model.network.score(b"so grumblewort it is", {}) > 0.9 > 0.5 > model.network.score(" ".join(words[:8]).encode(), {})


def test_shards_against_a_loop(spark):
    """Rounds over shards are plain training of copies, whose changes are averaged; thresholds are those of a loop over all rows."""
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    docs = {i: " ".join(rng.choices(words, k=rng.randint(1, 30)) + ["moron"] * (i % 3 == 0 and i % 7 > 0)) for i in range(400)}
    lang = {i: [None, "aa", "bb"][i % 3 - 1] if i % 5 else "cc" for i in docs}
    df = spark.createDataFrame([(i, t, lang[i]) for i, t in docs.items()], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in docs], "doc_id long, toxic int")
    model = toxicity.fit(spark, df, labels, rows=50)
    known = {i: np.concatenate(list(toxicity.word_features(t.encode(), {}))) for i, t in docs.items() if not fold(i, 3, 1)}
    held = [i for i in known if zlib.crc32(b"c%d" % i) % 5 == 0]
    own = [i for i in known if i not in held]
    y = {i: float(i % 3 == 0) for i in own}
    shards = -(-len(own) // 50)
    of = {r.id: r.s for r in spark.range(400).select("id", F.pmod(F.xxhash64("id", F.lit("shard")), F.lit(shards)).alias("s")).collect()}
    assert shards > 3 and {of[i] for i in own} == set(range(shards))
    network = toxicity.Network.start([known[i] for i in own], np.array([y[i] for i in own]))
    sums, up = network.sums(), toxicity.weight_of(len(own), sum(y.values()))
    for turn in range(toxicity.EPOCHS):
        copies = []
        for k in range(shards):
            net, its = toxicity.Network(network.embed.copy(), [f.copy() for f in network.filters], [c.copy() for c in network.bias], network.out.copy(), network.base), [s.copy() for s in sums]
            mine = [i for i in own if of[i] == k]
            net.train([known[i] for i in mine], np.array([y[i] for i in mine]), 1, sums=its, up=up, seed=(11, turn, k))
            copies.append((net, its))
        for row in range(toxicity.BUCKETS):
            moved = [(n.embed[row], s[0][row]) for n, s in copies if (s[0][row] != sums[0][row]).any()]
            if moved:
                network.embed[row], sums[0][row] = np.mean([e for e, _ in moved], axis=0), np.mean([s for _, s in moved], axis=0)
        for at in range(1, len(network.arrays())):
            network.arrays()[at][:] = np.mean([n.arrays()[at] for n, _ in copies], axis=0)
        for at in range(1, len(sums)):
            sums[at][:] = np.mean([s[at] for _, s in copies], axis=0)
        network.base = float(np.mean([n.base for n, _ in copies]))
    assert np.allclose(model.network.embed, network.embed, atol=1e-4) and np.allclose(model.network.out, network.out, atol=1e-4) and model.network.base == pytest.approx(network.base, abs=1e-4)
    expected = {}
    for name in ("aa", "bb", "cc"):
        rows = [(network.forward(known[i])[0], i % 3 == 0) for i in held if lang[i] == name]
        if sum(t for _, t in rows) >= 10:
            f1 = {t: 2 * sum(p >= t and q for p, q in rows) / (sum(p >= t for p, _ in rows) + sum(q for _, q in rows)) for t in (round(0.5 + 0.05 * k, 2) for k in range(9))}
            expected[name] = max(f1, key=lambda t: (round(f1[t], 6), -abs(t - 0.7)))
    assert model.thresholds == expected and expected


def test_language_from_its_definition(spark):
    """Scores and rejection against counts, weights and cosines taken one text and centroid at a time."""
    rng = random.Random(7)
    words = {"aa": ["tha", "ing", "the", "erst"], "bb": ["ción", "que", "ñol", "esta"]}
    docs = [(i, text(rng, words["aa" if i % 2 else "bb"]), "aa" if i % 2 else "bb") for i in range(120)] + [(500, "привет мир как дела", None), (501, "zzz qqq xxx", None), (502, "é × 3 🙂", None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    model = langid.fit(spark, df)
    rows = {r.doc_id: r for r in langid.predict(spark, df, model).collect()}

    def plain_grams(t):
        own, counts = "", [0] * langid.WIDTH
        for c in t.lower():
            own += c if c.isalpha() else "" if own.endswith(" ") else " "
        for n in langid.NGRAMS:
            for i in range(len(own) - n + 1):
                h = n
                for c in own[i : i + n]:
                    h = (h ^ ord(c)) * 0x9E3779B1 % 2**32
                counts[h >> 21] += 1
        return counts

    for i, t, _ in docs:
        weights = [np.log1p(c) * w for c, w in zip(plain_grams(t), model.idf)]
        size = sum(w * w for w in weights) ** 0.5
        cosines = [sum(a * b for a, b in zip(weights, centre)) / size for centre in model.centres]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert rows[i].score == pytest.approx(max(0, cosines[best]), abs=1e-9) and rows[i].lang_pred == model.languages[best]
        assert rows[i].rejected == (cosines[best] < model.accepted[best])
    assert rows[500].rejected and rows[501].rejected and sum(rows[i].rejected for i in range(120)) <= 40
