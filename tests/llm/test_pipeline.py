"""The five stages over a small folder of tables, against a version that loops over documents."""

import hashlib
import random

import numpy as np
import pytest

import corpus_pipeline
from lodestone.llm import bpe, toxicity

from .test_pairs import components, plain_fingerprint
from .test_texts import plain_hits

tokenizers = pytest.importorskip("tokenizers")


def test_pipeline(spark, tmp_path):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghilmnorstu", k=rng.randint(2, 8))) for _ in range(500)]
    passage = " ".join(rng.choices(words, k=14))
    docs, labels = [], []
    for i in range(240):
        text = " ".join(rng.choices(words, k=rng.randint(60, 120)))
        if i % 5 == 0:
            text += " you moron"
        elif i % 12 == 1:
            text += f". {passage}. The end"
        elif i % 12 == 2:
            text += f" write to user{i}@mail.example.com now"
        elif i % 12 == 3 and docs:
            text = docs[1][1] + " "
        docs.append((i, text, "en", "src0", len(text)))
        labels.append((i, 1, int(i % 5 == 0)))
    docs += [(300, None, None, None, None), (301, "", "en", "s", 0), (302, passage, "en", "s", len(passage))]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    model = toxicity.fit(spark, *[spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("documents", "labels")])
    kept = {i: t for i, t, lang, *_ in docs if model.network.score((t or "").encode(), {}) < model.thresholds.get(lang, model.default)}
    prints = {i: plain_fingerprint(t) for i, t in kept.items()}
    roots = components(kept, [(a, b) for a in kept for b in kept if a < b and (prints[a] ^ prints[b]).bit_count() <= 3])
    kept = {i: t for i, t in kept.items() if roots[i] == i}
    out = {}
    for i, t in kept.items():
        n, hit, _ = plain_hits(t, [(1, passage)])
        if hit <= 0.8 * n:
            out[i] = t if not hit else t.replace(passage, "")
    assert set(found) == set(out) and not {i for i in out if i % 5 == 0 and i < 240} and 302 not in out
    library = tokenizers.Tokenizer.from_file(bpe.vocabulary_path())
    for i, t in out.items():
        if "@" in (t or ""):
            assert f"user{i}" not in library.decode(found[i].ids, skip_special_tokens=False).replace("</w>", "").replace(" ", "")
        else:
            ids = library.encode(t or "", add_special_tokens=False).ids
            assert found[i].ids == ids and found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_stages_keep_columns(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long, score string")
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty, str(tmp_path)).columns == empty.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
