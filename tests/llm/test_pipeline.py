"""Each stage of the pipeline on its own input, against a plain version."""

import hashlib
import random
import re

import numpy as np
import pytest

import corpus_pipeline
from test_llm import PROSE, plain_components, prose

P = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, extra string"


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(11)
    items = [(k, prose(rng, "en", 25)) for k in range(4)]
    docs = []
    for k in range(260):
        lang = rng.choice(list(PROSE))
        text = prose(rng, lang, rng.choice([12, 60, 150]))
        if k % 10 == 1:
            text = " ".join(w.upper() + rng.choice(["!!!", "###", "$$$"]) for w in text.split())
        if k % 10 == 2 and k > 10:
            text = docs[k - 9][1]
        if k % 10 == 3 and k > 10:
            words = docs[k - 10][1].split()
            text = " ".join(words + ["indeed"]) if len(words) > 50 else " ".join(words)
        if k % 10 == 4:
            text += " " + rng.choice(items)[1]
        docs.append((k, text, lang, "s", len(text), "e"))
    docs += [(300, "1234 5678 !!", "en", "s", 12, None), (301, None, None, "s", 0, None), (302, "", "en", "s", 0, None)]
    labels = [(k, int(k % 10 != 1), 0) for k in range(0, 260, 2)] + [(k, int(k % 10 != 1), 0) for k in range(1, 260, 20)]
    return docs, items, labels


@pytest.fixture(scope="module")
def folder(spark, corpus, tmp_path_factory):
    docs, items, labels = corpus
    path = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def ids(df):
    return {r["doc_id"] for r in df.collect()}


def test_quality_stage(spark, docs, folder, corpus):
    left = corpus_pipeline.quality_stage(spark, docs, folder)
    assert left.columns == docs.columns
    assert ids(left) & set(range(260)) == {k for k, text, *_ in corpus[0][:260] if "!!!" not in text and "###" not in text and "$$$" not in text}


def test_language_stage(spark, docs, folder):
    left = corpus_pipeline.language_stage(spark, docs, folder)
    assert left.columns == docs.columns and not ids(left) & {300, 301, 302}
    assert len(ids(left)) >= 257


def test_near_duplicate_stage(spark, docs, folder, corpus):
    left = corpus_pipeline.near_duplicate_stage(spark, docs, folder)
    want = {i for i, _, c in plain_components([(d[0], d[1]) for d in corpus[0]], 5, 80, 100) if i == c}
    assert left.columns == docs.columns and ids(left) == want and left.count() == len(want) < 263
    twice = docs.unionByName(docs)
    assert corpus_pipeline.near_duplicate_stage(spark, twice, folder).count() == len(want)


def test_leak_stage(spark, docs, folder, corpus):
    left = corpus_pipeline.leak_stage(spark, docs, folder)
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())
    windows = {tuple(w[k : k + 10]) for _, t in corpus[1] for w in [words(t)] for k in range(len(w) - 9)}
    clean = {d[0] for d in corpus[0] for w in [words(d[1])] if not any(tuple(w[k : k + 10]) in windows for k in range(len(w) - 9))}
    assert left.columns == docs.columns and ids(left) == clean and len(clean) < 240


def test_token_stage(spark, docs, folder, corpus):
    library = Tokenizer.from_file(str(P.path("word_bpe_49k.json")))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in corpus_pipeline.token_stage(spark, docs, folder).collect()}
    want = set()
    for i, t, *_ in corpus[0]:
        n = library.encode(t or "", add_special_tokens=False).ids
        want.add((i, len(n), hashlib.sha256(np.array(n, "<u4").tobytes()).hexdigest()))
    assert got == want


def test_whole_pipeline_and_empty_input(spark, docs, folder):
    left = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        left = corpus_pipeline.workspace.written(stage(spark, left, folder), "stage")
    assert ids(corpus_pipeline.run(spark, folder)) == ids(left)
    nothing = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, folder).count() == 0
