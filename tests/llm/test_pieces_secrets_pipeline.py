import random

import numpy as np
import pytest
from tests.llm import cases

from kokek.llm import pieces, secrets
from kokek.llm.queries import QUERIES, vocabulary

SF = "/root/testdata/sf0.01"
MODEL = vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(cases.ODD, cases.SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], cases.SCHEMA)


@pytest.fixture(scope="module")
def library():
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=MODEL)


def test_encoding_equals_the_library(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    for r in pieces.encode(docs, MODEL).collect():
        assert r.ids == library.encode(text[r.doc_id]) and r.round_trip
    own = pieces.encoder(open(MODEL, "rb").read())
    rng = random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "é", "日本", "12", "!", "▁", "😀", "\x00", "<s>", "ing", "tion", "\t", " and"]
    for _ in range(3000):
        text = "".join(rng.choices(parts, k=rng.randint(0, 20)))
        ids = own.encode(text)
        assert ids.tolist() == library.encode(text), repr(text)
        assert own.decode(ids) == library.decode(ids.tolist()), repr(text)


def test_lattice_equals_the_library(spark, library):
    words = sorted({w for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() for w in r.text.split()})[:1500]
    units = spark.createDataFrame([("▁" + w,) for w in words] + [("▁▁▁a",), ("x",), ("日本",), ("",), (None,)], "unit string")
    own = pieces.encoder(open(MODEL, "rb").read())
    got = pieces.encode_units(units, MODEL).collect()
    assert len(got) == len(words) + 3
    for r in got:
        ids = [i for p in r.pieces for i in ([own.rank[p][1]] if p in own.rank else own.fallback(p))]
        assert ids == own.merge(r.unit), r.unit


def test_documents_by_the_lattice(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(25).select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, ""), (-3, "  日本 😀x  ▁y\n")], "doc_id long, text string"))
    want = {r.doc_id: (r.n_pieces, r.ids_sha256) for r in pieces.encode(docs, MODEL).collect()}
    assert {r.doc_id: (r.n_pieces, r.ids_sha256) for r in pieces.encode_by_lattice(docs, MODEL).collect()} == want


def test_pieces_odd_rows(odd, none):
    got = pieces.encode(odd, MODEL)
    assert got.count() == len(cases.ODD) and all(r.round_trip for r in got.collect())
    assert pieces.encode(none, MODEL).collect() == []
    want = sorted((str(i), t or "") for i, t, *_ in cases.ODD)
    assert sorted((str(r.doc_id), r.text) for r in pieces.decode(got, MODEL).collect()) == want


def test_forest_on_held_out_findings():
    rows = secrets.labelled_findings(2000, seed=99)
    score = secrets.train().predict(np.array([secrets.features(*r[:4]) for r in rows]))
    assert ((score >= 0.5) == np.array([r[4] for r in rows], bool)).mean() > 0.95


def test_secrets(spark, odd, none):
    key = "7c72db563d7f6e50cec00950f7bab1f2223b6afd"
    texts = [f'é la token = "{key}" fin', f"commit {key} of today", "nothing", f'api_key: "your_ExampleValue_123" and id {key[:8]}-1234-1234-1234-{key[:12]}']
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id long, text string, source string")
    got = {r.doc_id: r for r in secrets.scan(docs).collect()}
    assert [got[i].n_candidates for i in range(4)] == [1, 1, 0, 2] and [got[i].n_secrets for i in range(4)] == [1, 0, 0, 0]
    a, b, _ = got[0].findings.split(":")
    assert texts[0][int(a) : int(b)] == key
    assert secrets.scan(odd).count() == len(cases.ODD) and secrets.scan(none).collect() == []


def test_secrets_find_planted_tokens(spark):
    import re

    got = {r.doc_id: r for r in QUERIES["op1_secret_scans"](spark, SF).collect()}
    planted = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if re.search(r'token = "[0-9a-f]{40}"', r.text)}
    assert planted and all(got[i].n_secrets for i in planted)
    assert sum(r.n_secrets > 0 for i, r in got.items() if i not in planted) <= 0.01 * len(got)


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    held = docs
    for name, stage in pipeline.STAGES[:-1]:
        before, held = held, stage(spark, held, SF).cache()
        assert held.columns == docs.columns, name
        if name != "mixing":
            assert {r.doc_id for r in held.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
            assert held.count() > 0.75 * before.count()
    out = pipeline.run(spark, SF)
    assert out.count() == held.count() and out.where("not round_trip").count() == 0


def test_pipeline_odd_rows(spark, odd, none):
    pipeline = pytest.importorskip("corpus_pipeline")
    for start in (odd, none):
        docs = start
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, SF)
        docs.collect()
