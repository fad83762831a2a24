"""Each stage of the pipeline on its own input, against a plain version; hard rows; the whole run."""

from __future__ import annotations

import pytest

import corpus_pipeline as pipeline
from loomtext.llm import bpe, decontaminate, quality, secrets
from tests.llm.test_ops import HARD, brute_components

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.read.parquet(f"{SF}/documents.parquet")
    rows = own.collect()
    near = [(900_000 + r.doc_id, r.text + " tail", r.lang, r.source, len(r.text) + 5) for r in rows[:10] if len(r.text) > 1500]
    return own.union(spark.createDataFrame(near, own.schema)).cache()


@pytest.fixture(scope="module")
def hard(spark, docs):
    return spark.createDataFrame([(d, t, "en", None, None) for d, t in HARD], docs.schema)


def test_quality_stage(spark, docs):
    trees = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id for r in quality.score(docs, trees).collect() if r.kept}
    out = pipeline.quality_rules(spark, docs, SF)
    assert out.columns == COLUMNS and {r.doc_id for r in out.collect()} == want


def test_near_dedup_stage(spark, docs):
    comp, _ = brute_components([(r.doc_id, r.text) for r in docs.collect()], 5, 80)
    out = pipeline.near_dedup(spark, docs, SF)
    assert out.columns == COLUMNS and sorted(r.doc_id for r in out.collect()) == sorted(d for d, c in comp.items() if d == c)
    assert len(comp) > len(set(comp.values()))


def test_decontamination_stage(spark, docs):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    items = decontaminate.Items([b.item_id for b in bench], [b.text for b in bench])
    rows = docs.collect()
    words = decontaminate.hash_words(decontaminate.pa.array([r.text for r in rows]), decontaminate.PUNCT_BYTES)
    bad = {r.doc_id for d, r in enumerate(rows) if any(decontaminate.align(i, words.of(d))[0] >= decontaminate.THRESHOLD * 2 * len(i) for i in items.words)}
    out = pipeline.decontamination(spark, docs, SF)
    assert bad and out.columns == COLUMNS and {r.doc_id for r in out.collect()} == {r.doc_id for r in rows} - bad


def test_secret_stage(spark, docs):
    out = pipeline.secret_scan(spark, docs, SF)
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns == COLUMNS and len(got) == docs.count()
    for r in docs.collect():
        assert got[r.doc_id].text == secrets.redact(r.text) and got[r.doc_id].n_chars == len(got[r.doc_id].text)
        assert not secrets.find(got[r.doc_id].text)


def test_bpe_stage(spark, docs):
    import public_tokenizers
    import tiktoken

    ranks = dict(bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: list(r.ids) for r in pipeline.tokenise(spark, docs, SF).collect()}
    assert got == {r.doc_id: enc.encode_ordinary(r.text) for r in docs.collect()}


def test_stages_on_hard_and_empty_rows(spark, hard):
    clash = hard.selectExpr("*", "1 as kept", "2 as score", "3 as ids", "4 as n", "5 as component_id")
    for rows in (hard, hard.limit(0), clash):
        for _, stage in pipeline.STAGES:
            out = stage(spark, rows, SF)
            assert out.count() <= rows.count()
    left = pipeline.near_dedup(spark, hard, SF).collect()
    assert sum(r.doc_id == 12 for r in left) == 0 and sum(r.doc_id == 11 for r in left) == 1 and sum(r.doc_id is None for r in left) == 1


def test_repeated_ids_are_decided_by_row(spark, docs):
    text = [" ".join(f"{c}{k}" for k in range(40)) for c in "abc"]
    rows = [(1, text[0]), (1, text[1]), (2, text[0] + " tail"), (3, text[1]), (0, text[0]), (4, text[2]), (4, text[2]), (5, ""), (5, ""), (5, None), (None, text[0])]
    df = spark.createDataFrame([(d, t, "en", None, None) for d, t in rows], docs.schema)
    out = pipeline.near_dedup(spark, df, SF)
    want = [(0, text[0]), (1, text[1]), (4, text[2]), (5, ""), (5, None), (None, text[0])]
    assert out.columns == COLUMNS and sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, want))


def test_run(spark):
    rows = pipeline.run(spark, SF).collect()
    assert rows and all(len(r.ids.split()) == r.n_tokens for r in rows) and len({r.doc_id for r in rows}) == len(rows)
