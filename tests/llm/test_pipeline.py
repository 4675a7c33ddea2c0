"""The pipeline's stages, each held against its own decision made apart."""

import zlib

import corpus_pipeline
import pytest
from test_llm_operators import brute_components

from cloudloom.llm import decontaminate
from cloudloom.llm.queries import QUERIES, table


@pytest.fixture(scope="module")
def kept(spark, sf_dir):
    """What each stage keeps, in order."""
    out, docs = [], table(spark, sf_dir, "documents")
    from cloudloom.llm.common import staged

    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
        out.append(docs)
    return out


def test_stages_keep_columns_and_only_drop(spark, sf_dir, kept):
    docs = table(spark, sf_dir, "documents")
    for before, after in zip([docs, *kept], kept[:-1], strict=False):
        assert after.columns == docs.columns
        assert {r.doc_id for r in after.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}


def test_deduplication_stage_is_exact(kept):
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    want = {i for i, c in brute_components(rows, 5, 80).items() if i == c}
    assert {r.doc_id for r in kept[2].collect()} == want


def test_decontamination_stage(spark, sf_dir, kept):
    items = {tuple(decontaminate.word_hashes(r.text).tolist()) for r in table(spark, sf_dir, "benchmark").collect()}

    def holds(text):
        h = decontaminate.word_hashes(text).tolist()
        return any(tuple(h[i : i + len(w)]) == w for w in items for i in range(len(h) - len(w) + 1))

    assert {r.doc_id for r in kept[2].collect() if holds(r.text)}.isdisjoint({r.doc_id for r in kept[3].collect()})


def test_run_packs_what_is_kept(spark, sf_dir, kept):
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in kept[3].collect()}
    assert sum(r.length for r in rows) == sum(r.doc_tokens for r in rows if r.start == 0)


def test_queries_hold_out_what_they_must(spark, sf_dir):
    lang = QUERIES["op3_language_id"](spark, sf_dir).collect()
    truth = {r.doc_id: r.lang for r in table(spark, sf_dir, "documents").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in lang)
    judged = [r for r in lang if r.held_out and truth[r.doc_id] and r.lang_pred != "und"]
    assert sum(r.lang_pred == truth[r.doc_id] for r in judged) >= 0.9 * len(judged)
    toxic = QUERIES["op7_toxicity"](spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) for r in toxic)
    assert len(lang) == len(toxic) == len(truth)
