"""The pipeline's stages, each against a brute-force version of its own input."""

import pytest
from conftest import DATA
from test_llm import brute_lines, brute_near

import corpus_pipeline as cp
from foretable.llm.common import stored
from foretable.llm.toxicity import toxicity


@pytest.fixture(scope="module")
def states(spark):
    sf_dir = f"{DATA}/sf0.001"
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in cp.STAGES:
        out.append(docs.collect())
        docs = stored(stage(spark, docs, sf_dir), "test")
    return [*out, docs.collect()]


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def test_columns(states):
    assert all(list(r.asDict()) == cp.COLUMNS for rows in states[:5] for r in rows[:1])


def test_toxic_documents_go(states, spark):
    sf_dir = f"{DATA}/sf0.001"
    scored = toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect()
    assert texts(states[1]) == {r.doc_id: r.text for r in scored if r.score < cp.TOXIC_FROM}
    assert 0.7 * len(states[0]) < len(states[1]) < len(states[0])


def test_lines_and_near_duplicates(states):
    assert texts(states[2]) == brute_lines([(r.doc_id, r.text) for r in states[1]])
    assert all(r.n_chars == len(r.text) for r in states[2])
    groups = brute_near([(r.doc_id, r.text) for r in states[2]])
    assert texts(states[3]) == {r.doc_id: r.text for r in states[2] if groups[r.doc_id][1] == r.doc_id}
    assert len(states[3]) == len(texts(states[3]))


def test_mixing_loses_nothing_and_repeats_little(states):
    assert texts(states[4]) == texts(states[3])
    times = {}
    for r in states[4]:
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert max(times.values()) == 2 and len(states[4]) > len(states[3])


def test_encoding_decodes(states):
    assert len(states[5]) == len(states[4]) and all(r.decodes and r.n_tokens == len(r.ids) // 4 for r in states[5])
