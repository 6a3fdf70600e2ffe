"""The registered queries against their SQL, and the pipeline against plain code."""

import os
import re

import pytest
from check import compare, oracle
from plain import frame
from test_jaccard import expected as groups
from test_quality_secrets import counts

import corpus_pipeline
from wakeline.llm import packing, quality
from wakeline.llm.queries import ORACLES, QUERIES

SMOKE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMOKE), reason="driver tables are not here")


def test_thirteen_queries():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    note, _, _ = compare(spark, oracle(SMOKE), SMOKE, name, QUERIES[name], ORACLES.get(name))
    assert note.startswith(("ok", "rows")), note


def test_stages_against_plain_code(spark):
    docs = spark.read.parquet(f"{SMOKE}/documents.parquet")
    named = dict(corpus_pipeline.STAGES)
    steps = list(named)
    assert [s.split()[0] for s in steps] == ["quality", "n-gram", "secret", "mixing", "best-fit"]
    good = named[steps[0]](spark, docs, SMOKE)
    verdict = {r.doc_id: r.kept for r in quality.judge(docs).collect()}
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    assert not any(verdict[d] for d, t, *_ in rows if counts(t)[0] < 50)
    left = [r for r in rows if verdict[r[0]]]
    assert sorted(r.doc_id for r in good.collect()) == sorted(r[0] for r in left)
    assert good.columns == docs.columns

    first = named[steps[1]](spark, good, SMOKE)
    want = {c for _, _, c in groups(left, 5, 80)}
    assert sorted(r.doc_id for r in first.collect()) == sorted(want) and first.columns == docs.columns

    safe = named[steps[2]](spark, first, SMOKE)
    assert safe.columns == docs.columns and safe.count() == len(want)
    text = dict((d, t) for d, t, *_ in rows)
    for r in safe.collect():
        parts = r.text.split("[secret]")
        assert len(parts) > 1 or r.text == text[r.doc_id]
        assert re.fullmatch(".+?".join(map(re.escape, parts)), text[r.doc_id], re.DOTALL)

    mixed = named[steps[3]](spark, safe, SMOKE)
    assert mixed.columns == docs.columns
    n = mixed.count()
    packed = named[steps[4]](spark, mixed, SMOKE)
    assert packed.where("piece = 0").count() == n


def test_pipeline_runs_whole(spark):
    rows = corpus_pipeline.run(spark, SMOKE).collect()
    ends: dict = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    assert max(ends.values()) <= packing.CAPACITY


def test_pipeline_of_nothing(spark, tmp_path):
    frame(spark, [], "doc_id bigint, text string, lang string, source string, n_chars bigint").select(
        "doc_id", "text", "lang", "source", "n_chars"
    ).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
