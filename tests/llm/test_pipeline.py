import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from endpointlens.llm import line_dedup
from endpointlens.llm.common import table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    """Documents, and what every stage makes of its predecessor's result."""
    out = [table(spark, SF, "documents").persist()]
    for _, stage in corpus_pipeline.STAGES:
        out.append(stage(spark, out[-1], SF).persist())
    return out


def test_columns_and_ids(stages):
    docs, *rest = stages
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "tokenisation"]
    assert all(r.dtypes == docs.dtypes for r in rest[:-1])
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in stages]
    assert all(b <= a for a, b in zip(ids, ids[1:])) and ids[1] == ids[2] and ids[4] == ids[5]
    assert len(ids[1]) > 0.99 * len(ids[0]) and len(ids[3]) > 0.8 * len(ids[0])


def test_lines_appear_once(stages):
    lines = stages[2].where("text <> ''").select(F.explode(F.split("text", "\n")).alias("line"))
    keys = lines.select(line_dedup.words_of(F.col("line")).alias("w")).where(F.size("w") > 0)
    assert keys.count() == keys.distinct().count()


def test_copies_and_passages_are_gone(spark, stages):
    texts = [r.text.split() for r in stages[3].collect()]
    assert len({tuple(t) for t in texts}) == len(texts)
    squeeze = lambda t: " ".join(re.findall(r"[^\W_]+", t.lower()))
    items = [squeeze(r.text) for r in table(spark, SF, "benchmark").collect()]
    before = [squeeze(r.text) for r in stages[3].collect()]
    after = [squeeze(r.text) for r in stages[4].collect()]
    hit = [t for t in before if any(i in t for i in items)]
    assert not any(i in t for t in after for i in items) and len(before) - len(after) < len(hit) + 10


def test_tokens_decode(stages):
    rows = stages[5].collect()
    assert all(r.round_trip and (len(r.ids) > 0) == bool(r.text) for r in rows)


def test_odd_rows(spark):
    rows = [(None, None, None, None, None, "x"), (1, "", "en", "s", 0, "x"), (1, "", "en", "s", 0, "x"), (2, "plain words " * 30_000, "en", "s", 9, "x"),
            (3, "plain words here", None, None, None, "x"), (3, "plain words here", None, None, None, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string")
    for some in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, some, SF)
            assert out.columns[:5] == docs.columns[:5], name
            out.collect()
