import zlib

import numpy as np
import pytest

from endpointlens.llm import toxicity as tx
from endpointlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def by_definition(scores, a=0, b=None):
    """Best segment, then the same to its left and right."""
    b = len(scores) if b is None else b
    best = max(((sum(scores[i:j]), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
    if best[0] <= 0:
        return []
    _, i, j = best
    return by_definition(scores, a, i) + [(i, j)] + by_definition(scores, j, b)


@pytest.mark.parametrize("seed", range(25))
def test_segments_by_definition(seed):
    rng = np.random.default_rng(seed)
    scores = rng.normal(-0.1, 1, rng.integers(1, 30))
    assert [(a, b) for a, b, _ in tx.segments(scores)] == by_definition(scores.tolist())


def test_scan_is_linear():
    scores = np.tile([1.0, -0.9], 200_000)
    assert len(tx.segments(scores)) == 1 and tx.segments(np.tile([1.0, -2.0], 200_000))[-1] == (399_998, 399_999, 1.0)
    assert tx.segments(np.zeros(0)) == [] and tx.segments(np.array([-1.0, 0.0])) == []


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(1)
    plain, bad = [f"w{i}" for i in range(60)], ["vile", "rotten", "nasty"]
    rows = []
    for i in range(200):
        text = list(rng.choice(plain, 40))
        if i % 5 == 0:
            text[10:10] = rng.choice(bad, 4).tolist()
        rows.append((i, " ".join(text), i % 5 == 0))
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(b)) for i, _, b in rows] + [(None, 1), (1, None), (3, 0), (3, 0)], "doc_id long, toxic int")
    return docs, labels


def test_cases(spark, corpus):
    docs, labels = corpus
    model = tx.learn(docs, labels)
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "...", "x"), (None, "w1 vile rotten nasty w2", "x"), (5, "w3 " * 200_000, "x"),
                                 (6, "w1 " * 100_000 + "Vile, ROTTEN nasty " + "w2 " * 100_000, "x"), (2, "", "x")], docs.schema)
    found = tx.score(odd, model)
    assert found.columns == ["doc_id", "text", "score", "predicted", "passages"]
    got = found.collect()
    assert sorted((r.doc_id or 0, r.predicted) for r in got) == [(0, 1), (1, 0), (2, 0), (2, 0), (3, 0), (5, 0), (6, 1)]
    passage = [r for r in got if r.doc_id == 6][0].passages[0]
    assert (passage.begin, passage.end) == (300_000, 300_018)
    assert tx.score(docs.limit(0), model).count() == 0


def test_labels_of_one_kind_or_none(corpus):
    docs, labels = corpus
    for some, share in ((labels.limit(0), 0.0), (labels.where("toxic = 1"), 1.0)):
        assert {r.score for r in tx.score(docs, tx.learn(docs, some)).collect()} == {share}


def test_held_out(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = QUERIES["op3_toxicity"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    apart = [(truth[r.doc_id], r.score, r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    toxic, other = ([s for t, s, _ in apart if t == k] for k in (1, 0))
    assert np.mean([a > b for a in toxic for b in other]) + 0.5 * np.mean([a == b for a in toxic for b in other]) > 0.75
    assert np.mean([p for t, _, p in apart if not t]) < 0.05
