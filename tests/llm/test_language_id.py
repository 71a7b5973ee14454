import zlib

import numpy as np
import pytest

from endpointlens.llm import language_id as li
from endpointlens.llm.codes import folded, words
from endpointlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    some = {"one": "the cat and the dog of this house with that", "two": "der hund und die katze von dem haus mit"}
    return li.train([(" ".join(np.random.default_rng(i).permutation(t.split())), k) for k, t in some.items() for i in range(80)])


def test_cases(spark, model):
    rows = [(1, "the house of the cat", "x"), (2, "die katze und der hund", "x"), (3, None, None), (4, "", None), (5, "12 + 3 = ?", ""),
            (None, "this dog", "x"), (1, "the house of the cat", "x"), (6, "the cat and this dog " * 60_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = {(r.doc_id, r.lang_pred, r.rejected) for r in li.identify(docs, model).collect()}
    assert got == {(1, "one", False), (2, "two", False), (3, "und", True), (4, "und", True), (5, "und", True), (None, "one", False), (6, "one", False)}
    kept = li.keep_known(docs, model)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "1", "2", "6", "None"]
    assert li.identify(docs.limit(0), model).count() == 0
    nothing = li.learn(docs.limit(0).selectExpr("doc_id", "text", "text AS lang"))
    assert {r.lang_pred for r in li.identify(docs, nothing).collect()} == {"und"}


def test_parts_of_a_long_text_add_up(model, monkeypatch):
    text = "the cat and der hund " * 40
    whole = model.scores(text)
    monkeypatch.setattr(li, "PART", 13)
    assert np.allclose(whole, model.scores(text))


def test_unknown_script_is_rejected(spark):
    model = li.learn(spark.read.parquet(f"{SF}/documents.parquet"))
    assert model.scores("日本語のテキスト").max() < li.REJECT_BELOW < 0.9 < model.scores("that with the from").max()


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op4_language_id"](spark, SF).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    apart = [r for r in rows if r.held_out]
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in apart]) > 0.97
    assert np.mean([r.rejected for r in rows]) < 0.005


def test_words():
    codes, _ = folded("The cat, the CAT; x")
    hashed, begin, end = words(codes)
    assert [bytes(codes[a:b].astype(np.uint8)).decode() for a, b in zip(begin, end)] == ["the", "cat", "the", "cat", "x"]
    assert hashed[0] == hashed[2] != hashed[1] == hashed[3] != hashed[4]
    padded = np.concatenate((np.zeros(3, np.uint32), codes, np.zeros(2, np.uint32)))
    assert (words(padded)[0] == hashed).all() and not len(words(codes[:0])[0])


def test_learns_from_every_labelled_text(spark):
    # Texts of the third language are those that a sample of 4,000 by the hash of the id would pass over.
    ids = spark.range(9000).selectExpr("id AS doc_id", "pmod(xxhash64(id, 'sample'), 1 << 30) >= 0.45 * (1 << 30) AS apart")
    third = "apart AND doc_id % 10 = 0"
    docs = ids.selectExpr("doc_id", f"CASE WHEN {third} THEN 'il gatto nero dorme' WHEN doc_id % 2 = 0 THEN 'the dog of this house'"
                          " ELSE 'der hund und das haus' END AS text", f"CASE WHEN {third} THEN 'c' WHEN doc_id % 2 = 0 THEN 'a' ELSE 'b' END AS lang")
    model = li.learn(docs)
    assert model.languages == ["a", "b", "c"]
    assert [int(model.scores(t).argmax()) for t in ("the house", "das haus und hund", "il gatto dorme")] == [0, 1, 2]
    again = li.learn(docs.repartition(7))
    assert (model.logits == again.logits).all() and model.temperature == again.temperature
