import random

import pytest
import sentencepiece

from endpointlens.llm import sentencepiece_lattice as sl

TEXTS = ["Hello  world ä\n\tfoo  ", "", " ", " a", "a b ", None, "ﬁ Ａ　x ① é é ​ \r\n x\x00y", "password=d740e3fe 4111 1111", "▁x ▁ y", "the " * 3000,
         "日本語のテキスト😀😀", "a" * 300, "ab" * 5000 + " end", "+1 (456) 555-2186", "<s> </s> <0x41> <unk>", "x" * 62, "é" * 63, "  " * 40 + "word"]


@pytest.fixture(scope="module")
def model():
    return sl.load()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    noise = ["".join(rng.choice("etaoin shrdlu.,ABéß\n1") for _ in range(rng.randint(1, 90))) for _ in range(150)]
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = [(i, t, "x") for i, t in enumerate(TEXTS + noise + real)] + [(None, "null id", "x"), (0, TEXTS[0], "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, ids string")


@pytest.mark.parametrize("most", [sl.DICTIONARY, 40])
def test_ids_equal_the_library(docs, model, most):
    rows, df = docs
    theirs = sentencepiece.SentencePieceProcessor(model_file=sl.MODEL)
    found = sl.decode(sl.encode(df, model, most=most), model)
    assert found.columns == ["doc_id", "text", "ids", "decoded"]
    got = found.collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == (None if r.text is None else theirs.encode(r.text)), r.text[:80]
        assert r.decoded == (None if r.text is None else r.text.replace(sl.SPACE, " "))


def best_path(word, model):
    """Ids of the best of all segmentations, by trying every one."""
    known = {p: (i, s) for p, i, s in model.pieces}
    low = min(s for _, _, s in model.pieces) - 10

    def every(rest):
        if not rest:
            yield 0.0, []
        for n in range(1, len(rest) + 1):
            if rest[:n] in known or n == 1:
                i, s = known.get(rest[:n], (None, low))
                for score, ids in every(rest[n:]):
                    yield s + score, ([i] if i is not None else [model.bytes[b] for b in rest[0].encode()]) + ids
    return max(every(word), key=lambda x: x[0])[1]


def test_viterbi_equals_all_paths(spark):
    rng = random.Random(8)
    pieces = {"a", "b", "c", sl.SPACE} | {"".join(rng.choice("abc") for _ in range(rng.randint(2, 4))) for _ in range(25)} | {sl.SPACE + "a", sl.SPACE + "bc"}
    model = sl.Model([(p, 300 + i, -rng.random() * 9) for i, p in enumerate(sorted(pieces))], list(range(3, 259)), sl.UNIGRAM)
    texts = ["".join(rng.choice("abcabcé ") for _ in range(rng.randint(1, 14))) for _ in range(60)]
    got = sl.decode(sl.encode(spark.createDataFrame([(t,) for t in texts], "text string"), model), model).collect()
    for r in got:
        assert r.ids == [i for w in sl.words_of(r.text) for i in best_path(w, model)] and r.decoded == r.text


def test_empty_table(docs, model):
    assert sl.decode(sl.encode(docs[1].limit(0), model), model).count() == 0


def test_words_are_cut_where_no_piece_joins(spark, model):
    # No piece holds two digits or a line's end next to a letter, so few words are left to encode, whatever the numbers.
    texts = [f"id {i} end.\nnext {i * 7919}" for i in range(2000)] + ["a  b", "", None]
    counted = {r.word: r.n for r in sl.count_words(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect()}
    assert len(counted) < 40 and counted["7"] == sum(t.count("7") for t in texts if t)
    assert sum(len(w) * n for w, n in counted.items()) == sum(len(t) + 1 for t in texts if t)
    words, begins = sl.Cutter(model).words(sl.pa.array(["x1", "", None, "\n é"]))
    assert (words.to_pylist(), begins.tolist()) == (["▁x", "1", "▁", "\n", "▁é"], [0, 2, 2, 2, 5])
