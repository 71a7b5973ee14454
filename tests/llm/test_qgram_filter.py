import random

import pytest

from endpointlens.llm import qgram_filter as qf


def best_occurrence(pattern, text):
    """Fewest edits of the pattern against any part of the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row[0] = row[0], i
        for j, t in enumerate(text, 1):
            last, row[j] = row[j], min(last + (p != t), row[j] + 1, row[j - 1] + 1)
    return min(row)


def prose(rng, words):
    return " ".join("".join(rng.choice("aeiounrstlk") for _ in range(rng.randint(2, 8))) for _ in range(words))


def edited(rng, text, edits):
    letters = list(text)
    for _ in range(edits):
        at = rng.randrange(len(letters))
        letters[at:at + rng.randint(0, 1)] = rng.choice(["", "x", "yz"[0]])
    return "".join(letters)


@pytest.mark.parametrize("seed", range(3))
def test_windows_equal_full_alignment(seed):
    rng = random.Random(seed)
    items = [(i, prose(rng, rng.choice((8, 20, 40)))) for i in range(12)]
    index = qf.Index(items)
    texts = []
    for i in range(30):
        item = rng.choice(items)[1]
        at = rng.randrange(max(1, len(item) - 80))
        texts.append(prose(rng, 12) + " " + edited(rng, item[at:at + rng.choice((60, 100, 400))], rng.choice((0, 2, 5, 9))) + " " + prose(rng, 9))
    for text, found in zip(texts, index.search(texts)):
        codes = qf.folded(text)[0].tolist()
        want = {index.item[w] for w in range(len(index.window))
                if best_occurrence(index.window[w].tolist(), codes) <= index.edits[w]}
        assert {m[0] for m in found} == want
    assert any(index.search(texts))


def test_gram_hashes_depend_on_the_gram_alone():
    codes = qf.folded("the cat sat on the cat sat")[0]
    hashes = qf.grams(codes, 11)
    same = [(i, j) for i in range(len(hashes)) for j in range(i) if hashes[i] == hashes[j]]
    assert same == [(i, j) for i in range(len(hashes)) for j in range(i) if (codes[i:i + 11] == codes[j:j + 11]).all()]
    assert len(qf.grams(codes[:5], 11)) == 0


def test_rows(spark, monkeypatch):
    rng = random.Random(9)
    item, other = prose(rng, 40), prose(rng, 40)
    far = prose(rng, 300_000)
    rows = [(1, "Before: " + item.upper().replace(" ", ",\n") + " after", "x"), (2, prose(rng, 50), "x"), (3, None, "x"), (4, "", None),
            (None, item[40:240], "x"), (5, far[:900_000] + " " + other + " " + far[900_000:], "x"), (1, "Before: " + item.upper() + " after", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_ids string")
    bench = spark.createDataFrame([(7, item), (8, other), (9, None), (10, ""), (11, "of the"), (12, item)], "item_id long, text string")
    want = [(1, [7, 12]), (2, []), (3, []), (4, []), (None, [7, 12]), (5, [8]), (1, [7, 12])]
    for block in (1 << 20, 150):
        monkeypatch.setattr(qf, "INDEX_CHARS", block)
        found = qf.contaminated(docs, bench)
        assert found.columns == ["doc_id", "text", "matches", "contaminated", "item_ids"]
        got = found.collect()
        assert sorted(((r.doc_id, r.item_ids) for r in got), key=str) == sorted(want, key=str)
    span = [r for r in got if r.doc_id == 5][0].matches[0]
    assert abs(span.begin - 900_001) < 8 and len(other) // 4 < span.end - span.begin
    kept = qf.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4]
    assert qf.clean(docs.limit(0), bench).count() == 0 and qf.clean(docs, bench.limit(0)).count() == 7
