import hashlib
import random
import re

import numpy as np
import pytest

from endpointlens.llm import recompression as rc


def words_of(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def brute(rows, q=50):
    """(id, words, removed words, digest, kept words) by comparing all windows."""
    rank = lambda i: (i is None, i or 0)
    least, out = {}, []
    for i, text in rows:
        words = words_of(text)
        for p in range(len(words) - q + 1):
            key = tuple(words[p:p + q])
            least[key] = min(rank(i), least.get(key, rank(i)))
    for i, text in rows:
        words = words_of(text)
        gone = {p + k for p in range(len(words) - q + 1) if least[tuple(words[p:p + q])] < rank(i) for k in range(q)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((repr(i), len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, id int, row int, body string")
    return sorted((repr(r[0]), *r[1:4]) for r in rc.repeats(df).collect())


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["ä€", "x y", "ab ab ab ab".replace(" ", "\t")]
    prose = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passages = [prose(k) for k in (49, 50, 51, 60, 80, 200, 1)] + [["run"] * 70, ["a", "b"] * 60, ["a", "b", "c"] * 30]
    rows = []
    for i in range(n):
        words = prose(rng.randint(0, 120))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, len(words))
            piece = rng.choice(passages)
            words[at:at] = piece if rng.random() < 0.7 else piece[rng.randint(0, 5):]
        rows.append((rng.randint(0, 3 * n), rng.choice([" ", "\n", " \t"]).join(words)))
    rows += [(i + 500, t) for i, t in rng.sample(rows, 20)] + rng.sample(rows, 10)
    rows += [(1000, None), (1001, ""), (None, rows[3][1]), (None, " ".join(["run"] * 300)), (-5, " ".join(["run"] * 55)), (1002, " \n\t")]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_all_windows(spark, seed):
    rows = corpus(seed)
    assert found(spark, rows) == brute(rows)


def test_one_text_in_many_rows_and_a_long_one(spark):
    rng = random.Random(9)
    long = " ".join(rng.choice("abcdefgh") + str(rng.randint(0, 99)) for _ in range(30_000))
    rows = [(i, " ".join(long.split()[100:300])) for i in range(1, 200)] + [(0, long), (999, long[7:])]
    got = {r[0]: r for r in found(spark, rows)}
    assert got["0"][2] == 0 and got["999"][2] == got["999"][1]
    assert all(got[str(i)][1:3] == (200, 200) for i in range(1, 200))


def test_without_repeats(spark):
    rows = corpus(4, 40)
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, repeat_row int")
    got = sorted((repr(r.doc_id), hashlib.sha256(" ".join(words_of(r.text)).encode()).hexdigest(), r.repeat_row)
                 for r in rc.without_repeats(df).collect())
    assert got == sorted((i, digest, 5) for i, _, _, digest in brute(rows))


def test_empty(spark):
    assert found(spark, []) == []


def test_copies_agree_on_symbols_inside():
    """A passage has the same symbols at the same places in any context that holds what they looked at."""
    rng = random.Random(0)
    word = lambda: b"w%d" % rng.randint(0, 3000)
    passage = [word() for _ in range(120)]
    ahead = [[word() for _ in range(k)] for k in (0, 3, 40)]
    words = rc.Words([b" ".join(a + passage + [word()] * 2) for a in ahead])
    name, low, high = rc.rewritten(words)
    seen = []
    for first, a in zip(words.first, ahead):
        begin = first + len(a)
        inside = (low >= begin) & (high <= begin + 120)
        seen.append({(n, x - begin, y - begin) for n, x, y in zip(name[inside], low[inside], high[inside])})
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 5


def test_most_windows_hold_a_symbol():
    rng = random.Random(0)
    words = rc.Words([b" ".join(b"w%d" % rng.randint(0, 3000) for _ in range(5000))])
    _, low, high = rc.rewritten(words)
    free = [p for p in range(1, 4952) if not ((low >= p) & (high <= p + 50)).any()]
    assert len(free) < 0.05 * 4951
    assert np.median(high - low) < 40
