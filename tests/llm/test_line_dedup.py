import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from endpointlens.llm import line_dedup as ld


def normal(line):
    return re.sub(r"[\W_]+", " ", line.lower()).strip()


def simhash(line):
    words = [w for w in line.split(" ") if len(w.encode()) >= 5] or line.split(" ")
    hashes = [xxhash.xxh64_intdigest(w.encode(), 42) for w in words]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(last + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def brute(rows):
    """Rows with the lines that stay, by comparing all pairs of lines."""
    key = lambda i, t: (i is None, i or 0, t)
    lines = sorted({normal(x) for _, t in rows if t is not None for x in t.split("\n")} - {""})
    root = {x: x for x in lines}
    prints = {x: simhash(x) for x in lines}
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if (prints[a] ^ prints[b]).bit_count() <= 3 and edits(a, b) <= int(0.2 * max(len(a), len(b)) + 1e-9) and root[a] != root[b]:
                old = root[a]
                root = {x: root[b] if r == old else r for x, r in root.items()}
    first = {}
    for i, t in rows:
        for n, x in enumerate((t or "").split("\n")):
            if t is not None and normal(x):
                first.setdefault(root[normal(x)], []).append((*key(i, t), n))
    keep = {r: min(v) for r, v in first.items()}
    return [(i, t if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if not normal(x) or keep[root[normal(x)]] == (*key(i, t), n)))
            for i, t in rows]


def sentence(rng, n):
    return " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.choice((2, 3, 6, 7, 8)))) for _ in range(n))


@pytest.mark.parametrize("blocks", [(4, 5, 6, 7), (5,), (6,)])
def test_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(ld, "BLOCKS", blocks)
    monkeypatch.setattr(ld, "CROWDED", 2 if len(blocks) > 1 else 1024)
    rng = random.Random(3)
    base = [sentence(rng, rng.randint(1, 30)) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(base)
            if rng.random() < 0.5:
                words = line.split(" ")
                words[rng.randrange(len(words))] = rng.choice(("it", "of", "zz", "longer"))
                line = " ".join(words)
            lines.append(rng.choice((line, line.upper() + "!", "", " -- ", sentence(rng, 9))))
        rows.append((i, "\n".join(lines)))
    rows += [(50, None), (51, ""), (None, base[0] + "\n" + sentence(rng, 5)), rows[4], (52, sentence(rng, 300) + "\n" + sentence(rng, 90))]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, doc string, pos int")
    found = ld.without_repeated_lines(docs)
    assert found.columns == docs.columns
    got, want = [(r.doc_id, r.text) for r in found.collect()], brute(rows)
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sum(len(t or "") for _, t in got) < 0.95 * sum(len(t or "") for _, t in rows)


def test_prints_and_long_lines(spark):
    rng = random.Random(5)
    texts = [sentence(rng, n) for n in (1, 2, 62, 63, 64, 65, 200, 3000)] + ["word " * 100_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("doc", F.xxhash64("doc_id"))
    got = {r.doc_id: r.print & (2**64 - 1) for r in ld.occurrences(docs).collect()}
    assert got == {i: simhash(normal(t)) for i, t in enumerate(texts)}


def test_ids_do_not_decide_equality_of_texts(spark):
    rows = [(1, "alpha line here\nbeta line there"), (1, "gamma line here\nalpha line here"), (1, "alpha line here\nbeta line there")]
    got = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc.doc_id, r.lines, r.removed) for r in got) == [(1, 2, 0), (1, 2, 0), (1, 2, 1)] or \
        sorted((r.removed) for r in got) == [0, 1, 1]


def test_empty_table(spark):
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = ld.dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_words_in_place_of_characters(spark):
    """What an alignment of words accepts is within the edits by characters, and few changed words are accepted."""
    rng = random.Random(8)
    rows = []
    for _ in range(150):
        a = sentence(rng, rng.randint(1, 25)).split(" ")
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            i = rng.randrange(len(b) + 1)
            b[i:i + rng.randint(0, 2)] = sentence(rng, rng.randint(1, 2)).split(" ")[:rng.randint(0, 2)]
        rows.append((a, b, rng.randint(0, 40)))
    rows += [([], ["it", "it"], 5), (["it"], [], 3), ([], [], 0)]
    far = [f"word{i}" for i in range(400)]
    rows += [(far, ["begin", *far[:200], *far[202:], "end"], 40), (far, far[::-1], 40)]
    pairs = spark.createDataFrame(rows, "a array<string>, b array<string>, most int")
    found = pairs.select("a", "b", "most", ld.few_words_apart(F.col("a"), F.col("b"), F.col("most")).alias("near")).collect()
    assert all(edits(" ".join(r.a), " ".join(r.b)) <= r.most for r in found if r.near)
    assert [r.near for r in found[-5:]] == [False, True, True, True, False]
    assert 20 < sum(r.near for r in found) < 150


def test_words_are_summed_where_the_text_lies(spark):
    docs = spark.createDataFrame([(1, 7, "some words here\n\nmore")], "doc long, doc_id long, text string")
    plan = ld.occurrences(docs)._jdf.queryExecution().executedPlan().toString()
    assert "sum(" in plan and plan.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
