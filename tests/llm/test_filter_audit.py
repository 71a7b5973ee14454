import re
from itertools import permutations

import pytest

from endpointlens.llm import filter_audit

DOCS = "doc_id long, text string, lang string, part int, mask int, n int"
LABELS = "doc_id long, quality int, toxic int, n int"


def failing(rows):
    """(part, set of failed letters, id) of every row, by the definition."""
    out = []
    for i, text, lang in rows:
        text = text or ""
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
        bad = set()
        if len(words) < 200:
            bad.add("A")
        if 100 * len(set(words)) < 50 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 3 * len(text):
            bad.add("C")
        if re.search(r"[#$%&*|]", text):
            bad.add("D")
        if i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows):
            bad.add("E")
        out.append((lang or "", bad, i))
    return out


def brute(rows, labels):
    found, cells = failing(rows), {}
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    for part in {p for p, _, _ in found}:
        for order in permutations("ABCDE"):
            left = [(b, i) for p, b, i in found if p == part]
            for step, f in enumerate(order, 1):
                gone = [(b, i) for b, i in left if f in b]
                left = [(b, i) for b, i in left if f not in b]
                fails = sum(f in b for p, b, _ in found if p == part)
                cells[part, "".join(order), step] = [
                    len(left), len(gone), fails - len(gone), sum(b == {f} for p, b, _ in found if p == part),
                    sum(i in good for _, i in gone), sum(i in toxic for _, i in gone)]
    shapley = {}
    for (part, order, step), c in cells.items():
        shapley[part, order[step - 1]] = shapley.get((part, order[step - 1]), 0) + c[1]
    return {(*k, *c, shapley[k[0], k[1][k[2] - 1]]) for k, c in cells.items()}


def found(spark, rows, labels):
    docs = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], DOCS)
    out = filter_audit.audit(filter_audit.masks(docs, spark.createDataFrame([(*r, 9) for r in labels], LABELS)))
    return [tuple(r) for r in out.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails",
                                         "good_lost", "toxic_lost", "shapley").collect()]


def test_equals_brute_force(spark):
    prose = " ".join(f"word{i}" for i in range(220))
    rows = [(1, prose, "en"), (2, prose, "en"), (2, prose, "fr"), (3, prose + " $", "en"), (4, "SHOUT", "en"),
            (5, "a a a a a", None), (6, "", ""), (7, None, "fr"), (8, "a " * 250, "fr"), (9, "\t\n", "fr"),
            (10, "A " * 40_000, "fr"), (1, prose, "en"), (None, prose, "en"), (None, None, "de"), (11, "a\x0bb|é", "de"),
            (0, "late text #", "de"), (12, "late text #", "en"), (3, "SHOUT", "en"), (4, "SHOUT", "en")]
    labels = [(1, 1, 0), (2, 1, 1), (2, 0, None), (3, None, 1), (7, 1, 0), (None, 1, 1), (99, 1, 1), (10, 1, 1), (5, 0, 1)]
    got = found(spark, rows, labels)
    assert len(got) == len(set(got)) == 4 * 600
    assert set(got) == brute(rows, labels)


def test_one_text_in_many_rows(spark):
    rows = [(i, "same text", "en" if i % 3 else "fr") for i in range(300)]
    assert set(found(spark, rows, [(5, 1, 1)])) == brute(rows, [(5, 1, 1)])


def test_empty(spark):
    assert found(spark, [], []) == []


@pytest.mark.parametrize("letters", ["ABCDE", "XYZ"])
def test_intervals_cover_every_order_that_fails(letters):
    n = len(letters)
    for rank, order in enumerate(permutations(range(n))):
        for mask in range(1 << n):
            steps = [s for m, s, lo, hi in filter_audit.intervals(letters) if m == mask and lo <= rank < hi]
            assert steps == ([next(s for s, at in enumerate(order, 1) if mask >> at & 1)] if mask else [])
