import hashlib
import random
import re

import pytest

from endpointlens.llm import pii

KINDS = ("email", "ip", "card", "phone")


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    """Base spans by the plain patterns."""
    out = []
    for kind, pattern, good in (
            ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
            ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
            ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
            ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15)):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text or "") if good(m.group())]
    return out


ODD = ["a@b.c_d@e.f x@y", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "256.1.1.1 0001.002.3.0 1.2.3.4 01.2.3", "4111 1111 1111 1111-4111", "4111-1111-1111-1111 5",
       "+1 (456) 555-2186 +12", "+1+123456789 +1234567890123456", "ä€😀 a.b+c@x-y.z.de. 😀 10.0.0.1", None, "", "@", "+", "...@-.-", "5 - 6 -7--8", "%@%.%",
       "😀" * 50 + "4111111111111111" + "é" * 9 + "+4912345678.", "0.0.0.0.0", "1" * 30_000, "a" * 30_000 + "@" + "b." * 9_000, "4111 1111  1111 1111"]


def noise(rng):
    return "".join(rng.choice(["1", "4", "25", "0", ".", ".", "@", "a", "b-", " ", "-", "+", "(", ")", "é", "\n", "_", "4111111111111111"]) for _ in range(rng.randint(5, 60)))


def test_base_spans_equal_the_plain_patterns(spark):
    rng = random.Random(2)
    texts = ODD + [noise(rng) for _ in range(1500)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, ODD[0], "x"), (0, ODD[0], "x")], "doc_id long, text string, base string")
    got = pii.digest(pii.find(docs)).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        want = brute(texts[r.doc_id or 0])
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(w[0] == k for w in want) for k in KINDS], texts[r.doc_id or 0]
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(filter(None, r.spans.split(",")))


def test_added_spans(spark):
    rng = random.Random(7)
    hexed = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    rows, want = [], {}
    for i in range(240):
        value = hexed(rng.choice((18, 40)))
        text = rng.choice((f'note token = "{value}" end', f"my password={value} here", "nothing of note in model2022 or version12345 here", "plain prose only"))
        rows.append((i, text))
        want[i] = [f"secret:{text.index(value)}:{text.index(value) + len(value)}"] if value in text else []
    got = {r.doc_id: r.spans for r in pii.digest(pii.find(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert got == {i: ",".join(w) for i, w in want.items()}


def test_estimates_recover_reliable_labelers():
    rng = random.Random(1)
    names = [x.name for x in pii.LABELERS]
    patterns = []
    for _ in range(3000):
        truth = 1 if rng.random() < 0.3 else -1
        votes = {n: truth if rng.random() < 0.9 - 0.08 * k else -truth for k, n in enumerate(names)}
        patterns.append((votes, 1))
    model = pii.estimate(patterns)
    assert model.share == pytest.approx(0.3, abs=0.03)
    assert model.given[names[0]][1][0] == pytest.approx(0.9, abs=0.05) and model.given[names[-1]][1][0] == pytest.approx(0.5, abs=0.06)


def test_empty_table_and_plan(spark):
    empty = pii.digest(pii.find(spark.createDataFrame([], "doc_id long, text string")))
    assert empty.count() == 0
    plan = pii.digest(pii.find(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
