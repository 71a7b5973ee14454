import random

import numpy as np
import pytest

from endpointlens.llm import simhash_vptree as vp


def brute(prints, radius):
    """Smallest row of every component, by comparing all pairs."""
    root = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if ((a ^ prints[j]) & (2**64 - 1)).bit_count() <= radius and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return root


def text(rng, words):
    return " ".join(rng.choice("alpha beta gamma delta kilo lima oscar papa tango".split()) for _ in range(words))


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    rows = [(i, text(rng, rng.randint(1, 60)), i) for i in range(220)]
    rows += [(300 + i, rows[i % 20][1] + " " + rng.choice("xyz"), 0) for i in range(80)]
    rows += [(400, None, 1), (401, "", 1), (402, " \t", 1), (None, rows[5][1], 1), (7, rows[7][1], 7),
             (403, "word " * 150_000, 2)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, component_id long")


@pytest.mark.parametrize("tuning", [{}, {"shard": 8, "own_block": 5, "visit_block": 11}])
def test_components_equal_brute_force(corpus, tuning):
    rows, docs = corpus
    prints = [vp.fingerprint(t and t.encode()) for _, t, _ in rows]
    lowest = {}
    for (doc, _, _), root in zip(rows, brute(prints, 6)):
        if doc is not None:
            lowest[root] = min(doc, lowest.get(root, doc))
    want = sorted(((d, p, lowest.get(r)) for (d, _, _), p, r in zip(rows, prints, brute(prints, 6))), key=str)
    got = [tuple(r) for r in vp.near_duplicates(docs, radius=6, **tuning).collect()]
    assert sorted(got, key=str) == want
    assert len({c for _, _, c in want}) < len(rows) - 50


def test_empty_table(spark):
    assert vp.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_fingerprint_by_definition(spark):
    value = "The THE ä\tÄ the x\x0bend"
    words = ["the", "the", "ä", "Ä", "the x", "end"]
    shingles = [" ".join(words[i:i + 3]) for i in range(4)]
    hashes = [r.h for r in spark.createDataFrame([(s,) for s in shingles], "s string").selectExpr("xxhash64(s) AS h").collect()]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    assert vp.fingerprint(value.encode()) & (2**64 - 1) == bits


def test_every_near_pair_shares_a_shard():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 300, dtype=np.uint64)
    prints = np.concatenate((base, base ^ np.uint64(1 << 40), base ^ np.uint64(3 << 9)))
    shard, at, own = vp.route(vp.fit_tree(prints, 16), prints, 2)
    assert len(np.unique(at[own])) == len(prints) == own.sum()
    homes = dict(zip(at[own].tolist(), shard[own].tolist()))
    seen = set(zip(at.tolist(), shard.tolist()))
    near = [(i, j) for i in range(900) for j in range(i) if int(prints[i] ^ prints[j]).bit_count() <= 2]
    assert near and all((i, homes[j]) in seen or (j, homes[i]) in seen for i, j in near)


def shingles(value):
    words = (value or "").lower().split()
    width = min(5, len(words)) or 1
    return {tuple(words[i:i + width]) for i in range(len(words) - width + 1)}


def test_one_of_each_group(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [[word() for _ in range(rng.randint(500, 700))] for _ in range(30)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)]
    for n, b in enumerate(base[:20]):
        for k in range(3):
            changed = list(b)
            for _ in range(k):
                changed[rng.randrange(len(changed))] = word()
            rows.append((100 + 3 * n + k, " ".join(changed)))
    rows += [(500, None), (501, ""), (None, "a text of its own"), (None, " ".join(base[3])), rows[2], rows[25]]
    docs = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, key string, root int")
    for tuning in ({}, {"shard": 12, "own_block": 9, "visit_block": 20}):
        kept = vp.one_of_each(docs, **tuning)
        assert kept.columns == docs.columns
        assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i in [*range(30), 500, None])
    assert vp.one_of_each(docs.limit(0)).count() == 0


def test_unlike_texts_stay(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base = [word() for _ in range(200)]
    rows = [(0, " ".join(base))]
    for i in range(1, 40):
        changed = list(base)
        for at in rng.sample(range(200), rng.choice((1, 3, 12, 30))):
            changed[at] = word()
        rows.append((i, " ".join(changed)))
    kept = {r.doc_id for r in vp.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [shingles(t) for _, t in rows]
    alike = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    # Whoever went has a similar text; whoever is like nothing else stayed.
    assert all(any(alike(i, j) for j in range(40) if j != i) for i in range(40) if i not in kept)
    assert {i for i in range(40) if not any(alike(i, j) for j in range(40) if j != i)} <= kept


def family(rng, base, most):
    """Texts that differ from one base in up to `most` words each, unlike sizes included."""
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = []
    for i in range(60):
        changed = list(base)
        for at in rng.sample(range(len(base)), rng.randint(0, most)):
            changed[at] = word()
        rows.append((i, " ".join(changed)))
    return rows


def firsts(rows, similarity=0.8):
    """Smallest id of every group, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if len(a & sets[j]) >= similarity * len(a | sets[j]) and root[i] != root[j]:
                low, high = sorted((root[i], root[j]))
                root = [low if r == high else r for r in root]
    return {rows[r][0] for r in root}


def test_links_that_fail_hide_no_others(spark):
    """Among texts of one template most near fingerprints fail the check; the true links between them must survive."""
    rng = random.Random(12)
    rows = family(rng, ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(300)], 9)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in vp.one_of_each(docs).collect()} == firsts(rows)
    assert 1 < len(firsts(rows)) < 60


def test_near_fingerprints_are_checked(spark, monkeypatch):
    """However near the fingerprints, even equal ones: texts below the similarity stay, those at it go."""
    rng = random.Random(21)
    rows = family(rng, ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(120)], 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(vp, "SURE", 24)
    assert {r.doc_id for r in vp.one_of_each(docs).collect()} == firsts(rows)
    monkeypatch.setattr(vp, "majority", lambda hashes: 5)
    assert {r.doc_id for r in vp.one_of_each(docs).collect()} == firsts(rows)


def test_bins_lose_no_similar_pair(spark, monkeypatch):
    """Counts by bins drop unlike pairs before their shingles are moved, and no similar one; pairs are compared in several jobs."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    rows = [(i, t) for t, i in {t: i for i, t in family(rng, [word() for _ in range(200)], 8)}.items()]
    rows += [(100 + i, " ".join(word() for _ in range(200))) for i in range(20)] + [(200 + i, "word " * 3 + " ".join(str(n) for n in range(90000 + i))) for i in range(2)]
    docs = spark.createDataFrame(rows, "id long, text string")
    signed = vp.signatures(docs.selectExpr("id AS key", "id", "text")).cache()
    ids = {r.body: r.id for r in signed.select("body", "id").collect()}
    keyed = signed.select("body", "key", "size", "bins")
    pairs = vp.store(signed.selectExpr("body AS a").crossJoin(signed.selectExpr("body AS b")).where("a < b"))
    sets = {i: shingles(t) for i, t in rows}
    similar = lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
    true = {frozenset((i, j)) for i in sets for j in sets if i < j and similar(i, j)}
    likely = {frozenset((ids[r.a], ids[r.b])) for r in vp.conceivable(pairs, keyed).collect()}
    assert true <= likely and not any(100 <= i < 200 for p in likely for i in p)
    monkeypatch.setattr(vp, "PAIRS", 1)
    got = [frozenset((ids[r.a], ids[r.b])) for r in vp.alike(pairs, keyed, docs.selectExpr("id AS key", "text")).collect()]
    assert set(got) == true and len(got) == len(true)
