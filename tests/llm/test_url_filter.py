import math
import re

import pytest
from pyspark.sql import functions as F

from endpointlens.llm import url_filter as uf
from endpointlens.llm.queries import RULES

SF = "/root/testdata/sf0.01"


def expected(url):
    """(host, path, rule, verdict of the rule) by the definition."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.text), default=None)
    return host, path, best and best.text, best and best.verdict


ODD = ["http://a.COM/x", "http://example.com/en/1", "http://www.example.com/en/1", "https://x.www.example.com/en/", "http://notexample.com/en/",
       "http://b.net/es/?q#f", "http://b.net/fr", "b.net/fr/", "http://com/", "http://com", "://", "x://y?://z/fr/", None, "", "http://ÄB.net/es/ü",
       "http://user@h.net:80/fr/a\nb", "http://b.org/" + "a/" * 50_000, "http://b.net/fr/x://y.com/"]


def test_hosts_paths_and_rules(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(ODD * 2)] + [(None, ODD[0], "x")], "page_id long, url string, verdict string")
    got = uf.judge(pages, RULES).collect()
    assert len(got) == 2 * len(ODD) + 1
    for r in got:
        host, path, rule, verdict = expected(ODD[(r.page_id or 0) % len(ODD)])
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict in ("allow", "block") and verdict in (None, r.verdict)


def test_one_label_none_and_empty(spark):
    pages = spark.createDataFrame([(1, "http://b.net/fr/"), (2, "http://b.org/")], "page_id long, url string")
    assert {(r.page_id, r.verdict) for r in uf.judge(pages, RULES).collect()} == {(1, "block"), (2, "block")}
    assert [r.verdict for r in uf.judge(pages.where("page_id = 2"), RULES).collect()] == ["allow"]
    assert uf.judge(pages.limit(0), RULES).count() == 0


def test_entropy(spark):
    words = ["", "a", "abab", "http://x.y/ä?", "abcdefgh"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(uf.entropy(F.col("w")).alias("e")).collect()
    for w, r in zip(words, got):
        assert r.e == pytest.approx(-sum(w.count(c) / len(w) * math.log2(w.count(c) / len(w)) for c in set(w)))


def test_trees_learn_what_the_rules_say(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = uf.judge(pages, RULES)
    assert not re.search("Python|Pandas|Arrow", got._jdf.queryExecution().executedPlan().toString())
    ruled = [r for r in got.collect() if r.rule]
    assert sum((r.block_probability >= 0.5) == (r.verdict == "block") for r in ruled) > 0.8 * len(ruled)


@pytest.mark.parametrize("sample", [1, 40])
def test_a_rare_label_is_in_the_sample(spark, sample):
    """Three blocked urls among hundreds, a bound that may draw none of either: the trees are fitted all the same."""
    urls = [f"http://b{i}.net/fr/{i}" for i in range(3)] + [f"http://a{i}.com/page/{i}" for i in range(400)] + ["http://c.org/x", "http://c.net/fr"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.page_id: r.verdict for r in uf.judge(pages, RULES, sample=sample).collect()}
    assert len(got) == len(urls) and all(got[i] == "block" for i in range(3)) and all(got[i] == "allow" for i in range(3, 403))
