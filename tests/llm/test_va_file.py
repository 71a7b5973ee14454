import random

import pytest
from pyspark.sql import functions as F

from endpointlens.llm import va_file
from endpointlens.llm.queries import scaled


def brute(rows, k):
    got = set()
    rows = {(i, tuple(v)) for i, v in rows if i is not None and v is not None}
    for q, a in rows:
        if q % 5 == 0:
            every = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:k]
            got |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(every)}
    return got


@pytest.mark.parametrize("bits,block", [(1, 16384), (3, 40), (5, 7)])
def test_equals_brute_force(spark, bits, block):
    rng = random.Random(bits)
    rows = [(i, [rng.randint(-60, 60) for _ in range(rng.choice((6, 6, 4)))]) for i in range(150)]
    rows += [(200 + i, [5, 5, 5, 5, 5, 5]) for i in range(60)] + [(7, rows[7][1]), (400, []), (None, [1] * 6), (401, None)]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, vector array<long>, score int")
    found = va_file.top_k(df, F.expr("vec_id % 5 = 0"), k=4, bits=bits, block=block, query_block=20)
    assert {tuple(r) for r in found.collect()} == brute(rows, 4)


def test_few_rows_and_empty(spark):
    df = spark.createDataFrame([(0, [1.5]), (1, [-2.0]), (2, [float("nan")]), (3, [None]), (4, [float("inf")]), (5, None)],
                               "vec_id long, embedding array<float>")
    found = va_file.top_k(scaled(df), F.expr("vec_id % 20 = 0"))
    assert [tuple(r) for r in found.collect()] == [(0, 1, 1, -12288)]
    assert va_file.top_k(scaled(df.limit(0)), F.expr("vec_id % 20 = 0")).count() == 0
