"""Time joins against brute force, over cells of any size, with ties, gaps and NULLs."""

import datetime as dt
import random

import pytest

from pelagia.operators import joins

T0 = dt.datetime(2024, 3, 1)


@pytest.mark.parametrize("cell_s", [7, 100_000])
def test_as_of_against_brute_force(spark, cell_s):
    random.seed(cell_s)
    at = lambda s: None if s is None else T0 + dt.timedelta(seconds=s)
    have = [(random.choice("ab"), random.randrange(0, 400) if random.random() < 0.5 else random.randrange(2000, 2100), k) for k in range(150)] + [("a", None, 900), (None, 5, 901), ("a", 50, 902), ("a", 50, 903)]
    want = [(random.choice("abc"), random.randrange(-50, 2300), k) for k in range(200)] + [(None, 5, 500), ("a", None, 501), ("a", 50, 502)]
    left = spark.createDataFrame([(i, at(s), k) for i, s, k in want], "ID string, datetime timestamp, q int")
    right = spark.createDataFrame([(i, at(s), v) for i, s, v in have], "ID string, datetime timestamp, v int")
    for direction, limit in (("nearest", None), ("backward", None), ("nearest", 20)):
        got = {r.q: r.v for r in joins.as_of(left, right, ["v"], direction, None if limit is None else limit * 1_000_000, cell_us=cell_s * 1_000_000).collect()}
        truth = {}
        for i, s, q in want:
            near = [(abs(t - s), t, -v, v) for j, t, v in have if i is not None and s is not None and j == i and t is not None and (direction == "nearest" or t <= s) and (limit is None or abs(t - s) <= limit)]
            truth[q] = min(near)[3] if near else None
        assert got == truth
    assert joins.as_of(left.where("false"), right, ["v"]).count() == 0 and joins.as_of(left, right.where("false"), ["v"]).where("v is not null").count() == 0
