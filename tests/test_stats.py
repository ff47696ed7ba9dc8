"""Exact ranks found in rounds."""

import math
import random
import statistics

import pytest

from quern.operators import stats


def nearest(values, p):
    return sorted(values)[max(0, math.ceil(p * len(values) / 100) - 1)]


@pytest.mark.parametrize("values", [[], [7], [1, 2, 3, 4], list(range(1, 11)), [5] * 50 + [6], [-(2**63), 2**63 - 1, 0, 1], [r * r * (-1) ** r for r in range(500)]])
def test_small(spark, values):
    d = spark.createDataFrame([(v,) for v in [*values, None]], "v long")
    got = stats.distribution(d, "v").first()
    if not values:
        assert tuple(got) == (0, 0, 0, 0, 0.0, 0.0, 0, 0, 0, 0, 0)
        assert tuple(stats.floor_rank(d, "v").first()) == (None,) * 6
        return
    if abs(sum(values)) < 2**62:
        assert got["total"] == sum(values) and got["mean"] == round(sum(values) / len(values), 6)
    assert (got["count"], got["min"], got["max"], got["median"]) == (len(values), min(values), max(values), statistics.median(values))
    assert [got[f"p{p}"] for p in stats.PERCENTILES] == [nearest(values, p) for p in stats.PERCENTILES]
    floor = stats.floor_rank(d, "v", (0.0, 0.5, 0.9, 1.0)).first()
    assert [floor[f"p{k}"] for k in (0, 50, 90, 100)] == [sorted(values)[int((len(values) - 1) * p)] for p in (0.0, 0.5, 0.9, 1.0)]


def test_a_million_distinct_values(spark):
    """In seconds, and no task reads more than its share: a histogram of ranges is all that comes together."""
    d = spark.range(1_000_000, numPartitions=8).selectExpr("(id * 7919) % 1000003 * 1000 + id % 7 AS v")
    values = sorted((k * 7919) % 1000003 * 1000 + k % 7 for k in range(1_000_000))
    got = stats.distribution(d, "v").first()
    assert [got[f"p{p}"] for p in stats.PERCENTILES] == [values[math.ceil(p * 10_000) - 1] for p in stats.PERCENTILES]
    assert got["median"] == (values[499_999] + values[500_000]) / 2 and got["total"] == sum(values)
    floor = stats.floor_rank(d, "v").first()
    assert [floor[f"p{k}"] for k in (50, 90, 99)] == [values[int(999_999 * p)] for p in (0.5, 0.9, 0.99)]


def test_random_ranks(spark):
    r = random.Random(4)
    values = [r.choice([r.randrange(-50, 50), r.randrange(-(10**15), 10**15)]) for _ in range(3000)]
    hist = spark.createDataFrame([(v, values.count(v)) for v in set(values)], "v long, c long")
    ranks = [0, 2999, *(r.randrange(3000) for _ in range(12))]
    assert stats.values_at(hist, ranks, min(values), max(values)) == {k: sorted(values)[k] for k in ranks}
