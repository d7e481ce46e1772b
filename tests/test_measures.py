import itertools
import math

import pytest
from pyspark.sql import functions as F

from kgspark.quality import distribution


@pytest.mark.parametrize(("n1", "n2"), [(1, 1), (2, 3), (4, 4), (3, 6), (5, 5)])
def test_exact_share_counts_all_orders(n1, n2):
    """Every order of the two samples, looked at one by one."""
    widest = []
    for firsts in itertools.combinations(range(n1 + n2), n1):
        a = b = worst = 0
        for place in range(n1 + n2):
            a, b = (a + 1, b) if place in firsts else (a, b + 1)
            worst = max(worst, abs(a * n2 - b * n1))
        widest.append(worst)
    for reach in range(1, n1 * n2 + 1):
        assert distribution._inside_share(reach, n1, n2) == pytest.approx(sum(w < reach for w in widest) / len(widest))


def test_exact_p_values_meet_the_series_and_handle_odd_rows(spark):
    rows = [(0.05, 2000, 1800), (0.2, 300, 40), (1.0, 5, 7), (0.0, 5, 7), (None, 5, 7), (0.5, 0, 7), (0.5, None, 7), (0.01, 20_000, 20_000)]
    df = spark.createDataFrame(rows, "ks double, n1 long, n2 long")
    exact = distribution.ks_pvalue_exact(F.col("ks"), F.col("n1"), F.col("n2"))
    got = [tuple(r) for r in df.select(exact.alias("p"), distribution.ks_pvalue(F.col("ks"), F.col("n1").cast("double"), F.nullif(F.col("n2"), F.lit(0))).alias("s")).collect()]
    assert got[0][0] == pytest.approx(got[0][1], abs=0.01)
    assert got[2][0] == pytest.approx(2 / math.comb(12, 5))
    assert got[3][0] == 1.0
    assert [p for p, _ in got[4:7]] == [None] * 3
    assert got[7][0] == got[7][1]
