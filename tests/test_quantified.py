from loomgraph.operators import quantified


def test_pairs_below_makes_no_pair(spark):
    """Pairs of smaller and larger values are counted as a join would, whose product is never made."""
    nan = float("nan")
    left = spark.createDataFrame([(g % 3 if g else None, v) for g in range(9) for v in (1.0, 2.5, -0.0, None, nan, float(g), -3.0)] + [(8, 9.0), (9, 1.0)], "k int, v double")
    right = spark.createDataFrame([(g % 3 if g else None, v) for g in range(7) for v in (1.0, 0.0, 2.5, None, nan, 7.0, -float("inf"))] + [(8, 1.0)], "k int, v double")
    got = {tuple(r) for r in quantified.pairs_below(left, right, "k", "v").collect()}
    want = left.alias("a").join(right.alias("b"), "k").where("b.v > a.v").groupBy("k").count()
    assert got and got == {tuple(r) for r in want.collect()}
    big = spark.range(200_000).selectExpr("1 as k", "cast(id as double) as v")
    assert [tuple(r) for r in quantified.pairs_below(big, big, "k", "v").collect()] == [(1, 200_000 * 199_999 // 2)]
