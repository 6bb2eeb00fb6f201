from tidemark.operators.ordered import before


def test_sums_before_each_row_are_those_of_the_sorted_list(spark):
    rows = [(i * 37 % 101, ["a", "b", None][i % 3], float(i)) for i in range(101)]
    got = {r["k"]: r["before"] for r in before(spark.createDataFrame(rows, "k int, g string, v double").repartition(5), ["k"], "v", ["g"]).collect()}
    for k, g, _ in rows:
        assert got[k] == sum(v for kk, gg, v in rows if gg == g and kk < k)
    n = {r["k"]: r["before"] for r in before(spark.createDataFrame(rows, "k int, g string, v double"), ["k"]).collect()}
    assert n == {k: k for k, *_ in rows}
    assert before(spark.createDataFrame([], "k int"), ["k"]).count() == 0
