from tidemark.operators import dedup


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_one_row_per_identifier_first_to_arrive(spark):
    df = spark.createDataFrame([("a", 3, "x"), (" A\t", 1, "y"), ("b", 2, "z"), (None, 4, "n"), ("", 5, "e")], "k string, t int, v string")
    assert rows(dedup.keep_first(df, "k", ["t"])) == rows(spark.createDataFrame([(" A\t", 1, "y"), ("b", 2, "z"), (None, 4, "n"), ("", 5, "e")], df.schema))


def test_ties_take_the_same_row_however_they_are_partitioned(spark):
    data = [("a", 1, f"v{i}") for i in range(40)]
    one = rows(dedup.keep_first(spark.createDataFrame(data, "k string, t int, v string").repartition(1), "k", ["t"]))
    many = rows(dedup.keep_first(spark.createDataFrame(data[::-1], "k string, t int, v string").repartition(7), "k", ["t"]))
    assert one == many and len(one) == 1


def test_rows_equal_in_all_columns_leave_one_and_null_arrival_comes_last(spark):
    df = spark.createDataFrame([("a", None, "late"), ("a", 9, "first"), ("a", 9, "first")], "k string, t int, v string")
    assert rows(dedup.keep_first(df, "k", ["t"])) == [("a", 9, "first")]


def test_any_column_names_and_empty_tables(spark):
    df = spark.createDataFrame([("a", 1, 2, [1.5])], "`k.x` string, `r__` int, `k__` int, `o__` array<double>")
    assert dedup.keep_first(df, "k.x", ["r__"]).columns == df.columns
    assert rows(dedup.keep_first(df, "k.x", ["r__"])) == rows(df)
    assert dedup.keep_first(df.limit(0), "k.x", ["r__"]).count() == 0


def test_repeated_is_what_keep_first_drops(spark):
    data = [(i, None if i % 17 == 0 else f"id{i % 9}" if i % 3 else "HOT ") for i in range(200)]
    df = spark.createDataFrame(data, "d long, k string")
    kept = {r[0] for r in dedup.keep_first(df, "k", ["d"]).select("d").collect()}
    gone = {r[0] for r in dedup.repeated(df, "k", "d").collect()}
    assert kept | gone == {i for i, _ in data} and not kept & gone


def test_new_messages_against_the_store(spark):
    stored = spark.createDataFrame([("A", 1), (None, 2)], "k string, t int")
    batch = spark.createDataFrame([("a ", 5), ("b", 6), ("b", 7), (None, 8)], "k string, t int")
    assert rows(dedup.new_messages(batch, stored, "k", ["t"])) == rows(spark.createDataFrame([("b", 6), (None, 8)], batch.schema))
    assert dedup.new_messages(batch, stored.limit(0), "k", ["t"]).count() == 3
