"""Deliveries of one transaction are assembled before keys are replayed; marks close the gaps of a log read whole."""

from quillfind.operators import changefeed

SCHEMA = "origin string, epoch long, seq long, key string, tombstone boolean, record string"


def test_deliveries_of_one_transaction_are_one(spark):
    rows = [("o", 1, 1, "k", False, "a"), ("o", 1, 1, "k", False, "b"), ("o", 1, 1, "l", False, "c"), ("o", 1, 2, "k", None, '{"record":"source"}'), ("o", 1, 2, "k", None, '{"record":"source_gone"}'), ("o", 2, 1, "k", True, None), (" ", 1, 1, "k", False, "a")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(tuple(r) for r in changefeed.assembled(df, payload=True).collect())
    assert got == [("o", 1, 1, "k", False, "b"), ("o", 1, 1, "l", False, "c"), ("o", 1, 2, "k", True, '{"record":"source"}'), ("o", 2, 1, "k", True, None)]
    plan = changefeed.current_state(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate") == 2  # transactions, then keys


def test_a_log_read_whole_goes_by_its_marks(spark):
    log = spark.createDataFrame([("o", 1, s, f"k{s}", False, None) for s in (2, 3, 9)] + [("p", 3, 1, "k", False, None)], SCHEMA)
    marked = changefeed.watermarks(log, complete="read")
    assert {tuple(r) for r in marked.collect()} == {("o", 1, 9, 9), ("p", 3, 1, 1)}
    # found from the marks by the search for gaps, not put in place of it
    assert "upto" in marked._jdf.queryExecution().optimizedPlan().toString() and "collect_list" in marked._jdf.queryExecution().optimizedPlan().toString()
