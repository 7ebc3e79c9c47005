"""Replay of the change log against a brute-force replay."""

import random

from quillfind.operators import changefeed

SCHEMA = "origin string, epoch long, seq long, key string, tombstone boolean, record string"


def brute(rows):
    good = [r for r in rows if r[0] and r[0].strip() and r[3] and r[3].strip() and (r[1] or 0) > 0 and (r[2] or 0) > 0]
    newest, state = {}, {}
    for o, e, *_ in good:
        newest[o] = max(e, newest.get(o, 0))
    for o, e, s, k, t, rec in good:
        if e == newest[o]:
            gone = t if t is not None else any(f'"{w}"' in (rec or "") for w in changefeed.WITHDRAWING)
            state.setdefault((o, k), []).append((s, gone))
    return {(o, newest[o], max(v)[0], k) for (o, k), v in state.items() if not max(v)[1]}


def feed(n, seed):
    rng = random.Random(seed)
    kinds = ['{"record":"source"}', '{ "record" : "source_gone" }', None, "no json"]
    rows = []
    for _ in range(n):
        o = "hot" if rng.random() < 0.4 else rng.choice(["a", "b", None, " ", ""])
        rows.append((o, rng.choice([1, 2, 2, None, -1]), rng.choice([*range(1, 30), 0, None]), rng.choice(["k1", "k2", "k3", None, "\t"]), rng.choice([True, False, False, None]), rng.choice(kinds)))
    rows += rng.choices(rows, k=n // 4)
    # one sequence says one thing, as in a log; repeats may write the record differently
    seen = {}
    return [seen.setdefault(r[:4], r) for r in rows]


def found(df):
    return {tuple(r) for r in df.collect()}


def test_state_equals_brute_force(spark):
    for seed in range(3):
        rows = feed(400, seed)
        df = spark.createDataFrame(rows, SCHEMA).repartition(5)
        assert found(changefeed.current_state(df)) == brute(rows)


def test_order_and_repeats_make_no_difference(spark):
    rows = feed(200, 9)
    again = rows + rows[::2]
    random.Random(1).shuffle(again)
    assert found(changefeed.current_state(spark.createDataFrame(again, SCHEMA))) == brute(rows)


def test_empty_and_refused(spark):
    assert changefeed.current_state(spark.createDataFrame([], SCHEMA)).count() == 0
    assert changefeed.watermarks(spark.createDataFrame([], SCHEMA)).count() == 0
    only_bad = [(None, 1, 1, "k", False, None), ("o", 0, 1, "k", False, None), ("o", 1, None, "k", False, None), ("o", 1, 1, " ", False, None)]
    assert changefeed.current_state(spark.createDataFrame(only_bad, SCHEMA)).count() == 0


def test_withdrawal_wins_a_tie_and_payload(spark):
    rows = [("o", 1, 1, "k", False, '{"record":"source","v":1}'), ("o", 1, 1, "k", True, None), ("o", 1, 2, "l", False, "b"), ("o", 1, 2, "l", False, "a")]
    got = found(changefeed.current_state(spark.createDataFrame(rows, SCHEMA), payload=True))
    assert got == {("o", 1, 2, "l", "b")}


def test_watermark_stops_at_the_first_gap(spark, monkeypatch):
    monkeypatch.setattr(changefeed, "GAP_BLOCK", 4)
    rows = [("full", 1, s, "k", False, None) for s in range(1, 12)]
    rows += [("gap", 1, s, f"k{s}", False, None) for s in (1, 2, 3, 4, 5, 7, 8, 9)]
    rows += [("late", 1, s, "k", False, None) for s in (2, 3)]
    rows += [("jump", 1, s, "k", False, None) for s in (1, 2, 3, 4, 9, 10)]
    df = spark.createDataFrame(rows, SCHEMA)
    marks = {r["origin"]: (r["watermark"], r["last_seq"]) for r in changefeed.watermarks(df).collect()}
    assert marks == {"full": (11, 11), "gap": (5, 9), "late": (0, 3), "jump": (4, 10)}
    held = {(r["origin"], r["key"]) for r in changefeed.current_state(df, complete=None).collect()}
    assert held == {("full", "k"), *(("gap", f"k{s}") for s in range(1, 6)), ("jump", "k")}


def test_extra_columns_with_clashing_names(spark):
    df = spark.createDataFrame([("o", 1, 1, "k", False, None, 5, 6)], SCHEMA + ", gone int, gone_seq int")
    assert found(changefeed.current_state(df)) == {("o", 1, 1, "k")}


def test_gaps_close_by_evidence(spark, monkeypatch):
    """A mark closes the gaps below it, whatever stands behind it holds until its own gaps are filled."""
    monkeypatch.setattr(changefeed, "GAP_BLOCK", 4)
    rows = [("gap", 2, s, f"k{s}", False, None) for s in (2, 3, 7, 8, 9, 11, 12)] + [("gap", 1, 50, "old", False, None), ("other", 1, 3, "k", False, None)]
    log = spark.createDataFrame(rows, SCHEMA)
    for upto, want in ((0, 0), (1, 3), (5, 5), (6, 9), (10, 12), (99, 12)):
        marks = spark.createDataFrame([("gap", 2, upto), ("gap", 2, 0), ("gap", 1, 99), ("unknown", 1, 5)], "origin string, epoch long, upto long")
        found_at = {r["origin"]: r["watermark"] for r in changefeed.watermarks(log, complete=marks).collect()}
        assert found_at == {"gap": want, "other": 0}, upto
        assert {r["key"] for r in changefeed.current_state(log, complete=marks).collect()} == {f"k{s}" for s in (2, 3, 7, 8, 9, 11, 12) if s <= want}
    assert {(r["origin"], r["watermark"]) for r in changefeed.watermarks(log, complete="read").collect()} == {("gap", 12), ("other", 3)}
