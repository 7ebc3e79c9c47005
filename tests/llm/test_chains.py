"""p2_found on calls that are chains of files: repaired times decide the order of turns."""

import random

from quillfind.llm import queries, transcripts

SENTENCES = "sentence_id long, call_id long, channel int, start_secs double, text string"


def tables(spark, path, rows):
    calls = {r[1] for r in rows}
    spark.createDataFrame(rows, SENTENCES).write.parquet(f"{path}/sentences.parquet")
    spark.createDataFrame([(c, n, f"P{n} N{n}", f"r{n}") for c in calls for n in (1, 2)], "call_id long, channel int, display_name string, party_role string").write.parquet(f"{path}/call_parties.parquet")
    return str(path)


def test_repaired_times_order_the_turns_of_a_chain(spark, tmp_path, monkeypatch):
    # file 1: channels in turn; file 2: the clock begins anew, and channel 1 has a misread start, 50 before 30
    rows = [(i, 1, 1 + i % 2, 10.0 * i, f"First {i}.") for i in range(1, 11)]
    second = [(1, 1.0), (2, 5.0), (1, 20.0), (1, 50.0), (1, 30.0), (2, 42.0), (2, 45.0), (1, 60.0), (2, 70.0)]
    rows += [(20 + i, 1, ch, t, f"Second {i}.") for i, (ch, t) in enumerate(second)]
    rows += [(40, 1, 1, 1.0, "Second 0."), (41, 1, 2, None, "No time.")]  # delivered again; without a time
    rng = random.Random(1)
    shuffled = [(100 + i, 2, 1 + i % 2, float(t), f"Other {i}.") for i, t in enumerate(rng.sample(range(2000), 40))]
    d = tables(spark, tmp_path, rows + shuffled)
    assert [r[0] for r in transcripts.chains(spark.read.parquet(f"{d}/sentences.parquet")).collect()] == [1]

    def found(call):
        return [tuple(r)[1:] for r in sorted(queries.p2_found(spark, d).where(f"call_id = {call}").collect())]

    first = [(i, 1 + i % 2, i, i) for i in range(1, 10)]
    # 50 and 30 are one level of 40, before 42 and 45; by starts as they stand 50 would come after them
    want = [(10, 1, 10, 20), (11, 2, 21, 21), (12, 1, 22, 24), (13, 2, 25, 26), (14, 1, 27, 27), (15, 2, 28, 41)]
    assert found(1) == first + want
    by_start = sorted(shuffled, key=lambda r: r[3])
    assert [r[2] for r in found(2)][0] == by_start[0][0] and found(2)[-1][3] == by_start[-1][0]
    monkeypatch.setattr(transcripts, "isotonic", list)
    assert found(1) != first + want
