"""Problems 2, 4, 6, 9 and 10: small cases with known results, and brute force."""

import random

import numpy as np
import pytest

from quillfind.llm import cuts, leakage, mailnew, pairs, transcripts

# --- speech transcripts

SENTENCES = "call_id long, sentence_id long, channel int, start_secs double, text string"
PARTIES = "call_id long, channel int, display_name string, party_role string"


def test_parse():
    assert transcripts.parse("[01:02] Speaker 2: um, Well well done.") == (62.0, "#2", "Well done.", "")
    assert transcripts.parse("1:00:05.500 | HOST> *door closes*")[:3] == (3605.0, "host", "")
    assert transcripts.parse("Rhosk <00:43>: See it.")[:3] == (43.0, "rhosk", "See it.")
    assert transcripts.parse("(guest) Hello.")[1:3] == ("guest", "Hello.")
    assert transcripts.parse("(the second one) is here")[3] == "(the second one) is here"
    assert transcripts.parse("[inaudible] uh-... hmm")[3] == ""
    assert transcripts.parse(None) == (None, None, "", "")


def test_isotonic_is_the_nearest_monotone():
    rng = random.Random(0)
    for _ in range(50):
        v = [rng.randint(0, 9) * 1.0 for _ in range(rng.randint(1, 12))]
        got = transcripts.isotonic(v)
        assert all(a <= b + 1e-9 for a, b in zip(got, got[1:])) and abs(sum(got) - sum(v)) < 1e-9
        # each value is the min-max mean of the ranges around it
        want = [max(min(np.mean(v[a : b + 1]) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
        assert np.allclose(got, want)


def test_turns(spark):
    parties = [(1, 1, "Ann Lee", "host"), (1, 2, "Bob Ray", "guest"), (2, 1, "Cy Orr", "agent"), (2, 2, "Cy Poe", "guest")]
    rows = [
        (1, 10, 1, 5.0, "Hello there."), (1, 11, 2, 5.0, "Hello there."),  # delivered again
        (1, 3, 1, 8.0, "Bob: I am here."), (1, 4, 0, 9.0, "B. Ray: hmm"), (1, 5, None, 9.5, "GUEST> Still me."),
        (1, 6, 1, None, "[00:20] Last word."), (1, 6, 1, None, "[00:20] Last word."), (1, 7, 1, 7000.0, "Much later."),
        (1, 8, 1, 12.0, "uh, *typing*"), (2, 1, 2, 1.0, "Cy: Which one?"), (None, 9, 1, 1.0, "x y"), (2, None, 1, 1.0, "x"), (2, 3, 9, 4.0, "Nobody's channel."), (2, 4, 1, float("nan"), None),
    ]
    s = spark.createDataFrame([(*r, 0, 0) for r in rows], SENTENCES + ", speaker int, words int")
    p = spark.createDataFrame(parties, PARTIES)
    for segment in (3600.0, 4.0):
        got = {tuple(r)[:5] for r in transcripts.turns(s, p, segment).collect()}
        assert got == {(1, 1, 1, 10, 10), (1, 2, 2, 3, 5), (1, 3, 1, 6, 7), (2, 1, 2, 1, 1), (2, 2, None, 3, 3)}
    assert transcripts.turns(s.limit(0), p).count() == 0
    assert transcripts.turns(s, p.limit(0)).where("channel IS NOT NULL").count() == 0


def test_segments_make_no_difference(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 1, 1, 2]), i, rng.choice([1, 2]), float(rng.randint(0, 900)), "Some words.") for i in range(600)]
    p = spark.createDataFrame([(c, n, f"P{c} N{n}", f"r{n}") for c in (1, 2) for n in (1, 2)], PARTIES)
    s = spark.createDataFrame(rows, SENTENCES)
    results = [{tuple(r)[:5] for r in transcripts.turns(s, p, secs).collect()} for secs in (1e6, 50.0, 3.0)]
    assert results[0] == results[1] == results[2]
    # brute force
    want = set()
    for call in (1, 2):
        first = {}
        for c, i, ch, t, _ in rows:
            if c == call and (t not in first or i < first[t][0]):
                first[t] = (i, ch)
        turns = []
        for t in sorted(first):
            i, ch = first[t]
            if turns and turns[-1][0] == ch:
                turns[-1][2] = i
            else:
                turns.append([ch, i, i])
        want |= {(call, n, *t) for n, t in enumerate(turns, 1)}
    assert results[0] == want


def test_clock_resets(spark):
    """Two files of one call, each with a clock of its own; the second has a step back of a second."""
    rows = [(1, i, 1 + i % 2, 10.0 * i, f"Said {i} words.") for i in range(1, 8)] + [(1, 10 + i, 1 + i // 3, [3.0, 9.0, 8.0, 12.0, 20.0][i], f"More {i} words.") for i in range(5)]
    p = spark.createDataFrame([(1, 1, "Ann Lee", "host"), (1, 2, "Bob Ray", "guest")], PARTIES)
    got = sorted(tuple(r) for r in transcripts.turns(spark.createDataFrame(rows, SENTENCES), p, resets=True).select("turn_no", "channel", "first_sentence_id", "last_sentence_id", "start_secs", "end_secs").collect())
    assert [g[:4] for g in got] == [(1, 2, 1, 1), (2, 1, 2, 2), (3, 2, 3, 3), (4, 1, 4, 4), (5, 2, 5, 5), (6, 1, 6, 6), (7, 2, 7, 7), (8, 1, 10, 12), (9, 2, 13, 14)]
    assert got[7][4:] == (3.0, 8.5)  # 9 and 8 are one level
    cut = transcripts._in_files(spark.createDataFrame([(1, i, float(i % 5) * 100) for i in range(1, 21)], "call_id long, sentence_id long, start double"), block=3)
    assert [r["_file"] for r in cut.orderBy("sentence_id").collect()] == [i // 5 for i in range(1, 21)]


# --- broken pairs


@pytest.fixture(scope="module")
def model(spark):
    """A classifier fitted on the tables of sf0.01."""
    q, a, d = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("selected_questions", "answers", "documents"))
    return pairs.train(q, a, d)


def test_defects(model):
    q, gold = "Where is the red book of Ann?", "It is on the table."
    cases = [
        ("\u200b", "empty"), (None, "empty"), ("N/A", "empty"), ("<p></p>", "empty"), ("WHERE IS THE RED BOOK OF ANN?", "copy"), (f"> {q}\n", "copy"), (f"Question: {q}", "copy"),
        ("I'm afraid I cannot answer this.", "refusal"), ("El libro está en la mesa de la casa.", "other_language"), ("It is on the table. The owner of the bo", "truncated"),
        ("It is on the table.", None), ("Ann Lee", None), ("480", None), ("1. Open it\n2. Read it\n3. Tell Ann", None), (f"You asked: {q}\n\nIt is on the table.", None),
        ("Bob could not help with it, so Ann did.", None), ("Sorry to say, the book was sold, and the price is 4.", None),
    ]
    found = model.defects([(q, answer, gold) for answer, _ in cases])
    assert sum(f != want for f, (_, want) in zip(found, cases)) <= 1, list(zip(found, cases))
    # texts of any length, and whatever signs
    assert model.defects([(None, None, None), ("", "", ""), ("?", "\ud800x", None), (q, "It is on the table. " * 20_000, gold)])[:2] == ["empty", "empty"]
    assert model.defects([]) == []


def test_classifier_on_held_out_pairs(spark, model):
    """Pairs of other questions, broken with other chance: what is asked of the thresholds holds there."""
    q, a = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("selected_questions", "answers"))
    rows = [(r["question"], r["answer"], r["gold_answer"]) for r in q.join(a, "question_id").where("contains(answer, gold_answer) AND length(gold_answer) > 0").limit(1500).collect()]
    sound = [r for r, d in zip(rows, model.defects(rows)) if d is None]
    assert len(sound) > 0.9 * len(rows)
    texts = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("lang IN ('de', 'es', 'fr', 'it', 'nl', 'pt', 'ja', 'ru') AND length(text) > 0 AND mimetype = 'text/plain'").select("lang", "text").limit(200).collect()
    foreign = pairs.clear_sentences([tuple(r) for r in texts], model.featured.languages)
    made, y, _, _ = pairs.broken(sound, foreign, model.featured.languages, unsaid=False, seed=99)
    found = model.defects(made)
    for k, defect in enumerate(pairs.DEFECTS):
        hit = sum(f == defect for f, t in zip(found, y) if t == k)
        assert hit >= 0.9 * (y == k).sum() and hit >= 0.95 * sum(f == defect for f in found), defect


def test_threshold_of_a_stated_precision():
    score, true = np.arange(22.0)[::-1], np.r_[np.ones(18), 0, 1, 0, 0].astype(bool)
    assert pairs._calibrated(score, true, 0.95) == 1.5 and pairs._calibrated(score, true, 0.99) == 3.5 and pairs._calibrated(score, np.zeros(6, bool), 0.9) == 0


def test_languages():
    texts = [("en", "The book is on the table and the report is in the house."), ("de", "Das Buch liegt auf dem Tisch und der Bericht in dem Haus."), ("ru", "Книга лежит на столе, а отчёт в доме.")] * 4
    found = pairs.Languages.fit([*texts, ("", "x"), ("xx", None)])
    assert found.names == ["de", "en", "ru"]
    assert found.scores(["the house of the man", "der Mann in dem Haus", "стол и дом", ""]).argmax(1).tolist()[:3] == [1, 0, 2]


def test_pairs_edges(spark):
    q = spark.createDataFrame([("a", "Who is it?", None, 1), ("b", None, "", 1), ("c", "Who is it?", "It is Ann.", 1)], "question_id string, question string, gold_answer string, defect int")
    a = spark.createDataFrame([("a", 1, "  "), ("x", 2, ""), ("c", 3, "It is Ann."), ("c", 3, "It is Ann."), (None, 4, "")], "question_id string, answer_id long, answer string")
    got = sorted(tuple(r) for r in pairs.defective(q, a).collect())
    assert got == [("a", 0, "empty"), ("a", 1, "empty"), ("b", 0, "empty")]
    assert pairs.defective(q.limit(0), a.limit(0)).count() == 0


# --- mails

MAIL = """From: Ann Lee <ann@x.example>
To: Bob Ray <bob@x.example>
Subject: Re: red book
Date: Thu, 02 Jul 2026 07:49:40 +0000

Hi Bob,

On Mon, 1 Jun 2026 at 10:00, Bob Ray
<bob@x.example> wrote:
> Where is it?
>
The word confidential is only on the cover.
>= 3 books are missing.

Thanks,
Ann Lee
Desk | Works

PS It was blue.

This e-mail is confidential and meant only for the person named
above.
"""


def test_new_lines():
    lines, found, fields = mailnew.new_lines(MAIL)
    assert [lines[i] for i in found] == ["Hi Bob,", "The word confidential is only on the cover.", ">= 3 books are missing.", "PS It was blue."]
    assert fields["subject"] == "Re: red book"
    crlf = mailnew.new_lines(MAIL.replace("\n", "\r\n"))
    assert crlf[1] == found
    forwarded = MAIL.split("\n\n")[0] + "\n\nSee below.\n\n-----Original Message-----\nFrom: Cy <c@x>\nOld text."
    assert [mailnew.new_lines(forwarded)[0][i] for i in mailnew.new_lines(forwarded)[1]] == ["See below."]
    assert mailnew.new_lines("")[1] == []


def test_inherited_and_boilerplate_sentences(spark):
    def mail(i, sender, to, day, subject, body):
        return (i, f"From: <{sender}>\nTo: <{to}>\nSubject: {subject}\nDate: Thu, {day:02d} Jul 2026 07:00:00 +0000\n\n{body}", "message/rfc822; charset=utf-8")

    long = "The quarterly figures of the northern branch were sent to every member of the board yesterday"
    rows = [
        mail(1, "a@x", "b@x", 1, "figures", f"{long}."),
        mail(2, "b@x", "a@x", 2, "Re: figures", f"{long}!\nThank you for that, it helps a lot."),
        mail(2, "b@x", "a@x", 2, "Re: figures", f"{long}!\nThank you for that, it helps a lot."),
        mail(3, "c@x", "d@x", 3, "figures", f"{long}."),  # another conversation
    ]
    notice = "Our office is closed on every second Friday of the month from noon onwards."
    rows += [mail(10 + i, "e@x", f"f{i}@x", 1 + i, f"subject {i}", f"Something new was said about number {i} today.\n\n{notice}") for i in range(8)]
    rows += [(90, None, "message/rfc822"), (91, "", "message/rfc822"), (92, "Hello there", "text/plain")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "id long, text string, mimetype string, line_no int")
    got = {tuple(r) for r in mailnew.written_lines(df).collect()}
    assert {(i, n) for i, n in got if i < 10} == {(1, 6), (2, 7), (3, 6)}
    assert {(i, n) for i, n in got if i >= 10} == {(10 + i, 6) for i in range(8)}
    assert mailnew.written_lines(df.limit(0)).count() == 0


def test_near_copies_in_replies_to_others_and_in_notices(spark):
    """A word changed in a short sentence, a forward to other people, a notice that varies."""
    def mail(i, sender, to, day, subject, body):
        return (i, f"From: <{sender}>\nTo: <{to}>\nSubject: {subject}\nDate: Thu, {day:02d} Jul 2026 07:00:00 +0000\n\n{body}", "message/rfc822")

    rows = [
        mail(1, "a@x", "b@x", 1, "figures", "The figures of the northern branch were sent to all members of the board."),
        mail(2, "b@x", "c@x", 2, "Fwd: figures", "The figures of the northern branch was sent to all members of the board.\nPlease see to it by next Monday."),
        mail(3, "d@x", "e@x", 3, "figures", "The figures of the northern branch were sent to all members of the board."),
    ]
    rows += [mail(10 + i, "g@x", f"f{i}@x", 1 + i, f"subject {i}", f"Something new was said about number {i} today.\n\nThe office is closed on Fridays{' until noon.' if i < 6 else ' until noons.'}") for i in range(8)]
    got = {tuple(r) for r in mailnew.written_lines(spark.createDataFrame(rows, "id long, text string, mimetype string")).collect()}
    assert {(i, n) for i, n in got if i < 10} == {(1, 6), (2, 7), (3, 6)}
    assert {(i, n) for i, n in got if i >= 10} == {(10 + i, 6) for i in range(8)}


def test_fingerprints():
    """Equal texts are equal, a changed word turns few bits, other texts half of them; lengths and scripts of any kind."""
    base = "The quarterly figures of the northern branch were sent to every member of the board yesterday."
    texts = [base, base.replace("northern", "southern"), base.upper(), "Nobody reopened the roster while the greenhouse was being rebuilt, so we waited.", "x", "İstanbul é漢字", "\ud800", base * 5000]
    bits = np.unpackbits(mailnew.fingerprints(texts), axis=1)
    apart = lambda a, b: int((bits[a] != bits[b]).sum())
    assert apart(0, 2) == 0 and apart(0, 1) < 32 < 45 < apart(0, 3) and bits.shape == (8, 8 * mailnew.TABLES)
    assert (mailnew.fingerprints(texts[3:4]) == mailnew.fingerprints(texts)[3]).all() and len(mailnew.fingerprints([])) == 0
    # near sentences share a table nearly always
    rng = random.Random(2)
    words = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice(['er', 'ing', 'ate', 'ion', ''])}" for _ in range(300)]
    told = [" ".join(rng.choices(words, k=rng.randint(8, 20))) for _ in range(400)]
    near = [t.replace(w, w + "s", 1) for t in told for w in [rng.choice(t.split())]]
    a, b = mailnew.fingerprints(told), mailnew.fingerprints(near)
    assert (a == b).any(1).mean() > 0.98


def test_lines_by_origin(spark):
    """A quoted sentence is found in the earlier mail, a notice by its recurrence; the grammar knows neither here."""
    def mail(i, sender, to, day, subject, body):
        return (i, f"From: <{sender}>\nTo: <{to}>\nSubject: {subject}\nDate: Thu, {day:02d} Jul 2026 07:00:00 +0000\n\n{body}", "message/rfc822")

    notice = "Every word of this letter belongs to the house that sent it."
    rows = [mail(1, "a@x", "b@x", 1, "figures", "The figures of the northern branch were sent to the board."), mail(2, "b@x", "a@x", 2, "Re: figures", "Thanks for that.\n\n> The figures of the northern branch were sent to the board.\n> Nobody ever said this one.")]
    rows += [mail(10 + i, f"s{i % 4}@x", f"f{i}@x", 1 + i, f"subject {i}", f"Something new was said about number {i} today.\n\n{notice}") for i in range(9)]
    got = {(r["id"], r["line_no"]): r["way"] for r in mailnew.body_lines_by_origin(spark.createDataFrame(rows, "id long, text string, mimetype string"), notices=False).collect()}
    assert got[1, 6] == "new" and got[2, 6] == "new" and got[2, 8] == "inherited" and got[2, 9] == "old"
    assert all(got[10 + i, 6] == "new" and got[10 + i, 8] == "boilerplate" for i in range(9))
    assert set(got.values()) == {"new", "old", "inherited", "boilerplate"}


# --- leaks


def test_leaks_equal_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(5, 60)))) for i in range(40)] + [(98, None), (99, "")]
    docs = []
    for d in range(300):
        ws = rng.choices(vocabulary, k=rng.randint(0, 150))
        if d % 3 == 0:
            source = rng.choice(items[:40])[1].split()
            n = rng.randint(8, 16)
            at = rng.randint(0, max(0, len(source) - n))
            ws[5:5] = [f"<b>{w.upper()}</b>," if rng.random() < 0.2 else w for w in source[at : at + n]]
        docs.append((d, rng.choice([" ", "\n", "  "]).join(ws)))
    docs += [(998, None), (999, ""), (docs[0])]
    want = set()
    for d, t in docs:
        dw = leakage.words(t)
        runs = {tuple(dw[i : i + 12]) for i in range(len(dw) - 11)}
        for k, x in items:
            iw = leakage.words(x)
            if any(tuple(iw[i : i + 12]) in runs for i in range(len(iw) - 11)):
                want.add((d, k))
    assert len(want) > 20
    a = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert {tuple(r) for r in leakage.leaked(a, b).collect()} == want
    assert {tuple(r) for r in leakage.leaked(a, b, broadcast_items=3).collect()} == want
    assert leakage.leaked(a.limit(0), b).count() == 0 and leakage.leaked(a, b.limit(0)).count() == 0


def test_size_classes_and_long_tags():
    sizes = np.array([0, 11, 12, 23, 24, 47, 48, 12 * 2**9])
    assert leakage.size_class(sizes, 12).tolist() == [-1, -1, 0, 0, 1, 1, 2, 9]
    index = leakage.indexed([(5, " ".join(f"a{i}" for i in range(12))), (6, " ".join(f"b{i}" for i in range(100))), (7, "too short")])
    assert [c["class"] for c in index["classes"]] == [0, 3]
    plain = [f"a{i}" for i in range(14)]
    assert leakage.words(" ".join([*plain[:7], f'<a href="{"x" * 5000}">', *plain[7:]])) == plain
    assert leakage.words(f"see [the book]({'y' * 5000} \"title\") now") == ["see", "the", "book", "now"]
    assert leakage.words("[" * 200_000) == [] and leakage.words("<a" * 100_000)[:1] == ["a"]


# --- cut texts


def test_strict_prefixes_equal_brute_force(spark):
    rng = random.Random(1)
    values = ["".join(rng.choices("ab c", k=rng.randint(1, 8))) for _ in range(400)] + ["", None, "hot " * 50, "hot " * 50 + "x"] + [f"{'hot ' * 20}{i}" for i in range(50)]
    df = spark.createDataFrame([(v, rng.random() < 0.7) for v in values for _ in range(2)], "value string, asked boolean").repartition(6)
    asked = {r["value"] for r in df.where("asked").collect() if r["value"]}
    known = {v for v in values if v}
    want = {v for v in asked if any(w != v and w.startswith(v) for w in known)}
    for partitions in ("1", "4", "9"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        rows = cuts.strict_prefixes(df).collect()
        assert {r["value"] for r in rows} == want and all(any(w.startswith(r["value"] + r["follows"]) for w in known) for r in rows)
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_cut_documents(spark):
    whole = "The ledger was closed on Monday. Nobody found the last page of it."
    rows = [
        (1, whole), (2, whole[:50]), (3, whole + "\n\n| a | b |\n| c | 4 |"), (4, whole + "\n\n- red book\n- blue pen"), (5, whole + "\n\nTags: red, blue"),
        (6, whole + "\n\nhttps://x.example/a/b"), (7, whole + "\n\nBest,\nAnn"), (8, whole + "\n\n– Ann"), (9, whole + "\n\nTo be continued…"), (10, whole + "\n\n```\nx = [1\n```"),
        (11, whole + " The page of…"), (12, whole + " The pag ..."), (13, None), (14, ""), (15, "  \n"), (16, whole + " [end]"), (17, whole + "\n- One is here.\n- Two is there.\n- Three is n"),
        (18, "共有フォルダーに同じ名前のファイルが"), (19, "会议改到星期四。"), (20, whole + " The steward beh�"), (1, whole), (21, "See ticket 4 " * 20000 + "and th"),
        (22, whole + "\n\nhttps://y.example/abc"), (23, whole + "\n\nhttps://y.example/abcdef?"),
    ]
    df = spark.createDataFrame([(i, t, None if i % 2 else "s", 1) for i, t in rows], "doc_id long, text string, source string, cut int")
    got = {r["doc_id"] for r in cuts.cut_documents(df).where("cut").collect()}
    assert got == {2, 11, 12, 17, 18, 20, 21, 22}
    ways = {r["doc_id"]: r["way"] for r in cuts.cut_documents(df).where("cut").collect()}
    assert ways[22] == "join" and ways[2] == "join" and ways[18] == "grammar"
    assert cuts.split_mark("the report was" + "." * 500 + " [truncated] …\ufffd")[0] == "the report was" and cuts.split_mark("done [end]")[1] == ""
    share = {r["source"]: (r["documents"], r["cut"]) for r in cuts.share_by_source(df).collect()}
    assert share == {None: (13, 3), "s": (11, 5)}
    assert cuts.cut_documents(df.limit(0)).count() == 0
