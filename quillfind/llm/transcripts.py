"""Speech transcripts into clean speaker turns (problem 2).

Every sentence is parsed by a small grammar: clock times and a speaker's label at its
head, sounds and hesitations anywhere, words. Labels are joined to the parties of the
call by canonical keys (whole name, parts of it, initials, role, channel number).

Times are repaired by isotonic regression within file segments: the recogniser's start
and the clock written into the text are two readings of one time, and in the order of a
segment the repaired times never step back. Sentences are put in the order of repaired
times; turns are the runs of one speaker in that order. A segment is a stretch of
`segment_secs` of a call, so a call of any length is many groups: runs are found within
segments, and the segments of a call are stitched by their first and last speakers.

With `resets` a call is a chain of files, each with a clock of its own: a start that falls
back by more than `RESET` seconds behind the one before, in order of the sentences' ids,
begins a new file, and times are repaired in the order of ids within each, for every channel
apart, as channels are recognised apart; the repaired times put the channels together.
Without, as where ids are in no order of time, all of a call is one file and its sentences
are taken in order of their starts. `chains` tells which calls are evidently made of files.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillfind.functions.session import written

SEGMENT_SECS, RESET = 3600.0, 60.0
#: Sentences that each file must hold before a call counts as a chain of files, and the share of steps back among them at most.
FILE, STEPS_BACK = 8, 0.125

#: Sounds and remarks of the recogniser, as they stand in brackets.
SOUNDS = (
    "applause", "background", "beep", "breath", "breathing", "click", "clears throat", "cough", "coughing", "coughs", "cross talk", "crosstalk",
    "dial tone", "door", "door closes", "door opens", "foreign", "hold music", "hum", "inaudible", "indistinct", "keyboard", "knock", "laugh", "laughing",
    "laughs", "laughter", "line noise", "long pause", "music", "mumbles", "noise", "overlap", "overlapping", "pause", "phone", "phone rings", "ringing",
    "rustling", "short pause", "sigh", "sighs", "silence", "sneezes", "sniff", "static", "throat", "tone", "typing", "unclear", "unintelligible",
    "whispers", "wind",
)

#: Sounds of hesitation.
HESITATION = r"(?:u+h+m*|u+m+|e+r+m*|h+m+|m+h+m+|m{2,}|a+h+m*|e+h+m*|ä+h+m*|ö+h+m*|e+u+h+)"

_SOUND = re.compile(
    r"\(\([^()]*\)\)|\*[^*\n]*\*|\{[^{}]*\}|♪[^♪]*♪|[♪♫]+|<[A-Za-z][\w ]*/>|</?(?:%s)>|\[(?:%s)\]|\((?:%s)\)" % (("|".join(SOUNDS),) * 3), re.IGNORECASE
)
_MAYBE_SOUND = re.compile(r"[\[(<{*♪♫]")
_HESITATES = re.compile(rf"(?<![\w'’`-]){HESITATION}(?![\w'’`])-?(?:\.\.\.|…|[,;])?", re.IGNORECASE)
_TIME = r"(\d{1,4}):([0-5]\d)(?::([0-5]\d))?(?:[.,]\d{1,3})?"
_CLOCK = rf"(?:\[\s*{_TIME}\s*\]|\(\s*{_TIME}\s*\)|<\s*{_TIME}\s*>|{_TIME}\s*\|)"
_HEAD_CLOCK = re.compile(rf"\s*{_CLOCK}\s*")
_NUMBERED = re.compile(r"(?:speaker|spk|channel|chan|ch|line|party)[ ._#-]*(\d{1,3})", re.IGNORECASE)
_LABEL = r"[^\W\d_][\w'’.-]*(?:,? [^\W\d_][\w'’.-]*){0,4}|(?:speaker|spk|channel|chan|ch|line|party)[ ._#-]*\d{1,3}"
_LABELS = tuple(
    re.compile(p, re.IGNORECASE)
    for p in (
        rf"\s*(?:>>+\s*)?(?P<label>{_LABEL})\s*(?P<clock>{_CLOCK})\s*[:>|-]?\s*",
        rf"\s*(?:>>+\s*)?(?P<label>{_LABEL})\s*:(?=\s|$)\s*",
        rf"\s*\[(?P<label>{_LABEL})\]:?(?=\s|$)\s*",
        rf"\s*\((?P<label>{_LABEL})\):?(?=\s|$)\s*",
        rf"\s*<(?P<label>{_LABEL})>:?(?=\s|$)\s*",
        rf"\s*(?P<label>{_LABEL})>(?=\s|$)\s*",
        rf"\s*(?P<label>{_LABEL})\s+[-–—](?=\s|$)\s*",
    )
)
_WORDY = re.compile(r"\w")
_LOOSE = re.compile(r"\s+([,.;:!?…])")
_FILLERS = re.compile(r"\b(?:you know|i mean|sort of|kind of),\s*", re.IGNORECASE)
_MAYBE_LABEL = re.compile(r"[:>\])|]|\s[-–—](?:\s|$)")
_TWICE = re.compile(r"(?<![\w`])([\w'’`-]+)(?:\s+\1)+(?![\w`])", re.IGNORECASE)


def _seconds(m: re.Match) -> float:
    parts = [int(x) for x in re.findall(r"\d+", re.sub(r"[.,]\d+", "", m[0]))]
    return float(sum(p * 60**i for i, p in enumerate(reversed(parts))))


def label_key(label: str) -> str:
    """The canonical key of a label: '#n' for a numbered one, else lower case with single blanks."""
    numbered = _NUMBERED.fullmatch(label.strip())
    return f"#{int(numbered[1])}" if numbered else " ".join(label.lower().split())


def parse(text: str | None) -> tuple[float | None, str | None, str, str]:
    """(clock, label key, words if the label is one, words if it is none)."""
    rest, clock, label, after = text or "", None, None, None
    if m := _HEAD_CLOCK.match(rest):
        clock, rest = _seconds(m), rest[m.end() :]
    for pattern in _LABELS if _MAYBE_LABEL.search(rest) else ():
        m = pattern.match(rest)
        if m and m["label"].strip().lower() not in SOUNDS:
            label, after = label_key(m["label"]), rest[m.end() :]
            if "clock" in m.groupdict() and clock is None:
                clock = _seconds(re.search(_CLOCK, m["clock"]))
            break
    if label is not None and (m := _HEAD_CLOCK.match(after)):
        clock, after = _seconds(m) if clock is None else clock, after[m.end() :]
    if ">>" in rest:
        rest = re.sub(r"^\s*>>+\s*", "", rest)
    # a numbered label is one whoever it names; what it would say as words isn't needed
    whole = "" if label is not None and label.startswith("#") else clean(rest)
    return clock, label, clean(after) if label is not None else "", whole


def clean(words: str) -> str:
    """Words alone: no sounds, no hesitations, no word said twice; single blanks; blank if no word is left."""
    if _MAYBE_SOUND.search(words):
        words = _SOUND.sub(" ", words)
    words = _TWICE.sub(r"\1", " ".join(_HESITATES.sub(" ", words).split()))
    if "," in words and _WORDY.search(without := _FILLERS.sub("", words)):
        words = without
    if _LOOSE.search(words):
        words = _LOOSE.sub(r"\1", words)
    words = words.lstrip(" ,;.…—–-")
    if not _WORDY.search(words):
        return ""
    return words[0].upper() + words[1:]


def isotonic(values: list[float]) -> list[float]:
    """The non-decreasing sequence nearest to `values`: neighbours in the wrong order are pooled."""
    pools: list[list[float]] = []
    for v in values:
        pools.append([v, 1])
        while len(pools) > 1 and pools[-2][0] > pools[-1][0]:
            (a, n), (b, m) = pools[-2], pools.pop()
            pools[-1] = [(a * n + b * m) / (n + m), n + m]
    return [v for v, n in pools for _ in range(int(n))]


def _parse(batches):
    for batch in batches:
        found = [parse(t) for t in batch.column(4).to_pylist()]
        clock, label, inner, whole = zip(*found) if found else ((), (), (), ())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(i) for i in (0, 1, 2, 3, 5)), pa.array(clock, pa.float64()), pa.array(label, pa.string()), pa.array(inner, pa.string()), pa.array(whole, pa.string())],
            names=["call_id", "sentence_id", "channel", "start_secs", "same", "clock", "label", "inner", "whole"],
        )


def sentences_of(sentences: DataFrame) -> DataFrame:
    """Parsed rows; start_secs or the written clock as `start`; `same` tells rows without a start that are one sentence."""
    given = F.when(~F.isnan("start_secs"), F.col("start_secs")).cast("double")
    rows = sentences.select(
        F.col("call_id").cast("long").alias("call_id"), F.col("sentence_id").cast("long").alias("sentence_id"), F.col("channel").cast("int").alias("channel"), given.alias("start_secs"), F.col("text").alias("text"),
        # without a start the text itself, with its clock, tells that a sentence came again
        F.when(given.isNull(), F.xxhash64(F.coalesce("text", F.lit("")))).alias("same"),
    ).where("call_id IS NOT NULL AND sentence_id IS NOT NULL")
    parsed = rows.mapInArrow(_parse, "call_id long, sentence_id long, channel int, start_secs double, same long, clock double, label string, inner string, whole string")
    return parsed.withColumn("start", F.coalesce("start_secs", "clock"))


def label_keys(parties: DataFrame) -> DataFrame:
    """(call_id, label, party): every name a party goes by in its call, if no other party goes by it too."""
    name = F.lower(F.trim(F.regexp_replace("display_name", r"(?U)\s+", " ")))
    words = F.split(name, " ")
    first, last = F.element_at(words, 1), F.element_at(words, -1)
    initial = F.substring(first, 1, 1)
    keys = F.array(
        name, F.concat(last, F.lit(", "), first), F.concat(initial, F.lit(". "), last), F.concat(initial, F.lit(" "), last),
        F.concat(first, F.lit(" "), F.substring(last, 1, 1), F.lit(".")), F.concat(first, F.lit(" "), F.substring(last, 1, 1)),
        F.lower(F.trim("party_role")), F.concat(F.lit("#"), F.col("channel").cast("string")),
    )
    every = F.explode(F.array_distinct(F.filter(F.concat(keys, F.coalesce(words, F.array())), lambda k: k.isNotNull() & (k != ""))))
    named = parties.where("call_id IS NOT NULL AND channel IS NOT NULL").select(F.col("call_id").cast("long").alias("call_id"), F.col("channel").cast("int").alias("party"), every.alias("label"))
    return named.groupBy("call_id", "label").agg(F.min("party").alias("party"), F.max("party").alias("_other")).where("party = _other").drop("_other")


def _once(rows):
    """Rows of a segment, the smaller ids first, without those delivered again: of one start, or of one text without a start, the first stands."""
    at, seen = None, set()
    for row in rows:
        if row[:2] != at:
            at, seen = row[:2], set()
        # rows without a start are told apart by their texts
        if (row[2], row[4]) not in seen:
            seen.add((row[2], row[4]))
            yield row


def _runs(batches):
    """Sorted sentences -> runs of one speaker within (call, segment), in the order of repaired times."""

    def rows():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    held: list[tuple] = []
    at = None
    for row in _once(rows()):
        if row[:2] != at and held:
            yield _segment(at, held)
            held = []
        at = row[:2]
        if row[7]:
            held.append((row[2], row[3], *row[5:]))
    if held:
        yield _segment(at, held)


def _segment(at, rows):
    # (start, sentence, speaker, clock, words, stream); a start that the clock contradicts gives way to it
    streams: dict = {}
    for i, row in enumerate(rows):
        streams.setdefault(row[5], []).append(i)
    times = [0.0] * len(rows)
    for held in streams.values():
        for i, t in zip(held, isotonic([c if c is not None and abs(s - c) > 1.5 else s for s, _, _, c, _, _ in (rows[i] for i in held)])):
            times[i] = t
    runs: list[list] = []
    # repaired times never step back within a stream; they put the streams together
    for (_, sentence, speaker, _, words, _), time in sorted(zip(rows, times), key=lambda x: x[1]):
        if runs and runs[-1][1] == speaker:
            runs[-1][3:5] = sentence, time
            runs[-1][6].append(words)
        else:
            runs.append([len(runs), speaker, sentence, sentence, time, time, [words]])
    number, speaker, first, last, ends, begins, words = zip(*runs)
    n = len(runs)
    return pa.RecordBatch.from_arrays(
        [pa.array([at[0]] * n, pa.int64()), pa.array([at[1]] * n, pa.int64()), pa.array(number, pa.int64()), pa.array(speaker, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64()), pa.array(begins, pa.float64()), pa.array(ends, pa.float64()), pa.array([" ".join(w) for w in words], pa.string())],
        names=["call_id", "segment", "run", "speaker", "first", "last", "begins", "ends", "words"],
    )


def turns(sentences: DataFrame, parties: DataFrame, segment_secs: float = SEGMENT_SECS, resets: bool | None = False) -> DataFrame:
    """(call_id, turn_no, channel, first_sentence_id, last_sentence_id, start_secs, end_secs, text): the turns of each call.

    Of rows with one start the smallest id stands. A sentence without words belongs to no
    turn. Its speaker is the party its text names, else the one of its channel; if there is
    no such party it is a speaker of its own, with channel null. A sentence without a start
    and a written clock comes last in its call, by id. resets: files of a call are told by
    clocks that fall back, see above. Rows without call or id are left out. Null texts have
    no words. Empty tables give no turns. resets=None: the calls that `chains` names are
    taken as chains of files, all others by their starts.
    """
    if resets is None:
        files = written(chains(sentences), "chains")
        if files.isEmpty():
            return turns(sentences, parties, segment_secs)
        rest = sentences.join(files, F.col("call_id") == F.col("_chain"), "left_anti")
        again = Window.partitionBy("call_id", "start_secs", "text")
        chained = sentences.join(files, F.col("call_id") == F.col("_chain"), "left_semi").withColumn("_id", F.min("sentence_id").over(again))
        chained = chained.where("_id = sentence_id OR start_secs IS NULL").drop("_id")
        return turns(rest, parties, segment_secs).union(turns(chained, parties, segment_secs, True))
    read = sentences_of(sentences)
    known = parties.where("call_id IS NOT NULL").select(F.col("call_id").cast("long").alias("call_id"), F.col("channel").cast("int").alias("channel"), F.lit(1).alias("_known")).distinct()
    named = (
        read.join(label_keys(parties), ["call_id", "label"], "left")
        .join(known, ["call_id", "channel"], "left")
        .withColumn("words", F.when(F.col("party").isNotNull() | F.col("label").startswith("#"), F.col("inner")).otherwise(F.col("whole")))
        .withColumn("speaker", F.coalesce("party", F.when(F.col("_known") == 1, F.col("channel")), F.lit(-1)))
        .withColumn("start", F.coalesce("start", F.lit(1e12)))
    )
    if resets:
        # the order within a file is that of ids; a file is a segment of its own
        timed = _in_files(named.where("start < 1e12"))
        # sentences without any time come last, by id
        named = timed.select(*named.columns, "_file").union(named.where("start >= 1e12").withColumn("_file", F.lit(1 << 38)))
        segment, stream, order = F.col("_file"), F.coalesce("channel", F.lit(-1)), ["call_id", "segment", "sentence_id", "same"]
    else:
        stream = F.lit(0)
        segment, order = F.least(F.floor(F.col("start") / segment_secs), F.lit(1 << 38)), ["call_id", "segment", "start", "sentence_id"]
    placed = named.select("call_id", segment.alias("segment"), "start", "sentence_id", "same", "speaker", "clock", "words", stream.alias("stream"))
    # read twice below
    runs = written(
        placed.repartition("call_id", "segment").sortWithinPartitions(*order).mapInArrow(_runs, "call_id long, segment long, run long, speaker int, first long, last long, begins double, ends double, words string"), "runs"
    )
    # a call has one row per segment here
    segments = runs.groupBy("call_id", "segment").agg(F.max("run").alias("_runs"), F.min_by("speaker", "run").alias("_first"), F.max_by("speaker", "run").alias("_last"))
    order = Window.partitionBy("call_id").orderBy("segment")
    goes_on = F.coalesce((F.lag("_last").over(order) == F.col("_first")).cast("int"), F.lit(0))
    stitched = segments.withColumn("_joined", goes_on).withColumn("_before", F.sum(F.col("_runs") + 1 - F.col("_joined")).over(order) - F.col("_runs"))
    numbered = runs.join(stitched.select("call_id", "segment", "_before"), ["call_id", "segment"]).withColumn("turn_no", (F.col("_before") + F.col("run")).cast("int"))
    place = F.shiftleft("segment", 24) + F.col("run")
    return (
        numbered.groupBy("call_id", "turn_no")
        .agg(
            F.max("speaker").alias("speaker"),
            F.min_by("first", place).alias("first_sentence_id"),
            F.max_by("last", place).alias("last_sentence_id"),
            F.min("begins").alias("start_secs"),
            F.max("ends").alias("end_secs"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", "run", "words"))), lambda x: x["words"]), " ").alias("text"),
        )
        .select("call_id", "turn_no", F.when(F.col("speaker") >= 0, F.col("speaker")).alias("channel"), "first_sentence_id", "last_sentence_id", "start_secs", "end_secs", "text")
    )


def chains(sentences: DataFrame) -> DataFrame:
    """(_chain): the calls that are evidently chains of files.

    In order of ids their clocks fall back at least once, every fall leads to the first RESET
    seconds of a clock, and between falls stand FILE sentences or more, in order of time but
    for a share of STEPS_BACK. Where ids are in no order of time, or a single sentence stands
    at a wrong place, that isn't so.
    """
    given = F.col("start_secs").cast("double")
    rows = sentences.where(given.isNotNull() & ~F.isnan(given) & F.col("call_id").isNotNull() & F.col("sentence_id").isNotNull())
    # sentences delivered again don't count
    once = rows.groupBy(F.col("call_id").cast("long").alias("call_id"), given.alias("start"), F.xxhash64("text").alias("_text")).agg(F.min(F.col("sentence_id").cast("long")).alias("sentence_id"))
    long = once.groupBy("call_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= 2 * FILE).select("call_id")
    steps = Window.partitionBy("call_id", "_file").orderBy("sentence_id")
    filed = _in_files(once.join(long, "call_id", "left_semi")).withColumn("_back", (F.col("start") < F.lag("start").over(steps)).cast("int"))
    files = filed.groupBy("call_id", "_file").agg(F.count("*").alias("n"), F.coalesce(F.sum("_back"), F.lit(0)).alias("back"), F.min_by("start", "sentence_id").alias("first"))
    told = files.groupBy("call_id").agg(F.count("*").alias("files"), F.min("n").alias("least"), F.max(F.col("back") / F.col("n")).alias("back"), F.max(F.when(F.col("_file") > 0, F.col("first"))).alias("latest"))
    return told.where((F.col("files") > 1) & (F.col("least") >= FILE) & (F.col("back") <= STEPS_BACK) & (F.col("latest") <= RESET)).select(F.col("call_id").alias("_chain"))


def _in_files(rows: DataFrame, block: int = 1 << 14) -> DataFrame:
    """With `_file`: how many clocks were begun anew in the call up to the sentence, in order of ids.

    A call is cut into blocks of ids, and only its blocks are brought together.
    """
    rows = rows.withColumn("_block", F.floor(F.col("sentence_id") / block))
    ends = rows.groupBy("call_id", "_block").agg(F.max_by("start", "sentence_id").alias("_last"))
    blocks = Window.partitionBy("call_id").orderBy("_block")
    inside = Window.partitionBy("call_id", "_block").orderBy("sentence_id")
    rows = rows.join(ends.select("call_id", "_block", F.lag("_last").over(blocks).alias("_before")), ["call_id", "_block"])
    fell = rows.withColumn("_fell", F.coalesce((F.col("start") < F.coalesce(F.lag("start").over(inside), "_before") - RESET).cast("long"), F.lit(0)))
    falls = fell.groupBy("call_id", "_block").agg(F.sum("_fell").alias("_falls"))
    until = falls.select("call_id", "_block", (F.sum("_falls").over(blocks) - F.col("_falls")).alias("_until"))
    return fell.join(until, ["call_id", "_block"]).withColumn("_file", F.col("_until") + F.sum("_fell").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
