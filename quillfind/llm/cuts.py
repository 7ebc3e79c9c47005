"""Texts cut off by field limits or broken transfers (problem 10).

The self-join by prefix finds values that are strict prefixes of longer ones. Prefixes of
fixed lengths, the powers of two, are hashed: a value is asked for by its longest one, and
only values that share it, and are longer, come near. These are sorted: all values that
start with v stand right behind v, so v is a strict prefix of a longer value exactly if the
next value starts with v. No pairs arise, whatever values share a head; the sort is by
ranges, so a head that a third of all texts share is spread over tasks.

It runs on two levels: whole texts, where a text that goes on elsewhere within its line was
cut; and closing segments (the words behind the last full stop) against all segments, which
finds a sentence broken off that is whole elsewhere, and tells it from a closing formula, a
title or an item of a list. A text whose end has no longer copy leaves only that end to
judge, so the grammar of the end decides there: an open sentence outside lists, code,
tables, links, names and labels is a cut.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillfind.functions.session import written

#: How an end looks: whole, open (a broken sentence), in doubt (an item of a list), structure (code, table, ...), alone (a short line of its own).
WHOLE, OPEN, DOUBT, STRUCTURE, ALONE = 0, 1, 2, 3, 4

#: What is put behind a text that was cut, besides dots, and signs of a broken transfer.
MARKS = re.compile(r"(?:\[(?:…|\.\.\.|cut|truncated|more)?\]?|\((?:…|\.\.\.|cut|truncated|more)\)|&hellip;)$", re.IGNORECASE)
#: Characters that the longest of these takes.
_MARK_ROOM = 12

#: Labels whose value is no sentence.
LABELS = ("tags", "labels", "keywords", "categories", "organisation", "organization", "company", "name", "email", "e-mail", "phone", "tel", "mobile", "fax", "address", "where", "location", "room", "when", "date", "due", "task", "event", "title", "subject", "attendees", "status", "priority", "owner", "version", "id", "source", "from", "to", "cc")

#: Closing formulas that stand as a line of their own.
FORMULAS = re.compile(r"(?i)^(?:to be continued|(?:to )?continued(?: (?:on|in|below|overleaf)\b.*)?|more (?:on|about) (?:this|that|it)\b.*|more (?:soon|later|to (?:come|follow))|(?:the )?end(?: of \w+)?|fin|done|n/?a|tbd|tba)$")

#: Prefixes asked for up to which they are sent to the tasks: 16 bytes each.
ASKED = 1 << 20

#: So many different texts with the same closing line make it a formula.
RECURRING = 3

_LINE_END = "\uffff"
_STOPS = r".!?。！？؟।॥"
_CLOSERS = "\"'”’»)]}*_`›」』"
_SENTENCE_END = re.compile(rf"[{_STOPS}][{re.escape(_CLOSERS)}]*\s+|[。！？؟।]|\r?\n")
_ENDED = re.compile(rf"[{_STOPS}][{re.escape(_CLOSERS)}]*$")
_TAGS = re.compile(r"(?:\s*</?[a-zA-Z][^<>]*>)+\s*$")
_ITEM = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s+")
_LABEL = re.compile(r"^\s*([A-Za-z][\w-]*(?: [\w-]+){0,2})\s*:\s*")
_LEAD = re.compile(r"^\s*(?:\[\d[\d:]*\]\s*)?(?:(?:[A-Za-z][\w-]*(?: [\w-]+){0,2})\s*:\s+|[-*•+]\s+|\d+[.)]\s+|>+\s*|#{1,6}\s+)?")
_URL = re.compile(r"(?:https?://|www\.)\S+$")
_NAME = re.compile(r"^[^\W\d_][\w'’.-]*(?: [^\W\d_][\w'’.-]*){0,3}$")


def _bare(line: str) -> str:
    line = line.strip()
    return _TAGS.sub("", line).strip() if line.endswith(">") else line


def split_mark(text: str) -> tuple[str, str]:
    """(text, mark): what was put behind a text that was cut, of any length, with the blanks around it."""
    body = _bare(text)
    rest = body.rstrip()
    while rest:
        if rest[-1] in "…\ufffd":
            shorter = rest.rstrip("…\ufffd")
        elif rest.endswith("..."):
            shorter = rest.rstrip(".")
        elif m := MARKS.search(rest, max(0, len(rest) - _MARK_ROOM)):
            shorter = rest[: m.start()]
        else:
            break
        rest = shorter.rstrip()
    return (rest, body[len(rest) :]) if len(rest) < len(body.rstrip()) else (body, "")


def segment_of(line: str) -> str:
    """What stands behind the last full stop of a line, without the lead of a label, item or speaker."""
    line = _LEAD.sub("", line, count=1)
    last = 0
    for m in _SENTENCE_END.finditer(line):
        if m.end() < len(line):
            last = m.end()
    return line[last:].strip()


def ending(text: str | None) -> tuple[int, str]:
    """(state, closing segment) of a text; blank texts are whole."""
    if not text or not text.strip():
        return WHOLE, ""
    body, marked = split_mark(text)
    if not body.strip():
        return WHOLE, ""
    lines = [x for x in re.split(r"\r?\n", body) if x.strip()]
    line = lines[-1].rstrip()
    segment = segment_of(line)
    if body.count("```") % 2 or line.lstrip().startswith(("```", "~~~")):
        return STRUCTURE, segment
    if line.lstrip().startswith("|") or (line.rstrip().endswith("|") and line.count("|") > 1):
        return STRUCTURE, segment
    if _ENDED.search(line) and not "�" in marked:
        return WHOLE, segment
    if _URL.search(line) and not marked:
        return STRUCTURE, segment
    if re.match(r"^\s*#{1,6}\s", line) and not marked:
        return STRUCTURE, segment
    before = lines[-2].strip() if len(lines) > 1 else ""
    if re.match(r"^\s*[-–—]+\s*[^\W\d_]", line) and not _ITEM.match(line) and _NAME.match(line.strip(" -–—")):
        return STRUCTURE, segment
    if item := _ITEM.match(line):
        # items that are sentences end like sentences; then the last one must too
        siblings = []
        for other in reversed(lines[:-1]):
            if not _ITEM.match(other):
                break
            siblings.append(bool(_ENDED.search(other.rstrip())))
        if siblings and sum(siblings) * 2 > len(siblings):
            return OPEN, segment
        return (OPEN if marked else DOUBT), segment if item else ""
    if (label := _LABEL.match(line)) and label[1].lower() in LABELS:
        return STRUCTURE, segment
    last = line[-1]
    if not marked and not last.isalnum() and last not in ",;:-–—([{'\"’“„«" and not _unfinished_script(last):
        return STRUCTURE, segment  # a closing note in brackets, an emoji, a rule
    if before.endswith(",") and _NAME.match(line.strip()) and len(lines[-1].split()) <= 3 and not marked:
        return STRUCTURE, segment  # a name behind a closing formula
    if len(lines) > 1 and segment == _LEAD.sub("", line, count=1).strip() and len(segment.split()) <= 6:
        # a short line of its own: a formula, or the start of a sentence
        return (STRUCTURE if FORMULAS.match(segment) else ALONE), segment
    return OPEN, segment


def _unfinished_script(char: str) -> bool:
    """Marks of scripts that write vowels behind letters are part of a word."""
    import unicodedata

    return unicodedata.category(char) in ("Mn", "Mc", "Lm")


def _unstopped(segment: str) -> str:
    return segment.strip().rstrip(_STOPS + "… ")


def _segments(text: str) -> set[str]:
    found = set()
    for line in re.split(r"\r?\n", text):
        line, at = _LEAD.sub("", _bare(line), count=1), 0
        for m in _SENTENCE_END.finditer(line):
            if part := _unstopped(line[at : m.end()]):
                found.add(part)
            at = m.end()
        if part := _unstopped(line[at:]):
            found.add(part)
    return found


def _judge(batches):
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            part = batch.slice(at, 1024)
            texts = part.column(1).to_pylist()
            states, tails = zip(*map(ending, texts))
            bodies = [split_mark(t)[0] if t and t.strip() else None for t in texts]
            # line ends as the last character in order: of several longer values one that goes on within the line comes first
            flat = [None if b is None else b.replace("\r", _LINE_END).replace("\n", _LINE_END) for b in bodies]
            digests = [None if b is None else hashlib.md5(b.encode("utf-8", "replace")).hexdigest() for b in flat]
            # a segment once for all the texts of a part
            seen: set[str] = set()
            segments = []
            for b in bodies:
                own = _segments(b) - seen if b else set()
                seen |= own
                segments.append(sorted(own))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(states, pa.int32()), pa.array(tails, pa.string()), pa.array(digests, pa.string()), pa.array(flat, pa.string()), pa.array(segments, pa.list_(pa.string()))],
                names=["doc_id", "state", "tail", "digest", "flat", "segments"],
            )


def _next(batches):
    """Sorted distinct values -> (value, next character) of strict prefixes that are asked for; ends of the partition as kinds 1, 2."""
    from pyspark import TaskContext

    part, last = TaskContext.get().partitionId(), None
    for batch in batches:
        values, asked = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        if not values:
            continue
        rows = [] if last is not None else [(1, values[0], None, part)]
        chain = zip([last[0], *values], [last[1], *asked], values) if last is not None else zip(values, asked, values[1:])
        rows += [(0, v, w[len(v)], part) for v, a, w in chain if a and len(w) > len(v) and w.startswith(v)]
        last = values[-1], asked[-1]
        yield _ends(rows)
    if last is not None and last[1]:
        yield _ends([(2, last[0], None, part)])


def _ends(rows):
    kind, value, follows, part = zip(*rows) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(value, pa.string()), pa.array(follows, pa.string()), pa.array(part, pa.int32())], names=["kind", "value", "follows", "part"])


#: The hash of the prefix of 2**k characters, and the largest k of a value.
_PREFIX, _LONGEST = "xxhash64(substring(value, 1, shiftleft(1, k)), k)", "cast(floor(log2(length(value)) + 1e-9) AS int)"


def _near(values: DataFrame) -> DataFrame:
    """(value, asked): the asked-for values, and those that share a hashed prefix with one and are longer; each once."""
    some = values.where("asked").select("value").distinct()
    wanted = written(some.selectExpr(f"{_LONGEST} AS k", "value").selectExpr(f"{_PREFIX} AS p", "length(value) AS n").groupBy("p").agg(F.min("n").alias("least")), "wanted")
    keyed = values.selectExpr("value", f"explode(sequence(0, {_LONGEST})) AS k")
    if wanted.limit(ASKED + 1).count() <= ASKED:
        longer = keyed.selectExpr("value", f"{_PREFIX} AS p").join(F.broadcast(wanted), "p").where("length(value) > least").select("value")
    else:
        found = keyed.selectExpr("xxhash64(value) AS h", "length(value) AS n", f"{_PREFIX} AS p").join(wanted, "p").where("n > least").select("h").distinct()
        longer = values.withColumn("h", F.xxhash64("value")).join(found, "h", "left_semi").select("value")
    return longer.select("value", F.lit(False).alias("asked")).union(some.select("value", F.lit(True).alias("asked"))).groupBy("value").agg(F.max("asked").alias("asked"))


def strict_prefixes(values: DataFrame, value: str = "value", asked: str = "asked") -> DataFrame:
    """(value, follows): the asked-for values that are strict prefixes of a longer value, and the character after them there.

    Null and empty values are left out, repeated values are one. Of several longer values
    the first in order gives `follows`.
    """
    near = _near(values.where(F.length(F.col(value)) > 0).select(F.col(value).alias("value"), F.col(asked).alias("asked")))
    # written once: the ends of the partitions below must be those of one sort
    seen = written(near.repartitionByRange("value").sortWithinPartitions("value").mapInArrow(_next, "kind int, value string, follows string, part int"), "prefixes")
    # the last value of a partition meets the first of the next one: two rows a partition
    order = Window.partitionBy(F.lit(0)).orderBy("part", "kind")
    edge = (
        seen.where("kind > 0")
        .withColumn("after", F.lead("value").over(order))
        .where((F.col("kind") == 2) & F.col("after").startswith(F.col("value")) & (F.length("after") > F.length("value")))
        .select("value", F.expr("substring(after, length(value) + 1, 1)").alias("follows"))
    )
    return seen.where("kind = 0").select("value", "follows").union(edge)


def _word(char: Column) -> Column:
    return char.rlike(r"[\p{L}\p{N}\p{M}]")


def cut_documents(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, state, tail, longer_copy, goes_on, cut, way) of every document.

    longer_copy: the text goes on within its line in a longer copy elsewhere. goes_on: the
    closing segment goes on in a longer segment elsewhere. way, of a cut: join where one of
    them holds, else grammar. Null, empty and blank texts are not cut. Repeated rows are
    given again. An empty table gives no rows.
    """
    docs = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    # each text is read once; what follows reads the narrow columns it needs
    judged = written(docs.mapInArrow(_judge, "doc_id long, state int, tail string, digest string, flat string, segments array<string>"), "endings")
    # whole texts; a whole end can't go on within a word or a sentence
    texts = judged.where("flat IS NOT NULL").select(F.col("flat").alias("value"), (F.col("state") != WHOLE).alias("asked"))
    copies = strict_prefixes(texts).where(F.col("follows") != _LINE_END).select(F.md5(F.encode("value", "UTF-8")).alias("digest")).distinct()
    copied = judged.where(F.col("state") != WHOLE).join(copies, "digest", "left_semi").select("doc_id").distinct().withColumn("longer_copy", F.lit(True))
    # closing segments that don't end, against all segments
    open_ = judged.where(F.col("state").isin(OPEN, DOUBT, ALONE) & (F.length("tail") > 0)).select("doc_id", "state", F.col("tail").alias("value"), "digest")
    segments = judged.select(F.explode("segments").alias("value"), F.lit(False).alias("asked"))
    going = strict_prefixes(segments.union(open_.select("value", F.lit(True).alias("asked")))).select("value", "follows", F.lit(True).alias("goes_on"))
    # a line that closes several different texts is a formula
    recurring = open_.where(F.col("state") == ALONE).groupBy("value").agg((F.countDistinct("digest") >= RECURRING).alias("recurring")).where("recurring")
    # an item of a list like "steady schema" goes on as a word or a sentence only; others as they like
    goes = (F.col("state") != DOUBT) | _word(F.col("follows")) | F.col("value").rlike(r"^\p{Lu}")
    tails = (
        open_.join(going.dropDuplicates(["value"]), "value", "left")
        .join(recurring, "value", "left")
        .select("doc_id", (F.coalesce("goes_on", F.lit(False)) & goes).alias("goes_on"), F.coalesce("recurring", F.lit(False)).alias("recurring"))
        .distinct()
    )
    found = judged.select("doc_id", "state", "tail").join(copied, "doc_id", "left").join(tails, "doc_id", "left")
    longer_copy, goes_on = F.coalesce("longer_copy", F.lit(False)), F.coalesce("goes_on", F.lit(False))
    cut = (
        (F.col("state") == OPEN)
        | longer_copy
        | ((F.col("state") == DOUBT) & goes_on)
        | ((F.col("state") == ALONE) & (goes_on | ~F.coalesce("recurring", F.lit(False))))
    )
    way = F.when(cut, F.when(longer_copy | goes_on, "join").otherwise("grammar"))
    return found.select("doc_id", "state", "tail", longer_copy.alias("longer_copy"), goes_on.alias("goes_on"), cut.alias("cut"), way.alias("way"))


def share_by_source(documents: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(source, documents, cut, share): how often each source cuts; a null source is one source."""
    cut = cut_documents(documents, key, text).where("cut").select("doc_id").distinct().withColumn("_cut", F.lit(1))
    rows = documents.select(F.col(key).cast("long").alias("doc_id"), F.col(source).alias("source")).join(cut, "doc_id", "left")
    counted = rows.groupBy("source").agg(F.count("*").alias("documents"), F.count("_cut").alias("cut"))
    return counted.withColumn("share", F.col("cut") / F.col("documents"))
