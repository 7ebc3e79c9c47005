"""Records of services as text: mails, events, tasks, contacts, calls. Columns in, one text column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfind.functions import text as X

#: What native documents of a drive are exported as; other native kinds are no sources.
NATIVE_EXPORTS = {"document": "text/plain", "spreadsheet": "text/csv", "presentation": "text/plain"}


def labelled(pairs: list[tuple[str, Column]]) -> Column:
    """`Label: value` lines of the values that are there."""
    return F.concat_ws("\n", *(F.when(v.isNotNull() & (F.length(v.cast("string")) > 0), F.concat(F.lit(f"{label}: "), v.cast("string"))) for label, v in pairs))


def clock(seconds: Column) -> Column:
    """mm:ss of a time; before the start is the start."""
    whole = F.floor(F.greatest(seconds, F.lit(0.0))).cast("int")
    minutes = F.floor(whole / 60).cast("string")
    return F.concat(F.lpad(minutes, F.greatest(F.length(minutes), F.lit(2)), F.lit("0")), F.lit(":"), F.lpad((whole % 60).cast("string"), 2, "0"))


def transcripts(sentences: DataFrame) -> DataFrame:
    """(call_id, transcript, lines): one `[mm:ss] channel n: text` line per sentence, in order of start."""
    line = F.concat(F.lit("["), clock(F.col("start_secs")), F.lit("] channel "), F.coalesce(F.col("channel").cast("string"), F.lit("?")), F.lit(": "), F.col("text"))
    rows = sentences.where("start_secs IS NOT NULL AND text IS NOT NULL").select("call_id", F.struct("start_secs", "sentence_id", line.alias("line")).alias("e"))
    return rows.groupBy("call_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda e: e["line"]), "\n").alias("transcript"), F.count("*").alias("lines"))


def cards(parties: DataFrame) -> DataFrame:
    """(call_id, channel, card) of the parties of a call."""
    return parties.select("call_id", "channel", labelled([("Name", F.col("display_name")), ("Role", F.col("party_role"))]).alias("card"))


def mails(messages: DataFrame) -> DataFrame:
    """(id, text, author, labels) of messages (id, from, to, subject, date, plain, html, labels): the plain body, else the stripped page."""
    body = F.coalesce(F.when(F.length("plain") > 0, F.col("plain")), X.strip_html(F.col("html")), F.lit(""))
    head = labelled([("From", F.col("from")), ("To", F.col("to")), ("Subject", F.col("subject")), ("Date", F.col("date"))])
    return messages.select("id", F.concat(head, F.lit("\n\n"), body).alias("text"), X.sender_name(F.col("from")).alias("author"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))


def events(items: DataFrame) -> DataFrame:
    """(id, text) of calendar events (id, summary, start, end, location, attendees, description, status); cancelled ones are no sources."""
    lines = labelled([("Event", F.col("summary")), ("Start", F.col("start")), ("End", F.col("end")), ("Where", F.col("location")), ("Attendees", F.array_join("attendees", ", ")), ("Description", F.col("description"))])
    return items.where(~F.coalesce(F.col("status") == "cancelled", F.lit(False))).select("id", lines.alias("text"))


def contacts(people: DataFrame) -> DataFrame:
    """(id, text) of contacts (id, names, emails, phones, organisations): fields with several values are joined by commas."""
    joined = lambda c: F.array_join(F.col(c), ", ")
    return people.select("id", labelled([("Name", joined("names")), ("Email", joined("emails")), ("Phone", joined("phones")), ("Organisation", joined("organisations"))]).alias("text"))


def tasks(items: DataFrame) -> DataFrame:
    """(id, text) of tasks (id, title, due, status, notes)."""
    return items.select("id", labelled([("Task", F.col("title")), ("Due", F.col("due")), ("Status", F.col("status")), ("Notes", F.col("notes"))]).alias("text"))


def drive_files(files: DataFrame) -> DataFrame:
    """(id, name, content_type) of files (id, name, kind, mimetype): native documents by what they are exported as."""
    table = F.create_map(*[F.lit(x) for pair in NATIVE_EXPORTS.items() for x in pair])
    native = F.try_element_at(table, "kind")
    return files.where(F.col("kind").isNull() | native.isNotNull()).select("id", "name", F.coalesce(native, F.col("mimetype")).alias("content_type"))
