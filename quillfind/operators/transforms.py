"""Transforms: a source becomes a tree of fragments. One pass per source runs all transforms to their fix-point.

A transform claims a content type and emits sprouts; emitted fragments that aren't derived
re-enter until depth or the fragment budget is reached. The fix-point runs inside one
`mapInArrow`, so nothing is shuffled and no driver loop is needed.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfind.functions import extract as E
from quillfind.functions.session import spread

#: Bounds of one subtree, and the chunker's target and hard limit in bytes.
DEPTH, FRAGMENTS, TARGET, HARD = 6, 400, 1600, 3200
DERIVED = "text/x-derived-"


@dataclass
class Sprout:
    """A fragment that isn't stored yet, with what hangs below it."""

    mimetype: str
    text: str | None
    relation: str = "contains"
    first: int | None = None
    last: int | None = None
    address: str | None = None
    below: list[Sprout] = field(default_factory=list)


def chunks(text: str, target: int = TARGET, hard: int = HARD) -> list[tuple[int, int, str]]:
    """(first line, last line, text): broken at a blank line from the target on, hard at the limit; lines from 1."""
    found, begun, size, lines = [], 0, 0, text.split("\n")
    if lines and lines[-1] == "":
        lines.pop()

    def push(end: int) -> None:
        last = end
        while last > begun and not lines[last - 1].strip():
            last -= 1
        if last > begun:
            found.append((begun + 1, last, "\n".join(lines[begun:last])))

    for i, line in enumerate(lines):
        n = len(line.encode()) + 1
        if size and size + n > hard or (size >= target and not line.strip()):
            push(i)
            begun, size = (i, 0) if line.strip() else (i + 1, -n)  # the blank line itself is dropped
        size += n
    push(len(lines))
    return found


_ATX = re.compile(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)\s*$")
_LINK = re.compile(r"https?://[^\s<>()\[\]\"'`]+")


def headings(lines: list[str]) -> list[tuple[int, int, str]]:
    """(line index, level, title) of ATX and setext headings outside fences."""
    found, fence = [], None
    for i, line in enumerate(lines):
        if m := re.match(r"^ {0,3}(```+|~~~+)", line):
            fence = None if fence and m[1][0] == fence else fence or m[1][0]
            continue
        if fence:
            continue
        if m := _ATX.match(line):
            found.append((i, len(m[1]), m[2]))
        elif (m := _SETEXT.match(line)) and i and lines[i - 1].strip() and not _ATX.match(lines[i - 1]) and (not found or found[-1][0] != i - 1):
            found.append((i - 1, 1 if m[1][0] == "=" else 2, lines[i - 1].strip()))
    return found


def decompose(text: str) -> list[Sprout]:
    """Nested sections of a text with headings; links hang on the deepest section. Without headings: chunks.

    A section's text runs to the next heading of any level, its extent over all below it.
    """
    lines = text.replace("\r\n", "\n").split("\n")
    marks = headings(lines)
    if not marks:
        return [_linked(Sprout("text/plain", t, first=a, last=b)) for a, b, t in chunks("\n".join(lines))]
    top: list[Sprout] = []
    if any(x.strip() for x in lines[: marks[0][0]]):
        top.append(_linked(Sprout("text/markdown", "\n".join(lines[: marks[0][0]]).strip("\n"), first=1, last=marks[0][0])))
    stack: list[tuple[int, Sprout]] = []
    for k, (at, level, _) in enumerate(marks):
        end = marks[k + 1][0] if k + 1 < len(marks) else len(lines)
        over = next((a for a, other, _ in marks[k + 1 :] if other <= level), len(lines))
        section = _linked(Sprout("text/markdown", "\n".join(lines[at:end]).strip("\n"), first=at + 1, last=over))
        while stack and stack[-1][0] >= level:
            stack.pop()
        (stack[-1][1].below if stack else top).append(section)
        stack.append((level, section))
    return top


def _linked(section: Sprout) -> Sprout:
    for link in dict.fromkeys(x.rstrip(".,;:!?") for x in _LINK.findall(section.text or "")):
        section.below.append(Sprout("text/uri-list", link, "links-to", section.first, section.last, link))
    return section


def directory(text: str) -> list[Sprout]:
    """An entry for each listed child; its line is its index and 2, behind the head."""
    rows = [x.split("\t") for x in text.split("\n")[1:]]
    return [Sprout(f"{DERIVED}entry", r[0], "contains", i + 2, i + 2, r[0]) for i, r in enumerate(rows) if len(r) == 3]


def summarize(text: str, most: int = 400) -> list[Sprout]:
    """A summary, and its keywords if it isn't verbatim."""
    told, how = E.summary(text, most)
    if how == "empty":
        return []
    out = [Sprout(f"{DERIVED}summary;provenance={how}", told, "derives")]
    if how != "verbatim" and (words := E.keywords(text)):
        out.append(Sprout(f"{DERIVED}keywords", ", ".join(words), "derives"))
    return out


#: The registry: (name, claims(mimetype, is_root), apply). Structural transforms come before enrichment.
TRANSFORMS: list[tuple[str, Callable[[str, bool], bool], Callable[[str], list[Sprout]]]] = [
    ("sections", lambda m, root: root and m.startswith("text/") and not m.startswith(DERIVED) and m != "text/uri-list", decompose),
    ("directory", lambda m, root: root and m == "inode/directory", directory),
    ("summary", lambda m, root: root and (m.startswith("text/") or m == "message/rfc822"), summarize),
]


def plan(mimetype: str | None, text: str | None, transforms=None, depth: int = DEPTH, most: int = FRAGMENTS) -> list[tuple]:
    """(pos, parent, relation, mimetype, text, first, last, address), parents before children; the root is at 0.

    Parameters of the content type are kept; a claim sees its essence. Derived fragments are
    never taken apart again. What lies below the depth or behind the budget is cut.
    """
    kind = (mimetype or "application/octet-stream").lower()
    out = [(0, None, None, kind, None, None, None, None)]
    work = [(0, kind, text, True, 0)]
    while work:
        at, kind, body, root, level = work.pop(0)
        if not body or level >= depth or kind.startswith(DERIVED):
            continue
        for _, claims, apply in transforms or TRANSFORMS:
            if not claims(kind.split(";")[0].strip(), root):
                continue
            plant = [(at, s, level + 1) for s in apply(body)]
            while plant:
                parent, s, deep = plant.pop(0)
                if len(out) >= most or deep > depth:
                    continue
                pos = len(out)
                out.append((pos, parent, s.relation, s.mimetype, s.text, s.first, s.last, s.address))
                plant[0:0] = [(pos, b, deep + 1) for b in s.below]
                work.append((pos, s.mimetype, s.text, False, deep))
    return out


SUBTREE = "source long, pos int, parent int, relation string, mimetype string, text string, first int, last int, address string"


def subtrees(documents: DataFrame, key: str = "doc_id", text: str = "text", mimetype: str = "mimetype") -> DataFrame:
    """The flattened subtree of every source; the id of a fragment is source * 1000 + pos.

    A source without text has its root only.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                rows = [(k, *r) for k, t, m in zip(*(c.to_pylist() for c in part.columns)) for r in plan(m, t)]
                columns = list(zip(*rows)) or [[] for _ in range(9)]
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split(" ")[0] for f in SUBTREE.split(", ")])

    picked = documents.select(F.col(key).cast("long").alias("k"), F.col(text).alias("t"), F.col(mimetype).alias("m"))
    return spread(picked).mapInArrow(run, SUBTREE)


def summarized(documents: DataFrame, key: str = "doc_id", text: str = "text", most: int = 400) -> DataFrame:
    """(doc_id, summary, provenance) of every text; null and blank ones give an empty summary."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                told = [E.summary(t, most) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([s for s, _ in told], pa.string()), pa.array([p for _, p in told], pa.string())], names=["doc_id", "summary", "provenance"])

    return spread(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))).mapInArrow(run, "doc_id long, summary string, provenance string")


def keyworded(documents: DataFrame, key: str = "doc_id", text: str = "text", most: int = 8) -> DataFrame:
    """(doc_id, keywords) of every text; null and blank ones have none."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([E.keywords(t, most) for t in part.column(1).to_pylist()], pa.list_(pa.string()))], names=["doc_id", "keywords"])

    return spread(documents.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("t"))).mapInArrow(run, "doc_id long, keywords array<string>")


def fragments_of(trees: DataFrame) -> DataFrame:
    """(id, source, mimetype, text, extent, content_address) as they are stored."""
    extent = F.when(F.col("first").isNotNull(), F.struct(F.lit("lines").alias("unit"), F.col("first").cast("long").alias("first_pos"), F.col("last").cast("long").alias("last_pos")))
    return trees.select((F.col("source") * 1000 + F.col("pos")).alias("id"), "source", "mimetype", "text", extent.alias("extent"), F.col("address").alias("content_address"))


def edges_of(trees: DataFrame) -> DataFrame:
    """(src, kind, dst) of the subtrees."""
    return trees.where("parent IS NOT NULL").select((F.col("source") * 1000 + F.col("parent")).alias("src"), F.col("relation").alias("kind"), (F.col("source") * 1000 + F.col("pos")).alias("dst"))


def stamps(documents: DataFrame, dials: str = "v1") -> DataFrame:
    """(doc_id, stamp): which transforms take part in a source, and with what dials; a change makes it dirty."""
    m = F.lower(F.trim(F.substring_index(F.coalesce("mimetype", F.lit("application/octet-stream")), ";", 1)))
    textual = m.startswith("text/") & ~m.startswith(DERIVED) & (m != "text/uri-list")
    names = F.array(F.when(m == "inode/directory", "directory"), F.when(textual, "sections"), F.when(m.startswith("text/") | (m == "message/rfc822"), "summary"))
    return documents.select("doc_id", F.sha2(F.concat_ws("|", F.array_sort(F.array_compact(names)), F.lit(dials)), 256).alias("stamp"))


def anchors(needles: DataFrame, rows: DataFrame) -> DataFrame:
    """(source, needle, id): fragments of the same source that contain a needle, whatever the case; else its own input.

    needles: (source, needle, input); rows: (source, id, text). The substring test runs
    inside an equi-join on the source.
    """
    met = needles.join(rows.select("source", "id", F.lower("text").alias("_t")), "source").where(F.contains(F.col("_t"), F.lower("needle"))).select("source", "needle", "id")
    missed = needles.join(met.select("source", "needle").distinct(), ["source", "needle"], "left_anti").select("source", "needle", F.col("input").alias("id"))
    return met.union(missed).distinct()


def deepest(points: DataFrame, spans: DataFrame, block: int = 64) -> DataFrame:
    """(source, at, id): for each point the narrowest span of its source that holds it. points: (source, at); spans: (source, id, first, last).

    Spans are cut into blocks of positions, so a point meets the spans of its own block only.
    """
    of = spans.where("first <= last").withColumn("_b", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))))
    held = points.select("source", "at", F.floor(F.col("at") / block).alias("_b")).join(of, ["source", "_b"]).where(F.col("at").between(F.col("first"), F.col("last")))
    return held.groupBy("source", "at").agg(F.min(F.struct((F.col("last") - F.col("first")).alias("w"), F.col("id").alias("id"))).getField("id").alias("id"))
