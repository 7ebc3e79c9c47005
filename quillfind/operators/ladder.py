"""The discovery ladder: query, expand, scan and fetch, and the find session over them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfind.functions import text as X

#: Bounds of a query, a scan and a session.
QUERY_MOST, SCAN_LINES, ACTIONS, RETAINED, BUDGET = 50, 2000, 8, 100, 24_000


def clamp(limit: int, most: int = QUERY_MOST) -> int:
    return max(1, min(limit, most))


def scan(rows: DataFrame, start: int, end: int, key: str = "id", text: str = "text") -> DataFrame:
    """(id, first, last, content) of lines start..end of each text, at most 2,000 of them; texts without such lines are left out."""
    if not 1 <= start <= end:
        raise ValueError("lines are counted from 1, and the end doesn't come before the start")
    end = min(end, start + SCAN_LINES - 1)
    cut = X.slice_lines(F.col(text), start, end)
    return rows.select(F.col(key).alias("id"), F.lit(start).alias("first"), F.least(F.lit(end), X.count_lines(F.col(text))).alias("last"), cut.alias("content")).where("content IS NOT NULL")


def stand_ins(fragments: DataFrame) -> DataFrame:
    """(source, id, text): the longest text of each source that isn't derived; of equally long ones the last."""
    rows = fragments.where((F.length("text") > 0) & F.col("source").isNotNull() & ~F.col("mimetype").startswith(X.DERIVED))
    return rows.groupBy("source").agg(F.max(F.struct(F.length("text").alias("n"), "id", "text")).alias("m")).select("source", "m.id", "m.text")


def fetch(rows: DataFrame, ids: list[int], key: str = "id") -> DataFrame:
    """Whole texts by id; what has no text is left out."""
    return rows.where(F.col(key).isin(*ids) & F.col("text").isNotNull())


def fetch_bytes(rows: DataFrame, first: int, end: int, key: str = "id", text: str = "text") -> DataFrame:
    """(id, first, end, content): bytes first..end of each text in UTF-8, from 0, the end exclusive; texts that end before are left out."""
    if not 0 <= first < end:
        raise ValueError("bytes are counted from 0, and the end comes behind the start")
    raw = F.encode(F.col(text), "UTF-8")
    size = F.octet_length(F.col(text))
    part = F.substring(raw, first + 1, end - first)
    return rows.where(size > first).select(F.col(key).alias("id"), F.lit(first).cast("long").alias("first"), F.least(F.lit(end), size).cast("long").alias("end"), part.alias("content"))


def summaries(fragments: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(source, summary): the summary that derives from each root; of several the one of the lowest id. roots: (source, root)."""
    told = fragments.where(F.col("mimetype").startswith(f"{X.DERIVED}summary")).select(F.col("id").alias("dst"), "text")
    return roots.join(edges.where("kind = 'derives'"), F.col("root") == F.col("src")).join(told, "dst").groupBy("source").agg(F.min_by("text", "dst").alias("summary"))


class Bus:
    """Guards that may refuse an operation, waterfalls that may change a value, and listeners that are told."""

    def __init__(self) -> None:
        self.guards: list[Callable] = []
        self.steps: list[Callable] = []
        self.listeners: list[Callable] = []

    def check(self, operation: str, **about) -> None:
        for guard in self.guards:
            if (reason := guard(operation, **about)) is not None:
                raise PermissionError(reason)

    def pass_through(self, value):
        for step in self.steps:
            value = step(value)
        return value

    def tell(self, event: str, **about) -> None:
        for listener in self.listeners:
            listener(event, **about)


@dataclass
class Session:
    """A find session: a bounded set of candidates with stable numbers, and a budget of characters."""

    bus: Bus = field(default_factory=Bus)
    known: dict[str, int] = field(default_factory=dict)
    spent: int = 0

    def retain(self, addresses: list[str]) -> dict[str, int]:
        """The numbers of candidates; known ones keep theirs, and beyond 100 new ones are not taken up."""
        for a in addresses:
            if a not in self.known and len(self.known) < RETAINED:
                self.known[a] = len(self.known) + 1
        return {a: self.known[a] for a in addresses if a in self.known}

    def act(self, actions: list[Callable[[], str]]) -> list[str]:
        """Up to 8 actions in order, while the budget lasts; the last text is cut to what is left."""
        if len(actions) > ACTIONS:
            raise ValueError(f"at most {ACTIONS} actions")
        out = []
        for action in actions:
            self.bus.check("find")
            if self.spent >= BUDGET:
                break
            told = action()[: BUDGET - self.spent]
            self.spent += len(told)
            out.append(told)
        return out

    @staticmethod
    def window(text: str, start: int, most: int, digest: str | None = None) -> tuple[str, int, str]:
        """(lines from `start` that fit into `most` characters, next line or 0, digest of the text).

        With a digest of another text the window is refused: the text has changed between
        two scans. The longest run that fits is found by binary search over line offsets.
        """
        now = hashlib.sha256(text.encode()).hexdigest()
        if digest is not None and digest != now:
            raise ValueError("the text has changed")
        lines = text.split("\n")
        ends, total = [], 0
        for line in lines[start - 1 :]:
            total += len(line) + 1
            ends.append(total - 1)
        low, high = 0, len(ends)
        while low < high:
            middle = (low + high + 1) // 2
            if ends[middle - 1] <= most:
                low = middle
            else:
                high = middle - 1
        return "\n".join(lines[start - 1 : start - 1 + low]), (start + low if low and start - 1 + low < len(lines) else 0), now
