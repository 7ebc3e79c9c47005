"""Splitting oversized texts at natural boundaries (problem 7).

Per text: prefix sums of the bytes of its characters and a sorted array of natural
boundaries, each with a rank (paragraph, line, sentence, word). A binary search finds the
last boundary of the best rank under the limit; the next piece steps back by the overlap,
again to a boundary; where there is none the cut is hard, but never inside a character.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 3200, 200

#: Natural boundaries from the strongest to the weakest; a cut is at the end of a match.
BOUNDARIES = (
    r"\r?\n[ \t]*\r?\n\s*",
    r"\r?\n",
    r"[.!?…][\"'”’)\]]*\s+|[。！？؟।]+",
    r"\s+",
)
_PATTERNS = tuple(re.compile(p) for p in BOUNDARIES)


def _prefix(text: str) -> np.ndarray:
    """Bytes in UTF-8 before each character, and of the whole."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    width = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
    return np.concatenate(([0], np.cumsum(width)))


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(first char, end char, first byte, end byte) of each piece; the text must be well-formed.

    Every piece takes at most `limit` bytes; together they cover the text; each but the
    first starts about `overlap` bytes (at most) before the end of the one before.
    """
    byte = _prefix(text)
    if byte[-1] <= limit:
        return [(0, len(text), 0, int(byte[-1]))]
    if limit < 8 or not 0 <= overlap <= limit // 2:
        raise ValueError("limit must be 8 at least and overlap at most half of it")
    ends = [[m.end() for m in p.finditer(text)] for p in _PATTERNS]
    found, start = [], 0
    while True:
        hard = int(np.searchsorted(byte, byte[start] + limit, "right")) - 1  # last char offset within the limit
        if hard >= len(text):
            found.append((start, len(text), int(byte[start]), int(byte[-1])))
            return found
        # a boundary in the first half would leave a sliver; beyond that the strongest kind wins
        least = int(np.searchsorted(byte, byte[start] + max(limit // 2, overlap + 4), "left"))
        end = hard
        for marks in ends:
            at = bisect_right(marks, hard) - 1
            if at >= 0 and marks[at] >= least:
                end = marks[at]
                break
        found.append((start, end, int(byte[start]), int(byte[end])))
        back = int(np.searchsorted(byte, byte[end] - overlap, "left"))
        start = back
        for marks in ends[2:] if overlap else ():
            at = bisect_left(marks, back)
            if at < len(marks) and marks[at] < end and byte[end] - byte[marks[at]] >= overlap // 2:
                start = marks[at]
                break


#: Bytes of text put out at a time, besides a text's own.
OUT_BYTES = 8 << 20


def _split(limit: int, overlap: int):
    def put(ids, numbers, texts, first, last):
        return pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
            names=["id", "piece_no", "text", "first_pos", "last_pos"],
        )

    def run(batches):
        for batch in batches:
            columns, size = ([], [], [], [], []), 0
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (a, b, x, y) in enumerate(pieces(text, limit, overlap), 1):
                    for column, value in zip(columns, (key, k, text[a:b], x, y)):
                        column.append(value)
                    size += y - x
                    if size > OUT_BYTES:
                        yield put(*columns)
                        columns, size = ([], [], [], [], []), 0
            if columns[0]:
                yield put(*columns)

    return run


def split_oversized(rows: DataFrame, key: str = "id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(id, piece_no, text, extent) of every text of more than `limit` bytes.

    extent is {unit: bytes, first_pos, last_pos}, from 0, its end exclusive, in the text
    itself. Null, empty and small texts give no piece. Repeated rows give their pieces
    again. A text without any boundary is cut hard between characters.
    """
    large = rows.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    cut = large.mapInArrow(_split(limit, overlap), "id long, piece_no int, text string, first_pos long, last_pos long")
    extent = F.struct(F.lit("bytes").alias("unit"), "first_pos", "last_pos").alias("extent")
    return cut.select("id", "piece_no", "text", extent)
