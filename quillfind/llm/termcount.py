"""Frequency of every distinct value (problem 3), by last-seen counters.

Tokens are hash-partitioned and each partition is read in the order (term, record).
One pass keeps, per term, its occurrences, its records and the last record seen: a
record counts once because its sightings stand together, so no set of records is kept.
Sightings are shuffled once, after those of one batch have been added up.

The hash is over (term, slice of the record), so a term that holds a third of all rows
is spread over `slices` partitions; a record of a term lies in one slice only, so the
partial counters of a term add up exactly.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slices of one term's records.
SLICES = 16


_BLANK = re.compile(r"\s+")


def normal(value: str | None) -> str | None:
    """Lower case, NFC, blanks (any Unicode space) trimmed and collapsed to one space; blank gives None."""
    if value is None:
        return None
    if value.isascii():
        return " ".join(value.lower().split()) or None
    # lower case may leave decomposed letters behind, so compose last
    return _BLANK.sub(" ", unicodedata.normalize("NFC", unicodedata.normalize("NFC", value).lower())).strip() or None


def _terms(batches):
    """(value, record) -> (term, record, n), sightings of one batch added up."""
    for batch in batches:
        coded = batch.column(0).dictionary_encode()
        terms: dict[str, int] = {}
        code = np.array([-1 if (t := normal(v)) is None else terms.setdefault(t, len(terms)) for v in coded.dictionary.to_pylist()] + [-1], np.int64)
        own = code[coded.indices.fill_null(len(code) - 1).to_numpy(zero_copy_only=False)]
        given = own >= 0
        own, record = own[given], batch.column(1).to_numpy(zero_copy_only=False)[given]
        if not len(own):
            continue
        order = np.lexsort((record, own))
        own, record = own[order], record[order]
        begins = np.flatnonzero(np.r_[True, (own[1:] != own[:-1]) | (record[1:] != record[:-1])])
        names = pa.array(list(terms), pa.string()).take(pa.array(own[begins]))
        yield pa.RecordBatch.from_arrays([names, pa.array(record[begins], pa.int64()), pa.array(np.diff(np.r_[begins, len(own)]), pa.int64())], names=["_t", "_r", "_n"])


def _count(batches):
    """Last-seen counters over sorted rows: (term, record, n) -> (term, rows, records)."""
    term, last, rows, records = None, None, 0, 0
    for batch in batches:
        if batch.num_rows == 0:
            continue
        coded = batch.column(0).dictionary_encode()
        code = coded.indices.to_numpy(zero_copy_only=False)
        record = batch.column(1).to_numpy(zero_copy_only=False)
        n = batch.column(2).to_numpy(zero_copy_only=False)
        begins = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        fresh = np.r_[True, (code[1:] != code[:-1]) | (record[1:] != record[:-1])].astype(np.int64)
        values = coded.dictionary.take(pa.array(code[begins])).to_pylist()
        # the batch may go on with the term, and even the record, the one before ended with
        fresh[0] = not (values[0] == term and record[0] == last)
        sums, seen = np.add.reduceat(n, begins), np.add.reduceat(fresh, begins)
        if values[0] == term:
            sums[0] += rows
            seen[0] += records
        elif term is not None:
            yield pa.RecordBatch.from_arrays([pa.array([term]), pa.array([rows]), pa.array([records])], names=["normalized", "n_rows", "n_records"])
        term, last, rows, records = values[-1], record[-1], int(sums[-1]), int(seen[-1])
        if len(values) > 1:
            yield pa.RecordBatch.from_arrays(
                [pa.array(values[:-1], pa.string()), pa.array(sums[:-1], pa.int64()), pa.array(seen[:-1], pa.int64())],
                names=["normalized", "n_rows", "n_records"],
            )
    if term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([term]), pa.array([rows]), pa.array([records])], names=["normalized", "n_rows", "n_records"])


def frequencies(rows: DataFrame, record: str = "fragment", value: str = "normalized", slices: int = SLICES) -> DataFrame:
    """(normalized, n_rows, n_records): every distinct value with its sightings and records.

    Null and blank values are none. A null record is one record of its own. Repeated rows
    count as rows, not as records. An empty table gives no rows; other columns are ignored.
    """
    given = rows.select(F.col(value).alias("_v"), F.coalesce(F.col(record).cast("long"), F.lit(-(2**63))).alias("_r")).where(F.col("_v").isNotNull())
    pairs = given.mapInArrow(_terms, "_t string, _r long, _n long")
    spread = pairs.repartition("_t", F.pmod(F.xxhash64("_r"), F.lit(slices)))
    counted = spread.sortWithinPartitions("_t", "_r").mapInArrow(_count, "normalized string, n_rows long, n_records long")
    return counted.groupBy("normalized").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_records").alias("n_records"))


def marked(
    rows: DataFrame,
    record: str = "fragment",
    value: str = "normalized",
    rare: int = 1,
    common: float = 0.05,
    slices: int = SLICES,
) -> DataFrame:
    """`frequencies` with document_frequency = n_records and a mark: rare, common or null.

    rare: in at most `rare` records. common: in more than the share `common` of the records
    that have any value. A value that is both is rare.
    """
    counted = frequencies(rows, record, value, slices)
    # a value is present if a character is left once blanks are gone
    total = (
        rows.where(F.col(value).rlike(r"[^\s\p{Z}\x1c-\x1f\x85]"))
        .select(F.coalesce(F.col(record).cast("long"), F.lit(-(2**63))).alias("_r"))
        .distinct()
        .agg(F.count("*").alias("_total"))
    )
    mark = F.when(F.col("n_records") <= rare, "rare").when(F.col("n_records") > F.col("_total") * common, "common")
    # one row is joined to all: the broadcast side is a global aggregate
    return counted.join(F.broadcast(total)).select("normalized", "n_rows", F.col("n_records").alias("document_frequency"), mark.alias("mark"))
