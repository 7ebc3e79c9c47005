"""Connectors: the filesystem, and paged services through the Python data source API."""

from __future__ import annotations

import ipaddress
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillfind.functions import text as X

#: Fixed value: files that hold patterns of what is not to be read.
IGNORE_FILE = ".gitignore"


def admitted(scope: str, roots: list[str]) -> str:
    """The scope as an absolute path inside one of the roots; anything else is refused."""
    if ".." in scope.split("/"):
        raise ValueError(f"{scope!r} leaves its root")
    path = os.path.abspath(scope)
    for root in map(os.path.abspath, roots):
        if path == root or path.startswith(root + os.sep):
            return path
    raise ValueError(f"{scope!r} lies in no configured root")


def _below(root: str):
    """The path of a file below a folder of any filesystem: schemes and authorities are left out."""
    base = re.sub(r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", "", root if "://" in root or root.startswith("file:") else os.path.abspath(root)).rstrip("/")
    return F.regexp_replace(F.regexp_replace("path", r"^[a-zA-Z][a-zA-Z0-9+.-]*:(?://[^/]*)?", ""), "^" + re.escape(base) + "/*", "")


def _rules(lines: list[str]) -> list[tuple[int, bool, str]]:
    """(order, whether it is a negation, pattern below the folder) of the lines of an ignore file.

    A pattern with a slash inside is of the folder itself, any other of whatever lies below.
    """
    found = []
    for i, line in enumerate(lines):
        glob = line.rstrip()
        if not glob.strip() or glob.startswith("#"):
            continue
        negated = glob.startswith("!")
        glob = glob[1:] if negated else glob.removeprefix("\\")
        anchored = "/" in glob.rstrip("/")
        glob = glob.strip("/")
        if glob:
            found.append((i, negated, X.glob_regex(glob if anchored else f"**/{glob}")))
    return found


def ignored_paths(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """(locator) of the paths that ignore rules leave out.

    rules: (folder, order, negated, pattern). On each path and each folder above it the last
    rule decides, of the deepest folder that has one, that matches it below its own folder;
    what lies in a folder that is left out can't be taken in again.
    """
    parts = F.split("locator", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    prefixes = paths.select("locator", F.explode(above).alias("p"))
    own = F.split("p", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(own) - 1), lambda n: F.struct(F.array_join(F.slice(own, F.lit(1), n), "/").alias("folder"), n.alias("depth")))
    held = prefixes.select("p").distinct().select("p", F.explode(folders).alias("f")).select("p", "f.folder", "f.depth").join(rules, "folder")
    below = F.expr("CASE WHEN folder = '' THEN p ELSE substring(p, length(folder) + 2) END")
    last = held.where(F.rlike(below, F.col("pattern"))).groupBy("p").agg(F.max_by("negated", F.struct("depth", "order")).alias("negated"))
    return prefixes.join(last.where("NOT negated").select("p"), "p", "left_semi").select("locator").distinct()


def enumerate_files(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(locator, content_type, raw_bytes, modified) of the files below a folder, without their contents.

    Hidden files and folders, empty files, and what the patterns or the ignore files of the
    folder and those below match are left out. Only the metadata columns are read, and the
    contents of ignore files.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select(_below(root).alias("locator"), "length", "modificationTime")
    kept = files.where((F.col("length") > 0) & ~F.col("locator").rlike(r"(^|/)\."))
    schema = "folder string, order int, negated boolean, pattern string"

    uri = root if "://" in root else "file://" + os.path.abspath(root.removeprefix("file:"))

    def parse(batches):
        from pyarrow import fs

        # hidden files aren't listed, so each folder is asked for its own; any filesystem will do
        system, base = fs.FileSystem.from_uri(uri)
        for batch in batches:
            rows = []
            for folder in batch.column(0).to_pylist():
                path = "/".join(x for x in (base.rstrip("/"), folder, IGNORE_FILE) if x)
                if system.get_file_info(path).type == fs.FileType.File:
                    with system.open_input_stream(path) as f:
                        rows += [(folder, *r) for r in _rules(f.readall().decode("utf-8", "replace").splitlines())]
            columns = list(zip(*rows)) or [()] * 4
            kinds = (pa.string(), pa.int32(), pa.bool_(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["folder", "order", "negated", "pattern"])

    parts = F.split("locator", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    rules = kept.select(F.explode(above).alias("folder")).distinct().mapInArrow(parse, schema)
    if patterns:
        rules = rules.union(spark.createDataFrame([("", i - len(patterns), n, p) for i, n, p in _rules(patterns)], schema))
    kept = kept.join(ignored_paths(kept.select("locator"), rules), "locator", "left_anti")
    return kept.select("locator", X.detect_type(F.col("locator")).alias("content_type"), F.col("length").alias("raw_bytes"), F.unix_seconds("modificationTime").alias("modified"))


def read_texts(spark: SparkSession, root: str) -> DataFrame:
    """(locator, text): contents as text; what is no UTF-8 is replaced."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    decode = F.udf(lambda b: bytes(b).decode("utf-8", "replace"), "string", useArrow=True)
    return files.select(_below(root).alias("locator"), decode("content").alias("text"))


def public_host(pattern: str, host: str) -> bool:
    """Whether a host matches an allow-list pattern: itself, or *.domain below a domain."""
    host, pattern = host.lower().rstrip("."), pattern.lower()
    return host.endswith(pattern[1:]) and host != pattern[2:] if pattern.startswith("*.") else host == pattern


def public_address(address: str) -> bool:
    """An address on the public network: not private, local, reserved or multicast."""
    ip = ipaddress.ip_address(address)
    return ip.is_global and not ip.is_multicast


def web_address(url: str) -> tuple[str, str] | None:
    """(host, locator) of an http(s) URL; the locator keeps scheme and path."""
    m = re.match(r"^(https?)://([^/?#\s:@]+)(?::\d+)?([/?#]\S*)?$", url)
    return (f"web-{m[2].lower()}", f"{m[1]}/{m[2].lower()}{m[3] or ''}") if m else None


def url_of(locator: str) -> str:
    scheme, _, rest = locator.partition("/")
    return f"{scheme}://{rest}"


class PagedSource(DataSource):
    """Pages of a service as rows (page, item): format "paged".

    Options: path (a folder of archived pages, each a JSON object with a list of items and
    the name of the next page), first, items (the key of the list), pages_max, items_max.
    Each chain of pages is one partition, followed to its end or the ceilings.
    """

    @classmethod
    def name(cls) -> str:
        return "paged"

    def schema(self) -> str:
        return "page string, item string"

    def reader(self, schema) -> DataSourceReader:
        return _PagedReader(dict(self.options))


class _Chain(InputPartition):
    def __init__(self, first: str):
        self.first = first


class _PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options

    def partitions(self) -> list[InputPartition]:
        return [_Chain(x.strip()) for x in self.options.get("first", "0.json").split(",")]

    def read(self, partition: _Chain) -> Iterator[tuple]:
        key = self.options.get("items", "items")
        pages, items = int(self.options.get("pages_max", 1000)), int(self.options.get("items_max", 1_000_000))
        page = partition.first
        while page and pages > 0:
            with open(os.path.join(self.options["path"], os.path.basename(page))) as f:
                body = json.load(f)
            for item in body.get(key, []):
                if items <= 0:
                    raise ValueError(f"more items than items_max behind {partition.first}")
                items -= 1
                yield page, json.dumps(item, sort_keys=True)
            page, pages = body.get("nextPageToken"), pages - 1
        if page:
            raise ValueError(f"more pages than pages_max behind {partition.first}")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PagedSource)
