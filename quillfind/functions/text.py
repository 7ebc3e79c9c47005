"""Text functions as Column expressions: JVM-side, inside whole-stage code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Frequent English words that carry no topic. A parameter wherever it is used.
STOP_WORDS = tuple(
    "a about above after again against all also am an and any are as at be because been before being below between both but by can cannot could did do does doing down during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your yours yourself yourselves".split()
)

#: Content types by file extension.
EXTENSIONS = {
    "md": "text/markdown", "markdown": "text/markdown", "txt": "text/plain", "text": "text/plain", "log": "text/plain", "html": "text/html", "htm": "text/html",
    "csv": "text/csv", "json": "application/json", "xml": "application/xml", "yaml": "application/yaml", "yml": "application/yaml", "toml": "application/toml",
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif", "webp": "image/webp", "wav": "audio/wav",
    "mp3": "audio/mpeg", "mp4": "video/mp4", "eml": "message/rfc822", "ics": "text/calendar", "vcf": "text/vcard",
}

#: Extensions of source code and settings, read as plain text.
CODE = ("bash", "c", "canvas", "cc", "cfg", "conf", "cpp", "cs", "css", "env", "fish", "go", "h", "hpp", "ini", "java", "js", "jsx", "kt", "lock", "lua", "php", "pl", "py", "rb", "rs", "scala", "sh", "sql", "swift", "ts", "tsx", "zsh")

#: Structured types that are text all the same.
TEXTUAL = ("application/json", "application/xml", "application/yaml", "application/toml", "application/javascript", "application/x-sh", "application/sql", "application/rtf", "message/rfc822")

DERIVED = "text/x-derived-"


def collapse_ws(c: Column) -> Column:
    """Runs of blanks (any Unicode space) become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def truncate_chars(c: Column, most: int) -> Column:
    """At most `most` characters; a longer text ends with an ellipsis in place of its last ones."""
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.rtrim(F.substring(c, 1, most - 1)), F.lit("…")))


def preview(c: Column, most: int = 280) -> Column:
    return truncate_chars(collapse_ws(c), most)


def lines(c: Column) -> Column:
    """The lines of a text: a newline at the end adds none, a carriage return before one is dropped."""
    parts = F.split(c, "\n", -1)
    cut = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(cut, lambda x: F.regexp_replace(x, "\r$", ""))


def count_lines(c: Column) -> Column:
    return F.size(lines(c))


def slice_lines(c: Column, start: Column | int, end: Column | int) -> Column:
    """Lines start..end, from 1, inclusive; the end is clamped. Null for 0, an inverted range, or one beyond the end."""
    start, end = (x if isinstance(x, Column) else F.lit(x) for x in (start, end))
    every = lines(c)
    fits = (start >= 1) & (end >= start) & (start <= F.size(every))
    return F.when(fits, F.array_join(F.slice(every, start, F.least(end, F.size(every)) - start + 1), "\n"))


def normalize_spelling(c: Column) -> Column:
    return F.lower(collapse_ws(c))


def words(c: Column) -> Column:
    """Runs of letters and digits in lower case: the tokens of the full-text index."""
    return F.filter(F.split(F.lower(c), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def strip_stopwords(c: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Tokens that are no stop words; all of them if nothing else is left."""
    every = words(c)
    kept = F.filter(every, lambda w: ~w.isin(*stop))
    return F.when(F.size(kept) > 0, kept).otherwise(every)


def strip_html(c: Column) -> Column:
    """Text of an HTML page: scripts and styles dropped, block tags as line ends, six entities, lines collapsed."""
    out = F.regexp_replace(c, r"(?is)<(script|style)\b.*?</\1\s*>", " ")
    out = F.regexp_replace(out, r"(?is)<!--.*?-->", " ")
    out = F.regexp_replace(out, r"(?i)</?(?:p|div|br|li|ul|ol|tr|table|h[1-6]|blockquote|section|article|header|footer|pre|hr)\b[^>]*>", "\n")
    out = F.regexp_replace(out, r"<[^>]*>", "")
    for entity, char in (("nbsp", " "), ("lt", "<"), ("gt", ">"), ("quot", '"'), ("#39", "'"), ("amp", "&")):
        out = F.replace(out, F.lit(f"&{entity};"), F.lit(char))
    out = F.regexp_replace(F.regexp_replace(out, r"[ \t\r\f]+", " "), r" ?\n ?", "\n")
    return F.trim(F.regexp_replace(F.regexp_replace(out, r"\n+", "\n"), r"^\n|\n$", ""))


def strip_links(c: Column) -> Column:
    """[text](target) becomes text."""
    return F.regexp_replace(c, r"\[([^\[\]]*)\]\([^()\s]*\)", "$1")


def sender_name(c: Column) -> Column:
    """Name of `Name <address>`; the address where there is no name."""
    name = F.trim(F.regexp_extract(c, r"^([^<]*)<[^>]*>", 1))
    return F.when(F.length(name) > 0, F.regexp_replace(name, '^"|"$', "")).otherwise(F.trim(F.regexp_replace(c, "[<>]", "")))


def essence(c: Column) -> Column:
    """A content type without parameters, in lower case."""
    return F.lower(F.trim(F.substring_index(c, ";", 1)))


def parameter(c: Column, key: str) -> Column:
    """The value of a parameter of a content type; null if it has none."""
    found = F.regexp_extract(c, rf'(?i);\s*{re.escape(key)}\s*=\s*"?([^;"]*)"?', 1)
    return F.when(F.length(found) > 0, F.trim(found))


def has_essence(c: Column, kind: str) -> Column:
    """The essence itself, or the essence with parameters; never a bare prefix."""
    return (c == kind) | c.startswith(f"{kind};")


def matches_pattern(c: Column, pattern: str) -> Column:
    """`family/*` or a whole essence."""
    kind = essence(c)
    return kind.startswith(pattern[:-1]) if pattern.endswith("/*") else kind == pattern


def patterns_overlap(a: str, b: str) -> bool:
    """Whether some content type matches both."""
    if a.endswith("/*") or b.endswith("/*"):
        return a.split("/")[0] == b.split("/")[0]
    return a == b


def is_textual(c: Column) -> Column:
    return essence(c).startswith("text/") | essence(c).isin(*TEXTUAL)


def detect_type(path: Column) -> Column:
    """Content type by extension: the table, then code as plain text, else bytes."""
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.when(extension.isin(*EXTENSIONS), F.try_element_at(table, extension)).when(extension.isin(*CODE), "text/plain").otherwise("application/octet-stream")


def host_id(kind: Column, principal: Column) -> Column:
    """kind- and 16 hex digits of a digest of kind and principal."""
    return F.concat(kind, F.lit("-"), F.substring(F.sha2(F.concat(kind, F.lit("\n"), F.lower(F.trim(principal))), 256), 1, 16))


def in_scope(locator: Column, prefix: str) -> Column:
    """The scope itself or below it; an empty scope covers all."""
    return F.lit(True) if prefix == "" else (locator == prefix) | locator.startswith(f"{prefix}/")


def glob_regex(glob: str, path: bool = True) -> str:
    """A glob as an anchored pattern: in paths * stops at /, ** doesn't; ? is one character; [..] a class."""
    out, i = "", 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and path:
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c == "*":
            out, i = out + ("[^/]*" if path else ".*"), i + 1
        elif c == "?":
            out, i = out + ("[^/]" if path else "."), i + 1
        elif c == "[" and "]" in glob[i + 2 :]:
            end = glob.index("]", i + 2)
            inner = glob[i + 1 : end]
            out, i = out + "[" + ("^" + inner[1:] if inner[0] == "!" else inner).replace("\\", "\\\\") + "]", end + 1
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def base64url(c: Column) -> Column:
    """Bytes of base64 with - and _, with or without padding."""
    plain = F.translate(F.regexp_replace(c, "=+$", ""), "-_", "+/")
    return F.unbase64(F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("=")))


def keyword_phrases(c: Column) -> Column:
    """Phrases parted by commas, semicolons or line ends, trimmed."""
    return F.filter(F.transform(F.split(c, r"[,;\n]"), lambda p: F.trim(p)), lambda p: p != "")


def vocabulary_tokens(c: Column) -> Column:
    """Words with the marks inside that belong to names: - _ . / '; at most 64 characters."""
    raw = F.split(c, r"[\s,;:!?()\[\]{}<>\"“”|=+*&^%$#@~`\\]+")
    trimmed = F.transform(raw, lambda w: F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return F.filter(trimmed, lambda w: (w != "") & (F.length(w) <= 64))


def shape_of(token: Column, stop: tuple[str, ...] = STOP_WORDS, common: tuple[str, ...] = ()) -> Column:
    """identifier, term, or null: what a token's form says it is.

    Without a letter or a stop word: null. With a digit, _ or /: identifier. With a capital
    inside, - or .: term. Of four letters at least and not among the common words: term.
    """
    low = F.lower(token)
    plain = F.length(token) >= 4
    return (
        F.when(~token.rlike(r"\p{L}") | low.isin(*stop), F.lit(None).cast("string"))
        .when(token.rlike(r"[\p{N}_/]"), "identifier")
        .when(token.rlike(r"[.-]") | token.rlike(r"^.+\p{Lu}"), "term")
        .when(plain & ~low.isin(*common) if common else plain, "term")
    )


def json_part(c: Column) -> Column:
    """What a model's reply holds from its first brace or bracket to the last."""
    return F.regexp_extract(c, r"(?s)([\[{].*[\]}])", 1)


def excerpts(c: Column, terms: Column, width: int = 320, stride: int = 160, best: int = 2) -> Column:
    """The windows of `width` characters that contain most of the terms, not overlapping, at most `best`.

    A list of (start, hits, text); ties go to the earlier window; without hits it is empty.
    """
    starts = F.sequence(F.lit(0), F.greatest(F.length(c) - 1, F.lit(0)), F.lit(stride))
    low = F.lower(c)
    scored = F.transform(
        starts,
        lambda s: F.struct(
            (-F.size(F.filter(terms, lambda t: F.contains(F.substring(low, s + 1, F.lit(width)), t)))).alias("miss"),
            s.alias("start"),
            F.substring(c, s + 1, F.lit(width)).alias("text"),
        ),
    )
    ranked = F.array_sort(F.filter(scored, lambda x: x["miss"] < 0))
    none = F.filter(ranked, lambda x: F.lit(False))
    apart = F.aggregate(
        ranked,
        none,
        lambda kept, x: F.when((F.size(kept) < best) & ~F.exists(kept, lambda k: F.abs(k["start"] - x["start"]) < width), F.concat(kept, F.array(x))).otherwise(kept),
    )
    return F.transform(apart, lambda x: F.struct(x["start"].alias("start"), (-x["miss"]).alias("hits"), x["text"].alias("text")))
