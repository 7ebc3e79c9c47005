"""Only the newly written text of a mail (problem 6).

Each mail is read once: a line grammar tells headers, quotes and the lines that introduce
them, forwarded mails, signatures, legal notices and postscripts, and all of the body is
cut into sentences, quoted ones without their marks. Sentences are fingerprinted by a
SimHash of 128 bits over their 3-grams of characters; near ones are retrieved through
Hamming partition tables, one for each byte of the fingerprint, and verified by edit
distance. Removed are

* inherited sentences: near an earlier one newly written by another sender, under the same
  subject and with a person in common;
* boilerplate of senders: sentences that close many mails of one sender or of several, and
  sentences near those.

The grammar decides what has no earlier copy and recurs nowhere. The tables are kept within
a conversation, and within classes of length, so that fingerprints may differ in many bits:
one changed word of a short sentence turns a dozen of them.
"""

from __future__ import annotations

import math
import re
from email.utils import parsedate_to_datetime

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfind.functions.session import written

#: Edits per character; what makes a sentence boilerplate: so many mails, of one sender so
#: large a share of all of them, and this share of its places at the end of a mail, two
#: places elsewhere supposed.
EDITS, BOILERPLATE, SENDER_SHARE, TAIL_SHARE = 0.1, 5, 0.2, 0.7
#: Bytes of a fingerprint, each the key of a table, and characters of an n-gram.
TABLES, GRAM = 16, 3
#: Rows of a few longs, or of a sentence, that are sent to all tasks at most; more are joined.
SENT = 1 << 17

#: Closing formulas, alone on their line.
CLOSINGS = frozenset(
    "best|best regards|best wishes|all the best|with best regards|with best wishes|regards|kind regards|warm regards|warmest regards|many regards|with kind regards|rgds|br|kr|cheers|thanks|many thanks|thank you|thanks a lot|thanks again|thanks and regards|thank you and regards|thx|yours|yours sincerely|yours truly|yours faithfully|sincerely|sincerely yours|respectfully|cordially|take care|love|talk soon|speak soon|ciao|"
    "mit freundlichen grüßen|mit freundlichen gruessen|freundliche grüße|viele grüße|liebe grüße|beste grüße|herzliche grüße|schöne grüße|mit besten grüßen|gruß|grüße|mfg|vg|lg|danke|vielen dank|besten dank|"
    "cordialement|bien cordialement|bien à vous|bien à toi|amicalement|salutations|meilleures salutations|sincères salutations|merci|merci beaucoup|à bientôt|"
    "saludos|un saludo|saludos cordiales|atentamente|cordialmente|un cordial saludo|un abrazo|gracias|muchas gracias|"
    "cordiali saluti|distinti saluti|saluti|un saluto|grazie|met vriendelijke groet|met vriendelijke groeten|vriendelijke groet|groet|groeten|groetjes|mvg|bedankt|atenciosamente|cumprimentos|abraços|obrigado|obrigada".split("|")
)

#: Notices of devices and mail programs.
_DEVICE = re.compile(
    r"^(?:sent (?:from|via|with|using) (?:my |the )?\S.{0,60}|get outlook for .{0,30}|.{2,30} mail for \w[\w ]{0,20}|(?:von meinem|gesendet von|gesendet mit) .{0,60}|von meinem .{0,40} gesendet|envoyé (?:de|depuis|avec) .{0,60}|enviado (?:desde|con) .{0,60}|inviato (?:da|con) .{0,60}|verzonden (?:vanaf|met|via) .{0,60})$",
    re.IGNORECASE,
)

#: Words that begin or mark a legal notice.
_LEGAL = re.compile(
    r"^(?:\W*(?:confidentiality (?:notice|note|statement)|disclaimer|legal notice|privileged (?:and|&) confidential|privacy notice|haftungsausschluss|vertraulichkeitshinweis|avis de confidentialité|aviso legal|aviso de confidencialidad|avvertenza|vrijwaring)\b"
    r"|this (?:e-?mail|message|communication|transmission)\b.{0,80}\b(?:confidential|privileged|intended|meant)\b|the (?:information|contents?)\b.{0,60}\b(?:confidential|privileged)\b"
    r"|please (?:consider|think of|think about)\b.{0,30}\b(?:environment|trees?|planet|nature)\b|(?:views?|opinions?)\b.{0,40}\b(?:of the (?:author|writer|sender)|not (?:of|those of))\b|if you (?:are not|have received|received)\b.{0,80}\b(?:recipient|error|mistake)\b"
    r"|(?:diese|die) (?:e-?mail|nachricht)\b.{0,60}\b(?:vertraulich|bestimmt)|ce (?:message|courriel|mail)\b.{0,60}\bconfidentiel|este (?:mensaje|correo)\b.{0,60}\bconfidencial|questo messaggio\b.{0,60}\b(?:riservat|confidenzial)|dit (?:bericht|e-?mail(?:bericht)?)\b.{0,60}\bvertrouwelijk)",
    re.IGNORECASE,
)

_HEADER = re.compile(r"^[*_]{0,2}(?:from|to|cc|bcc|subject|date|sent|reply-to|sender|message-id|in-reply-to|references|mime-version|content-[\w-]+|received|return-path|x-[\w-]+|importance|von|an|betreff|datum|gesendet|kopie|de|à|objet|envoyé|copie|para|asunto|fecha|enviado|da|a|oggetto|inviato|aan|onderwerp|verzonden|assunto|data)\s?:[*_]{0,2}(?:\s|$)", re.IGNORECASE)
_ADDRESSED = re.compile(r"^[*_]{0,2}(?:from|von|de|da|van)\s?:[*_]{0,2}\s*(?=.*(?:@|<|^\W*\w+\s?:\W*\S+ \S+\s*$))", re.IGNORECASE)
_FORWARD = re.compile(
    r"^\s*(?:[-_=*]{2,}\s*(?:original|forwarded|ursprüngliche|weitergeleitete|message d'origine|message (?:original|transféré)|mensaje (?:original|reenviado)|messaggio (?:originale|inoltrato)|oorspronkelijk|doorgestuurd|mensagem (?:original|encaminhada))[^-_=*]{0,40}[-_=*]{2,}|begin forwarded message:|anfang der weitergeleiteten (?:nachricht|e-?mail):|début du message (?:réexpédié|transféré)\s?:|inicio del mensaje reenviado:)\s*$",
    re.IGNORECASE,
)
_RULE = re.compile(r"^\s*(?:_{8,}|-{8,}|={8,})\s*$")
_SAID = r"(?:wrote|writes|said|schrieb|schreibt|schreef|a écrit|écrivait|escribió|ha scritto|scrisse|escreveu|skrev|napisał)"
_NUMBERS = r"(?=.*\d)"
_INTRO = re.compile(
    rf"^(?!.*[.!?]\s*$)\s*(?:{_NUMBERS}.*\b{_SAID}\b[^:]{{0,80}}:\s*$|.*\b{_SAID}\s+(?:on|am|le|el|il|op|em)\s.*\d.*:\s*$|.*<[^<>@\s]+@[^<>\s]+>\s*(?:{_SAID})?\s?:\s*$|(?=.*\d{{1,2}}:\d{{2}}).*@.*:\s*$)",
    re.IGNORECASE,
)
_INTRO_HEAD = re.compile(r"^\s*(?:on|am|le|el|il|op|em|den)\b.*\d", re.IGNORECASE)
_QUOTED = re.compile(r"^\s*(?:>(?!=)(?!\s*=\s)|\|(?:\s|$|[^\s|]))")
_PS = re.compile(r"^\s*(?:P\.? ?P?\.? ?S\b|p\.s\.|ps:|pps\b|N\.?B\.?:)")
_CONTACT = re.compile(r"[|@]|https?://|www\.|\+?\d[\d ()/-]{7,}")
_DELIMITER = re.compile(r"^(?:--\s*|_{5,}|—{2,}|-{5,}|={5,}|\*{5,})\s*$")
_DASH_NAME = re.compile(r"^\s*(?:--?|[–—~/])\s*([^\W\d_][\w'’.-]*(?: [^\W\d_][\w'’.-]*){0,3})\s*$")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+|(?<=[。！？؟।])\s*")
_WORD = re.compile(r"\w+")


def _is_intro(lines: list[str], i: int) -> int:
    """How many lines from i on introduce a quote: 0, 1 or 2."""
    line = lines[i]
    if line.endswith(":") and _INTRO.match(line):
        return 1
    if i + 1 < len(lines) and _INTRO_HEAD.match(line) and not line.rstrip().endswith((".", "!", "?", ":")):
        joined = f"{line} {lines[i + 1].strip()}"
        if joined.endswith(":") and len(joined) < 250 and not _QUOTED.match(lines[i + 1]) and _INTRO.match(joined):
            return 2
    return 0


def _head_block(lines: list[str], i: int) -> bool:
    """A header of a mail begins at i: From with an address or a name, and another field right below."""
    return bool(_ADDRESSED.match(lines[i])) and sum(bool(_HEADER.match(x)) for x in lines[i : i + 4]) >= 3


def new_lines(text: str, notices: bool = True) -> tuple[list[str], list[int], dict[str, str]]:
    """(lines, indexes of the lines newly written, header fields) of a mail; notices: whether the grammar knows legal notices."""
    lines = [x[:-1] if x.endswith("\r") else x for x in text.split("\n")]
    n, i, fields = len(lines), 0, {}
    if lines and _HEADER.match(lines[0]):
        while i < n and lines[i].strip():
            if m := re.match(r"^([A-Za-z-]+)\s?:\s*(.*)$", lines[i]):
                fields.setdefault(m[1].lower(), m[2])
            i += 1
    sender = re.sub(r"<[^>]*>", "", fields.get("from", "")).strip(" \"'").lower()
    names = {sender, *sender.split()} - {""}
    found, signed = [], False
    while i < n:
        line = lines[i].strip()
        if not line:
            i += 1
            continue
        if _QUOTED.match(line) and not (line.startswith("|") and line.endswith("|") and line.count("|") > 2):
            i += 1
            continue
        if _FORWARD.match(line) or _head_block(lines, i) or (_RULE.match(line) and i + 1 < n and _head_block(lines, i + 1)):
            break  # what follows is an earlier mail to the end
        if k := _is_intro(lines, i):
            i += k
            continue
        if _PS.match(line):
            # a postscript is new, up to the blank line behind it
            while i < n and lines[i].strip() and not _QUOTED.match(lines[i]) and not _LEGAL.match(lines[i].strip()):
                found.append(i)
                i += 1
            continue
        if notices and (_LEGAL.match(line) or _legal_ahead(lines, i)):
            while i < n and lines[i].strip():
                i += 1
            continue
        if not signed and _signs(lines, i, names):
            signed = True
        elif signed and _prose(lines, i):
            # said behind the signature: a postscript without its letters, up to the blank line
            while i < n and lines[i].strip() and not _QUOTED.match(lines[i]):
                found.append(i)
                i += 1
            continue
        if not signed:
            found.append(i)
        i += 1
    return lines, found, fields


def _legal_ahead(lines: list[str], i: int) -> bool:
    """The notice's telling words may stand on its second line."""
    return i > 0 and not lines[i - 1].strip() and i + 1 < len(lines) and bool(lines[i + 1].strip()) and bool(_LEGAL.match(f"{lines[i].strip()} {lines[i + 1].strip()}"))


def _prose(lines: list[str], i: int) -> bool:
    """A paragraph of whole sentences begins at i, without anything of a signature."""
    if i and lines[i - 1].strip():
        return False
    end = i
    while end < len(lines) and lines[end].strip() and not _QUOTED.match(lines[end]):
        end += 1
    text = " ".join(x.strip() for x in lines[i:end])
    return len(text.split()) >= 4 and bool(re.search(r"[.!?。！？؟।][\"'”’)]*$", text)) and not _CONTACT.search(text)


def _signs(lines: list[str], i: int, names: set[str]) -> bool:
    """A signature begins at i: closing formula, delimiter, device notice, or the sender's name."""
    line = lines[i].strip()
    bare = line.rstrip(",.!;:–— -").lower()
    if bare in CLOSINGS and len(line) - len(bare) <= 2:
        return True
    if _DELIMITER.match(line) or (_DEVICE.match(line) and not line.endswith((".", "!", "?")) and len(line.split()) <= 9):
        return True
    if m := _DASH_NAME.match(line):
        return m[1].lower() in names or not names
    if bare in names and bare == line.lower().rstrip("."):
        # the name alone, and only lines of a signature behind it
        below = [x.strip() for x in lines[i + 1 : i + 5]]
        return not below or not below[0] or "|" in below[0] or "@" in below[0]
    return False


_SAID_IN = "place:int,text:string,own:array<int>,tail:boolean,new:boolean"
_MAIL = f"id long, lines array<struct<n:int,new:boolean>>, sender string, subject string, people array<string>, sent_at long, sentences array<struct<{_SAID_IN}>>"
_MARKS = re.compile(r"^(?:\s*[>|])+\s?")


def _address(field: str) -> str:
    m = re.search(r"[^\s<>,;]+@[^\s<>,;]+", field)
    return (m[0] if m else field).strip().lower()


def _people(fields: dict[str, str]) -> list[str]:
    """Addresses of whom a mail is from and to; names where a field has no address."""
    found: set[str] = set()
    for field in (fields.get("from", ""), fields.get("to", ""), fields.get("cc", "")):
        found |= set(map(str.lower, re.findall(r"[^\s<>,;]+@[^\s<>,;]+", field))) or {x.strip().lower() for x in re.split("[,;]", field)}
    return sorted(found - {""})


def _sent(field: str) -> int | None:
    try:
        return int(parsedate_to_datetime(field).timestamp())
    except (ValueError, TypeError, IndexError, OverflowError):
        return None


def body_lines(lines: list[str]) -> list[int]:
    """Indexes of the lines below the header that aren't blank."""
    begin = next((i for i, x in enumerate(lines) if not x.strip()), len(lines)) if lines and _HEADER.match(lines[0]) else 0
    return [i for i in range(begin, len(lines)) if lines[i].strip()]


def _sentences(lines: list[str], found: list[int]) -> list[tuple[str, list[int], bool, bool]]:
    """(text, lines it stands on, whether nothing but quotes follows its paragraph, whether it is new by the grammar) of all sentences of the body."""
    out, blocks = [], []
    new = set(found)
    for i in body_lines(lines):
        quoted, before = bool(_QUOTED.match(lines[i])), blocks[-1][1][-1] if blocks else -2
        if i != before + 1 or quoted != blocks[-1][0]:
            blocks.append((quoted, []))
        blocks[-1][1].append(i)
    last = max((k for k, (quoted, _) in enumerate(blocks) if not quoted), default=-1)
    for k, (quoted, block) in enumerate(blocks):
        text, ends = "", []
        for i in block:
            line = _MARKS.sub("", lines[i]) if quoted else lines[i]
            text += ("" if not text else " ") + " ".join(line.split())
            ends.append(len(text))
        at = 0
        for m in [*_SENTENCE.finditer(text), None]:
            end = m.start() if m else len(text)
            if part := text[at:end].strip():
                on = [i for i, e, b in zip(block, ends, [0, *ends]) if b < end and e > at]
                out.append((part, on, k == last, not quoted and new.issuperset(on)))
            at = m.end() if m else end
    return out


def _reader(notices: bool):
    def read(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                lines, found, fields = new_lines(text, notices)
                told = [x for x in _sentences(lines, found) if _WORD.search(x[0])]
                subject = re.sub(r"^(?:\s*(?:re|aw|fwd?|wg|sv|tr|rv|antw|antwort|r|i)\s*(?:\[\d+\])?\s*:)+", "", fields.get("subject", ""), flags=re.IGNORECASE)
                new = set(found)
                row = (
                    key, [{"n": i + 1, "new": i in new} for i in sorted({*body_lines(lines), *found})], _address(fields.get("from", "")) or None, " ".join(subject.lower().split()) or None,
                    _people(fields), _sent(fields.get("date", "")), [{"place": k, "text": t, "own": [i + 1 for i in on], "tail": tail, "new": fresh} for k, (t, on, tail, fresh) in enumerate(told)],
                )
                for c, v in zip(columns, row):
                    c.append(v)
            said = pa.struct([("place", pa.int32()), ("text", pa.string()), ("own", pa.list_(pa.int32())), ("tail", pa.bool_()), ("new", pa.bool_())])
            kinds = (pa.int64(), pa.list_(pa.struct([("n", pa.int32()), ("new", pa.bool_())])), pa.string(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(said))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "lines", "sender", "subject", "people", "sent_at", "sentences"])

    return read


def fingerprints(texts: list[str]) -> np.ndarray:
    """(text, byte): the SimHash of each text over its n-grams of characters in lower case, blanks around it."""
    out = np.zeros((len(texts), TABLES), np.uint8)
    sizes = np.array([len(t) + 2 for t in texts], np.int64)
    begin = 0
    while begin < len(texts):  # so many texts that their bits fit in some 30 MB; a longer text alone
        end = max(begin + 1, begin + int(np.searchsorted(np.cumsum(sizes[begin:]), 1 << 18)))
        code = np.frombuffer("".join(f" {t.lower().replace(chr(0x130), 'i')} "[: n] for t, n in zip(texts[begin:end], sizes[begin:end])).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        total = np.zeros(len(code) - GRAM + 1, np.uint64)
        for k in range(GRAM):
            total = (total + code[k : k + len(total)] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(29)
        # n-grams over the edge of two texts belong to none
        ends = np.cumsum(sizes[begin:end])
        inside = np.ones(len(total), bool)
        inside[(ends[:-1, None] - np.arange(1, GRAM)).ravel()] = False
        total, count = total[inside], sizes[begin:end] - GRAM + 1
        start = np.r_[0, np.cumsum(count)[:-1]]
        parts = np.empty((len(total), TABLES // 8), np.uint64)
        for k in range(TABLES // 8):
            mixed = (total + np.uint64(k + 1)) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            parts[:, k] = mixed ^ (mixed >> np.uint64(31))
        bits = np.unpackbits(parts.view(np.uint8), axis=1)
        ones = np.add.reduceat(bits, start, axis=0, dtype=np.int32)
        out[begin:end] = np.packbits(2 * ones > count[:, None], axis=1)
        begin = end
    return out


def _fingerprinted(batches):
    """Rows whose first column is the text -> the same, and a key for each table."""
    for batch in batches:
        prints = fingerprints(batch.column(0).to_pylist()).astype(np.int32) + 256 * np.arange(TABLES, dtype=np.int32) if batch.num_rows else np.empty((0, TABLES), np.int32)
        keys = pa.ListArray.from_arrays(pa.array(np.arange(0, TABLES * (batch.num_rows + 1), TABLES, dtype=np.int32)), pa.array(prints.ravel(), pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, "keys"])


def _tables(df: DataFrame) -> DataFrame:
    """(text, ...) -> the same with `keys`, one for each table."""
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", keys array<int>"
    return df.mapInArrow(_fingerprinted, schema)


def _sent_if_small(df: DataFrame, rows: int = SENT) -> DataFrame:
    """To be sent to all tasks if it is no larger; df must have been written."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _size(text: Column) -> Column:
    """Class of a text's length: texts within the edits of each other are in the same class or in neighbouring ones."""
    return F.floor(F.log(F.greatest(F.length(text), F.lit(1)).cast("double")) / -math.log(1 - EDITS) + 1e-9).cast("int")


def _near(a: str, b: str):
    """Within the edits of each other."""
    x, y = F.length(a), F.length(b)
    most = F.floor(F.greatest(x, y) * EDITS).cast("int")
    return (F.abs(x - y) <= most) & (F.levenshtein(F.col(a), F.col(b)) <= most)


def _inherited(read: DataFrame) -> DataFrame:
    """(id, place): sentences near an earlier one that another sender newly wrote in the same conversation."""
    # a conversation is what a person sent or got under a subject; only those of more than one time and sender
    known = read.where("subject IS NOT NULL AND sent_at IS NOT NULL AND sender IS NOT NULL")
    mine = known.select("id", F.xxhash64("sender").alias("by"), "sent_at", "subject", F.explode("people").alias("person")).select("id", "by", "sent_at", F.xxhash64("subject", "person").alias("talk"))
    talks = mine.groupBy("talk").agg(F.min("sent_at").alias("a"), F.max("sent_at").alias("b"), F.min("by").alias("c"), F.max("by").alias("d")).where("a < b AND c < d").select("talk")
    pairs = written(mine.join(talks, "talk", "left_semi").distinct(), "talks")
    said = known.select("id", F.explode("sentences").alias("s")).select("id", "s.place", "s.text", "s.new")
    talked = written(said.join(_sent_if_small(pairs), "id").select("talk", "by", "id", "place", "sent_at", "new", "text", F.xxhash64("text").alias("h")), "talked")
    # equal sentences of one sender in one conversation are one entry: the first time it was newly said, and the last time it stood there
    entries = talked.groupBy("talk", "by", "h").agg(F.min(F.when(F.col("new"), F.col("sent_at"))).alias("said_at"), F.max("sent_at").alias("stood_at"))
    texts = written(_tables(talked.groupBy("h").agg(F.first("text").alias("text")).select("text", "h")), "texts")
    placed = entries.join(texts.select("h", "keys", _size(F.col("text")).alias("size"), F.length("text").alias("n")), "h")
    later = placed.select("talk", "by", "h", "n", "stood_at", "size", F.explode("keys").alias("key"))
    earlier = placed.where("said_at IS NOT NULL").withColumn("size", F.explode(F.array(*(F.col("size") + d for d in (-1, 0, 1))))).select("talk", "by", "h", "n", "said_at", "size", F.explode("keys").alias("key"))

    def narrow(df: DataFrame, when: str) -> DataFrame:
        return df.select(F.xxhash64("talk", "size", "key").alias("at"), "talk", "by", "h", "n", when)

    met = (
        narrow(later, "stood_at").alias("l").join(narrow(earlier, "said_at").alias("e"), "at")
        .where("l.talk = e.talk AND l.by <> e.by AND e.said_at < l.stood_at").where(F.abs(F.col("l.n") - F.col("e.n")) <= F.greatest("l.n", "e.n") * EDITS)
        .select(F.col("l.talk").alias("talk"), F.col("l.by").alias("by"), F.col("l.h").alias("h"), F.col("e.h").alias("other"), F.col("e.said_at").alias("said_at")).distinct()
    )
    text, other = texts.select("h", "text"), texts.select(F.col("h").alias("other"), F.col("text").alias("was"))
    heard = met.join(text, "h").join(other, "other").where(_near("text", "was")).groupBy("talk", "by", "h").agg(F.min("said_at").alias("heard_at"))
    return talked.join(heard, ["talk", "by", "h"]).where("sent_at > heard_at").select("id", "place")


def _boilerplate(read: DataFrame, least: int) -> DataFrame:
    """(id, place): sentences that close many mails of one sender, or of several, and sentences at the end of mails near those.

    Equal sentences are counted first, by their hashes; only what recurs gets a fingerprint
    to be met, so a sentence that a third of all mails hold is one entry.
    """
    told = read.where("sender IS NOT NULL").select(F.xxhash64("sender").alias("by"), "id", "sent_at", F.explode("sentences").alias("s")).select("by", "id", "sent_at", "s.place", "s.tail", "s.text", F.xxhash64("s.text").alias("h"))
    counts = (F.count("*").alias("n"), (F.sum(F.col("tail").cast("long")) / (F.count("*") + 2)).alias("share"), F.min("sent_at").alias("a"), F.max("sent_at").alias("b"))
    closing = (F.col("share") >= TAIL_SHARE) & (F.col("a") < F.col("b"))
    often = written(told.groupBy("h").agg(*counts, F.min("by").alias("c"), F.max("by").alias("d")).where(F.col("n") >= least), "often")
    # 0 stands for all senders
    several = often.where(closing & (F.col("c") < F.col("d"))).select(F.lit(0).cast("long").alias("who"), "h")
    mails = read.where("sender IS NOT NULL").groupBy(F.xxhash64("sender").alias("by")).agg(F.count("*").alias("mails"))
    single = told.join(_sent_if_small(often.select("h")), "h", "left_semi").groupBy("by", "h").agg(*counts).where(closing & (F.col("n") >= least)).join(mails, "by").where(F.col("n") >= F.col("mails") * SENDER_SHARE)
    common = _sent_if_small(written(several.union(single.select(F.col("by").alias("who"), "h")), "common"))
    whose = told.withColumn("who", F.explode(F.array(F.lit(0).cast("long"), "by")))
    exact = whose.join(common, ["who", "h"], "left_semi")
    # near ones: the texts of what recurs, and what else ends a mail
    known = written(_tables(exact.groupBy("who", "h").agg(F.first("text").alias("text")).select("text", "who")), "known")
    met_at = F.xxhash64("who", "size", "key").alias("at")
    targets = known.select("text", "who", F.explode(F.array(*(_size(F.col("text")) + d for d in (-1, 0, 1)))).alias("size"), F.explode("keys").alias("key")).select(F.col("text").alias("was"), met_at)
    targets = _sent_if_small(written(targets, "targets"))
    ends = _tables(told.where("tail").join(common.where("who = 0").select("h"), "h", "left_anti").select("text", "id", "place", "by"))
    ends = ends.select("text", "id", "place", _size(F.col("text")).alias("size"), F.explode(F.array(F.lit(0).cast("long"), "by")).alias("who"), "keys").select("text", "id", "place", "who", "size", F.explode("keys").alias("key"))
    near = ends.select("text", "id", "place", met_at).join(targets, "at").where(_near("text", "was")).select("id", "place")
    return exact.select("id", "place").union(near)


def _decided(batches):
    """(id, lines, sentences, gone) -> (id, line_no, way): a line goes if every sentence on it goes."""
    for batch in batches:
        ids, numbers, ways = [], [], []
        for key, lines, sentences, gone in zip(*(batch.column(i).to_pylist() for i in range(4))):
            how = {g["place"]: g["way"] for g in sorted(gone or (), key=lambda g: -g["way"])}
            on: dict[int, int] = {}
            for said in sentences if how else ():
                way = how.get(said["place"], 0)
                for n in said["own"]:
                    on[n] = min(on.get(n, way), way)
            for line in lines:
                ids.append(key)
                numbers.append(line["n"])
                ways.append({1: "inherited", 2: "boilerplate"}.get(on.get(line["n"], 0)) or ("new" if line["new"] else "old"))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(ways, pa.string())], names=["id", "line_no", "way"])


def body_lines_by_origin(fragments: DataFrame, key: str = "id", text: str = "text", mimetype: str = "mimetype", boilerplate: int = BOILERPLATE, notices: bool = True) -> DataFrame:
    """(id, line_no, way): the lines of each mail's body, counted from 1 over the whole text, and what they are.

    way: inherited or boilerplate where all sentences of the line are so by the tables; else
    new, or old where the grammar says so. Mails are the fragments of type message/rfc822,
    with any parameters and in any case. Null and blank texts have no lines. Mails stored
    twice give their lines each: copies have one date, so neither is the earlier. A mail
    without a date inherits from none. Repeated rows of one id give their lines once. An
    empty table gives no rows. notices: whether the grammar knows legal notices by itself.
    """
    essence = F.lower(F.trim(F.split(F.col(mimetype), ";")[0]))
    mails = fragments.where((essence == "message/rfc822") & (F.length(text) > 0)).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    read = written(mails.mapInArrow(_reader(notices), _MAIL), "mails")
    gone = _inherited(read).withColumn("way", F.lit(1)).union(_boilerplate(read, boilerplate).withColumn("way", F.lit(2)))
    # no more entries than a mail has sentences
    gone = gone.groupBy("id").agg(F.collect_set(F.struct("place", "way")).alias("gone"))
    places = F.transform("sentences", lambda x: F.struct(x["place"].alias("place"), x["own"].alias("own"))).alias("sentences")
    return read.select("id", "lines", places).join(gone, "id", "left").mapInArrow(_decided, "id long, line_no int, way string").distinct()


def written_lines(fragments: DataFrame, key: str = "id", text: str = "text", mimetype: str = "mimetype", boilerplate: int = BOILERPLATE, notices: bool = True) -> DataFrame:
    """(id, line_no): the lines of each mail newly written by its sender; see `body_lines_by_origin`."""
    return body_lines_by_origin(fragments, key, text, mimetype, boilerplate, notices).where("way = 'new'").select("id", "line_no")
