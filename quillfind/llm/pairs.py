"""Broken prompt and response pairs (problem 4): a multi-label linear classifier with calibrated thresholds.

A bounded sample of the pairs is broken on purpose (truncated, copied, swapped with texts
in other languages, refused, emptied). One logistic regression per defect is fitted on
hashed n-grams of the answer and of its end, and on features of the pair: what the answer
says that the question doesn't, how it relates to the gold answer, how its last line looks,
and how well each language explains it. The languages are profiles of character n-grams
learned from labelled texts. Real pairs stand as sound ones in a first fit; those it finds
broken are left out of the second. The threshold of each defect is set for a stated
precision on questions and wordings held out. The classifier alone decides.
"""

from __future__ import annotations

import re
import unicodedata
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pairs drawn for training (at most twice as many by chance), buckets of features, parts of which each is held out for the thresholds, precision they are set for.
SAMPLE, BUCKETS, FOLDS, PRECISION = 500, 1 << 16, 3, 0.99
#: Rounds of a fit; by how much the profile of a sentence's language must beat all others; by how much languages may explain a question less well and still be its own; score from which a real pair is doubted.
ROUNDS, CLEAR, NEARLY, DOUBT = 8, 5.0, 4.0, -1.0
#: Labelled texts drawn for each language, labels at most, buckets of character n-grams, longest n-gram.
PER_LANGUAGE, LABELS, PROFILE, LONGEST = 150, 64, 1 << 15, 4

DEFECTS = ("empty", "copy", "refusal", "other_language", "truncated")
#: Families of features, each with buckets of its own, and the defects they tell of: words of the answer, of the gold answer, the end, the relation, the language.
FAMILIES = {"a": ("empty", "refusal"), "g": ("refusal",), "e": ("truncated",), "p": ("empty", "copy", "refusal"), "l": ("other_language",)}

#: What stands where an answer is missing, to train on.
PLACEHOLDERS = (
    "na", "n/a", "none", "null", "nil", "nan", "undefined", "tbd", "tba", "todo", "no answer", "no response", "not available",
    "not applicable", "empty", "blank", "missing", "sin respuesta", "keine antwort", "sans réponse", "pas de réponse", "k. a.", "s/r", "n.a", "placeholder",
)

#: Empty answers without any word, to train on.
NOTHING = ("", " ", "-", "--", "...", "…", "?", "​", "<p></p>", "<br/>", "``", "\n", "\n\n", "\t", "**", "[]", "&nbsp;")

#: How a question is said again, to train on.
ECHOES = ("{0}", "{0}\n", "> {0}\n", "Question: {0}", "Q: {0}", "You asked: {0}", "The question was: {0}", "{0} {0}", '"{0}"', "Your question: {0}", "Pregunta: {0}", "Frage: {0}", "Question : {0}", "Usted preguntó: {0}", "Sie fragten: {0}", "Vous avez demandé : {0}")

#: Parts of refusals to train on: (what may stand in front, what declines, what may stand behind).
REFUSALS = {
    "en": (
        ("", "", "I'm sorry, but ", "Sorry, ", "Unfortunately ", "Apologies, ", "I apologize, but ", "I'm afraid ", "Thank you for the question, but ", "As an assistant ", "As an AI model "),
        (
            "I can't help with that", "I cannot help with this", "I cannot provide that information", "I can't provide this", "I must decline to answer this", "I have to decline", "that is something I must decline to answer",
            "I am unable to assist with this request", "I am unable to assist with requests like this", "I'm not able to answer that", "I am not able to answer this question", "I would rather not answer this question", "I'd rather not answer this",
            "my guidelines do not allow me to discuss this", "my guidelines do not let me discuss this topic", "my policy does not permit me to answer", "I do not have access to those records, so I cannot say", "I don't have access to that",
            "I won't answer that", "I will not answer this", "we are not permitted to share this", "I am not allowed to answer such requests", "I'm not authorized to discuss this", "I can't discuss it", "I can't share that information",
            "answering would be against policy", "answering that falls outside what is allowed here", "it is not possible for me to answer this request", "I don't feel comfortable answering this", "I regret that I cannot comply with this request",
        ),
        (".", ".", ".", ", sorry.", ", apologies.", ". Please ask someone else.", ". Please ask your administrator.", ". Is there anything else?"),
    ),
    "es": (
        ("", "", "Lo siento, ", "Lamentablemente ", "Perdón, pero ", "Como asistente "),
        ("no puedo ayudar con eso", "no puedo ayudarle con esto", "no me está permitido responder a esta pregunta", "no puedo dar esa información", "no estoy autorizado a responder", "prefiero no responder a esto", "debo rechazar esta solicitud", "no tengo acceso a esos datos", "no me es posible responder", "no puedo compartir esa información"),
        (".", ".", ". Disculpe.", ". Pregunte a otra persona."),
    ),
    "fr": (
        ("", "", "Je suis désolé, ", "Désolé, ", "Malheureusement, ", "En tant qu'assistant, "),
        ("je ne peux pas répondre à cette question", "il m'est impossible de vous aider", "il m'est impossible de vous aider sur ce point", "je ne peux pas donner cette information", "je préfère ne pas répondre", "je ne suis pas autorisé à répondre", "je dois refuser cette demande", "je n'ai pas accès à ces données", "je ne suis pas en mesure de vous aider", "cela ne m'est pas permis"),
        (".", ".", ", désolé.", ". Merci de demander à quelqu'un d'autre."),
    ),
    "de": (
        ("", "", "Es tut mir leid, ", "Leider ", "Tut mir leid, aber ", "Als Assistent "),
        ("diese Frage darf ich nicht beantworten", "dabei kann ich leider nicht helfen", "dabei kann ich nicht helfen", "diese Auskunft darf ich nicht geben", "dazu kann ich keine Auskunft geben", "dazu kann ich nichts sagen", "darauf möchte ich nicht antworten", "das kann ich nicht beantworten", "ich bin nicht befugt, das zu beantworten", "ich habe keinen Zugriff auf diese Daten", "ich muss diese Anfrage ablehnen"),
        (".", ".", ", leider.", ". Bitte fragen Sie jemand anderen."),
    ),
    "it": (
        ("", "Mi dispiace, ", "Purtroppo "),
        ("non posso aiutare con questo", "non posso rispondere a questa domanda", "non mi è permesso rispondere", "preferisco non rispondere", "non ho accesso a questi dati", "devo rifiutare questa richiesta"),
        (".", ", mi dispiace."),
    ),
    "nl": (
        ("", "Het spijt me, ", "Helaas "),
        ("ik kan daar niet bij helpen", "ik mag deze vraag niet beantwoorden", "ik kan die informatie niet geven", "ik wil hier liever niet op antwoorden", "ik heb geen toegang tot die gegevens", "ik moet dit verzoek afwijzen"),
        (".", ", sorry."),
    ),
    "pt": (
        ("", "Desculpe, ", "Infelizmente "),
        ("não posso ajudar com isso", "não posso responder a esta pergunta", "não me é permitido responder", "prefiro não responder", "não tenho acesso a esses dados", "devo recusar este pedido"),
        (".", ", lamento."),
    ),
}

#: How a text says that the records hold no answer, to train on; no refusal where the gold answer says so.
NO_ANSWERS = (
    "The sources hold no answer to this question.", "The records do not say.", "This is not stated in any source.", "No document mentions it.", "The files contain no information about this.", "There is no record of it in the archive.",
    "Las fuentes no lo indican.", "No consta en los documentos.", "Les sources ne le précisent pas.", "Ce n'est pas indiqué dans les documents.", "Das steht in keiner Quelle.", "Die Unterlagen sagen dazu nichts.",
)

#: Sentences that sound like refusals and are none, to train on.
NO_REFUSALS = (
    "{0} could not help with the report, so {1} finished it.", "Sorry to say, the file was moved, and the value now is {2}.", "The system refuses any copy larger than {2} rows.", "It cannot be more than {2}, because the limit caps it.",
    "{0} declined the invitation and {1} went.", "They were unable to open it until {0} came.", "{0} is not allowed to open it before {1} signs.", "Unfortunately it was {2}, not more.", "The policy permits {2} copies.",
    "{0} no pudo ayudar con el informe y {1} lo terminó.", "{0} n'a pas pu aider, alors {1} l'a terminé.", "{0} konnte nicht helfen, also hat {1} es gemacht.",
)

#: Sound pairs to train on where fewer than FEW are drawn.
FEW = 60
BUILT_IN = (
    ("What is the name of the town?", "The name of the town is Bath, as the map says.", "The name of the town is Bath"), ("Who wrote the first letter?", "Ann Lee", "Ann Lee"), ("How many boxes are left?", "14", "14"),
    ("Is the gate still open?", "Yes", "Yes"), ("What are the steps to mend it?", "1. Open the lid\n2. Clean the belt\n3. Close it", "1. Open the lid\n2. Clean the belt\n3. Close it"),
    ("Why was the meeting moved?", "It was moved because the room was taken. Nobody minded much.", "It was moved because the room was taken."), ("¿Dónde está el libro?", "El libro está en la mesa de la casa.", "El libro está en la mesa"), ("Wo liegt der Schlüssel?", "Der Schlüssel liegt unter der Matte.", "Der Schlüssel liegt unter der Matte."),
)

_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>|&nbsp;")
_SENTENCE = re.compile(r"(?<=[.!?])[\"'”’»)\]*]*\s+|(?<=[。！？؟।])|\n+")
_STOP = re.compile(r"[.!?。！？؟।॥][\"'”’»)\]}*_`]*$")
#: Names inside a sentence, and words with digits or underscores: of any language.
_NAMED = re.compile(r"(?<=[^\W_][ ,])[A-ZÀ-Þ][\w'’-]*|[A-Za-z0-9_]*[0-9_][A-Za-z0-9_]*")
_MARK = re.compile(r"\s*(?:…|\.\.\.+|\[(?:…|\.\.\.)?\]?|�+)\s*$")
_ITEM = re.compile(r"\s*(?:[-*•]|\d+[.)])\s+")
_LABEL = re.compile(r"\s*[^\W\d_][\w ]{0,20}:\s")


def plain(text: str) -> list[str]:
    """Words in lower case and composed letters, without tags; numbers as they are."""
    if "<" in text or "&" in text:
        text = _TAG.sub(" ", text)
    return _WORD.findall((text if text.isascii() else unicodedata.normalize("NFKC", text)).replace("’", "'").lower())


def sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s and not s.isspace()]


class Languages:
    """Profiles of character n-grams: how well each language explains a text."""

    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs

    @staticmethod
    def _grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, position of the first character, starts of the texts) of all n-grams; whatever is no letter is a blank."""
        starts = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 2 for t in texts], out=starts[1:])
        code = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        low = code < 0x80
        code[low & ~(((code >= 97) & (code <= 122)) | (code == 39))] = 32
        code[(code == 0xA0) | ((code >= 0x2000) & (code < 0x2070)) | ((code >= 0x3000) & (code < 0x3003)) | (code == 0xFF0C)] = 32
        found, at, total = [], [], np.zeros(len(code), np.uint64)
        letter = code != 32
        for n in range(1, LONGEST + 1):
            if len(code) < n:
                break
            total = (total[: len(code) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + code[n - 1 :] + np.uint64(n)) * np.uint64(0xC2B2AE3D27D4EB4F)
            here = np.flatnonzero(letter[: len(total)] | (letter[1 : len(total) + 1] if n > 1 and len(letter) > len(total) else False))
            found.append((total[here] >> np.uint64(64 - 15)).astype(np.int64))
            at.append(here)
        return np.concatenate(found or [np.empty(0, np.int64)]), np.concatenate(at or [np.empty(0, np.int64)]), starts

    @classmethod
    def fit(cls, labelled: list[tuple[str, str]], least: int = 3) -> Languages:
        """(label, text) -> profiles; labels are taken by their first two letters, those with less than `least` texts are left out."""
        groups: dict[str, list[str]] = {}
        for label, text in labelled:
            key = (label or "").strip().lower()[:2]
            if len(key) == 2 and text:
                groups.setdefault(key, []).append(_NAMED.sub(" ", text).lower())
        names = sorted(k for k, v in groups.items() if len(v) >= least)
        counts = np.full((PROFILE, len(names)), 0.05)
        for i, name in enumerate(names):
            counts[:, i] += np.bincount(cls._grams(groups[name])[0], minlength=PROFILE)
        return cls(names, (np.log(counts) - np.log(counts.sum(0))).astype(np.float32))

    def scores(self, texts: list[str]) -> np.ndarray:
        """Log likelihood of each text under each language, by its number of n-grams to the power of a half."""
        if not self.names or not texts:
            return np.zeros((len(texts), len(self.names)), np.float32)
        bucket, at, starts = self._grams([_NAMED.sub(" ", t).lower() for t in texts])
        owner = np.searchsorted(starts, at, "right") - 1
        order = np.argsort(owner, kind="stable")
        sizes = np.bincount(owner, minlength=len(texts))
        total = np.zeros((len(texts), len(self.names)), np.float32)
        full = sizes > 0
        if full.any():
            total[full] = np.add.reduceat(self.logs[bucket[order]], np.r_[0, np.cumsum(sizes)[:-1]][full], axis=0)
        return total / np.sqrt(np.maximum(sizes, 1))[:, None]


def _step(value: float, steps: tuple) -> int:
    return sum(value >= s for s in steps)


def _shape(word: str) -> str:
    if word.isdigit():
        return "d"
    return "A" if word.isupper() and len(word) > 1 else "X" if word[:1].isupper() else "x"


_MARGINS = (-20.0, -10.0, -5.0, -2.0, -0.5, 0.5, 2.0, 5.0, 10.0, 20.0)
_SHARES = (0.01, 0.3, 0.6, 0.8, 0.95, 1.0)


REGION = BUCKETS // 8
_REGION = {family: i * REGION for i, family in enumerate(FAMILIES)}
#: (family, defect): 1 where a weight may be learned.
_TELLS = np.array([[d in told for d in DEFECTS] for told in FAMILIES.values()], np.float32)


class Featured:
    """Hashed features of pairs: arrays (bucket, value, start of each pair)."""

    def __init__(self, languages: Languages):
        self.languages, self.known = languages, {}

    def _bucket(self, name: str) -> int:
        found = self.known.get(name)
        if found is None:
            if len(self.known) > 1 << 19:
                self.known.clear()
            found = self.known[name] = _REGION[name[0]] + zlib.crc32(name.encode("utf-8", "replace")) % REGION
        return found

    def of(self, pairs: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """pairs: (question, answer, gold), each of which may be None."""
        spoken = self._spoken(pairs)
        buckets, values, sizes = [], [], []
        known = self._bucket
        for (question, answer, gold), tongue in zip(pairs, spoken):
            question, answer, gold = question or "", answer or "", gold or ""
            said, asked, told = plain(answer), plain(question), plain(gold)
            grams = _ngrams("a", said)
            held = _ngrams("g", told)
            features = [*tongue, *_ending(answer, gold), *_relation(answer, said, asked, told)]
            own = [known(x) for x in (*grams, *held, *features)]
            buckets += own
            values += [1.0 / max(1, len(grams)) ** 0.5] * len(grams) + [0.5 / max(1, len(held)) ** 0.5] * len(held) + [0.5] * len(features)
            sizes.append(len(own))
        return np.array(buckets, np.int64), np.array(values, np.float32), np.r_[0, np.cumsum(sizes)].astype(np.int64)

    def _spoken(self, pairs: list[tuple]) -> list[list[str]]:
        """Features of language: how much better the question's own language explains the answer than any other does."""
        if len(self.languages.names) < 2:
            return [[] for _ in pairs]
        texts: dict[str, int] = {}
        parts = []
        for question, answer, _ in pairs:
            mine = [texts.setdefault(s, len(texts)) for s in sentences(answer or "") if any(map(str.isalpha, s))]
            parts.append((texts.setdefault(question or "", len(texts)), mine))
        scores = self.languages.scores(list(texts))
        out = []
        for (asked, mine), (question, answer, _) in zip(parts, pairs):
            if not mine:
                out.append(["l:none"])
                continue
            # a short question may be of several languages: all that explain it nearly as well as the best one
            own = scores[asked] >= scores[asked].max() - NEARLY
            of = scores[mine]
            margin = of[:, own].max(1) - of[:, ~own].max(1) if not own.all() else np.full(len(mine), 99.0)
            sizes = np.array([len(plain(s)) for s in sentences(answer) if any(map(str.isalpha, s))])
            long = min(5, int(sizes.max()))
            best, whole = (_step(float(x), _MARGINS) for x in (margin.max(), (margin * sizes).sum() / max(1, sizes.sum())))
            out.append([f"l:best{best}", f"l:whole{whole}", f"l:best{best},{long}", f"l:whole{whole},{long}"])
        return out


def _ngrams(space: str, words: list[str]) -> list[str]:
    """Words, pairs and triples of words, each once; numbers are alike."""
    w = ["^", *("#" if x[0].isdigit() else x for x in words), "$"]
    found = {f"{space}1{x}" for x in w} | {f"{space}2{a} {b}" for a, b in zip(w, w[1:])} | {f"{space}3{a} {b} {c}" for a, b, c in zip(w, w[1:], w[2:])}
    return sorted(found)


def _ending(answer: str, gold: str) -> list[str]:
    """How the answer ends: its last signs, its last line and what of a sentence stands there."""
    body = _TAG.sub(" ", answer).rstrip() if "<" in answer else answer.rstrip()
    if not body:
        return ["e:nothing"]
    mark = _MARK.search(body)
    whole = body[: mark.start()] if mark else body
    kind = "mark" if mark else "stop" if _STOP.search(body) else "digit" if body[-1].isdigit() else "letter" if body[-1].isalpha() else f"sign{body[-1]}"
    lines = [x for x in whole.split("\n") if x.strip()] or [""]
    line = lines[-1]
    item, label = bool(_ITEM.match(line)) and len(lines) > 1, bool(_LABEL.match(line))
    rest = line[_ITEM.match(line).end() :] if item else line
    parts = [x for x in re.split(r"(?<=[.!?])[\"'”’»)\]*]*\s+|(?<=[。！？؟।])", rest) if x.strip()] or [""]
    last = parts[-1].split()
    shape = "".join(_shape(x) for x in last[:5])
    n = min(len(last), 7)
    behind = "behind" if len(parts) > 1 else "first"
    where = "item" if item else "label" if label else "line"
    stopped = sum(bool(_STOP.search(x.rstrip())) for x in lines[:-1])
    odd = "odd" if whole.count("`") % 2 or whole.count("**") % 2 or whole.count("(") > whole.count(")") else "even"
    given = gold.strip()
    cut = "part" if given and len(whole) < len(given) and given.startswith(whole) else "same" if given and whole.strip() == given else "holds" if given and given.rstrip(" .") in whole else "no"
    ends = plain(last[-1])[-1:] if last else []
    return [
        f"e:{kind}", f"e:{kind},{where}", f"e:{kind},{behind}", f"e:{kind},{behind},{where}", f"e:{kind},{n}", f"e:{kind},{where},{behind},{n}", f"e:{kind},{shape}", f"e:{kind},{where},{behind},{shape}",
        f"e:{odd},{kind}", f"e:{cut}", f"e:{cut},{kind}", f"e:{cut},{kind},{where},{behind}", f"e:lines{min(len(lines), 4)},{kind}", f"e:above{min(stopped, 2)},{kind}", *(f"e:ends{kind},{x}" for x in ends),
    ]


def _relation(answer: str, said: list[str], asked: list[str], told: list[str]) -> list[str]:
    """What the answer shares with the question and the gold answer, and what it says besides."""
    a, q, g = set(said), set(asked), set(told)
    new = [w for w in said if w not in q]
    covered = len(a & q) / max(1, len(q))
    follows = set(zip(asked, asked[1:]))
    in_order = len(follows & set(zip(said, said[1:]))) / max(1, len(follows))
    n, c, o = min(len(new), 6), _step(covered, _SHARES), _step(in_order, _SHARES)
    number = any(w.isdigit() for w in new)
    fresh = g - q
    held = _step(len(a & fresh) / len(fresh), (0.01, 0.5, 1.0)) if fresh else "x"
    signs = "sign" if any(not x.isspace() for x in answer) else "blank"
    longer = _step(len(said) / max(1, len(asked)), (0.2, 0.6, 0.95, 1.05, 1.6, 2.1))
    return [
        f"p:new{n}", f"p:words{min(len(said), 6)}", f"p:words{min(len(said), 1)},{signs}", f"p:order{o}", f"p:order{o},{n}", f"p:cover{c},{n}", f"p:number{number},{o}", f"p:longer{longer},{o}", f"p:held{held}", f"p:held{held},{n}",
        *(f"p:beside{o},{'#' if w.isdigit() else w}" for w in sorted(set(new[:4]))),
    ]


class Classifier:
    """A linear model and a threshold for each defect."""

    def __init__(self, weights: np.ndarray, threshold: np.ndarray, languages: Languages):
        self.weights, self.threshold, self.featured = weights, threshold, Featured(languages)

    @classmethod
    def of(cls, parts: dict) -> Classifier:
        """From plain arrays and names, as they are sent to the workers."""
        return cls(parts["weights"], parts["threshold"], Languages(parts["names"], parts["logs"]))

    def parts(self) -> dict:
        return {"weights": self.weights, "threshold": self.threshold, "names": self.featured.languages.names, "logs": self.featured.languages.logs}

    def scores(self, pairs: list[tuple]) -> np.ndarray:
        """What each defect scores over its threshold; (pair, defect)."""
        return _Rows(*self.featured.of(pairs)).scored(self.weights) - self.threshold

    def defects(self, pairs: list[tuple]) -> list[str | None]:
        """The defect of each pair: of those over their thresholds the one that is farthest over it."""
        if not pairs:
            return []
        over = self.scores(pairs)
        best = over.argmax(1)
        return [DEFECTS[k] if row[k] >= 0 else None for k, row in zip(best, over)]


class _Rows:
    """Hashed features of many pairs: (bucket, value) side by side, and where each pair starts; no pair is without any."""

    def __init__(self, bucket: np.ndarray, value: np.ndarray, start: np.ndarray):
        self.bucket, self.value, self.start = bucket, value, start

    def __len__(self) -> int:
        return len(self.start) - 1

    def at(self, rows: np.ndarray) -> _Rows:
        size = (self.start[1:] - self.start[:-1])[rows]
        start = np.r_[0, np.cumsum(size)]
        where = np.repeat(self.start[rows] - start[:-1], size) + np.arange(start[-1])
        return _Rows(self.bucket[where], self.value[where], start)

    def scored(self, weights: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[self.bucket] * self.value[:, None], self.start[:-1], axis=0)


def _fitted(rows: _Rows, y: np.ndarray, rounds: int, part: int = 512, seed: int = 5) -> np.ndarray:
    """Logistic regressions of all defects at once, by steps over parts of the pairs, each weight with a rate of its own."""
    used, bucket = np.unique(rows.bucket, return_inverse=True)
    rows = _Rows(bucket, rows.value, rows.start)
    w, tells = np.zeros((len(used), len(DEFECTS)), np.float32), _TELLS[used // REGION]
    squares = np.full(w.shape, 1e-3, np.float32)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        order = rng.permutation(len(rows))
        for at in range(0, len(order), part):
            mine = rows.at(order[at : at + part])
            off = (1 / (1 + np.exp(-np.clip(mine.scored(w), -30, 30))) - y[order[at : at + part]]).astype(np.float32)
            off = np.repeat(off, np.diff(mine.start), axis=0) * mine.value[:, None]
            step = tells * np.stack([np.bincount(mine.bucket, off[:, k], len(used)) for k in range(len(DEFECTS))], 1).astype(np.float32) * (32 / len(mine)) + 2e-4 * w
            squares += step * step
            w -= 0.5 * step / np.sqrt(squares)
    out = np.zeros((BUCKETS, len(DEFECTS)), np.float32)
    out[used] = w
    return out


def _calibrated(score: np.ndarray, true: np.ndarray, precision: float) -> float:
    """The threshold of the best F1 among those of at least this precision, in the middle of the gap below it.

    Of fewer than ten cases it is 0. Where that precision is out of reach, or costs a tenth of the cases, it is the threshold of the best F1.
    """
    if true.sum() < 10:
        return 0.0
    order = np.argsort(-score, kind="stable")
    hit = np.cumsum(true[order])
    exact, whole = hit / np.arange(1, len(order) + 1), hit / hit[-1]
    f1 = 2 * exact * whole / np.maximum(exact + whole, 1e-9)
    sure = np.where(exact >= precision, f1, -1)
    best = int(sure.argmax())
    if sure[best] < 0 or whole[best] < 0.9 * whole[int(f1.argmax())]:
        best = int(f1.argmax())
    below = score[order[best + 1]] if best + 1 < len(order) else score[order[best]] - 2
    return float((score[order[best]] + below) / 2)


def _pick(rng: np.random.Generator, values):
    return values[int(rng.integers(len(values)))]


def _refusal(rng: np.random.Generator, tongue: str) -> tuple[str, int]:
    """A refusal and the number of its wording."""
    fronts, bodies, backs = REFUSALS[tongue]
    k = int(rng.integers(len(bodies)))
    text = _pick(rng, fronts) + bodies[k] + _pick(rng, backs)
    return text[0].upper() + text[1:], zlib.crc32(bodies[k].encode())


def _truncated(text: str, more: str, rng: np.random.Generator) -> str | None:
    """The text, or the text and another sentence, cut inside a sentence."""
    whole = text.strip()
    if rng.random() < 0.6 or len(whole.split()) < 5 or "\n" in whole:
        whole = f"{whole if _STOP.search(whole) else whole + '.'} {more.strip()}"
    begins = [m.end() for m in re.finditer(r"[.!?][\"'*]*\s+(?=\S)", whole[:-1])]
    least = begins[-1] + 3 if begins else max(12, len(whole) // 3)
    if len(whole) - 2 <= least:
        return None
    body = whole[: int(rng.integers(least, len(whole) - 1))].rstrip()
    return None if _STOP.search(body) or "\n" in body[least:] else body + _pick(rng, ["", "", "", "", "...", "…", " …", " ..."])


def broken(real: list[tuple], foreign: list[tuple[str, str]], languages: Languages, unsaid: bool = True, seed: int = 11) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
    """(pairs, labels, groups, reals): the real pairs, label -1, and the same broken in every way; pairs of one group are held out together.

    reals: the number of a pair that is real, else -1.

    foreign: (label, sentence) to swap answers with.
    """
    rng = np.random.default_rng(seed)
    made: list[tuple] = []
    names = [w for q, _, _ in real for w in re.findall(r"(?<=\s)[A-Z][a-z]{3,}", q or "")] or ["Kim", "Lee"]
    spoken = languages.scores([q or "" for q, _, _ in real])
    tongue = [languages.names[i] for i in spoken.argmax(1)] if languages.names else ["en"] * len(real)
    others = {t: [s for label, s in foreign if label != t] for t in set(tongue)}
    said = languages.scores([a or "" for _, a, _ in real])
    clear = np.diff(np.sort(said, axis=1)[:, -2:], axis=1)[:, 0] > CLEAR if len(languages.names) > 1 else np.zeros(len(real), bool)
    swapped = {t: [a for (_, a, _), x, k, sure in zip(real, tongue, said.argmax(1), clear) if sure and x != t and languages.names[k] == x] for t in set(tongue)} if clear.any() else dict.fromkeys(tongue, [])
    same = {t: [s for label, s in foreign if label == t] for t in set(tongue)}
    alike = {t: [a or "It was said at that time." for (_, a, _), x in zip(real, tongue) if x == t] for t in set(tongue)}

    def put(q, a, g, label, group, own=-1):
        made.append((q, a, g, DEFECTS.index(label) if label else -1, group, own))

    for i, (q, a, g) in enumerate(real):
        group = zlib.crc32((q or "").encode("utf-8", "replace"))
        a = a or ""
        put(q, a, g, None, group, i)
        kept = g if rng.random() < 0.6 else None
        # gold answers may be defective too: that makes no sound answer a broken one
        foul = [q, cut, "n/a"] if (cut := _truncated(g or a, more := _pick(rng, alike[tongue[i]]), rng)) else [q, None, "n/a"]
        if g:
            put(q, a, _pick(rng, [*foul, _pick(rng, others[tongue[i]]) if others[tongue[i]] else None]), None, group)
        more = _pick(rng, same[tongue[i]]) if same[tongue[i]] and rng.random() < 0.7 else more
        for text in (a, g or ""):
            if plain(text) and (cut := _truncated(text, more, rng)):
                put(q, cut, kept, "truncated", group)
        if q and plain(q):
            asked = [q, q, q.upper(), q.lower(), q.strip().rstrip("?.!") + ".", q.strip().rstrip("?.!")][int(rng.integers(6))]
            put(q, _pick(rng, ECHOES).format(asked), kept, "copy", group)
            put(q, _pick(rng, ECHOES).format(q) + _pick(rng, ["\n\n", " ", "\n"]) + a, g, None, group)
        for _ in range(2):
            wording = tongue[i] if tongue[i] in REFUSALS and rng.random() < 0.6 else _pick(rng, list(REFUSALS))
            said, wording_no = _refusal(rng, wording)
            if rng.random() < 0.3:
                said = f"{said} {_refusal(rng, wording)[0]}"
            put(q, said, _pick(rng, NO_ANSWERS) if rng.random() < 0.1 else said if rng.random() < 0.05 else kept, "refusal", wording_no)
        x, y = _pick(rng, names), _pick(rng, names)
        put(q, _pick(rng, NO_REFUSALS[:9] if tongue[i] == "en" else NO_REFUSALS[9:]).format(x, y, int(rng.integers(1, 99))), g, None, group)
        if unsaid and rng.random() < 0.3:
            answered = bool(g and plain(g)) and rng.random() < 0.25
            put(q, _pick(rng, NO_ANSWERS[:6] if tongue[i] == "en" else NO_ANSWERS), g if answered else _pick(rng, NO_ANSWERS), "refusal" if answered else None, group)
        word = _pick(rng, PLACEHOLDERS)
        word = [word, word.upper(), word.title(), f"[{word}]", f"({word})", word + "."][int(rng.integers(6))]
        put(q, word if rng.random() < 0.5 else _pick(rng, NOTHING), kept, "empty", group)
        if swapped[tongue[i]] and rng.random() < 0.4:
            put(q, _pick(rng, swapped[tongue[i]]), kept, "other_language", group)
        elif others[tongue[i]]:
            n = int(rng.integers(1, 4))
            put(q, " ".join(_pick(rng, others[tongue[i]]) for _ in range(n)), kept, "other_language", group)
    pairs = [m[:3] for m in made]
    return pairs, *(np.array([m[k] for m in made], np.int64) for k in (3, 4, 5))


def clear_sentences(labelled: list[tuple[str, str]], languages: Languages) -> list[tuple[str, str]]:
    """(label, sentence) of whole sentences whose profile says clearly what their label says.

    Labels may be wrong, and sentences of names and numbers say nothing.
    """
    found = [(label.strip().lower()[:2], s) for label, text in labelled if label and text for s in sentences(text) if _STOP.search(s) and "@" not in s and (3 <= len(s.split()) <= 40 or (not s.isascii() and 8 <= len(s) <= 200))]
    if len(languages.names) < 2 or not found:
        return found
    top = languages.scores([s for _, s in found])
    clear = np.diff(np.sort(top, axis=1)[:, -2:], axis=1)[:, 0] > CLEAR
    return [x for x, name, sure in zip(found, top.argmax(1), clear) if sure and x[0] == languages.names[name]]


def fit(real: list[tuple], labelled: list[tuple[str, str]], precision: float = PRECISION) -> Classifier:
    """A classifier from real pairs (question, answer, gold) and labelled texts (language, text)."""
    languages = Languages.fit(labelled)
    found = clear_sentences(labelled, languages)
    featured = Featured(languages)
    # real pairs that a fit on the other half of the questions finds broken are no sound ones
    pairs, y, group, own = broken(real, found, languages, unsaid=False)
    rows, hot, fold = _Rows(*featured.of(pairs)), _hot(y), group % 2
    trusted = np.array([y[i] >= 0 or own[i] < 0 or _holds(pairs[i]) for i in range(len(y))])
    clean = np.zeros(len(real), bool)
    for half in (0, 1):
        learn, ask = np.flatnonzero((fold != half) & trusted), np.flatnonzero((fold == half) & (own >= 0))
        if len(learn) and len(ask):
            clean[own[ask]] = (rows.at(ask).scored(_fitted(rows.at(learn), hot[learn], ROUNDS)) < DOUBT).all(1)
    if clean.any():
        pairs, y, group, own = broken([r for r, keep in zip(real, clean) if keep], found, languages)
        rows, hot = _Rows(*featured.of(pairs)), _hot(y)
    whole = _fitted(rows, hot, ROUNDS)
    # each part of the questions and wordings is scored by a fit on the others
    score, part = np.zeros((len(y), len(DEFECTS)), np.float32), group % FOLDS
    for k in range(FOLDS):
        learn, asked = np.flatnonzero(part != k), np.flatnonzero(part == k)
        if len(learn) and len(asked):
            score[asked] = rows.at(asked).scored(_fitted(rows.at(learn), hot[learn], ROUNDS))
    threshold = [_calibrated(score[:, k], y == k, precision) if (y == k).any() else np.inf for k in range(len(DEFECTS))]
    return Classifier(whole, np.array(threshold, np.float32), languages)


def _hot(y: np.ndarray) -> np.ndarray:
    return (np.arange(len(DEFECTS)) == y[:, None]).astype(np.float32)


def _holds(pair: tuple) -> bool:
    """The answer holds all words of the gold answer: more likely sound than not."""
    told = set(plain(pair[2] or ""))
    return bool(told) and told <= set(plain(pair[1] or ""))


def paired(questions: DataFrame, answers: DataFrame) -> DataFrame:
    """(question_id, answer_id, question, answer, gold): each answer with its question, and each gold answer as answer 0."""
    q = questions.select(F.col("question_id").alias("question_id"), F.col("question").alias("question"), F.col("gold_answer").alias("gold"))
    a = answers.select(F.col("question_id").alias("question_id"), F.col("answer_id").cast("long").alias("answer_id"), F.col("answer").alias("answer"))
    own = q.select("question_id", F.lit(0).cast("long").alias("answer_id"), "question", F.col("gold").alias("answer"), F.lit(None).cast("string").alias("gold"))
    return a.join(q, "question_id").select("question_id", "answer_id", "question", "answer", "gold").union(own)


def _drawn(rows: DataFrame, by, share: float, limit: int) -> list:
    """At most `limit` rows, drawn by a hash."""
    return rows.where(F.pmod(by, F.lit(1 << 20)) < int(min(1.0, share) * (1 << 20)) + 1).limit(limit).collect()


def train(questions: DataFrame, answers: DataFrame, texts: DataFrame | None = None, text: str = "text", lang: str = "lang", sample: int = SAMPLE, precision: float = PRECISION) -> Classifier:
    """Fit on about `sample` answers with their questions, and about PER_LANGUAGE texts of each of the LABELS most frequent languages."""
    n = answers.count()
    drawn = answers.where(F.pmod(F.xxhash64("answer_id", "question_id"), F.lit(1 << 20)) < int(min(1.0, sample / max(1, n)) * (1 << 20)) + 1).limit(2 * sample)
    asked = questions.select(F.col("question_id").alias("question_id"), F.col("question").alias("question"), F.col("gold_answer").alias("gold"))
    met = F.broadcast(drawn.select("question_id", "answer")).join(asked, "question_id").collect()
    # an answer of the sample and the gold answer to its question
    real = sorted({(r["question"] or "", r["answer"] or "", r["gold"] or "") for r in met} | {(r["question"] or "", r["gold"], "") for r in met if r["gold"]})
    if len(real) < FEW:
        real += [p for p in BUILT_IN for _ in range(FEW // len(BUILT_IN))]
    labelled: list[tuple[str, str]] = []
    if texts is not None:
        named = texts.where(F.length(F.trim(F.col(lang))) >= 2).select(F.lower(F.substring(F.trim(F.col(lang)), 1, 2)).alias("_l"), F.col(text).alias("_t"))
        sizes = {r["_l"]: r["count"] for r in named.groupBy("_l").count().orderBy(F.desc("count"), "_l").limit(LABELS).collect()}
        shares = F.create_map(*[F.lit(x) for k, c in sizes.items() for x in (k, min(1.0, PER_LANGUAGE / c))]) if sizes else None
        if shares is not None:
            some = named.where("_t IS NOT NULL").where(F.pmod(F.xxhash64("_t"), F.lit(1 << 20)) < F.try_element_at(shares, F.col("_l")) * (1 << 20)).limit(2 * PER_LANGUAGE * len(sizes))
            labelled = sorted((r["_l"], r["_t"]) for r in some.collect())
    return fit(real, labelled, precision)


def defective(questions: DataFrame, answers: DataFrame, texts: DataFrame | None = None, sample: int = SAMPLE, precision: float = PRECISION) -> DataFrame:
    """(question_id, answer_id, defect) of the defective pairs; a pair has one defect at most.

    texts: (text, lang), from which the languages are learned; wrong and missing labels do
    little harm. Without it no answer is in another language. A null answer is empty. A null
    question is in no language and is copied by none. Answers to unknown questions are no
    pairs. Repeated answers count each. Empty tables give no rows.
    """
    model = train(questions, answers, texts, sample=sample, precision=precision)
    pairs = paired(questions, answers)
    shared = pairs.sparkSession.sparkContext.broadcast(model.parts())

    def judge(batches):
        model = Classifier.of(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                found = model.defects(list(zip(*(part.column(i).to_pylist() for i in (2, 3, 4)))))
                mask = pa.array([d is not None for d in found], pa.bool_())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.string())], names=["question_id", "answer_id", "defect"]).filter(mask)

    return pairs.mapInArrow(judge, "question_id string, answer_id long, defect string")
