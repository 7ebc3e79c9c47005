"""Extractive text kernels: sentences, keywords, and a summary by marginal relevance. Pure functions for Arrow batches."""

from __future__ import annotations

import math
import re

from quillfind.functions.text import STOP_WORDS

#: Bounds on sentences and sections, weight of relevance against novelty, and the bonus of word pairs.
SENTENCES, SECTIONS, RELEVANCE, PAIR_BONUS = 4096, 512, 0.7, 1.2

_STOP = frozenset(STOP_WORDS)
_RULE = re.compile(r"^\s*(?:[-*_=]\s*){3,}$")
_HEADING = re.compile(r"^\s{0,3}#{1,6}\s+")
_END = re.compile(r"(?<=[.!?])[\"'”’)\]]*\s+")
_LINK = re.compile(r"\[([^\[\]]*)\]\([^()\s]*\)")


def clean_line(line: str) -> str:
    """A line without the marks of lists and quotes, and with links as their texts."""
    return _LINK.sub(r"\1", re.sub(r"^\s*(?:[-*+]|\d+[.)]|>+)\s+", "", line)).strip()


def sections(text: str) -> list[list[str]]:
    """Sentences by section; headings begin a section, paragraphs do where there is none; fences and rules are skipped."""
    lines = text.splitlines()
    headed = any(line.lstrip().startswith("#") for line in lines)
    found, fenced, n, fresh = [[]], False, 0, False
    for line in lines:
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        elif fenced or _RULE.match(line):
            continue
        elif not line.strip():
            fresh = not headed
        else:
            heading = bool(_HEADING.match(line))
            if (heading or fresh) and found[-1] and len(found) < SECTIONS:
                found.append([])
            fresh = False
            for sentence in () if heading else _END.split(clean_line(line)):
                if sentence and n < SENTENCES:
                    found[-1].append(sentence)
                    n += 1
    return [s for s in found if s]


def terms(sentence: str) -> list[str | None]:
    """Words of 3 to 40 characters with a letter; whatever else stands between them is a break (None)."""
    words = (w.strip("'").lower() for w in re.split(r"[^\w']|_", sentence))
    return [w if w not in _STOP and 3 <= len(w) <= 40 and any(map(str.isalpha, w)) else None for w in words if w]


def units(sentence: str) -> list[str]:
    """The terms of a sentence, each with the pair it begins; no word is paired with itself."""
    ws = [*terms(sentence), None]
    return [u for a, b in zip(ws, ws[1:]) if a for u in ((a, f"{a} {b}") if b and b != a else (a,))]


def weighted(sentences: list[str]) -> tuple[list[dict[str, float]], dict[str, float]]:
    """(the units of each sentence with their weights, all weights): count times ln(1 + sentences / spread).

    Pairs need two sightings and have a bonus. Units are in the order of their first sight.
    """
    held = [units(s) for s in sentences]
    count: dict[str, int] = {}
    spread: dict[str, int] = {}
    for us in held:
        for u in us:
            count[u] = count.get(u, 0) + 1
        for u in set(us):
            spread[u] = spread.get(u, 0) + 1
    weight = {u: 0.0 if " " in u and n < 2 else n * math.log(1 + len(held) / spread[u]) * (PAIR_BONUS if " " in u else 1.0) for u, n in count.items()}
    return [{u: weight[u] for u in us} for us in held], weight


def keywords(text: str | None, most: int = 8) -> list[str]:
    """The weightiest words and word pairs.

    A pair takes up its words; ties stay in the order of first sight.
    """
    if not text:
        return []
    weight = weighted([s for section in sections(text) for s in section])[1]
    chosen: list[str] = []
    for u in sorted((u for u, w in weight.items() if w > 0), key=lambda u: -weight[u]):
        if any(u in c.split() for c in chosen):
            continue
        if " " in u:
            chosen = [c for c in chosen if c not in u.split()]
        chosen.append(u)
        if len(chosen) >= most:
            break
    return chosen


def select(text: str | None, most: int = 400) -> str:
    """The whole text if it fits; else one best sentence of each section, then the most novel relevant ones, in order.

    A sentence is as relevant as its weights are together, over the root of their number and
    one. Sections are lines of their own. If no sentence fits, the best one is cut.
    """
    if len(text or "") <= most:
        return (text or "").strip()
    parts = [(i, s) for i, section in enumerate(sections(text)) for s in section]
    if not parts:
        return ""
    vectors, _ = weighted([s for _, s in parts])
    size = [math.sqrt(sum(w * w for w in v.values())) for v in vectors]
    relevance = [sum(v.values()) / math.sqrt(len(v) + 1) for v in vectors]
    top = max(relevance)
    relevance = [r / top for r in relevance] if top > 0 else relevance
    nearest = [0.0] * len(parts)  # the likeness to the chosen sentence most like it
    taken = [False] * len(parts)
    room = most
    # only sentences that share a unit are alike
    holding: dict[str, list[int]] = {}
    for k, v in enumerate(vectors):
        for u in v:
            holding.setdefault(u, []).append(k)

    def take(i: int) -> None:
        nonlocal room
        taken[i] = True
        room -= len(parts[i][1])
        shared: dict[int, float] = {}
        for u, w in vectors[i].items():
            for k in holding[u] if w else ():
                shared[k] = shared.get(k, 0.0) + w * w
        for k, s in shared.items():
            nearest[k] = max(nearest[k], s / (size[k] * size[i]))

    of: dict[int, list[int]] = {}
    for k, (i, _) in enumerate(parts):
        of.setdefault(i, []).append(k)
    for inside in of.values():
        if fit := [k for k in inside if len(parts[k][1]) <= room]:
            take(max(fit, key=lambda k: (relevance[k], k)))
    while fit := [k for k in range(len(parts)) if not taken[k] and len(parts[k][1]) <= room]:
        take(max(fit, key=lambda k: (RELEVANCE * relevance[k] - (1 - RELEVANCE) * nearest[k], k)))
    if not any(taken):
        best = parts[max(range(len(parts)), key=lambda k: (relevance[k], k))][1]
        return best if len(best) <= most else best[: most - 1].rstrip() + "…"
    return "\n".join(" ".join(parts[k][1] for k in inside if taken[k]) for inside in of.values() if any(taken[k] for k in inside))


def title_and_body(text: str) -> tuple[str | None, str]:
    """The first heading, or a short line in front of a blank one, and the rest."""
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if not line.strip():
            continue
        if _HEADING.match(line):
            return _HEADING.sub("", line).strip(), "\n".join(lines[i + 1 :]).strip()
        if len(line) <= 160 and i + 1 < len(lines) and not lines[i + 1].strip():
            return line.strip(), "\n".join(lines[i + 1 :]).strip()
        break
    return None, text.strip()


def summary(text: str | None, most: int = 400) -> tuple[str, str]:
    """(summary, provenance): verbatim if it fits, else extractive and led by the title; empty without text."""
    if not text or not text.strip():
        return "", "empty"
    flat = " ".join(text.split())
    if len(flat) <= most:
        return flat, "verbatim"
    title, body = title_and_body(text)
    if title and len(title) + 2 < most:
        return f"{title}: {select(body, most - len(title) - 2)}", "extractive"
    return select(text, most), "extractive"
