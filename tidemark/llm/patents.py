"""Plain functions on patent texts: normal form, sections, phrases."""

from __future__ import annotations

import re
import unicodedata

#: Headings of the parts of a patent, in en, de, fr and zh.
ABSTRACT_HEADS = ("abstract", "(57) abstract", "summary", "zusammenfassung", "abrégé", "摘要")
DESCRIPTION_HEADS = ("description", "detailed description", "embodiments", "technical field and description", "beschreibung", "说明书")
CLAIM_HEADS = ("claims", "what is claimed is", "we claim", "ansprüche", "patentansprüche", "revendications", "权利要求书")

#: Characters that carry no text (soft hyphen, zero-width characters, byte-order mark).
INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_SPACES = re.compile(r"[^\S\n]+")
_NUMBERED = re.compile(r"\d+\s*\.\s*(\D.*)")
_MARKED_CLAIM = re.compile(r"\[claim\s*1\s*\]")
_KIND = {**dict.fromkeys(ABSTRACT_HEADS, "abstract"), **dict.fromkeys(DESCRIPTION_HEADS, "description"), **dict.fromkeys(CLAIM_HEADS, "claims")}
_HYPHENED = re.compile(r"(?<=\w)-\n\s*(?=\w)")


def normal(text: str) -> str:
    """Compatibility form, lower case, without invisible characters; words that a line end cut are whole again."""
    if not text.isascii() and any(c in text for c in INVISIBLE):
        text = _INVISIBLE.sub("", text)
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().replace("’", "'")
    if "-\n" in text:
        text = _HYPHENED.sub("", text)
    return _SPACES.sub(" ", text) if "  " in text or "\t" in text or "\r" in text else text


def _headings(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the lines that are headings."""
    out, at = [], 0
    for line in text.split("\n"):
        head = line.strip().rstrip(":：").rstrip()
        kind = _KIND.get(head)
        if kind is None and head[:1].isdigit() and (m := _NUMBERED.fullmatch(head)):
            kind = _KIND.get(m[1])
        if kind is not None:
            out.append((at, at + len(line), kind))
        at += len(line) + 1
    return out


def sections(text: str) -> dict[str, str]:
    """abstract, description, claims, of a text in normal form; parts without a heading go with the part before.

    ``open`` says that the abstract isn't closed by a heading, so that it may hold the description as well.
    """
    out = {"abstract": "", "description": "", "claims": ""}
    heads = _headings(text)
    claims = [h for h in heads if h[2] == "claims"]
    end = len(text)
    if claims:
        out["claims"], end = text[claims[-1][1] :], claims[-1][0]
    elif m := _MARKED_CLAIM.search(text):
        out["claims"], end = text[m.start() :], m.start()
    described = [h for h in heads if h[2] == "description" and h[0] < end]
    if described:
        out["description"], end = text[described[0][1] : end], described[0][0]
    else:
        out["open"] = "1"
    out["abstract"] = text[:end]
    return out


def invention(text: str) -> str:
    """The text on the invention itself: the claims, and the abstract where a heading closes it; without claims, the abstract as far as it goes."""
    parts = sections(text)
    if not parts["claims"].strip():
        return parts["abstract"]
    return parts["claims"] if "open" in parts else parts["abstract"] + "\n" + parts["claims"]


_BREAK = re.compile(r"[^\w\s'-]+|\n+|\d+")
_WORD = re.compile(r"\w+(?:['-]\w+)*'?")
_CJK = re.compile(r"[㐀-鿿豈-﫿]+")
MOST_WORDS, MOST_CHARACTERS = 4, 6


def phrases(text: str) -> set[str]:
    """Distinct runs of up to MOST_WORDS words within a clause, and of up to MOST_CHARACTERS Chinese characters."""
    out: set[str] = set()
    for clause in _BREAK.split(text):
        if not clause or clause.isspace():
            continue
        if not clause.isascii() and _CJK.search(clause):
            for run in _CJK.findall(clause):
                for n in range(1, MOST_CHARACTERS + 1):
                    out.update(run[i : i + n] for i in range(len(run) - n + 1))
            clause = _CJK.sub(" ", clause)
        words = _WORD.findall(clause)
        for n in range(1, MOST_WORDS + 1):
            out.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
    return out
