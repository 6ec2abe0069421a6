"""Personal data in whole texts, also when it is disguised.

Plain patterns give the base spans. Transducers then rewrite disguises - homoglyphs, "at" and "dot" in words or
brackets, spelled digits - and keep, for every piece of the normalised text, the piece of the source it came from.
Identifiers found in the normalised text are mapped back, so every span is in code points of the source.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from crestline.llm.spans import Span, ordered, scan_texts

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_LOCAL_CHARS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_LONG_DIGITS = re.compile(r"[0-9](?:[ -]?[0-9]){13}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterable[tuple[int, int]]:
    """Leftmost, non-overlapping, found from the @ outwards: a long run without @ costs nothing."""
    taken = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > taken and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < m.start():
            yield start, m.end()
            taken = m.end()


def _ips(text: str) -> Iterable[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            yield m.span()


def _cards(text: str) -> Iterable[tuple[int, int]]:
    if _LONG_DIGITS.search(text):
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str) -> Iterable[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m.group()) <= 15:
                yield m.span()


_FINDERS: dict[str, Callable[[str], Iterable[tuple[int, int]]]] = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones}


def plain(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *span) for kind, find in _FINDERS.items() for span in find(text)]


# ---- transducers -------------------------------------------------------------------------------------------------

#: Letters of other scripts that look like a Latin letter, and the letter.
_LOOKALIKES = {
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "Х": "X", "У": "Y",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ι": "i", "κ": "k", "ɡ": "g", "ı": "i", "‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "․": ".", "。": ".",
}
#: Characters without width.
_INVISIBLE = "­​‌‍⁠﻿"
#: Digits 0 to 9 in four languages.
_SPELLED = (
    "zero one two three four five six seven eight nine",
    "null eins zwei drei vier fünf sechs sieben acht neun",
    "zéro un deux trois quatre cinq six sept huit neuf",
    "cero uno dos tres cuatro cinco seis siete ocho nueve",
)


def _homoglyphs() -> dict[str, str]:
    """Lookalikes, invisible characters, spaces, decimal digits of any script, compatibility forms of one ASCII character."""
    out = dict(_LOOKALIKES) | dict.fromkeys(_INVISIBLE, "")
    for code in [*range(0x80, 0x3000), *range(0xFE50, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        if (digit := unicodedata.decimal(c, None)) is not None:
            out[c] = str(digit)
        elif unicodedata.category(c) == "Zs":
            out[c] = " "
        elif unicodedata.category(c)[0] in "LNPS" and len(plain_form := unicodedata.normalize("NFKC", c)) == 1 and "!" <= plain_form <= "~":
            out[c] = plain_form
    return out


_HOMOGLYPHS = _homoglyphs()
_DIGIT_OF = {w: str(i) for line in _SPELLED for i, w in enumerate(line.split())} | {"oh": "0"}
_AT_WORD, _DOT_WORD = "(?:at|arroba|arobase)", "(?:dot|punkt|punto|point)"
_DIGIT_WORD = "(?:" + "|".join(sorted(_DIGIT_OF, key=len, reverse=True)) + ")"
_DIGIT_RUN = re.compile(rf"(?<!\w)(?:(?:plus|más)\s+)?{_DIGIT_WORD}(?:[\s,.-]+(?:{_DOT_WORD}\s+)?{_DIGIT_WORD})+(?!\w)", re.I)
_DIGIT_ONE = re.compile(rf"(?<!\w)(?:{_DIGIT_WORD}|{_DOT_WORD}|plus|más)(?!\w)", re.I)
_BRACKETED = re.compile(rf"\s*[\[({{<]\s*(?:({_AT_WORD}|@)|({_DOT_WORD}|\.))\s*[\])}}>]\s*", re.I)
_NAME = "[A-Za-z0-9_%+-]+"
_BARE = re.compile(rf"(?<![A-Za-z0-9_%+.-])({_NAME}(?:(?:\.|\s+{_DOT_WORD}\s+){_NAME})*)(\s+{_AT_WORD}\s+|@)({_NAME}(?:(?:\.|\s+{_DOT_WORD}\s+){_NAME})+)", re.I)
_BARE_DOT = re.compile(rf"\s+{_DOT_WORD}\s+", re.I)
_NUMBER_DOT = re.compile(rf"(?<=[0-9])\s+{_DOT_WORD}\s+(?=[0-9])", re.I)
_JOINED = re.compile(rf"(?<![A-Za-z0-9_*-])[A-Za-z0-9.%+]+([_*-]{_AT_WORD}[_*-])([A-Za-z0-9]+(?:[_*-]{_DOT_WORD}[_*-][A-Za-z0-9]+)+)", re.I)
_JOINED_DOT = re.compile(rf"[_*-]{_DOT_WORD}[_*-]", re.I)
_ENCODED = re.compile(r"&(?:#0*64|#x0*40|commat);|(?<=[A-Za-z0-9])%40(?=[A-Za-z0-9])|(&(?:#0*46|#x0*2e|period);)", re.I)
_SPACED = re.compile(r"(?<=[A-Za-z0-9])( +@ *| *@ +)(?=[A-Za-z0-9-]+ *\. *[A-Za-z0-9])|(?<=[A-Za-z0-9]@)[A-Za-z0-9-]+( +\. *| *\. +)(?=[A-Za-z0-9])")
_HINTS = ("dot", "punkt", "punto", "point", "at]", "at)", "at}", "at>", "at ]", "at )", "arroba", "arobase", "@]", "@)", ".]", ".)")

Edit = tuple[int, int, str]


class Rewritten:
    """A normalised text and, for each of its pieces, where the source piece starts and ends."""

    def __init__(self, source: str, edits: list[Edit]):
        out, self._at, self._src, at, pos = [], [], [], 0, 0
        for start, end, new in edits:
            for a, b, text, whole in ((pos, start, source[pos:start], False), (start, end, new, True)):
                if text:
                    self._at.append(at)
                    self._src.append((a, b, whole))
                    out.append(text)
                    at += len(text)
            pos = end
        if pos < len(source) or not out:
            self._at.append(at)
            self._src.append((pos, len(source), False))
            out.append(source[pos:])
        self.text = "".join(out)

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """The source's range, and whether any of it was rewritten or left out."""
        i, j = bisect_right(self._at, start) - 1, bisect_right(self._at, end - 1) - 1
        a, b, whole = self._src[i]
        first = a if whole else a + start - self._at[i]
        a, b, last_whole = self._src[j]
        last = b if last_whole else a + end - self._at[j]
        return first, last, whole or last_whole or last - first != end - start or any(x[2] for x in self._src[i : j + 1])


def _glyph_edits(text: str) -> list[Edit]:
    if text.isascii() or not (found := _HOMOGLYPHS.keys() & set(text)):
        return []
    return [(m.start(), m.end(), _HOMOGLYPHS[m.group()]) for m in re.finditer("[" + re.escape("".join(sorted(found))) + "]", text)]


def _bracket_edits(text: str) -> list[Edit]:
    return [(m.start(), m.end(), "@" if m.group(1) else ".") for m in _BRACKETED.finditer(text)]


def _bare_edits(text: str) -> list[Edit]:
    out: list[Edit] = []
    for m in _BARE.finditer(text):
        dots = [(m.start(g) + d.start(), m.start(g) + d.end(), ".") for g in (1, 3) for d in _BARE_DOT.finditer(m.group(g))]
        if dots or m.group(2) == "@":
            out += sorted([*dots, (m.start(2), m.end(2), "@")])
    return out


def _joined_edits(text: str) -> list[Edit]:
    out: list[Edit] = []
    for m in _JOINED.finditer(text):
        out += [(*m.span(1), "@"), *((m.start(2) + d.start(), m.start(2) + d.end(), ".") for d in _JOINED_DOT.finditer(m.group(2)))]
    return out


def _encoded_edits(text: str) -> list[Edit]:
    return [(m.start(), m.end(), "." if m.group(1) else "@") for m in _ENCODED.finditer(text)]


def _spaced_edits(text: str) -> list[Edit]:
    return [(*m.span(1), "@") if m.group(1) else (*m.span(2), ".") for m in _SPACED.finditer(text)]


def _digit_edits(text: str) -> list[Edit]:
    """Runs of spelled digits; a word for plus may begin a run and words for a dot may part it."""
    digit = lambda w: _DIGIT_OF.get(w, "+" if w in ("plus", "más") else ".")
    return [(m.start(), m.end(), "".join(digit(w.lower()) for w in _DIGIT_ONE.findall(m.group()))) for m in _DIGIT_RUN.finditer(text)]


def normalise(text: str) -> list[Rewritten]:
    """The transducers that changed something, in order; the last one's text is the normalised text."""
    done: list[Rewritten] = []

    def step(edits: list[Edit]) -> None:
        nonlocal text
        if edits:
            done.append(Rewritten(text, edits))
            text = done[-1].text

    step(_glyph_edits(text))
    low = text.lower()
    if any(h in low for h in _HINTS):
        step(_bracket_edits(text))
        step(_bare_edits(text))
        step(_joined_edits(text))
        step([(m.start(), m.end(), ".") for m in _NUMBER_DOT.finditer(text)])
    if "&#" in text or "%40" in text or "&commat" in text or "&period" in text:
        step(_encoded_edits(text))
    if " @" in text or "@ " in text or "@" in text and " ." in text:
        step(_spaced_edits(text))
        step(_spaced_edits(text))
    if not _DIGIT_OF.keys().isdisjoint(low.replace("-", " ").replace(",", " ").replace(".", " ").split()):
        step(_digit_edits(text))
    return done


def find_pii(text: str) -> list[Span]:
    """Base spans, then those that only the normalised text shows and that lie in no base span of their kind."""
    out = [Span(kind, a, b, True, text[a:b]) for kind, a, b in plain(text)]
    if steps := normalise(text):
        base = list(out)
        for kind, a, b in plain(steps[-1].text):
            edited = False
            for step in reversed(steps):
                a, b, changed = step.back(a, b)
                edited |= changed
            if edited and not any(x.kind == kind and x.start <= a and b <= x.end for x in base):
                out.append(Span(kind, a, b, False, text[a:b]))
    return ordered(out, KINDS)


def pii_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) for every row: kind, start, end, base, text; code points of the whole source text.

    Null and empty texts have no spans. Repeated rows and ids stay as they are; a null id stays null. Other columns
    are not read. Long texts cost time in proportion: patterns start from rare characters.
    """
    return scan_texts(docs, lambda: find_pii, id_col, text_col)
