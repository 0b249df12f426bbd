"""Personal data with offset-preserving deobfuscation.

A detector finds e-mail addresses, IP addresses, card numbers and phone numbers in a text as it stands
(the base spans).  Transducers then rewrite the text: homoglyphs, invisible characters, spelled digits
and disguises of at and dot.  Each rewritten character remembers the stretch of the source that it
stands for, so what the same detectors find in the rewritten text maps back to exact source offsets.
Spans that differ from every base span are added to the base ones, which stay beside them.

Input cases: a null text counts as empty and has no spans.  Repeated rows give repeated results.
Offsets are code points, ends are exclusive.  Whole texts are searched; every pattern takes time in
proportion to the text.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

from pyspark.sql import DataFrame

from .common import map_rows

KINDS = ("email", "ip", "card", "phone")
LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# Where a run of digits fails to start a match, no later digit of the run can: so only its start is tried.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")


def luhn(digits: str) -> bool:
    twice = [sum(divmod(2 * int(c), 10)) for c in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(twice)) % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern from left to right, found from their @ signs."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        a = at
        while a > done and text[a - 1] in LOCAL_CHARS:
            a -= 1
        m = DOMAIN.match(text, at + 1) if a < at else None
        if m:
            done = m.end()
            out.append((a, done))
        else:
            done = at + 1  # no address can begin before this sign and reach beyond it
        at = text.find("@", max(done, at + 1))
    return out


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def detect(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all spans, by start and then by kind as listed."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        if all(map(small, m.group().split("."))):
            found.append((*m.span(), 1))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = NOT_DIGIT.sub("", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= len(NOT_DIGIT.sub("", m.group())) <= 15:
                found.append((*m.span(), 3))
    found.sort(key=lambda x: (x[0], x[2], x[1]))
    return [(a, b, KINDS[k]) for a, b, k in found]


# Cyrillic and Greek letters that look like the Latin ones beside them.
LOOKALIKE = dict(zip("аеорсухіјѕһԁԛԝАВЕКМНОРСТХІЈЅοαινρκΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijshdqwABEKMHOPCTXIJSoaivpkABEZHIKMNOPTYX"))
INVISIBLE = frozenset("\xad\u200b\u200c\u200d\u2060\ufeff")
# The digits' names, in four languages.
DIGIT_WORDS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
}
WORD = "(?:" + "|".join(sorted(DIGIT_WORDS, key=len, reverse=True)) + ")"
SPOKEN_WORD = re.compile(rf"\b{WORD}\b", re.I)
#: Digits' names in a row, plain digits between them allowed, a plus before them.
SPOKEN = re.compile(rf"(?:\bplus[\s,-]{{1,3}}|\+\s?)?\b(?:{WORD}|[0-9]{{1,4}})(?:[\s,.-]{{1,3}}(?:{WORD}|[0-9]{{1,4}}))*\b", re.I)
SPOKEN_TOKEN = re.compile(rf"plus|\+|{WORD}|[0-9]", re.I)
AT = re.compile(r"\s{0,3}[(\[{<]\s{0,2}(?:at|@|arroba|ät|arobase)\s{0,2}[)\]}>]\s{0,3}", re.I)
DOT = re.compile(r"\s{0,3}[(\[{<]\s{0,2}(?:dot|\.|punto|punkt|point)\s{0,2}[)\]}>]\s{0,3}", re.I)
#: An address whose at is a bare word: its dots must be words or bracketed too.
BARE = re.compile(r"(?<![A-Za-z0-9._%+-])([A-Za-z0-9._%+-]{1,64})(\s{1,3}at\s{1,3})(?=[A-Za-z0-9-]{1,63}(?:\s{1,3}dot\s{1,3}|\s{0,3}[(\[{]\s?dot\s?[)\]}]\s{0,3})[A-Za-z0-9-])", re.I)
BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}dot\s{1,3}(?=[A-Za-z0-9])", re.I)
BRACKETED = re.compile(r"[(\[{<]\s{0,2}(?:at|@|dot|\.|arroba|ät|arobase|punto|punkt|point)\s{0,2}[)\]}>]", re.I)
#: A dot beside a digit's name in a run: it may part the numbers of an address.
DOTTED = re.compile(rf"\b{WORD}\.(?:{WORD}|[0-9])|[0-9]\.{WORD}\b", re.I)


def disguised(text: str, low: str) -> bool:
    """Whether any character or disguise of the text would be rewritten, digits' names apart."""
    return "dot" in low and BARE_DOT.search(text) is not None or any(c in text for c in "([{<") and BRACKETED.search(text) is not None or not text.isascii() and any(c >= "\x80" and glyph(c) != c for c in set(text))


def glyph(c: str) -> str:
    """The plain character that a code point looks like; empty for invisible ones."""
    if c < "\x80":
        return c
    if c in INVISIBLE:
        return ""
    if "！" <= c <= "～":
        return chr(ord(c) - 0xFEE0)
    d = unicodedata.digit(c, None)
    return LOOKALIKE.get(c, c) if d is None or unicodedata.category(c) != "Nd" else str(d)


class Tape:
    """A text under rewriting: for each character its source stretch, and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.start, self.end, self.new = list(range(len(text))), list(range(1, len(text) + 1)), bytearray(len(text))

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace stretches (in order, apart from each other); each new character stands for a whole stretch."""
        text, start, end, new, last = [], [], [], bytearray(), 0
        for a, b, put in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[last:a] + put)
            start += self.start[last:a] + [self.start[a]] * len(put) if put else self.start[last:a]
            end += self.end[last:a] + [self.end[b - 1]] * len(put) if put else self.end[last:a]
            new += self.new[last:a] + b"\x01" * len(put)
            last = b
        self.text, self.start, self.end, self.new = "".join(text), start, end, new


def spoken(text: str, dot: str):
    """Edits that turn runs of digits' names into digits; a dot alone between two of them becomes ``dot``."""
    for m in SPOKEN.finditer(text):
        run = m.group()
        if SPOKEN_WORD.search(run):
            last = m.start()
            for t in SPOKEN_TOKEN.finditer(run):
                a, b = m.start() + t.start(), m.start() + t.end()
                if a > last:
                    yield last, a, dot if text[last:a] == "." else ""
                word = t.group().lower()
                yield a, b, "+" if word in ("plus", "+") else DIGIT_WORDS.get(word, word)
                last = b


def rewritten(text: str, dot: str | None) -> list[tuple[int, int, str]]:
    """What the detectors find after rewriting, in source offsets; digits' names stay as they are if ``dot`` is None."""
    tape = Tape(text)
    tape.rewrite([(i, i + 1, g) for i, c in enumerate(text) if c >= "\x80" and (g := glyph(c)) != c])
    if dot is not None:
        tape.rewrite(list(spoken(tape.text, dot)))
    tape.rewrite([(*m.span(2), "@") for m in BARE.finditer(tape.text)])
    for pattern, put in ((AT, "@"), (DOT, "."), (BARE_DOT, ".")):
        tape.rewrite([(*m.span(), put) for m in pattern.finditer(tape.text)])
    return [(tape.start[a], tape.end[b - 1], kind) for a, b, kind in detect(tape.text)]


def added(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans that only show after rewriting, in source offsets."""
    plain = text if text.isascii() else "".join(map(glyph, text))
    words = SPOKEN_WORD.search(plain) is not None
    out = rewritten(text, None) if disguised(text, text.lower()) else []
    if words:
        seen = base + out
        for dot in ("", ".") if DOTTED.search(plain) else ("",):
            # A number's name before an address is no part of it: addresses that are known already don't grow.
            out += [s for s in rewritten(text, dot) if s[2] != "email" or not any(k == "email" and x < s[1] and s[0] < y for x, y, k in seen)]
    return [s for s in dict.fromkeys(out) if s not in base]


def spans(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans."""
    if not text:
        return [], []
    base = detect(text)
    more = added(text, base)
    return base, sorted(base + more, key=lambda x: (x[0], KINDS.index(x[2]), x[1])) if more else base


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redact(text: str | None, found: list[tuple[int, int, str]]) -> str | None:
    """The text with each stretch of overlapping spans replaced by the kind of its first span."""
    if not found:
        return text
    out, last = [], 0
    for a, b, kind in found:
        if a >= last:
            out.append(f"{text[last:a]}<{kind.upper()}>")
        last = max(last, b)
    return "".join(out) + text[last:]


def find(docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``columns`` plus ``found array<struct<start,end,kind,base>>`` of each whole text, by start."""

    def make():
        def one(text):
            base, every = spans(text)
            own = set(base)
            return ([{"start": a, "end": b, "kind": k, "base": (a, b, k) in own} for a, b, k in every],)

        return lambda texts: [one(t) for t in texts]

    return map_rows(docs, make, "found array<struct<start: int, end: int, kind: string, base: boolean>>", list(columns))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind, base_sha256, spans, n_added: what ``find`` finds, made in the same task."""

    def make():
        def one(text):
            base, every = spans(text)
            kinds = [k for _, _, k in base]
            return (*map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(every), len(every) - len(base))

        return lambda texts: [one(t) for t in texts]

    return map_rows(docs, make, "n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_added bigint", ["doc_id"])


def mask(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """``columns`` plus ``masked``: the text with personal data replaced by the kind, as in ``<EMAIL>``."""
    return map_rows(docs, lambda: lambda texts: [(redact(t, spans(t)[1]),) for t in texts], "masked string", list(columns))
