"""Personal data with offset-preserving deobfuscation.

Base identifiers (email, ip, card, phone) are found in the text as it is. Then transducers rewrite
disguises one after the other - first homoglyphs, full-width forms and invisible characters, then spelled
digits, then ``at``, ``dot`` and ``plus`` written out - and note for every piece of their output where it came
from. The same detectors run on the rewritten text, with and without the spelled digits, as a digit word
after an identifier would else be taken into it. A span that touches a rewritten piece is mapped back through
the passes to source characters and added, unless it overlaps an earlier span of its kind: base spans come
first and always stay, then those found without the spelled digits.

All detectors are linear in the length of the text. Offsets are code points, ends exclusive.

Edge cases: a null or empty text has no spans; repeated rows give equal rows; an empty table gives an empty
result; only the id and the text are read, other columns pass through ``redact`` untouched.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import small_batches, text_of

KINDS = ("email", "ip", "card", "phone")
_ORDER = {kind: n for n, kind in enumerate(KINDS)}

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

# fixed values: characters that look like an ASCII letter, sign or digit (Cyrillic, Greek, punctuation)
_HOMOGLYPHS = dict(
    zip(
        "аеорсухіјѕԁԛԝһьАВЕЗКМНОРСТУХІЈЅ" "αορτυνικΑΒΕΖΗΙΚΜΝΟΡΤΥΧ" "‐‑‒–—−․。∙·" "⁺٠۰",
        "aeopcyxijsdqwhbABE3KMHOPCTYXIJS" "aoptuvikABEZHIKMNOPTYX" "------...." "+00",
        strict=True,
    )
)
# full-width forms are a fixed distance from ASCII; these code points print nothing
_GLYPHS = _HOMOGLYPHS | {chr(c + 0xFEE0): chr(c) for c in range(0x21, 0x7F)} | {chr(c): "" for c in (0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF)}
_GLYPH = re.compile(f"[{re.escape(''.join(_GLYPHS))}]+")
_DIGITS = {word: str(n) for n, word in enumerate("zero one two three four five six seven eight nine".split())} | {"oh": "0"}
_DIGIT = r"(?:zero|one|two|three|four|five|six|seven|eight|nine)"
# a run of digit words is one number; "oh" counts after another digit word or right before one
_SPELLED = re.compile(
    rf"\b(?=[zotfsen])(?:oh[\x20-])?{_DIGIT}\b(?:[\x20-](?:{_DIGIT}|oh)\b)*", re.IGNORECASE | re.ASCII
)
_AT = r"\x20?[\[({<]\x20?at\x20?[\])}>]\x20?"
_DOT = r"\x20?[\[({<]\x20?dot\x20?[\])}>]\x20?"
_LABEL = r"[A-Za-z0-9-]{1,63}"
# fixed values: common last labels of host names
_TOP = r"(?:com|org|net|edu|gov|info|biz|io|co|uk|de|fr|es|eu|it|nl|ch|at|us|ca|au)\b"
# bare "at" and "dot" count only in the form "name at host dot top" with a common last label, "dot" between
# digits as well; "plus" counts before a digit
_WRITTEN = re.compile(
    rf"(?P<at>{_AT}|(?<=[A-Za-z0-9])\x20at\x20(?=(?:{_LABEL}(?:{_DOT}|\x20dot\x20|\.)){{1,6}}{_TOP}))"
    rf"|(?P<dot>{_DOT}|(?<=[A-Za-z0-9])\x20dot\x20(?=(?:{_LABEL}(?:{_DOT}|\x20dot\x20|\.)){{0,6}}{_TOP})"
    r"|(?<=[0-9])\x20dot\x20(?=[0-9]))"
    r"|(?P<plus>\bplus[\x20-]?(?=[0-9]))",
    re.IGNORECASE | re.ASCII,
)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def _luhn(digits: str) -> bool:
    total = 0
    for n, c in enumerate(reversed(digits)):
        value = ord(c) - 48
        if n % 2:
            value = value * 2 - 9 if value > 4 else value * 2
        total += value
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    """Leftmost, non-overlapping: each @ takes the local part back to the previous match or another sign."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at) if start < at else None
        if found:
            done = found.end()
            yield Span("email", start, done)
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """The base identifiers by start, then kind as listed in ``KINDS``."""
    spans = list(_emails(text))
    for found in _IP.finditer(text):
        if all(int(part[-4:]) <= 255 and len(part.lstrip("0")) <= 3 for part in found[0].split(".")):
            spans.append(Span("ip", *found.span()))
    for found in _CARD.finditer(text):
        if found.end() - found.start() >= 14:
            digits = _NOT_DIGIT.sub("", found[0])
            if 14 <= len(digits) <= 19 and _luhn(digits):
                spans.append(Span("card", *found.span()))
    if "+" in text:
        for found in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", found[0])) <= 15:
                spans.append(Span("phone", *found.span()))
    return sorted(spans, key=lambda s: (s.start, _ORDER[s.kind]))


class Rewritten(NamedTuple):
    """Transducer output: the text, and per piece its place there, its place in the source and both lengths."""

    text: str
    out: list[int]
    source: list[tuple[int, int, bool]]

    def back(self, start: int, end: int) -> tuple[int, int, bool]:
        """Source span of an output span, and whether a rewritten piece takes part in it."""
        first = bisect.bisect_right(self.out, start) - 1
        last = bisect.bisect_left(self.out, end) - 1
        at, _, new = self.source[first]
        begin = at if new else at + start - self.out[first]
        at, stop, new = self.source[last]
        finish = stop if new else at + end - self.out[last]
        # characters that were dropped leave a source span of another length
        changed = finish - begin != end - start or any(self.source[k][2] for k in range(first, last + 1))
        return begin, finish, changed


def _glyphs(found: re.Match) -> Iterator[tuple[str, int, int]]:
    for k, glyph in enumerate(found[0], found.start()):
        yield _GLYPHS[glyph], k, k + 1


def _digits(found: re.Match) -> Iterator[tuple[str, int, int]]:
    at = found.start()
    for word in found[0].lower().replace("-", " ").split(" "):
        yield _DIGITS[word], at, at + len(word)
        at += len(word) + 1


def _signs(found: re.Match) -> Iterator[tuple[str, int, int]]:
    yield "@" if found["at"] else "." if found["dot"] else "+", *found.span()


def _rewritten(text: str, pattern: re.Pattern, pieces_of) -> Rewritten | None:
    """One pass: every match replaced by the pieces (text, start, end) made of it; None if there is no match."""
    pieces: list[str] = []
    out: list[int] = []
    source: list[tuple[int, int, bool]] = []
    length = done = 0

    def put(piece: str, start: int, end: int, new: bool) -> None:
        nonlocal length
        if piece:
            pieces.append(piece)
            out.append(length)
            source.append((start, end, new))
            length += len(piece)

    for found in pattern.finditer(text):
        start, end = found.span()
        put(text[done:start], done, start, False)
        for piece in pieces_of(found):
            put(*piece, True)
        done = end
    if not done:
        return None
    put(text[done:], done, len(text), False)
    return Rewritten("".join(pieces), out, source)


def rewrites(text: str) -> Iterator[list[Rewritten]]:
    """The passes that undo the disguises, each over the text of the one before; first without spelled digits."""
    glyphs = None if text.isascii() else _rewritten(text, _GLYPH, _glyphs)
    plain = glyphs.text if glyphs else text
    spelled = _rewritten(plain, _SPELLED, _digits)
    for digits in [None, spelled] if spelled else [None]:
        signs = _rewritten(digits.text if digits else plain, _WRITTEN, _signs)
        passes = [p for p in (glyphs, digits, signs) if p]
        if passes and passes[-1].text:
            yield passes


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """(base spans, base and deobfuscated spans), each by start, then kind."""
    base = base_spans(text)
    spans = list(base)
    for passes in rewrites(text):
        taken = {kind: sorted((s.start, s.end) for s in spans if s.kind == kind) for kind in KINDS}
        for span in base_spans(passes[-1].text):
            start, end, new = span.start, span.end, False
            for made in reversed(passes):
                start, end, changed = made.back(start, end)
                new = new or changed
            if new:
                near = bisect.bisect_left(taken[span.kind], (end,))
                if near == 0 or taken[span.kind][near - 1][1] <= start:
                    spans.append(Span(span.kind, start, end))
    return base, sorted(spans, key=lambda s: (s.start, _ORDER[s.kind]))


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: ``id_col``, n_email, n_ip, n_card, n_phone (base counts), base, spans.

    ``base`` and ``spans`` list ``kind:start:end``, comma-joined, by start and kind.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_id"), text_of(text_col).alias("_text"))

    @F.pandas_udf("n_email long, n_ip long, n_card long, n_phone long, base string, spans string")
    def detect(texts: pd.Series) -> pd.DataFrame:
        found = [all_spans(text) for text in texts]
        columns: dict[str, list] = {f"n_{kind}": [sum(s.kind == kind for s in base) for base, _ in found] for kind in KINDS}
        columns["base"] = [_joined(base) for base, _ in found]
        columns["spans"] = [_joined(spans) for _, spans in found]
        return pd.DataFrame(columns)

    return rows.select(F.col("_id").alias(id_col), detect("_text").alias("_found")).select(id_col, "_found.*")


def masked(text: str) -> str:
    """The text with every span replaced by its kind in angle brackets; overlapping spans become one."""
    spans = all_spans(text)[1]
    if not spans:
        return text
    out, done = [], 0
    for span in spans:
        if span.start >= done:
            out += [text[done : span.start], f"<{span.kind.upper()}>"]
        done = max(done, span.end)
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with every identifier masked and, if the column is there, ``length_col`` set anew.

    A null text stays null.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts: pd.Series) -> pd.Series:
        return texts.map(masked, na_action="ignore")

    out = docs.withColumn(text_col, mask(F.col(text_col).cast("string")))
    if length_col in docs.columns:
        length = F.when(F.col(text_col).isNull(), F.col(length_col)).otherwise(F.char_length(text_col).cast("long"))
        out = out.withColumn(length_col, length.cast(docs.schema[length_col].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])
