"""Personal data: base identifiers and disguised ones, as spans of the source text.

Base matches (``base_spans``) are e-mail addresses, dotted IPv4 addresses, card numbers that pass Luhn and international
phone numbers, leftmost and non-overlapping in each kind. They are found from anchors (an @, a chain of dotted numbers, a
plus sign), which gives what the plain pattern gives, in time linear in the text also where a run of letters or digits is very long.

Disguised matches (``disguised_spans``) come from a transducer: it rewrites look-alike letters and digits, bracketed or
spelled "at" and "dot", and runs of spelled digits, and keeps for each rewritten piece the source range it stands for. The
same detectors run over the rewritten text, and each hit is mapped back to source characters. A hit that overlaps no base
span of its kind is added; base spans stay as they are.

Defined cases: a null or empty text has no spans; repeated rows and null ids are kept row by row; an empty table gives no rows; other columns
pass through ``redact`` and are not read by ``detect``; the whole text is scanned, however long, in time linear in it.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        hit = _DOMAIN.match(text, at + 1) if start < at else None
        if hit:
            done = hit.end()
            yield "email", start, done
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[Span]:
    for chain in _CHAIN.finditer(text):
        parts = chain[0].split(".")
        start = chain.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield "ip", start, end
            start = end + 1


def _cards(text: str) -> Iterator[Span]:
    for hit in _CARD.finditer(text):
        digits = hit[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            yield "card", hit.start(), hit.end()


def _phones(text: str) -> Iterator[Span]:
    for hit in _PHONE.finditer(text):
        if 9 <= sum("0" <= c <= "9" for c in hit[0]) <= 15:
            yield "phone", hit.start(), hit.end()


_DIGIT = re.compile("[0-9]")


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) in code points, sorted by start and then by kind as listed in KINDS."""
    spans: list[Span] = []
    if "@" in text:
        spans += _emails(text)
    if _DIGIT.search(text):
        spans += _ips(text)
        spans += _cards(text)
        if "+" in text:
            spans += _phones(text)
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


# Letters of other scripts that look like ASCII, fullwidth forms by rule, and spelled digits.
_LOOKALIKE = dict(zip("аеорсухіјѕԁһкмнтвАВЕКМНОРСТХУІЈЅαοινρτΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "aeopcyxijsdhkmhtbABEKMHOPCTXYIJSaoivptABEZHIKMNOPTYX", strict=True))
_LOOKALIKE |= {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | {"․": ".", "。": ".", "‐": "-", "‑": "-", "–": "-"}
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "plus": "+"}
_NUMBER_WORD = r"(?:zero|oh|one|two|three|four|five|six|seven|eight|nine)"
_LOOKALIKES = re.compile("[" + re.escape("".join(_LOOKALIKE)) + "]")
_BRACKETED = re.compile(r"[\[({<]\s?(?:at|dot)\s?[\])}>]")
_DOT_WORD = re.compile(r"\bdot\b")
_AT_WORD = re.compile(r"\sat\s+[a-z0-9-]+\.")
#: Letters that re.I takes for i, s or k, but that lower() keeps or splits.
_ODD_CASE = re.compile("[\u0130\u0131\u017f\u212a]")
_NUMBERS = re.compile(r"\b" + _NUMBER_WORD + r"[\s-]+(?:" + _NUMBER_WORD + r"|[0-9])")
_REWRITE = re.compile(
    r"(?P<at>\s*[\[({<]\s?at\s?[\])}>]\s*)"
    r"|(?P<dot>\s*[\[({<]\s?dot\s?[\])}>]\s*)"
    r"|(?P<plainat>(?<=[a-z0-9])\s+at\s+(?=[a-z0-9-]+(?:\s+dot\s+|\s*[\[({<]\s?dot\s?[\])}>]\s*|\.)[a-z0-9-]))"
    r"|(?P<plaindot>(?<=[a-z0-9])\s+dot\s+(?=[a-z0-9]))"
    r"|(?P<digits>(?:\bplus\s+)?\b" + _NUMBER_WORD + r"(?:[\s-]+(?:" + _NUMBER_WORD + r"|[0-9]+))+\b)",
    re.I,
)
_NUMBER_TOKEN = re.compile(r"[a-z]+|[0-9]+", re.I)


def normalise(text: str) -> tuple[str, list[int], list[tuple[int, int, int]]]:
    """The rewritten text, the start of each piece in it, and (source start, source end, length) of the pieces."""
    source = text if text.isascii() else _LOOKALIKES.sub(lambda m: _LOOKALIKE[m[0]], text)
    out, starts, pieces, done, size = [], [], [], 0, 0

    def put(piece: str, start: int, end: int) -> None:
        nonlocal size
        if piece:
            out.append(piece)
            starts.append(size)
            pieces.append((start, end, len(piece)))
            size += len(piece)

    for hit in _REWRITE.finditer(source):
        put(source[done : hit.start()], done, hit.start())
        kind = hit.lastgroup
        if kind == "digits":
            for token in _NUMBER_TOKEN.finditer(hit[0]):
                put(_SPELLED.get(token[0].lower(), token[0]), hit.start() + token.start(), hit.start() + token.end())
        else:
            put("@" if kind in ("at", "plainat") else ".", hit.start(), hit.end())
        done = hit.end()
    put(source[done:], done, len(source))
    return "".join(out), starts, pieces


def _disguised(lower: str) -> bool:
    """Whether there may be anything to rewrite, at least where _REWRITE finds something; plain prose is passed over quickly."""
    if _BRACKETED.search(lower) or ("dot" in lower and _DOT_WORD.search(lower)):
        return True
    return _AT_WORD.search(lower) is not None or _NUMBERS.search(lower) is not None


def disguised_spans(text: str) -> list[Span]:
    """Spans of the source that are identifiers only after rewriting."""
    lookalike = not text.isascii() and (_LOOKALIKES.search(text) or _ODD_CASE.search(text)) is not None
    if not lookalike and not _disguised(text.lower()):
        return []
    rewritten, starts, pieces = normalise(text)

    def back(position: int, end: bool) -> int:
        k = bisect_right(starts, position - end) - 1
        source_start, source_end, length = pieces[k]
        if source_end - source_start == length:
            return source_start + position - starts[k]
        return source_end if end else source_start

    return [(kind, back(a, False), back(b, True)) for kind, a, b in base_spans(rewritten)]


def all_spans(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and base and added spans together, in order."""
    base = base_spans(text)
    starts: dict[str, list[int]] = {k: [] for k in KINDS}
    ends: dict[str, list[int]] = {k: [] for k in KINDS}
    for kind, start, end in base:
        starts[kind].append(start)
        ends[kind].append(end)

    def covered(kind: str, start: int, end: int) -> bool:
        """Base spans of a kind do not overlap, so the last that begins before the end decides."""
        k = bisect_left(starts[kind], end)
        return k > 0 and ends[kind][k - 1] > start

    more = [s for s in disguised_spans(text) if not covered(*s)]
    return base, sorted({*base, *more}, key=lambda s: (s[1], KINDS.index(s[0]), s[2])) if more else base


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """Each stretch that spans cover becomes one <KIND> mark, of the span that starts it."""
    out, done = [], 0
    for kind, start, end in spans:
        if start >= done:
            out += [text[done:start], f"<{kind.upper()}>"]
        done = max(done, end)
    return "".join([*out, text[done:]])


def detect(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans (each ARRAY<STRUCT<kind, start, end>>, code points, end exclusive) of each document."""
    span = "ARRAY<STRUCT<kind: STRING, start: BIGINT, end: BIGINT>>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            found = [all_spans(t or "") for t in batch.column(1).to_pylist()]
            rows = [[[{"kind": k, "start": a, "end": b} for k, a, b in spans] for spans in side] for side in zip(*found, strict=True)] or [[], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], kind), pa.array(rows[1], kind)], ["doc_id", "base", "spans"])

    return docs.select("doc_id", "text").mapInArrow(scan, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, base {span}, spans {span}")


def redact(docs: DataFrame, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with all found spans replaced in the text, and n_chars counted anew; a null text stays null."""

    @F.pandas_udf("string")
    def clean(column: pd.Series) -> pd.Series:
        return column.map(lambda t: t if t is None else redacted(t, all_spans(t)[1]), na_action="ignore")

    out = docs.withColumn(text, clean(F.col(text)))
    return out.withColumn(n_chars, F.length(text).cast(docs.schema[n_chars].dataType)) if n_chars in docs.columns else out
