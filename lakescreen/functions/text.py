"""Text functions on columns."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: The header words that tell a document type, in the order they are tried.
HEADERS = (
    ("PASSPORT", "passport"),
    ("PASSEPORT", "passport"),
    ("PASAPORTE", "passport"),
    ("VISA", "visa"),
)

# Characters that readers confuse, where letters or where digits are expected, and the ambiguous ones.
LETTER_FIXES = {"0": "O", "1": "I", "2": "Z", "5": "S", "6": "G", "8": "B"}
DIGIT_FIXES = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "Z": "2", "S": "5", "B": "8", "G": "6"}
AMBIGUOUS = "O0Qo1lI|5S2Z8B6G"
# What stands for another character in a line as it was read.
LINE_FIXES = {"«": "<", "»": ">", "‘": "'", "’": "'", "`": "'", "“": '"', "”": '"', "—": "-", "–": "-", "•": ""}
# Months by their first three letters.
MONTHS = ("JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once for a row."""
    return F.element_at(F.transform(F.array(value), then), 1)


def letters(c: Column) -> Column:
    """Digits that readers take letters for, as those letters."""
    return F.translate(c, "".join(LETTER_FIXES), "".join(LETTER_FIXES.values()))


def digits(c: Column) -> Column:
    """Letters of either case that readers take digits for, as those digits."""
    upper, values = "".join(DIGIT_FIXES), "".join(DIGIT_FIXES.values())
    return F.translate(c, upper + upper.lower(), values * 2)


def by_neighbours(c: Column) -> Column:
    """Left to right, a character beside a digit becomes a digit, one beside a letter a letter, where a confusion is known.

    The character before counts as already repaired, the one after as it was read.
    """
    at = F.split(c, "")

    def step(done: Column, i: Column) -> Column:
        here, before, after = F.element_at(at, (i + 1).cast("int")), F.right(done, F.lit(1)), F.coalesce(F.try_element_at(at, (i + 2).cast("int")), F.lit(""))
        is_digit, is_letter = r"^\p{Nd}$", r"^\p{L}$"
        number, word = before.rlike(is_digit) | after.rlike(is_digit), before.rlike(is_letter) | after.rlike(is_letter)
        return F.concat(done, F.when(number, F.when(here.rlike(is_letter), digits(here)).otherwise(here)).when(word, F.when(here.rlike(is_digit), letters(here)).otherwise(here)).otherwise(here))

    return F.when(c == "", c).otherwise(F.aggregate(F.sequence(F.lit(0), F.length(c) - 1), F.lit(""), step))


def ambiguous(c: Column) -> Column:
    """Whether a token holds a character that readers confuse."""
    return c.rlike(f"[{AMBIGUOUS}]")


@F.pandas_udf(StringType())
def nfkc(column: pd.Series) -> pd.Series:
    """Unicode compatibility composition, which Spark has no function for."""
    return column.str.normalize("NFKC")


def substituted(c: Column) -> Column:
    """Quotes, dashes, guillemets and bullets as their plain forms."""
    kept = {k: v for k, v in LINE_FIXES.items() if v}
    return F.translate(c, "".join(kept) + "•", "".join(kept.values()))


def zone_clean(c: Column) -> Column:
    """A zone line in its alphabet: brackets and unknown marks as fillers, strokes as I; lines of fewer than 20 characters stay."""
    flat = F.replace(F.upper(c), F.lit(" "))
    known = F.translate(flat, "()[]{}!|§°", "<<<<<<IIII")
    return F.when(F.length(flat) < 20, c).otherwise(F.regexp_replace(known, r"[^\p{L}\p{Nd}<]", "<"))


def zone_fixes(c: Column) -> Column:
    """How many characters zone_clean replaces."""
    flat = F.replace(F.upper(c), F.lit(" "))
    return F.when(F.length(flat) < 20, 0).otherwise(F.regexp_count(flat, F.lit(r"[^\p{L}\p{Nd}<]")))


def person_name(c: Column) -> Column:
    """Letters, spaces, apostrophes and hyphens only."""
    return F.trim(F.regexp_replace(c, r"[^A-Za-z '\-]", ""))


def gender(c: Column) -> Column:
    """Male for what begins with M (but MISS), Female for F, else null."""
    v = F.upper(strip(c))
    return F.when(v.startswith("M") & (v != "MISS"), "Male").when(v.startswith("F"), "Female")


def password_lack(c: Column) -> Column:
    """What a password lacks, or null: twelve characters, a lower-case letter, an upper-case letter, a digit."""
    return (
        F.when(F.length(c) < 12, "at least 12 characters")
        .when(~c.rlike(r"\p{Ll}"), "a lowercase letter")
        .when(~c.rlike(r"\p{Lu}"), "an uppercase letter")
        .when(~c.rlike(r"\p{Nd}"), "a digit")
    )


def user_name_ok(c: Column) -> Column:
    """3 to 64 letters, digits, dots, dashes and underscores, white space at the ends aside."""
    return strip(c).rlike(r"^[\p{L}\p{N}._-]{3,64}$")


def has_token(c: Column, tokens: Iterable[str]) -> Column:
    """Whether any of the tokens stands in the text, whatever its case."""
    low, out = F.lower(c), F.lit(False)
    for token in tokens:
        out = out | F.contains(low, F.lit(token))
    return out


def strip(c: Column) -> Column:
    """Without white space at both ends, tabs, breaks and Unicode spaces included."""
    return F.regexp_replace(F.regexp_replace(c, r"^(?U)\s+", ""), r"(?U)\s+$", "")


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")


def collapse(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def redact_digits(c: Column) -> Column:
    """Runs of six or more digits, of any script, become ######."""
    return F.regexp_replace(c, r"(?U)\d{6,}", "######")


def mrz_like(line: Column) -> Column:
    """Whether a line looks like a machine-readable zone: 28 characters or more, over 80 % letters or fillers, three fillers."""
    flat = F.regexp_replace(F.upper(line), r"\s", "")
    size = F.length(flat)
    return (size >= 28) & (F.length(F.regexp_replace(flat, "[^A-Z<]", "")) > 0.8 * size) & (F.regexp_count(flat, F.lit("<")) >= 3)


def header_type(text: Column, hint: Column) -> Column:
    """The hint, unless it is unknown, or else the type that the first six lines name; null without either."""
    head = F.upper(F.array_join(F.slice(F.split(text, "\n"), 1, 6), " "))
    out = F.lit(None).cast("string")
    for word, kind in reversed(HEADERS):
        out = F.when(F.contains(head, F.lit(word)), kind).otherwise(out)
    return F.coalesce(F.nullif(F.nullif(hint, F.lit("unknown")), F.lit("")), out)


def short_id(c: Column, keep: int = 12) -> Column:
    return F.when(F.length(c) > keep, F.concat(F.left(c, F.lit(keep)), F.lit("…"))).otherwise(c)


def rightmost_hop(c: Column) -> Column:
    """The last non-empty part of a comma list."""
    parts = F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.try_element_at(parts, F.lit(-1))


# Fixed value: what may be a date in running text: day, month's name, year; or numbers with the year first or last.
_DATE = r"\b(\d{1,2}[ ./\-][A-Za-z0-9]{3,9}[ ./\-]\d{2,4}|\d{4}[.\-/]\d{1,2}[.\-/]\d{1,2}|\d{1,2}[.\-/]\d{1,2}[.\-/]\d{2,4})\b"


def normal_date(c: Column) -> Column:
    """A date token as yyyy-mm-dd without a calendar check, or null: d-Mon-yyyy, y-m-d, d-m-yyyy, d-m-yy (up to 49 is 20yy)."""
    p = F.split(F.translate(strip(c), "./ ", "---"), "-")
    a, b, z = (F.try_element_at(p, F.lit(i)) for i in (1, 2, 3))
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.upper(F.left(b, F.lit(3))))
    first = a.rlike(r"^\d{4}$")
    day, number = F.when(first, z).otherwise(a).try_cast("int"), b.try_cast("int")
    short = z.try_cast("int")
    year = F.when(first, a).when(z.rlike(r"^\d{4}$"), z).when(z.rlike(r"^\d{2}$"), (short + F.when(short <= 49, 2000).otherwise(1900)).cast("string"))
    two = lambda n: F.lpad(n.cast("string"), 2, "0")
    named = b.rlike("^[A-Za-z]{3,9}$") & (month > 0) & z.rlike(r"^\d{4}$") & a.rlike(r"^\d{1,2}$")
    numeric = b.rlike(r"^\d{1,2}$") & F.when(first, z).otherwise(a).rlike(r"^\d{1,2}$") & number.between(1, 12) & day.between(1, 31)
    return F.when(F.size(p) == 3, F.when(named, F.concat_ws("-", z, two(month), two(day))).when(numeric & year.isNotNull(), F.concat_ws("-", year, two(number), two(day))))


def date_tokens(c: Column) -> Column:
    """Dates in running text, in order, as normal_date gives them."""
    return F.array_compact(F.transform(F.regexp_extract_all(c, F.lit(_DATE), F.lit(1)), normal_date))


# Letters that readers take for digits in a date.
DATE_FIXES = {"O": "0", "o": "0", "I": "1", "l": "1", "S": "5", "B": "8"}


def expiry_date(c: Column) -> Column:
    """A day of several shapes, after letters that stand for digits are put right: ISO, d Mon yyyy, d Month yyyy, d/m/yyyy, m/d/yyyy. Months whose name
    has such a letter are lost with it."""
    fixed = F.translate(strip(c), "".join(DATE_FIXES), "".join(DATE_FIXES.values()))
    shapes = ("d MMM yyyy", "d MMMM yyyy", "d/M/yyyy", "M/d/yyyy")
    iso = fixed.rlike(r"^\d{4}-\d{2}-\d{2}$")
    return F.when(iso, F.try_to_date(fixed, "yyyy-MM-dd")).otherwise(F.coalesce(*[F.try_to_date(fixed, s) for s in shapes], F.try_to_date(fixed, "yyyy-M-d")))


def age_label(then: Column, now: Column) -> Column:
    minutes = F.floor((F.unix_timestamp(now) - F.unix_timestamp(then)) / 60 + 0.5)
    hours = F.floor(minutes / 60 + 0.5)
    return F.when(minutes < 60, F.concat(minutes, F.lit("m ago"))).when(hours < 48, F.concat(hours, F.lit("h ago"))).otherwise(F.concat(F.floor(hours / 24 + 0.5), F.lit("d ago")))
