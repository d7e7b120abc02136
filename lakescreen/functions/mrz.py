"""Machine-readable zones: check digits, fields of two-line passports, repair of misread characters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGIT_FIXES, LETTER_FIXES, digits, let, letters

#: The public check digit rule (values 0-9, A-Z as 10-35, filler 0; weights 7, 3, 1).
ALPHABET, WEIGHTS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ", (7, 3, 1)


#: A letter's value modulo 10, which is all that the check digit depends on.
_LETTERS, _MODULO = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "01234567890123456789012345"


def check_digit(payload: Column, length: int | None = None) -> Column:
    """The check digit. The payload is read once, whether or not the rows' code is generated; its length, if known, gives the weights as a constant."""
    plain = F.split(F.translate(F.regexp_replace(payload, "[^0-9A-Z]", "0"), _LETTERS, _MODULO), "")
    value = lambda c: F.greatest(F.lit(0), F.ascii(c) - 48)
    if length is None:
        values = F.transform(plain, lambda c, i: value(c) * F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (i % 3 + 1).cast("int")))
    else:
        values = F.zip_with(plain, F.array(*[F.lit(WEIGHTS[i % 3]) for i in range(length)]), lambda c, w: F.coalesce(value(c) * w, F.lit(0)))
    return F.aggregate(values, F.lit(0), lambda a, x: a + x) % 10


def digit_ok(payload: Column, digit: Column, length: int | None = None) -> Column:
    """True or false, and null where the field is only fillers and carries a filler for its digit."""
    empty = (F.regexp_replace(payload, "<", "") == "") & (digit == "<")
    return F.when(~empty, check_digit(payload, length).cast("string") == digit)


def at(line: Column, start: int, end: int) -> Column:
    """Characters start to end (exclusive, from 0)."""
    return F.substring(line, start + 1, end - start)


def yymmdd(c: Column, as_of: Column, birth: bool) -> Column:
    """ISO date of six digits: years up to 49 are 20xx. A birth date in the future is a century earlier; null if it still is."""
    year = F.left(c, F.lit(2)).try_cast("int")
    full = F.when(year <= 49, year + 2000).otherwise(year + 1900)
    rest = F.concat(F.lit("-"), F.substring(c, 3, 2), F.lit("-"), F.substring(c, 5, 2))
    day = F.try_to_date(F.concat(full.cast("string"), rest), "yyyy-MM-dd")
    if birth:
        earlier = F.try_to_date(F.concat((full - 100).cast("string"), rest), "yyyy-MM-dd")
        day = F.when(day > as_of, F.when(earlier <= as_of, earlier)).otherwise(day)
    return F.date_format(day, "yyyy-MM-dd")


def parse_td3(top: Column, bottom: Column, as_of: Column) -> Column:
    """Fields of a two-line passport zone as a struct, each digit check true, false or null."""
    names = at(top, 5, 44)
    number, nationality = at(bottom, 0, 9), at(bottom, 10, 13)
    composite = F.concat(at(bottom, 0, 10), at(bottom, 13, 20), at(bottom, 21, 43))
    clean = lambda c: F.trim(F.regexp_replace(c, "<+", " "))
    return F.struct(
        F.regexp_replace(at(top, 0, 2), "<", "").alias("document_code"),
        F.regexp_replace(at(top, 2, 5), "<", "").alias("issuer"),
        clean(F.regexp_substr(names, F.lit("^.*?(?=<<|$)"))).alias("surname"),
        clean(F.regexp_replace(names, "^.*?(<<|$)", "")).alias("given_names"),
        F.regexp_replace(number, "<", "").alias("number"),
        digit_ok(number, at(bottom, 9, 10), 9).alias("number_ok"),
        F.regexp_replace(nationality, "<", "").alias("nationality"),
        yymmdd(at(bottom, 13, 19), as_of, True).alias("date_of_birth"),
        digit_ok(at(bottom, 13, 19), at(bottom, 19, 20), 6).alias("birth_ok"),
        F.when(at(bottom, 20, 21).isin("M", "F"), at(bottom, 20, 21)).alias("sex"),
        yymmdd(at(bottom, 21, 27), as_of, False).alias("expiry_date"),
        digit_ok(at(bottom, 21, 27), at(bottom, 27, 28), 6).alias("expiry_ok"),
        digit_ok(composite, at(bottom, 43, 44), 39).alias("composite_ok"),
    )


# Characters that a field's check digit may tell from each other, and how many of a field's are tried.
AMBIGUOUS = "ODQILZSBG015286"
MOST_PLACES = 8


def _other(c: Column) -> Column:
    """The character that c may stand for, a letter for a digit and a digit for a letter."""
    return F.translate(c, "".join(LETTER_FIXES) + "".join(DIGIT_FIXES), "".join(LETTER_FIXES.values()) + "".join(DIGIT_FIXES.values()))


def _bit(mask: Column, place: Column) -> Column:
    return F.call_function("shiftright", mask, place.cast("int")).bitwiseAND(F.lit(1))


def repair(payload: Column, digit: Column) -> Column:
    """The field in upper case without spaces, repaired by its check digit where that does not fit: the first eight characters that readers confuse are exchanged
    in all combinations, counted upwards with the first of them as the lowest bit, and the first combination that fits is taken. Where none fits, or the digit is
    missing or a filler, the field stays as it was read.

    A combination changes the sum of the check by the sum of its exchanges' differences, so all are judged by at most eight numbers and one text is built.
    """
    value = lambda c: F.greatest(F.lit(0), F.instr(F.lit(ALPHABET), c) - 1)
    weight = lambda i: F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (i - 1) % 3 + 1)

    def exchanged(read: Column, places: Column, mask: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            place = F.array_position(places, (i + 1).cast("int"))
            return F.when((place > 0) & (_bit(mask, place - 1) == 1), _other(c)).otherwise(c)

        return F.array_join(F.transform(F.split(read, ""), one), "")

    def searched(read: Column) -> Column:
        need = digit.cast("int") - check_digit(read)
        char = lambda i: F.substr(read, i, F.lit(1))
        places = F.slice(F.filter(F.sequence(F.lit(1), F.length(read)), lambda i: F.contains(F.lit(AMBIGUOUS), char(i))), 1, MOST_PLACES)
        changes = lambda at: F.transform(at, lambda i: (value(_other(char(i))) - value(char(i))) * weight(i))

        def first(at: Column) -> Column:
            last = F.call_function("shiftleft", F.lit(1), F.size(at)) - 1
            total = lambda c, m: F.aggregate(F.transform(c, lambda x, j: x * _bit(m, j)), F.lit(0), lambda a, x: a + x)
            fits = lambda c, wanted: F.filter(F.sequence(F.lit(1), last), lambda m: F.pmod(total(c, m) - wanted, F.lit(10)) == 0)
            found = let(F.struct(changes(at).alias("c"), need.alias("n")), lambda x: F.try_element_at(fits(x["c"], x["n"]), F.lit(1)))
            return let(found, lambda m: F.when(m.isNull(), read).otherwise(exchanged(read, at, m)))

        return let(places, lambda at: F.when(F.size(at) > 0, first(at)).otherwise(read))

    wanted = digit.rlike("^[0-9]$")
    return let(F.replace(F.upper(payload), F.lit(" ")), lambda read: F.when(wanted & (F.length(read) > 0) & (check_digit(read).cast("string") != digit), searched(read)).otherwise(read))


def parse_mrv_b(top: Column, bottom: Column, as_of: Column) -> Column:
    """Fields of a two-line visa zone of 36 characters; entries and stay stand in its optional data."""
    names, number, extra = at(top, 5, 36), at(bottom, 0, 9), at(bottom, 28, 36)
    clean = lambda c: F.trim(F.regexp_replace(c, "<+", " "))
    days = F.regexp_extract(at(bottom, 29, 31), "([0-9]{1,2})", 1).try_cast("int")  # a check digit follows
    return F.struct(
        F.regexp_replace(at(top, 2, 5), "<", "").alias("issuer"),
        clean(F.regexp_substr(names, F.lit("^.*?(?=<<|$)"))).alias("surname"),
        clean(F.regexp_replace(names, "^.*?(<<|$)", "")).alias("given_names"),
        F.regexp_replace(number, "<", "").alias("number"),
        digit_ok(number, at(bottom, 9, 10), 9).alias("number_ok"),
        F.regexp_replace(at(bottom, 10, 13), "<", "").alias("nationality"),
        yymmdd(at(bottom, 13, 19), as_of, True).alias("date_of_birth"),
        digit_ok(at(bottom, 13, 19), at(bottom, 19, 20), 6).alias("birth_ok"),
        F.when(at(bottom, 20, 21).isin("M", "F"), at(bottom, 20, 21)).alias("sex"),
        yymmdd(at(bottom, 21, 27), as_of, False).alias("expiry_date"),
        digit_ok(at(bottom, 21, 27), at(bottom, 27, 28), 6).alias("expiry_ok"),
        F.when(extra.startswith("M"), "multiple").when(extra.rlike("^[S1]"), "single").alias("entries"),
        F.when(days.isNotNull(), F.concat(days.cast("string"), F.lit(" days"))).alias("stay"),
    )


def _names(raw: Column) -> tuple[Column, Column]:
    clean = lambda c: F.trim(F.regexp_replace(c, "<+", " "))
    return clean(F.regexp_substr(raw, F.lit("^.*?(?=<<|$)"))), clean(F.regexp_replace(raw, "^.*?(<<|$)", ""))


def _card(issuer: Column, names: Column, number: Column, number_digit: Column, length: int, nationality: Column, birth: Column, birth_digit: Column, sex: Column, expiry: Column, expiry_digit: Column, as_of: Column) -> Column:
    surname, given = _names(letters(names))
    birth, expiry = digits(birth), digits(expiry)
    return F.struct(
        F.regexp_replace(letters(issuer), "<", "").alias("issuer"),
        surname.alias("surname"),
        given.alias("given_names"),
        F.regexp_replace(number, "<", "").alias("number"),
        digit_ok(number, number_digit, length).alias("number_ok"),
        F.regexp_replace(letters(nationality), "<", "").alias("nationality"),
        yymmdd(birth, as_of, True).alias("date_of_birth"),
        digit_ok(birth, birth_digit, 6).alias("birth_ok"),
        F.when(sex.isin("M", "F", "<"), sex).alias("sex"),
        yymmdd(expiry, as_of, False).alias("expiry_date"),
        digit_ok(expiry, expiry_digit, 6).alias("expiry_ok"),
    )


def parse_td2(top: Column, bottom: Column, as_of: Column) -> Column:
    """Fields of a two-line card zone of 36 characters; its number has eight characters."""
    return _card(at(top, 2, 5), at(top, 5, 36), at(bottom, 0, 8), at(bottom, 8, 9), 8, at(bottom, 10, 13), at(bottom, 13, 19), at(bottom, 19, 20), at(bottom, 20, 21), at(bottom, 21, 27), at(bottom, 27, 28), as_of)


def parse_td1(first: Column, second: Column, third: Column, as_of: Column) -> Column:
    """Fields of a three-line card zone of 30 characters."""
    return _card(at(first, 2, 5), third, at(first, 5, 14), at(first, 14, 15), 9, at(first, 10, 13), at(second, 0, 6), at(second, 6, 7), at(second, 7, 8), at(second, 8, 14), at(second, 14, 15), as_of)


def repair_classes(top: Column, bottom: Column) -> tuple[Column, Column]:
    """Both lines of a passport zone with letters forced into the issuer and digits into both dates and their check digits."""
    return F.concat(at(top, 0, 2), letters(at(top, 2, 5)), at(top, 5, 44)), F.concat(at(bottom, 0, 13), digits(at(bottom, 13, 20)), at(bottom, 20, 21), digits(at(bottom, 21, 28)), at(bottom, 28, 44))


# Lengths of a candidate line.
SHORTEST, LONGEST = 30, 48


def zone(lines: Column) -> Column:
    """STRUCT<format, first, second, third> of the zone among cleaned lines, or null.

    Candidates are the lines of 30 to 48 characters, and neighbours among them are tried in order, whatever stands before, between or after them: first all pairs as
    a passport (TD3, or TD3? if a line has not 44 characters) or a visa (MRV-B), then all pairs as a card (TD2), then all threes of 30 characters as a card (TD1).
    """

    def found(kept: Column) -> Column:
        none = F.lit(None).cast("string")
        line = lambda i: F.element_at(kept, i)
        as_zone = lambda kind, *of: F.struct(kind.alias("format"), *[x.alias(n) for x, n in zip((*of, none)[:3], ("first", "second", "third"), strict=True)])

        def pair(a: Column, b: Column) -> Column:
            both = lambda low, high: F.length(a).between(low, high) & F.length(b).between(low, high)
            passport = a.rlike(r"^P[<\[]") & both(40, LONGEST)
            return as_zone(F.when(passport, F.when(both(44, 44), "TD3").otherwise("TD3?")).when(a.rlike(r"^V[<\[]") & both(34, 44), "MRV-B"), a, b)

        def card(a: Column, b: Column) -> Column:
            return as_zone(F.when(a.rlike(r"^I[<\[]") & F.length(a).between(34, 38) & F.length(b).between(34, 38), "TD2"), a, b)

        def three(a: Column, b: Column, c: Column) -> Column:
            return as_zone(F.when(a.rlike(r"^I[<\[]") & (F.length(a) == 30) & (F.length(b) == 30) & (F.length(c) == 30), "TD1"), a, b, c)

        starts = lambda n: F.filter(F.sequence(F.lit(1), F.greatest(F.size(kept) - n + 1, F.lit(1))), lambda i: i + (n - 1) <= F.size(kept))
        of = lambda n, judge: F.transform(starts(n), lambda i: judge(*[line(i + k) for k in range(n)]))
        return F.try_element_at(F.filter(F.concat(of(2, pair), of(2, card), of(3, three)), lambda z: z["format"].isNotNull()), F.lit(1))

    return let(F.filter(lines, lambda x: F.length(x).between(SHORTEST, LONGEST)), found)


def zone_format(lines: Column) -> Column:
    """TD3, TD3?, MRV-B, TD2, TD1 or null: the format of the zone among the lines."""
    return zone(lines)["format"]


#: The fields that every format has, in order.
_SHARED = ("issuer", "surname", "given_names", "number", "number_ok", "nationality", "date_of_birth", "birth_ok", "sex", "expiry_date", "expiry_ok")


def read_zone(found: Column, as_of: Column) -> Column:
    """STRUCT of the format and the fields of a zone (see zone()), with misread characters repaired: names and codes are letters, dates digits, and the number is
    repaired by its check digit. composite_ok (of the lines before the number's repair) is null but for passports, entries and stay are null but for visas."""
    none = lambda to: F.lit(None).cast(to)

    def number(line: Column, start: int, end: int) -> Column:
        return F.rpad(repair(at(line, start, end), at(line, end, end + 1)), end - start, "<")

    def second(line: Column, size: int) -> Column:
        """A zone's line of number, nation and dates, repaired; its number has size characters."""
        return F.concat(number(line, 0, size), at(line, size, 10), letters(at(line, 10, 13)), digits(at(line, 13, 19)), at(line, 19, 21), digits(at(line, 21, 27)), at(line, 27, LONGEST))

    def fields(kind: Column, parsed: Column, composite: Column | None = None, visa: bool = False) -> Column:
        return let(parsed, lambda r: F.struct(
            kind.alias("format"), *[r[n].alias(n) for n in _SHARED], (none("boolean") if composite is None else composite).alias("composite_ok"),
            *[(r[n] if visa else none("string")).alias(n) for n in ("entries", "stay")]))

    # each repaired line is bound by a name before it is taken apart, as a parser reads it many times
    def passport(z: Column) -> Column:
        top, bottom = repair_classes(z["first"], z["second"])
        composite = lambda b: digit_ok(F.concat(at(b, 0, 10), at(b, 13, 20), at(b, 21, 43)), at(b, 43, 44), 39)
        lines = let(bottom, lambda b: F.struct(top.alias("t"), second(b, 9).alias("b"), composite(b).alias("c")))
        return let(lines, lambda x: fields(z["format"], parse_td3(F.concat(at(x["t"], 0, 5), letters(at(x["t"], 5, 44))), x["b"], as_of), x["c"]))

    def visa(z: Column) -> Column:
        lines = F.struct(F.concat(at(z["first"], 0, 2), letters(at(z["first"], 2, 36))).alias("t"), second(z["second"], 9).alias("b"))
        return let(lines, lambda x: fields(z["format"], parse_mrv_b(x["t"], x["b"], as_of), visa=True))

    def two(z: Column) -> Column:
        return let(second(z["second"], 8), lambda b: fields(z["format"], parse_td2(z["first"], b, as_of)))

    def three(z: Column) -> Column:
        a = z["first"]
        # the nation of such a card lies inside its number, as it was read
        card = lambda x: parse_td1(x, z["second"], z["third"], as_of).withField("nationality", F.regexp_replace(letters(at(a, 10, 13)), "<", ""))
        return let(F.concat(at(a, 0, 5), number(a, 5, 14), at(a, 14, LONGEST)), lambda x: fields(z["format"], card(x)))

    def read(z: Column) -> Column:
        kind = z["format"]
        return F.when(kind.startswith("TD3"), passport(z)).when(kind == "MRV-B", visa(z)).when(kind == "TD2", two(z)).when(kind == "TD1", three(z))

    return let(found, read)
