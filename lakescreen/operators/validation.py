"""Validation rules as columns: each gives ARRAY<STRUCT<field, status, message, rule>>, and a ruleset is a list of them.

A document reaches the rules as a ``Doc``: its trimmed values, readable dates, check-digit verdicts and zone values are columns that
``validate`` computes once, in a projection before the rules, so that a rule only compares.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alphanumeric
from .dataflow import isolated

CHECK = "array<struct<field:string,status:string,message:string,rule:string>>"


class Doc:
    """Columns of one document; prefix names the projection that holds them."""

    def __init__(self, prefix: str, as_of: Column):
        self.prefix, self.as_of = prefix, as_of

    def value(self, name: str) -> Column:
        return F.col(f"{self.prefix}v_{name}")

    def date(self, name: str) -> Column:
        return F.col(f"{self.prefix}d_{name}")

    def digit(self, name: str) -> Column:
        return F.col(f"{self.prefix}ok_{name}")

    def zone(self, name: str) -> Column:
        return F.col(f"{self.prefix}z_{name}")

    @property
    def has_zone(self) -> Column:
        return F.col(f"{self.prefix}has_zone")

    @property
    def raw(self) -> Column:
        return F.col(f"{self.prefix}raw")

    @property
    def composite(self) -> Column:
        return F.col(f"{self.prefix}composite")

    @property
    def doc_type(self) -> Column:
        return F.col(f"{self.prefix}type")


@dataclass
class Rule:
    """A rule's identity, the names it reads, and the checks it makes of a document."""

    rule_id: str
    run: Callable[[Doc], Column]
    names: tuple[str, ...] = ()
    zone: tuple[str, ...] = ()


def check(name: Column | str, status: Column | str, message: Column | str, rule: str) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return F.struct(lit(name).alias("field"), lit(status).alias("status"), lit(message).alias("message"), F.lit(rule).alias("rule"))


def required(*names: str) -> Rule:
    rule_id = f"required_fields[{','.join(names)}]"
    one = lambda d, n: check(n, F.when(d.value(n).isNotNull(), "PASS").otherwise("FAIL"), F.when(d.value(n).isNotNull(), "present").otherwise("missing"), rule_id)
    return Rule(rule_id, lambda d: F.array(*[one(d, n) for n in names]), names)


def dates(*names: str) -> Rule:
    rule_id = f"date_format[{','.join(names)}]"

    def one(d: Doc, n: str) -> Column:
        v, day = d.value(n), d.date(n)
        return check(n, F.when(v.isNull(), "WARNING").when(day.isNotNull(), "PASS").otherwise("FAIL"), F.when(v.isNull(), "absent").when(day.isNotNull(), "readable").otherwise("unreadable"), rule_id)

    return Rule(rule_id, lambda d: F.array(*[one(d, n) for n in names]), names)


def not_expired(name: str) -> Rule:
    rule_id = f"expiry_validity[{name}]"

    def run(d: Doc) -> Column:
        day = d.date(name)
        return F.array(check(name, F.when(day >= d.as_of, "PASS").otherwise("WARNING"), F.when(day.isNull(), "unreadable").when(day >= d.as_of, "valid").otherwise("expired"), rule_id))

    return Rule(rule_id, run, (name,))


def born_in_past(name: str = "date_of_birth") -> Rule:
    def run(d: Doc) -> Column:
        day = d.date(name)
        old = F.date_diff(d.as_of, day) > 36500
        status = F.when(day.isNull(), "WARNING").when(day > d.as_of, "FAIL").when(old, "WARNING").otherwise("PASS")
        return F.array(check(name, status, F.when(day.isNull(), "unreadable").when(day > d.as_of, "in the future").when(old, "very old").otherwise("plausible"), "dob_sanity"))

    return Rule(f"dob_in_past[{name}]", run, (name,))


def pattern(name: str, regex: str, severity: str = "FAIL") -> Rule:
    rule_id = f"format[{name}]"

    def run(d: Doc) -> Column:
        v = d.value(name)
        fits = v.rlike(f"^(?:{regex})$")
        return F.array(check(name, F.when(v.isNull(), "WARNING").when(fits, "PASS").otherwise(severity), F.when(v.isNull(), "absent").when(fits, "fits").otherwise("does not fit"), rule_id))

    return Rule(rule_id, run, (name,))


def digit(name: str) -> Rule:
    """Three-valued: true passes, false fails, null warns; so does an absent value."""
    rule_id = f"mrz_check_digit[{name}]"

    def run(d: Doc) -> Column:
        v, ok = d.value(name), d.digit(name)
        return F.array(check(name, F.when(v.isNull(), "WARNING").when(ok, "PASS").when(~ok, "FAIL").otherwise("WARNING"), F.when(v.isNull(), "absent").when(ok, "digit fits").when(~ok, "digit does not fit").otherwise("no digit"), rule_id))

    return Rule(rule_id, run, (name,))


def consistent(*pairs: tuple[str, str]) -> Rule:
    """Fields against the zone's values, compared by letters and digits; a pair that the zone lacks is left out, a missing zone warns once."""

    def run(d: Doc) -> Column:
        def one(name: str, other: str) -> Column:
            v, m = d.value(name), d.zone(other)
            same = alphanumeric(v) == alphanumeric(m)
            status = F.when(v.isNull(), "WARNING").when(same, "PASS").otherwise("FAIL")
            return F.when(m.isNotNull(), check(name, status, F.when(v.isNull(), "absent").when(same, "agrees").otherwise("differs"), "mrz_consistency"))

        return F.when(d.has_zone, F.array_compact(F.array(*[one(*p) for p in pairs]))).otherwise(F.array(check("mrz", "WARNING", "no zone to compare with", "mrz_consistency")))

    return Rule("mrz_consistency", run, tuple(p[0] for p in pairs), tuple(p[1] for p in pairs))


def composite() -> Rule:
    """The zone's own digit over the whole line: true, false, or null where there is no zone or none of its kind."""

    def run(d: Doc) -> Column:
        ok = d.composite
        return F.array(check("mrz", F.when(d.raw.isNull(), "WARNING").when(ok, "PASS").when(~ok, "FAIL").otherwise("WARNING"), F.when(d.raw.isNull(), "no zone").when(ok, "digit fits").when(~ok, "digit does not fit").otherwise("no digit"), "mrz_composite"))

    return Rule("mrz_composite", run)


#: First letters of a zone's document code.
DOC_CODES = {"P": "passport", "V": "visa"}


def doc_code() -> Rule:
    def run(d: Doc) -> Column:
        first = F.upper(F.left(F.trim(d.zone("document_code")), F.lit(1)))
        means = F.when(first == "P", DOC_CODES["P"]).when(first == "V", DOC_CODES["V"])
        unread = F.coalesce(d.zone("document_code"), F.lit("")) == ""
        status = F.when(unread | means.isNull(), "WARNING").when(means == d.doc_type, "PASS").otherwise("FAIL")
        return F.array(check("mrz", status, F.when(unread, "no code").when(means.isNull(), "unknown class").when(means == d.doc_type, "agrees").otherwise("another type"), "mrz_doc_code"))

    return Rule("mrz_doc_code", run, (), ("document_code",))


def presence(expected: bool = True) -> Rule:
    def run(d: Doc) -> Column:
        if not expected:
            return F.array(check("mrz", "PASS", F.when(d.raw.isNull(), "none, as expected").otherwise("present"), "mrz_presence"))
        return F.array(check("mrz", F.when(d.raw.isNull(), "WARNING").otherwise("PASS"), F.when(d.raw.isNull(), "expected, not found").otherwise("present"), "mrz_presence"))

    return Rule(f"mrz_presence[{expected}]", run)


#: How a visa may say how often it lets its holder in.
ENTRY_VALUES = ("MULT", "MULTIPLE", "SINGLE", "M", "S")


def entries(name: str = "entry_validity") -> Rule:
    def run(d: Doc) -> Column:
        v = d.value(name)
        fits = alphanumeric(v).isin(*ENTRY_VALUES)
        return F.array(check(name, F.when(v.isNull(), "WARNING").when(fits, "PASS").otherwise("FAIL"), F.when(v.isNull(), "absent").when(fits, "known").otherwise("unknown"), "visa_entry_validity"))

    return Rule("visa_entry_validity", run, (name,))


def stay(name: str = "stay_duration") -> Rule:
    def run(d: Doc) -> Column:
        v = F.upper(d.value(name))
        number = F.regexp_extract(v, r"^\s*(\d+)\s*(DAYS?|MONTHS?)\s*$", 1).try_cast("int")
        days = number * F.when(F.contains(v, F.lit("MONTH")), 30).otherwise(1)
        status = F.when(v.isNull(), "WARNING").when(days.isNull() | (days <= 0), "FAIL").when(days > 365, "WARNING").otherwise("PASS")
        return F.array(check(name, status, F.when(v.isNull(), "absent").when(days.isNull() | (days <= 0), "unreadable").when(days > 365, "long").otherwise("plausible"), "visa_stay_duration"))

    return Rule("visa_stay_duration", run, (name,))


def python_rule(rule_id: str, name: str, function: Callable[[pd.Series], pd.Series]) -> Rule:
    """A rule of one's own in Python: function gets the values of a field in batches and gives PASS, WARNING or FAIL for each, or null for no check.

    It runs by itself: where it raises, only the rows at fault have a warning of the engine with the kind of the error, and all other rows and rules stand.
    """
    judge = isolated(function, "string")

    def run(doc: Doc) -> Column:
        def told(r: Column) -> Column:
            broken = F.concat(F.lit(f"rule {rule_id} failed: "), F.substring_index(r["error"], ":", 1))
            return F.when(r["error"].isNotNull(), check("engine", "WARNING", broken, rule_id)).when(r["value"].isNotNull(), check(name, r["value"], r["value"], rule_id))

        return F.array_compact(F.transform(F.array(judge(doc.value(name))), told))

    return Rule(rule_id, run, (name,))


@dataclass
class Ruleset:
    """Rules of one document type; country None is for any."""

    doc_type: str
    rules: list[Rule] = field(default_factory=list)
    country: str | None = None


_RULESETS: dict[tuple[str, str], Ruleset] = {}


def register_ruleset(ruleset: Ruleset) -> None:
    """Add a ruleset, or replace the one of its country and type."""
    _RULESETS[((ruleset.country or "*").upper(), ruleset.doc_type.lower())] = ruleset


def ruleset_for(doc_type: str | None, country: str | None = None) -> Ruleset | None:
    """The most specific: country and type, then type, then that of unknown types."""
    kind = (doc_type or "unknown").lower()
    tried = [((country or "*").upper(), kind), ("*", kind), ("*", "unknown")]
    return next((_RULESETS[k] for k in tried if k in _RULESETS), None)


# Which rules each bundled ruleset has, in order, and their patterns.
_NUMBER = "[A-Z]{1,2}[A-Z0-9]{6,9}"
_PASSPORT = ("full_name", "passport_number", "date_of_birth", "expiry_date", "nationality")
_VISA = ("visa_number", "full_name", "date_of_birth", "expiry_date", "entry_validity")
for _ruleset in (
    Ruleset(
        "passport",
        [
            presence(True),
            doc_code(),
            required(*_PASSPORT),
            pattern("passport_number", _NUMBER),
            pattern("nationality", "[A-Z]{3}"),
            dates("date_of_birth", "expiry_date"),
            born_in_past("date_of_birth"),
            not_expired("expiry_date"),
            digit("passport_number"),
            digit("date_of_birth"),
            digit("expiry_date"),
            composite(),
            consistent(("passport_number", "passport_number"), ("nationality", "nationality"), ("date_of_birth", "date_of_birth"), ("expiry_date", "expiry_date")),
        ],
    ),
    Ruleset(
        "visa",
        [
            presence(True),
            doc_code(),
            required(*_VISA),
            pattern("visa_number", _NUMBER),
            pattern("visa_type", r"[A-Z0-9][A-Z0-9 /\\-]{1,23}", "WARNING"),
            entries("entry_validity"),
            stay("stay_duration"),
            dates("date_of_birth", "expiry_date"),
            born_in_past("date_of_birth"),
            not_expired("expiry_date"),
            digit("visa_number"),
            digit("date_of_birth"),
            digit("expiry_date"),
            composite(),
            consistent(("visa_number", "visa_number"), ("date_of_birth", "date_of_birth"), ("expiry_date", "expiry_date"), ("entry_validity", "entry_validity")),
        ],
    ),
    Ruleset("unknown", [dates("date_of_birth", "expiry_date", "date_of_issue"), born_in_past("date_of_birth"), not_expired("expiry_date"), digit("document_number"), presence(False)]),
):
    register_ruleset(_ruleset)


def _trimmed(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def prepared(df: DataFrame, rules: Iterable[Rule], fields: Column, zone: Column, raw: Column, composite_ok: Column, doc_type: Column, prefix: str = "_") -> DataFrame:
    """df with the columns that a Doc of this prefix reads.

    fields: MAP<name, STRUCT<value, check_digit_ok>>; zone: MAP<name, value>, null or empty without a zone; raw: the zone's text.
    """
    rules = list(rules)
    names = sorted({n for r in rules for n in r.names})
    of_zone = sorted({n for r in rules for n in r.zone})
    got = df.select("*", *[F.try_element_at(fields, F.lit(n)).alias(f"{prefix}f_{n}") for n in names], zone.alias(f"{prefix}zone"))
    values = [_trimmed(F.col(f"{prefix}f_{n}")["value"]).alias(f"{prefix}v_{n}") for n in names]
    digits = [F.col(f"{prefix}f_{n}")["check_digit_ok"].alias(f"{prefix}ok_{n}") for n in names]
    held = F.col(f"{prefix}zone")
    more = [_trimmed(F.try_element_at(held, F.lit(n))).alias(f"{prefix}z_{n}") for n in of_zone]
    state = [F.coalesce(F.size(held) > 0, F.lit(False)).alias(f"{prefix}has_zone"), _trimmed(raw).alias(f"{prefix}raw"), composite_ok.alias(f"{prefix}composite"), F.lower(doc_type).alias(f"{prefix}type")]
    one = got.select(*df.columns, *values, *digits, *more, *state)
    return one.select("*", *[F.try_to_date(F.left(F.col(f"{prefix}v_{n}"), F.lit(10)), "yyyy-MM-dd").alias(f"{prefix}d_{n}") for n in names])


def run(rules: list[Rule], doc: Doc) -> Column:
    """All checks of a ruleset, in order. Without rules, one that fails; a rule that cannot be built becomes a warning."""
    if not rules:
        return F.array(check("ruleset", "FAIL", "no ruleset", "engine"))
    made = []
    for rule in rules:
        try:
            made.append(rule.run(doc))
        except Exception as error:  # noqa: BLE001 - a broken rule must not end the others
            made.append(F.array(check("engine", "WARNING", f"rule {rule.rule_id} failed: {type(error).__name__}", rule.rule_id)))
    return F.flatten(F.array(*made))


def validate(df: DataFrame, ruleset: Ruleset | None, fields: Column, zone: Column, raw: Column, composite_ok: Column, doc_type: Column, as_of: Column, name: str = "checks") -> DataFrame:
    """df with its checks under the ruleset."""
    rules = ruleset.rules if ruleset else []
    ready = prepared(df, rules, fields, zone, raw, composite_ok, doc_type)
    # an array of one, taken apart: the checks are made once, whatever is read of them later
    made = ready.select(*df.columns, F.inline(F.array(F.struct(run(rules, Doc("_", as_of)).alias(name)))))
    return made


def is_valid(checks: Column) -> Column:
    return ~F.exists(checks, lambda c: c["status"] == "FAIL")


def summary(checks: Column) -> Column:
    """is_valid, failures and warnings (fields), and whether a person has to look: any failure, warning or invalid result."""
    of = lambda s: F.transform(F.filter(checks, lambda c: c["status"] == s), lambda c: c["field"])
    review = F.exists(checks, lambda c: c["status"] != "PASS")
    return F.struct(is_valid(checks).alias("is_valid"), of("FAIL").alias("failures"), of("WARNING").alias("warnings"), review.alias("human_review_required"))


# What a check names that is no field.
NO_FIELD = ("mrz", "rule", "ruleset")


def examined_confidence(checks: Column, confidences: Column) -> Column:
    """The mean reading confidence of the fields that the checks examined, each once however many checks did; a field that was not read counts as 0, and without
    any the mean is 0. confidences is a MAP of field to confidence, or null."""
    names = F.array_distinct(F.filter(F.transform(checks, lambda c: c["field"]), lambda f: F.coalesce((f != "") & ~f.isin(*NO_FIELD), F.lit(False))))
    total = F.aggregate(names, F.lit(0.0), lambda a, f: a + F.coalesce(F.try_element_at(confidences, f).cast("double"), F.lit(0.0)))
    return F.when(F.size(names) > 0, total / F.size(names)).otherwise(0.0)
