"""Column rules shared by every operator: keys, labels, values, accessions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ACCESSION_DIGITS = r"^\d{18}$"
ACCESSION_DASHED = r"^\d{10}-\d{2}-\d{6}$"


def company_number(cik: Column | str) -> Column:
    """The number a cik holds; padding and outer blanks do not count. Null when it holds none."""
    c = F.col(cik) if isinstance(cik, str) else cik
    return F.trim(c).try_cast("bigint")


def padded_cik(cik: Column | str) -> Column:
    return F.lpad(company_number(cik).cast("string"), 10, "0")


def label(c: Column | str) -> Column:
    """Compared form of concept, fiscal_period, form, kind and status."""
    return F.lower(F.trim(F.col(c) if isinstance(c, str) else c))


def usable(v: Column | str) -> Column:
    """Not null and finite."""
    v = F.col(v) if isinstance(v, str) else v
    return F.coalesce(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), F.lit(False))


def dashed_accession(a: Column | str) -> Column:
    """##########-##-###### from either form; null when blank; other strings pass through trimmed."""
    a = F.trim(F.col(a) if isinstance(a, str) else a)
    return (
        F.when(a == "", None)
        .when(a.rlike(ACCESSION_DIGITS), F.concat_ws("-", F.substring(a, 1, 10), F.substring(a, 11, 2), F.substring(a, 13, 6)))
        .otherwise(a)
    )


def bare_tag(tag: Column | str) -> Column:
    """A tag without its namespace (what precedes the last colon)."""
    return F.substring_index(F.col(tag) if isinstance(tag, str) else tag, ":", -1)


def duration_class(period: Column | str) -> Column:
    """'FY' or 'Q' (any quarter); null for anything else."""
    p = label(period)
    return F.when(p == "fy", "FY").when(p.rlike("^q[1-4]$"), "Q")


def year_quarter_index(year: Column, period: Column) -> Column:
    """Quarter ordinal year*4 + q - 1, null outside Q1..Q4; consecutive quarters differ by one."""
    p = label(period)
    return F.when(p.rlike("^q[1-4]$"), year * 4 + F.substring(p, 2, 1).try_cast("int") - 1)


# What counts as whitespace beside the plain kinds; listed, as the regex engine's Unicode classes are slow.
WHITESPACE = r"[\s\x1c-\x1f\u0085\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"


def collapse_space(text: Column | str) -> Column:
    """Each whitespace run (no-break space included) as one blank, outer ones removed."""
    t = F.col(text) if isinstance(text, str) else text
    return F.trim(F.regexp_replace(t, WHITESPACE, " "))


def json_list(text: Column | str, element: str) -> Column:
    """A list out of JSON text, of elements of the given type; a bare value in its place is a list of one. A field is read
    as its text where a schema says string."""
    t = F.col(text) if isinstance(text, str) else text
    bare = t if element == "string" else F.from_json(t, element)
    return F.when(t.startswith("["), F.from_json(t, f"array<{element}>")).when(t.isNotNull(), F.array(bare))
