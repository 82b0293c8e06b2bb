"""Small column expressions. All stay inside Spark's code generation."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, functions as F

from boxoffice.functions import fixed as fx


def ntz(moment: datetime | str) -> Column:
    """A zone-less timestamp literal."""
    text = moment if isinstance(moment, str) else moment.isoformat(sep=" ")
    return F.to_timestamp_ntz(F.lit(text))


def clock(as_of: datetime | str | Column) -> Column:
    """The job's clock: a literal moment, or a column that carries one per row."""
    return as_of if isinstance(as_of, Column) else ntz(as_of)


def money(c: Column | str) -> Column:
    """NULL where the amount is beyond the money type; the caller says what then becomes of the row."""
    return _col(c).try_cast(fx.MONEY)


def from_cents(c: Column | str) -> Column:
    """Whole cents as money; an absent number is 0. NULL beyond the money type."""
    return (F.coalesce(_col(c), F.lit(0)).cast("decimal(20,0)") / 100).try_cast(fx.MONEY)


def null_if_blank_text(c: Column | str) -> Column:
    """The empty string is stored as NULL; white space is kept."""
    return F.nullif(_col(c), F.lit(""))


def is_blank(c: Column | str) -> Column:
    return ~F.coalesce(_col(c).rlike(r"[^\p{IsWhite_Space}]"), F.lit(False))


def first_not_blank(*choices: Column | str) -> Column:
    """The first value that is not white space only, untrimmed; else the last one as it is."""
    *early, last = map(_col, choices)
    return F.coalesce(*[F.when(~is_blank(c), c) for c in early], last)


def full_name(first: Column | str, last: Column | str) -> Column:
    """CONCAT that reads NULL as the empty string."""
    return F.concat(
        F.coalesce(_col(first), F.lit("")), F.lit(" "), F.coalesce(_col(last), F.lit(""))
    )


def fill(template: str, **parts: Column | str) -> Column:
    """Put columns into the {named} places of a text; NULL reads as the empty string."""
    pieces: list[Column] = []
    rest = template
    while "{" in rest:
        before, tail = rest.split("{", 1)
        name, rest = tail.split("}", 1)
        if before:
            pieces.append(F.lit(before))
        value = parts[name]
        value = value if isinstance(value, Column) else F.lit(value)
        pieces.append(F.coalesce(value, F.lit("")))
    if rest:
        pieces.append(F.lit(rest))
    return F.concat(*pieces)


def text(template: str, *parts: Column) -> Column:
    """Like ``fill`` for texts with %s places."""
    marks = template.split("%s")
    pieces: list[Column] = []
    for mark, part in zip(marks, [*parts, None]):
        if mark:
            pieces.append(F.lit(mark))
        if part is not None:
            pieces.append(F.coalesce(part.cast("string"), F.lit("")))
    return F.concat(*pieces)


def second_text(moment: Column | str) -> Column:
    return F.date_format(_col(moment), "yyyy-MM-dd HH:mm:ss")


def mail_time(moment: Column | str) -> Column:
    return F.concat(second_text(moment), F.lit(fx.MAIL_ZONE_SUFFIX))


def parse_show_date(c: Column | str) -> Column:
    """'YYYY-MM-DD HH:MM' as a zone-less timestamp; NULL when the text is no such date."""
    return F.when(_col(c).rlike(fx.SHOW_DATE_PATTERN), _col(c).try_cast("timestamp_ntz"))


def derived_id(*parts: Column | str) -> Column:
    """An id that depends on the input only, so that a re-run writes the same rows."""
    return F.sha2(F.concat_ws("-", *[_col(p).cast("string") for p in parts]), 256)


def parse_id(c: Column, key_type: str) -> Column:
    """An id that came in as text; NULL when it is no id of that type."""
    if key_type != "string":
        return c.try_cast(key_type)
    bare = F.regexp_replace(F.lower(c), r"urn:uuid:|[{}-]", "")
    dashed = F.regexp_replace(
        bare, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", r"$1-$2-$3-$4-$5"
    )
    return F.when(c.rlike(fx.UUID_PATTERN), dashed)


def is_email_valid(c: Column | str) -> Column:
    return F.coalesce(_col(c).rlike(fx.EMAIL_PATTERN), F.lit(False))


def is_password_valid(c: Column | str) -> Column:
    p = _col(c)
    fine = (
        F.octet_length(p).between(fx.PASSWORD_MIN_BYTES, fx.PASSWORD_MAX_BYTES)
        & p.rlike(r"\p{Lu}")
        & p.rlike(r"\p{Ll}")
        & p.rlike(r"\p{Nd}")
        & ~p.rlike(r"\p{IsWhite_Space}")
    )
    return F.coalesce(fine, F.lit(False))


def _col(c: Column | str) -> Column:
    return c if isinstance(c, Column) else F.col(c)
