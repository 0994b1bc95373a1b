"""Business rules shared by many operators, as JVM-side column expressions.

Nothing here leaves whole-stage codegen: every rule is a composition of
built-in ``pyspark.sql.functions``.
"""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ISO_DATE = "yyyy-MM-dd"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rental_days(start, end) -> Column:
    """Days billed for a booking: whole days between the dates, at least one.

    Same-day and reversed bookings cost one day. ``greatest`` skips NULL, so a
    missing date also gives one day.
    """
    return F.greatest(F.datediff(_c(end), _c(start)), F.lit(1))


def parse_iso_date(text) -> Column:
    """``yyyy-MM-dd`` text to a date; unparsable text gives NULL instead of an error."""
    return F.try_to_date(_c(text), ISO_DATE)


def parse_loose_date(text) -> Column:
    """Three numbers between ``-`` to a date: unpadded parts, text after a number and days past a
    month's end are fine (they roll over); a missing or zero part, or another form, gives NULL."""
    parts = F.split(_c(text), "-")
    year, month, day = (F.regexp_extract(F.get(parts, F.lit(i)), r"^\s*([+-]?\d{1,5})", 1).try_cast("int")
                        for i in range(3))
    usable = (F.size(parts) == 3) & year.between(1, 9999) & month.between(1, 99999) & day.between(1, 99999)
    first = F.make_date(F.when(usable, year), F.lit(1), F.lit(1))
    return F.date_add(F.add_months(first, F.when(usable, month) - 1), F.when(usable, day) - 1)


def doc_rental_days(start_text, end_text, strict: bool = False) -> Column:
    """Rental days for documents, whose dates are text; bad or missing text gives 1.

    The booking cost report reads ``yyyy-MM-dd`` only (``strict``), all others loosely.
    """
    parse = parse_iso_date if strict else parse_loose_date
    return rental_days(parse(start_text), parse(end_text))


NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def num_or_zero(x) -> Column:
    """Untyped money to double: NULL, unparsable, NaN and infinite values count 0."""
    text = _c(x).cast("string")
    # Spark also reads type suffixes such as 12d; those are not numbers here.
    value = F.when(text.rlike(NUMBER), text).try_cast("double")
    finite = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
    return F.when(finite, value).otherwise(F.lit(0.0))


def truthy_text(x) -> Column:
    """A marker value counts as present when it is neither NULL nor empty text."""
    c = _c(x)
    return c.isNotNull() & (c.cast("string") != F.lit(""))


def money(x) -> Column:
    """Money leaves the library as double; it is computed in decimal before."""
    return _c(x).cast("double")


# The text orders of the sources, as Spark collations. The relational one ignores case
# and accents; the document one is that of a locale-aware comparison, where they break ties.
TABLE_ORDER, DOCUMENT_ORDER = "UNICODE_CI_AI", "UNICODE"


def text_order(x, collation: str | None = None) -> Column:
    """The text as a sort key: bytewise, or by a collation."""
    return _c(x) if collation is None else F.collate(_c(x), collation)


def sorted_texts(texts, collation: str | None = None) -> Column:
    """An array of texts in the order of the collation (bytewise without one); equal ones in bytewise order."""
    if collation is None:
        return F.array_sort(texts)
    keyed = F.array_sort(F.transform(texts, lambda x: F.struct(F.collate(x, collation).alias("k"), x.alias("x"))))
    return F.transform(keyed, lambda s: s.getField("x"))


def all_of(conditions) -> Column | None:
    """AND of optional conditions; None when there is no condition."""
    conditions = [c for c in conditions if c is not None]
    return reduce(lambda a, b: a & b, conditions) if conditions else None


def where_all(df, conditions):
    cond = all_of(conditions)
    return df if cond is None else df.filter(cond)


def given(value) -> bool:
    """A filter argument is applied only when truthy (empty text means no filter)."""
    return value is not None and value != ""


# Stored bookings are partitioned by the year of their start date.
START_YEAR = "start_year"
# Stored booking documents by the first four characters of its text, where they are digits.
START_KEY, NO_YEAR = "start_key", "other"


def today() -> str:
    """The current date (UTC) as ISO text: the default of the "active from" date."""
    return datetime.now(timezone.utc).date().isoformat()


def start_key(start_text) -> Column:
    """Partition of a booking document."""
    text = _c(start_text)
    return F.when(text.rlike("^[0-9]{4}"), F.substring(text, 1, 4)).otherwise(F.lit(NO_YEAR))


def doc_start_window(df, lower: str | None = None, upper: str | None = None, upper_inclusive: bool = True):
    """Conditions on the text ``start_date`` of booking documents, each bound optional.

    Text order implies the order of first characters, so stored documents skip
    partitions; those whose date starts with no year are always read.
    """
    start = F.col("start_date")
    partition = F.col(START_KEY) if START_KEY in df.columns else None
    conds = []
    if given(lower):
        conds.append(start >= F.lit(lower))
        if partition is not None:
            conds.append((partition >= lower[:4]) | (partition == NO_YEAR))
    if given(upper):
        conds.append(start <= F.lit(upper) if upper_inclusive else start < F.lit(upper))
        if partition is not None:
            conds.append((partition <= upper[:4]) | (partition == NO_YEAR))
    return conds


def start_date_window(df, lower: str | None = None, upper: str | None = None, upper_inclusive: bool = True):
    """Conditions for ``lower <= start_date <= upper`` (or ``< upper``), each bound optional.

    When the bookings carry the ``start_year`` partition column, the matching
    year bounds are added too, so the scan skips whole partitions.
    """
    start = F.col("start_date")
    conds = []
    if given(lower):
        lo = F.lit(lower).cast("date")
        conds.append(start >= lo)
        if START_YEAR in df.columns:
            conds.append(F.col(START_YEAR) >= F.year(lo))
    if given(upper):
        hi = F.lit(upper).cast("date")
        conds.append(start <= hi if upper_inclusive else start < hi)
        if START_YEAR in df.columns:
            conds.append(F.col(START_YEAR) <= F.year(hi))
    return conds


def in_partitions(column: str, parts: list[str]) -> list[Column]:
    """Conditions that keep the listed partitions (as text): the list, and for years their range."""
    if not parts:
        return [F.lit(False)]
    text = F.col(column).cast("string")
    conds = [text.isin(*parts)]
    if all(p.isdigit() and len(p) == 4 for p in parts):
        conds += [text >= min(parts), text <= max(parts)]
    return conds


def number_text(x) -> Column:
    """A double as its shortest decimal text: ``4`` (not ``4.0``), ``10000000``, ``0.1``.

    An exponent is written from 1e21 upwards and below 1e-6 (``1e+21``, ``1.5e-7``); zero has no sign.
    """
    text = F.abs(_c(x).cast("double")).cast("string")  # digits with one point, and E with an exponent
    mantissa, power = F.regexp_extract(text, r"^([0-9.]+)", 1), F.regexp_extract(text, r"E(-?[0-9]+)$", 1)
    whole, part = F.split_part(mantissa, F.lit("."), F.lit(1)), F.split_part(mantissa, F.lit("."), F.lit(2))
    joined = F.concat(whole, part)
    digits = F.regexp_replace(F.regexp_replace(joined, "0+$", ""), "^0+", "")
    lead = F.length(joined) - F.length(F.regexp_replace(joined, "^0+", ""))
    size = F.length(digits)
    # the value is 0.digits times ten to the power of point
    point = F.length(whole) - lead + F.when(power != "", power).otherwise("0").cast("int")
    zeros = lambda n: F.repeat(F.lit("0"), n)
    plain = (F.when(size <= point, F.concat(digits, zeros(point - size)))
             .when(point > 0, F.concat(F.substr(digits, F.lit(1), point), F.lit("."), F.substr(digits, point + 1)))
             .otherwise(F.concat(F.lit("0."), zeros(-point), digits)))
    fraction = F.when(size > 1, F.concat(F.lit("."), F.substr(digits, F.lit(2)))).otherwise("")
    short = F.concat(F.substr(digits, F.lit(1), F.lit(1)), fraction, F.lit("e"),
                     F.when(point > 0, "+").otherwise("-"), F.abs(point - 1).cast("string"))
    body = F.when(digits == "", "0").when((point > 21) | (point <= -6), short).otherwise(plain)
    finite = text.rlike("^[0-9]")
    return F.when(~finite, _c(x).cast("string")).otherwise(F.concat(F.when(_c(x) < 0, "-").otherwise(""), body))


# Display format of money (Austrian German, euro).
EURO_SIGN = "€"
EURO_SPACE = "\u00a0"  # no-break space


def euro_text(x) -> Column:
    """Money as display text of the form ``€ 1.234,50`` (two decimals, '.' groups)."""
    value = F.coalesce(num_or_zero(x), F.lit(0.0))
    digits = F.translate(F.format_number(F.abs(value), 2), ",.", ".,")
    text = F.concat(F.lit(EURO_SIGN + EURO_SPACE), digits)
    return F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text)
