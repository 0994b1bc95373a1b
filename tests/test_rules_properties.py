"""Property tests of the shared rules against plain-Python statements of the same rules."""

import datetime as dt
import math

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from rentwise.functions.rules import doc_rental_days, euro_text, num_or_zero, rental_days

DATES = st.dates(min_value=dt.date(1990, 1, 1), max_value=dt.date(2040, 12, 31))


def _days(start, end):
    return max((end - start).days, 1)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(DATES, DATES), min_size=1, max_size=200))
def test_rental_days_matches_rule(spark, pairs):
    df = spark.createDataFrame(pairs, "s date, e date")
    got = [r[0] for r in df.select(rental_days("s", "e")).collect()]
    assert got == [_days(s, e) for s, e in pairs]
    text = df.select(doc_rental_days(F.col("s").cast("string"), F.col("e").cast("string"))).collect()
    assert [r[0] for r in text] == got


def _num_or_zero(text):
    try:
        v = float(text)
    except (TypeError, ValueError):
        return 0.0
    return v if math.isfinite(v) else 0.0


MONEY_TEXT = st.one_of(
    st.none(),
    st.decimals(min_value=-10**6, max_value=10**6, places=2, allow_nan=False).map(str),
    st.sampled_from(["x", "", "NaN", "Infinity", "-Infinity", "1e3", "12.5.1"]),
)


@settings(max_examples=5, deadline=None)
@given(st.lists(MONEY_TEXT, min_size=1, max_size=200))
def test_num_or_zero_matches_rule(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(num_or_zero("v")).collect()]
    assert got == [_num_or_zero(v) for v in values]


def _euro(x):
    body = f"{abs(x):,.2f}".translate(str.maketrans(",.", ".,"))
    return ("-" if x < 0 else "") + "€\u00a0" + body


@settings(max_examples=5, deadline=None)
@given(st.lists(st.decimals(min_value=-10**7, max_value=10**7, places=2, allow_nan=False), min_size=1, max_size=200))
def test_euro_text_matches_rule(spark, values):
    df = spark.createDataFrame([(str(v),) for v in values], "v string")
    got = [r[0] for r in df.select(euro_text(F.col("v").cast("decimal(12,2)"))).collect()]
    assert got == [_euro(float(v)) for v in values]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(
    ["1998-03-01", "1998", "199", "", "1999-1-5", "abc", "2001-01-01T10", "0", "20010"]))), min_size=1, max_size=20),
    st.sampled_from(["1998-03-01", "1999", "", "b", "2"]), st.sampled_from(["1998-12-31", "2001-01-01", "c", "1"]))
def test_document_partitions_prune_no_row(spark, dates, lower, upper):
    """The partition condition keeps every document that the text condition keeps."""
    from rentwise.functions.rules import START_KEY, doc_start_window, start_key, where_all
    docs = spark.createDataFrame(dates, "start_date string")
    stored = docs.withColumn(START_KEY, start_key("start_date"))
    for inclusive in (True, False):
        window = lambda df: where_all(df, doc_start_window(df, lower, upper, inclusive)).select("start_date")
        assert sorted(window(stored).collect()) == sorted(window(docs).collect())
