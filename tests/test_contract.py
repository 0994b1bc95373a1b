"""The driver contract: registered queries, oracles, names."""

import re

import __spark_entry__ as E


def rental(registered):
    """The rental queries; the training-data subpackage has rules and tests of its own."""
    return {n: v for n, v in registered.items() if not re.match(r"op\d+_|pipeline$", n)}


def test_every_query_has_an_oracle():
    qs, sql = rental(E.queries()), rental(E.oracle_sql())
    assert set(sql) == set(qs)


def test_registered_names_follow_survey_ids():
    for name in rental(E.queries()):
        assert re.match(r"^(S[1-5]|M[1-6]|R(1[0-2]|[1-9])|N[1-9]|Q[1-4])_[a-z_]+$", name), name
        assert not name.lower().startswith("op")


def test_oracle_sql_reads_only_driver_views():
    """Oracles read the driver's views and their own CTEs, nothing else."""
    driver = {"region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"}
    for name, sql in rental(E.oracle_sql()).items():
        ctes = set(re.findall(r"(\w+)\s+as\s*\(", sql, flags=re.I))
        read = re.findall(r"\b(?:from|join)\s+(\w+)", sql, flags=re.I)
        unknown = {t for t in read if t not in driver | ctes and t.lower() not in ("values", "unnest")}
        assert not unknown, (name, unknown)
