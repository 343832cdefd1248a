"""The driver's contract: every query has a stable schema, and reference SQL exists for most."""

import __spark_entry__ as e
from lexgrove.plans import bindings


def test_names():
    assert set(e.oracle_sql()) <= set(e.queries())
    assert len(bindings.QUERIES) >= 40 and len(bindings.ORACLES) >= 38


def test_entry(spark):
    assert e.entry(spark).columns == ["term", "n_books", "books"]
