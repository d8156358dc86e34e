"""All catalog queries by name, with their DuckDB SQL."""

from __future__ import annotations


def _books() -> list:
    from eventlode.plans import classify, extract, ingest, maintenance, pulse, search, stats, streams, values, writes

    return [search.BOOK, stats.BOOK, maintenance.BOOK, extract.BOOK, classify.BOOK, writes.BOOK, values.BOOK, ingest.BOOK, streams.BOOK, pulse.BOOK]


def queries() -> dict:
    from eventlode.plans import coverage

    found = dict(coverage.QUERIES)
    for b in _books():
        found |= b.queries
    return found


def oracle_sql() -> dict:
    from eventlode.plans import coverage

    found = dict(coverage.ORACLE)
    for b in _books():
        found |= b.oracle
    return found
