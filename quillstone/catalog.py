"""All registered queries."""

from __future__ import annotations

from quillstone.plans import extraction, files, lines, machine_learning, opportunities, page_data, postings, relational, reports, similarity, stored, streams, texts  # noqa: F401  they register
from quillstone.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
