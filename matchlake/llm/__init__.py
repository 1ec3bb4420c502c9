"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

``queries()`` and ``oracle_sql()`` list what ``__spark_entry__`` registers.
"""

from __future__ import annotations


def _load() -> None:
    from . import registered as _registered  # noqa: F401


def queries() -> dict:
    from .registry import QUERIES

    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    from .registry import ORACLES

    _load()
    return dict(ORACLES)
