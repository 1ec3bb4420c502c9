"""Registered queries: each one runs an operator over data derived from the supplied tables."""

from .registry import QUERIES, Query, query  # noqa: F401


def load_all() -> dict[str, "Query"]:
    from . import (  # noqa: F401
        tracks,
        gaps,
        stats,
        insights,
        athlete,
        risk,
        identity,
        geometry,
        text,
        sources,
        listings,
        evaluation,
        streams,
        uploads,
        custom,
    )

    return QUERIES
