"""The registered queries."""

from docketeer.plans import documents, drafts, flows, indexes, ordered, pages, relational, retrieval, stores, streams, texts  # noqa: F401
from docketeer.plans.registry import QUERIES

__all__ = ["QUERIES"]
