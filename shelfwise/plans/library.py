"""All queries of the library but those of the training-data folder: importing a module registers its queries."""

from __future__ import annotations

from ..functions import labels, markdown, scalars, sql, text  # noqa: F401
from ..operators import catalog, classifier, company, extract, front_reader, history, label_reader, layout, list_queries, match, online, photos, products, profiles, projections, reconcile, resolve, reviews, submission  # noqa: F401
from ..sources import pages, written  # noqa: F401
from ..streaming import decisions  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
