"""All registered queries and their SQL, by name."""

from __future__ import annotations

from tessella.plans import catalog, context, corpus, embedding, evaluation, headings, references, relational, retrieval, selection, storage, typed  # noqa: F401
from tessella.plans.base import QUERIES, SQL  # noqa: F401
