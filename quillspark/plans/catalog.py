"""The engine's queries over the driver tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from quillspark.plans import answers, chunks, evaluation, graphs, memory, others, relations, retrieval, segmentation  # noqa: F401  (registers its queries)
from quillspark.plans.registry import QUERIES, SQL  # noqa: F401

FLAGSHIP = "ret_context"
