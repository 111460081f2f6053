"""All registered queries."""

from assay.plans import (  # noqa: F401
    evaluation_queries,
    projection_queries,
    run_queries,
    source_queries,
    stream_queries,
    text_queries,
    vector_queries,
)
from assay.plans.registry import ORACLES, QUERIES  # noqa: F401
