"""All queries of this subpackage."""

from assay.llm import (  # noqa: F401
    decontamination,
    dialogues,
    embeddings,
    jaccard,
    licenses,
    merkle,
    packing,
    passages,
    periods,
    quality,
    sharding,
    signatures,
    token_files,
)
from assay.llm.registry import ORACLES, QUERIES  # noqa: F401
