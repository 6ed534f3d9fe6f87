"""Named queries over the given tables, their SQL twins, and the plan registry."""

from loomframe.plans import (  # noqa: F401
    annotation_queries,
    image_queries,
    label_queries,
    metric_queries,
    sampling_queries,
    stream_queries,
    text_queries,
    vector_queries,
)
from loomframe.plans.registry import ORACLE, QUERIES  # noqa: F401
