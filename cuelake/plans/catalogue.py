"""All registered queries and their SQL oracles."""

from . import other_queries, stream_queries, structure_queries, text_queries, window_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
