"""All queries of the library."""

from . import eda_queries, encoder_queries, interaction_queries, model_queries, service_queries, source_queries, stream_queries, text_queries, word_queries
from .registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "eda_queries", "encoder_queries", "interaction_queries", "model_queries", "service_queries", "source_queries", "stream_queries", "text_queries", "word_queries"]
