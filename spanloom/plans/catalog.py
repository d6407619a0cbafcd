"""All modules that register queries."""

from . import analysis_queries, coreference_queries, dataset_queries, evaluation_queries, extraction_queries, graph_queries, lexicon_queries, matching_queries, relation_queries, sequence_queries, span_queries, statistics_queries, text_queries, track_queries  # noqa: F401
