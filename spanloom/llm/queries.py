"""Queries of the corpus problems, named pN_..., and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import read_table, read_texts
from . import canonical_text, chunking, grouping, language, mixing, name_linking, packing, pii

Query = Callable[[SparkSession, str], DataFrame]


def _over(f: Callable[..., DataFrame], *tables: str) -> Query:
    return lambda spark, sf_dir: f(*[read_texts(spark, sf_dir) if t == "documents" else read_table(spark, sf_dir, t) for t in tables])


def queries() -> dict[str, Query]:
    return {
        "p1_found": _over(canonical_text.entities_to_mend, "predictions", "documents"),
        "p1_entities": _over(canonical_text.canonical_entities, "predictions", "documents"),
        "p1_documents": _over(canonical_text.canonical_documents, "documents"),
        "p2_found": _over(language.mislabelled, "documents"),
        "p2_documents": _over(language.document_languages, "documents"),
        "p2_segments": _over(language.language_segments, "documents"),
        "p3_found": _over(chunking.oversized, "documents", "encoder_configs"),
        "p3_pieces": _over(chunking.split_documents, "documents", "encoder_configs"),
        "p4_found": _over(grouping.grouped_records, "match_pairs"),
        "p4_entities": _over(grouping.group_entities, "match_pairs", "predictions"),
        "p5_found": _over(name_linking.misspelt_records, "length_examples", "predictions", "kb_entities"),
        "p5_links": _over(name_linking.linked_records, "length_examples", "predictions", "kb_entities"),
        "p6_found": lambda spark, d: packing.cut_documents(_packed(spark, d)),
        "p6_containers": lambda spark, d: _packed(spark, d),
        "p6_report": lambda spark, d: packing.packing_report(_packed(spark, d), read_table(spark, d, "pack_specs")),
        "p7_found": _over(mixing.sources_falling_short, "documents", "mix_targets"),
        "p8_found": _over(pii.personal_information, "documents", "kb_entities"),
        "p8_documents": _over(pii.masked_documents, "documents", "kb_entities"),
        "p7_report": _over(mixing.mix_report, "documents", "mix_targets"),
        "p7_mix": _over(mixing.mixed, "documents", "mix_targets"),
    }


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(read_texts(spark, sf_dir), read_table(spark, sf_dir, "pack_specs"))


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": """
            SELECT c.config_id, d.doc_id FROM documents d JOIN encoder_configs c
            ON octet_length(encode(d.text)) > c.max_position_embeddings""",
        "p6_found": """
            SELECT p.pack_id, d.doc_id FROM documents d JOIN pack_specs p
            ON octet_length(encode(d.text)) > p.capacity_tokens""",
        "p7_found": """
            WITH s AS (SELECT source, sum(coalesce(octet_length(encode(text)), 0)) AS tokens FROM documents GROUP BY source),
                 w AS (SELECT sum(tokens) AS total FROM s)
            SELECT m.mix_id, m.source FROM mix_targets m CROSS JOIN w LEFT JOIN s ON s.source = m.source
            WHERE m.target_share * w.total > m.max_repeats * coalesce(s.tokens, 0)""",
    }
