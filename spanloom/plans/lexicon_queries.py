"""Queries over names of a list found in texts."""

from pyspark.sql import functions as F

from ..operators import lexicon as L
from ..queries import query
from ..session import read_table as t
from ..session import read_texts

_W = r"[\p{L}\p{N}_]+"
_KEY = lambda c: f"array_to_string(regexp_extract_all(lower({c}), '{_W}'), ' ')"
_RUNS = " UNION ALL ".join(f"SELECT doc_id, s AS start_char, lead(e, {n - 1}) OVER w AS end_char, {' || chr(32) || '.join(['low'] + [f'lead(low, {k}) OVER w' for k in range(1, n)])} AS key FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY i)" for n in range(1, 7))


@query(
    "catalogue_mentions",
    f"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(text, '{_W}')) AS word, unnest(regexp_split_to_array(text, '{_W}')[1:len(regexp_extract_all(text, '{_W}'))]) AS gap, unnest(range(1, len(regexp_extract_all(text, '{_W}')) + 1)) AS i FROM documents WHERE text IS NOT NULL),
        p AS MATERIALIZED (SELECT doc_id, i, lower(word) AS low, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i) - length(word))::INT AS s, (sum(length(gap) + length(word)) OVER (PARTITION BY doc_id ORDER BY i))::INT AS e FROM u),
        r AS ({_RUNS}), x AS (SELECT DISTINCT {_KEY('kb_name')} AS key, entity_type AS label FROM kb_entities WHERE kb_name IS NOT NULL) SELECT r.doc_id, start_char, end_char, substring(d.text, start_char + 1, end_char - start_char) AS surface, label FROM r JOIN x USING (key) JOIN documents d ON d.doc_id = r.doc_id WHERE end_char IS NOT NULL AND key <> ''""",
)
def catalogue_mentions(spark, d):
    """Where names of the catalogue stand in the texts as they are spelled there."""
    return L.lexicon_entities(read_texts(spark, d), t(spark, d, "kb_entities").select(F.col("kb_name").alias("name"), F.col("entity_type").alias("label")))
