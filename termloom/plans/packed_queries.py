"""Query and oracle of the packed-field operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termloom.operators.packed import unpack_postings
from termloom.sources.tables import table


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return unpack_postings(table(spark, d, "term_freq_rep"), "full_rep", ["rep_id"])


#: The habits of the fixture's fields, written out as one pattern; the operator knows none of them.
P4_SQL = r"""
SELECT rep_id, CAST(pos AS INTEGER) AS pos, CAST(regexp_extract(e, '(\d+)', 1) AS BIGINT) AS doc_id,
  CASE WHEN regexp_matches(e, '^"?''?\d+"?''?\s*[,:=/]')
       THEN CAST(regexp_replace(regexp_extract(e, '^"?''?\d+"?''?\s*[,:=/]\s*"?(\d[\d,]*)', 1), ',', '', 'g') AS BIGINT)
       ELSE 1 END AS freq
FROM (SELECT rep_id, unnest(es) AS e, unnest(range(1, len(es) + 1)) AS pos FROM (
  SELECT rep_id, regexp_extract_all(full_rep,
    '"?''?\d+"?''?(?:\s*[,:=/]\s*(?:"\d{1,3}(?:,\d{3})+"|"?\d+(?:\.\d+)?"?))?') AS es
  FROM term_freq_rep WHERE full_rep IS NOT NULL))
"""

QUERIES = {"p4_found": p4_found}
ORACLES = {"p4_found": P4_SQL}
