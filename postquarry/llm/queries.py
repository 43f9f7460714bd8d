"""Queries of the text operators and their SQL."""

from __future__ import annotations

from ..session import table
from . import canonical, languages, leakage, linkage, reading, tokenizer


def _documents(spark, d):
    return table(spark, d, "documents").select("doc_id", "text", "lang")


def p1_found(spark, d):
    return canonical.canonical_matches(table(spark, d, "combined_jobs"), table(spark, d, "canonical_values"))


def p1_nearest(spark, d):
    values = canonical.entered_values(table(spark, d, "combined_jobs")).select("field", "value")
    return canonical.nearest_labels(values, table(spark, d, "canonical_values"))


def p2_found(spark, d):
    return languages.mislabelled_segments(table(spark, d, "combined_jobs")).select("row_id", "field", "segment", "lang")


def p2_segments(spark, d):
    return languages.label_segments(table(spark, d, "combined_jobs"))


def p6_found(spark, d):
    return linkage.linked_pairs(table(spark, d, "combined_jobs"), table(spark, d, "canonical_values")).select("row_id_1", "row_id_2")


def p6_pairs(spark, d):
    return linkage.linked_representatives(table(spark, d, "combined_jobs"), table(spark, d, "canonical_values"))


def p6_members(spark, d):
    return linkage.represented(table(spark, d, "combined_jobs"), table(spark, d, "canonical_values"))


def p7_ids(spark, d):
    return tokenizer.encode_corpus(_documents(spark, d))


def p8_found(spark, d):
    return leakage.leaked_items(_documents(spark, d), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p8_overlaps(spark, d):
    return leakage.leaked_items(_documents(spark, d), table(spark, d, "eval_items"))


def p9_found(spark, d):
    return reading.reading_levels(_documents(spark, d), table(spark, d, "level_labels")).select("doc_id", "reading_level")


def p9_grades(spark, d):
    return reading.reading_grades(_documents(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_nearest, p2_found, p2_segments, p6_found, p6_pairs, p6_members, p7_ids, p8_found, p8_overlaps, p9_found, p9_grades)}

# every value against every label, without the join's segments; edits are counted in bytes there, so any letter that no label has is one byte
_P1_NEAREST = f"""WITH e AS (SELECT 'title' AS field, title AS value FROM combined_jobs UNION ALL SELECT 'job_category', job_category FROM combined_jobs),
v AS (SELECT DISTINCT field, lower(trim(value)) AS value FROM e WHERE trim(value) <> ''),
r AS (SELECT field, lower(trim(label)) AS ref, min(ref_id) AS ref_id FROM canonical_values WHERE trim(label) <> '' GROUP BY 1, 2),
n AS (SELECT v.field, value, ref, ref_id, levenshtein(regexp_replace(value, '[^ -~]', '\x01', 'g'), ref) AS edits, CASE {' '.join(f'WHEN length(ref) >= {least} THEN {k}' for least, k in reversed(canonical.EDITS))} END AS k FROM v JOIN r USING (field))
SELECT field, value, ref_id, edits::integer AS edits FROM n WHERE edits <= k QUALIFY row_number() OVER (PARTITION BY field, value
ORDER BY edits, CASE WHEN edits > 1 THEN (list_sort(string_split(value, '')) <> list_sort(string_split(ref, '')))::int ELSE 0 END, ref_id) = 1"""

SQL: dict[str, str] = {"p1_nearest": _P1_NEAREST}
