"""Queries of problem 5: the trees in augmented_notes_30k.summary as flat tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from caselode.operators import nested
from caselode.operators.skew import spread
from caselode.sources.tables import table


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "augmented_notes_30k").select("line_no", "summary"))


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return nested.node_rows(_notes(spark, d), "line_no", "summary")


def _child(spark: SparkSession, d: str, name: str) -> DataFrame:
    notes = _notes(spark, d)
    schema = nested.merged_schema(notes, "line_no", "summary")
    return nested.child_table(nested.node_rows(notes, "line_no", "summary", schema), schema, name, "line_no")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).where("kind = 'object' and level > 0").select("line_no", "node_path", "parent_path")


def p5_nodes(spark: SparkSession, d: str) -> DataFrame:
    objects = _nodes(spark, d).where("kind = 'object' and level > 0")
    return objects.select("line_no", "node_path", "parent_path", "node_id", "parent_id", "shape", "ordinal", F.to_json("attributes").alias("attributes"))


def p5_schema(spark: SparkSession, d: str) -> DataFrame:
    """Per structural path and attribute: how many objects, or items of lists, carry it (attribute null: how many there are)."""
    return nested.merged_schema(_notes(spark, d), "line_no", "summary").groupBy("shape", "kind", "attribute").agg(F.sum("n").alias("objects"))


def p5_tables(spark: SparkSession, d: str) -> DataFrame:
    """Every row of every table the merged tree has: notes (""), sections, objects of all levels and scalars of lists."""
    rows = _nodes(spark, d).withColumn("table_name", nested.table_of(F.col("shape")))
    return rows.select("line_no", "table_name", "kind", "node_path", "parent_path", "node_id", "parent_id", "ordinal", F.to_json("attributes").alias("attributes"))


def p5_values(spark: SparkSession, d: str) -> DataFrame:
    """Every leaf of every summary: the row it belongs to, its attribute and its value (null for JSON null)."""
    return _nodes(spark, d).select("line_no", "node_path", F.explode("attributes").alias("attribute", "value"))


def p5_symptoms(spark: SparkSession, d: str) -> DataFrame:
    return _child(spark, d, "symptoms")


def p5_treatments(spark: SparkSession, d: str) -> DataFrame:
    return _child(spark, d, "treatments")


def p5_doses(spark: SparkSession, d: str) -> DataFrame:
    return _child(spark, d, "treatments/doses")


QUERIES = {f.__name__: f for f in (p5_found, p5_nodes, p5_schema, p5_tables, p5_values, p5_symptoms, p5_treatments, p5_doses)}
# DuckDB takes commas before closers for valid; they are ruled out by pattern
_TREE = r"""
WITH RECURSIVE one AS (
  SELECT line_no, CASE WHEN json_valid(summary) AND NOT regexp_matches(summary, ',\s*[}\]]') THEN summary END AS s FROM augmented_notes_30k),
two AS (
  SELECT line_no, CASE WHEN json_type(s) = 'OBJECT' THEN s WHEN json_type(s) = 'VARCHAR' THEN json_extract_string(s, '$') END AS s FROM one WHERE s IS NOT NULL),
docs AS (SELECT line_no, CAST(s AS JSON) AS j FROM two WHERE s IS NOT NULL AND json_valid(s) AND NOT regexp_matches(s, ',\s*[}\]]') AND json_type(s) = 'OBJECT'),
nodes AS (
  SELECT line_no, '' AS path, CAST(NULL AS VARCHAR) AS parent, '' AS shape, CAST(NULL AS INT) AS ordinal, 0 AS level, j FROM docs
  UNION ALL
  SELECT n.line_no, CASE WHEN n.path = '' THEN e.key ELSE n.path || '/' || e.key END,
         CASE WHEN json_type(n.j) = 'OBJECT' THEN n.path ELSE n.parent END,
         CASE WHEN json_type(n.j) = 'ARRAY' THEN n.shape || '[]' WHEN n.shape = '' THEN e.key ELSE n.shape || '/' || e.key END,
         CASE WHEN json_type(n.j) = 'ARRAY' THEN CAST(e.key AS INT) END, n.level + 1, e.value
  FROM nodes n, json_each(n.j) e WHERE json_type(n.j) = 'ARRAY' OR json_type(e.value) = 'OBJECT' OR json_array_length(e.value) > 0),
objects AS (SELECT * FROM nodes WHERE level > 0 AND json_type(j) = 'OBJECT'),
told AS (SELECT *, CASE WHEN json_type(j) = 'OBJECT' THEN 'object' ELSE 'item' END AS kind FROM nodes WHERE json_type(j) <> 'ARRAY' OR json_array_length(j) = 0),
leaves AS (
  SELECT t.line_no, t.path, t.shape, t.kind, e.key AS attribute, CASE WHEN json_type(e.value) = 'DOUBLE' THEN rtrim(rtrim(e.value ->> '$', '0'), '.') WHEN json_type(e.value) <> 'NULL' THEN e.value ->> '$' END AS value
  FROM told t, json_each(t.j) e WHERE t.kind = 'object' AND json_type(e.value) <> 'OBJECT' AND (json_type(e.value) <> 'ARRAY' OR json_array_length(e.value) = 0)
  UNION ALL SELECT line_no, path, shape, kind, 'value', CASE WHEN json_type(j) = 'DOUBLE' THEN rtrim(rtrim(j ->> '$', '0'), '.') WHEN json_type(j) <> 'NULL' THEN j ->> '$' END FROM told WHERE kind = 'item'),
keyed AS (SELECT *, md5(length(line_no::VARCHAR) || ':' || line_no || ':' || path) AS node_id,
          CASE WHEN parent IS NOT NULL THEN md5(length(line_no::VARCHAR) || ':' || line_no || ':' || parent) END AS parent_id,
          regexp_replace(translate(regexp_replace(lower(shape), '(\[\])+(/|$)', '\2', 'g'), '_', ' '), '/[0-9]+(/|$)', '/#\1', 'g') AS table_name FROM told)
"""


def _child_sql(name: str, columns: dict[str, tuple[str, ...]]) -> str:
    """The child table as SQL; every attribute's spellings are named."""
    held = ", ".join(
        "coalesce(" + ", ".join(f"max(CASE WHEN l.attribute = '{s}' THEN l.value END)" for s in spellings) + f") AS {column}" for column, spellings in columns.items()
    )
    return _TREE + f"""SELECT k.line_no, k.node_id, k.parent_id, k.path AS node_path, k.parent AS parent_path, k.ordinal, {held}
FROM keyed k LEFT JOIN leaves l ON l.line_no = k.line_no AND l.path = k.path AND l.kind = k.kind WHERE k.table_name = '{name}' GROUP BY ALL"""


ORACLE = {
    "p5_found": _TREE + "SELECT line_no, path AS node_path, parent AS parent_path FROM objects",
    "p5_schema": _TREE
    + """SELECT shape, kind, CAST(NULL AS VARCHAR) AS attribute, count(*) AS objects FROM told GROUP BY ALL
UNION ALL SELECT shape, kind, attribute, count(*) FROM leaves GROUP BY ALL""",
    "p5_values": _TREE + "SELECT line_no, path AS node_path, attribute, value FROM leaves",
    "p5_nodes": _TREE
    + """, members AS (SELECT line_no, path, '{' || string_agg(to_json(attribute) || ':' || coalesce(to_json(value)::VARCHAR, 'null'), ',' ORDER BY attribute) || '}' AS attributes
  FROM leaves WHERE kind = 'object' GROUP BY ALL)
SELECT k.line_no, k.path AS node_path, k.parent AS parent_path, k.node_id, k.parent_id, k.shape, k.ordinal, coalesce(m.attributes, '{}') AS attributes
FROM keyed k LEFT JOIN members m ON m.line_no = k.line_no AND m.path = k.path WHERE k.kind = 'object' AND k.level > 0""",
    "p5_tables": _TREE
    + """, members AS (SELECT line_no, path, kind, '{' || string_agg(to_json(attribute) || ':' || coalesce(to_json(value)::VARCHAR, 'null'), ',' ORDER BY attribute) || '}' AS attributes
  FROM leaves GROUP BY ALL)
SELECT k.line_no, k.table_name, k.kind, k.path AS node_path, k.parent AS parent_path, k.node_id, k.parent_id, k.ordinal, coalesce(m.attributes, '{}') AS attributes
FROM keyed k LEFT JOIN members m ON m.line_no = k.line_no AND m.path = k.path AND m.kind = k.kind""",
    "p5_symptoms": _child_sql("symptoms", {c: (c.replace("_", " "),) for c in ("intensity_of_symptom", "location", "name_of_symptom", "time", "value")}),
    "p5_treatments": _child_sql("treatments", {c: (c.replace("_", " "),) for c in ("doses", "name", "related_condition", "value")}),
    "p5_doses": _child_sql("treatments/doses", {c: (c,) for c in ("amount", "taken", "unit")}),
}
