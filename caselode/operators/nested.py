"""Deeply nested JSON records to related flat tables (problem 5).

``merged_schema`` is inferred first: one pass over all records finds every structural path (array positions written
"[]"), what stands there (object, list item) and each attribute with its type and count. The schema is small, is
checkpointed, and tells how many levels the records have. ``node_rows`` then explodes one level after the other in a
single narrow chain (no shuffle): an object, and a scalar in a list, becomes a row of the child table of its path,
with its own key, the key of the nearest object around it and its ordinal in the array. ``child_table`` gives the
rows of one table with the columns the merged schema has for it, ``flat_tables`` those of all.

Nothing is lost: the outermost object is the row of the table "" (its parent is null), scalars of lists are rows
with the attribute "value", a JSON null is an attribute without a value, an empty list is the value "[]".

Defined results
  null, blank, malformed or non-object records, and records with text after the closing brace: no rows;
  a JSON string whose content is a JSON object counts as that object (one level of wrapping);
  empty objects count; of a key an object repeats the last value counts; more than 1,000 levels are no record;
  a null record key is kept, and its ids are those of the empty key; repeated input rows give repeated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from caselode.session import cut_lineage

_MAP, _LIST = "map<string,variant>", "array<variant>"
MAX_ATTRIBUTES = 5000
LEVELS_PER_STEP = 10
_REPEATS = "spark.sql.variant.allowDuplicateKeys"


def _strict(text: Column) -> Column:
    """The value of a text that is one JSON value and nothing else (the parser alone would ignore a tail)."""
    parsed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    items = F.try_variant_get(parsed, "$", _LIST)
    return F.when(F.size(items) == 1, items[0])


def parsed_object(text: Column) -> Column:
    """map<string,variant> of the object a text holds, directly or as the content of a JSON string; else null."""
    value = _strict(text)
    direct = F.try_variant_get(value, "$", _MAP)
    inner = F.when(F.ltrim(text).startswith('"'), F.try_variant_get(_strict(F.try_variant_get(value, "$", "string")), "$", _MAP))
    return F.coalesce(direct, inner)


def _holds_rows(v: Column) -> Column:
    """Is it an object or a list with items (and so rows of its own), not an attribute?"""
    return F.try_variant_get(v, "$", _MAP).isNotNull() | (F.coalesce(F.size(F.try_variant_get(v, "$", _LIST)), F.lit(0)) > 0)


def _text(v: Column) -> Column:
    """An attribute's value as text, numbers without zeros that end a fraction: null for JSON null, "[]" for an empty list."""
    raw = F.to_json(v)
    return F.when(raw.startswith('"'), F.try_variant_get(v, "$", "string")).when(raw != "null", raw)


def _node(path: str, shape: str, parent: str, ordinal: str, value: str) -> str:
    return f"""named_struct('path', {path}, 'shape', {shape}, 'parent', {parent}, 'ordinal', CAST({ordinal} AS INT), 'level', n.level + 1, 'v', {value},
        'm', try_variant_get({value}, '$', '{_MAP}'), 'a', try_variant_get({value}, '$', '{_LIST}'), 'open', true)"""


def _under(prefix: str, part: str) -> str:
    return f"if({prefix} = '', {part}, concat({prefix}, '/', {part}))"


#: The node itself, closed (a list with items is no row), and what it holds one level down. What stands in an array
#: hangs on the nearest object around it, which the array carries as its own parent.
_EXPANDED = f"""explode(CASE WHEN n.open THEN concat(
    transform(filter(array(n), x -> coalesce(size(x.a), 0) <= 0), x -> named_struct('path', x.path, 'shape', x.shape, 'parent', x.parent,
        'ordinal', x.ordinal, 'level', x.level, 'v', x.v, 'm', x.m, 'a', x.a, 'open', false)),
    coalesce(
        transform(filter(map_entries(n.m), e -> try_variant_get(e.value, '$', '{_MAP}') IS NOT NULL OR coalesce(size(try_variant_get(e.value, '$', '{_LIST}')), 0) > 0),
            e -> {_node(_under("n.path", "e.key"), _under("n.shape", "e.key"), "n.path", "NULL", "e.value")}),
        transform(n.a, (x, i) -> {_node(_under("n.path", "CAST(i AS STRING)"), "concat(n.shape, '[]')", "n.parent", "i", "x")}),
        filter(array(n), x -> false)))
  ELSE array(n) END) AS n"""


def _roots(df: DataFrame, key: str, json_col: str) -> DataFrame:
    spark = df.sparkSession
    if spark.conf.get(_REPEATS, "false") != "true":
        spark.conf.set(_REPEATS, "true")
    none = F.lit(None)
    root = F.struct(
        F.lit("").alias("path"),
        F.lit("").alias("shape"),
        none.cast("string").alias("parent"),
        none.cast("int").alias("ordinal"),
        F.lit(0).alias("level"),
        none.cast("variant").alias("v"),
        F.col("_m").alias("m"),
        none.cast(_LIST).alias("a"),
        F.lit(True).alias("open"),
    )
    src = df.select(F.col(key).alias("_key"), parsed_object(F.col(json_col)).alias("_m"))
    return src.where("_m is not null").select("_key", root.alias("n"))


def _descend(rows: DataFrame, levels: int) -> DataFrame:
    for _ in range(levels):
        rows = rows.selectExpr("_key", _EXPANDED)
    return rows


def merged_schema(df: DataFrame, key: str, json_col: str) -> DataFrame:
    """The schema all records share, as a checkpointed table (shape, level, kind, attribute, type, n).

    Per structural path and kind ("object" or "item"): how many there are (attribute null), and per attribute and
    JSON type how many carry it. Steps of LEVELS_PER_STEP levels; a further step reads only what goes deeper.
    """
    rows, found = _roots(df, key, json_col), None
    while rows is not None:
        rows = _descend(rows, LEVELS_PER_STEP)
        n = F.col("n")
        kind = F.when(n["open"], "open").when(n["m"].isNotNull(), "object").otherwise("item")
        told = F.transform(
            F.map_entries(F.map_filter(n["m"], lambda _, v: ~_holds_rows(v))),
            lambda e: F.struct(e["key"].alias("attribute"), F.schema_of_variant(e["value"]).alias("type")),
        )
        nothing = F.struct(F.lit(None).cast("string").alias("attribute"), F.lit(None).cast("string").alias("type"))
        own = F.struct(F.lit("value").alias("attribute"), F.schema_of_variant(n["v"]).alias("type"))
        facts = F.concat(F.array(nothing), F.when(n["m"].isNotNull(), told).otherwise(F.array(own)))
        part = rows.select(n["shape"].alias("shape"), n["level"].alias("level"), kind.alias("kind"), F.explode(facts).alias("f"))
        part = cut_lineage(part.groupBy("shape", "level", "kind", "f.attribute", "f.type").agg(F.count("*").alias("n")))
        found = part if found is None else found.unionByName(part)
        deeper = part.where("kind = 'open'").limit(1).count() > 0
        rows = cut_lineage(rows.where("n.open")) if deeper else None
    return found.where("kind <> 'open'")


def node_rows(df: DataFrame, key: str, json_col: str, schema: DataFrame | None = None) -> DataFrame:
    """One row per object, the outermost included, and per scalar of a list, of each record of ``df``.

    Columns: ``key``, node_path, parent_path, node_id, parent_id (128-bit digests of record key and path, as hex),
    shape, level, ordinal (position in the array directly around, else null), kind ("object" or "item") and
    attributes (map of scalar members as text). The levels to explode come from the merged schema.
    """
    schema = merged_schema(df, key, json_col) if schema is None else schema
    levels = (schema.agg(F.max("level")).first()[0] or 0) + 1
    rows, found = _roots(df, key, json_col), None
    while levels:
        step = min(levels, LEVELS_PER_STEP)
        levels -= step
        rows = _descend(rows, step)
        part = rows.where("not n.open") if levels else rows
        found = part if found is None else found.unionByName(part)
        rows = cut_lineage(rows.where("n.open")) if levels else rows
    n = F.col("n")
    attributes = F.when(n["m"].isNull(), F.create_map(F.lit("value"), _text(n["v"]))).otherwise(
        F.transform_values(F.map_filter(n["m"], lambda _, v: ~_holds_rows(v)), lambda _, v: _text(v))
    )
    record = F.coalesce(F.col("_key").cast("string"), F.lit(""))
    ident = lambda path: F.md5(F.concat_ws(":", F.length(record), record, path))
    return found.select(
        F.col("_key").alias(key),
        n["path"].alias("node_path"),
        n["parent"].alias("parent_path"),
        ident(n["path"]).alias("node_id"),
        F.when(n["parent"].isNotNull(), ident(n["parent"])).alias("parent_id"),
        n["shape"].alias("shape"),
        n["level"].alias("level"),
        n["ordinal"].alias("ordinal"),
        F.when(n["m"].isNull(), "item").otherwise("object").alias("kind"),
        attributes.alias("attributes"),
    )


def table_of(shape: Column) -> Column:
    """The child table of a structural path: small letters, "_" as a blank, no list marks, numbered keys as "#"."""
    bare = F.regexp_replace(F.lower(shape), r"(\[\])+(?=/|$)", "")
    return F.regexp_replace(F.translate(bare, "_", " "), r"(?<=/)[0-9]+(?=/|$)", "#")


def schema_tables(schema: DataFrame) -> dict[str, list[str]]:
    """The child tables of a merged schema with their attributes. They go to the driver; their number is checked."""
    told = schema.select(table_of(F.col("shape")).alias("name"), "attribute").distinct().limit(MAX_ATTRIBUTES + 1).collect()
    if len(told) > MAX_ATTRIBUTES:
        raise ValueError(f"over {MAX_ATTRIBUTES} attributes in the merged schema")
    found: dict[str, list[str]] = {}
    for row in told:
        found.setdefault(row["name"], []).extend([row["attribute"]] if row["attribute"] is not None else [])
    return {name: sorted(attributes) for name, attributes in sorted(found.items())}


def child_table(nodes: DataFrame, schema: DataFrame, name: str, key: str) -> DataFrame:
    """The rows of every structural path that ``table_of`` calls ``name``, with the columns the merged schema has for it.

    Attributes that differ only in case or in blank, "_" and "." share a column; an object that has several
    spellings with different values keeps them all, joined by "; ". A name no record has gives an empty table.
    """
    some = nodes.where(table_of(F.col("shape")) == name)
    fixed = [key, "node_id", "parent_id", "node_path", "parent_path", "ordinal"]
    spellings: dict[str, list[str]] = {}
    for attribute in schema_tables(schema.where(table_of(F.col("shape")) == name)).get(name, []):
        column = attribute.lower().replace(" ", "_").replace(".", "_")
        spellings.setdefault(f"attribute_{column}" if column in fixed else column, []).append(attribute)
    columns = []
    for column, names in sorted(spellings.items()):
        values = [F.try_element_at("attributes", F.lit(n)) for n in names]
        held = F.array_distinct(F.array_compact(F.array(*values)))
        columns.append((values[0] if len(values) == 1 else F.when(F.size(held) > 0, F.array_join(held, "; "))).alias(column))
    return some.select(*fixed, *columns)


def flat_tables(df: DataFrame, key: str, json_col: str) -> dict[str, DataFrame]:
    """Every child table of the records, by name ("" is that of the records themselves)."""
    schema = merged_schema(df, key, json_col)
    nodes = node_rows(df, key, json_col, schema)
    return {name: child_table(nodes, schema, name, key) for name in schema_tables(schema)}
