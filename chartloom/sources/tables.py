"""Readers for side tables: tab files, dictionaries, mappings, labels, splits and logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import entity, is_clinical_path
from ..scale import checkpointed
from .files import numbered_lines


def tab_inventory(lines: DataFrame) -> DataFrame:
    """Per file: columns, data rows and the column list.

    ``lines`` has (file, line_no, line) with line numbers from 0.
    """
    cde = F.max(F.when((F.col("line_no") == 2) & F.upper("line").startswith("CDE_ID"), 3).otherwise(1))
    agg = lines.groupBy("file").agg(
        F.max(F.when(F.col("line_no") == 0, F.col("line"))).alias("_h"), cde.alias("_skip"), F.count(F.lit(1)).alias("_n")
    )
    cols = F.split("_h", "\t")
    return agg.select(
        "file", F.regexp_replace("file", r"^nationwidechildrens\.org_|\.txt$", "").alias("table"),
        F.size(cols).alias("n_columns"), F.greatest(F.col("_n") - F.col("_skip"), F.lit(0)).alias("n_rows"),
        F.array_join(cols, ";").alias("columns"),
    )


def file_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, line) of text files by their names."""
    return numbered_lines(spark, path).select(F.element_at(F.split("file", "/"), -1).alias("file"), "line_no", "line")


# ---- dictionary and mapping -----------------------------------------------------
# Dictionary entities that are clinical, and case fields that are not.
CLINICAL_ENTITIES = (
    "case", "demographic", "diagnosis", "treatment", "exposure", "follow_up", "family_history", "pathology_detail", "molecular_test",
)
SKIPPED_CASE_FIELDS = (
    "samples", "files", "aliquots", "portions", "analytes", "slides", "read_groups", "annotations",
    "tissue_source_site", "tissue_source_sites", "projects",
)


def _get(v: Column, path: str, kind: str) -> Column:
    return F.try_variant_get(v, F.lit(path), kind)


_BRANCHES = ("oneOf", "anyOf")


def _is_object(v: Column) -> Column:
    return F.schema_of_variant(v).startswith("OBJECT")


def _branches(v: Column, path: Column) -> Column:
    """The schemas inside a schema with their paths: pairs of (kind, position), kinds in the order enums are listed."""
    none = F.array().cast("array<struct<path:array<int>,value:variant>>")

    def listed(kind: int, name: str) -> Column:
        return F.transform(
            _get(v, f"$.{name}", "array<variant>"),
            lambda p, i: F.struct(F.concat(path, F.array(F.lit(kind), i)).alias("path"), p.alias("value")),
        )

    parts = [listed(kind, name) for kind, name in enumerate(_BRANCHES)]
    items = _get(v, "$.items", "variant")
    inside = F.array(F.struct(F.concat(path, F.array(F.lit(len(_BRANCHES)), F.lit(0))).alias("path"), items.alias("value")))
    return F.concat(*[F.coalesce(p, none) for p in parts], F.when(items.isNotNull(), inside).otherwise(none))


def _nested_levels(properties: DataFrame, keys: list[str]) -> list[DataFrame]:
    """The properties' schemas level by level, each with its path, until no schema has another inside."""
    level = properties.select(*keys, F.array().cast("array<int>").alias("path"), "value")
    out = []
    while True:
        level = checkpointed(level)
        if level.isEmpty():
            return out
        out.append(level)
        inner = F.explode(_branches(F.col("value"), F.col("path"))).alias("b")
        level = level.where(_is_object(F.col("value"))).select(*keys, inner).select(*keys, "b.path", "b.value")


def property_types(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, type) of the properties: enum, branches joined by bars, lists, arrays with their items, or a reference.

    Worked out from the innermost level outwards; a schema's text needs those of the schemas in it.
    """
    below = None
    for level in reversed(levels):
        if below is not None:
            size = F.size("path")
            inner = below.groupBy(*keys, F.slice("path", F.lit(1), size - 2).alias("path")).agg(
                F.array_sort(F.collect_list(F.struct(
                    F.get("path", size - 2).alias("kind"), F.get("path", size - 1).alias("at"), "type", "object"
                ))).alias("inner")
            )
            level = level.join(inner, [*keys, "path"], "left")
        else:
            level = level.withColumn("inner", F.lit(None).cast("array<struct<kind:int,at:int,type:string,object:boolean>>"))
        v, none = F.col("value"), F.array().cast("array<struct<kind:int,at:int,type:string,object:boolean>>")

        def joined(kind: int) -> Column:
            mine = F.filter(F.coalesce("inner", none), lambda x: (x["kind"] == kind) & x["object"] & (x["type"] != ""))
            return F.array_join(F.transform(mine, lambda x: x["type"]), "|")

        items = F.get(F.filter(F.coalesce("inner", none), lambda x: x["kind"] == len(_BRANCHES)), F.lit(0))["type"]
        strings, plain = _get(v, "$.type", "array<string>"), _get(v, "$.type", "string")
        enum = F.size(F.coalesce(_get(v, "$.enum", "array<variant>"), F.array().cast("array<variant>"))) > 0
        text = F.when(enum, "enum")
        for kind, name in enumerate(_BRANCHES):
            text = text.when(_get(v, f"$.{name}", "array<variant>").isNotNull(), joined(kind))
        text = (
            text.when(strings.isNotNull(), F.array_join(strings, "|"))
            .when((plain == "array") & (F.coalesce(items, F.lit("")) != ""), F.concat(F.lit("array["), items, F.lit("]")))
            .when(plain.isNotNull(), plain)
            .otherwise(F.coalesce(_get(v, "$['$ref']", "string"), F.lit("")))
        )
        object_ = _is_object(v)
        below = level.select(*keys, "path", object_.alias("object"), F.when(object_, text).otherwise(F.coalesce(v.try_cast("string"), F.lit(""))).alias("type"))
    return below.select(*keys, "type")


def property_enums(levels: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, enum) with the distinct enum texts of a property and everything inside it, in document order."""
    found = reduce(DataFrame.unionByName, levels).select(
        *keys, F.struct("path", F.coalesce(_get(F.col("value"), "$.enum", "array<string>"), F.array().cast("array<string>")).alias("texts")).alias("n")
    )
    listed = F.flatten(F.transform(F.array_sort(F.collect_list("n")), lambda n: n["texts"]))
    return found.groupBy(*keys).agg(F.array_distinct(listed).alias("enum"))


def flatten_dictionary(schemas: DataFrame) -> DataFrame:
    """One row per (entity, field) of clinical schemas; ``schemas`` has (entity, schema VARIANT)."""
    clinical = F.col("entity").isin(*CLINICAL_ENTITIES) | (_get(F.col("schema"), "$.category", "string") == "clinical")
    kept = schemas.where(~F.col("entity").startswith("_") & (F.col("entity") != "clinical") & clinical).select(
        "entity", F.coalesce(_get(F.col("schema"), "$.required", "array<string>"), F.array().cast("array<string>")).alias("_r"),
        _get(F.col("schema"), "$.properties", "variant").alias("_p"),
    )
    rows = kept.lateralJoin(schemas.sparkSession.tvf.variant_explode(F.col("_p").outer())).select(
        "entity", "_r", F.col("key").alias("field"), "value"
    ).where(~((F.col("entity") == "case") & F.col("field").isin(*SKIPPED_CASE_FIELDS)))
    rows, keys = checkpointed(rows), ["entity", "field"]
    levels = _nested_levels(rows, keys)
    if not levels:
        return rows.select(*keys, *[F.lit("").alias(c) for c in ("type", "required", "description", "enum")], F.lit(0).alias("n_enum"))
    found = rows.join(property_types(levels, keys), keys).join(property_enums(levels, keys), keys)
    return found.select(
        "entity", "field", "type",
        F.when(F.array_contains("_r", F.col("field")), "yes").otherwise("no").alias("required"),
        F.coalesce(_get(F.col("value"), "$.description", "string"), F.lit("")).alias("description"),
        F.array_join("enum", " | ").alias("enum"), F.size("enum").alias("n_enum"),
    )


def flatten_mapping(payload: DataFrame, clinical_only: bool = True) -> DataFrame:
    """Official paths with entity, type and description; ``payload`` has one VARIANT column ``doc``."""
    fields = payload.select(F.explode(_get(F.col("doc"), "$.fields", "array<string>")).alias("field"))
    info = payload.select(_get(F.col("doc"), "$._mapping", "variant").alias("_m")).lateralJoin(
        payload.sparkSession.tvf.variant_explode(F.col("_m").outer())
    ).select(
        F.col("key").alias("field"), _get(F.col("value"), "$.type", "string").alias("type"), _get(F.col("value"), "$.description", "string").alias("description")
    )
    inside = is_clinical_path(F.col("field"))
    out = fields.join(info, "field", "left").select(
        "field", entity(F.col("field")).alias("entity"), F.coalesce("type", F.lit("")).alias("type"),
        F.coalesce("description", F.lit("")).alias("description"), F.when(inside, "yes").otherwise("no").alias("in_clinical_json"),
    )
    return out.where("in_clinical_json = 'yes'") if clinical_only else out


def checked_mapping(mapping: DataFrame) -> DataFrame:
    """Mapping rows with their columns checked; a repeated path fails the job."""
    missing = {"field", "entity"} - set(mapping.columns)
    if missing:
        raise ValueError(f"mapping lacks columns {sorted(missing)}")
    per = mapping.groupBy("field").agg(F.count(F.lit(1)).alias("_n"), F.first(F.coalesce("entity", F.lit(""))).alias("entity"))
    again = F.raise_error(F.concat(F.lit("mapping field repeated: "), F.col("field"))).cast("string")
    return per.select("field", F.when(F.col("_n") == 1, F.col("entity")).otherwise(again).alias("entity"))


# ---- labels, splits, logs -----------------------------------------------------
def picked(df: DataFrame, name: str) -> Column:
    """A column by name, whatever its case."""
    for c in df.columns:
        if c.lower() == name.lower():
            return F.col(f"`{c}`")
    raise ValueError(f"no column {name!r} among {df.columns}")


def label_table(df: DataFrame) -> DataFrame:
    """Labels with numeric time and censorship, column names in any case."""
    return df.select(
        picked(df, "case_id").cast("string").alias("case_id"),
        picked(df, "survival_months").cast("string").try_cast("double").alias("survival_months"),
        picked(df, "censorship").cast("string").try_cast("double").cast("int").alias("censorship"),
    )


def split_table(wide: DataFrame) -> DataFrame:
    """Ragged train/val/test columns to long (fold, part, case_id); ``wide`` carries ``file``."""
    fold = F.regexp_extract("file", r"splits_(\d+)", 1).cast("int").alias("fold")
    parts = [p for p in ("train", "val", "test") if p in wide.columns]
    long = wide.select(fold, *parts).unpivot("fold", parts, "part", "case_id")
    return long.where(F.col("case_id").isNotNull() & (F.col("case_id") != ""))


def read_splits(spark: SparkSession, folder: str) -> DataFrame:
    df = spark.read.csv(f"{folder}/splits_*.csv", header=True).withColumn("file", F.col("_metadata.file_name"))
    return split_table(df)


def read_evaluations(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation log rows from JSON lines."""
    schema = ("logical_eval_idx long, k long, subset array<string>, cv_c_mean double, cv_folds array<double>, "
              "status string, physical_cache_hit boolean, wall_ms long")
    return spark.read.schema(schema).json(path)
