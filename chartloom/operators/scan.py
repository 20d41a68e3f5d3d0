"""Which fields exist: key scan of documents, field dictionary and presence against the official list."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import array_of, object_of
from ..functions.text import leaf, without_arrays
from ..scale import checkpointed

# Labels of generic fields, of ids and of unknown fields; clinical entities and their path prefix.
GENERIC_LABELS = {
    "state": "release state of the record", "created_datetime": "time the record was created",
    "updated_datetime": "time the record was last updated", "submitter_id": "identifier given by the submitter",
}
ID_LABEL = "identifier"
NO_LABEL = "no description"
ENTITY_PREFIX = {
    "case": "", "demographic": "demographic", "diagnosis": "diagnoses[]",
    "pathology_detail": "diagnoses[].pathology_details[]", "treatment": "diagnoses[].treatments[]",
    "exposure": "exposures[]", "follow_up": "follow_ups[]", "molecular_test": "follow_ups[].molecular_tests[]",
    "other_clinical_attribute": "follow_ups[].other_clinical_attributes[]", "family_history": "family_histories[]",
    "project": "project",
}


def _inside(prefix: Column, v: Column) -> Column:
    """Rows of one object: its keys, and the objects directly inside it under their own prefix."""
    none, empty = F.lit(None).cast("variant"), F.array().cast("array<struct<prefix:string,key:string,v:variant>>")

    def row(p: Column, key: Column, value: Column) -> Column:
        return F.struct(p.alias("prefix"), key.cast("string").alias("key"), value.alias("v"))

    def entry(e: Column) -> Column:
        path = F.when(prefix == "", e["key"]).otherwise(F.concat(prefix, F.lit("."), e["key"]))
        child = e["value"]
        items = F.filter(array_of(child), lambda x: object_of(x).isNotNull())
        inside = F.transform(items, lambda x: row(F.concat(path, F.lit("[]")), F.lit(None), x))
        nested = F.when(object_of(child).isNotNull(), F.array(row(path, F.lit(None), child))).otherwise(F.coalesce(inside, empty))
        return F.concat(F.array(row(prefix, e["key"], none)), nested)

    entries = F.map_entries(object_of(v))
    return F.coalesce(F.flatten(F.transform(entries, entry)), empty)


def _keys_to(cases: DataFrame, depth: int) -> DataFrame:
    """Distinct keys of the first ``depth`` levels; objects left unopened below give rows with a null key."""
    node = cases.where(object_of(F.col("doc")).isNotNull()).select(
        "dataset", F.struct(F.lit("").alias("prefix"), F.lit(None).cast("string").alias("key"), F.col("doc").alias("v")).alias("n")
    )
    for _ in range(depth):
        opened = F.when(F.col("n.key").isNotNull(), F.array("n")).otherwise(_inside(F.col("n.prefix"), F.col("n.v")))
        node = node.select("dataset", F.explode(opened).alias("n"))
    return node.select("dataset", F.col("n.prefix").alias("prefix"), F.col("n.key").alias("key")).distinct()


def scan_keys(cases: DataFrame, depth: int = 8) -> DataFrame:
    """Distinct (dataset, prefix, key) over all documents, whatever their depth.

    Each level opens the objects found so far and passes finished keys on, in
    one chain without a shuffle; only distinct keys are moved.  ``depth`` is the
    length of the first chain; it doubles while objects are left below it.
    """
    while True:
        found = checkpointed(_keys_to(cases, depth))
        if found.where("key is null").isEmpty():
            return found
        depth *= 2


def field_dictionary(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """Fields with path, label and order: known fields in dictionary order, others by name.

    ``labels`` has (prefix, field, label, ord).  A label is looked up by
    section, then generic names, then any section, then ids.
    """
    known = labels.select("prefix", F.col("field").alias("key"), "label", "ord")
    anywhere = labels.groupBy(F.col("field").alias("key")).agg(F.min_by("label", "ord").alias("_any"))
    generic = F.lit(None).cast("string")
    for name, label in GENERIC_LABELS.items():
        generic = F.when(F.col("key") == name, label).otherwise(generic)
    j = keys.join(known, ["prefix", "key"], "left").join(anywhere, "key", "left")
    label = F.coalesce("label", generic, "_any", F.when(F.col("key").endswith("_id"), ID_LABEL), F.lit(NO_LABEL))
    path = F.when(F.col("prefix") == "", F.col("key")).otherwise(F.concat_ws(".", "prefix", "key"))
    # a section holds the field names of one object kind
    w = Window.partitionBy("dataset", "prefix").orderBy(F.asc_nulls_last("ord"), "key")
    return j.select("dataset", "prefix", path.alias("field_path"), F.col("key").alias("field_name"), label.alias("label"),
                    F.row_number().over(w).cast("long").alias("place"))


def presence(scanned: DataFrame, mapping: DataFrame, datasets: DataFrame) -> DataFrame:
    """Official paths against scanned ones per dataset, three statuses."""
    # one row listing the registry's datasets meets every official path
    names = datasets.agg(F.collect_set("dataset").alias("_d"))
    official = mapping.select("field", "entity").join(F.broadcast(names)).select("field", "entity", F.explode("_d").alias("dataset"))
    seen = scanned.select("dataset", without_arrays(F.col("field_path")).alias("field"), F.col("field_path").alias("scan_path"))
    j = official.withColumn("_in", F.lit(True)).join(seen, ["dataset", "field"], "full")
    status = (
        F.when(F.col("_in").isNull(), "not_in_table").when(F.col("scan_path").isNull(), "in_table_not_data").otherwise("in_table_and_data")
    )
    return j.select("dataset", "field", F.coalesce("scan_path", F.lit("")).alias("scan_path"), F.coalesce("entity", F.lit("")).alias("entity"), status.alias("status"))


def status_rank(status: Column) -> Column:
    return F.when(status == "in_table_and_data", 0).when(status == "in_table_not_data", 1).otherwise(2)


def presence_summary(p: DataFrame) -> DataFrame:
    """Counts per dataset with both balance checks."""
    n = lambda s: F.count_if(F.col("status") == s)
    return p.groupBy("dataset").agg(
        n("in_table_and_data").alias("in_table_and_data"), n("in_table_not_data").alias("in_table_not_data"), n("not_in_table").alias("not_in_table"),
        F.count_if(F.col("status") != "not_in_table").alias("n_mapping_fields"), F.count_if(F.col("status") != "in_table_not_data").alias("n_scanned_fields"),
    ).withColumn(
        "balanced",
        (F.col("in_table_and_data") + F.col("in_table_not_data") == F.col("n_mapping_fields"))
        & (F.col("in_table_and_data") + F.col("not_in_table") == F.col("n_scanned_fields")),
    )


def census(p: DataFrame, order: DataFrame, status: str) -> DataFrame:
    """Datasets holding each path, in registry order; ``order`` has (dataset, ord)."""
    total = order.agg(F.count(F.lit(1)).alias("n_datasets_total"))
    hit = p.where(F.col("status") == status).join(order, "dataset")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", "dataset"))), lambda x: x["dataset"])
    return hit.groupBy("field").agg(F.count(F.lit(1)).alias("n_datasets_present"), F.array_join(listed, ",").alias("present_datasets")).join(total)


def field_texts(fields: DataFrame, templates: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Semantic text of a field: path, description by entity or by leaf (first in file order), template.

    ``dictionary`` has (entity, field, description, ord); a field without a
    template fails the job.
    """
    from ..functions.text import entity

    named = fields.select("field_path", entity(F.col("field_path")).alias("entity"), leaf(F.col("field_path")).alias("field"))
    described = dictionary.where(F.coalesce("description", F.lit("")) != "")
    exact = described.groupBy("entity", "field").agg(F.max_by("description", "ord").alias("_e"))
    loose = described.groupBy("field").agg(F.min_by("description", "ord").alias("_l"))
    j = named.join(exact, ["entity", "field"], "left").join(loose, "field", "left").join(templates, "field_path", "left")
    template = F.coalesce("template", F.raise_error(F.concat(F.lit("no template for "), F.col("field_path"))).cast("string"))
    return j.select("field_path", F.concat(
        F.lit("Field path: "), "field_path", F.lit(". GDC field description: "), F.coalesce("_e", "_l", F.lit("")), F.lit(" Field Bank template: "), template
    ).alias("text"))


def refreshed_templates(fields: DataFrame, old: DataFrame, spec: DataFrame, examples: DataFrame) -> DataFrame:
    """Template table for the kept fields: edits stay, blanks come from the spec, examples are renewed."""
    blank = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    o = old.select("field", *[F.col(c).alias(f"o_{c}") for c in ("example", "convert", "unit", "template")])
    s = spec.select("field", *[F.col(c).alias(f"s_{c}") for c in ("convert", "unit", "template")])
    j = fields.select("field").distinct().join(o, "field", "left").join(s, "field", "left").join(examples, "field", "left")
    kept = [F.coalesce(blank(f"o_{c}"), F.col(f"s_{c}"), F.lit("")).alias(c) for c in ("convert", "unit", "template")]
    return j.select("field", F.coalesce(blank("example"), F.col("o_example"), F.lit("")).alias("example"), *kept)
