"""Queries on alias, scheme and spec files."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extract
from ..scale import new_folder
from ..sources import settings
from .clinical import Clinic
from .q_compare import scores
from .registry import query


@query("u4_alias_rules", """
SELECT p_partkey, p_type AS field_path, CASE WHEN p_partkey % 3 = 0 THEN 'C' || p_partkey WHEN p_partkey % 3 = 1 THEN '' ELSE 'NAME   ' || p_partkey END AS value FROM part
""")
def u4_alias_rules(c: Clinic):
    """Alias files with the names of up to 1,000 parts each; keys with capitals never apply, an empty canonical empties the value."""
    k = F.col("p_partkey").cast("string")
    p = c.tables.read("part").select("p_type", "p_partkey", k.alias("k"))
    key = F.when(F.col("p_partkey") % 3 == 2, F.concat(F.lit("Name "), "k")).otherwise(F.concat(F.lit("name "), "k"))
    canonical = F.when(F.col("p_partkey") % 3 == 1, "").otherwise(F.concat(F.lit("C"), "k"))
    maps = p.groupBy("p_type", F.floor(F.col("p_partkey") / 1000).alias("file")).agg(
        F.map_from_entries(F.collect_list(F.struct(key, canonical))).alias("map")
    )
    rule = F.create_map("p_type", F.struct("map", F.lit("names of parts").alias("note")))
    texts = maps.select(F.to_json(F.struct(F.lit(1).alias("version"), rule.alias("aliases"))).alias("text"))
    values = p.select("p_partkey", F.col("p_type").alias("field_path"), F.concat(F.lit("  NAME   "), "k", F.lit(" ")).alias("value"))
    return extract.aliased(values, settings.alias_rules(texts)).select("p_partkey", "field_path", "value")


_SCHEMES = """
WITH s AS (SELECT dataset, min(k) AS k FROM x_fs GROUP BY 1), d AS (SELECT dataset, CASE WHEN k % 2 = 0 THEN 'TCGA-' || dataset ELSE dataset END AS name FROM s),
b AS (SELECT 'S' || s.dataset AS scheme, d.name AS dataset FROM s JOIN d ON CASE s.k % 4 WHEN 0 THEN true WHEN 1 THEN d.name LIKE 'TCGA-%' WHEN 2 THEN d.dataset = s.dataset ELSE false END)
"""


@query("u3_scheme_datasets", f"{_SCHEMES} SELECT scheme, dataset FROM b")
def u3_scheme_datasets(c: Clinic):
    """Schemes that are free, bound to all TCGA datasets, to an alias and to nothing, over registered datasets."""
    texts, datasets, aliases = scheme_texts(c)
    return settings.scheme_datasets(settings.listed_schemes(texts), datasets, aliases)


@query("u3_scheme_fields", "SELECT 'S' || dataset AS scheme, row_number() OVER (PARTITION BY dataset ORDER BY field) - 1 AS ord, field FROM x_fs")
def u3_scheme_fields(c: Clinic):
    fields = settings.scheme_fields(settings.listed_schemes(scheme_texts(c)[0]))
    return fields.withColumn("ord", F.col("ord").cast("long"))


def scheme_texts(c: Clinic):
    """(scheme texts, datasets, aliases): one scheme a dataset with the dataset's fields, a registry list."""
    s = scores(c).groupBy("dataset").agg(F.min("k").alias("k"), F.array_sort(F.collect_set("field")).alias("fields"))
    kind = F.col("k") % 4
    bound = (
        F.when(kind == 1, F.lit('"ALL_TCGA"')).when(kind == 2, F.concat(F.lit('["", " '), "dataset", F.lit(' "]'))).when(kind == 3, F.lit("[]"))
    )
    tail = F.when(bound.isNotNull(), F.concat(F.lit(', "datasets": '), bound)).otherwise("")
    text = F.concat(F.lit('{"source": " GDC", "fields": '), F.to_json("fields"), tail, F.lit("}"))
    texts = s.select(F.concat(F.lit("S"), "dataset").alias("scheme"), text.alias("text"))
    name = F.when(F.col("k") % 2 == 0, F.concat(F.lit("TCGA-"), "dataset")).otherwise(F.col("dataset"))
    named = s.select(F.col("dataset").alias("alias"), name.alias("dataset"))
    return texts, named.select("dataset"), named.where("alias <> dataset")


@query("u5_template_spec", """
SELECT lower(p_type) || '.p' || p_partkey AS field, CASE p_size % 3 WHEN 0 THEN 'days_to_years' WHEN 1 THEN 'INT' ELSE '' END AS convert, CASE WHEN p_size % 2 = 0 THEN 'years' ELSE '' END AS unit,
 'The "' || p_name || '", is' || chr(10) || '{}.' AS template, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_brand END AS note FROM part
""")
def u5_template_spec(c: Clinic):
    """Spec files of a field a part, with quotes, commas and line ends inside cells and words that mean nothing."""
    size = F.col("p_size")
    spec = c.tables.read("part").select(
        F.concat(F.lit(" "), F.lower("p_type"), F.lit(".p"), F.col("p_partkey").cast("string")).alias("field"),
        F.when(size % 3 == 0, "days_to_years").when(size % 3 == 1, "INT").otherwise("None").alias("convert"),
        F.when(size % 2 == 0, " years ").alias("unit"),
        F.concat(F.lit('The "'), "p_name", F.lit('", is\n{}.')).alias("template"),
        F.when(size % 5 == 0, "NaN").otherwise(F.col("p_brand")).alias("note"), "p_size",
    )
    folder = new_folder(c.spark)
    spec.write.csv(folder, header=True, quote='"', escape='"', quoteAll=True)
    return settings.read_spec(c.spark, folder)
