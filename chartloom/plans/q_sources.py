"""Queries on documents, dictionaries, presence and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.paths import path_values
from ..operators import scan
from ..sources import cases as case_source
from ..sources import sinks, tables
from . import oracle_base as ob
from .clinical import Clinic
from .q_compare import scores
from .registry import query

# one document per order: its customer is the case, so ids repeat across files
ob.cte("x_doc", """
SELECT 'DS' || (o_custkey % 5) AS dataset, o_orderkey % 3 AS file_ord, o_orderkey AS pos, CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'P' || o_custkey END AS id, 'PR' || (o_custkey % 4) AS project,
 CASE WHEN o_orderkey % 4 <> 0 THEN o_orderpriority END AS race, 'G' || (o_orderkey % 4) AS grade, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderkey % 900 END AS day, o_orderstatus AS kind, o_orderkey, o_orderkey % 5 AS m FROM orders
""")


def documents(c: Clinic):
    k = F.col("o_orderkey")
    txt = lambda x: x.cast("string")
    second = F.struct(F.lit("G9").alias("tumor_grade"), F.lit(None).cast("long").alias("days_to_diagnosis"), F.lit(None).cast("array<struct<treatment_type:string,n:bigint>>").alias("treatments"))
    first = F.struct(
        F.concat(F.lit("G"), txt(k % 4)).alias("tumor_grade"), F.when(k % 3 != 0, k % 900).alias("days_to_diagnosis"),
        F.array(F.struct(F.col("o_orderstatus").alias("treatment_type"), (k % 7).alias("n")), F.struct(F.lit(None).cast("string").alias("treatment_type"), F.lit(1).cast("long").alias("n"))).alias("treatments"),
    )
    doc = F.to_json(F.struct(
        F.when(k % 31 == 0, " ").otherwise(F.concat(F.lit("P"), txt(F.col("o_custkey")))).alias("submitter_id"),
        F.struct(F.concat(F.lit("PR"), txt(F.col("o_custkey") % 4)).alias("project_id")).alias("project"),
        F.struct(F.when(k % 4 != 0, F.col("o_orderpriority")).alias("race"), F.lit("Alive").alias("vital_status")).alias("demographic"),
        F.when(k % 5 == 0, F.array(first, second)).otherwise(F.array(first)).alias("diagnoses"), F.array().cast("array<string>").alias("exposures"),
    ))
    return c.tables.read("orders").select(
        F.concat(F.lit("DS"), txt(F.col("o_custkey") % 5)).alias("dataset"), (k % 3).alias("file_ord"), k.alias("pos"), F.parse_json(doc).alias("doc")
    )


_PROJECTS = [("DS0", "PR0"), ("DS0", "PR1"), ("DS1", "PR2")]
_OTHER = "((dataset = 'DS0' AND project NOT IN ('PR0', 'PR1')) OR (dataset = 'DS1' AND project <> 'PR2'))"


@query("s1_load_cases", f"""
SELECT dataset, id AS submitter_id, file_ord, pos, grade FROM (SELECT *, row_number() OVER (PARTITION BY dataset, id ORDER BY file_ord, pos) AS r FROM x_doc WHERE id <> '' AND NOT {_OTHER}) WHERE r = 1
""")
def s1_load_cases(c: Clinic):
    """S1 first-wins load, S2 project filter, W4 first per key."""
    projects = c.spark.createDataFrame(_PROJECTS, "dataset string, project_id string")
    loaded = case_source.load_cases(documents(c), projects)
    return loaded.select("dataset", "submitter_id", "file_ord", "pos", F.try_variant_get("doc", F.lit("$.diagnoses[0].tumor_grade"), "string").alias("grade"))


@query("s1_array_files", """
SELECT dataset, row_number() OVER (PARTITION BY dataset ORDER BY pos) - 1 AS pos, CASE WHEN id = '' THEN ' ' ELSE id END AS submitter_id, grade, len(string_split(grade, 'G')) AS n FROM x_doc
""")
def s1_array_files(c: Clinic):
    """S1, S3: the documents written as one JSON array a dataset, registered and read again in splits."""
    from ..scale import checkpointed, new_folder, ordered_columns

    # a number as folder: for a text the writer would sort again, by the folder alone
    d = documents(c).select(F.substring("dataset", 3, 9).cast("int").alias("dataset"), "pos", F.to_json("doc").alias("j"))
    placed = ordered_columns(d, ["dataset"], ["pos"], {"r": ("row",)}, c.tables.rows("orders"))
    line = F.concat(F.when(F.col("r") == 1, "[").otherwise(","), "j")
    ends = d.select("dataset").distinct().select("dataset", F.lit(None).cast("long").alias("r"), F.lit("]").alias("line"))
    folder = new_folder(c.spark)
    # written first: a union of parts that are dealt by dataset may keep them apart
    checkpointed(placed.select("dataset", "r", line.alias("line")).unionByName(ends)).repartition("dataset").sortWithinPartitions(
        "dataset", F.asc_nulls_last("r")
    ).select("dataset", "line").write.partitionBy("dataset").text(folder)
    registry = case_source.Registry({f"DS{i}": {"clinic_files": [f"{folder}/dataset={i}"]} for i in range(5)})
    read = case_source.read_cases(c.spark, registry)
    grade = F.try_variant_get("doc", F.lit("$.diagnoses[0].tumor_grade"), "string").alias("grade")
    return read.select("dataset", "pos", F.try_variant_get("doc", F.lit("$.submitter_id"), "string").alias("submitter_id"), grade, F.size(F.split(grade, "G")).cast("long").alias("n"))


@query("s1_load_report", f"""
SELECT dataset, fate, count(*) AS n FROM (SELECT dataset, CASE WHEN id = '' THEN 'blank_id' WHEN {_OTHER} THEN 'other_project' WHEN row_number() OVER (PARTITION BY dataset, id, {_OTHER} ORDER BY file_ord, pos) = 1 THEN 'kept' ELSE 'duplicate' END AS fate FROM x_doc) GROUP BY ALL
""")
def s1_load_report(c: Clinic):
    projects = c.spark.createDataFrame(_PROJECTS, "dataset string, project_id string")
    return case_source.with_fate(documents(c), projects).groupBy("dataset", "fate").agg(F.count(F.lit(1)).alias("n"))


ob.cte("x_loaded", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dataset, id ORDER BY file_ord, pos) AS r FROM x_doc WHERE id <> '') WHERE r = 1")


@query("s1_shredded_diagnoses", """
SELECT dataset, id AS patient_id, 0 AS dx_pos, grade AS tumor_grade, CAST(day AS DOUBLE) AS days_to_diagnosis FROM x_loaded UNION ALL SELECT dataset, id, 1, 'G9', NULL FROM x_loaded WHERE m = 0
""")
def s1_shredded_diagnoses(c: Clinic):
    f = case_source.shred(case_source.load_cases(documents(c)))
    return f.diagnoses.select("dataset", "patient_id", "dx_pos", "tumor_grade", "days_to_diagnosis")


_PATHS = ["demographic.race", "diagnoses[].tumor_grade", "diagnoses[].days_to_diagnosis", "diagnoses[].treatments[].treatment_type", "diagnoses[].treatments[].n", "exposures", "exposures[].x"]


@query("p2_path_values", """
SELECT pos, 'demographic.race' AS field_path, race AS value, 'string' AS kind FROM x_doc WHERE race IS NOT NULL UNION ALL SELECT pos, 'diagnoses[].tumor_grade', grade, 'string' FROM x_doc UNION ALL SELECT pos, 'diagnoses[].tumor_grade', 'G9', 'string' FROM x_doc WHERE m = 0
UNION ALL SELECT pos, 'diagnoses[].days_to_diagnosis', CAST(day AS VARCHAR), 'number' FROM x_doc WHERE day IS NOT NULL UNION ALL SELECT pos, 'diagnoses[].treatments[].treatment_type', kind, 'string' FROM x_doc
UNION ALL SELECT pos, 'diagnoses[].treatments[].n', CAST(pos % 7 AS VARCHAR), 'number' FROM x_doc UNION ALL SELECT pos, 'diagnoses[].treatments[].n', '1', 'number' FROM x_doc UNION ALL SELECT pos, 'exposures', '[]', 'array' FROM x_doc
""")
def p2_path_values(c: Clinic):
    """P1 parsed paths and P2 multi-valued walks over documents."""
    return path_values(documents(c), _PATHS, keep=["pos"]).select("pos", "field_path", "value", "kind")


@query("a1_key_scan", """
SELECT DISTINCT dataset, p AS prefix, k AS key FROM (SELECT dataset, unnest(['', '', '', '', '', 'project', 'demographic', 'diagnoses[]', 'diagnoses[]', 'diagnoses[].treatments[]']) AS p, unnest(['submitter_id', 'project', 'demographic', 'diagnoses', 'exposures', 'project_id', 'vital_status', 'tumor_grade', 'treatments', 'n']) AS k FROM x_doc
 UNION ALL SELECT dataset, 'demographic', 'race' FROM x_doc WHERE race IS NOT NULL UNION ALL SELECT dataset, 'diagnoses[]', 'days_to_diagnosis' FROM x_doc WHERE day IS NOT NULL UNION ALL SELECT dataset, 'diagnoses[].treatments[]', 'treatment_type' FROM x_doc)
""")
def a1_key_scan(c: Clinic):
    return scan.scan_keys(documents(c), 4)


@query("a2_field_dictionary", """
WITH k AS (SELECT DISTINCT dataset, unnest(['', '', '', '', '', 'project', 'demographic', 'demographic', 'diagnoses[]', 'diagnoses[]', 'diagnoses[]', 'diagnoses[].treatments[]', 'diagnoses[].treatments[]']) AS prefix,
 unnest(['submitter_id', 'project', 'demographic', 'diagnoses', 'exposures', 'project_id', 'vital_status', 'race', 'tumor_grade', 'treatments', 'days_to_diagnosis', 'n', 'treatment_type']) AS key FROM x_doc),
l AS (SELECT * FROM (VALUES ('demographic', 'vital_status', 'Vital', 2), ('diagnoses[]', 'tumor_grade', 'Grade', 1), ('exposures[]', 'n', 'Count', 3)) t(prefix, key, label, ord))
SELECT k.dataset, k.prefix, CASE WHEN k.prefix = '' THEN k.key ELSE k.prefix || '.' || k.key END AS field_path, k.key AS field_name,
 CASE WHEN l.label IS NOT NULL THEN l.label WHEN k.key = 'submitter_id' THEN 'identifier given by the submitter' WHEN k.key = 'n' THEN 'Count' WHEN k.key LIKE '%\\_id' ESCAPE '\\' THEN 'identifier' ELSE 'no description' END AS label,
 row_number() OVER (PARTITION BY k.dataset, k.prefix ORDER BY l.ord NULLS LAST, k.key) AS place FROM k LEFT JOIN l ON l.prefix = k.prefix AND l.key = k.key
""")
def a2_field_dictionary(c: Clinic):
    """A2 assembly and J2 label lookup."""
    labels = c.spark.createDataFrame([("demographic", "vital_status", "Vital", 2), ("diagnoses[]", "tumor_grade", "Grade", 1), ("exposures[]", "n", "Count", 3)], "prefix string, field string, label string, ord int")
    return scan.field_dictionary(scan.scan_keys(documents(c), 4), labels)


ob.cte("x_seen", "SELECT dataset, 'diagnoses[].' || replace(field, '.', '_') AS path, 'diagnoses.' || replace(field, '.', '_') AS field, k FROM x_fs WHERE k % 3 <> 0")
ob.cte("x_map", "SELECT DISTINCT 'diagnoses.' || replace(field, '.', '_') AS field, 'diagnosis' AS entity FROM x_fs WHERE field NOT LIKE '%f3'")
ob.cte("x_pres", """
SELECT coalesce(o.dataset, s.dataset) AS dataset, coalesce(o.field, s.field) AS field, coalesce(s.path, '') AS scan_path, coalesce(o.entity, '') AS entity, CASE WHEN o.field IS NULL THEN 'not_in_table' WHEN s.field IS NULL THEN 'in_table_not_data' ELSE 'in_table_and_data' END AS status
FROM (SELECT d.dataset, m.* FROM (SELECT DISTINCT dataset FROM x_fs) d, x_map m) o FULL JOIN x_seen s ON s.dataset = o.dataset AND s.field = o.field
""")


def presence(c: Clinic):
    s = scores(c)
    name = F.replace("field", F.lit("."), F.lit("_"))
    seen = s.where(F.col("k") % 3 != 0).select("dataset", F.concat(F.lit("diagnoses[]."), name).alias("field_path"))
    mapping = s.where(~F.col("field").endswith("f3")).select(F.concat(F.lit("diagnoses."), name).alias("field"), F.lit("diagnosis").alias("entity")).distinct()
    return scan.presence(seen, tables.checked_mapping(mapping), s.select("dataset").distinct())


@query("j4_presence", "SELECT * FROM x_pres")
def j4_presence(c: Clinic):
    """J4 presence with S8 mapping guard."""
    return presence(c)


@query("j4_presence_summary", """
SELECT dataset, count_if(status='in_table_and_data') AS in_table_and_data, count_if(status='in_table_not_data') AS in_table_not_data, count_if(status='not_in_table') AS not_in_table, count_if(status<>'not_in_table') AS n_mapping_fields, count_if(status<>'in_table_not_data') AS n_scanned_fields, true AS balanced FROM x_pres GROUP BY 1
""")
def j4_presence_summary(c: Clinic):
    return scan.presence_summary(presence(c))


@query("t3_presence_order", "SELECT dataset, field, row_number() OVER (PARTITION BY dataset ORDER BY CASE status WHEN 'in_table_and_data' THEN 0 WHEN 'in_table_not_data' THEN 1 ELSE 2 END, field) AS place FROM x_pres")
def t3_presence_order(c: Clinic):
    from pyspark.sql import Window

    w = Window.partitionBy("dataset").orderBy(scan.status_rank(F.col("status")), "field")
    return presence(c).select("dataset", "field", F.row_number().over(w).cast("long").alias("place"))


@query("a10_mapping_census", """
SELECT field, count(*) AS n_datasets_present, string_agg(dataset, ',' ORDER BY CAST(substr(dataset, 7) AS INTEGER)) AS present_datasets, (SELECT count(DISTINCT dataset) FROM x_fs) AS n_datasets_total FROM x_pres WHERE status = 'in_table_and_data' GROUP BY 1
""")
def a10_mapping_census(c: Clinic):
    order = scores(c).select("dataset", F.substring("dataset", 7, 9).cast("int").alias("ord")).distinct()
    return scan.census(presence(c), order, "in_table_and_data")


@query("j3_field_texts", """
SELECT DISTINCT 'diagnoses[].' || field AS field_path, 'Field path: diagnoses[].' || field || '. GDC field description: ' || CASE WHEN field LIKE '%f1' THEN 'one' WHEN field LIKE '%f2' THEN 'two' ELSE '' END || ' Field Bank template: ' || field || ' is {}.' AS text FROM x_fs
""")
def j3_field_texts(c: Clinic):
    s = scores(c).select(F.concat(F.lit("diagnoses[]."), "field").alias("field_path"), F.concat("field", F.lit(" is {}.")).alias("template")).distinct()
    d = c.spark.createDataFrame([("diagnosis", "f1", "one", 1), ("treatment", "f2", "two", 2), ("exposure", "f2", "other", 3), ("diagnosis", "f0", "", 4)], "entity string, field string, description string, ord int")
    return scan.field_texts(s, s, d)


@query("e12_refreshed_templates", """
SELECT DISTINCT field, 'x' || field AS example, CASE WHEN field LIKE '%f2' THEN 'days_abs' ELSE 'int' END AS convert, '' AS unit, CASE WHEN field LIKE '%f2' THEN 'Edited {}.' ELSE field || ' is {}.' END AS template FROM x_fs
""")
def e12_refreshed_templates(c: Clinic):
    """E12 refreshed template table and P27 fill precedence."""
    s = scores(c).select("field").distinct()
    edited = F.col("field").endswith("f2")
    old = s.select("field", F.lit("old").alias("example"), F.when(edited, "days_abs").otherwise(" ").alias("convert"), F.lit("").alias("unit"), F.when(edited, "Edited {}.").otherwise("").alias("template"))
    spec = s.select("field", F.lit("int").alias("convert"), F.lit("").alias("unit"), F.concat("field", F.lit(" is {}.")).alias("template"))
    return scan.refreshed_templates(s, old, spec, s.select("field", F.concat(F.lit("x"), "field").alias("example")))


# ---- dictionaries and tab files ------------------------------------------------
@query("s6_flatten_dictionary", r"""
SELECT 'treatment' AS entity, lower(p_type) || '_' || p_partkey AS field, CASE p_size % 5 WHEN 0 THEN 'enum' WHEN 1 THEN 'integer|null' WHEN 2 THEN 'enum|number' WHEN 3 THEN 'array[string]' ELSE '#/defs/x' END AS type, CASE WHEN p_size % 2 = 0 THEN 'yes' ELSE 'no' END AS required, p_name AS description,
 CASE p_size % 5 WHEN 0 THEN 'a | b' WHEN 2 THEN 'c | d' ELSE '' END AS enum, CASE p_size % 5 WHEN 0 THEN 2 WHEN 2 THEN 2 ELSE 0 END AS n_enum FROM part
""")
def s6_flatten_dictionary(c: Clinic):
    """One schema document per part, so the work grows with the table; some hold enums five schemas deep."""
    s = F.col("p_size")
    name = F.concat(F.lower("p_type"), F.lit("_"), F.col("p_partkey").cast("string"))
    body = (
        F.when(s % 5 == 0, '"enum":["a","b","a"]').when(s % 5 == 1, '"type":["integer","null"]').when(s % 5 == 2, '"oneOf":[{"anyOf":[{"oneOf":[{"anyOf":[{"oneOf":[{"enum":["c","d"]}]}]}]}]},{"type":"number"}]')
        .when(s % 5 == 3, '"type":"array","items":{"type":"string"}').otherwise('"$ref":"#/defs/x"')
    )
    need = F.when(s % 2 == 0, F.concat(F.lit('["'), name, F.lit('"]'))).otherwise("[]")
    doc = F.concat(F.lit('{"category":"clinical","required":'), need, F.lit(',"properties":{"'), name, F.lit('":{"description":"'), F.col("p_name"), F.lit('",'), body, F.lit("}}}"))
    return tables.flatten_dictionary(c.tables.read("part").select(F.lit("treatment").alias("entity"), F.parse_json(doc).alias("schema")))


@query("s7_flatten_mapping", """
SELECT f AS field, CASE p_size % 3 WHEN 0 THEN 'treatment' WHEN 1 THEN 'demographic' ELSE 'case' END AS entity, CASE WHEN p_size % 2 = 0 THEN 'keyword' ELSE '' END AS type, CASE WHEN p_size % 2 = 0 THEN p_name ELSE '' END AS description, CASE WHEN p_size % 3 = 2 THEN 'no' ELSE 'yes' END AS in_clinical_json
FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'diagnoses.treatments.t' || p_partkey WHEN 1 THEN 'demographic.d' || p_partkey ELSE 'x' || p_partkey END AS f FROM part)
""")
def s7_flatten_mapping(c: Clinic):
    s, key = F.col("p_size"), F.col("p_partkey").cast("string")
    f = F.when(s % 3 == 0, F.concat(F.lit("diagnoses.treatments.t"), key)).when(s % 3 == 1, F.concat(F.lit("demographic.d"), key)).otherwise(F.concat(F.lit("x"), key))
    info = F.when(s % 2 == 0, F.concat(F.lit('"'), f, F.lit('":{"type":"keyword","description":"'), F.col("p_name"), F.lit('"}'))).otherwise("")
    doc = F.concat(F.lit('{"fields":["'), f, F.lit('"],"_mapping":{'), info, F.lit("}}"))
    return tables.flatten_mapping(c.tables.read("part").select(F.parse_json(doc).alias("doc")), clinical_only=False)


@query("s4_tab_rows", """
SELECT CAST(p_partkey AS VARCHAR) AS part, p_type AS kind, CASE WHEN p_size % 2 = 0 THEN CAST(p_size AS VARCHAR) END AS size, CASE WHEN p_size % 2 = 1 THEN p_name END AS name FROM part
UNION ALL SELECT DISTINCT 'part', 'kind', CASE WHEN p_size % 2 = 0 THEN 'size' END, CASE WHEN p_size % 2 = 1 THEN 'name' END FROM part
""")
def s4_tab_rows(c: Clinic):
    """Parts written as two tab files, of one and of three header lines and with other columns; a data row equals the header."""
    from ..scale import checkpointed, new_folder
    from ..sources import files

    p = c.tables.read("part").select((F.col("p_size") % 2).alias("f"), F.col("p_partkey").cast("string").alias("k"), "p_type", "p_name", F.col("p_size").cast("string").alias("size"))
    odd = F.col("f") == 1
    row = F.when(odd, F.concat_ws("\t", "p_type", "k", "p_name")).otherwise(F.concat_ws("\t", "k", "p_type", "size"))
    kinds = p.select("f").distinct()
    head = F.when(odd, "kind\tpart\tname").otherwise("part\tkind\tsize")
    heads = [kinds.select("f", F.lit(0).alias("r"), head.alias("line")), kinds.select("f", F.lit(3).alias("r"), head.alias("line"))]
    more = [kinds.where("f = 0").select("f", F.lit(i + 1).alias("r"), F.lit(t).alias("line")) for i, t in enumerate(["Part\tKind\tSize", "CDE_ID:1\tCDE_ID:2\tCDE_ID:3"])]
    lines = p.select("f", F.lit(4).alias("r"), row.alias("line"))
    for x in [*heads, *more]:
        lines = lines.unionByName(x)
    folder = new_folder(c.spark)
    checkpointed(lines).repartition("f").sortWithinPartitions("f", "r").select("f", "line").write.partitionBy("f").text(folder)
    return files.tab_rows(c.spark, [f"{folder}/f=0", f"{folder}/f=1"]).select("part", "kind", "size", "name")


@query("s5_tab_inventory", r"""
SELECT 'nationwidechildrens.org_' || source || '.txt' AS file, source AS "table", len(string_split(any_value(h), E'\t')) AS n_columns, count(*) - 1 AS n_rows, replace(any_value(h), E'\t', ';') AS columns
FROM (SELECT source, doc_id, first_value(doc_id || E'\tb') OVER (PARTITION BY source ORDER BY doc_id) AS h FROM documents) GROUP BY source
""")
def s5_tab_inventory(c: Clinic):
    """Documents of a source as the lines of its file, numbered in id order."""
    from ..scale import ordered_columns

    d = c.tables.read("documents").select("source", "doc_id")
    lines = ordered_columns(d, ["source"], ["doc_id"], {"r": ("row",)}, c.tables.rows("documents")).select(
        F.concat(F.lit("nationwidechildrens.org_"), "source", F.lit(".txt")).alias("file"), (F.col("r") - 1).alias("line_no"), F.concat(F.col("doc_id").cast("string"), F.lit("\tb")).alias("line"))
    return tables.tab_inventory(lines)


@query("s9_label_table", "SELECT 'C' || c_custkey AS case_id, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE round(c_acctbal, 2) END AS survival_months, CAST(c_custkey % 2 AS INTEGER) AS censorship FROM customer")
def s9_label_table(c: Clinic):
    k = F.col("c_custkey")
    raw = c.tables.read("customer").select(
        F.concat(F.lit("C"), k.cast("string")).alias("Case_ID"), F.when(k % 5 == 0, "n/a").otherwise(F.round("c_acctbal", 2).cast("string")).alias("SURVIVAL_MONTHS"), (k % 2).cast("string").alias("Censorship"))
    return tables.label_table(raw)


@query("s10_split_table", """
SELECT CAST(c_custkey % 5 AS INTEGER) AS fold, part, case_id FROM (SELECT c_custkey, unnest(['train', 'val', 'test']) AS part, unnest(['A' || c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'B' || c_custkey END, CASE WHEN c_custkey % 3 = 0 THEN 'D' || c_custkey ELSE '' END]) AS case_id FROM customer) WHERE case_id <> ''
""")
def s10_split_table(c: Clinic):
    k, t = F.col("c_custkey"), F.col("c_custkey").cast("string")
    wide = c.tables.read("customer").select(
        F.concat(F.lit("splits_"), (k % 5).cast("string"), F.lit(".csv")).alias("file"), F.concat(F.lit("A"), t).alias("train"),
        F.when(k % 2 == 0, F.concat(F.lit("B"), t)).alias("val"), F.when(k % 3 == 0, F.concat(F.lit("D"), t)).otherwise("").alias("test"))
    return tables.split_table(wide)


# ---- maintenance ----------------------------------------------------------------
def _old_new(c: Clinic):
    p = c.tables.read("part").select(F.col("p_brand").alias("dataset"), F.col("p_partkey").alias("k"), F.col("p_size").cast("long").alias("v"))
    return p.where("k % 3 <> 0"), p.where("k % 3 <> 1").withColumn("v", F.col("v") + 100)


@query("s12_upsert", "SELECT p_brand AS dataset, p_partkey AS k, CASE WHEN p_partkey % 3 <> 1 THEN p_size + 100 ELSE p_size END AS v FROM part")
def s12_upsert(c: Clinic):
    """S12 upsert by key, S13 keyed mapping upsert, X1 union by name."""
    old, new = _old_new(c)
    return sinks.upsert(old, new, ["k"])


@query("s14_merged_rows", "SELECT p_brand AS dataset, p_partkey AS k, CASE WHEN p_partkey % 3 <> 1 THEN p_size + 100 ELSE p_size END AS v, CASE p_partkey % 3 WHEN 1 THEN 'kept' WHEN 0 THEN 'appended' ELSE 'replaced' END AS change FROM part")
def s14_merged_rows(c: Clinic):
    old, new = _old_new(c)
    return sinks.merged(old, new, ["dataset", "k"])


@query("s15_first_written", "SELECT p_brand AS dataset, p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_size + 100 ELSE p_size END AS v FROM part")
def s15_first_written(c: Clinic):
    old, new = _old_new(c)
    return sinks.first_written(old, new, ["dataset", "k"])


@query("s16_missing_parts", "SELECT DISTINCT p_brand AS dataset, p_size AS tag FROM part WHERE (p_brand, p_size) NOT IN (SELECT p_brand, p_size FROM part WHERE p_partkey % 3 <> 0)")
def s16_missing_parts(c: Clinic):
    p = c.tables.read("part").select(F.col("p_brand").alias("dataset"), F.col("p_size").alias("tag"), "p_partkey")
    return sinks.missing_parts(p.select("dataset", "tag").distinct(), p.where("p_partkey % 3 <> 0"), ["dataset", "tag"])


@query("s18_stale_banks", "SELECT p_partkey AS bank, left(sha256(p_name), 16) AS template_fp, left(sha256(p_type || ',' || p_brand), 16) AS fields_fp FROM part WHERE p_partkey % 4 = 0 OR p_size % 5 = 0")
def s18_stale_banks(c: Clinic):
    fp = [sinks.fingerprint(F.col("p_name")).alias("template_fp"), sinks.fields_fingerprint(F.array("p_type", "p_brand")).alias("fields_fp")]
    planned = c.tables.read("part").select(F.col("p_partkey").alias("bank"), *fp, "p_size")
    old = planned.where("bank % 4 <> 0").withColumn("template_fp", F.when(F.col("p_size") % 5 == 0, "stale").otherwise(F.col("template_fp")))
    return sinks.stale_banks(planned.drop("p_size"), old, ["bank"])


@query("s18_written_banks", """
SELECT p_partkey AS bank, CASE WHEN p_partkey % 4 = 1 THEN 'moved' ELSE p_brand END AS dataset, left(sha256(CASE WHEN p_partkey % 3 = 0 THEN p_name || '!' ELSE p_name END), 16) AS template_fp, left(sha256(p_type || ',' || p_brand), 16) AS fields_fp,
 CASE WHEN p_partkey % 3 = 0 OR p_partkey % 5 = 0 THEN 2 WHEN p_partkey % 4 = 1 THEN 3 ELSE 1 END AS written FROM part
""")
def s18_written_banks(c: Clinic):
    """S12, S18: banks written, the stale and new ones built again, then some moved to another partition."""
    from ..scale import new_folder

    p = c.tables.read("part")
    name = lambda last: F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, last).otherwise(""))
    planned = lambda last: p.select(
        F.col("p_partkey").alias("bank"), F.col("p_brand").alias("dataset"), sinks.fingerprint(name(last)).alias("template_fp"),
        sinks.fields_fingerprint(F.array("p_type", "p_brand")).alias("fields_fp"))
    path = new_folder(c.spark)
    for turn, plan in ((1, planned("").where("bank % 5 <> 0")), (2, planned("!"))):
        sinks.write_banks(c.spark, path, plan, lambda stale: stale.withColumn("written", F.lit(turn)), ["bank"], "dataset")
    again = planned("!").where("bank % 4 = 1").withColumn("dataset", F.lit("moved"))
    kept = sinks.read_keyed(c.spark, path).select("bank", F.greatest("written", F.when(F.col("written") == 1, 3)).alias("written"))
    sinks.replace_keys(c.spark, path, again.join(kept, "bank"), ["bank"], "dataset")
    return sinks.read_keyed(c.spark, path).select("bank", "dataset", "template_fp", "fields_fp", "written")


@query("s19_pruned_outputs", "SELECT p_brand AS dataset, CASE WHEN p_size % 4 = 0 THEN 'G1_' || left(md5(p_name), 10) ELSE p_type END AS scheme, p_partkey FROM part WHERE p_size % 4 = 0 OR p_type <> 'PROMO'")
def s19_pruned_outputs(c: Clinic):
    p = c.tables.read("part").select(
        F.col("p_brand").alias("dataset"), F.when(F.col("p_size") % 4 == 0, F.concat(F.lit("G1_"), F.substring(F.md5("p_name"), 1, 10))).otherwise(F.col("p_type")).alias("scheme"), "p_partkey")
    plan = c.tables.read("part").where("p_type <> 'PROMO'").select(F.col("p_brand").alias("dataset"), F.col("p_type").alias("scheme")).distinct()
    return sinks.pruned(p, plan, ["dataset", "scheme"])
