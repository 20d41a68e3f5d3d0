"""Queries on fields: scalars, completeness, information, rules and registry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers, text
from ..functions.missing import cleaned, is_missing_token, text_state
from ..operators import rules, stats
from ..scale import checkpointed
from .clinical import Clinic
from .registry import query

STATS_SQL = """
SELECT dataset, field_path, total, total - valid AS missing, valid, value_kind, unique_count,
 CASE value_kind WHEN 'empty' THEN 'none' WHEN 'numeric' THEN 'variance' ELSE 'entropy_norm' END AS info_metric_type,
 round(metric, 6) AS info_metric_value, coverage, total - valid - sentinel_count AS null_count, sentinel_count,
 round((total - valid - sentinel_count) / CAST(total AS DOUBLE), 6) AS null_rate,
 round(sentinel_count / CAST(total AS DOUBLE), 6) AS sentinel_rate,
 mode_value, round(mode_share, 6) AS mode_share, inferred_type,
 contains(field_path, '[]') AS multi_record, round(multi / CAST(total AS DOUBLE), 6) AS multi_record_rate
FROM x_stats
"""


def whole_stats(c: Clinic):
    return stats.field_stats(c.values, c.dictionary, c.sizes)


@query("a3_field_stats", STATS_SQL)
def a3_field_stats(c: Clinic):
    return whole_stats(c)


@query("p3_value_states", "SELECT dataset, field_path, state, count(*) AS n FROM x_state GROUP BY ALL")
def p3_value_states(c: Clinic):
    return stats.with_state(c.values).groupBy("dataset", "field_path", "state").agg(F.count(F.lit(1)).alias("n"))


@query("a5_entropy_mode", """
SELECT dataset, field_path, n_values, unique_count AS k, mode_value, round(entropy, 6) AS entropy,
 round(CASE WHEN unique_count > 1 THEN entropy / log2(CAST(unique_count AS DOUBLE)) ELSE 0 END, 6) AS entropy_norm,
 round(CAST(top AS DOUBLE) / n_values, 6) AS mode_share FROM x_info
""")
def a5_entropy_mode(c: Clinic):
    info = stats.information(stats.category_counts(stats.patient_values(c.values)))
    return info.select(
        "dataset", "field_path", "n_values", F.col("unique_count").alias("k"), "mode_value",
        F.round(F.col("entropy") + 0.0, 6).alias("entropy"), F.round("entropy_norm", 6).alias("entropy_norm"),
        F.round("mode_share", 6).alias("mode_share"),
    )


@query("a6_population_variance", """
SELECT dataset, field_path, round(avg(number), 6) AS mean, round(var_pop(number), 4) AS variance, round(stddev_pop(number), 6) AS deviation
FROM x_collapsed WHERE n_valid > 0 GROUP BY ALL
""")
def a6_population_variance(c: Clinic):
    counts = checkpointed(stats.category_counts(stats.patient_values(c.values)))
    v = stats.variance(counts, stats.information(counts)).join(
        stats.completeness(counts).select(*stats.FIELD, "valid"), stats.FIELD, "right"
    ).where("valid > 0")
    return v.select(
        "dataset", "field_path", F.round("mean", 6).alias("mean"), F.round("variance", 4).alias("variance"),
        F.round("deviation", 6).alias("deviation"),
    )


@query("a7_type_inference", "SELECT dataset, field_path, unique_count, inferred_type FROM x_stats")
def a7_type_inference(c: Clinic):
    counts = checkpointed(stats.category_counts(stats.patient_values(c.values)))
    info, stage = stats.information(counts), stats.stage_vocabulary(counts)
    joined = c.dictionary.join(info, stats.FIELD, "left").join(stage, stats.FIELD, "left")
    kind = stats.inferred_type(F.col("numeric_share"), F.col("ordinal_stage"), F.col("unique_count"))
    return joined.select(*stats.FIELD, F.coalesce("unique_count", F.lit(0)).alias("unique_count"), kind.alias("inferred_type"))


@query("t5_first_examples", """
SELECT dataset, field_path, string_agg(v, ' | ' ORDER BY patient_id) AS example_values FROM (
 SELECT dataset, field_path, patient_id, collapsed AS v, row_number() OVER (PARTITION BY dataset, field_path ORDER BY patient_id) AS rn
 FROM x_collapsed WHERE n_valid > 0) WHERE rn <= 5 GROUP BY ALL
""")
def t5_first_examples(c: Clinic):
    return stats.first_examples(stats.patient_values(c.values))


@query("t2_stats_order", """
SELECT dataset, field_path, row_number() OVER (ORDER BY dataset, total - valid DESC, field_path) AS position FROM x_stats
""")
def t2_stats_order(c: Clinic):
    """Order of the shared table; one row per (dataset, field), so the closing rank sees a registry-sized table."""
    from pyspark.sql import Window

    s = stats.completeness(stats.category_counts(stats.patient_values(c.values)))
    table = c.dictionary.join(c.sizes, "dataset").join(s, stats.FIELD, "left").withColumn(
        "missing", F.col("n_patients") - F.coalesce("valid", F.lit(0))
    )
    w = Window.orderBy("dataset", F.desc("missing"), "field_path")
    return table.select("dataset", "field_path", F.row_number().over(w).cast("long").alias("position"))


@query("p4_clean_values", """
SELECT dataset, field_path, coalesce(CASE WHEN lower(trim(value)) IN ('', 'not reported', 'unknown', 'not applicable', '--') THEN NULL WHEN field_path LIKE '%days_to%' OR field_path LIKE '%bmi' THEN regexp_replace(trim(value), '[.]0$', '') ELSE trim(value) END, 'not reported') AS value, count(*) AS n
FROM x_values GROUP BY ALL
""")
def p4_clean_values(c: Clinic):
    return c.values.groupBy("dataset", "field_path", cleaned(stats.value_text(F.col("value"), F.col("number"))).alias("value")).agg(F.count(F.lit(1)).alias("n"))


_PART_TEXT = """SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN ' ' || p_size || ' ' WHEN 1 THEN p_size || 'd' WHEN 2 THEN '1_' || (100 + p_size) WHEN 3 THEN p_type || ' ' || (-p_size) || '.5 cm'
 WHEN 4 THEN p_size || 'e2' ELSE p_name END AS t FROM part"""


def _part_text(c: Clinic):
    size = F.col("p_size").cast("string")
    t = (
        F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit(" "), size, F.lit(" ")))
        .when(F.col("p_partkey") % 6 == 1, F.concat(size, F.lit("d")))
        .when(F.col("p_partkey") % 6 == 2, F.concat(F.lit("1_"), (100 + F.col("p_size")).cast("string")))
        .when(F.col("p_partkey") % 6 == 3, F.concat("p_type", F.lit(" "), (-F.col("p_size")).cast("string"), F.lit(".5 cm")))
        .when(F.col("p_partkey") % 6 == 4, F.concat(size, F.lit("e2")))
        .otherwise(F.col("p_name"))
    )
    return c.tables.read("part").select("p_partkey", "p_size", "p_type", "p_brand", "p_name", t.alias("t"))


@query("p6_to_number", f"""
SELECT p_partkey, CASE WHEN regexp_matches(trim(t), '^[+-]?[0-9_]+(\\.[0-9]*)?(e[0-9]+)?$') THEN TRY_CAST(replace(trim(t), '_', '') AS DOUBLE) END AS number FROM ({_PART_TEXT})
""")
def p6_to_number(c: Clinic):
    return _part_text(c).select("p_partkey", numbers.to_number(F.col("t")).alias("number"))


@query("p7_first_number", f"""
SELECT p_partkey, coalesce(CASE WHEN regexp_matches(trim(t), '^[+-]?[0-9_]+(\\.[0-9]*)?(e[0-9]+)?$') THEN TRY_CAST(replace(trim(t), '_', '') AS DOUBLE) END,
 TRY_CAST(regexp_extract(t, '[-+]?[0-9]+(?:\\.[0-9]+)?') AS DOUBLE)) AS number FROM ({_PART_TEXT})
""")
def p7_first_number(c: Clinic):
    return _part_text(c).select("p_partkey", numbers.first_number(F.col("t")).alias("number"))


@query("p8_unit_converters", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, x AS raw,
 CAST(CAST(CASE WHEN x > 365 THEN trunc(x / 365.25::DOUBLE) ELSE trunc(x) END AS BIGINT) AS VARCHAR) AS years,
 CAST(CAST(trunc(x) AS BIGINT) AS VARCHAR) AS whole, CAST(CAST(abs(x) AS BIGINT) AS VARCHAR) AS days
FROM (SELECT *, date_diff('day', TIMESTAMP '1998-01-01', l_shipdate) AS x FROM lineitem)
""")
def p8_unit_converters(c: Clinic):
    li = c.tables.read("lineitem")
    x = F.datediff("l_shipdate", F.lit("1998-01-01").cast("date"))
    t = x.cast("string")
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.cast("long").alias("raw"),
        numbers.convert(t, "days_to_years").alias("years"), numbers.convert(t, "int").alias("whole"),
        numbers.convert(t, "days_abs").alias("days"),
    )


@query("p10_collapsed_values", """
SELECT dataset, field_path, collapsed, n FROM x_counts
""")
def p10_collapsed_values(c: Clinic):
    counts = stats.category_counts(stats.patient_values(c.values))
    return counts.where(F.col("collapsed").isNotNull()).select("dataset", "field_path", "collapsed", "n")


@query("p5_missing_tokens", """
SELECT regexp_replace(lower(trim(t)), '\\s+', ' ', 'g') IN ('', 'stage x', 'tx', 'not reported', 'unknown', 'none', 'na', 'n/a') AS missing, count(*) AS n
FROM (SELECT CASE p_partkey % 5 WHEN 0 THEN '  Not   Reported ' WHEN 1 THEN 'Stage  X' WHEN 2 THEN p_type WHEN 3 THEN ' N/A' ELSE '' END AS t FROM part) GROUP BY 1
""")
def p5_missing_tokens(c: Clinic):
    k = F.col("p_partkey") % 5
    t = F.when(k == 0, "  Not   Reported ").when(k == 1, "Stage  X").when(k == 2, F.col("p_type")).when(k == 3, " N/A").otherwise("")
    return c.tables.read("part").groupBy(is_missing_token(t, ("stage x", "tx")).alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("p11_filled_templates", """
SELECT p_partkey, p_type || ' is ' || p_size || ' of {}.' AS sentence, replace(replace('diagnoses[].' || lower(p_type), '[]', ''), '.', '_') || '_template' AS column_name,
 lower(p_type) AS leaf_name FROM part
""")
def p11_filled_templates(c: Clinic):
    """P11 template fill, P12 output column, P13 leaf names."""
    path = F.concat(F.lit("diagnoses[]."), F.lower("p_type"))
    template = F.concat("p_type", F.lit(" is {} of {}."))
    return c.tables.read("part").select(
        "p_partkey", text.filled_template(template, F.col("p_size").cast("string")).alias("sentence"),
        text.output_column(path).alias("column_name"), text.leaf(path).alias("leaf_name"),
    )


@query("p23_stage_tokens", r"""
SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'stage' WHEN 1 THEN 'PT' WHEN 2 THEN 'G' END AS prefix,
 CASE o_orderkey % 4 WHEN 0 THEN (o_orderkey // 4) % 4 + 1 WHEN 1 THEN o_orderkey % 5 WHEN 2 THEN o_orderkey % 9 END AS num FROM orders
""")
def p23_stage_tokens(c: Clinic):
    key = F.col("o_orderkey")
    roman = F.element_at(F.array(*[F.lit(x) for x in ("I", "IIA", "IIIb", "IV")]), (F.floor(key / 4) % 4 + 1).cast("int"))
    t = (
        F.when(key % 4 == 0, F.concat(F.lit("Stage "), roman))
        .when(key % 4 == 1, F.concat(F.lit("pT"), (key % 5).cast("string"), F.lit("a")))
        .when(key % 4 == 2, F.concat(F.lit("g"), (key % 9).cast("string")))
        .otherwise(F.lit("T1/T2"))
    )
    s = text.stage_token(t)
    return c.tables.read("orders").select("o_orderkey", s["prefix"].alias("prefix"), s["num"].cast("long").alias("num"))


@query("p20_ordinal_codes", """
SELECT p_partkey, 1 + p_size % 4 AS grade, CASE WHEN p_size % 5 = 4 THEN 1 ELSE p_size % 5 + 2 END AS t_code, p_size % 4 + 1 AS n_code,
 CASE WHEN p_size % 3 = 2 THEN 0 ELSE p_size % 3 + 1 END AS m_code, p_size % 4 + 2 AS stage_code, p_size % 6 + 1 AS ecog_code FROM part
""")
def p20_ordinal_codes(c: Clinic):
    s = F.col("p_size")
    txt = lambda n: n.cast("string")
    grade = F.concat(F.lit("unknown, G"), txt(1 + s % 4))
    t = F.when(s % 5 == 4, "Tis, TX").otherwise(F.concat(F.lit("T"), txt(s % 5), F.lit("a")))
    n = F.concat(F.lit("N"), txt(s % 4), F.lit(", N0"))
    m = F.when(s % 3 == 2, "MX").otherwise(F.concat(F.lit("cM"), txt(s % 3)))
    roman = F.element_at(F.array(*[F.lit(x) for x in ("I", "II", "IIIA", "IV")]), (s % 4 + 1).cast("int"))
    codes = {
        "grade": ("diagnoses[].tumor_grade", grade), "t_code": ("diagnoses[].ajcc_pathologic_t", t),
        "n_code": ("diagnoses[].ajcc_pathologic_n", n), "m_code": ("diagnoses[].ajcc_pathologic_m", m),
        "stage_code": ("diagnoses[].ajcc_pathologic_stage", F.concat(F.lit("Stage "), roman)),
        "ecog_code": ("follow_ups[].ecog_performance_status", txt(s % 6)),
    }
    return c.tables.read("part").select(
        "p_partkey", *[text.ordinal_code(f, v).alias(name) for name, (f, v) in codes.items()]
    )


@query("p22_canonical_nominal", """
SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '__MISSING__' WHEN lower(p_type) = lower(p_brand) THEN lower(p_type)
 WHEN lower(p_brand) < lower(p_type) THEN lower(p_brand) || ' | ' || lower(p_type) ELSE lower(p_type) || ' | ' || lower(p_brand) END AS nominal,
 CASE WHEN p_size % 3 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS median_number FROM part
""")
def p22_canonical_nominal(c: Clinic):
    """P21 token numbers and P22 canonical nominal values of comma-joined text."""
    s = F.col("p_size")
    value = F.when(s % 3 == 0, " unknown, TX ,").otherwise(F.concat("p_type", F.lit(" , "), "p_brand", F.lit(",unknown,  "), "p_type"))
    numeric = F.when(s % 3 == 0, "unknown").otherwise(
        F.concat((s - 1).cast("string"), F.lit(" cm, "), (s + 1).cast("string"), F.lit(", not reported"))
    )
    return c.tables.read("part").select(
        "p_partkey", text.canonical_nominal(value).alias("nominal"),
        text.array_median(text.token_numbers(numeric)).alias("median_number"),
    )


@query("p24_type_classes", """
SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'nominal' WHEN 1 THEN 'continuous' WHEN 2 THEN NULL WHEN 3 THEN NULL ELSE 'nominal' END AS class,
 CASE p_size % 4 WHEN 0 THEN 'treatment' WHEN 1 THEN 'demographic' WHEN 2 THEN 'case' ELSE 'other_clinical_attribute' END AS entity FROM part
""")
def p24_type_classes(c: Clinic):
    """P24 dictionary type classes and P25 entity of a path."""
    s = F.col("p_size")
    pick = lambda words, n: F.element_at(F.array(*[F.lit(w) for w in words]), (s % n + 1).cast("int"))
    types = pick(["enum|null", "integer | number|null", "string|null", "null", "boolean|string"], 5)
    paths = pick(["diagnoses[].treatments[].x", "demographic.race", "state", "follow_ups[].other_clinical_attributes[].bmi"], 4)
    return c.tables.read("part").select("p_partkey", text.classified_type(types).alias("class"), text.entity(paths).alias("entity"))


@query("p29_subset_scheme", """
SELECT o_orderkey, 'G3_' || left(md5(list_aggregate(list_transform(list_sort([o_orderkey % 7, o_custkey % 11 + 20, o_orderkey % 5 + 7]), lambda x: CAST(x AS VARCHAR)), 'string_agg', ',')), 10) AS scheme,
 CASE WHEN o_orderkey % 3 = 2 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'work' ELSE 'greedy' END AS kind,
 CASE o_orderkey % 3 WHEN 0 THEN 'raw' WHEN 1 THEN 'lm0' END AS t, CASE WHEN o_orderkey % 3 < 2 THEN 'TCGA-' || o_orderkey END AS dataset FROM orders
""")
def p29_subset_scheme(c: Clinic):
    """P29 subset scheme ids and P30 arm names, built and parsed back."""
    o, key = c.tables.read("orders"), F.col("o_orderkey")
    idx = F.array(key % 7, F.col("o_custkey") % 11 + 20, key % 5 + 7)
    ds = F.concat(F.lit("TCGA-"), key.cast("string"))
    name = F.when(key % 3 == 0, text.work_arm(F.lit("MULTI"), ds, "raw")).when(key % 3 == 1, text.greedy_arm(ds, best=True)).otherwise(F.lit("baseline__x"))
    arm = text.parsed_arm(name)
    return o.select("o_orderkey", text.subset_scheme(idx).alias("scheme"), arm["kind"].alias("kind"), arm["t"].alias("t"), arm["dataset"].alias("dataset"))


@query("p26_label_unit_sentence", """
SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'years' WHEN 1 THEN 'cm' WHEN 2 THEN '' ELSE '%' END AS unit,
 CASE p_size % 4 WHEN 0 THEN 'Age At Onset' WHEN 1 THEN 'Tumor Largest Dimension' WHEN 2 THEN 'BMI Value' ELSE 'Nodal Sites' END AS label,
 CASE p_size % 4 WHEN 0 THEN 'Age At Onset is {} years.' WHEN 1 THEN 'Tumor Largest Dimension is {} cm.' WHEN 2 THEN 'BMI Value is {}.' ELSE 'Nodal Sites are {} %.' END AS sentence,
 CASE WHEN p_size % 7 = 0 THEN 'needs exactly one {}' END AS problem FROM part
""")
def p26_label_unit_sentence(c: Clinic):
    s = F.col("p_size")
    pick = lambda *words: F.element_at(F.array(*[F.lit(w) for w in words]), (s % 4 + 1).cast("int"))
    name = pick("age_at_onset", "tumor_largest_dimension", "bmi_value", "nodal_sites")
    desc = pick("Age, in years, at onset", "Largest size in centimeters", "Index in kilograms", "Percentage of sites")
    kind = pick("integer", "number|null", "string", "number")
    unit = text.unit_of(desc, kind)
    sentence = text.sentence_of(name, unit, ("bmi",))
    checked = F.when(s % 7 == 0, F.concat(sentence, F.lit(" {}."))).otherwise(sentence)
    return c.tables.read("part").select(
        "p_partkey", unit.alias("unit"), text.label_of(name, ("bmi",)).alias("label"), sentence.alias("sentence"),
        text.template_problem(checked).alias("problem"),
    )


# ---- rules ----------------------------------------------------------------
_R0 = """(regexp_extract(replace(field_path,'[]',''), '[^.]*$') IN ('state','lost_to_followup','vital_status','treatment_outcome','timepoint_category')
 OR regexp_extract(replace(field_path,'[]',''), '[^.]*$') LIKE 'days\\_to\\_%' ESCAPE '\\' OR contains(replace(field_path,'[]',''), 'year_of_diagnosis'))"""
_RULED = f"""
SELECT *, CASE WHEN {_R0} THEN 'R0_label_leak' WHEN coverage < 0.3 THEN 'R3_coverage'
 WHEN replace(field_path,'[]','') NOT IN ('demographic.race','demographic.sex_at_birth') AND (unique_count < 2 OR mode_share > 0.95) THEN 'R4_degenerate'
 WHEN field_path = 'demographic.gender' THEN 'R5_alias' END AS rule,
 CASE WHEN {_R0} THEN regexp_extract(replace(field_path,'[]',''), '[^.]*$') WHEN coverage < 0.3 THEN printf('%.6f', coverage) || '<0.3'
 WHEN replace(field_path,'[]','') NOT IN ('demographic.race','demographic.sex_at_birth') AND unique_count < 2 THEN 'n_unique=' || unique_count
 WHEN replace(field_path,'[]','') NOT IN ('demographic.race','demographic.sex_at_birth') AND round(mode_share, 6) > 0.95 THEN printf('mode_share=%.6f', round(mode_share, 6))
 WHEN field_path = 'demographic.gender' THEN 'alias_of sex_at_birth' ELSE '' END AS trigger
FROM x_stats"""


@query("f6_rule_verdicts", f"SELECT dataset, field_path, rule, trigger FROM ({_RULED})")
def f6_rule_verdicts(c: Clinic):
    """F1-F6: label leak, admin, coverage, degenerate and alias rules in order."""
    return rules.apply_rules(whole_stats(c)).select("dataset", "field_path", "rule", "trigger")


@query("f7_rule_only_paths", """
SELECT DISTINCT p AS field_path FROM (SELECT CASE p_size % 6 WHEN 0 THEN 'demographic.race' WHEN 1 THEN 'diagnoses.case_id' WHEN 2 THEN 'exposures.' || lower(p_type)
 WHEN 3 THEN 'diagnoses.age_at_diagnosis' WHEN 4 THEN 'demographic.days_to_birth' ELSE 'follow_ups' END AS p FROM part)
WHERE p NOT IN ('diagnoses.case_id', 'diagnoses.age_at_diagnosis', 'follow_ups')
""")
def f7_rule_only_paths(c: Clinic):
    s = F.col("p_size") % 6
    path = (
        F.when(s == 0, "demographic.race").when(s == 1, "diagnoses.case_id")
        .when(s == 2, F.concat(F.lit("exposures."), F.lower("p_type"))).when(s == 3, "diagnoses.age_at_diagnosis")
        .when(s == 4, "demographic.days_to_birth").otherwise("follow_ups")
    )
    return rules.rule_only_fields(c.tables.read("part").select(path.alias("field_path")).distinct())


@query("a8_field_registry", f"""
WITH r AS ({_RULED}), k AS (SELECT field_path, count_if(rule IS NULL) AS n_present, count(*) AS n_ds FROM r GROUP BY 1),
u AS (SELECT r.*, n_present FROM r JOIN k USING (field_path) WHERE rule IS NULL OR n_present = 0),
t AS (SELECT field_path, inferred_type, count(*) AS c FROM u GROUP BY ALL),
ty AS (SELECT field_path, CASE WHEN bool_or(inferred_type = 'ordinal_stage') THEN 'ordinal_stage' ELSE arg_min(inferred_type, (-c, inferred_type)) END AS inferred_type FROM t GROUP BY 1),
ex AS (SELECT field_path, string_agg(DISTINCT rule, ',' ORDER BY rule) AS rules FROM r WHERE rule IS NOT NULL GROUP BY 1)
SELECT u.field_path AS field, any_value(ty.inferred_type) AS inferred_type,
 CASE WHEN any_value(n_present) / 5.0 >= 0.8 THEN 'universal' WHEN any_value(n_present) / 5.0 >= 0.5 THEN 'common' ELSE 'local' END AS portability,
 any_value(n_present) AS n_datasets_present,
 round(quantile_cont(CAST(coverage AS DOUBLE), 0.5), 6) AS coverage_median,
 round(quantile_cont(CAST(coverage AS DOUBLE), 0.75) - quantile_cont(CAST(coverage AS DOUBLE), 0.25), 6) AS coverage_iqr,
 round(quantile_cont(CAST(unique_count AS DOUBLE), 0.5), 6) AS n_unique_median, round(quantile_cont(round(mode_share, 6), 0.5), 6) AS mode_share_median,
 CASE WHEN any_value(n_present) > 0 THEN '' ELSE any_value(ex.rules) END AS excluded_by, any_value(n_present) > 0 AS keep
FROM u JOIN ty USING (field_path) LEFT JOIN ex USING (field_path) GROUP BY u.field_path
""")
def a8_field_registry(c: Clinic):
    return rules.registry(rules.apply_rules(whole_stats(c)))


@query("a9_kept_fields", f"""
SELECT dataset, any_value(total) AS n_patients, string_agg(field_path, ',' ORDER BY field_path) AS fields, round(sum(coverage), 6) AS coverage_sum FROM ({_RULED}) WHERE rule IS NULL GROUP BY 1
""")
def a9_kept_fields(c: Clinic):
    kept = rules.kept_fields(rules.apply_rules(whole_stats(c)))
    total = F.aggregate(F.map_values("coverage"), F.lit(0.0), lambda a, x: a + x)
    return kept.select("dataset", "n_patients", F.array_join("fields", ",").alias("fields"), F.round(total, 6).alias("coverage_sum"))
