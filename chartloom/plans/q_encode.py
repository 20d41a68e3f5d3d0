"""Queries on encodings: tokens, types, vocabularies, cells, vectors and neighbours."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import encode, extract, landmark
from ..operators.families import Families
from . import oracle_base as ob
from .clinical import VALUE_FIELDS, Clinic
from .registry import query

ENCODED = {
    "patients": {"age_at_index": "number", "race": "string"},
    "diagnoses": {"tumor_grade": "string", "ajcc_pathologic_stage": "string", "method_of_diagnosis": "string"},
    "diagnoses_treatments": {"treatment_type": "string"},
    "follow_ups": {"ecog_performance_status": "number"},
    "follow_ups_other_clinical_attributes": {"bmi": "number"},
}
_PATHS = ["demographic.age_at_index", "demographic.race", "diagnoses[].tumor_grade", "diagnoses[].ajcc_pathologic_stage", "diagnoses[].method_of_diagnosis",
          "diagnoses[].treatments[].treatment_type", "follow_ups[].ecog_performance_status", "follow_ups[].other_clinical_attributes[].bmi"]
_DICT = [("demographic", "age_at_index", "integer|null"), ("demographic", "race", "enum"), ("diagnosis", "tumor_grade", "enum"), ("diagnosis", "method_of_diagnosis", "string"),
         ("follow_up", "ecog_performance_status", "enum"), ("other_clinical_attribute", "bmi", "number")]
_CONTINUOUS = "('demographic.age_at_index', 'follow_ups[].other_clinical_attributes[].bmi')"
_IN = "(" + ", ".join(f"'{p}'" for p in _PATHS) + ")"
RARE = 10

ob.cte("x_tok", f"SELECT dataset, patient_id, field_path, trim(value) AS token FROM x_used WHERE field_path IN {_IN}")
ob.cte("x_num", "SELECT dataset, patient_id, field_path, quantile_cont(CAST(token AS DOUBLE), 0.5) AS x FROM x_tok WHERE field_path IN " + _CONTINUOUS + " GROUP BY ALL")
ob.cte("x_cat", "SELECT dataset, patient_id, field_path, string_agg(DISTINCT lower(token), ' | ' ORDER BY lower(token)) AS category FROM x_tok GROUP BY ALL")
ob.cte("x_fit", "SELECT dataset, field_path, min(x) AS lo, max(x) AS hi, quantile_cont(x, 0.5) AS mid FROM x_num GROUP BY ALL")
ob.cte("x_vocab", f"""
SELECT field_path, '__MISSING__' AS category, 0 AS idx FROM (SELECT DISTINCT field_path FROM x_cat) UNION ALL SELECT field_path, '__OTHER__', 1 FROM (SELECT DISTINCT field_path FROM x_cat)
UNION ALL SELECT field_path, category, row_number() OVER (PARTITION BY field_path ORDER BY category) + 1 FROM (SELECT field_path, category, count(*) AS n FROM x_cat GROUP BY ALL) WHERE n >= {RARE}
""")
ob.cte("x_types", f"SELECT dataset, f AS field_path, CASE WHEN f IN {_CONTINUOUS} THEN 'continuous' ELSE 'nominal' END AS final_type FROM x_sizes, (SELECT unnest([{', '.join(repr(p) for p in _PATHS)}]) AS f)")
ob.cte("x_cells", f"""
SELECT p.dataset, p.patient_id, t.field_path, final_type AS kind, CASE WHEN final_type = 'nominal' THEN CASE WHEN c.category IS NULL THEN 0 ELSE coalesce(v.idx, 1) END END AS code,
 CASE WHEN final_type = 'continuous' THEN CASE WHEN hi <= lo THEN 0 ELSE (coalesce(x, mid) - lo) / (hi - lo) END END AS x,
 CASE WHEN final_type = 'continuous' THEN 1 ELSE width END AS width
FROM x_pat p JOIN x_types t ON t.dataset = p.dataset LEFT JOIN x_num n ON n.patient_id = p.patient_id AND n.field_path = t.field_path
LEFT JOIN x_fit f ON f.dataset = p.dataset AND f.field_path = t.field_path LEFT JOIN x_cat c ON c.patient_id = p.patient_id AND c.field_path = t.field_path
LEFT JOIN x_vocab v ON v.field_path = t.field_path AND v.category = c.category LEFT JOIN (SELECT field_path, max(idx) + 1 AS width FROM x_vocab GROUP BY 1) w ON w.field_path = t.field_path
""")


def tokens(c: Clinic, t: Families | None = None):
    """Tokens of the encoded fields at any time, copies as in ``t``; types, medians and categories read families without times."""
    converts = c.spark.createDataFrame([("demographic.age_at_index", "int")], "field_path string, convert string")
    return encode.tokens(landmark.used_values(c.unplaced if t is None else t, ENCODED, None), converts)


def fields(c: Clinic):
    return c.sizes.select("dataset", F.explode(F.array(*[F.lit(p) for p in _PATHS])).alias("field_path"))


def types(c: Clinic, t):
    return encode.field_types(t, fields(c), c.spark.createDataFrame(_DICT, "entity string, field string, type string"))


@query("e2_converted_tokens", "SELECT dataset, field_path, token, count(*) AS n FROM x_tok GROUP BY ALL")
def e2_converted_tokens(c: Clinic):
    t = tokens(c, c.timed)
    return t.groupBy("dataset", "field_path", "token").agg(F.count(F.lit(1)).alias("n"))


@query("e3_field_types", """
SELECT dataset, field_path, final_type, CASE WHEN field_path LIKE '%stage' OR field_path LIKE '%method%' OR field_path LIKE '%treatment_type' THEN 'infer_type' ELSE 'gdc_dictionary' END AS source FROM x_types
""")
def e3_field_types(c: Clinic):
    return types(c, tokens(c)).select("dataset", "field_path", "final_type", "source")


@query("a26_continuous_fit", "SELECT dataset, field_path, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mid, 6) AS mid FROM x_fit")
def a26_continuous_fit(c: Clinic):
    from ..scale import checkpointed

    t = checkpointed(tokens(c))
    number = types(c, t).where("final_type = 'continuous'").select("dataset", "field_path")
    t = t.join(number, ["dataset", "field_path"])
    fit = encode.continuous_fit(checkpointed(encode.patient_numbers(t, c.bound)), ["dataset", "field_path"], c.bound)
    return fit.select("dataset", "field_path", *[F.round(x, 6).alias(x) for x in ("lo", "hi", "mid")])


@query("a27_dataset_vocabulary", f"""
SELECT dataset, field_path, category, row_number() OVER (PARTITION BY dataset, field_path ORDER BY category) + 1 AS idx FROM (SELECT dataset, field_path, category, count(*) AS n FROM x_cat GROUP BY ALL) WHERE n >= {RARE}
UNION ALL SELECT DISTINCT dataset, field_path, '__MISSING__', 0 FROM x_cat UNION ALL SELECT DISTINCT dataset, field_path, '__OTHER__', 1 FROM x_cat
""")
def a27_dataset_vocabulary(c: Clinic):
    t = tokens(c)
    return encode.vocabulary(encode.patient_categories(t), ["dataset", "field_path"], RARE)


@query("a28_global_vocabulary", "SELECT field_path, category, idx FROM x_vocab")
def a28_global_vocabulary(c: Clinic):
    t = tokens(c)
    return encode.vocabulary(encode.patient_categories(t), ["field_path"], RARE)


def cells(c: Clinic):
    from ..scale import checkpointed

    t = checkpointed(tokens(c))
    # each is read by several steps
    ty = checkpointed(types(c, t))
    numbers = checkpointed(encode.patient_numbers(t, c.bound))
    cats = checkpointed(encode.patient_categories(t))
    vocab = checkpointed(encode.vocabulary(cats, ["field_path"], RARE))
    fit = encode.continuous_fit(numbers, ["dataset", "field_path"], c.bound)
    return encode.encoded_cells(c.patients, ty, numbers, cats, fit, vocab, ["field_path"]), ty, vocab


@query("e4_encoded_cells", "SELECT dataset, patient_id, field_path, kind, code, round(x, 6) AS x, width FROM x_cells")
def e4_encoded_cells(c: Clinic):
    return cells(c)[0].withColumn("x", F.round("x", 6))


@query("e5_feature_schema", """
SELECT dataset, field_path, final_type, width, CAST(sum(width) OVER (PARTITION BY dataset ORDER BY field_path) - width AS BIGINT) AS start FROM (
 SELECT dataset, t.field_path, final_type, CASE WHEN final_type = 'continuous' THEN 1 ELSE w END AS width FROM x_types t JOIN (SELECT field_path, max(idx) + 1 AS w FROM x_vocab GROUP BY 1) v ON v.field_path = t.field_path)
""")
def e5_feature_schema(c: Clinic):
    _, ty, vocab = cells(c)
    return encode.feature_schema(ty, vocab, ["field_path"])


@query("e6_mixed_vectors", """
SELECT dataset, patient_id, CAST(sum(width) AS BIGINT) AS width, round(sum(CASE WHEN kind = 'continuous' THEN CAST(CAST(x AS FLOAT) AS DOUBLE) ELSE 1 END), 4) AS total,
 round(sum(CASE WHEN kind = 'continuous' THEN CAST(CAST(x AS FLOAT) AS DOUBLE) * (start + 1) ELSE start + code + 1 END), 2) AS placed
FROM (SELECT *, sum(width) OVER (PARTITION BY patient_id ORDER BY field_path) - width AS start FROM x_cells) GROUP BY ALL
""")
def e6_mixed_vectors(c: Clinic):
    order = c.sizes.select("dataset", F.posexplode(F.array(*[F.lit(p) for p in sorted(_PATHS)])).alias("ord", "field_path"))
    v = encode.vectors(cells(c)[0], order)
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x.cast("double"))
    placed = F.aggregate(F.transform("vec", lambda x, i: x.cast("double") * (i + 1)), F.lit(0.0), lambda a, x: a + x)
    return v.select("dataset", "patient_id", F.size("vec").cast("long").alias("width"), F.round(total, 4).alias("total"), F.round(placed, 2).alias("placed"))


KINDS = {
    "demographic.age_at_index": "continuous", "diagnoses[].year_of_diagnosis": "continuous",
    "diagnoses[].pathology_details[].lymph_nodes_tested": "continuous", "diagnoses[].tumor_grade": "ordinal",
    "diagnoses[].ajcc_pathologic_stage": "ordinal", "follow_ups[].ecog_performance_status": "ordinal",
    "demographic.race": "nominal", "diagnoses[].prior_malignancy": "nominal",
}
_NODE_FIELDS = [*KINDS, "derived.radiation_therapy"]
ob.cte("x_node0", f"SELECT * FROM x_scheme WHERE field_path IN ({', '.join(repr(f) for f in _NODE_FIELDS)})")
ob.cte("x_nvocab", """
SELECT field_path, category, row_number() OVER (PARTITION BY field_path ORDER BY category) + 1 AS idx FROM (SELECT DISTINCT field_path, lower(value) AS category FROM x_node0 WHERE valid AND field_path IN ('demographic.race', 'diagnoses[].prior_malignancy'))
""")
ob.cte("x_nodes", """
SELECT n.dataset, n.patient_id, n.field_path, CASE WHEN NOT valid THEN NULL
 WHEN n.field_path IN ('demographic.age_at_index', 'diagnoses[].year_of_diagnosis', 'diagnoses[].pathology_details[].lymph_nodes_tested') THEN list_median(list_transform(string_split(value, ', '), lambda s: CAST(s AS DOUBLE)))
 WHEN n.field_path = 'diagnoses[].tumor_grade' THEN CAST(right(value, 1) AS DOUBLE) WHEN n.field_path LIKE '%stage' THEN CASE value WHEN 'Stage I' THEN 2 WHEN 'Stage II' THEN 3 WHEN 'Stage III' THEN 4 ELSE 5 END
 WHEN n.field_path LIKE '%ecog%' THEN CAST(list_max(list_transform(string_split(value, ', '), lambda s: CAST(s AS DOUBLE))) + 1 AS DOUBLE)
 WHEN n.field_path IN ('demographic.race', 'diagnoses[].prior_malignancy') THEN CAST(coalesce(idx, 1) AS DOUBLE) END AS x
FROM x_node0 n LEFT JOIN x_nvocab v ON v.field_path = n.field_path AND v.category = lower(value)
""")
ob.cte("x_nscaled", """
SELECT dataset, patient_id, field_path, CASE WHEN hi = lo THEN x * 0 ELSE (x - (hi + lo) / 2) / (hi - lo) * 2 END AS x FROM (SELECT *, min(x) OVER (PARTITION BY dataset, field_path) AS lo, max(x) OVER (PARTITION BY dataset, field_path) AS hi FROM x_nodes)
""")


def nodes(c: Clinic):
    values = extract.scheme_values(c.families, fields=_NODE_FIELDS)
    nominal = [f for f, k in KINDS.items() if k == "nominal"]
    vocab = encode.vocabulary(encode.scheme_categories(values.where(F.col("field_path").isin(*nominal))), ["field_path"])
    return encode.node_values(values, KINDS, vocab)


@query("e7_node_features", "SELECT dataset, patient_id, field_path, round(x, 6) + 0.0::DOUBLE AS x FROM x_nscaled")
def e7_node_features(c: Clinic):
    """A29 fits on collapsed scheme values and E7 symmetric scaling."""
    return encode.symmetric_scaled(nodes(c)).withColumn("x", F.round("x", 6) + F.lit(0.0))


@query("a29_scheme_fit", """
SELECT field_path, round(min(x), 6) AS lo, round(max(x), 6) AS hi, round(quantile_cont(x, 0.5), 6) AS mid FROM x_nodes WHERE field_path IN ('demographic.age_at_index', 'diagnoses[].year_of_diagnosis', 'diagnoses[].pathology_details[].lymph_nodes_tested') AND x IS NOT NULL GROUP BY 1
""")
def a29_scheme_fit(c: Clinic):
    names = [f for f, k in KINDS.items() if k == "continuous"]
    values = extract.scheme_values(c.families, fields=names)
    x = values.select("field_path", encode.scheme_number(F.col("field_path"), F.col("value")).alias("x")).where("x is not null")
    fit = encode.continuous_fit(x, ["field_path"], c.bound)
    return fit.select("field_path", *[F.round(k, 6).alias(k) for k in ("lo", "hi", "mid")])


@query("a30_observed_coverage", """
SELECT dataset, field_path, count(x) AS n_observed, count(*) - count(x) AS n_missing, round(100.0 * count(x) / CAST(count(*) AS DOUBLE), 6) AS percent_observed FROM x_nodes GROUP BY ALL
""")
def a30_observed_coverage(c: Clinic):
    return encode.observed(nodes(c)).withColumn("percent_observed", F.round("percent_observed", 6))


@query("e8_node_table", f"""
SELECT dataset, patient_id, i, i AS j, round(coalesce(x, 0), 6) + 0.0::DOUBLE AS value FROM x_nscaled JOIN (SELECT unnest([{', '.join(repr(f) for f in _NODE_FIELDS)}]) AS field_path, unnest(range({len(_NODE_FIELDS)})) AS i) USING (field_path)
""")
def e8_node_table(c: Clinic):
    order = c.spark.createDataFrame([(f, i) for i, f in enumerate(_NODE_FIELDS)], "field_path string, ord long")
    return encode.node_table(encode.symmetric_scaled(nodes(c)), order).withColumn("value", F.round("value", 6) + F.lit(0.0))


@query("e8_scheme_edges", """
WITH n AS (SELECT p_brand AS scheme, count(DISTINCT p_type) AS n FROM part GROUP BY 1) SELECT scheme, s AS source, t AS target FROM n, LATERAL (SELECT unnest(range(n)) AS s), LATERAL (SELECT unnest(range(n)) AS t) WHERE s <> t
""")
def e8_scheme_edges(c: Clinic):
    schemes = c.tables.read("part").select(F.col("p_brand").alias("scheme"), "p_type").distinct()
    return encode.scheme_edges(schemes)


@query("e11_bank_slice", """
SELECT vec_id, slice_idx, round(CAST(embedding[k + 1] AS DOUBLE), 6) AS x FROM embeddings, (SELECT unnest([10, 11, 4, 5, 62, 63]) AS k, unnest([0, 1, 2, 3, 4, 5]) AS slice_idx)
""")
def e11_bank_slice(c: Clinic):
    """Fields 5, 2 and 31 of a bank with two tokens per field."""
    bank = c.tables.read("embeddings").select("vec_id", F.posexplode("embedding").alias("token_idx", "x"))
    s = encode.bank_slice(bank, [5, 2, 31], 2)
    return s.select("vec_id", F.col("slice_idx").cast("long").alias("slice_idx"), F.round(F.col("x").cast("double"), 6).alias("x"))


@query("e14_neighbour_pairs", """
WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), s AS (SELECT a.label, a.vec_id AS x, b.vec_id AS y, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC, b.vec_id) AS r
 FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id) SELECT DISTINCT label, least(x, y) AS a, greatest(x, y) AS b FROM s WHERE r <= 3
""")
def e14_neighbour_pairs(c: Clinic):
    return encode.neighbour_pairs(c.tables.read("embeddings"), "label", "vec_id", "embedding", 3, rows=c.tables.rows("embeddings"))
