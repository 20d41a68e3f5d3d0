"""SQL text of the clinical mapping, assembled into self-contained oracle queries."""

from __future__ import annotations

import re

_CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    _CTES[name] = body.strip()


def with_ctes(body: str) -> str:
    """Prefix a query with exactly the CTEs it uses, each after the ones it needs."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in sorted(set(re.findall(r"\bx_\w+\b", text))):
            if name in _CTES and name not in order:
                visit(_CTES[name])
                order.append(name)

    visit(body)
    body = body.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({_CTES[n]})" for n in order)
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"


cte("x_index", """
SELECT o_custkey AS patient_id, min(o_orderdate) AS index_ts, max(o_orderdate) AS last_ts FROM orders GROUP BY 1
""")
cte("x_home", """
SELECT c_custkey AS patient_id, 'DS' || (c_nationkey % 5) AS dataset FROM customer
""")
cte("x_pat", """
SELECT c_custkey AS patient_id, 'DS' || (c_nationkey % 5) AS dataset,
 CASE WHEN c_custkey % 10 = 0 THEN 'Not Reported' WHEN c_custkey % 10 IN (1,2,3) THEN 'Dead' ELSE 'Alive' END AS vital_status,
 CAST(CASE WHEN c_custkey % 10 NOT IN (1,2,3) THEN NULL WHEN c_custkey % 40 = 1 THEN NULL WHEN c_custkey % 40 = 2 THEN 0
   ELSE date_diff('day', index_ts, last_ts) END AS DOUBLE) AS days_to_death,
 CAST(30 + c_custkey % 50 AS INTEGER) AS age_at_index,
 CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'not reported' ELSE c_mktsegment END AS race,
 CASE WHEN c_custkey % 9 = 4 THEN NULL WHEN c_custkey % 9 = 5 THEN 'First Treatment' ELSE 'Diagnosis' END AS index_date
FROM customer LEFT JOIN x_index ON c_custkey = patient_id
""")
cte("x_dx", """
SELECT h.patient_id, h.dataset, o_orderkey AS dx_pos,
 CAST(CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE date_diff('day', index_ts, o_orderdate) END AS DOUBLE) AS days_to_diagnosis,
 CASE WHEN o_orderpriority LIKE '1%' THEN 'true' ELSE 'false' END AS diagnosis_is_primary_disease,
 CASE WHEN o_orderstatus = 'P' THEN 'Unknown' ELSE 'G' || (1 + o_orderkey % 4) END AS tumor_grade,
 CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE 'Stage ' || (['I','II','III','IV'])[(o_orderkey % 4) + 1] END AS ajcc_pathologic_stage,
 CASE WHEN o_orderkey % 3 = 0 THEN 'Biopsy' END AS method_of_diagnosis,
 CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'Lung, NOS' END AS site_of_resection_or_biopsy,
 CASE WHEN o_orderkey % 13 = 0 THEN 'yes' ELSE 'no' END AS prior_malignancy,
 CASE WHEN o_orderkey % 2 = 0 THEN 'yes' ELSE 'no' END AS prior_treatment,
 CASE WHEN o_orderkey % 17 = 0 THEN 'Prior primary' ELSE 'primary' END AS classification_of_tumor,
 CASE WHEN o_orderkey % 19 = 0 THEN NULL ELSE year(o_orderdate) END AS year_of_diagnosis,
 CAST(CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE date_diff('day', index_ts, ship_ts) END AS DOUBLE) AS days_to_last_follow_up,
 CAST(CASE WHEN o_orderkey % 29 = 0 THEN date_diff('day', index_ts, o_orderdate) + 40 END AS DOUBLE) AS days_to_recurrence,
 o_orderdate AS updated_at
FROM orders JOIN x_index x ON o_custkey = x.patient_id JOIN x_home h ON h.patient_id = x.patient_id
LEFT JOIN (SELECT l_orderkey, max(l_shipdate) AS ship_ts FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey
""")
cte("x_tx", """
SELECT h.patient_id, h.dataset, l_orderkey AS dx_pos, l_linenumber AS n1, l_partkey AS n2, l_suppkey AS n3,
 CASE l_returnflag WHEN 'R' THEN 'Radiation Therapy, NOS' WHEN 'A' THEN 'Pharmaceutical Therapy, NOS' ELSE 'Surgery, NOS' END AS treatment_type,
 CASE WHEN l_linestatus = 'O' THEN 'yes' ELSE 'no' END AS treatment_or_therapy,
 CASE WHEN l_partkey % 5 = 0 THEN 'Prior to Diagnosis' WHEN l_partkey % 5 = 1 THEN 'Postoperative' END AS timepoint_category,
 CAST(date_diff('day', index_ts, l_shipdate) AS DOUBLE) AS days_to_treatment_start,
 CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE CAST(date_diff('day', index_ts, l_shipdate) AS DOUBLE) + l_quantity END AS days_to_treatment_end,
 l_shipdate AS updated_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN x_index x ON o_custkey = x.patient_id JOIN x_home h ON h.patient_id = x.patient_id
""")
cte("x_pth", """
SELECT patient_id, dataset, dx_pos, dx_pos % 30 AS lymph_nodes_tested, dx_pos % 7 AS lymph_nodes_positive, updated_at FROM x_dx WHERE dx_pos % 2 = 0
""")
cte("x_fu", """
SELECT h.patient_id, h.dataset, event_id AS fu_pos,
 CAST(CASE WHEN event_type = 'error' THEN NULL ELSE 30 * day(ts) END AS DOUBLE) AS days_to_follow_up,
 CASE WHEN event_id % 8 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) % 5 END AS ecog_performance_status,
 CASE WHEN event_id % 10 = 0 THEN NULL ELSE value END AS bmi, event_type, ts AS updated_at
FROM events JOIN x_home h ON user_id = h.patient_id
""")
cte("x_mol", """
SELECT patient_id, dataset, fu_pos, CASE WHEN event_type = 'click' THEN days_to_follow_up - 5 END AS days_to_test,
 CASE WHEN event_type <> 'click' THEN (['Initial Diagnosis','Sample Procurement','Preoperative','Prior to Treatment','Postoperative'])[(fu_pos % 5) + 1] END AS timepoint_category,
 updated_at FROM x_fu
""")
cte("x_oca", """
SELECT patient_id, dataset, fu_pos, bmi, CASE WHEN fu_pos % 6 = 0 THEN days_to_follow_up - 200 END AS days_to_comorbidity,
 CASE WHEN fu_pos % 4 = 0 THEN 'Initial Diagnosis' WHEN fu_pos % 4 = 1 THEN 'Not Reported' END AS timepoint_category, updated_at FROM x_fu
""")
cte("x_exp", """
SELECT patient_id, dataset,
 CASE WHEN patient_id % 5 = 0 THEN CAST(patient_id % 40 AS VARCHAR) END AS exposure_duration_years,
 CASE WHEN patient_id % 5 = 1 THEN CAST(1970 + patient_id % 20 AS VARCHAR) END AS tobacco_smoking_onset_year,
 CASE WHEN patient_id % 10 = 1 THEN CAST(1995 + patient_id % 5 AS VARCHAR) END AS tobacco_smoking_quit_year,
 CASE WHEN patient_id % 5 = 2 THEN CAST(15 + patient_id % 10 AS VARCHAR) END AS age_at_onset,
 CASE WHEN patient_id % 4 = 0 THEN 'unknown' ELSE CAST(patient_id % 60 AS VARCHAR) END AS pack_years_smoked
FROM x_pat WHERE patient_id % 3 <> 0
""")


def _cells(table: str, prefix: str, pos: str, fields: dict[str, str]) -> str:
    parts = []
    for name, kind in fields.items():
        value = f"CAST(CAST({name} AS BIGINT) AS VARCHAR)" if kind == "day" else f"CAST({name} AS VARCHAR)"
        k = "number" if kind == "day" else kind
        parts.append(
            f"SELECT dataset, patient_id, '{prefix}{name}' AS field_path, {pos} AS pos, {value} AS value, "
            f"CASE WHEN {name} IS NULL THEN 'null' ELSE '{k}' END AS kind FROM {table}"
        )
    return " UNION ALL ".join(parts)


cte("x_values", " UNION ALL ".join([
    _cells("x_pat", "demographic.", "0", {"vital_status": "string", "days_to_death": "day", "age_at_index": "number", "race": "string"}),
    _cells("x_dx", "diagnoses[].", "dx_pos", {
        "days_to_diagnosis": "day", "tumor_grade": "string", "ajcc_pathologic_stage": "string", "method_of_diagnosis": "string",
        "site_of_resection_or_biopsy": "string", "prior_malignancy": "string", "year_of_diagnosis": "number"}),
    _cells("x_tx", "diagnoses[].treatments[].", "dx_pos", {
        "treatment_type": "string", "treatment_or_therapy": "string", "days_to_treatment_start": "day"}),
    _cells("x_pth", "diagnoses[].pathology_details[].", "dx_pos", {"lymph_nodes_tested": "number", "lymph_nodes_positive": "number"}),
    _cells("x_fu", "follow_ups[].", "fu_pos", {"ecog_performance_status": "number"}),
    _cells("x_oca", "follow_ups[].other_clinical_attributes[].", "fu_pos", {"bmi": "number"}),
]))

FIELDS = [
    "demographic.vital_status", "demographic.days_to_death", "demographic.age_at_index", "demographic.race",
    "demographic.gender", "diagnoses[].days_to_diagnosis", "diagnoses[].tumor_grade",
    "diagnoses[].ajcc_pathologic_stage", "diagnoses[].method_of_diagnosis",
    "diagnoses[].site_of_resection_or_biopsy", "diagnoses[].prior_malignancy", "diagnoses[].year_of_diagnosis",
    "diagnoses[].treatments[].treatment_type", "diagnoses[].treatments[].treatment_or_therapy",
    "diagnoses[].treatments[].days_to_treatment_start",
    "diagnoses[].pathology_details[].lymph_nodes_tested", "diagnoses[].pathology_details[].lymph_nodes_positive",
    "follow_ups[].ecog_performance_status", "follow_ups[].other_clinical_attributes[].bmi",
]
cte("x_dictionary", "SELECT dataset, field_path FROM (SELECT DISTINCT dataset FROM x_home), (SELECT unnest(["
    + ", ".join(f"'{f}'" for f in FIELDS) + "]) AS field_path)")
cte("x_sizes", "SELECT dataset, count(*) AS n_patients FROM x_home GROUP BY 1")

SENTINEL_LIST = ("'not reported','unknown','not applicable','not available','not evaluated','not otherwise specified',"
                 "'indeterminate','cannot be assessed','unspecified','na','n/a','none','null','missing','--'")


def state_sql(value: str = "value", kind: str = "kind") -> str:
    return (f"CASE WHEN {kind} = 'null' THEN 'null' WHEN {kind} = 'string' AND trim({value}) = '' THEN 'null' "
            f"WHEN {kind} = 'string' AND lower(trim({value})) IN ({SENTINEL_LIST}) THEN 'sentinel' ELSE 'valid' END")


cte("x_state", f"SELECT *, {state_sql()} AS state FROM x_values")
cte("x_per", """
SELECT dataset, field_path, patient_id, count(*) AS n_raw, count_if(state='valid') AS n_valid, count_if(state='sentinel') AS n_sentinel,
 count_if(state='valid' AND TRY_CAST(value AS DOUBLE) IS NULL) AS n_text,
 CAST(sum(CASE WHEN state='valid' THEN TRY_CAST(value AS DECIMAL(22,8)) END) AS DOUBLE) AS s,
 string_agg(DISTINCT value, ' | ' ORDER BY value) FILTER (state='valid') AS texts
FROM x_state GROUP BY ALL
""")
cte("x_collapsed", """
SELECT dataset, field_path, patient_id, n_raw, n_valid, n_sentinel,
 CASE WHEN n_valid > 0 AND n_text = 0 THEN s / n_valid END AS number,
 CASE WHEN n_valid = 0 THEN NULL WHEN n_text = 0 THEN CAST(s / n_valid AS VARCHAR) ELSE texts END AS collapsed
FROM x_per
""")
cte("x_counts", """
SELECT dataset, field_path, collapsed, count(*) AS n, min(patient_id) AS first_at FROM x_collapsed WHERE n_valid > 0 GROUP BY ALL
""")
cte("x_info", """
SELECT dataset, field_path, sum(n) AS n_values, count(*) AS unique_count, arg_max(collapsed, (n, -first_at)) AS mode_value,
 max(n) AS top, count_if(TRY_CAST(collapsed AS DOUBLE) IS NULL) AS n_text,
 sum(CASE WHEN TRY_CAST(collapsed AS DOUBLE) IS NOT NULL THEN n ELSE 0 END) AS numeric_n,
 -sum((n / tot) * log2(n / tot)) AS entropy
FROM (SELECT *, CAST(sum(n) OVER (PARTITION BY dataset, field_path) AS DOUBLE) AS tot FROM x_counts) GROUP BY dataset, field_path
""")
cte("x_tokens", """
SELECT DISTINCT dataset, field_path, trim(t) AS token FROM (SELECT dataset, field_path, unnest(string_split(collapsed, ' | ')) AS t FROM x_counts) WHERE trim(t) <> ''
""")
cte("x_stage", r"""
SELECT dataset, field_path, (v >= 2 AND p >= 2 AND p >= 0.5 * v AND np = 1 AND nn >= 2) AS ordinal_stage FROM (
 SELECT dataset, field_path, count(*) AS v, count(prefix) AS p, count(DISTINCT prefix) AS np, count(DISTINCT num) AS nn FROM (
  SELECT dataset, field_path,
   CASE WHEN contains(token,'.') OR contains(token,'/') THEN NULL WHEN regexp_matches(token, '^(?i)stage\s+(VIII|VII|III|II|IV|IX|VI|V|X|I|\d+)[A-Za-z]*$') THEN 'stage'
        WHEN regexp_matches(token, '^[A-Za-z]{1,6}\d+[A-Za-z]*$') THEN upper(regexp_extract(token, '^([A-Za-z]{1,6})\d+', 1)) END AS prefix,
   CASE WHEN contains(token,'.') OR contains(token,'/') THEN NULL WHEN regexp_matches(token, '^(?i)stage\s+(VIII|VII|III|II|IV|IX|VI|V|X|I|\d+)[A-Za-z]*$')
          THEN CASE upper(regexp_extract(token, '^(?i)stage\s+(VIII|VII|III|II|IV|IX|VI|V|X|I|\d+)', 1)) WHEN 'I' THEN 1 WHEN 'II' THEN 2 WHEN 'III' THEN 3 WHEN 'IV' THEN 4 WHEN 'V' THEN 5 ELSE 99 END
        WHEN regexp_matches(token, '^[A-Za-z]{1,6}\d+[A-Za-z]*$') THEN CAST(regexp_extract(token, '^[A-Za-z]{1,6}(\d+)', 1) AS INTEGER) END AS num
  FROM x_tokens) GROUP BY ALL)
""")
cte("x_stats", """
SELECT d.dataset, d.field_path, n_patients AS total, coalesce(valid,0) AS valid, coalesce(sentinel,0) AS sentinel_count, coalesce(multi,0) AS multi,
 CASE WHEN i.n_values IS NULL THEN 'empty' WHEN i.n_text = 0 THEN 'numeric' ELSE 'categorical' END AS value_kind,
 coalesce(unique_count, 0) AS unique_count,
 CASE WHEN i.n_values IS NULL THEN 0.0 WHEN i.n_text = 0 THEN variance WHEN unique_count > 1 THEN entropy / log2(CAST(unique_count AS DOUBLE)) ELSE 0.0 END AS metric,
 coalesce(mode_value, '') AS mode_value, coalesce(CAST(top AS DOUBLE) / n_values, 0.0) AS mode_share,
 round(coalesce(valid,0) / CAST(n_patients AS DOUBLE), 6) AS coverage,
 CASE WHEN i.n_values IS NULL THEN 'empty' WHEN CAST(numeric_n AS DOUBLE) / n_values >= 0.95 THEN 'numeric' WHEN coalesce(ordinal_stage, false) THEN 'ordinal_stage'
   WHEN unique_count <= 20 THEN 'ordinal_class' ELSE 'text' END AS inferred_type
FROM x_dictionary d JOIN x_sizes USING (dataset)
LEFT JOIN (SELECT dataset, field_path, count_if(n_valid > 0) AS valid, count_if(n_valid = 0 AND n_sentinel > 0) AS sentinel, count_if(n_raw > 1) AS multi,
   var_pop(number) AS variance FROM x_collapsed GROUP BY ALL) c USING (dataset, field_path)
LEFT JOIN x_info i USING (dataset, field_path) LEFT JOIN x_stage s USING (dataset, field_path)
""")

# ---- time location ---------------------------------------------------------
cte("x_txf", """
SELECT patient_id, dx_pos, bool_or(treatment_type LIKE 'Surgery%' AND treatment_or_therapy <> 'no') AS resected,
 max(greatest(days_to_treatment_start, days_to_treatment_end)) AS tx_last, min(days_to_treatment_start) AS tx_first,
 min(CASE WHEN timepoint_category = 'Postoperative' THEN days_to_treatment_start END) AS adj,
 bool_or(coalesce(timepoint_category = 'Postoperative', false)) AS adj_seen,
 min(CASE WHEN treatment_type LIKE 'Surgery%' AND treatment_or_therapy <> 'no' THEN days_to_treatment_start END) AS surg
FROM x_tx GROUP BY ALL
""")
cte("x_dxf", """
SELECT x_dx.*, resected, tx_last, tx_first, adj, adj_seen, surg,
 (diagnosis_is_primary_disease = 'false' OR classification_of_tumor = 'Prior primary') AS is_prior,
 (ajcc_pathologic_stage IS NOT NULL OR coalesce(resected, false)) AS evidence,
 CASE WHEN coalesce(method_of_diagnosis = 'Biopsy', false) AND (ajcc_pathologic_stage IS NOT NULL OR coalesce(resected, false)) THEN 'P2'
  WHEN NOT coalesce(method_of_diagnosis = 'Biopsy', false) AND ajcc_pathologic_stage IS NOT NULL AND site_of_resection_or_biopsy <> '' THEN 'P1' ELSE 'P3' END AS path_class
FROM x_dx LEFT JOIN x_txf USING (patient_id, dx_pos)
""")
cte("x_ctx", """
SELECT coalesce(d.dataset, f.dataset) AS dataset, coalesce(d.patient_id, f.patient_id) AS patient_id,
 coalesce(dx_last, f.fu_last) AS last_fu, CASE WHEN dx_last IS NOT NULL THEN 'diagnoses.days_to_last_follow_up' WHEN f.fu_last IS NOT NULL THEN 'follow_ups.days_to_follow_up' ELSE '' END AS last_src,
 greatest(coalesce(dx_last, f.fu_last), rec, tx_last, f.fu_last) AS th2,
 coalesce(adj, CASE WHEN adj_seen THEN tx_first END) AS adj_start, tx_first, surg, coalesce(evidence, false) AS res_ev,
 CASE WHEN own THEN own_yes ELSE coalesce(any_yes, false) END AS prior_case,
 CASE WHEN own THEN CASE WHEN own1 THEN 'P1' WHEN own2 THEN 'P2' ELSE 'P3' END ELSE CASE WHEN all1 THEN 'P1' WHEN all2 THEN 'P2' WHEN d.dataset IS NOT NULL THEN 'P3' END END AS main_class,
 coalesce(days, []) AS follow_days
FROM (SELECT dataset, patient_id, max(days_to_last_follow_up) AS dx_last, max(days_to_recurrence) AS rec, max(tx_last) AS tx_last, min(tx_first) AS tx_first,
  min(adj) AS adj, bool_or(adj_seen) AS adj_seen, min(surg) AS surg, bool_or(evidence) AS evidence, bool_or(NOT is_prior) AS own,
  bool_or(NOT is_prior AND prior_malignancy = 'yes') AS own_yes, bool_or(prior_malignancy = 'yes') AS any_yes,
  bool_or(NOT is_prior AND path_class = 'P1') AS own1, bool_or(NOT is_prior AND path_class = 'P2') AS own2,
  bool_or(path_class = 'P1') AS all1, bool_or(path_class = 'P2') AS all2 FROM x_dxf GROUP BY ALL) d
FULL JOIN (SELECT dataset, patient_id, max(days_to_follow_up) AS fu_last, list(DISTINCT days_to_follow_up) FILTER (days_to_follow_up IS NOT NULL) AS days FROM x_fu GROUP BY ALL) f
 ON d.patient_id = f.patient_id
""")


def _chain(lo: str, th1: str | None = None) -> str:
    own = f"{th1}, " if th1 else ""
    return (f"coalesce({own}CASE WHEN {lo} <> '-Infinity'::DOUBLE THEN list_min(list_filter(follow_days, lambda d: d >= {lo})) END, th2)")


_STATUS = ("CASE WHEN st IS NOT NULL THEN st WHEN lo IS NULL AND hi IS NULL THEN 'unlocated' WHEN lo IS NULL OR hi IS NULL THEN 'lo_only' "
           "WHEN lo = hi THEN 'point' ELSE 'bounded' END")
_LO = "CASE WHEN st IS NULL THEN lo END AS t_lo, CASE WHEN st IS NULL THEN hi END AS t_hi"

cte("x_tdx", f"""
SELECT *, {_LO}, {_STATUS} AS status FROM (SELECT f.*, CASE WHEN is_prior AND prior_case THEN 0 ELSE days_to_diagnosis END AS lo,
 CASE WHEN is_prior AND prior_case THEN 0 WHEN days_to_diagnosis = 0 THEN 0 WHEN days_to_diagnosis IS NULL THEN NULL ELSE {_chain('days_to_diagnosis')} END AS hi,
 CASE WHEN NOT (is_prior AND prior_case) AND days_to_diagnosis IS NULL THEN 'unlocated' END AS st,
 prior_case, res_ev, adj_start, th2, follow_days FROM x_dxf f JOIN x_ctx c ON f.patient_id = c.patient_id)
""")
cte("x_ttx", f"""
SELECT *, {_LO}, {_STATUS} AS status FROM (SELECT *, CASE WHEN zero THEN 0 ELSE e END AS lo, CASE WHEN zero THEN 0 ELSE {_chain('e')} END AS hi,
 CASE WHEN NOT zero AND (coalesce(timepoint_category = 'Prior to Diagnosis', false) OR e IS NULL) THEN 'unlocated' END AS st
 FROM (SELECT t.*, ((d.is_prior AND d.prior_case) OR (coalesce(t.timepoint_category = 'Prior to Diagnosis', false) AND d.prior_treatment = 'yes')) AS zero,
  coalesce(days_to_treatment_end, days_to_treatment_start) AS e, d.follow_days, d.th2
  FROM x_tx t JOIN x_tdx d ON t.patient_id = d.patient_id AND t.dx_pos = d.dx_pos))
""")
cte("x_tpth", f"""
SELECT *, {_LO}, {_STATUS} AS status FROM (SELECT p.*, CASE WHEN d.is_prior AND d.prior_case THEN 0 ELSE days_to_diagnosis END AS lo,
 CASE WHEN d.is_prior AND d.prior_case THEN 0 WHEN path_class = 'P1' THEN least(days_to_diagnosis, CASE WHEN res_ev THEN adj_start END)
  ELSE {_chain('days_to_diagnosis', 'CASE WHEN res_ev THEN adj_start END')} END AS hi,
 CASE WHEN NOT (d.is_prior AND d.prior_case) AND (path_class = 'P3' OR days_to_diagnosis IS NULL) THEN 'unlocated' END AS st
 FROM x_pth p JOIN x_tdx d ON p.patient_id = d.patient_id AND p.dx_pos = d.dx_pos)
""")
cte("x_tfu", """
SELECT *, days_to_follow_up AS t_lo, days_to_follow_up AS t_hi, CASE WHEN days_to_follow_up IS NOT NULL THEN 'point' ELSE 'unlocated' END AS status,
 NOT (days_to_follow_up IS NULL AND ecog_performance_status IS NULL) AS slotted FROM x_fu
""")
cte("x_tmol", f"""
SELECT *, {_LO}, {_STATUS} AS status FROM (SELECT *,
 CASE WHEN days_to_test IS NOT NULL THEN days_to_test WHEN timepoint_category = 'Postoperative' THEN post ELSE '-Infinity'::DOUBLE END AS lo,
 CASE WHEN days_to_test IS NOT NULL THEN {_chain('days_to_test')} WHEN timepoint_category = 'Initial Diagnosis' THEN 0
  WHEN timepoint_category IN ('Sample Procurement','Preoperative') AND main_class = 'P1' THEN 0 WHEN timepoint_category = 'Preoperative' THEN surg
  WHEN timepoint_category = 'Prior to Treatment' THEN tx_first WHEN timepoint_category = 'Postoperative' THEN {_chain('post')} END AS hi,
 CASE WHEN days_to_test IS NOT NULL OR timepoint_category = 'Initial Diagnosis' THEN NULL
  WHEN timepoint_category = 'Sample Procurement' AND coalesce(main_class <> 'P1', true) THEN 'unlocated'
  WHEN timepoint_category = 'Preoperative' AND coalesce(main_class <> 'P1', true) AND surg IS NULL THEN 'unlocated'
  WHEN timepoint_category = 'Prior to Treatment' AND tx_first IS NULL THEN 'unlocated' WHEN timepoint_category = 'Postoperative' AND post IS NULL THEN 'unlocated'
  WHEN timepoint_category IS NULL THEN 'unlocated' END AS st
 FROM (SELECT m.*, main_class, surg, tx_first, th2, follow_days, CASE WHEN main_class = 'P2' THEN surg ELSE 0 END AS post FROM x_mol m JOIN x_ctx c ON m.patient_id = c.patient_id))
""")
cte("x_toca", f"""
SELECT *, {_LO}, {_STATUS} AS status FROM (SELECT o.*, CASE WHEN days_to_comorbidity < 0 THEN 0 WHEN days_to_comorbidity IS NOT NULL THEN days_to_comorbidity ELSE 0 END AS lo,
 CASE WHEN days_to_comorbidity < 0 THEN 0 WHEN days_to_comorbidity IS NOT NULL THEN {_chain('days_to_comorbidity')} ELSE 0 END AS hi,
 CASE WHEN days_to_comorbidity IS NULL AND coalesce(timepoint_category <> 'Initial Diagnosis', true) THEN 'unlocated' END AS st
 FROM x_oca o JOIN x_ctx c ON o.patient_id = c.patient_id)
""")
cte("x_slots", """
SELECT *, row_number() OVER (PARTITION BY patient_id, family ORDER BY k0, k1, k2, k3) AS slot, CASE WHEN status NOT IN ('unlocated', 'non_informative') THEN t_hi END AS record_days FROM (
 SELECT dataset, patient_id, 'diagnoses' AS family, dx_pos AS k0, 0 AS k1, 0 AS k2, 0 AS k3, t_lo, t_hi, status, updated_at FROM x_tdx
 UNION ALL SELECT dataset, patient_id, 'diagnoses_treatments', dx_pos, n1, n2, n3, t_lo, t_hi, status, updated_at FROM x_ttx WHERE treatment_or_therapy <> 'no'
 UNION ALL SELECT dataset, patient_id, 'diagnoses_pathology_details', dx_pos, 0, 0, 0, t_lo, t_hi, status, updated_at FROM x_tpth
 UNION ALL SELECT dataset, patient_id, 'follow_ups', fu_pos, 0, 0, 0, t_lo, t_hi, status, updated_at FROM x_tfu WHERE slotted
 UNION ALL SELECT dataset, patient_id, 'follow_ups_molecular_tests', fu_pos, 0, 0, 0, t_lo, t_hi, status, updated_at FROM x_tmol
 UNION ALL SELECT dataset, patient_id, 'follow_ups_other_clinical_attributes', fu_pos, 0, 0, 0, t_lo, t_hi, status, updated_at FROM x_toca)
""")
cte("x_ends", """
SELECT p.dataset, p.patient_id, vital_status, CASE vital_status WHEN 'Dead' THEN 1 WHEN 'Alive' THEN 0 END AS event,
 CASE WHEN vital_status = 'Dead' THEN days_to_death ELSE last_fu END AS gt, last_fu, days_to_death,
 CASE WHEN vital_status = 'Dead' THEN 'demographic.days_to_death' WHEN coalesce(last_src, '') = '' THEN 'diagnoses.days_to_last_follow_up' ELSE last_src END AS src
FROM x_pat p LEFT JOIN x_ctx c ON p.patient_id = c.patient_id
""")
cte("x_labels", """
SELECT dataset, 'C' || patient_id AS case_id, patient_id, gt / (365.25::DOUBLE / 12.0::DOUBLE) AS survival_months, 1 - event AS censorship FROM x_ends WHERE gt IS NOT NULL AND event IS NOT NULL
""")
