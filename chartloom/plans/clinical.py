"""Driver tables shaped as clinical case families.

A customer is a patient, an order a diagnosis, a line item a treatment and an
event a follow-up.  Every family table carries the patient, the dataset and its
place in document order, so the operators see the same columns a shredded case
document gives (see ``sources.cases``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.families import TIMED, Families, long_values
from ..operators.timing import case_context, diagnosis_facts, timed
from ..scale import stored

# which columns of each family become field values, and their JSON kind
VALUE_FIELDS = {
    "patients": {"vital_status": "string", "days_to_death": "number", "age_at_index": "number", "race": "string"},
    "diagnoses": {
        "days_to_diagnosis": "number", "tumor_grade": "string", "ajcc_pathologic_stage": "string",
        "method_of_diagnosis": "string", "site_of_resection_or_biopsy": "string", "prior_malignancy": "string",
        "year_of_diagnosis": "number",
    },
    "diagnoses_treatments": {
        "treatment_type": "string", "treatment_or_therapy": "string", "days_to_treatment_start": "number",
    },
    "diagnoses_pathology_details": {"lymph_nodes_tested": "number", "lymph_nodes_positive": "number"},
    "follow_ups": {"ecog_performance_status": "number"},
    "follow_ups_other_clinical_attributes": {"bmi": "number"},
}


# a handful of files can hold less splits than the cluster has cores
SPREAD_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "events": "event_id"}
SPREAD_ROWS = 50_000


class Tables:
    """Lazy readers over one folder of parquet tables, with row counts from file footers."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._rows: dict[str, int] = {}

    def read(self, name: str) -> DataFrame:
        """A table; one with fewer splits than cores is spread over them by its join key."""
        df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        key = SPREAD_KEYS.get(name)
        cores = self.spark.sparkContext.defaultParallelism
        if key and self.rows(name) >= SPREAD_ROWS and df.rdd.getNumPartitions() < cores:
            df = df.repartition(cores, key)
        return df

    def rows(self, *names: str) -> int:
        """Rows of the tables together: an upper bound for anything that only filters or groups them."""
        for name in names:
            if name not in self._rows:
                self._rows[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet").count()
        return sum(self._rows[name] for name in names)


def _text(c: Column) -> Column:
    return c.cast("string")


class Clinic:
    """Family tables of the clinical mapping."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.tables = Tables(spark, folder)

    # upper bounds used to decide whether ordered work must be cut
    @property
    def object_rows(self) -> int:
        return self.tables.rows("customer", "orders", "lineitem", "events")

    @cached_property
    def _index(self) -> DataFrame:
        orders = self.tables.read("orders")
        return orders.groupBy(F.col("o_custkey").alias("patient_id")).agg(
            F.min("o_orderdate").alias("index_ts"), F.max("o_orderdate").alias("last_ts")
        )

    def _patients(self) -> DataFrame:
        c = self.tables.read("customer")
        joined = c.join(self._index, c.c_custkey == F.col("patient_id"), "left").drop("patient_id")
        key = F.col("c_custkey")
        dead = (key % 10).isin(1, 2, 3)
        death = (
            F.when(~dead, None).when(key % 40 == 1, None).when(key % 40 == 2, 0)
            .otherwise(F.datediff("last_ts", "index_ts"))
        )
        return joined.select(
            key.alias("patient_id"),
            F.concat(F.lit("DS"), _text(F.col("c_nationkey") % 5)).alias("dataset"),
            F.when(key % 10 == 0, "Not Reported").when(dead, "Dead").otherwise("Alive").alias("vital_status"),
            death.cast("double").alias("days_to_death"),
            (30 + key % 50).cast("int").alias("age_at_index"),
            F.when(F.col("c_mktsegment") == "HOUSEHOLD", "not reported").otherwise(F.col("c_mktsegment")).alias("race"),
            F.when(key % 9 == 4, None).when(key % 9 == 5, "First Treatment").otherwise("Diagnosis").alias("index_date"),
            F.when(key % 4 == 0, F.lit(None).cast("int")).otherwise(key % 3).cast("int").alias("onset_gap"),
        )

    def _diagnoses(self) -> DataFrame:
        o = self.tables.read("orders")
        last = self.tables.read("lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("ship_ts"))
        key = F.col("o_orderkey")
        joined = (
            o.join(last, o.o_orderkey == last.l_orderkey, "left")
            .join(self._index, o.o_custkey == F.col("patient_id"))
            .join(self._homes, "patient_id")
        )
        return joined.select(
            "patient_id", "dataset", key.alias("dx_pos"), F.array(key).alias("pos"),
            F.when(key % 11 == 0, None).otherwise(F.datediff("o_orderdate", "index_ts")).cast("double").alias("days_to_diagnosis"),
            F.when(F.col("o_orderpriority").startswith("1"), "true").otherwise("false").alias("diagnosis_is_primary_disease"),
            F.when(F.col("o_orderstatus") == "P", "Unknown").otherwise(F.concat(F.lit("G"), _text(1 + key % 4))).alias("tumor_grade"),
            F.when(key % 7 == 0, None).otherwise(
                F.element_at(F.array(*[F.lit(f"Stage {r}") for r in ("I", "II", "III", "IV")]), (key % 4 + 1).cast("int"))
            ).alias("ajcc_pathologic_stage"),
            F.when(key % 3 == 0, "Biopsy").alias("method_of_diagnosis"),
            F.when(key % 5 == 0, "").otherwise("Lung, NOS").alias("site_of_resection_or_biopsy"),
            F.when(key % 13 == 0, "yes").otherwise("no").alias("prior_malignancy"),
            F.when(key % 2 == 0, "yes").otherwise("no").alias("prior_treatment"),
            F.when(key % 17 == 0, "Prior primary").otherwise("primary").alias("classification_of_tumor"),
            F.when(key % 19 == 0, None).otherwise(F.year("o_orderdate")).alias("year_of_diagnosis"),
            F.lit(None).cast("string").alias("residual_disease"),
            F.when(key % 6 == 0, None).otherwise(F.datediff("ship_ts", "index_ts")).cast("double").alias("days_to_last_follow_up"),
            F.lit(None).cast("double").alias("days_to_last_known_disease_status"),
            F.when(key % 29 == 0, F.datediff("o_orderdate", "index_ts") + 40).cast("double").alias("days_to_recurrence"),
            F.col("o_orderdate").alias("updated_at"),
        )

    @cached_property
    def _homes(self) -> DataFrame:
        c = self.tables.read("customer")
        return c.select(
            F.col("c_custkey").alias("patient_id"),
            F.concat(F.lit("DS"), _text(F.col("c_nationkey") % 5)).alias("dataset"),
        )

    def _treatments(self) -> DataFrame:
        li, o = self.tables.read("lineitem"), self.tables.read("orders")
        # what an order knows of its patient comes together first: line items move once
        owner = (
            o.select("o_orderkey", F.col("o_custkey").alias("patient_id"))
            .join(self._index, "patient_id")
            .join(self._homes, "patient_id")
        )
        joined = li.join(owner, li.l_orderkey == owner.o_orderkey)
        part = F.col("l_partkey")
        start = F.datediff("l_shipdate", "index_ts").cast("double")
        return joined.select(
            "patient_id", "dataset", F.col("l_orderkey").alias("dx_pos"),
            F.array("l_orderkey", F.col("l_linenumber").cast("long"), "l_partkey", "l_suppkey").alias("pos"),
            F.when(F.col("l_returnflag") == "R", "Radiation Therapy, NOS")
            .when(F.col("l_returnflag") == "A", "Pharmaceutical Therapy, NOS")
            .otherwise("Surgery, NOS").alias("treatment_type"),
            F.when(F.col("l_linestatus") == "O", "yes").otherwise("no").alias("treatment_or_therapy"),
            F.lit(None).cast("string").alias("treatment_intent_type"),
            F.when(part % 5 == 0, "Prior to Diagnosis").when(part % 5 == 1, "Postoperative").alias("timepoint_category"),
            start.alias("days_to_treatment_start"),
            F.when(part % 4 == 0, None).otherwise(start + F.col("l_quantity")).alias("days_to_treatment_end"),
            F.col("l_shipdate").alias("updated_at"),
        )

    def _pathology_details(self) -> DataFrame:
        d = self.diagnoses.where(F.col("dx_pos") % 2 == 0)
        return d.select(
            "patient_id", "dataset", "dx_pos", "pos",
            (F.col("dx_pos") % 30).alias("lymph_nodes_tested"),
            (F.col("dx_pos") % 7).alias("lymph_nodes_positive"),
            "updated_at",
        )

    def _follow_ups(self) -> DataFrame:
        e = self.tables.read("events")
        k = F.get_json_object("props", "$.k").cast("int")
        day = F.when(F.col("event_type") == "error", None).otherwise(30 * F.dayofmonth("ts")).cast("double")
        return e.join(self._homes, e.user_id == F.col("patient_id")).select(
            "patient_id", "dataset", F.col("event_id").alias("fu_pos"), F.array("event_id").alias("pos"),
            day.alias("days_to_follow_up"),
            F.when(F.col("event_id") % 8 == 0, None).otherwise(k % 5).alias("ecog_performance_status"),
            F.when(F.col("event_id") % 10 == 0, None).otherwise(F.col("value")).alias("bmi"),
            "event_type",
            F.col("ts").alias("updated_at"),
        ).withColumns({
            "has_content": F.col("ecog_performance_status").isNotNull(),
            "is_shell": F.col("days_to_follow_up").isNull() & F.col("ecog_performance_status").isNull(),
        })

    def _molecular_tests(self) -> DataFrame:
        f = self.follow_ups
        words = ["Initial Diagnosis", "Sample Procurement", "Preoperative", "Prior to Treatment", "Postoperative"]
        return f.select(
            "patient_id", "dataset", "fu_pos", "pos",
            F.when(F.col("event_type") == "click", F.col("days_to_follow_up") - 5).alias("days_to_test"),
            F.when(
                F.col("event_type") != "click",
                F.element_at(F.array(*[F.lit(w) for w in words]), (F.col("fu_pos") % 5 + 1).cast("int")),
            ).alias("timepoint_category"),
            "updated_at",
        )

    def _other_attributes(self) -> DataFrame:
        f, key = self.follow_ups, F.col("fu_pos")
        return f.select(
            "patient_id", "dataset", "fu_pos", "pos", "bmi",
            F.when(key % 6 == 0, F.col("days_to_follow_up") - 200).alias("days_to_comorbidity"),
            F.lit(None).cast("double").alias("days_to_risk_factor"),
            F.when(key % 4 == 0, "Initial Diagnosis").when(key % 4 == 1, "Not Reported").alias("timepoint_category"),
            "updated_at",
        )

    def _exposures(self) -> DataFrame:
        p, key = self.patients, F.col("patient_id")
        return p.where(key % 3 != 0).select(
            "patient_id", "dataset", F.array(F.lit(0).cast("long")).alias("pos"),
            F.when(key % 5 == 0, _text(key % 40)).alias("exposure_duration_years"),
            F.when(key % 5 == 1, _text(1970 + key % 20)).alias("tobacco_smoking_onset_year"),
            F.when(key % 10 == 1, _text(1995 + key % 5)).alias("tobacco_smoking_quit_year"),
            F.when(key % 5 == 2, _text(15 + key % 10)).alias("age_at_onset"),
            F.when(key % 4 == 0, "unknown").otherwise(_text(key % 60)).alias("pack_years_smoked"),
        )

    # ---- tables kept in the shared folder -----------------------------------
    def _stored(self, name: str, build) -> DataFrame:
        return stored(self.spark, self.tables.folder, name, build)

    @cached_property
    def families(self) -> Families:
        return Families(**{n: (lambda n=n: self._stored(n, getattr(self, f"_{n}"))) for n in Families.NAMES})

    def __getattr__(self, name: str) -> DataFrame:
        if name in Families.NAMES:
            return getattr(self.families, name)
        raise AttributeError(name)

    @cached_property
    def facts(self) -> DataFrame:
        return self._stored("diagnosis_facts", lambda: diagnosis_facts(self.families))

    @cached_property
    def context(self) -> DataFrame:
        return self._stored("case_context", lambda: case_context(self.facts, self.families.follow_ups))

    @cached_property
    def timed(self) -> Families:
        """Families with their time location, each written when first used."""

        def located(family: str) -> DataFrame:
            return self._stored(
                f"timed_{family}", lambda: timed(self.families, self.facts, self.context).table(family)
            )

        return self.families.with_tables({f: (lambda f=f: located(f)) for f in TIMED})

    @cached_property
    def unplaced(self) -> Families:
        """Families for work that reads no time: the rows that can be placed in time, before they are.

        Rows without a dataset, patient or (children of diagnoses) diagnosis meet
        no context and have no place.  A child of a repeated diagnosis is one row
        here and one for each copy in ``timed``: read it where copies don't count.
        """
        family_keys = {f: ("dataset", "patient_id", "dx_pos") if f.startswith("diagnoses") else ("dataset", "patient_id") for f in TIMED if f != "follow_ups"}
        return self.families.mapped(family_keys, lambda family, table: table.dropna(subset=list(family_keys[family])))

    @cached_property
    def values(self) -> DataFrame:
        return long_values(self.families, VALUE_FIELDS)

    @property
    def bound(self) -> int:
        return self.object_rows

    @cached_property
    def dictionary(self) -> DataFrame:
        """(dataset, field_path) of every field the mapping can carry, one field of which never appears."""
        fields = [
            "demographic.vital_status", "demographic.days_to_death", "demographic.age_at_index", "demographic.race",
            "demographic.gender", "diagnoses[].days_to_diagnosis", "diagnoses[].tumor_grade",
            "diagnoses[].ajcc_pathologic_stage", "diagnoses[].method_of_diagnosis",
            "diagnoses[].site_of_resection_or_biopsy", "diagnoses[].prior_malignancy", "diagnoses[].year_of_diagnosis",
            "diagnoses[].treatments[].treatment_type", "diagnoses[].treatments[].treatment_or_therapy",
            "diagnoses[].treatments[].days_to_treatment_start",
            "diagnoses[].pathology_details[].lymph_nodes_tested", "diagnoses[].pathology_details[].lymph_nodes_positive",
            "follow_ups[].ecog_performance_status", "follow_ups[].other_clinical_attributes[].bmi",
        ]
        return self._homes.select("dataset").distinct().select(
            "dataset", F.explode(F.array(*[F.lit(f) for f in fields])).alias("field_path")
        )

    @cached_property
    def sizes(self) -> DataFrame:
        return self._homes.groupBy("dataset").agg(F.count(F.lit(1)).alias("n_patients"))
