"""When each clinical sub-record can be proven to have been known.

``timed`` adds ``t_lo``, ``t_hi`` and ``status`` to the six timed families.  The
location travels in the object's own row, so masks, audits and slot tables are
projections of it and need no lookup by object identity.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.missing import has_text, stripped, trimmed
from ..scale import checkpointed, next_at_or_after, ordered_columns
from .families import TIMED, Families

POINT, BOUNDED, LO_ONLY = "point", "bounded", "lo_only"
UNLOCATED, NON_INFORMATIVE = "unlocated", "non_informative"
STATUSES = (POINT, BOUNDED, LO_ONLY, UNLOCATED, NON_INFORMATIVE)
EXCLUDED = (UNLOCATED, NON_INFORMATIVE)

# Words in a treatment type that mean surgery, and sites that name no organ.
SURGERY_WORDS = (
    "surgery", "hysterectomy", "resection", "colectomy", "orchiectomy", "mastectomy", "prostatectomy",
    "nephrectomy", "gastrectomy", "lobectomy", "excision", "amputation", "cystectomy", "hepatectomy",
    "pancreatectomy", "thyroidectomy",
)
EMPTY_SITES = ("", "not reported", "unknown", "not applicable", "none")
INFINITY = float("inf")


def word(c: Column) -> Column:
    return F.coalesce(F.lower(trimmed(c.cast("string"))), F.lit(""))


def _day(x: float) -> Column:
    return F.lit(float(x))


def located(t_lo: Column, t_hi: Column) -> Column:
    """(t_lo, t_hi, status) of an interval; an unlocated one has no bounds."""
    lo, hi = t_lo.cast("double"), t_hi.cast("double")
    status = (
        F.when(lo.isNull() & hi.isNull(), UNLOCATED)
        .when(lo.isNull() | hi.isNull() | (hi == INFINITY), LO_ONLY)
        .when(lo == hi, POINT)
        .otherwise(BOUNDED)
    )
    return F.struct(lo.alias("t_lo"), hi.alias("t_hi"), status.alias("status"))


def nowhere(status: str = UNLOCATED) -> Column:
    none = F.lit(None).cast("double")
    return F.struct(none.alias("t_lo"), none.alias("t_hi"), F.lit(status).alias("status"))


def upper(th1: Column | None = None) -> Column:
    """Upper bound chain: own evidence, first follow-up at or after the asked day, last known contact."""
    return F.coalesce(*([th1] if th1 is not None else []), "next_day", "th2")


# ---- case context ---------------------------------------------------------
def is_surgery(kind: Column) -> Column:
    out = F.lit(False)
    for token in SURGERY_WORDS:
        out = out | word(kind).contains(token)
    return out


def is_negative(therapy: Column) -> Column:
    return word(therapy) == "no"


def is_prior(flag: Column, classification: Column) -> Column:
    return (word(flag) == "false") | (word(classification) == "prior primary")


_ANCHORS = ("residual_disease", "ajcc_pathologic_t", "ajcc_pathologic_n", "ajcc_pathologic_m", "ajcc_pathologic_stage")


def _anchored(diagnoses: DataFrame) -> Column:
    out = F.lit(False)
    for name in _ANCHORS:
        if name in diagnoses.columns:
            out = out | has_text(F.col(name))
    return out


def treatment_facts(treatments: DataFrame) -> DataFrame:
    """One row per diagnosis: what its treatments say about timing."""
    start, end = F.col("days_to_treatment_start"), F.col("days_to_treatment_end")
    labelled = (word(F.col("treatment_intent_type")) == "adjuvant") | (word(F.col("timepoint_category")) == "postoperative")
    surgery = is_surgery(F.col("treatment_type")) & ~is_negative(F.col("treatment_or_therapy"))
    return treatments.groupBy("dx_pos", "patient_id", "dataset").agg(
        F.max(surgery).alias("resected"),
        F.max(F.greatest(start, end)).alias("tx_last"),
        F.min(start).alias("tx_first"),
        F.min(F.when(labelled, start)).alias("adjuvant_first"),
        F.max(labelled).alias("adjuvant_seen"),
        F.min(F.when(surgery, start)).alias("surgery_first"),
    )


def diagnosis_facts(f: Families) -> DataFrame:
    """Diagnoses with prior flag and pathology class P1 / P2 / P3."""
    facts = f.diagnoses.join(treatment_facts(f.treatments), ["dx_pos", "patient_id", "dataset"], "left")
    anchored = _anchored(f.diagnoses)
    biopsy = word(F.col("method_of_diagnosis")) == "biopsy"
    organ = ~word(F.col("site_of_resection_or_biopsy")).isin(*EMPTY_SITES)
    evidence = anchored | F.coalesce("resected", F.lit(False))
    return facts.withColumns({
        "is_prior": is_prior(F.col("diagnosis_is_primary_disease"), F.col("classification_of_tumor")),
        "evidence": evidence,
        "path_class": F.when(biopsy & evidence, "P2").when(~biopsy & anchored & organ, "P1").otherwise("P3"),
    })


def case_context(facts: DataFrame, follow_ups: DataFrame) -> DataFrame:
    """One row per patient: last contact, adjuvant start, surgery day and number of different follow-up days."""
    own, malignant = ~F.col("is_prior"), word(F.col("prior_malignancy")) == "yes"
    rank = F.when(F.col("path_class") == "P1", 0).when(F.col("path_class") == "P2", 1).otherwise(2)
    dx = facts.groupBy("patient_id", "dataset").agg(
        F.max("days_to_last_follow_up").alias("dx_last"),
        F.max("days_to_last_known_disease_status").alias("status_last"),
        F.max("days_to_recurrence").alias("recurrence_last"),
        F.max("tx_last").alias("tx_last"),
        F.min("tx_first").alias("tx_first"),
        F.min("adjuvant_first").alias("_labelled"),
        F.max("adjuvant_seen").alias("_seen"),
        F.min("surgery_first").alias("surgery_first"),
        F.max("evidence").alias("resection_evidence"),
        F.max(own).alias("_own"),
        F.max(own & malignant).alias("_own_yes"),
        F.max(malignant).alias("_any_yes"),
        # own before prior ones, then by class: a number, so that patients are counted by hash
        F.min(F.when(own, 0).otherwise(3) + rank).alias("_class"),
    )
    fu = follow_ups.where(~F.col("is_shell")).groupBy("patient_id", "dataset").agg(
        F.count_distinct("days_to_follow_up").alias("n_follow_days"), F.max("days_to_follow_up").alias("follow_last")
    )
    any_fu = follow_ups.groupBy("patient_id", "dataset").agg(F.max("days_to_follow_up").alias("fu_last"))
    joined = dx.join(fu.join(any_fu, ["patient_id", "dataset"], "full"), ["patient_id", "dataset"], "full")
    last = F.coalesce("dx_last", "fu_last")
    return joined.select(
        "dataset", "patient_id",
        last.alias("last_follow_up"),
        F.when(F.col("dx_last").isNotNull(), "diagnoses.days_to_last_follow_up")
        .when(F.col("fu_last").isNotNull(), "follow_ups.days_to_follow_up").otherwise("").alias("last_follow_up_source"),
        F.greatest(last, "status_last", "recurrence_last", "tx_last", "follow_last").alias("th2"),
        F.coalesce("_labelled", F.when(F.col("_seen"), F.col("tx_first"))).alias("adjuvant_start"),
        "tx_first", "surgery_first",
        F.coalesce("resection_evidence", F.lit(False)).alias("resection_evidence"),
        F.when(F.col("_own"), F.col("_own_yes")).otherwise(F.coalesce("_any_yes", F.lit(False))).alias("prior_malignancy_case"),
        F.when(F.col("_class") % 3 == 0, "P1").when(F.col("_class") % 3 == 1, "P2").when(F.col("_class") % 3 == 2, "P3").alias("main_class"),
        F.coalesce("n_follow_days", F.lit(0)).alias("n_follow_days"),
    )


# ---- intervals ------------------------------------------------------------
def diagnosis_interval() -> Column:
    day = F.col("days_to_diagnosis")
    return (
        F.when(F.col("is_prior") & F.col("prior_malignancy_case"), located(_day(0), _day(0)))
        .when(day.isNull(), nowhere())
        .when(day == 0, located(_day(0), _day(0)))
        .otherwise(located(day, upper()))
    )


def treatment_interval() -> Column:
    early = word(F.col("timepoint_category")) == "prior to diagnosis"
    t_lo = treatment_day()
    return (
        F.when(F.col("is_prior") & F.col("prior_malignancy_case"), located(_day(0), _day(0)))
        .when(early & (word(F.col("prior_treatment")) == "yes"), located(_day(0), _day(0)))
        .when(early | t_lo.isNull(), nowhere())
        .otherwise(located(t_lo, upper()))
    )


def pathology_interval() -> Column:
    day = F.col("days_to_diagnosis")
    th1 = F.when(F.col("resection_evidence"), F.col("adjuvant_start"))
    return (
        F.when(F.col("is_prior") & F.col("prior_malignancy_case"), located(_day(0), _day(0)))
        .when((F.col("path_class") == "P3") | day.isNull(), nowhere())
        .when(F.col("path_class") == "P1", located(day, F.least(day, th1)))
        .otherwise(located(day, upper(th1)))
    )


def follow_up_interval() -> Column:
    day = F.col("days_to_follow_up")
    return (
        F.when(day.isNotNull(), located(day, day))
        .when(F.col("has_content"), nowhere())
        .otherwise(nowhere(NON_INFORMATIVE))
    )


def treatment_day() -> Column:
    return F.coalesce("days_to_treatment_end", "days_to_treatment_start")


def after_surgery() -> Column:
    """Lower bound of a postoperative test."""
    return F.when(F.coalesce(F.col("main_class") == "P2", F.lit(False)), F.col("surgery_first")).otherwise(_day(0))


def other_day() -> Column:
    return F.coalesce("days_to_comorbidity", "days_to_risk_factor")


def molecular_interval() -> Column:
    day, when_ = F.col("days_to_test"), word(F.col("timepoint_category"))
    first_class = F.col("main_class") == "P1"
    open_lo = _day(-INFINITY)
    surgery, start, after = F.col("surgery_first"), F.col("tx_first"), after_surgery()
    return (
        F.when(day.isNotNull(), located(day, upper()))
        .when(when_ == "initial diagnosis", located(open_lo, _day(0)))
        .when(when_.isin("sample procurement", "preoperative") & first_class, located(open_lo, _day(0)))
        .when((when_ == "preoperative") & surgery.isNotNull(), located(open_lo, surgery))
        .when((when_ == "prior to treatment") & start.isNotNull(), located(open_lo, start))
        .when((when_ == "postoperative") & after.isNotNull(), located(after, upper()))
        .otherwise(nowhere())
    )


def other_interval() -> Column:
    day = other_day()
    early = word(F.col("timepoint_category")).isin("initial diagnosis", "prior to diagnosis")
    return (
        F.when(day < 0, located(_day(0), _day(0)))
        .when(day.isNotNull(), located(day, upper()))
        .when(early, located(_day(0), _day(0)))
        .otherwise(nowhere())
    )


def timed(f: Families, facts: DataFrame | None = None, context: DataFrame | None = None) -> Families:
    """The families with ``t_lo``, ``t_hi``, ``status`` and ``slotted`` on every timed object.

    Six families read the same context, so it is written once: one row per
    diagnosis and one per patient.  Tables are placed when first used.
    """
    # joins and windows sort by their keys in this order: those that tell rows apart come first
    who, child = ["patient_id", "dataset"], ["dx_pos", "patient_id", "dataset"]

    @cache
    def context_table() -> DataFrame:
        return context if context is not None else checkpointed(case_context(facts_table(), f.follow_ups))

    @cache
    def facts_table() -> DataFrame:
        return facts if facts is not None else checkpointed(diagnosis_facts(f))

    def days() -> DataFrame:
        return f.follow_ups.where(~F.col("is_shell")).select(*who, "days_to_follow_up")

    def told(rows: DataFrame, by: list[str], day: Column, context: DataFrame, ask: Column | None = None) -> DataFrame:
        """The rows with the context of ``by`` and the first follow-up at or after ``ask``.

        ``ask`` is the row's own ``day`` unless the context decides it.  Rows
        move twice, to their context and to their patient; nothing is built
        from them to be joined back.
        """
        asked = rows.join(context, by).withColumn("_ask", ask if ask is not None else day.cast("double"))
        return next_at_or_after(asked, days(), who, "_ask", "days_to_follow_up", "next_day", measured=rows).drop("_ask")

    def placed() -> DataFrame:
        context = context_table().select(*who, "prior_malignancy_case", "resection_evidence", "adjuvant_start", "th2")
        return told(facts_table(), who, F.col("days_to_diagnosis"), context)

    def parent() -> DataFrame:
        return placed().select(
            *child, "is_prior", "path_class", "days_to_diagnosis", "prior_malignancy_case", "resection_evidence",
            "adjuvant_start", "th2", "next_day",
        )

    def treated() -> DataFrame:
        own = facts_table().join(context_table().select(*who, "prior_malignancy_case", "th2"), who)
        own = own.select(*child, "is_prior", "prior_treatment", "prior_malignancy_case", "th2")
        return told(f.treatments, child, treatment_day(), own)

    def own_context() -> DataFrame:
        return context_table().select(*who, "th2", "main_class", "tx_first", "surgery_first")

    def place(df: DataFrame, original: DataFrame, interval: Column, slotted: Column) -> DataFrame:
        return (
            df.withColumn("_i", F.when(slotted, interval))
            .withColumn("slotted", slotted)
            .select(*original.columns, "_i.t_lo", "_i.t_hi", "_i.status", "slotted")
        )

    yes = F.lit(True)
    return f.with_tables({
        "diagnoses": lambda: place(placed(), f.diagnoses, diagnosis_interval(), yes),
        "diagnoses_treatments": lambda: place(
            treated(), f.treatments, treatment_interval(), ~is_negative(F.col("treatment_or_therapy")),
        ),
        "diagnoses_pathology_details": lambda: place(
            f.pathology_details.join(parent(), child), f.pathology_details, pathology_interval(), yes
        ),
        "follow_ups": lambda: place(f.follow_ups, f.follow_ups, follow_up_interval(), ~F.col("is_shell")),
        "follow_ups_molecular_tests": lambda: place(
            told(f.molecular_tests, who, F.col("days_to_test"), own_context(), F.coalesce(F.col("days_to_test").cast("double"), after_surgery())),
            f.molecular_tests, molecular_interval(), yes,
        ),
        "follow_ups_other_clinical_attributes": lambda: place(
            told(f.other_attributes, who, other_day(), context_table().select(*who, "th2")),
            f.other_attributes, other_interval(), yes,
        ),
    })


# ---- slots ----------------------------------------------------------------
def slots(t: Families, rows: int | None = None, families: Iterable[str] = TIMED) -> DataFrame:
    """Numbered slots of all timed objects, in document order per patient and family.

    Families are numbered apart: of ``families`` alone the slots are the same.
    """
    parts = None
    for family in families:
        df = t.table(family).where("slotted")
        if "updated_at" not in df.columns:
            df = df.withColumn("updated_at", F.lit(None).cast("timestamp"))
        part = df.select(
            "dataset", "patient_id", F.lit(family).alias("family"), "pos", "t_lo", "t_hi", "status",
            record_days().alias("record_days"), F.col("updated_at").alias("write_at"),
        )
        parts = part if parts is None else parts.unionByName(part)
    return ordered_columns(parts, ["dataset", "patient_id", "family"], ["pos"], {"slot": ("row",)}, rows)


def record_days() -> Column:
    return F.when(~F.col("status").isin(*EXCLUDED) & (F.col("t_hi") != INFINITY), F.col("t_hi"))


def slot_coverage(s: DataFrame, kind: str = "record") -> DataFrame:
    """Per family and slot number: present, covered, excluded and status counts."""
    has_time = F.col("write_at").isNotNull() if kind == "write" else F.col("record_days").isNotNull()
    agg = s.groupBy("family", "slot").agg(
        F.count(F.lit(1)).alias("present"),
        F.count_if(has_time).alias("covered"),
        *[F.count_if(F.col("status") == status).alias(status) for status in STATUSES],
    )
    return agg.select(
        "family", "slot", "covered", "present", (F.col("present") - F.col("covered")).alias("excluded"),
        F.concat_ws("/", F.col("covered").cast("string"), F.col("present").cast("string")).alias("ratio"), *STATUSES,
    )


def slot_cells(s: DataFrame, family: str, value: str = "record_days", label: str = "record") -> DataFrame:
    """The wide slot table in long form: (dataset, patient_id, column, value), one row per slot of a family."""
    name = F.concat(F.lit(f"{family}_{label}"), F.col("slot").cast("string"))
    return s.where(F.col("family") == family).select("dataset", "patient_id", name.alias("column"), F.col(value).alias("value"))


def wide_slots(s: DataFrame, family: str, value: str = "record_days", label: str = "record") -> DataFrame:
    """One row per patient, one column per slot number of a family.

    The slot numbers are listed from the data first: a table this wide can only
    be written when the longest case fits a row, as in the document it came from.
    """
    own = s.where(F.col("family") == family)
    widest = own.agg(F.max("slot")).first()[0] or 0
    names = [f"{family}_{label}{i}" for i in range(1, widest + 1)]
    tagged = own.withColumn("_c", F.concat(F.lit(f"{family}_{label}"), F.col("slot").cast("string")))
    return tagged.groupBy("dataset", "patient_id").pivot("_c", names).agg(F.first(value))


def endpoints(patients: DataFrame, context: DataFrame) -> DataFrame:
    """Survival endpoint per patient: dead patients by death day, others by last follow-up."""
    dead, alive = word(F.col("vital_status")) == "dead", word(F.col("vital_status")) == "alive"
    joined = patients.join(context, ["dataset", "patient_id"], "left")
    last = F.col("last_follow_up")
    source = F.coalesce(F.nullif("last_follow_up_source", F.lit("")), F.lit("diagnoses.days_to_last_follow_up"))
    return joined.select(
        "dataset", "patient_id", "vital_status",
        F.when(dead, 1).when(alive, 0).alias("event"),
        F.when(dead, F.col("days_to_death")).otherwise(last).alias("ground_truth_time"),
        F.when(dead, "demographic.days_to_death").otherwise(source).alias("ground_truth_source"),
        last.alias("days_to_last_follow_up"), "days_to_death",
    )


def year_of_diagnosis(diagnoses: DataFrame) -> DataFrame:
    """Earliest year among primary-flagged diagnoses, else among all."""
    main = (word(F.col("diagnosis_is_primary_disease")) == "true") | (word(F.col("classification_of_tumor")) == "primary")
    year = F.col("year_of_diagnosis").cast("int")
    return diagnoses.groupBy("dataset", "patient_id").agg(
        F.coalesce(F.min(F.when(main, year)), F.min(year)).alias("year_of_diagnosis")
    )


def days_between(start: Column, end: Column) -> Column:
    """Days between two timestamps, with microseconds."""
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return seconds.cast("double") / 86_400.0


def parse_time(text: Column) -> Column:
    """ISO text with or without offset as a UTC timestamp without zone."""
    plain = stripped(text)
    zoned = plain.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    at = F.try_to_timestamp(plain)
    return F.when(zoned, F.to_utc_timestamp(at, F.current_timezone()).cast("timestamp_ntz")).otherwise(
        plain.try_cast("timestamp_ntz")
    )


def normalized_times(s: DataFrame, ends: DataFrame, kind: str = "record") -> DataFrame:
    """Slot times as a share of the last known day; write times count from the patient's first."""
    dead = word(F.col("vital_status")) == "dead"
    last = F.when(dead, F.col("days_to_death")).otherwise(F.col("days_to_last_follow_up"))
    lasts = ends.select("dataset", "patient_id", last.alias("last_time_days"))
    if kind == "record":
        timed_slots, days = s.where("record_days is not null"), F.col("record_days")
    else:
        first = s.where("write_at is not null").groupBy("dataset", "patient_id").agg(F.min("write_at").alias("_first"))
        timed_slots = s.where("write_at is not null").join(first, ["dataset", "patient_id"])
        days = days_between(F.col("_first"), F.col("write_at"))
    joined = timed_slots.join(lasts, ["dataset", "patient_id"])
    share = F.when(F.col("last_time_days") != 0, F.round(days / F.col("last_time_days"), 6) + F.lit(0.0))
    return joined.select("dataset", "patient_id", "family", "slot", "last_time_days", share.alias("share"))


# ---- audits ---------------------------------------------------------------
# Legal anchors of the time axis; the first is the expected one.
ANCHORS = (
    "Diagnosis", "First Patient Visit", "First Treatment", "Initial Genomic Sequencing",
    "Recurrence", "Sample Procurement", "Study Enrollment",
)


def index_date_audit(f: Families, day0_ratio: float = 0.2) -> DataFrame:
    """Per dataset: counts of every anchor, missing kinds, day-0 consistency and flags."""
    dx = f.diagnoses.select("dataset", "patient_id", "diagnosis_is_primary_disease", "days_to_diagnosis")
    primary, day = word(F.col("diagnosis_is_primary_disease")) == "true", F.col("days_to_diagnosis")
    per = dx.groupBy("dataset", "patient_id").agg(
        F.count_if(primary & day.isNull()).alias("m"), F.count_if(primary & (day == 0)).alias("z"),
        F.count_if(primary & (day != 0)).alias("nz"),
    )
    value = F.nullif(stripped(F.col("index_date")), F.lit(""))
    anchored = value == ANCHORS[0]
    joined = f.patients.withColumn("_v", value).join(per, ["dataset", "patient_id"], "left")
    content = F.col("m").isNotNull() | F.col("vital_status").isNotNull()
    agg = joined.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_cases"),
        *[F.count_if(F.col("_v") == a).alias(a) for a in ANCHORS],
        F.count_if(F.col("_v").isNull() & ~content).alias("missing_key_empty_shell"),
        F.count_if(F.col("_v").isNull() & content).alias("missing_key_clinical_content"),
        F.count_if(F.col("_v").isNotNull() & ~F.col("_v").isin(*ANCHORS)).alias("unexpected"),
        *[F.sum(F.when(F.col("_v") == ANCHORS[0], F.coalesce(c, F.lit(0))).otherwise(0)).alias(n)
          for c, n in (("z", "primary_dtd_zero"), ("nz", "primary_dtd_nonzero"), ("m", "primary_dtd_missing"))],
    )
    kinds = sum((F.when(F.col(a) > 0, 1).otherwise(0) for a in ANCHORS), F.lit(0))
    others = sum((F.col(a) for a in ANCHORS[1:]), F.lit(0)) + F.col("unexpected")
    placed = F.col("primary_dtd_zero") + F.col("primary_dtd_nonzero")
    flags = F.concat_ws(
        ", ",
        F.when(kinds > 1, "mixed_index_date"),
        F.when(others > 0, "non_diagnosis_index_date"),
        F.when(F.col("missing_key_clinical_content") > 0, "index_date_missing_clinical"),
        F.when((placed > 0) & (F.try_divide("primary_dtd_nonzero", placed) >= day0_ratio), "day0_not_primary"),
    )
    return agg.withColumn("flags", flags)


def index_date_flagged(f: Families) -> DataFrame:
    """Cases whose anchor is missing although they have content, or is not the expected one."""
    value = F.nullif(stripped(F.col("index_date")), F.lit(""))
    n_dx = f.diagnoses.groupBy("dataset", "patient_id").agg(F.count(F.lit(1)).alias("n_diagnoses"))
    joined = f.patients.join(n_dx, ["dataset", "patient_id"], "left")
    content = F.col("n_diagnoses").isNotNull() | F.col("vital_status").isNotNull()
    flag = F.when(value.isNull() & content, "index_date_missing_clinical").when(
        value != ANCHORS[0], "non_diagnosis_index_date"
    )
    return joined.select(
        "dataset", "patient_id", F.coalesce(value, F.lit("")).alias("index_date"),
        F.coalesce("n_diagnoses", F.lit(0)).alias("n_diagnoses"), flag.alias("flag"),
    ).where("flag is not null")


def gt_category(event: Column, time: Column) -> Column:
    return (
        F.when(time < 0, "negative").when((time == 0) & event.isNull(), "unknown_0")
        .when((time == 0) & (event == 1), "event_0").when(time == 0, "censored_0")
    )


def event_table(ends: DataFrame) -> DataFrame:
    """Patient events with the category of patients at or before day 0."""
    event = F.col("event").cast("string").try_cast("int")
    return ends.withColumn("event", event).withColumn("category", gt_category(F.col("event"), F.col("ground_truth_time")))


def event_summary(ends: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per dataset: events, censored, unknown, rate, missing times and the day-0 pits."""
    e, t = F.col("event"), F.col("ground_truth_time")
    n_event, n_censored = F.count_if(e == 1), F.count_if(e == 0)
    out = ends.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_patients"), n_event.alias("n_event"), n_censored.alias("n_censored"),
        F.count_if(e.isNull()).alias("n_unknown"),
        F.count_if((e == 1) & t.isNull()).alias("n_event_no_time"),
        F.count_if((e == 0) & t.isNull()).alias("n_censored_no_time"),
        F.count_if(t <= 0).alias("n_gt_le_0"), F.count_if(t < 0).alias("n_gt_lt_0"),
        F.count_if((e == 1) & (t == 0)).alias("n_event_gt_0"),
        F.count_if((e == 0) & (t == 0)).alias("n_censored_gt_0"),
        F.count_if(e.isNull() & (t == 0)).alias("n_unknown_gt_0"),
    ).withColumn("event_rate", F.round(F.try_divide("n_event", F.col("n_event") + F.col("n_censored")), 4))
    if labels is not None:
        out = out.join(label_events(labels), "dataset", "left")
    return out


def label_events(labels: DataFrame) -> DataFrame:
    """Label patients, events (censorship 0) and censored per dataset."""
    return labels.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_label_patients"),
        F.count_if(F.col("censorship") == 0).alias("n_event_label"),
        F.count_if(F.col("censorship") == 1).alias("n_censored_label"),
    )


def label_gate(labels: DataFrame) -> DataFrame:
    """Day-0 and negative survival times left in the labels."""
    m, c = F.col("survival_months"), F.col("censorship")
    return labels.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_patients"), F.count_if(m <= 0).alias("n_gt_le_0"),
        F.count_if(m < 0).alias("n_gt_lt_0"), F.count_if((c == 0) & (m == 0)).alias("n_event_0"),
        F.count_if((c == 1) & (m == 0)).alias("n_censored_0"), F.count_if(m.isNull()).alias("n_no_time"),
    )


def main_set(labels: DataFrame, min_events: int = 100) -> DataFrame:
    """Datasets with enough label events, most events first."""
    return label_events(labels).where(F.col("n_event_label") >= min_events).orderBy(F.desc("n_event_label"), "dataset")
