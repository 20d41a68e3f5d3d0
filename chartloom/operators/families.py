"""Case families: one table per kind of clinical sub-record.

Every table has ``patient_id``, ``dataset`` and ``pos``, the place of the object
in the case document; children also carry their parent's ``dx_pos`` or
``fu_pos``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import FAMILY_PATHS

TIMED = tuple(FAMILY_PATHS)
PREFIXES = {"patients": "demographic.", "exposures": "exposures[].", **{f: p + "." for f, p in FAMILY_PATHS.items()}}


class Families:
    """Named family tables; a table may be given as a function and is then built on first use."""

    NAMES = (
        "patients", "diagnoses", "treatments", "pathology_details", "follow_ups", "molecular_tests",
        "other_attributes", "exposures",
    )

    def __init__(self, **tables: DataFrame | Callable[[], DataFrame]):
        self._tables = {"exposures": None, **tables}

    def __getattr__(self, name: str):
        tables = self.__dict__.get("_tables", {})
        if name not in tables:
            raise AttributeError(name)
        if callable(tables[name]):
            tables[name] = tables[name]()
        return tables[name]

    def table(self, family: str) -> DataFrame:
        return getattr(self, _ATTRIBUTE.get(family, family))

    def with_tables(self, tables: dict[str, DataFrame | Callable[[], DataFrame]]) -> Families:
        return Families(**{**self._tables, **{_ATTRIBUTE.get(k, k): v for k, v in tables.items()}})

    def mapped(self, names, change: Callable[[str, DataFrame], DataFrame]) -> Families:
        """The same families with ``change(family, table)`` applied lazily to the named ones."""
        return self.with_tables({n: (lambda n=n: change(n, self.table(n))) for n in names})


_ATTRIBUTE = {
    "diagnoses_treatments": "treatments",
    "diagnoses_pathology_details": "pathology_details",
    "follow_ups_molecular_tests": "molecular_tests",
    "follow_ups_other_clinical_attributes": "other_attributes",
}


def long_values(
    f: Families, fields: dict[str, dict[str, str]], timed: bool = False, keep: dict[str, str] | None = None
) -> DataFrame:
    """(dataset, patient_id, field_path, pos, value, number, kind): one row per raw value.

    Each family is scanned once and all its fields come out of one explode.
    Numbers travel as doubles, other kinds as text.  ``timed`` keeps the time
    location of the object that holds the value; ``keep`` (name to type) carries
    further columns of tables that have them.
    """
    out = None
    for family, names in fields.items():
        df = f.table(family)
        in_time = family in TIMED
        pos = F.col("pos") if "pos" in df.columns else F.array(F.lit(0).cast("long"))
        cells = []
        for name, kind in names.items():
            numeric = kind == "number"
            cells.append(
                F.struct(
                    F.lit(PREFIXES[family] + name).alias("field_path"),
                    (F.lit(None) if numeric else F.col(name)).cast("string").alias("value"),
                    (F.col(name) if numeric else F.lit(None)).cast("double").alias("number"),
                    F.when(F.col(name).isNull(), "null").otherwise(kind).alias("kind"),
                )
            )
        extra = []
        if timed:
            place = {"t_hi": "double", "status": "string", "slotted": "boolean"}
            extra = [(F.col(c) if in_time else F.lit(None)).cast(t).alias(c) for c, t in place.items()]
            extra.append(F.lit(family if in_time else None).cast("string").alias("family"))
        extra += [(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in (keep or {}).items()]
        part = df.select("dataset", "patient_id", pos.alias("pos"), *extra, F.explode(F.array(*cells)).alias("_c"))
        kept = [c for c in part.columns if c != "_c"]
        part = part.select(*kept, "_c.*")
        out = part if out is None else out.unionByName(part)
    return out


def primary_order(prefix: str = "") -> Column:
    """Sort key of the primary diagnosis: earliest day, missing days last, flag, document order."""
    days, flag = F.col(prefix + "days_to_diagnosis"), F.col(prefix + "diagnosis_is_primary_disease")
    return F.struct(
        days.isNull().alias("undated"),
        days.alias("days"),
        (F.lower(F.coalesce(flag.cast("string"), F.lit(""))) != "true").alias("other"),
        F.col(prefix + "pos").alias("pos"),
    )


def primary_diagnosis(diagnoses: DataFrame, columns: list[str]) -> DataFrame:
    """One row per patient with the chosen diagnosis columns of the primary diagnosis."""
    row = F.struct(*[F.col(c) for c in columns])
    return (
        diagnoses.groupBy("dataset", "patient_id")
        .agg(F.min_by(row, primary_order()).alias("_d"))
        .select("dataset", "patient_id", "_d.*")
    )
