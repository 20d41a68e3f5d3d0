"""Field paths: parsing, timed families and value extraction from documents."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Timed families and the path of their objects.
FAMILY_PATHS = {
    "diagnoses": "diagnoses[]",
    "diagnoses_treatments": "diagnoses[].treatments[]",
    "diagnoses_pathology_details": "diagnoses[].pathology_details[]",
    "follow_ups": "follow_ups[]",
    "follow_ups_molecular_tests": "follow_ups[].molecular_tests[]",
    "follow_ups_other_clinical_attributes": "follow_ups[].other_clinical_attributes[]",
}


@dataclass(frozen=True)
class Step:
    key: str
    is_array: bool


def parse_path(path: str) -> list[Step]:
    steps = []
    for token in path.split(".") if path else []:
        array = token.endswith("[]")
        steps.append(Step(token[:-2] if array else token, array))
    return steps


def timed_family(path: Column) -> Column:
    """Timed family of a field path by longest matching prefix, null for untimed fields."""
    out = F.lit(None).cast("string")
    for family, prefix in sorted(FAMILY_PATHS.items(), key=lambda kv: len(kv[1])):
        out = F.when((path == prefix) | path.startswith(prefix + "."), family).otherwise(out)
    return out


def array_of(value: Column, path: str = "$") -> Column:
    """The array under a path, null when there is something else or nothing."""
    return F.try_variant_get(value, F.lit(path), "array<variant>")


def object_of(value: Column, path: str = "$") -> Column:
    """The object under a path as a map of its keys, null when there is something else or nothing."""
    return F.try_variant_get(value, F.lit(path), "map<string,variant>")


def kind_of_schema(schema: Column) -> Column:
    """JSON kind from the schema text of a VARIANT value."""
    return (
        F.when(schema.isNull() | (schema == "VOID"), "null")
        .when(schema == "STRING", "string")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("ARRAY"), "array")
        .when(schema.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def path_values(cases: DataFrame, paths: list[str], doc: str = "doc", keep: list[str] = ()) -> DataFrame:
    """Long table of every value under the given paths.

    Paths are grouped by their array steps, so siblings share one walk.  A
    missing key gives no row, a present null gives a row of kind ``null``; an
    array step over something that is not an array gives nothing.
    """
    groups: dict[tuple[str, ...], list[tuple[str, list[str]]]] = {}
    for path in paths:
        steps = parse_path(path)
        arrays, walked = [], []
        last = 0
        for i, step in enumerate(steps):
            walked.append(step.key)
            if step.is_array:
                arrays.append(".".join(walked))
                walked = []
                last = i + 1
        groups.setdefault(tuple(arrays), []).append((path, [s.key for s in steps[last:]]))
    out = None
    for arrays, leaves in groups.items():
        carried = [f"_k_{k}" for k in keep]
        node = cases.select(
            *[F.col(k).alias(f"_k_{k}") for k in keep], F.col(doc).alias("_node"), F.array().cast("array<int>").alias("path_pos")
        )
        for keys in arrays:
            # anything but an array gives null here, and null explodes to nothing
            node = node.select(*carried, "path_pos", F.posexplode(array_of(F.col("_node"), "$." + keys)).alias("_p", "_node")).select(
                *carried, F.concat("path_pos", F.array("_p")).alias("path_pos"), "_node"
            )
        # leaves first, their schemas next: each is worked out once
        leaf_values = {
            f"_v{i}": F.try_variant_get("_node", F.lit("$." + ".".join(keys)), "variant") if keys else F.coalesce("_node", F.parse_json(F.lit("null")))
            for i, (_, keys) in enumerate(leaves)
        }
        read = node.select(*carried, "path_pos", *[v.alias(n) for n, v in leaf_values.items()])
        read = read.select(*carried, "path_pos", *leaf_values, *[F.schema_of_variant(n).alias(f"_s{n}") for n in leaf_values])
        cells = []
        for i, (path, _) in enumerate(leaves):
            value, schema = F.col(f"_v{i}"), F.col(f"_s_v{i}")
            text = F.when(schema == "STRING", value.cast("string")).when(schema != "VOID", F.to_json(value))
            cells.append(
                F.when(
                    value.isNotNull(),
                    F.struct(F.lit(path).alias("field_path"), text.alias("value"), kind_of_schema(schema).alias("kind")),
                )
            )
        part = (
            read.select(*carried, "path_pos", F.explode(F.array_compact(F.array(*cells))).alias("_c"))
            .select(*[F.col(f"_k_{k}").alias(k) for k in keep], "path_pos", "_c.*")
        )
        out = part if out is None else out.unionByName(part)
    return out
