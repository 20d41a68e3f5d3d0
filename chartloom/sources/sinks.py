"""Table maintenance: upserts, merges, fingerprints and pruning."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scale import checkpointed


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Replace every existing row whose key appears in the incoming rows; columns are united by name."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming, allowMissingColumns=True)


def merged(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows replaced by incoming ones with their key, others appended; ``change`` tells which."""
    values = [c for c in existing.columns if c not in keys]
    old = existing.select(*keys, F.struct(*values).alias("_o"))
    new = incoming.select(*keys, F.struct(*values).alias("_n"))
    j = old.join(new, keys, "full")
    change = F.when(F.col("_n").isNull(), "kept").when(F.col("_o").isNull(), "appended").otherwise("replaced")
    return j.select(*keys, F.coalesce("_n", "_o").alias("_v"), change.alias("change")).select(*keys, "_v.*", "change")


def first_written(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Existing rows stay; only unseen keys are added."""
    return existing.unionByName(incoming.join(existing, keys, "left_anti"), allowMissingColumns=True)


def missing_parts(expected: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys without any found row."""
    return expected.join(found.select(*keys).distinct(), keys, "left_anti")


def collected(parts: dict[tuple, DataFrame], key_names: list[str]) -> DataFrame:
    """Result tables stacked with their key columns added in front."""
    out = None
    for key, df in parts.items():
        tagged = df.select(*[F.lit(v).alias(n) for n, v in zip(key_names, key)], *df.columns)
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def fingerprint(text: Column) -> Column:
    """First sixteen hex digits of the sha-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def fields_fingerprint(fields: Column) -> Column:
    return fingerprint(F.array_join(fields, ","))


def stale_banks(planned: DataFrame, manifest: DataFrame, keys: list[str]) -> DataFrame:
    """Planned banks to rebuild: unseen ones and those whose template or field fingerprint changed."""
    same = ["template_fp", "fields_fp"]
    return planned.join(manifest.select(*keys, *same), [*keys, *same], "left_anti")


def pruned(outputs: DataFrame, plan: DataFrame, keys: list[str], protected: str = r"^G1_[0-9a-f]{10}$", name: str = "scheme") -> DataFrame:
    """Outputs inside the plan or with a protected name."""
    inside = outputs.join(plan.select(*keys).distinct(), keys, "left_semi")
    spared = outputs.join(plan.select(*keys).distinct(), keys, "left_anti").where(F.col(name).rlike(protected))
    return inside.unionByName(spared)


# ---- keyed tables ---------------------------------------------------------------
# A keyed table is a folder of part folders and manifests.  A manifest lists the part folders that are the table;
# the newest whole one (written by Spark's committer, its success mark last) holds, so a rewrite shows at once or not at all.
_SLOT = "_slot"


def _slot(partition: str) -> Column:
    """Name of a part folder: the partition's value as a fingerprint, as values may hold any characters."""
    return F.coalesce(fingerprint(F.col(partition).cast("string")), F.lit("null")).alias(_SLOT)


def _files(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _versions(spark: SparkSession, path: str) -> tuple[int, int]:
    """Numbers of the newest whole manifest and of the newest one begun; 0 where there is none."""
    place, system = _files(spark, f"{path}/manifests")
    if not system.exists(place):
        return 0, 0
    begun = {int(f.getPath().getName()): f"{f.getPath()}/_SUCCESS" for f in system.listStatus(place)}
    whole = [n for n, mark in begun.items() if system.exists(_files(spark, mark)[0])]
    return max(whole, default=0), max(begun, default=0)


def _manifest(spark: SparkSession, path: str, version: int | None = None) -> dict[str, str]:
    """Part folders by slot: one entry a partition."""
    version = _versions(spark, path)[0] if version is None else version
    if not version:
        return {}
    return {r[_SLOT]: r["folder"] for r in spark.read.schema(f"{_SLOT} string, folder string").json(f"{path}/manifests/{version}").collect()}


def _parts(spark: SparkSession, path: str, manifest: dict[str, str]) -> DataFrame:
    return spark.read.option("mergeSchema", True).parquet(*[f"{path}/{folder}" for _, folder in sorted(manifest.items())])


def read_keyed(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of a keyed table; None where nothing was written yet or no row is left."""
    manifest = _manifest(spark, path)
    return _parts(spark, path, manifest) if manifest else None


def replace_keys(spark: SparkSession, path: str, incoming: DataFrame, keys: list[str], partition: str) -> None:
    """Upsert into a keyed table: a key's old rows go, whatever partition they are in; columns are united by name.

    Null keys are keys like any other; several incoming rows of a key all stay.
    Rewritten are the partitions of the incoming rows and those that held one
    of their keys; a partition without rows leaves the table.  Part folders that
    the manifest no longer names stay on disk for readers that began before.
    Of two writers that began from one manifest one fails: its number is taken,
    or the newest manifest isn't the one it began from.
    """
    version, begun = _versions(spark, path)
    manifest = _manifest(spark, path, version)
    incoming = checkpointed(incoming)
    touched = {r[_SLOT] for r in incoming.select(_slot(partition)).distinct().collect()}
    new = incoming
    if manifest:
        # a key is looked up in all partitions, by its columns alone
        old = _parts(spark, path, manifest)
        wanted = incoming.select(*[F.col(k).alias(f"_k_{k}") for k in keys]).distinct()
        same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys])
        touched |= {r[_SLOT] for r in old.select(*{*keys, partition}).join(wanted, same, "left_semi").select(_slot(partition)).distinct().collect()}
        rewritten = {s: f for s, f in manifest.items() if s in touched}
        if rewritten:
            new = _parts(spark, path, rewritten).join(wanted, same, "left_anti").unionByName(incoming, allowMissingColumns=True)
    if not touched:
        return
    folder = f"parts/{uuid.uuid4().hex}"
    new = checkpointed(new.withColumn(_SLOT, _slot(partition)))
    new.repartition(_SLOT).write.mode("errorifexists").partitionBy(_SLOT).parquet(f"{path}/{folder}")
    now = {s: f for s, f in manifest.items() if s not in touched}
    now |= {r[_SLOT]: f"{folder}/{_SLOT}={r[_SLOT]}" for r in new.select(_SLOT).distinct().collect()}
    rows = spark.createDataFrame(sorted(now.items()), f"{_SLOT} string, folder string")
    if _versions(spark, path)[0] != version:
        raise RuntimeError(f"other writer: {path}")
    rows.coalesce(1).write.mode("errorifexists").json(f"{path}/manifests/{begun + 1}")
    if _versions(spark, path)[0] != begun + 1:
        raise RuntimeError(f"other writer: {path}")


def write_banks(spark: SparkSession, path: str, planned: DataFrame, build, keys: list[str], partition: str) -> DataFrame:
    """Build and write the planned banks whose template or field fingerprint isn't the written one; returns those built.

    ``build`` makes the bank rows, with keys and both fingerprints, from the
    planned rows that are stale; banks that are up to date are not read.
    """
    old = read_keyed(spark, path)
    stale = checkpointed(planned if old is None else stale_banks(planned, old.select(*keys, "template_fp", "fields_fp").distinct(), keys))
    if not stale.isEmpty():
        replace_keys(spark, path, build(stale), keys, partition)
    return stale
