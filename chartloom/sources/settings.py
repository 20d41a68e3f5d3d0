"""Alias, scheme and template spec files as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.missing import stripped
from ..functions.numbers import CONVERTERS
from ..functions.text import template_problem

# Tokens of a binding that mean all TCGA datasets, sources of schemes, names that are no schemes, spec columns.
ALL_TOKENS = ("all_tcga", "tcga")
SOURCES = ("gdc",)
RESERVED = ("FIELD_BANK",)
NEEDED = ("template_file", "prompt_file", "dirname", "fields")
SPEC_COLUMNS = ("field", "convert", "unit", "template", "note")

_MEMBERS, _LIST = "map<string,string>", "array<string>"


def _checked(value: Column, *faults: tuple[Column, Column]) -> Column:
    """The value, or a failed job with the text of the first fault that holds."""
    out = value
    for bad, said in reversed(faults):
        out = F.when(bad, F.raise_error(said).cast("string")).otherwise(out)
    return out


def _said(text: str, *parts: Column) -> Column:
    return F.concat(F.lit(text), *[F.coalesce(p, F.lit("")) for p in parts])


def _texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of whole small files."""
    name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(name.alias("path"), F.col("value").alias("text"))


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


# ---- value aliases ------------------------------------------------------------
def alias_rules(texts: DataFrame) -> DataFrame:
    """(field_path, key, canonical) of alias files: ``{"aliases": {field: {"map": {key: canonical}}}}`` in ``text``.

    Keys count as they stand, so one that isn't in lower case with single
    spaces never applies.  Files without the section have no rules; a text that
    is no JSON object fails the job.
    """
    members = F.from_json("text", _MEMBERS, {"mode": "FAILFAST"})
    fields = texts.select(F.explode(F.from_json(members["aliases"], _MEMBERS)).alias("field_path", "rule"))
    maps = fields.select("field_path", F.from_json("rule", _MEMBERS)["map"].alias("map"))
    return maps.select("field_path", F.explode(F.from_json("map", _MEMBERS)).alias("key", "canonical"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """Rules of an alias file, or of all files of a folder."""
    return alias_rules(_texts(spark, path))


# ---- schemes --------------------------------------------------------------------
def listed_schemes(texts: DataFrame) -> DataFrame:
    """(scheme, fields, datasets) from (scheme, text), the text a scheme's JSON object.

    ``datasets`` is null for a scheme that holds everywhere, else the names and
    tokens it is bound to.  Missing, empty or repeated fields and an unknown
    source fail the job; reserved names are left out.
    """
    part = F.from_json("text", _MEMBERS)
    named = texts.where(~F.col("scheme").isin(*RESERVED)).select(
        "scheme", F.from_json(part["fields"], _LIST).alias("fields"), part["datasets"].alias("_bound"), part["source"].alias("_source")
    )
    bound = F.col("_bound")
    names = F.transform(F.when(bound.startswith("["), F.from_json(bound, _LIST)).otherwise(F.array(bound)), stripped)
    good = F.array_distinct(F.filter(names, lambda x: x != ""))
    size = F.coalesce(F.size("fields"), F.lit(0))
    scheme = _checked(
        F.col("scheme"),
        (size <= 0, _said("scheme without fields: ", F.col("scheme"))),
        (F.size(F.array_distinct("fields")) < size, _said("scheme with repeated fields: ", F.col("scheme"))),
        (~F.lower(stripped(F.coalesce("_source", F.lit("")))).isin(*SOURCES), _said("scheme with an unknown source: ", F.col("scheme"))),
    )
    return named.select(scheme.alias("scheme"), "fields", F.when(bound.isNotNull(), good).alias("datasets"))


def read_schemes(spark: SparkSession, folder: str) -> DataFrame:
    """Schemes of a folder: ``schemes.json``, else ``custom_schemes.json``, else none.

    The file either lists names under ``_schemes``, each with a ``fields.json`` in
    the folder of its name, or holds the schemes themselves.
    """
    found = [f"{folder}/{n}" for n in ("schemes.json", "custom_schemes.json") if _exists(spark, f"{folder}/{n}")]
    if not found:
        return listed_schemes(spark.createDataFrame([], "scheme string, text string"))
    members = F.from_json("text", _MEMBERS, {"mode": "FAILFAST"})
    top = _texts(spark, found[0]).select(members.alias("m"))
    if top.where(F.map_contains_key("m", "_schemes")).count():
        names = top.select(F.explode(F.from_json(F.col("m")["_schemes"], _LIST)).alias("scheme")).distinct()
        own = spark.read.text(f"{folder}/*/fields.json", wholetext=True) if _exists_any(spark, f"{folder}/*/fields.json") else None
        if own is None:
            own = spark.createDataFrame([], "scheme string, text string")
        else:
            name = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
            own = own.select(F.regexp_extract(name, r"([^/]+)/fields\.json$", 1).alias("scheme"), F.col("value").alias("text"))
        return listed_schemes(names.join(own, "scheme", "left"))
    each = top.select(F.explode("m").alias("scheme", "text")).where(~F.col("scheme").startswith("_"))
    lacking = F.array_except(F.array(*[F.lit(n) for n in NEEDED]), F.map_keys(F.from_json("text", _MEMBERS)))
    fault = (~F.col("scheme").isin(*RESERVED) & (F.size(lacking) > 0), _said("scheme lacks parts: ", F.col("scheme"), F.array_join(lacking, ",")))
    return listed_schemes(each.select(_checked(F.col("scheme"), fault).alias("scheme"), "text"))


def _exists_any(spark: SparkSession, pattern: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def scheme_fields(schemes: DataFrame) -> DataFrame:
    """(scheme, ord, field) in the order of the files, from 0."""
    return schemes.select("scheme", F.posexplode("fields").alias("ord", "field"))


def scheme_datasets(schemes: DataFrame, datasets: DataFrame, aliases: DataFrame | None = None, tcga: str = r"(?i)^TCGA[-_]") -> DataFrame:
    """(scheme, dataset) over the registered datasets.

    Free schemes hold on all of them, a binding that is nothing but the token on
    all whose name fits ``tcga``, others on the datasets of their names or
    aliases (alias, dataset).
    """
    alone = lambda x: F.lower(x).isin(*ALL_TOKENS)
    names = F.col("datasets")
    every = (F.size(names) > 0) & F.forall(names, alone)
    keys = (
        F.when(names.isNull(), F.array(F.struct(F.lit("any").alias("kind"), F.lit("").alias("key"))))
        .when(every, F.array(F.struct(F.lit("tcga").alias("kind"), F.lit("").alias("key"))))
        .otherwise(F.transform(names, lambda x: F.struct(F.lit("name").alias("kind"), x.alias("key"))))
    )
    asked = schemes.select("scheme", F.inline(keys))
    own = F.array(
        F.struct(F.lit("name").alias("kind"), F.col("dataset").alias("key")),
        F.struct(F.lit("any").alias("kind"), F.lit("").alias("key")),
        F.struct(F.when(F.col("dataset").rlike(tcga), "tcga").alias("kind"), F.lit("").alias("key")),
    )
    known = datasets.select("dataset").distinct().select("dataset", F.inline(own)).where("kind is not null")
    if aliases is not None:
        known = known.unionByName(
            aliases.join(datasets.select("dataset").distinct(), "dataset").select("dataset", F.lit("name").alias("kind"), F.col("alias").alias("key"))
        )
    return asked.join(known, ["kind", "key"]).select("scheme", "dataset").distinct()


# ---- template spec ----------------------------------------------------------------
def _clean(name: str) -> Column:
    text = stripped(F.coalesce(F.col(name), F.lit("")))
    return F.when(F.lower(text).isin("nan", "none"), "").otherwise(text)


def read_spec(spark: SparkSession, path: str) -> DataFrame:
    """(field, convert, unit, template, note) of a template spec CSV.

    A missing column is an error at once; a row without a field, an unknown
    converter, a template that doesn't hold one ``{}`` and end with a period and
    a repeated field fail the job.
    """
    given = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')
    missing = [c for c in SPEC_COLUMNS if c not in given.columns]
    if missing:
        raise ValueError(f"spec lacks columns {missing}: {path}")
    rows = given.select(*[_clean(c).alias(c) for c in SPEC_COLUMNS])
    counted = rows.groupBy("field").agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*SPEC_COLUMNS[1:])).alias("_r"))
    field = _checked(
        F.col("field"),
        (F.col("field") == "", F.lit("spec row without a field")),
        (F.col("_n") > 1, _said("spec field repeated: ", F.col("field"))),
        (~F.lower("_r.convert").isin(*CONVERTERS), _said("unknown converter of ", F.col("field"))),
        (template_problem(F.col("_r.template")).isNotNull(), _said("template of ", F.col("field"), F.lit(" "), template_problem(F.col("_r.template")))),
    )
    return counted.select(field.alias("field"), "_r.*")
