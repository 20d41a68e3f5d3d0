"""Patients times fields into numbers: tokens, vocabularies, scaled and one-hot cells, vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.missing import is_missing_token, stripped
from ..functions.numbers import DAYS_PER_YEAR, convert_by, to_number
from ..functions.text import (
    MISSING, ORDINAL_ENCODERS, OTHER, array_median, canonical_nominal, classified_type, entity, leaf, ordinal_code,
    token_numbers,
)
from ..scale import checkpointed, exact_quantiles, ordered_columns
from .stats import inferred_type, stage_vocabulary, value_text

CELL = ["dataset", "patient_id", "field_path"]


# ---- tokens and per-patient values -----------------------------------------
def tokens(used: DataFrame, converts: DataFrame | None = None) -> DataFrame:
    """Converted, non-missing tokens of the used raw values; ``converts`` has (field_path, convert)."""
    text = value_text(F.col("value"), F.col("number"))
    rows = used.select(*CELL, "pos", text.alias("_t"))
    if converts is not None:
        # one row per converted field
        rows = rows.join(F.broadcast(converts.select("field_path", "convert")), "field_path", "left")
        token = convert_by(F.col("_t"), F.col("convert"))
    else:
        token = F.col("_t")
    return rows.select(*CELL, "pos", stripped(token).alias("token")).where(~is_missing_token(F.col("token")))


def is_age_in_days(path: Column) -> Column:
    return leaf(path) == "age_at_diagnosis"


def token_number(path: Column, token: Column) -> Column:
    x = to_number(token)
    return F.when(is_age_in_days(path) & (x > 365), x / DAYS_PER_YEAR).otherwise(x)


def patient_numbers(t: DataFrame, rows: int | None = None) -> DataFrame:
    """Median number of every patient's field."""
    numbers = t.select(*CELL, token_number(F.col("field_path"), F.col("token")).alias("x")).where("x is not null")
    return exact_quantiles(numbers, CELL, "x", {"x": 0.5}, rows)


def patient_categories(t: DataFrame) -> DataFrame:
    """Sorted distinct lower-case tokens of every patient's field, joined."""
    # a patient's repeats leave as they are; only different tokens are spelled out
    listed = t.select(*CELL, "token").distinct().groupBy(*CELL).agg(F.collect_list("token").alias("_l"))
    words = F.transform("_l", lambda x: F.lower(stripped(F.regexp_replace(x, r"\s+", " "))))
    known = F.array_sort(F.array_distinct(F.filter(words, lambda w: ~is_missing_token(w))))
    return listed.select(*CELL, known.alias("_w")).where(F.size("_w") > 0).select(*CELL, F.array_join("_w", " | ").alias("category"))


# ---- typing -----------------------------------------------------------------
def field_types(t: DataFrame, fields: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Type per (dataset, field): from the dictionary when it decides, else from the tokens.

    ``dictionary`` has (entity, field, type).
    """
    named = fields.select("dataset", "field_path", entity(F.col("field_path")).alias("entity"), leaf(F.col("field_path")).alias("field"))
    typed = named.join(F.broadcast(dictionary), ["entity", "field"], "left")
    seen = t.groupBy("dataset", "field_path", F.col("token").alias("collapsed")).agg(F.count(F.lit(1)).alias("n"))
    share = seen.groupBy("dataset", "field_path").agg(
        (F.sum(F.when(to_number(F.col("collapsed")).isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("numeric_share"),
        F.count(F.lit(1)).alias("unique_count"),
    )
    on = ["dataset", "field_path"]
    joined = typed.join(share, on, "left").join(stage_vocabulary(seen), on, "left")
    inferred = inferred_type(F.col("numeric_share"), F.col("ordinal_stage"), F.col("unique_count"))
    known = classified_type(F.col("type"))
    return joined.select(
        *on, F.coalesce("type", F.lit("")).alias("gdc_type"),
        F.coalesce(known, F.when(inferred == "numeric", "continuous").otherwise("nominal")).alias("final_type"),
        F.when(known.isNotNull(), "gdc_dictionary").otherwise("infer_type").alias("source"),
    )


# ---- fits -------------------------------------------------------------------
def continuous_fit(numbers: DataFrame, keys: list[str], rows: int | None = None) -> DataFrame:
    """Min, max and median over the per-patient medians."""
    ends = numbers.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return ends.join(exact_quantiles(numbers, keys, "x", {"mid": 0.5}, rows), keys)


def vocabulary(categories: DataFrame, keys: list[str], threshold: int = 1) -> DataFrame:
    """(keys, category, idx): missing 0, other 1, kept categories in order from 2.

    One row per distinct kept category; the numbering runs over categories,
    not patients.
    """
    counts = checkpointed(categories.groupBy(*keys, "category").agg(F.count(F.lit(1)).alias("n")))
    often = counts.where(F.col("n") >= threshold)
    kept = ordered_columns(often, keys, ["category"], {"_r": ("row",)}).select(*keys, "category", (F.col("_r") + 1).alias("idx"))
    fields = counts.select(*keys).distinct()
    fixed = F.explode(F.array(
        F.struct(F.lit(MISSING).alias("category"), F.lit(0).cast("long").alias("idx")),
        F.struct(F.lit(OTHER).alias("category"), F.lit(1).cast("long").alias("idx")),
    ))
    return fields.select(*keys, fixed.alias("_f")).select(*keys, "_f.*").unionByName(kept)


def missing_vocabulary(vocab: DataFrame, fields: DataFrame) -> DataFrame:
    """Fields a stored vocabulary does not cover: must be empty before it is used."""
    return fields.select("field_path").distinct().join(vocab.select("field_path").distinct(), "field_path", "left_anti")


# ---- cells ------------------------------------------------------------------
def scaled(x: Column, lo: Column, hi: Column) -> Column:
    return F.when(hi <= lo, 0.0).otherwise((x - lo) / (hi - lo))


def encoded_cells(
    patients: DataFrame, types: DataFrame, numbers: DataFrame, categories: DataFrame, fit: DataFrame, vocab: DataFrame,
    vocab_keys: list[str],
) -> DataFrame:
    """(dataset, patient, field, kind, code, x, width): scaled number or category code for every cell."""
    every = patients.select("dataset", "patient_id").join(types.select("dataset", "field_path", "final_type"), "dataset")
    con = every.where("final_type = 'continuous'").join(numbers, CELL, "left").join(fit, ["dataset", "field_path"], "left")
    lo, hi, mid = (F.coalesce(c, F.lit(0.0)) for c in ("lo", "hi", "mid"))
    con = con.select(
        *CELL, F.lit("continuous").alias("kind"), F.lit(None).cast("long").alias("code"),
        scaled(F.coalesce("x", mid), lo, hi).alias("x"), F.lit(1).cast("long").alias("width"),
    )
    widths = vocab.groupBy(*vocab_keys).agg((F.max("idx") + 1).alias("width"))
    nom = every.where("final_type = 'nominal'").join(categories, CELL, "left")
    nom = nom.join(vocab, [*vocab_keys, "category"], "left").join(widths, vocab_keys, "left")
    code = F.when(F.col("category").isNull(), 0).otherwise(F.coalesce("idx", F.lit(1)))
    nom = nom.select(
        *CELL, F.lit("nominal").alias("kind"), code.cast("long").alias("code"), F.lit(None).cast("double").alias("x"),
        F.coalesce("width", F.lit(2)).cast("long").alias("width"),
    )
    return con.unionByName(nom)


def cell_vector(kind: Column, code: Column, x: Column, width: Column) -> Column:
    """The cell as an array: one number, or a one-hot of its width."""
    hot = F.transform(F.sequence(F.lit(0).cast("long"), width - 1), lambda i: F.when(i == code, 1.0).otherwise(0.0).cast("float"))
    return F.when(kind == "continuous", F.array(x.cast("float"))).otherwise(hot)


def feature_schema(types: DataFrame, vocab: DataFrame, keys: list[str], order: str = "field_path") -> DataFrame:
    """Width and start offset of every field of a dataset, in field order.

    One row per (dataset, field): the window sees a field list.
    """
    widths = vocab.groupBy(*keys).agg((F.max("idx") + 1).alias("_w"))
    joined = types.join(widths, keys, "left")
    width = F.when(F.col("final_type") == "continuous", 1).otherwise(F.coalesce("_w", F.lit(2))).cast("long")
    w = Window.partitionBy("dataset").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return joined.withColumn("width", width).select(
        "dataset", "field_path", "final_type", "width", (F.sum("width").over(w) - F.col("width")).alias("start")
    )


def vectors(cells: DataFrame, order: DataFrame) -> DataFrame:
    """One vector per patient: its cells in field order, as long as the field list is wide.

    ``order`` has (dataset, field_path, ord).
    """
    v = cells.join(order, ["dataset", "field_path"]).select(
        "dataset", "patient_id", F.struct("ord", cell_vector(F.col("kind"), F.col("code"), F.col("x"), F.col("width")).alias("v")).alias("c")
    )
    listed = F.flatten(F.transform(F.array_sort(F.collect_list("c")), lambda c: c["v"]))
    return v.groupBy("dataset", "patient_id").agg(listed.alias("vec"))


def bank_slice(bank: DataFrame, subset: list[int], tokens_per_field: int = 1) -> DataFrame:
    """Blocks of a field bank for a subset of field indices, in subset order; each field owns equal blocks."""
    place = F.map_from_arrays(F.array(*[F.lit(int(i)) for i in subset]), F.array(*[F.lit(k) for k in range(len(subset))]))
    owner = F.floor(F.col("token_idx") / tokens_per_field).cast("int")
    kept = bank.where(owner.isin(*[int(i) for i in subset]))
    return kept.withColumn("slice_idx", place[owner] * tokens_per_field + F.col("token_idx") % tokens_per_field)


# ---- scheme values: collapsed text ------------------------------------------
def scheme_number(path: Column, value: Column) -> Column:
    """Median of the numbers in a collapsed value, ages in days turned into years."""
    xs = token_numbers(value)
    days = path == "diagnoses[].age_at_diagnosis"
    years = F.transform(xs, lambda x: F.when(x > 365, x / DAYS_PER_YEAR).otherwise(x))
    return F.when(days, array_median(years)).otherwise(array_median(xs))


def scheme_categories(values: DataFrame) -> DataFrame:
    c = canonical_nominal(F.col("value"))
    return values.select(*CELL, c.alias("category")).where(F.col("category") != MISSING)


def node_values(values: DataFrame, kinds: dict[str, str], vocab: DataFrame) -> DataFrame:
    """Raw node number per (patient, field): value, ordinal code or category index; null when unobserved.

    Fields without a kind stay null, whatever their value.
    """
    path, value = F.col("field_path"), F.col("value")
    kind = F.lit("none")
    for field, k in kinds.items():
        kind = F.when(path == field, k).otherwise(kind)
    ordinal = F.lit(0)
    for field in ORDINAL_ENCODERS:
        if kinds.get(field) == "ordinal":
            ordinal = F.when(path == field, ordinal_code(field, value)).otherwise(ordinal)
    staged = values.withColumns({"kind": kind, "category": canonical_nominal(value), "_o": ordinal})
    joined = staged.join(vocab.select("field_path", "category", "idx"), ["field_path", "category"], "left")
    number = (
        F.when(F.col("kind") == "continuous", scheme_number(path, value))
        .when((F.col("kind") == "ordinal") & (F.col("_o") > 0), F.col("_o").cast("double"))
        .when((F.col("kind") == "nominal") & (F.col("category") != MISSING), F.coalesce("idx", F.lit(1)).cast("double"))
    )
    return joined.select(*CELL, number.alias("x"))


def symmetric_scaled(nodes: DataFrame, keys: list[str] = ("dataset", "field_path")) -> DataFrame:
    """Node numbers scaled to [-1, 1] per field; constants become 0 and unobserved cells stay null."""
    ends = nodes.groupBy(*keys).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    j = nodes.join(ends, list(keys))
    x = F.when(F.col("hi") == F.col("lo"), F.col("x") * 0.0).otherwise(
        (F.col("x") - (F.col("hi") + F.col("lo")) / 2.0) / (F.col("hi") - F.col("lo")) * 2.0
    )
    return j.select(*CELL, x.alias("x"))


def observed(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("dataset", "field_path").agg(
        F.count("x").alias("n_observed"), F.count_if(F.col("x").isNull()).alias("n_missing"),
        (100.0 * F.count("x") / F.count(F.lit(1))).alias("percent_observed"),
    )


def node_table(nodes: DataFrame, order: DataFrame) -> DataFrame:
    """Sparse diagonal: (patient, i, i, value) with 0 for unobserved cells."""
    return nodes.join(order, "field_path").select(
        "dataset", "patient_id", F.col("ord").alias("i"), F.col("ord").alias("j"), F.coalesce("x", F.lit(0.0)).alias("value")
    )


def scheme_edges(schemes: DataFrame) -> DataFrame:
    """Directed edges between all different fields of a scheme: (scheme, source, target).

    The result is the complete graph over a scheme's field list, built from its
    length.
    """
    n = schemes.groupBy("scheme").agg(F.count(F.lit(1)).alias("n"))
    span = lambda: F.sequence(F.lit(0).cast("long"), F.col("n") - 1)
    target = n.select("scheme", "n", F.explode(span()).alias("target"))
    return target.select("scheme", F.explode(span()).alias("source"), "target").where(F.col("source") != F.col("target"))


# ---- neighbours -------------------------------------------------------------
def neighbour_pairs(df: DataFrame, group: str, item: str, vector: str, n: int = 3, block: int = 2000, rows: int | None = None) -> DataFrame:
    """Pairs (a < b) where one is among the other's ``n`` most similar items of its group, by cosine.

    Items of a group meet block against block; a task holds two blocks and
    returns its best ``n`` per item, so pairs are never listed.
    """
    placed = ordered_columns(df.select(group, item, vector), [group], [item], {"_r": ("row",)}, rows)
    placed = placed.withColumn("b", F.floor((F.col("_r") - 1) / block).cast("long"))
    counts = placed.groupBy(group).agg(F.max("b").alias("last"))
    spread = placed.join(counts, group).withColumn("o", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    left = spread.select(group, F.col("b").alias("i"), F.col("o").alias("j"), item, vector)
    right = spread.select(
        F.col(group).alias("_g"), F.col("o").alias("_i"), F.col("b").alias("_j"), F.col(item).alias("_item"),
        F.col(vector).alias("_vector"),
    )
    types = dict(df.dtypes)
    schema = f"`{group}` {types[group]}, a {types[item]}, b {types[item]}, similarity double"

    def unit(values: pd.Series) -> np.ndarray:
        m = np.stack(values.to_numpy()).astype(float)
        size = np.linalg.norm(m, axis=1, keepdims=True)
        return np.divide(m, size, out=np.zeros_like(m), where=size > 0)

    def best(lp: pd.DataFrame, rp: pd.DataFrame) -> pd.DataFrame:
        if lp.empty or rp.empty:
            return pd.DataFrame({group: [], "a": [], "b": [], "similarity": []})
        lp, rp = lp.sort_values(item), rp.sort_values("_item")
        a, b = lp[item].to_numpy(), rp["_item"].to_numpy()
        s = np.clip(unit(lp[vector]) @ unit(rp["_vector"]).T, -1.0, 1.0)
        s[a[:, None] == b[None, :]] = -np.inf
        order = np.argsort(-s, axis=1, kind="stable")[:, :n]
        out = pd.DataFrame({
            group: lp[group].iloc[0], "a": np.repeat(a, order.shape[1]), "b": b[order].reshape(-1),
            "similarity": np.take_along_axis(s, order, 1).reshape(-1),
        })
        return out[np.isfinite(out["similarity"])]

    keys = [group, "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy("_g", "_i", "_j")).applyInPandas(best, schema)
    w = Window.partitionBy(group, "a").orderBy(F.desc("similarity"), "b")
    top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return top.select(group, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
