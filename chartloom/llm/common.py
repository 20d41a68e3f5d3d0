"""Small column and table helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.scale import shared_folder

#: the characters that separate words
SPACE = "\\x20\\x09-\\x0D"


def table(spark, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def saved(df: DataFrame) -> DataFrame:
    """The table written once to the shared folder and read back: lineage ends here, and the rows stay as they are."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_saved(spark) -> None:
    """Delete what ``saved`` wrote in this application; call it when the results are written."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/llm-{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The batch function, which at its end hands freed memory back to the system.

    Workers outlive a task and wait beside the next one; without this they keep
    the room of the largest task that they ran, in Arrow's pool and in malloc's.
    """

    @functools.wraps(run)
    def leaner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
        if trim:
            trim(0)

    return leaner


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value worked out once, also when the body uses it inside lambdas."""
    return F.transform(F.array(value), body)[0]


def whole(text: Column) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """Runs of characters other than space and U+0009 to U+000D; an empty array for null."""
    return F.array_remove(F.split(whole(text), f"[{SPACE}]+"), "")


def word_hashes(found: Column) -> Column:
    return F.transform(found, lambda w: F.xxhash64(w))


def _paired(hashes: Column, step: int) -> Column:
    """Hash of element i with element i + step, for each i that has both."""

    def pair(h: Column) -> Column:
        n = F.greatest(F.size(h) - step, F.lit(0))
        return F.zip_with(F.slice(h, 1, n), F.slice(h, step + 1, n), lambda a, b: F.xxhash64(a, b))

    return let(hashes, pair)


def shingle_hashes(hashes: Column, width: int) -> Column:
    """One 64-bit hash for each window of ``width`` word hashes (empty with fewer words).

    Windows double in width, so a window costs one pass for each bit of its width.
    """
    span, out = 1, hashes
    while span * 2 <= width:
        out = _paired(out, span)
        span *= 2
    return out if span == width else _paired(out, width - span)


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Names for intermediate columns that the table doesn't have (case aside)."""
    have = {c.lower() for c in df.columns}
    out = []
    for stem in stems:
        name = f"_{stem}"
        while name.lower() in have:
            name = f"_{name}"
        have.add(name.lower())
        out.append(name)
    return out


def position_in(splits: Iterable[Column], key: Column, strict: bool = False) -> Column:
    """How many of the ascending ``splits`` are at or below ``key`` (below it, if strict), by binary search."""
    splits = list(splits)
    n = len(splits)
    if n == 0:
        return F.lit(0)
    held = F.array(*splits)
    steps = F.array(*[F.lit(0)] * (n.bit_length() + 1))

    def narrow(array: Column, want: Column) -> Column:
        start = F.struct(F.lit(0).alias("lo"), F.lit(n).alias("hi"))

        def step(at: Column, _: Column) -> Column:
            mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
            done = at["lo"] >= at["hi"]
            right = F.get(array, mid) < want if strict else F.get(array, mid) <= want
            return F.struct(
                F.when(done, at["lo"]).when(right, mid + 1).otherwise(at["lo"]).alias("lo"),
                F.when(done, at["hi"]).when(right, at["hi"]).otherwise(mid).alias("hi"),
            )

        return F.aggregate(steps, start, step)["lo"]

    return let(held, lambda a: let(key, lambda k: narrow(a, k)))


def ordered_splits(df: DataFrame, key: str, pieces: int) -> list[int]:
    """At most ``pieces - 1`` values of a long key, all of them in the table, that cut its rows into about equal parts.

    A part holds the keys above one value and up to the next.
    """
    if pieces < 2:
        return []
    shares = [i / pieces for i in range(1, pieces)]
    found = df.agg(F.percentile_approx(key, shares, max(10_000, 20 * pieces)).alias("q")).first()["q"]
    about = [F.lit(x).cast("long") for x in sorted(set(found or []))]
    # the sketch works on doubles; the parts' largest keys are exact
    tops = df.groupBy(position_in(about, F.col(key), strict=True).alias("part")).agg(F.max(key).alias("top")).collect()
    return sorted(r["top"] for r in tops)[:-1]
