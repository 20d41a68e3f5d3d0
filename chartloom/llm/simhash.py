"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at a Hamming distance of at most ``radius``.  Bits
that go together across the corpus are put next to each other, the bits are cut
into partitions, and each partition i gets a threshold t_i (-1: not probed) with
sum(t_i + 1) = radius + 1, so linked fingerprints are within t_i in some
partition i.  Cuts and thresholds come from one dynamic program that minimises
probes plus expected candidates, estimated from the value histograms of blocks
of bits over all fingerprints.

A partition of threshold t is probed through its values with every choice of t
bits blanked, which both sides of a pair share.  Fingerprints that share a probe
are candidates.  Small buckets are compared in place and give a link from each
fingerprint to one before it, never all pairs.  In a bucket above ``BUCKET``
every fingerprint gives its balls instead of pairs: two fingerprints are within r of
each other exactly if a wide ball (radius ceil(r/2)) around one and a narrow
ball (radius floor(r/2)) around the other share a centre.  A centre is met by
few fingerprints, so hot buckets cost in proportion to their fingerprints.  Components are then joined by the smallest
document id in rounds of large-star and small-star steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import fresh, saved, table

RADIUS, SHINGLE, SEED, BITS = 2, 3, 42, 64
#: fingerprints compared pair by pair inside one bucket
BUCKET = 128
#: bits of a block whose values are counted for the estimates
BLOCK = 4
#: cost of one probe row against one compared candidate
PROBE_COST = 8.0


def _simhash(text: str, hash64) -> int:
    # on bytes, lower() and split() know A-Z and the six ASCII spaces only
    found = text.encode().lower().split()
    if not found:
        return 0
    n = max(1, len(found) - SHINGLE + 1)
    counts = np.zeros(BITS, "int64")
    for start in range(0, n, 65_536):
        stop = min(n, start + 65_536)
        part = found[start:stop + SHINGLE - 1]
        if len(part) >= SHINGLE:
            hashes = [hash64(b" ".join(x), SEED) for x in zip(part, part[1:], part[2:])]
        else:
            hashes = [hash64(b" ".join(part), SEED)]
        bits = np.unpackbits(np.array(hashes, "<u8").view("u1").reshape(len(hashes), 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype="int64")
    on = counts * 2 > n
    return int(np.packbits(on, bitorder="little").view("<i8")[0])


def simhash(df: DataFrame, text: str = "text", name: str = "fingerprint", keep: list[str] | None = None) -> DataFrame:
    """The columns in ``keep`` (all by default) and the 64-bit fingerprint as a long; 0 for texts without words.

    A-Z count as a-z; a text of fewer than three words is one shingle.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != name]
    (source,) = [text] if text in kept else fresh(df, "simhash_text")
    given = df.select(*kept, *([] if text in kept else [F.col(text).alias(source)]))
    schema = df.select(*kept, F.lit(0).cast("long").alias(name)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            values = [_simhash(x.as_py() or "", xxhash.xxh64_intdigest) for x in batch.column(source)]
            yield pa.RecordBatch.from_arrays(
                [*batch.select(kept).columns, pa.array(values, pa.int64())], names=[*kept, name]
            )

    return given.mapInArrow(run, schema)


# ---------------------------------------------------------------- partitions and thresholds


def _bit_matrix(values: np.ndarray) -> np.ndarray:
    return np.unpackbits(values.view("u1").reshape(-1, 8), axis=1, bitorder="little")


def _summed(df: DataFrame, size: int, count) -> np.ndarray:
    """Sum over all rows of what ``count`` makes of a batch of fingerprints: ``size`` numbers from each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, "int64")
        for batch in batches:
            if batch.num_rows:
                total += count(batch.column(0).to_numpy(zero_copy_only=False))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("int32")), pa.array(total[at])], names=["i", "v"])

    rows = df.mapInArrow(run, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(size, "int64")
    for r in rows:
        out[r["i"]] = r["v"]
    return out


def bit_order(fps: DataFrame) -> list[int]:
    """All bits, each put after the one not yet placed that goes with it most (by correlation over all fingerprints)."""

    def together(values: np.ndarray) -> np.ndarray:
        bits = _bit_matrix(values).astype("float64")
        return np.concatenate([(bits.T @ bits).astype("int64").ravel(), [len(bits)]])

    found = _summed(fps, BITS * BITS + 1, together)
    n = max(1, int(found[-1]))
    both = found[:-1].reshape(BITS, BITS) / n
    mean = np.diag(both)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    corr = np.abs((both - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(corr, -1)
    order = [int(np.unravel_index(corr.argmax(), corr.shape)[0])]
    while len(order) < BITS:
        rest = [b for b in range(BITS) if b not in order]
        order.append(max(rest, key=lambda b: (corr[order[-1], b], -b)))
    return order


def distance_shares(fps: DataFrame, order: list[int]) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each block of bits the share of pairs at distance 0, 1, ... in it."""
    blocks = BITS // BLOCK
    weights = (1 << np.arange(BLOCK)).astype("int64")

    def histogram(values: np.ndarray) -> np.ndarray:
        bits = _bit_matrix(values)[:, order].reshape(-1, blocks, BLOCK).astype("int64") @ weights
        at = bits + np.arange(blocks) * (1 << BLOCK)
        return np.bincount(at.ravel(), minlength=blocks << BLOCK)

    found = _summed(fps, blocks << BLOCK, histogram).reshape(blocks, 1 << BLOCK)
    n = int(found[0].sum())
    share = found / max(1, n)
    apart = np.array([[bin(a ^ b).count("1") for b in range(1 << BLOCK)] for a in range(1 << BLOCK)])
    out = np.zeros((blocks, BLOCK + 1))
    for b in range(blocks):
        pairs = np.outer(share[b], share[b])
        out[b] = [pairs[apart == d].sum() for d in range(BLOCK + 1)]
    return n, out


def allocate(n: int, shares: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int, int]]:
    """(first bit, end bit, threshold) of the probed partitions, cheapest by probes and expected candidates."""
    blocks = len(shares)
    within: dict[tuple[int, int], np.ndarray] = {}
    for a in range(blocks):
        dist = np.array([1.0])
        for b in range(a + 1, blocks + 1):
            dist = np.convolve(dist, shares[b - 1])
            within[a, b] = np.cumsum(dist)
    best: dict[tuple[int, int], tuple[float, list]] = {(blocks, 0): (0.0, [])}
    for a in range(blocks - 1, -1, -1):
        for left in range(radius + 2):
            options = []
            for b in range(a + 1, blocks + 1):
                width = (b - a) * BLOCK
                for t in range(-1, min(left, radius + 1)):
                    rest = best.get((b, left - t - 1))
                    if rest is None:
                        continue
                    cost = 0.0 if t < 0 else PROBE_COST * n * comb(width, t) + n * (n - 1) / 2 * within[a, b][min(t, width)]
                    part = [] if t < 0 else [(a * BLOCK, b * BLOCK, t)]
                    options.append((cost + rest[0], part + rest[1]))
            if options:
                best[a, left] = min(options)
    return best[0, radius + 1][1]


# ---------------------------------------------------------------- probes and links


def _masks(order: list[int], parts: list[tuple[int, int, int]]) -> list[int]:
    """One 64-bit mask for each probe of a fingerprint: the partition's bits without the blanked ones."""
    out = []
    for a, b, t in parts:
        bits = [order[i] for i in range(a, b)]
        for blank in combinations(bits, t):
            out.append(sum(1 << x for x in bits if x not in blank))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _balls(radius: int) -> list[tuple[int, bool]]:
    """Differences of a fingerprint to the centres of its wide ball, and whether each is in its narrow ball too."""
    wide, narrow = (radius + 1) // 2, radius // 2
    return [(_signed(sum(1 << b for b in c)), r <= narrow) for r in range(wide + 1) for c in combinations(range(BITS), r)]


def _bucket_links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = [], []
            for members in batch.column(0):
                x = np.sort(np.array(members.as_py(), "int64")).view("uint64")
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
                for i in range(1, len(x)):
                    for j in np.flatnonzero(near[i, :i]):
                        left.append(int(x[j].view("int64")))
                        right.append(int(x[i].view("int64")))
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of fingerprints within ``radius``.

    ``fps`` has different longs in its only column and is read several times.
    The radius is the same in buckets of every size.
    """
    schema = "a long, b long"
    (name,) = fps.columns
    order = bit_order(fps)
    n, shares = distance_shares(fps, order)
    spark = fps.sparkSession
    if n < 2:
        return spark.createDataFrame([], schema)
    masks = _masks(order, allocate(n, shares, radius))
    probe = F.array(*[
        F.struct(F.lit(i).alias("p"), F.col(name).bitwiseAND(F.lit(_signed(m))).alias("k")) for i, m in enumerate(masks)
    ])
    at = ["p", "k"]
    probes = fps.select(F.explode(probe).alias("s"), F.col(name).alias("x")).select("s.p", "s.k", "x")
    sizes = saved(probes.groupBy(*at).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    small = sizes.where(F.col("n") <= bucket).select(*at)
    large = sizes.where(F.col("n") > bucket).select(*at)
    # a bucket's list is bounded by its counted size
    lists = probes.join(small, at).groupBy(*at).agg(F.collect_list("x").alias("x")).select("x")
    links = lists.mapInArrow(_bucket_links(radius), schema)
    if large.limit(1).count():
        crowded = saved(probes.join(large, at, "left_semi").select("x").distinct())
        around = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(narrow).alias("narrow")) for d, narrow in _balls(radius)])
        balls = crowded.select("x", F.explode(around).alias("s")).select(
            "x", F.col("s.d").bitwiseXOR(F.col("x")).alias("c"), F.col("s.narrow").alias("narrow")
        )
        # few fingerprints meet a centre: at most one for each difference
        met = balls.groupBy("c").agg(F.min(F.when(F.col("narrow"), F.col("x"))).alias("a"), F.collect_set("x").alias("xs"))
        star = met.where(F.col("a").isNotNull() & (F.size("xs") > 1)).select("a", F.explode("xs").alias("b")).where("a <> b")
        links = links.unionByName(star)
    return links


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): the root is the smallest node of its component.

    Large-star and small-star rounds, each over a table written to the shared
    folder; stops when a round changes nothing.
    """
    edges = saved(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    before = None
    while True:
        # large star: every larger neighbour goes to the node's smallest neighbour (itself included)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        # small star: a node and its smaller neighbours go to the smallest of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        moved = large.join(low, "b")
        small = moved.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a <> b").unionByName(
            low.select(F.col("m").alias("a"), "b")
        ).distinct()
        edges = saved(small)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or state[0] == 0:
            break
        before = state
    return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(
        edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct()
    )


def near_duplicates(df: DataFrame, text: str = "text", id_: str = "doc_id", radius: int = RADIUS) -> DataFrame:
    """Every row's id, ``fingerprint`` (long), ``group`` (its smallest fingerprint) and ``component_id``.

    ``component_id`` is the smallest id of the rows whose fingerprints can be
    reached over links, null only if all their ids are null.  Null and empty
    texts have fingerprint 0 and link like any other.  Repeated rows share a
    fingerprint.  Only id and text are used, so other columns may have any
    name; an empty table gives an empty result.
    """
    given = df.select(F.col(id_).alias("_id"), F.col(text).alias("_text"))
    rows = saved(simhash(given, "_text", "_fp", keep=["_id"]))
    classes = saved(rows.groupBy("_fp").agg(F.min("_id").alias("_first")))
    tree = saved(components(fingerprint_links(classes.select("_fp"), radius)))
    # only fingerprints with links take part in this grouping
    linked = tree.join(classes, F.col("node") == F.col("_fp")).select("node", "root", "_first")
    firsts = linked.groupBy("root").agg(F.min("_first").alias("_least"))
    named = linked.join(firsts, "root").select(F.col("node"), F.col("root"), F.col("_least"))
    known = classes.join(named, F.col("_fp") == F.col("node"), "left").select(
        F.col("_fp").alias("_key"),
        F.coalesce("root", "_fp").alias("group"),
        F.when(F.col("node").isNotNull(), F.col("_least")).otherwise(F.col("_first")).alias("component_id"),
    )
    return rows.join(known, F.col("_fp") == F.col("_key")).select(
        F.col("_id").alias(id_), F.col("_fp").alias("fingerprint"), "group", "component_id"
    )


def op8_simhash(spark, folder: str) -> DataFrame:
    """Fingerprint and group of every document."""
    found = near_duplicates(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
