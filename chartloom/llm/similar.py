"""Near duplicates: every pair of texts whose five-word shingles have a likeness of 0.8 or more.

First the closest copies go together: SimHash prints over the shingles that are
linked at ``RADIUS`` bits (the generalised pigeonhole search of ``simhash``)
give groups, and each text of a group is checked against one of them.

All other candidates are exact (prefix filter).  Shingles are put in one order;
two sets of that likeness share a shingle among the first n - ceil(0.8 n) + 1 of
each, whichever words were edited, added or cut.  The order is rarest first by
counters over all texts: any order finds the same pairs, this one keeps common
shingles out of the prefixes.  Texts that share a prefix shingle form a bucket.  Two texts of sizes n and m that meet first at places p and q
share at most min(n - p, m - q) shingles; they are a pair only if that reaches
the ceil(0.8 / 1.8 (n + m)) that the likeness asks for.

Large groups are thinned without losing a link.  A text that is checked to be
alike to the hub of its bucket gets the hub as pivot and keeps its distance to
it (one minus likeness, a metric).  After ``ROUNDS`` rounds only pivots are
paired.  Texts of two pivots can be alike only if the pivots' distance is at
most 0.2 plus both texts' own distances; where it is, and the pivots are not
alike themselves or joined by others, they are open.  Open pivots are joined
in turns by a few of their texts (one stands for all at a like distance from their
pivot), as one link settles all texts of both sides.  Only for pivots that are still
apart after that all texts near enough are paired and checked.

Pairs are checked on sketches of the ``SKETCH`` smallest shingle hashes.  A
sketch only settles a pair whose likeness is far from the bound; all others are
decided on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import fresh, lean, saved, whole
from chartloom.llm.simhash import SEED, components, fingerprint_links

WIDTH, SIMILARITY, SKETCH = 5, 0.8, 512
#: counters of the shingle order, and how many go in one row
COUNTERS, PART = 1 << 22, 4096
#: the most that one counter says
MOST = (1 << 32) - 1
#: bits at which prints are linked, rounds of hubs, and the pivots in a block of a bucket
RADIUS, ROUNDS, BLOCK = 3, 2, 2000
#: turns in which open pivots are joined by a few texts, the most pairs of texts for two pivots in a turn, and
#: the distances from a pivot for which one text stands; they decide the cost, not the results
TURNS, TRIES, BAND = 2, 3, 0.04
#: distance from the bound at which a sketch settles a pair: for whole sets (equal 32-bit hashes) and
#: for estimates (more than four standard errors at the bound)
NEAR, FAR = 0.02, 0.08


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, hash64) -> np.ndarray:
    """Sorted 64-bit hashes of the different five-word shingles; A-Z count as a-z, fewer words are one shingle."""
    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, "u8")
    known = {w: hash64(w, SEED) for w in set(words)}
    order = np.fromiter(map(known.__getitem__, words), "u8", len(words))
    n = max(1, len(order) - WIDTH + 1)
    rolled = np.zeros(n, "u8")
    for i in range(min(WIDTH, len(order))):
        rolled = rolled * np.uint64(0x100000001B3) + order[i:i + n]
    return np.unique(_mixed(rolled))


def prefix(found: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The shingles of which any set of that likeness shares one in its own prefix; 0 for an empty set."""
    n = len(found)
    if not n:
        return np.zeros(1, "u8")
    order = np.lexsort((found, counts[found & np.uint64(COUNTERS - 1)]))
    return found[order[:n - ceil(similarity * n - 1e-9) + 1]]


def sketch(found: np.ndarray) -> bytes:
    return np.unique((found >> np.uint64(32)).astype("<u4"))[:SKETCH].tobytes()


def print_of(found: np.ndarray) -> int:
    """64-bit SimHash of a shingle set; 0 for an empty one."""
    if not len(found):
        return 0
    bits = np.unpackbits(found.astype("<u8").view("u1").reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype="u8")
    return int(np.packbits(2 * bits > len(found), bitorder="little").view("<i8")[0])


def sketch_likeness(a: bytes, b: bytes) -> float:
    """Jaccard likeness of two shingle sets by their sketches; two empty ones are alike."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    union = np.union1d(x, y)
    if len(x) >= SKETCH or len(y) >= SKETCH:
        union = union[:SKETCH]
        x, y = x[x <= union[-1]], y[y <= union[-1]]
    return len(np.intersect1d(x, y, assume_unique=True)) / len(union)


def shingle_counts(df: DataFrame, text: str) -> np.ndarray:
    """How many of the rows' texts have a shingle that falls on each counter, copies included; no more than 32 bits hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        total = np.zeros(COUNTERS, "u8")
        for batch in batches:
            for x in batch.column(text):
                np.add.at(total, shingle_set(x.as_py() or "", xxhash.xxh64_intdigest) & np.uint64(COUNTERS - 1), 1)
        parts = np.minimum(total, MOST).astype("<u4").reshape(-1, PART)
        for i in np.flatnonzero(parts.any(axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([parts[i].tobytes()], pa.binary())], names=["i", "v"])

    def added(group: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(v.as_py(), "<u4").astype("u8") for v in group.column("v"))
        return pa.table({"i": group.column("i")[:1], "v": pa.array([np.minimum(total, MOST).astype("<u4").tobytes()], pa.binary())})

    out = np.zeros((COUNTERS // PART, PART), "<u4")
    for r in df.select(text).mapInArrow(lean(run), "i int, v binary").groupBy("i").applyInArrow(added, "i int, v binary").collect():
        out[r["i"]] = np.frombuffer(r["v"], "<u4")
    return out.ravel()


def signatures(df: DataFrame, text: str, keep: list[str], counts: np.ndarray, similarity: float) -> DataFrame:
    """The columns in ``keep`` with the set's size ``n``, ``prefix``, ``sketch`` and ``print``; null texts count as empty."""
    schema = T.StructType([
        *[df.schema[c] for c in keep], T.StructField("n", T.LongType()), T.StructField("prefix", T.ArrayType(T.LongType())),
        T.StructField("sketch", T.BinaryType()), T.StructField("print", T.LongType()),
    ])
    known = df.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            n, first, small, prints = [], [], [], []
            for x in batch.column(text):
                found = shingle_set(x.as_py() or "", xxhash.xxh64_intdigest)
                n.append(len(found))
                first.append(prefix(found, known.value, similarity).view("i8"))
                small.append(sketch(found))
                prints.append(print_of(found))
            yield pa.RecordBatch.from_arrays(
                [*batch.select(keep).columns, pa.array(n, pa.int64()), pa.array(first, pa.list_(pa.int64())), pa.array(small, pa.binary()),
                 pa.array(prints, pa.int64())],
                names=[*keep, "n", "prefix", "sketch", "print"],
            )

    return df.select(*keep, text).mapInArrow(lean(run), schema)


def settled(a: bytes, b: bytes, least: float) -> tuple[float, float, bool | None]:
    """Lower and upper bound of two texts' likeness, and whether they are alike; None where only the whole sets can tell."""
    if not a or not b:
        same = float(a == b)
        return same, same, same >= least
    found = sketch_likeness(a, b)
    margin = FAR if max(len(a), len(b)) >= 4 * SKETCH else NEAR
    return found - margin, found + margin, None if abs(found - least) <= margin else found >= least


def _judged(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [settled(a.as_py(), b.as_py(), least) for a, b in zip(batch.column("sa"), batch.column("sb"))]
            low, high, alike = zip(*said) if said else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.select(["ia", "ib", "a", "b"]).columns, pa.array(low, pa.float64()), pa.array(high, pa.float64()), pa.array(alike, pa.bool_())],
                names=["ia", "ib", "a", "b", "low", "high", "alike"],
            )

    return run


def _compared(least: float):
    """Rows of one ``a`` come together, its own text first: the likeness of each other row's text to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        key, held = None, None
        for batch in batches:
            out = []
            columns = [batch.column(c).to_pylist() for c in ("_a", "_salt", "ia", "ib", "b")]
            for a, salt, ia, ib, b, text in zip(*columns, batch.column("text")):
                found = shingle_set(text.as_py() or "", xxhash.xxh64_intdigest)
                if b is None:
                    key, held = (a, salt), found
                    continue
                if key != (a, salt):
                    raise ValueError("a pair came without its first text")
                common = len(np.intersect1d(held, found, assume_unique=True))
                union = len(held) + len(found) - common
                out.append((ia, ib, a, b, common / union, common * (1 + least) >= (len(held) + len(found)) * least - 1e-6))
            columns = list(zip(*out)) or [()] * 6
            ia, ib, a, b = (pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary())))
            found = pa.array(columns[4], pa.float64())
            yield pa.RecordBatch.from_arrays(
                [ia, ib, a, b, found, found, pa.array(columns[5], pa.bool_())], names=["ia", "ib", "a", "b", "low", "high", "alike"]
            )

    return run


def text_class(text):
    """Identity of a text: equal texts, null and empty included, have one."""
    return F.unhex(F.md5(whole(text)))


_VERDICTS = "ia long, ib long, a binary, b binary, low double, high double, alike boolean"
#: pairs that share a copy of their first text
PAIRS = 500


#: places of the filter that keeps most texts out of a shuffle: a fixed size, whatever the data
PLACES = 1 << 20


def holding(given: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows (class, text) whose class falls on a place of one in ``nodes``: all those in it, and few others."""
    place = F.pmod(F.xxhash64("class"), F.lit(PLACES)).cast("int").alias("place")
    marks = np.zeros(PLACES, "?")
    marks[nodes.select(place).distinct().toArrow().column("place").to_numpy()] = True
    known = given.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = known.value[batch.column("place").to_numpy(zero_copy_only=False)]
            yield batch.select(["class", "text"]).filter(pa.array(kept))

    return given.select("class", "text", place).mapInArrow(lean(run), "class binary, text string")


def verdicts(pairs: DataFrame, known: DataFrame, given: DataFrame, least: float) -> DataFrame:
    """The pairs (ia, ib) with their classes a and b, bounds of their likeness, and whether it is ``least`` or more.

    ``known`` has short, class and sketch of all texts in the pairs, ``given``
    class and text.  Whole texts of doubtful pairs meet in rows sorted by the
    pair's first text, one copy of it for about ``PAIRS`` pairs.
    """
    one = known.select(F.col("short").alias("ia"), F.col("class").alias("a"), F.col("sketch").alias("sa"))
    two = known.select(F.col("short").alias("ib"), F.col("class").alias("b"), F.col("sketch").alias("sb"))
    judged = saved(pairs.select("ia", "ib").join(one, "ia").join(two, "ib").select("ia", "ib", "a", "b", "sa", "sb").mapInArrow(lean(_judged(least)), _VERDICTS))
    doubtful = judged.where("alike is null").select("ia", "ib", "a", "b")
    if not doubtful.limit(1).count():
        return judged
    sizes = doubtful.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / PAIRS).cast("int").alias("parts"))
    dealt = doubtful.join(sizes, "a").withColumn("_salt", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int"))
    nodes = doubtful.select(F.col("a").alias("class")).union(doubtful.select("b")).distinct()
    texts = saved(holding(given, nodes).join(nodes, "class", "left_semi").dropDuplicates(["class"]))
    firsts = dealt.groupBy("a", "_salt").agg(F.lit(None).cast("long").alias("ia")).join(texts.withColumnRenamed("class", "a"), "a").select(
        F.col("a").alias("_a"), "_salt", "ia", F.lit(None).cast("long").alias("ib"), F.lit(None).cast("binary").alias("b"), "text"
    )
    others = dealt.join(texts.withColumnRenamed("class", "b"), "b").select(F.col("a").alias("_a"), "_salt", "ia", "ib", "b", "text")
    sorted_ = firsts.unionByName(others).repartition("_a", "_salt").sortWithinPartitions("_a", "_salt", F.asc_nulls_first("b"))
    return judged.where("alike is not null").unionByName(saved(sorted_.mapInArrow(lean(_compared(least)), _VERDICTS)))


def _sized(similarity: float):
    return F.least("na", "nb") >= F.greatest("na", "nb") * similarity - 1e-6


def _reach(similarity: float):
    """Whether what two texts can share from their first meeting on is enough for the likeness."""
    return F.least("sa", "sb") >= (F.col("na") + F.col("nb")) * (similarity / (1 + similarity)) - 1e-6


def print_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (ia, ib) of each group of linked prints: its first text with every other one."""
    tree = saved(components(fingerprint_links(saved(classes.select("print").distinct()), RADIUS)))
    named = classes.select("short", "print").join(tree, F.col("print") == F.col("node"), "left").select("short", F.coalesce("root", "print").alias("group"))
    first = named.groupBy("group").agg(F.min("short").alias("ia"), F.max("short").alias("last")).where("ia < last").drop("last")
    return named.join(first, "group").where("short <> ia").select("ia", F.col("short").alias("ib"))


def hub_pairs(members: DataFrame, turn: int, similarity: float) -> DataFrame:
    """Pairs (ia, ib) of each bucket's hub of this turn with the other pivots of the bucket that are members."""
    own = members.where("short = pivot")
    place = F.struct(F.xxhash64("short", F.lit(turn)), "short", "n", "slack")
    hub = own.groupBy("h").agg(F.min(place).alias("p"), F.count(F.lit(1)).alias("c")).where("c > 1").select(
        "h", F.col("p.short").alias("ia"), F.col("p.n").alias("na"), F.col("p.slack").alias("sa")
    )
    met = own.select("h", F.col("short").alias("ib"), F.col("n").alias("nb"), F.col("slack").alias("sb")).join(hub, "h").where("ia <> ib")
    return met.where(_sized(similarity) & _reach(similarity)).select("ia", "ib").distinct()


def moves(ties: DataFrame) -> DataFrame:
    """(pivot, to, far): which pivots go to a hub, out of the alike pairs (hub ia, ib); no hub in ``to`` goes itself."""
    going = ties.select(F.col("ib").alias("ia")).distinct()
    free = ties.join(going, "ia", "left_anti")
    best = free.groupBy("ib").agg(F.min(F.struct("far", "ia")).alias("m"))
    return best.select(F.col("ib").alias("pivot"), F.col("m.ia").alias("to"), F.col("m.far").alias("far"))


def moved(members: DataFrame, ties: DataFrame) -> DataFrame:
    """The members under their new pivots; a distance to the new one is at most the sum of both ways."""
    return members.join(moves(ties), "pivot", "left").select(
        "h", "short", "n", "slack", F.coalesce("to", "pivot").alias("pivot"), (F.col("away") + F.coalesce("far", F.lit(0.0))).alias("away")
    )


def pivot_pairs(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (ia, ib) of pivots whose texts meet in a bucket, with the largest sum ``reach`` of such texts' distances.

    Sizes and places are those of any texts of the two pivots in the bucket.
    Large buckets are split into pairs of blocks.
    """
    each = members.groupBy("h", "pivot").agg(
        F.min("n").alias("low"), F.max("n").alias("high"), F.max("slack").alias("slack"), F.max("away").alias("away")
    )
    sizes = each.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("h", F.ceil(F.col("c") / BLOCK).cast("int").alias("blocks"))
    cut = each.join(sizes, "h").withColumn("at", F.pmod(F.xxhash64("pivot"), F.col("blocks")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))

    def side(x: str, mine: str, other: str) -> DataFrame:
        return cut.select("h", F.col("at").alias(mine), every.alias(other), *[F.col(c).alias(f"{c}_{x}") for c in ("pivot", "low", "high", "slack", "away")])

    share = similarity / (1 + similarity)
    fits = (F.least("high_a", "high_b") >= F.greatest("low_a", "low_b") * similarity - 1e-6) & (
        F.least("slack_a", "slack_b") >= (F.col("low_a") + F.col("low_b")) * share - 1e-6
    )
    met = side("a", "i", "j").join(side("b", "j", "i"), ["h", "i", "j"]).where("pivot_a < pivot_b").where(fits)
    return met.groupBy(F.col("pivot_a").alias("ia"), F.col("pivot_b").alias("ib")).agg(F.max(F.col("away_a") + F.col("away_b")).alias("reach"))


def _near(similarity: float):
    """Whether two texts are far enough from their pivots, whose least distance is ``apart``, to be alike."""
    return F.col("wa") + F.col("wb") >= F.col("apart") - (1 - similarity) - 1e-6


def member_pairs(members: DataFrame, open_: DataFrame, similarity: float) -> DataFrame:
    """Pairs (ia, ib) of texts under the pivots (pa, pb) of ``open_`` that are near enough to them to be alike.

    ``apart`` is the least distance of the two pivots.
    """
    one = members.select("h", F.col("pivot").alias("pa"), F.col("short").alias("ia"), F.col("n").alias("na"), F.col("slack").alias("sa"), F.col("away").alias("wa"))
    two = members.select("h", F.col("pivot").alias("pb"), F.col("short").alias("ib"), F.col("n").alias("nb"), F.col("slack").alias("sb"), F.col("away").alias("wb"))
    met = one.join(open_.select("pa", "pb", "apart"), "pa").join(two, ["h", "pb"]).where("ia <> pa or ib <> pb")
    return met.where(_near(similarity) & _sized(similarity) & _reach(similarity)).select(F.least("ia", "ib").alias("ia"), F.greatest("ia", "ib").alias("ib")).distinct()


def tried_pairs(members: DataFrame, open_: DataFrame, turn: int, similarity: float) -> DataFrame:
    """At most ``TRIES`` pairs (ia, ib) of texts for each two pivots of ``open_``, with the pivots' ``root_a`` and ``root_b``.

    Of a pivot's texts in each band of distances one stands for the others, another one in each turn.
    """
    asked = open_.select(F.col("pa").alias("pivot")).union(open_.select("pb")).distinct()
    place = F.struct(F.xxhash64("short", F.lit(turn)), "short", "n", "away")
    band = F.floor(F.col("away") / BAND).alias("band")
    stand = saved(
        members.join(asked, "pivot", "left_semi").groupBy("pivot", band).agg(F.min(place).alias("p")).select("pivot", "p.short", "p.n", "p.away")
    )
    one, two = (
        stand.select(F.col("pivot").alias(f"p{x}"), F.col("short").alias(f"i{x}"), F.col("n").alias(f"n{x}"), F.col("away").alias(f"w{x}")) for x in "ab"
    )
    met = open_.join(one, "pa").join(two, "pb").where("ia <> pa or ib <> pb").where(_near(similarity) & _sized(similarity)).withColumns(
        {"ia": F.least("ia", "ib"), "ib": F.greatest("ia", "ib")}
    )
    # texts nearest to their pivots are likeliest to be alike; the others are drawn
    first = [F.col("wa") + F.col("wb"), *[F.xxhash64("ia", "ib", F.lit(turn * TRIES + i)) for i in range(1, TRIES)]]
    few = F.array(*[F.min_by(F.struct("ia", "ib"), F.struct(x, "ia", "ib")) for x in first])
    return met.groupBy("pa", "pb", "root_a", "root_b").agg(few.alias("few")).select(
        F.explode("few").alias("p"), "root_a", "root_b"
    ).select("p.ia", "p.ib", "root_a", "root_b").distinct()


def similar_groups(df: DataFrame, text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(class, group) of every different text; texts of one group are joined by pairs of that likeness.

    ``class`` is ``text_class`` of the text, ``group`` the smallest class in the group.
    """
    given = df.select(text_class(F.col(text)).alias("class"), F.col(text).alias("text"))
    short = F.xxhash64("class")
    counts = shingle_counts(given, "text")
    classes = saved(signatures(given, "text", ["class"], counts, similarity).dropDuplicates(["class"]).withColumn("short", short))
    spread = classes.select("short", "n", F.posexplode("prefix").alias("p", "h")).withColumn("slack", F.col("n") - F.col("p"))
    # of two texts the one with fewer shingles meets the other in a shorter prefix
    early = F.col("slack") >= F.col("n") * (2 * similarity / (1 + similarity)) - 1e-6
    shared = spread.groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.max(early).alias("early")).where("c > 1 and early").select("h")
    members = saved(spread.drop("p").join(shared, "h").select("h", "short", "n", "slack", F.col("short").alias("pivot"), F.lit(0.0).alias("away")))
    pairs = saved(print_pairs(classes))
    asked = members.select("short").union(pairs.select("ia")).union(pairs.select("ib")).distinct()
    known = saved(classes.select("short", "class", "sketch").join(asked, "short", "left_semi"))
    found = []
    for turn in range(ROUNDS + 1):
        said = verdicts(pairs, known, given, similarity).where("alike")
        found.append(said.select("a", "b"))
        members = saved(moved(members, said.select("ia", "ib", (1 - F.col("low")).alias("far"))))
        if turn < ROUNDS:
            pairs = saved(hub_pairs(members, turn, similarity))
    pairs = saved(pivot_pairs(members, similarity))
    said = saved(verdicts(pairs, known, given, similarity))
    found.append(said.where("alike").select("a", "b"))
    # pivots that are joined by now need no further link between their texts
    tree = saved(components(reduce(DataFrame.unionByName, found)))
    one, two = (tree.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in "ab")
    apart = said.where("not alike").join(pairs, ["ia", "ib"]).where(F.col("reach") > 0).select(
        "a", "b", F.col("ia").alias("pa"), F.col("ib").alias("pb"), (1 - F.col("high")).alias("apart"), "reach"
    ).where(F.col("apart") <= (1 - similarity) + F.col("reach") + 1e-6)
    open_ = saved(
        apart.join(one, "a", "left").join(two, "b", "left")
        .select("pa", "pb", "apart", F.coalesce("root_a", "a").alias("root_a"), F.coalesce("root_b", "b").alias("root_b"))
        .where("root_a <> root_b")
    )
    for turn in range(TURNS):
        pairs = saved(tried_pairs(members, open_, turn, similarity))
        if not pairs.limit(1).count():
            break
        said = saved(verdicts(pairs.select("ia", "ib").distinct(), known, given, similarity).where("alike").select("ia", "ib", "a", "b"))
        found.append(said.select("a", "b"))
        tree = saved(components(pairs.join(said, ["ia", "ib"]).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()))
        one, two = (tree.select(F.col("node").alias(f"root_{x}"), F.col("root").alias(f"to_{x}")) for x in "ab")
        open_ = saved(
            open_.join(one, "root_a", "left").join(two, "root_b", "left")
            .select("pa", "pb", "apart", F.coalesce("to_a", "root_a").alias("root_a"), F.coalesce("to_b", "root_b").alias("root_b"))
            .where("root_a <> root_b")
        )
    pairs = saved(member_pairs(members, open_, similarity))
    found.append(verdicts(pairs, known, given, similarity).where("alike").select("a", "b"))
    tree = components(reduce(DataFrame.unionByName, found))
    return classes.select("class").join(tree.select(F.col("node").alias("class"), "root"), "class", "left").select(
        "class", F.coalesce("root", "class").alias("group")
    )


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each group: the one with the smallest id (null ids last, then by the text's class)."""
    columns = docs.columns
    last = F.lit((1 << 63) - 1)
    groups = saved(similar_groups(docs.select("text")))
    rows = docs.select(F.coalesce("doc_id", last).alias("id"), text_class(F.col("text")).alias("class"))
    best = rows.join(groups, "class").groupBy("group").agg(F.min(F.struct("id", "class")).alias("b"))
    id_, class_ = fresh(docs, "sort_id", "sort_class")
    named = docs.withColumns({id_: F.coalesce("doc_id", last), class_: text_class(F.col("text"))})
    best = best.select(F.col("b.id").alias(id_), F.col("b.class").alias(class_))
    return named.join(best, [id_, class_]).dropDuplicates([id_, class_]).select(*columns)
