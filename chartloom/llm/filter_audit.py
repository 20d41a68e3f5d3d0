"""What filters do in every order: an audit of five filters over whole texts.

The filters (``LETTERS``):

    A    fewer than 50 words
    B    different words below 65 % of the words
    C    letters A-Z above 5 % of the code points
    D    holds any of ``#$%&*|``
    E    the same text as a document of a smaller id

E is found by radix tries.  Texts are range-partitioned by adaptive prefixes:
where more than ``BUCKET`` bytes or ``ROWS`` texts share a prefix of eight bytes
the next four times as many are taken, and so on until a prefix is rare enough
or has one text only.  A task gets its ranges in order of prefix, puts the
texts of one prefix into a compressed trie that keeps the smallest id at each
end, walks it, and goes on with an empty trie.  Before the shuffle equal texts
of a batch are merged by the same trie: only the smallest id's row takes the
text along, so a text that fills a third of the table moves once a batch.

The flags become a mask a document.  Masks are counted by part and labels; all
120 orders are worked out from a part's 32 counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.common import saved, table

LETTERS = "ABCDE"
MIN_WORDS, DISTINCT, CAPITALS, MARKS = 50, 65, 5, b"#$%&*|"
#: bytes and number of texts under one prefix, the first prefix and how much longer the next ones are
BUCKET, ROWS, FIRST, LONGER = 32_000_000, 10_000, 8, 4
#: levels of prefixes: the last one is longer than any text of Spark
LEVELS = 14
_UPPER = bytes(range(65, 91))
#: bytes that begin no code point
_TAILS = bytes(range(0x80, 0xC0))
_E = 1 << LETTERS.index("E")


def plain_mask(text: bytes) -> int:
    """Bits A to D of a text."""
    words = text.split()
    points = len(text.translate(None, _TAILS))
    upper = len(text) - len(text.translate(None, _UPPER))
    return (
        (len(words) < MIN_WORDS)
        | (100 * len(set(words)) < DISTINCT * len(words)) << 1
        | (100 * upper > CAPITALS * points) << 2
        | (len(text) > len(text.translate(None, MARKS))) << 3
    )


def _common(a: bytes, b: bytes) -> int:
    """Length of the longest common beginning."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    low, high = 0, n
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


class Trie:
    """A compressed trie of byte strings; a node is [label, children by first byte, value or None]."""

    def __init__(self):
        self.root = [b"", {}, None]

    def end(self, text: bytes) -> list:
        """The node at which the text ends; made if it is new."""
        node, at = self.root, 0
        while at < len(text):
            child = node[1].get(text[at])
            if child is None:
                child = node[1][text[at]] = [text[at:], {}, None]
                return child
            label = child[0]
            if not text.startswith(label, at):
                same = _common(text[at:at + len(label)], label)
                middle = [label[:same], {label[same]: child}, None]
                child[0] = label[same:]
                node[1][text[at]] = middle
                child = middle
            node, at = child, at + len(child[0])
        return node

    def ends(self) -> Iterator[list]:
        """The values of all ends."""
        left = [self.root]
        while left:
            node = left.pop()
            if node[2] is not None:
                yield node[2]
            left.extend(node[1].values())


class Texts:
    """Rows by text: at each end the smallest id (null above all) and the rows that wait for it."""

    def __init__(self):
        self.trie = Trie()

    def add(self, text: bytes, doc_id: int | None, row) -> None:
        node = self.trie.end(text)
        key = (doc_id is None, doc_id or 0)
        if node[2] is None:
            node[2] = [key, []]
        elif key < node[2][0]:
            node[2][0] = key
        node[2][1].append((key, row))

    def flags(self) -> Iterator[tuple[bool, object]]:
        """(whether a smaller id has the text, row) of every row."""
        for least, rows in self.trie.ends():
            for key, row in rows:
                yield least < key, row


_MASKED = "doc_id long, part string, mask int, copies long, text binary"
_MASKED_SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("copies", pa.int64()), ("text", pa.binary()),
])


def _masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bits A to D; rows whose text has a smaller id in their batch get E and lose the text, equal rows are counted."""
    for batch in batches:
        texts, rows = Texts(), {}
        for doc_id, part, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            data = value.as_py()
            texts.add(data, doc_id, (doc_id, part, data))
        masks: dict[bytes, int] = {}
        for again, (doc_id, part, data) in texts.flags():
            mask = masks.get(data)
            if mask is None:
                mask = masks[data] = plain_mask(data)
            key = (doc_id, part, mask | _E, None) if again else (doc_id, part, mask, data)
            rows[key] = rows.get(key, 0) + 1
        out = list(zip(*[(d, p, m, n, t) for (d, p, m, t), n in rows.items()])) or [()] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _MASKED_SCHEMA)], schema=_MASKED_SCHEMA)


def prefixed(df: DataFrame, text: str = "text", bucket: int = BUCKET, rows: int = ROWS) -> DataFrame:
    """The rows with ``prefix``: the shortest beginning of the text that few texts (in bytes) or one text only begin with.

    Each level looks at the texts under the crowded prefixes of the one before
    only.  A level has at most bytes / ``bucket`` + rows / ``rows`` crowded
    prefixes: these are broadcast, the texts stay where they are.
    """
    df = df.withColumn("prefix", F.substring(text, 1, FIRST))
    length, left, crowds = FIRST, df, []
    for _ in range(LEVELS):
        crowd = saved(
            left.groupBy("prefix").agg(F.sum(F.octet_length(text)).alias("bytes"), F.count(F.lit(1)).alias("n"), F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b"))
            .where(((F.col("bytes") > bucket) | (F.col("n") > rows)) & (F.col("a") != F.col("b"))).select(F.col("prefix").alias("crowded"))
        )
        if not crowd.limit(1).count():
            break
        crowds.append((length, crowd))
        length *= LONGER
        longer = F.substring(text, 1, length)
        left = left.join(F.broadcast(crowd), F.col("prefix") == F.col("crowded"), "left_semi").withColumn("prefix", longer)
    for size, crowd in crowds:
        longer = F.substring(text, 1, size * LONGER)
        df = df.join(F.broadcast(crowd), F.col("prefix") == F.col("crowded"), "left")
        df = df.withColumn("prefix", F.when(F.col("crowded").isNotNull(), longer).otherwise(F.col("prefix"))).drop("crowded")
    return df


def _flagged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bit E of rows that come in order of their prefix: one trie a prefix."""
    schema = pa.schema(list(_MASKED_SCHEMA)[:4])

    def done(texts: Texts) -> pa.RecordBatch:
        rows = [(d, p, m | _E * again, n) for again, (d, p, m, n) in texts.flags()]
        columns = zip(*rows) if rows else [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    texts, held, prefix = Texts(), 0, None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("doc_id", "part", "mask", "copies", "prefix")]
        for doc_id, part, mask, copies, now, value in zip(*columns, batch.column("text")):
            if now != prefix:
                # prefixes of few texts share a trie as long as it is small: equal texts have equal prefixes
                if held > 1_000_000:
                    yield done(texts)
                    texts, held = Texts(), 0
                prefix = now
            data = value.as_py()
            held += len(data) + 100
            texts.add(data, doc_id, (doc_id, part, mask, copies))
    yield done(texts)


def filter_masks(df: DataFrame, text: str = "text", id_: str = "doc_id", part: str = "source") -> DataFrame:
    """(doc_id, part, mask, copies): the failed filters of every row as bits A = 1 to E = 16.

    Rows equal in id, part and mask may be given once with their number as
    ``copies``.  Null texts count as empty, a null part is the empty one.  A
    null id is above all others and equal to itself: rows of equal text and id
    don't fail E for each other.  Only the three columns are used.
    """
    given = df.select(
        F.col(id_).cast("long").alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary").alias("text"),
    )
    masked = saved(given.mapInArrow(_masked, _MASKED))
    known = masked.where("text is null").drop("text")
    asked = prefixed(masked.where("text is not null"))
    ordered = asked.repartitionByRange("prefix").sortWithinPartitions("prefix")
    return known.unionByName(ordered.mapInArrow(_flagged, "doc_id long, part string, mask int, copies long"))


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows by (part, mask) with those labelled good and toxic; an id with several labels has each that a row gives it."""
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.sum("copies").alias("n"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.max(F.coalesce((F.col("quality") == 1).cast("long"), F.lit(0))).alias("good"),
        F.max(F.coalesce((F.col("toxic") == 1).cast("long"), F.lit(0))).alias("toxic"),
    )
    joined = rows.where("doc_id is not null").join(known, "doc_id", "left").drop("doc_id")
    none = rows.where("doc_id is null").select("part", "mask", "n", F.lit(None).cast("long").alias("good"), F.lit(None).cast("long").alias("toxic"))
    return joined.unionByName(none).groupBy("part", "mask").agg(
        F.sum("n").alias("n"), F.sum(F.coalesce(F.col("n") * F.col("good"), F.lit(0))).alias("good"),
        F.sum(F.coalesce(F.col("n") * F.col("toxic"), F.lit(0))).alias("toxic"),
    )


def order_steps() -> list[tuple[str, int, int, int]]:
    """(order, step, filters applied before as bits, this filter's bit) of every order and step."""
    out = []
    for order in permutations(LETTERS):
        before = 0
        for step, letter in enumerate(order, 1):
            bit = 1 << LETTERS.index(letter)
            out.append(("".join(order), step, before, bit))
            before |= bit
    return out


def order_report(counts: DataFrame) -> DataFrame:
    """A row for each part, order and step from the counts by mask."""
    sets = range(1 << len(LETTERS))

    def passing(value: str) -> F.Column:
        """For each set of filters, how many rows fail none of them."""
        return F.array(*[F.coalesce(F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(value))), F.lit(0)) for s in sets])

    each = counts.groupBy("part").agg(
        passing("n").alias("n"), passing("good").alias("good"), passing("toxic").alias("toxic"),
        F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == s, F.col("n"))), F.lit(0)) for s in sets]).alias("only"),
    )
    steps = F.array(*[
        F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("before"), F.lit(f).alias("bit"))
        for o, s, b, f in order_steps()
    ])
    rows = each.withColumn("at", F.explode(steps)).select("*", "at.*")
    both = F.col("before").bitwiseOR(F.col("bit"))

    def gone(name: str, before=None, after=None) -> F.Column:
        return F.get(F.col(name), F.col("before") if before is None else before) - F.get(F.col(name), both if after is None else after)

    removed = gone("n")
    out = rows.select(
        "part", "filter_order", "step", "bit", F.get(F.col("n"), both).alias("kept"), removed.alias("removed"),
        (gone("n", F.lit(0), F.col("bit")) - removed).alias("redundant"), F.get(F.col("only"), F.col("bit")).alias("unique_fails"),
        gone("good").alias("good_lost"), gone("toxic").alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def op13_filter_audit(spark, folder: str) -> DataFrame:
    """The five filters in all 120 orders by source."""
    masks = filter_masks(table(spark, folder, "documents").select("doc_id", "text", "source"))
    return order_report(mask_counts(masks, table(spark, folder, "labels")))


ORACLE = """
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
flags AS (
  SELECT doc_id, part, len(w) < 50 AS a, 100 * len(list_distinct(w)) < 65 * len(w) AS b,
    100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t) AS c, regexp_matches(t, '[#$%&*|]') AS d,
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), min(doc_id) OVER (PARTITION BY t) IS NOT NULL) AS e
  FROM texts),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id),
counts AS (
  SELECT part, CAST(a AS INT) + 2 * CAST(b AS INT) + 4 * CAST(c AS INT) + 8 * CAST(d AS INT) + 16 * CAST(e AS INT) AS mask,
    count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
  FROM flags LEFT JOIN known USING (doc_id) GROUP BY ALL),
f(l, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM f a, f b, f c, f d, f e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31
    AND len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, step, bits[step] AS bit, CAST(coalesce(list_sum(bits[1:step - 1]), 0) AS INT) AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)),
found AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN (mask & (before | bit)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & before) <> 0 AND (mask & bit) <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (mask & before) = 0 AND (mask & bit) <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM counts, steps GROUP BY ALL)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found
"""
