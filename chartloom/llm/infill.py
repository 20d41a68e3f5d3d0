"""Fill-in-the-middle texts by a secondary sort.

A text is cut into units (lines); two cuts drawn from the document's id make
prefix, middle and suffix, which are written in another order behind marks:

    psm    <P>prefix<S>suffix<M>middle
    spm    <S>suffix<P>prefix<M>middle

Tasks emit pieces (runs of whole units of about ``CHUNK`` bytes; only a unit
beyond that is cut inside) under the document's row and the piece's place in
the output.  One shuffle by row with a sort by (row, place) inside partitions
brings each output in order past one task, which feeds it to a digest, or joins
it, without holding more than a piece of it.  For the way back the outputs are
scanned for their marks as they pass, each stretch gets its place in the text,
and the same partitions are sorted again by that place.

A row is known by a 128-bit hash of its id, its text and the partition it was
read from, so it is the same on every attempt of a task, and a repeated row
spreads over as many tasks as read it.  Rows repeated inside a partition send
each piece several times; the copies are counted once and given back as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.llm.common import table

#: bytes of a piece, and of the pieces that a task hands on at once
CHUNK, HELD = 16_384, 4_000_000
SEED, RATE, SPM = "7:", 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: the parts in output order: mark and place in the text
FORMS = {"psm": ((PREFIX, 0), (SUFFIX, 2), (MIDDLE, 1)), "spm": ((SUFFIX, 2), (PREFIX, 0), (MIDDLE, 1)), "plain": ()}
#: pieces of a part are numbered below the part's number
PART = 1 << 40
LAST = 1 << 62

_HEAD = "struct<doc_id:long,n:long,form:string,prefix_chars:long,middle_chars:long>"
_PIECES = f"row binary, place long, piece binary, head {_HEAD}"
_RESULT = "doc_id long, n long, form string, prefix_chars long, middle_chars long"
_HEAD_TYPE = pa.struct([
    ("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()),
])
_PIECE_SCHEMA = pa.schema([("row", pa.binary()), ("place", pa.int64()), ("piece", pa.binary()), ("head", _HEAD_TYPE)])


class _Held:
    """Rows of one schema, handed on as batches of about ``HELD`` bytes."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: tuple, size: int) -> bool:
        self.rows.append(row)
        self.bytes += size + 64
        return self.bytes >= HELD

    def batch(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [()] * len(self.schema)
        out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, self.schema)], schema=self.schema)
        self.rows, self.bytes = [], 0
        return out


def draws(seed: str, doc_id: int | None) -> list[int]:
    """The first four 32-bit numbers of the sha256 of seed and decimal id (nothing for a null id)."""
    found = hashlib.sha256(f"{seed}{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(found[i:i + 4], "big") for i in (0, 4, 8, 12)]


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Where each line of the bytes ends (behind its line feed)."""
    ends = np.flatnonzero(data == 10) + 1
    if len(data) and (not len(ends) or ends[-1] < len(data)):
        ends = np.append(ends, len(data))
    return ends


def code_points(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def cuts(data: bytes, ends: np.ndarray, doc_id: int | None, seed: str, rate: int, spm: int) -> tuple[str, int, int]:
    """The form of a text and the bytes at which its middle and its suffix begin."""
    if not data or PREFIX in data or SUFFIX in data or MIDDLE in data:
        return "plain", 0, 0
    one, two, three, four = draws(seed, doc_id)
    if three % 100 >= rate:
        return "plain", 0, 0
    places = np.concatenate([[0], ends])
    low, high = sorted((one % len(places), two % len(places)))
    return "spm" if four % 100 < spm else "psm", int(places[low]), int(places[high])


def chunks(ends: np.ndarray, start: int, stop: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole units of at most ``CHUNK`` bytes; a longer unit is cut inside."""
    while start < stop:
        far = min(start + CHUNK, stop)
        at = int(np.searchsorted(ends, far, side="right")) - 1
        end = int(ends[at]) if at >= 0 and ends[at] > start else far
        yield start, end
        start = end


def placed(data: bytes, ends: np.ndarray, form: str, middle: int, suffix: int) -> Iterator[tuple[int, bytes]]:
    """(place in the output, bytes) of a text's pieces; a part's first piece begins with its mark."""
    if form == "plain":
        for i, (a, b) in enumerate(chunks(ends, 0, len(data))):
            yield i, data[a:b]
        if not data:
            yield 0, b""
        return
    span = ((0, middle), (middle, suffix), (suffix, len(data)))
    for rank, (mark, part) in enumerate(FORMS[form]):
        first = mark
        for i, (a, b) in enumerate(chunks(ends, *span[part])):
            yield rank * PART + i, first + data[a:b]
            first = b""
        if first:
            yield rank * PART, first


def _cut(seed: str, rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held = _Held(_PIECE_SCHEMA)
        for batch in batches:
            for doc_id, value in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                data = value.as_py() or b""
                raw = np.frombuffer(data, "u1")
                ends = unit_ends(raw)
                form, middle, suffix = cuts(data, ends, doc_id, seed, rate, spm)
                if form == "plain":
                    head = (doc_id, len(ends), form, None, None)
                else:
                    head = (doc_id, len(ends), form, code_points(raw[:middle]), code_points(raw[middle:suffix]))
                row = xxhash.xxh3_128_digest(f"{doc_id} {part} ".encode() + data)
                named = dict(zip(_HEAD_TYPE.names, head))
                for place, piece in placed(data, ends, form, middle, suffix):
                    if held.add((row, place, piece, named if place == 0 else None), len(piece)):
                        yield held.batch()
        yield held.batch()

    return run


def fim_pieces(df: DataFrame, text: str = "text", id_: str = "doc_id", seed: str = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """The outputs' pieces (row, place, piece, head), in order: partitions hold whole rows, sorted by row and place.

    Null texts count as empty and stay plain, as texts do that hold a mark and
    those beyond ``rate`` percent; ``spm`` percent of the others take that form.
    ``head`` (id, units, form, code points of prefix and middle) is at place 0.
    Only id and text are used.  An empty table gives none.
    """
    given = df.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return given.mapInArrow(_cut(seed, rate, spm), _PIECES).repartition("row").sortWithinPartitions("row", "place")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(row, place, piece, head) one by one."""
    for batch in batches:
        heads = batch.column("head")
        pieces = batch.column("piece")
        for i, (row, place) in enumerate(zip(batch.column("row").to_pylist(), batch.column("place").to_pylist())):
            yield row, place, pieces[i].as_py(), heads[i].as_py() if heads[i].is_valid else None


def outputs(pieces: Iterator[tuple]) -> Iterator[tuple]:
    """Each row's head, copies and pieces from sorted pieces: (head, None), then (None, piece)..., then (copies, None).

    A piece that comes several times belongs to equal rows and is handed on once.
    """
    row = place = None
    copies = 0
    for key, at, piece, head in pieces:
        if key != row:
            if row is not None:
                yield copies, row, None
            row, place, copies = key, None, 0
            yield head, row, None
        copies += at == 0
        if at != place:
            place = at
            yield None, row, piece
    if row is not None:
        yield copies, row, None


class Restorer:
    """Gives the stretches of a text, in the order of its output, as the output passes piece by piece."""

    def __init__(self, form: str):
        self.marks, self.at, self.held = FORMS[form], 0, b""
        self.part = 0 if form == "plain" else None

    def feed(self, piece: bytes) -> Iterator[tuple[int, bytes]]:
        """(part of the text, bytes) that are settled; up to two bytes wait, as they may begin a mark."""
        data = self.held + piece
        while self.at < len(self.marks):
            mark, part = self.marks[self.at]
            found = data.find(mark)
            if found < 0:
                break
            yield from self._part(data[:found])
            self.part, self.at, data = part, self.at + 1, data[found + len(mark):]
        wait = min(2, len(data)) if self.at < len(self.marks) else 0
        self.held = data[len(data) - wait:]
        yield from self._part(data[:len(data) - wait])

    def _part(self, data: bytes) -> Iterator[tuple[int, bytes]]:
        if data:
            if self.part is None:
                raise ValueError("the output does not begin with its mark")
            yield self.part, data

    def close(self) -> None:
        if self.at < len(self.marks):
            raise ValueError("the output lacks a mark")


def restored_text(output: str, form: str) -> str:
    """The text of one output."""
    parts: list[list[bytes]] = [[], [], []]
    back = Restorer(form)
    for part, data in back.feed(output.encode()):
        parts[part].append(data)
    back.close()
    return b"".join(b"".join(p) for p in parts).decode()


def fim_texts(pieces: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars and ``output`` of every row, from its sorted pieces."""
    schema = pa.schema([*_HEAD_TYPE, ("output", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, head, parts = _Held(schema), None, []
        for said, _, piece in outputs(_streamed(batches)):
            if piece is not None:
                parts.append(piece)
            elif isinstance(said, dict):
                head, parts = said, []
            else:
                whole = b"".join(parts).decode()
                for _ in range(said):
                    if held.add((*head.values(), whole), len(whole)):
                        yield held.batch()
        yield held.batch()

    return pieces.mapInArrow(run, f"{_RESULT}, output string")


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The outputs' digests, and their stretches under the places they have in the text."""
    schema = _PIECE_SCHEMA.append(pa.field("output_sha256", pa.string())).append(pa.field("copies", pa.int64()))
    held, head, digest, back, count = _Held(schema), None, None, None, 0
    for said, row, piece in outputs(_streamed(batches)):
        if piece is not None:
            digest.update(piece)
            for part, data in back.feed(piece):
                if held.add((row, part * PART + count, data, None, None, None), len(data)):
                    yield held.batch()
                count += 1
        elif isinstance(said, dict):
            head, digest, back, count = said, hashlib.sha256(), Restorer(said["form"]), 0
        else:
            back.close()
            if held.add((row, LAST, None, head, digest.hexdigest(), said), 100):
                yield held.batch()
    yield held.batch()


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([*_HEAD_TYPE, ("output_sha256", pa.string()), ("restored_sha256", pa.string())])
    held, digest = _Held(schema), hashlib.sha256()
    for batch in batches:
        pieces, heads, digests, copies = (batch.column(c) for c in ("piece", "head", "output_sha256", "copies"))
        for i, place in enumerate(batch.column("place").to_pylist()):
            if place != LAST:
                digest.update(pieces[i].as_py())
                continue
            row = (*heads[i].as_py().values(), digests[i].as_py(), digest.hexdigest())
            digest = hashlib.sha256()
            for _ in range(copies[i].as_py()):
                if held.add(row, 128):
                    yield held.batch()
    yield held.batch()


def fim_round_trip(pieces: DataFrame) -> DataFrame:
    """The head of every row with the sha256 of its output and of the text rebuilt from the output."""
    scanned = pieces.mapInArrow(_scanned, f"{_PIECES}, output_sha256 string, copies long")
    back = scanned.sortWithinPartitions("row", "place")
    return back.mapInArrow(_digested, f"{_RESULT}, output_sha256 string, restored_sha256 string")


def op11_infill(spark, folder: str) -> DataFrame:
    """Every document's form, cuts, output digest and the digest of its text rebuilt from the output."""
    return fim_round_trip(fim_pieces(table(spark, folder, "documents").select("doc_id", "text")))


ORACLE = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') AS u,
    sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS d
  FROM documents),
drawn AS (
  SELECT doc_id, t, u, len(u) AS n,
    CAST('0x' || substr(d, 1, 8) AS BIGINT) % (len(u) + 1) AS h1, CAST('0x' || substr(d, 9, 8) AS BIGINT) % (len(u) + 1) AS h2,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>')
           OR CAST('0x' || substr(d, 17, 8) AS BIGINT) % 100 >= 100 THEN 'plain'
         WHEN CAST('0x' || substr(d, 25, 8) AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, t, n, form, array_to_string(u[1:least(h1, h2)], '') AS p,
    array_to_string(u[least(h1, h2) + 1:greatest(h1, h2)], '') AS m, array_to_string(u[greatest(h1, h2) + 1:n], '') AS s
  FROM drawn)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
  CAST(CASE WHEN form <> 'plain' THEN length(p) END AS BIGINT) AS prefix_chars,
  CAST(CASE WHEN form <> 'plain' THEN length(m) END AS BIGINT) AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM parts
"""
