"""Token-id files of patched frame-of-reference blocks.

One file holds the ids of one range of documents, in ascending order of id:

    "PFB1"
    blocks     minimum u32, ids u32, exceptions u32, width u8, then the packed
               low bits (width bits an id), the exceptions' places (u16) and
               their whole differences to the minimum (u32)
    footer     documents' ids (i64), whether they are null (u8), ids of each
               document (i64), start of each block in the file (u64)
    trailer    documents u64, blocks u64, start of the footer u64, "PFB1"

Numbers are little-endian.  A block covers ``BLOCK`` ids, whatever the
documents' bounds.  Its width is the bit length of one of the percentiles
``PERCENTILES`` of its differences, the one that gives the smallest block; what
does not fit the width goes to the exception list.

Documents are dealt to ranges of ids and sorted there, so a task writes one
file from start to end.  A file has a name of its own for each attempt; the
manifest, written by Spark, names the files of the attempts that count.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chartloom.llm.common import saved, shared_folder, table, whole

MAGIC = b"PFB1"
BLOCK = 4096
PERCENTILES = (100, 99.5, 99, 98, 95, 90)
END_ID = 2
#: pieces and words that a task remembers; forgetting costs time only
KNOWN_PIECES = 500_000
#: bytes of ids after which a reader hands documents on
CHUNK = 8_000_000
# fixed values: the stages of the tokenizer file that the plain way repeats
_SPLIT_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_NORMALIZER = {"type": "Sequence", "normalizers": [
    {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": _SPLIT_PATTERN}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
_PLAIN = re.compile("[\t\n\r\x20-~À-ÖØ-öø-ÿ]*")
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
_BLOCK_HEAD, _TRAILER = struct.Struct("<IIIB"), struct.Struct("<QQQ4s")


def pack_block(ids: np.ndarray) -> bytes:
    """One block of unsigned 32-bit ids."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype("<u4")
    ordered = np.sort(rest)
    n = len(rest)
    best = None
    for p in PERCENTILES:
        width = int(ordered[min(n - 1, int(np.ceil(n * p / 100)) - 1)]).bit_length()
        over = n - int(np.searchsorted(ordered, 1 << width)) if width < 32 else 0
        cost = n * width + 48 * over
        if best is None or cost < best[0]:
            best = (cost, width)
    width = best[1]
    if width in (8, 16):
        packed = rest.astype(f"<u{width // 8}").tobytes()
    elif width:
        bits = np.unpackbits(rest.view("u1").reshape(n, 4), axis=1, bitorder="little")[:, :width]
        packed = np.packbits(bits.ravel(), bitorder="little").tobytes()
    else:
        packed = b""
    odd = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, "int64")
    return (
        _BLOCK_HEAD.pack(low, n, len(odd), width) + packed + odd.astype("<u2").tobytes() + rest[odd].astype("<u4").tobytes()
    )


def unpack_block(block: bytes) -> np.ndarray:
    low, n, odd, width = _BLOCK_HEAD.unpack_from(block)
    at = _BLOCK_HEAD.size
    size = (n * width + 7) // 8
    if width in (8, 16):
        out = np.frombuffer(block, f"<u{width // 8}", n, at).astype("<u4")
    elif width:
        bits = np.unpackbits(np.frombuffer(block, "u1", size, at), count=n * width, bitorder="little").reshape(n, width)
        full = np.zeros((n, 32), "u1")
        full[:, :width] = bits
        out = np.packbits(full, axis=1, bitorder="little").view("<u4").ravel()
    else:
        out = np.zeros(n, "<u4")
    if odd:
        out[np.frombuffer(block, "<u2", odd, at + size)] = np.frombuffer(block, "<u4", odd, at + size + 2 * odd)
    return out + np.uint32(low)


class _Writer:
    def __init__(self, out):
        self.out, self.at, self.starts = out, 0, []
        self.ids, self.nulls, self.sizes = [], [], []
        self.held: list[bytes] = []
        self.held_ids = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.sizes.append(len(ids) // 4)
        self.held.append(ids)
        self.held_ids += len(ids) // 4
        if self.held_ids >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        found = np.frombuffer(b"".join(self.held), "<u4")
        stop = len(found) if last else len(found) // BLOCK * BLOCK
        for i in range(0, stop, BLOCK):
            self.starts.append(self.at)
            self._put(pack_block(found[i:min(i + BLOCK, stop)]))
        self.held, self.held_ids = [found[stop:].tobytes()], len(found) - stop

    def close(self) -> None:
        self._flush(True)
        footer = self.at
        self._put(np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.sizes, "<i8").tobytes())
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(_TRAILER.pack(len(self.ids), len(self.starts), footer, MAGIC))


class TokenFile:
    """Reads one file: its documents in order, or any stretch of its ids."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        docs, blocks, self.footer, magic = _TRAILER.unpack(source.read_at(_TRAILER.size, size - _TRAILER.size))
        if magic != MAGIC:
            raise ValueError("not a token file")
        raw = source.read_at(size - _TRAILER.size - self.footer, self.footer)
        self.ids = np.frombuffer(raw, "<i8", docs)
        self.nulls = np.frombuffer(raw, "u1", docs, 8 * docs)
        self.sizes = np.frombuffer(raw, "<i8", docs, 9 * docs)
        self.starts = np.frombuffer(raw, "<u8", blocks, 17 * docs)

    def block(self, i: int) -> np.ndarray:
        start = int(self.starts[i])
        stop = int(self.starts[i + 1]) if i + 1 < len(self.starts) else self.footer
        return unpack_block(self.source.read_at(stop - start, start))

    def stretch(self, start: int, stop: int) -> np.ndarray:
        """Ids start to stop (exclusive) of the file; opens the blocks that hold them only."""
        if start >= stop:
            return np.zeros(0, "<u4")
        first = start // BLOCK
        found = np.concatenate([self.block(i) for i in range(first, (stop - 1) // BLOCK + 1)])
        return found[start - first * BLOCK:stop - first * BLOCK]

    def documents(self) -> Iterator[bytes]:
        """Every document's ids as bytes; holds one document and one block."""
        at, held = 0, b""
        place = 0
        for size in self.sizes.tolist():
            need, out = 4 * size, []
            while need:
                if place >= len(held):
                    held, place = self.block(at).tobytes(), 0
                    at += 1
                piece = held[place:place + need]
                out.append(piece)
                place += len(piece)
                need -= len(piece)
            yield b"".join(out)


class WordTokenizer:
    """Ids by the tokenizers library, once for each different piece of a bounded table.

    Texts of the letters, digits and marks in ``_PLAIN`` are stable under the
    tokenizer's normalizer but for case, and ``_SPLIT`` cuts them as its
    pre-tokenizer does; each piece goes to the library's model.  Other texts are
    cut at spaces, tabs and line ends only, which the tokenizer drops and never
    joins across, and each word takes the library's whole way.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.plain = spec["normalizer"] == _NORMALIZER and spec["pre_tokenizer"] == _PRE_TOKENIZER and all(
            t["content"].startswith("<|") for t in spec["added_tokens"]
        )
        self.model = self.tokenizer.model
        # the byte-level spelling of the plain characters beyond ASCII
        self.spelled = {
            c: self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7
        } if self.plain else {}
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {"": b""}

    def encode(self, text: str) -> bytes:
        if self.plain and _PLAIN.fullmatch(text) and "<|" not in text:
            pieces, known = _SPLIT.findall(text.lower()), self.pieces
            new = set(pieces).difference(known)
            if len(known) + len(new) > KNOWN_PIECES:
                known.clear()
                new = set(pieces)
            for piece in new:
                spelled = piece if piece.isascii() else piece.translate(self.spelled)
                known[piece] = array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()
            return b"".join([known[p] for p in pieces])
        words, known = text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "), self.words
        new = list(set(words).difference(known))
        if len(known) + len(new) > KNOWN_PIECES:
            known.clear()
            new = list(set(words))
        for word, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False) if new else ()):
            known[word] = array("I", found.ids).tobytes()
        return b"".join([known[w] for w in words])


_TOKENIZERS: dict[str, WordTokenizer] = {}


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = WordTokenizer(path)
    return _TOKENIZERS[path]


def write_token_files(df: DataFrame, folder: str, tokenizer: str, text: str = "text", id_: str = "doc_id", end_id: int = END_ID) -> DataFrame:
    """Write the documents' ids to files in ``folder`` and return the manifest: part, file, docs, ids, bytes.

    ``folder`` is a path or URI that all executors share, ``tokenizer`` a path
    that every executor can open.  Documents are in ascending order of id (null
    first; equal ids by their texts' hashes); each ends with ``end_id``, null
    and empty texts have it alone.  Only id and text are used.  An empty table
    gives an empty manifest.
    """
    given = df.select(F.col(id_).cast("long").alias("id"), F.xxhash64(whole(F.col(text))).alias("hash"), F.col(text).alias("text"))
    dealt = given.repartitionByRange("id", "hash").sortWithinPartitions("id", "hash")
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer = stream = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                store, path = pafs.FileSystem.from_uri(folder)
                store.create_dir(path, recursive=True)
                name = f"ids-{part:06d}-{uuid.uuid4().hex}.pfb"
                stream = store.open_output_stream(f"{path}/{name}")
                writer, m = _Writer(stream), _tokenizer(tokenizer)
            ids = batch.column(0).to_pylist()
            for doc_id, value in zip(ids, batch.column(2)):
                writer.add(doc_id, m.encode(value.as_py() or "") + end)
        if writer is not None:
            writer.close()
            stream.close()
            row = ([part], [name], [len(writer.ids)], [sum(writer.sizes)], [writer.at])
            yield pa.RecordBatch.from_arrays(
                [pa.array(row[0], pa.int32()), pa.array(row[1]), *[pa.array(x, pa.int64()) for x in row[2:]]],
                names=["part", "file", "docs", "ids", "bytes"],
            )

    return saved(dealt.mapInArrow(run, "part int, file string, docs long, ids long, bytes long"))


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Every document of the files: doc_id, ``start`` (ids of all documents before it) and ``ids`` (u32 bytes)."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file: the window sees names and counts, not ids
    files = manifest.select("part", "file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("base"))
    count = manifest.count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, base in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                store, path = pafs.FileSystem.from_uri(folder)
                with store.open_input_file(f"{path}/{file}") as source:
                    found = TokenFile(source)
                    ids, starts, data, held = [], [], [], 0
                    for i, doc in enumerate(found.documents()):
                        ids.append(None if found.nulls[i] else int(found.ids[i]))
                        starts.append(base)
                        data.append(doc)
                        base += len(doc) // 4
                        held += len(doc)
                        if held >= CHUNK:
                            yield _rows(ids, starts, data)
                            ids, starts, data, held = [], [], [], 0
                    if ids:
                        yield _rows(ids, starts, data)

    return files.repartition(max(1, count)).mapInArrow(run, "doc_id long, start long, ids binary")


def _rows(ids: list, starts: list, data: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())],
        names=["doc_id", "start", "ids"],
    )


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op6_token_files(spark, folder: str) -> DataFrame:
    """Start, number and checksum of every document's ids, from the files."""
    where = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = read_token_files(write_token_files(docs, where, default_tokenizer()), where)
    return found.select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32")
    )
