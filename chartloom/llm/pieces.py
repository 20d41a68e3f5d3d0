"""SentencePiece encoding and decoding of merge-type (BPE) models by backtracking.

The pieces that match at a position come from a trie, walked only from positions
that the encoder reaches.  It takes the longest match, accepts it if it is compatible with
the token before it (merging the two tokens' characters anew gives the same two
tokens), tries shorter prefixes otherwise, and steps back over a token when none
is left, marking the position in a bitfield so that it is not tried again.  The
encoding of a prefix is unique, so a failed position fails for good and the
work stays linear in the text.

A text is cut where no piece can reach across: before a word mark that follows
another character (if the vocabulary has no piece with such an inside), between
letters and other characters (if no piece has both) and around characters
without a piece.  Segments repeat, so each task keeps a bounded table of
segments it has encoded: a young and an old half.  A full young half becomes the
old one; segments that are met again move to the young half, so frequent ones stay.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartloom.llm.common import fresh, lean, table

MARK = "▁"
#: segments and token pairs that a task remembers; forgetting costs time only
KNOWN_SEGMENTS, KNOWN_PAIRS = 450_000, 400_000
#: ids and text characters after which a task hands rows on
CHUNK = 4_000_000


class PieceModel:
    """The pieces of a sentencepiece BPE model and its encoder."""

    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as proto

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = proto.ModelProto()
        with open(path, "rb") as f:
            spec.ParseFromString(f.read())
        norm, train = spec.normalizer_spec, spec.trainer_spec
        if train.model_type != train.BPE or norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or train.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the identity normalizer that keep all spaces are read")
        if any(p.type in (p.USER_DEFINED, p.UNUSED) for p in spec.pieces):
            raise ValueError("models with user-defined or unused pieces are not read")
        self.prefix = MARK if norm.add_dummy_prefix else ""
        self.unknown = lib.unk_id()
        self.bytes = [lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if train.byte_fallback else None
        pieces = [(i, p.piece, p.score) for i, p in enumerate(spec.pieces) if p.type == p.NORMAL]
        self.score = {text: score for _, text, score in pieces}
        self.ids = {text: i for i, text, _ in pieces}
        self.chars = {text for text in self.ids if len(text) == 1}
        # only pieces that their own merges rebuild can appear in an encoding
        self.reached = {text for text in self.ids if len(text) == 1 or self.merge(text) == [text]}
        # a node of the trie: what follows by character, and the piece that ends here
        self.trie: list = [{}, None]
        for text in self.reached:
            node = self.trie
            for c in text:
                node = node[0].setdefault(c, [{}, None])
            node[1] = text
        self.longest = max(map(len, self.reached), default=0)
        self.cut = self._cut()
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        # decoding: what each id stands for
        out = [b""] * lib.get_piece_size()
        self.marked = [self.prefix != "" and p.type == p.NORMAL and p.piece.startswith(MARK) for p in spec.pieces]
        for i, p in enumerate(spec.pieces):
            if p.type == p.NORMAL:
                out[i] = p.piece.replace(MARK, " ").encode()
            elif p.type == p.BYTE:
                out[i] = bytes([int(p.piece[3:5], 16)])
            elif p.type == p.UNKNOWN:
                out[i] = train.unk_surface.encode()
        self.surface = pa.array(out, pa.large_binary())

    def _cut(self) -> re.Pattern | None:
        """What finds the segments of a text; None if pieces can reach across word marks."""
        if any(MARK in text.lstrip(MARK) for text in self.ids):
            return None
        letters = {c for c in self.chars if c.isalpha()}
        if not letters or any((a in letters) != (b in letters) for text in self.ids for a, b in pairwise(text.lstrip(MARK))):
            return re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
        each = "".join(map(re.escape, sorted(letters)))
        return re.compile(f"{MARK}*(?:[{each}]+|[^{each}{MARK}]+)|{MARK}+")

    def merge(self, text: str) -> list[str]:
        """Merge the characters of a short text: best score first, leftmost among equals."""
        parts = list(text)
        score = self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        if self.n_pairs >= KNOWN_PAIRS:
            self.pairs.clear()
            self.n_pairs = 0
        row = self.pairs.setdefault(left, {})
        found = row.get(right)
        if found is None:
            # merging the pair's characters anew must give the pair
            found = row[right] = self.merge(left + right) == [left, right]
            self.n_pairs += 1
        return found

    def matches(self, text: str, at: int) -> list[str]:
        """The pieces that the text has from a position on, shortest first."""
        follow, out = self.trie[0], []
        for c in text[at:at + self.longest]:
            node = follow.get(c)
            if node is None:
                break
            follow, piece = node
            if piece is not None:
                out.append(piece)
        return out

    def segment(self, text: str) -> list[str]:
        """Pieces of a text whose characters all have a piece."""
        if text in self.reached:
            return [text]
        n = len(text)
        failed = bytearray(n // 8 + 1)
        pairs, tokens = self.pairs, []
        tried: list[tuple[list[str], int]] = []  # matches at each token's start, and how many are left to try, longest last
        at, last, after = 0, None, None
        fits = self.matches(text, 0)
        left = len(fits)
        while True:
            while left:
                left -= 1
                token = fits[left]
                end = at + len(token)
                if failed[end >> 3] >> (end & 7) & 1:
                    continue
                if after is not None:
                    fine = after.get(token)
                    if fine is None:
                        fine = self.compatible(last, token)
                    if not fine:
                        continue
                tokens.append(token)
                if end == n:
                    return tokens
                tried.append((fits, left))
                at, last = end, token
                if (after := pairs.get(token)) is None:
                    after = pairs[token] = {}
                fits = self.matches(text, at)
                left = len(fits)
                break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                at -= len(tokens.pop())
                fits, left = tried.pop()
                last = tokens[-1] if tokens else None
                after = None if last is None else pairs.setdefault(last, {})

    def _pieces(self, segment: str) -> list[int]:
        ids = self.ids
        if self.chars.issuperset(segment):
            return [ids[t] for t in self.segment(segment)]
        out: list[int] = []
        run: list[str] = []
        for c in segment:
            if c in self.chars:
                run.append(c)
                continue
            if run:
                out += [ids[t] for t in self.segment("".join(run))]
                run = []
            out += [self.bytes[b] for b in c.encode()] if self.bytes else [self.unknown]
        if run:
            out += [ids[t] for t in self.segment("".join(run))]
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        if not text:
            return b""
        text = self.prefix + text.replace(" ", MARK)
        if self.cut is None:
            return array("i", self._pieces(text)).tobytes()
        segments = self.cut.findall(text)
        out = list(map(self.known.get, segments))
        if None in out:
            self._learn({segment for segment, found in zip(segments, out) if found is None})
            known = self.known
            out = [known[segment] if found is None else found for segment, found in zip(segments, out)]
        if self.bytes is None:
            return self._one_unknown(b"".join(out))
        return b"".join(out)

    def _learn(self, new: set[str]) -> None:
        """Put segments into the young half of the table, encoded anew if the old half lacks them."""
        if self.known and len(self.known) + len(new) > KNOWN_SEGMENTS // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        for segment in new:
            found = older.get(segment)
            known[segment] = array("i", self._pieces(segment)).tobytes() if found is None else found

    def _one_unknown(self, ids: bytes) -> bytes:
        """Neighbouring unknown characters are one unknown id."""
        a = np.frombuffer(ids, "<i4")
        if len(a) < 2:
            return ids
        return a[np.r_[True, ~((a[1:] == self.unknown) & (a[:-1] == self.unknown))]].tobytes()

    def decode(self, ids: list[int]) -> str:
        """The text of ids; each byte that is not part of valid UTF-8 becomes U+FFFD."""
        return self.decode_all([array("i", ids).tobytes()])[0]

    def decode_all(self, ids: list[bytes]) -> list[str]:
        """The texts of several encodings, looked up at once."""
        flat = np.frombuffer(b"".join(ids), "<i4")
        raw = self.surface.take(pa.array(flat))
        ends = np.frombuffer(raw.buffers()[1], "<i8", len(flat) + 1)
        data = memoryview(raw.buffers()[2] or b"")
        texts, at = [], 0
        for one in ids:
            stop = at + len(one) // 4
            part = bytes(data[ends[at]:ends[stop]])
            try:
                text = part.decode()
            except UnicodeDecodeError:
                text = _lenient(part)
            first = next((i for i in range(at, stop) if ends[i + 1] > ends[i]), None)
            texts.append(text[1:] if first is not None and self.marked[flat[first]] else text)
            at = stop
        return texts


def _lenient(raw: bytes) -> str:
    out = []
    while raw:
        try:
            out.append(raw.decode())
            break
        except UnicodeDecodeError as e:
            out.append(raw[:e.start].decode() + "�")
            raw = raw[e.start + 1:]
    return "".join(out)


_MODELS: dict[str, PieceModel] = {}


def _model(path: str) -> PieceModel:
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def _forget(path: str) -> None:
    """Drop the model; functions sent to workers call this, as naming ``_MODELS`` would send a copy of it along."""
    _MODELS.pop(path, None)


def _column(batch: pa.RecordBatch, ids: list[bytes], decoded: list[str] | None) -> pa.RecordBatch:
    sizes = np.fromiter((len(x) // 4 for x in ids), "int64", len(ids))
    offsets = np.zeros(len(ids) + 1, "int32")
    np.cumsum(sizes, out=offsets[1:])
    values = pa.py_buffer(b"".join(ids))
    flat = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, values])
    arrays = [*batch.columns, pa.ListArray.from_arrays(pa.array(offsets), flat)]
    names = [*batch.schema.names, "ids"]
    if decoded is not None:
        arrays.append(pa.array(decoded, pa.string()))
        names.append("decoded")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def piece_encode(df: DataFrame, model: str, text: str = "text", decode: bool = False, keep: list[str] | None = None, forget: bool = False) -> DataFrame:
    """The table's columns in ``keep`` (all by default) with ``ids`` (array of int) and, if asked for, ``decoded``.

    ``model`` is a path that every executor can open.  Null and empty texts have
    no ids and decode to the empty text.  Texts of any length are encoded whole;
    repeated rows are encoded alike; an empty table stays empty.  Input columns
    called ``ids`` or ``decoded`` are replaced.  With ``forget`` a task drops its
    model and table of known segments at its end and hands the memory back, so
    workers that go on to other work don't hold them.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in {"ids", "decoded"}]
    (source,) = [text] if text in kept else fresh(df, "piece_text")
    given = df.select(*kept, *([] if text in kept else [F.col(text).alias(source)]))
    fields = [df.schema[c] for c in kept]
    fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    if decode:
        fields.append(T.StructField("decoded", T.StringType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for batch in batches:
            rest = batch.select(kept)
            ids, start, held = [], 0, 0
            for i, value in enumerate(batch.column(source)):
                found = m.encode(value.as_py() or "")
                ids.append(found)
                held += len(found)
                if held >= CHUNK:
                    yield _column(rest.slice(start, i + 1 - start), ids, m.decode_all(ids) if decode else None)
                    ids, start, held = [], i + 1, 0
            if ids:
                yield _column(rest.slice(start), ids, m.decode_all(ids) if decode else None)
        if forget:
            _forget(model)

    return given.mapInArrow(lean(run) if forget else run, T.StructType(fields))


def piece_decode(df: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """The table with ``decoded``: the text of the ids column (null and no ids: empty)."""
    given = df.drop("decoded")
    schema = T.StructType([*given.schema.fields, T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(model)
        for batch in batches:
            back = m.decode_all([array("i", x.as_py() or []).tobytes() for x in batch.column(ids)])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(back, pa.string())], names=[*batch.schema.names, "decoded"])

    return given.mapInArrow(run, schema)


def ids_text(ids: Column) -> Column:
    return F.array_join(ids.cast("array<string>"), ",")


def digests(df: DataFrame) -> DataFrame:
    return df.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids_text(F.col("ids")), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op2_pieces(spark, folder: str) -> DataFrame:
    """Number and digest of every document's ids, and the digest of the text decoded from them."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return digests(piece_encode(docs, default_model(), decode=True, keep=["doc_id"]))


def stage(spark, docs: DataFrame, folder: str) -> DataFrame:
    """The documents with their ids; the text is the decoded one."""
    out = piece_encode(docs, default_model(), decode=True, keep=[c for c in docs.columns if c != "text"], forget=True)
    columns = [F.col("decoded").alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return out.select(*columns, F.size("ids").cast("long").alias("n_tokens"), "ids")
