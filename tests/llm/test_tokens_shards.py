"""Encoders against their libraries, token files by round trip, shards by their law."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from chartloom.llm import pieces, shards, token_files


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel(pieces.default_model())


def ids(model, text):
    return np.frombuffer(model.encode(text), "<i4").tolist()


def test_random_texts_equal_the_library(model, library):
    random.seed(11)
    letters = "ab  ▁\n\té日🙂\x00<>s/inertho   "
    for _ in range(4000):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 30)))
        assert ids(model, text) == library.encode(text)
        assert model.decode(library.encode(text)) == library.decode(library.encode(text))


def test_random_ids_decode_like_the_library(model, library):
    random.seed(12)
    for _ in range(2000):
        found = [random.randint(0, 31_999) if random.random() < 0.5 else random.randint(0, 260) for _ in range(random.randint(0, 12))]
        assert model.decode(found) == library.decode(found)


@pytest.mark.parametrize("text", ["abcdefgh" * 10_000, " " * 50_000, "é" * 9999, "\x01" * 5000])
def test_long_texts(model, library, text):
    assert ids(model, text) == library.encode(text)


def test_segments_are_encoded_once(model, library, monkeypatch):
    """Marks after a word make no new segment, and a full table keeps the segments that are met again."""
    encoded, pieces_of = [], model._pieces
    monkeypatch.setattr(model, "_pieces", lambda segment: encoded.append(segment) or pieces_of(segment))
    monkeypatch.setattr(model, "known", {})
    monkeypatch.setattr(model, "older", {}, raising=False)
    text = "the word, the word. the word; (the word)\nthe word"
    assert ids(model, text) == library.encode(text)
    assert sum("word" in segment for segment in encoded) == 1
    encoded.clear()
    monkeypatch.setattr(pieces, "KNOWN_SEGMENTS", 60)
    for i in range(200):
        text = "frequent " + " ".join(f"rare{chr(97 + i % 26)}{chr(97 + k)}{chr(97 + i // 26)}" for k in range(8))
        assert ids(model, text) == library.encode(text)
    assert encoded.count("▁frequent") == 1 and len(model.known) + len(model.older) <= 60


def test_decoding_at_once_is_decoding_each(model, library):
    random.seed(13)
    found = [[random.randint(0, 260 if k % 2 else 31_999) for _ in range(random.randint(0, 9))] for k in range(300)]
    assert model.decode_all([np.array(x, "<i4").tobytes() for x in found]) == [library.decode(x) for x in found]
    assert model.decode_all([]) == []


def test_pieces_query(spark, odd, as_folder, library):
    where = as_folder(documents=odd)
    got = sorted(str(tuple(r)) for r in pieces.op2_pieces(spark, where).collect())
    want = []
    for r in odd.collect():
        found = library.encode(r.text or "")
        digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append(str((r.doc_id, len(found), digest(",".join(map(str, found))), digest(library.decode(found)))))
    assert got == sorted(want)


def test_pieces_clash_empty_and_decode(spark, clashing, library):
    out = pieces.piece_encode(clashing, pieces.default_model(), decode=True)
    assert out.columns.count("ids") == 1 and out.count() == clashing.count()
    back = pieces.piece_decode(out.drop("decoded"), pieces.default_model()).where("doc_id = 7").first()
    assert back.decoded == library.decode(library.encode(back.text))
    assert pieces.piece_encode(clashing.limit(0), pieces.default_model()).count() == 0


def test_forgetting_reaches_the_worker(docs):
    """The function goes through the pickler, as on its way to a worker; there it has to drop the worker's model."""
    import pyarrow as pa
    from pyspark import cloudpickle

    class Taken:
        columns, schema = ["doc_id", "text"], docs.schema

        def select(self, *_):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            return run

    path = pieces.default_model()
    batch = pa.record_batch({"doc_id": [1, 2], "text": ["one two", None]})
    for forget in (False, True):
        pieces._MODELS.clear()
        run = cloudpickle.loads(cloudpickle.dumps(pieces.piece_encode(Taken(), path, forget=forget)))
        (out,) = run(iter([batch]))
        assert out.column("ids").to_pylist()[1] == [] and len(out.column("ids")[0]) > 0
        assert list(pieces._MODELS) == ([] if forget else [path])


def test_lean_gives_the_same_batches():
    import pyarrow as pa

    from chartloom.llm.common import lean

    given = [pa.record_batch({"x": [i]}) for i in range(3)]
    assert list(lean(lambda batches: (b.slice(0) for b in batches))(iter(given))) == given
    assert list(lean(lambda batches: batches)(iter([]))) == []


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, rng.choice([1, 2, 255, 300, 49_000, 2 ** 32 - 1]), rng.integers(1, token_files.BLOCK + 1), dtype="uint32")
        if rng.random() < 0.5:
            x[rng.integers(0, len(x), max(1, len(x) // 50))] = rng.integers(0, 2 ** 32 - 1)
        assert (token_files.unpack_block(token_files.pack_block(x)) == x).all()


def test_outliers_go_to_the_exception_list():
    x = np.zeros(4096, "uint32")
    x[7] = 2 ** 31
    assert len(token_files.pack_block(x)) < 64


def test_words_equal_the_library():
    from tokenizers import Tokenizer

    path = token_files.default_tokenizer()
    library, mine = Tokenizer.from_file(path), token_files.WordTokenizer(path)
    random.seed(13)
    parts = ["a", "b", "é", "É", "à", "÷", "×", "ß", "ª", "µ", "é", "\u0301", "\u0338", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85",
             "\u2028", "'s", "'", "İ", "Σ", "²", "<|endoftext|>", "日", "🙂", "!", "K", "ll", "'ll", "\u3000", "\x00", "\r", "1"]
    for _ in range(6000):
        text = "".join(random.choice(parts) for _ in range(random.randint(0, 14)))
        assert np.frombuffer(mine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def expected_files(rows):
    from tokenizers import Tokenizer

    library, at, out = Tokenizer.from_file(token_files.default_tokenizer()), 0, []
    for doc_id, text in rows:
        found = library.encode(text or "", add_special_tokens=False).ids + [token_files.END_ID]
        out.append((doc_id, at, len(found), zlib.crc32(np.array(found, "<u4").tobytes())))
        at += len(found)
    return out


def test_token_files_query(spark, docs, folder):
    given = sorted((r.doc_id, r.text) for r in docs.collect())
    got = sorted(tuple(r) for r in token_files.op6_token_files(spark, folder).collect())
    assert got == expected_files(given)


def test_token_files_of_odd_rows(spark, clashing, tmp_path):
    where = str(tmp_path / "files")
    manifest = token_files.write_token_files(clashing, where, token_files.default_tokenizer())
    found = token_files.read_token_files(manifest, where).collect()
    assert len(found) == clashing.count()
    found.sort(key=lambda r: r.start)
    keys = [(r.doc_id is not None, r.doc_id or 0) for r in found]
    assert keys == sorted(keys)
    assert all(a.start + len(a.ids) // 4 == b.start for a, b in zip(found, found[1:]))
    assert [np.frombuffer(r.ids, "<u4").tolist() for r in found if r.doc_id in (1, 2, 3)] == [[2], [2], [2]]
    assert token_files.write_token_files(clashing.limit(0), where, token_files.default_tokenizer()).count() == 0


def test_any_stretch_of_a_file(spark, docs, tmp_path):
    import pyarrow.fs as pafs

    where = str(tmp_path / "files")
    manifest = token_files.write_token_files(docs, where, token_files.default_tokenizer()).collect()
    store, path = pafs.FileSystem.from_uri(where)
    with store.open_input_file(f"{path}/{manifest[0].file}") as source:
        file = token_files.TokenFile(source)
        whole = np.frombuffer(b"".join(file.documents()), "<u4")
        assert (file.stretch(4000, 9000) == whole[4000:9000]).all()


def check_shards(rows, texts):
    by, total = defaultdict(list), sum(r["size"] for r in rows)
    for r in rows:
        by[r["shard"]].append(r)
    assert set(by) <= set(range(shards.SHARDS))
    for found in by.values():
        assert sorted(r["slot"] for r in found) == list(range(len(found)))
    largest = max(r["size"] for r in rows)
    share = total / shards.SHARDS
    for k in range(shards.SHARDS):
        assert abs(sum(r["size"] for r in by.get(k, [])) - share) <= 2 * largest + 2 * shards.TOGETHER * share
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows if r["doc_id"] is not None) == sorted(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in texts if i is not None
    )


def test_shards_query(spark, docs, folder):
    rows = [r.asDict() for r in shards.op5_shards(spark, folder).collect()]
    check_shards(rows, [(r.doc_id, r.text) for r in docs.collect()])


def test_shards_of_a_hot_text(spark):
    given = [(i, "the same long text again and again" * 20 if i % 3 else f"text {i} " * (i % 50)) for i in range(4000)]
    rows = [r.asDict() for r in shards.shards(spark.createDataFrame(given, "doc_id long, text string")).collect()]
    check_shards(rows, given)


def test_shards_of_repeated_rows_and_clashes(spark, clashing):
    given = [(5, "one row many times")] * 3000
    rows = [r.asDict() for r in shards.shards(spark.createDataFrame(given, "doc_id long, text string")).collect()]
    check_shards(rows, given)
    assert shards.shards(clashing).count() == clashing.count()
    assert shards.shards(clashing.limit(0)).count() == 0


def test_write_shards(spark, docs, tmp_path):
    shards.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and back.select("shard").distinct().count() == shards.SHARDS
