"""Infill texts, archives and the filter audit against plain versions."""

import base64
import hashlib
import re
from collections import Counter
from itertools import permutations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chartloom.llm import filter_audit, infill, warc

MARKED = [
    (20, "a line with <P> inside\nand more\n", "en", "s", 1), (21, "<M>", "en", "s", 1), (22, "\n\n\nx\n", "en", "t", 1),
    (23, "long unit " * 5_000 + "\nshort\n" + "é" * 30_000 + "\n", "en", "t", 1),
    (24, "".join(f"line {i} of many\n" for i in range(9_000)), "en", None, 1), (25, "< P>\n<\nP>\n<S\n>M>\n<", "en", "t", 1),
]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(scope="module")
def texts(spark, odd):
    return odd.unionByName(spark.createDataFrame(MARKED, odd.schema))


# infill


def plain_infill(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    found = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(found[i:i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")):
        return (doc_id, len(units), "plain", None, None, text)
    low, high = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if h[3] % 100 < 50:
        return (doc_id, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}")
    return (doc_id, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_infill_outputs_and_round_trip(texts):
    given_rows = [(r["doc_id"], r["text"]) for r in texts.collect()]
    expect = [plain_infill(*r) for r in given_rows]
    pieces = infill.fim_pieces(texts)
    assert rows_of(infill.fim_texts(pieces)) == sorted(expect, key=str)

    def sha(t):
        return hashlib.sha256((t or "").encode()).hexdigest()

    expect = [(*e[:5], sha(e[5]), sha(t)) for e, (_, t) in zip(expect, given_rows)]
    assert rows_of(infill.fim_round_trip(pieces)) == sorted(expect, key=str)


def test_infill_repeated_rows_in_one_partition(spark):
    df = spark.createDataFrame([(1, "a\nb\nc\n")] * 7 + [(None, "a\nb\n")] * 3 + [(None, None)] * 2, "doc_id long, text string").coalesce(1)
    found = infill.fim_round_trip(infill.fim_pieces(df)).collect()
    assert Counter((r["doc_id"], r["n"]) for r in found) == {(1, 3): 7, (None, 2): 3, (None, 0): 2}


def test_infill_extra_columns_and_empty_table(clashing, odd):
    assert rows_of(infill.fim_texts(infill.fim_pieces(clashing))) == rows_of(infill.fim_texts(infill.fim_pieces(odd)))
    assert infill.fim_round_trip(infill.fim_pieces(odd.limit(0))).count() == 0


def test_infill_rate_and_seed(texts):
    forms = Counter(r["form"] for r in infill.fim_texts(infill.fim_pieces(texts, rate=0)).collect())
    assert set(forms) == {"plain"}
    assert {r["form"] for r in infill.fim_texts(infill.fim_pieces(texts, spm=100)).collect()} == {"plain", "spm"}


def test_infill_query(spark, db, folder):
    expect = sorted(db.execute(infill.ORACLE).fetchall(), key=str)
    assert rows_of(infill.op11_infill(spark, folder)) == expect


@settings(max_examples=200, deadline=None)
@given(st.text("ab<>PSM\né", max_size=40), st.integers(0, 50), st.integers(1, 7))
def test_infill_restores_from_any_pieces(text, doc_id, step):
    _, _, form, _, _, output = plain_infill(doc_id, text)
    assert infill.restored_text(output, form) == text
    parts, back, data = [b"", b"", b""], infill.Restorer(form), output.encode()
    for i in range(0, len(data), step):
        for part, stretch in back.feed(data[i:i + step]):
            parts[part] += stretch
    back.close()
    assert b"".join(parts) == text.encode()


def test_infill_refuses_broken_outputs():
    for output in ("<P>a<S>b", "a<P>b<S>c<M>d", ""):
        with pytest.raises(ValueError):
            infill.restored_text(output, "psm")


# archives

PAGES = [
    (1, "http://a.org/", "<p>same</p>"), (2, "http://a.org/x y\r\nX-Page-Id: 9", "<p>same</p>"), (3, None, "<p>same</p>"),
    (4, "http://b.org/", None), (5, "http://b.org/", ""), (6, "http://c.org/", "é🙂\r\n\r\nWARC/1.1\r\n\r\n"),
    (None, "http://d.org/", "<p>same</p>"), (None, None, None), (7, "http://e.org/", "x" * 3_000_000), (8, "http://e.org/", "x" * 3_000_000),
    (9, "http://f.org/", "alone"), (9, "http://f.org/", "alone"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").repartition(3)


def plain_types(rows, least=0):
    """(page_id, size, digest, type, refers_to), the original of equal ids being any one of them."""
    best = {}
    for page_id, _, html in rows:
        key = html or ""
        best[key] = max(best.get(key, (False, 0)), (page_id is not None, page_id or 0))
    out, used = [], set()
    for page_id, _, html in rows:
        data = (html or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = best[html or ""] == (page_id is not None, page_id or 0) and (html or "") not in used
        if len(data) < least or first:
            used.add(html or "")
            out.append((page_id, len(data), digest, "response", None))
        else:
            out.append((page_id, len(data), digest, "revisit", best[html or ""][1] if best[html or ""][0] else None))
    return sorted(out, key=str)


def archives(spark, pages, tmp_path, least=0):
    raw, final = f"file://{tmp_path}/raw", f"file://{tmp_path}/final"
    manifest = warc.deduplicated(warc.write_warc(pages, raw), raw, final, least)
    return manifest, final


def test_archives_hold_every_page_once(spark, pages, tmp_path):
    manifest, final = archives(spark, pages, tmp_path)
    found = warc.read_warc(manifest, final, payloads=True).collect()
    keep = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted((tuple(r[c] for c in keep) for r in found), key=str) == plain_types(PAGES)
    responses = {r["record_id"]: r for r in found if r["record_type"] == "response"}
    assert len({r["record_id"] for r in found}) == len(PAGES)
    by_page = {(p, h) for p, _, h in PAGES}
    for r in found:
        if r["record_type"] == "revisit":
            to = responses[r["refers_to_id"]]
            assert (to["page_id"], to["payload_digest"]) == (r["refers_to"], r["payload_digest"])
        else:
            assert (r["page_id"], bytes(r["payload"]).decode()) in {(p, h or "") for p, h in by_page}


def test_archives_are_plain_gzip_members(spark, pages, tmp_path):
    import gzip
    import os

    archives(spark, pages, tmp_path)
    data = b"".join(gzip.open(f"{tmp_path}/final/{f}").read() for f in os.listdir(f"{tmp_path}/final"))
    assert data.count(b"\r\nWARC-Type: revisit\r\n") == sum(r[3] == "revisit" for r in plain_types(PAGES))
    assert b"x%20y%0D%0AX-Page-Id:%209" in data


def test_archives_least_size(spark, pages, tmp_path):
    manifest, final = archives(spark, pages, tmp_path, least=1)
    found = warc.read_warc(manifest, final).where("payload_bytes = 0")
    assert {r["record_type"] for r in found.collect()} == {"response"}


def test_archives_roll_and_hot_digests(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "HOT", 5)
    rows = [(i, "u", "hot" if i % 3 else f"page {i % 7}") for i in range(200)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    manifest, final = archives(spark, df, tmp_path)
    keep = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    found = sorted((tuple(r[c] for c in keep) for r in warc.read_warc(manifest, final).collect()), key=str)
    assert found == plain_types(rows)


def test_archives_of_no_pages_and_extra_columns(spark, pages, tmp_path):
    from pyspark.sql import functions as F

    (tmp_path / "a").mkdir()
    manifest, final = archives(spark, pages.limit(0), tmp_path / "a")
    assert warc.read_warc(manifest, final).count() == 0
    more = pages.withColumns({c: F.lit(1) for c in ("file", "at", "length", "record_id", "original", "payload_digest")})
    manifest, final = archives(spark, more, tmp_path)
    assert warc.read_warc(manifest, final).count() == len(PAGES)


def test_archive_query(spark, db, folder):
    assert rows_of(warc.op12_warc(spark, folder)) == sorted(db.execute(warc.ORACLE).fetchall(), key=str)


def test_broken_archives_are_refused():
    import io

    data = warc.record([("WARC-Type", "response")], b"block")
    assert [warc.parsed(m)[1] for m in warc.members(io.BytesIO(data * 3))] == [b"block"] * 3
    with pytest.raises(ValueError):
        list(warc.members(io.BytesIO(data[:-4])))
    with pytest.raises(ValueError):
        warc.parsed(b"HTTP/1.1 200\r\n\r\n")


# filter audit


def plain_masks(rows):
    least = {}
    for doc_id, text in rows:
        key = (doc_id is None, doc_id or 0)
        least[text or ""] = min(least.get(text or "", key), key)
    out = []
    for doc_id, text in rows:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        out.append(
            (len(words) < 50) + 2 * (100 * len(set(words)) < 65 * len(words)) + 4 * (100 * len(re.findall("[A-Z]", t)) > 5 * len(t))
            + 8 * bool(re.search(r"[#$%&*|]", t)) + 16 * (least[t] < (doc_id is None, doc_id or 0))
        )
    return out


def plain_report(rows, labels):
    """rows: (doc_id, text, part)."""
    masks = plain_masks([(d, t) for d, t, _ in rows])
    good = {d for d, q, _ in labels if q == 1} - {None}
    toxic = {d for d, _, x in labels if x == 1} - {None}
    out = {}
    for part in {p or "" for _, _, p in rows}:
        mine = [(d, m) for (d, _, p), m in zip(rows, masks) if (p or "") == part]
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, letter in enumerate(order, 1):
                bit = 1 << "ABCDE".index(letter)
                gone = [(d, m) for d, m in left if m & bit]
                left = [(d, m) for d, m in left if not m & bit]
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(bool(m & bit) for _, m in mine) - len(gone), sum(m == bit for _, m in mine),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone),
                ]
    for (part, order, step), row in out.items():
        letter = order[step - 1]
        row.append(sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == letter))
    return sorted(((*k, *v) for k, v in out.items()), key=str)


def audit(df, labels):
    found = filter_audit.order_report(filter_audit.mask_counts(filter_audit.filter_masks(df), labels))
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return rows_of(found.select(*names))


LABELS = [(1, 1, 0), (4, 1, 1), (4, 0, 1), (8, 1, None), (-5, 0, 1), (None, 1, 1), (7, None, 1), (99, 1, 1)]


@pytest.fixture(scope="module")
def some_labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_audit_of_odd_rows(texts, some_labels):
    again = texts.unionByName(texts.selectExpr("doc_id + 1 as doc_id", "text", "lang", "'u' as source", "n_chars"))
    rows = [(r["doc_id"], r["text"], r["source"]) for r in again.collect()]
    assert audit(again, some_labels) == plain_report(rows, LABELS)


def test_audit_with_small_buckets(spark, texts, some_labels, monkeypatch):
    shared = "the same long beginning of a text " * 20
    rows = [(i, shared + f"{i % 11} {'tail ' * (i % 5)}", "s", "x" if i % 2 else "y", 0) for i in range(300)]
    rows += [(i, shared, "s", "x", 0) for i in range(300, 500)] + [(None, shared, "s", "x", 0)] * 3
    df = texts.unionByName(spark.createDataFrame(rows, texts.schema)).repartition(5)
    monkeypatch.setattr(filter_audit.prefixed, "__defaults__", ("text", 2_000, 20))
    lengths = {r["n"] for r in filter_audit.prefixed(df.selectExpr("cast(text as binary) as text").where("text is not null"))
               .selectExpr("octet_length(prefix) as n").distinct().collect()}
    assert max(lengths) > 500 and 8 in lengths
    plain = [(r["doc_id"], r["text"], r["source"]) for r in df.collect()]
    assert audit(df, some_labels) == plain_report(plain, LABELS)


def test_audit_extra_columns_and_empty_tables(clashing, odd, some_labels):
    from pyspark.sql import functions as F

    more = clashing.withColumns({c: F.lit(1) for c in ("mask", "copies", "prefix", "part", "crowded")})
    assert audit(more, some_labels) == audit(odd, some_labels)
    assert audit(odd.limit(0), some_labels) == []
    none = audit(odd, some_labels.limit(0))
    assert none and {r[7] for r in none} == {0}


def test_audit_query(spark, db, folder):
    names = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    expect = sorted(db.execute(f"select {', '.join(names)} from ({filter_audit.ORACLE})").fetchall(), key=str)
    assert rows_of(filter_audit.op13_filter_audit(spark, folder).select(*names)) == expect


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=12).map(lambda b: bytes(x % 3 for x in b)), max_size=40))
def test_trie_ends(texts):
    found = filter_audit.Texts()
    for i, t in enumerate(texts):
        found.add(t, i, i)
    flags = dict((row, again) for again, row in found.flags())
    assert flags == {i: t in texts[:i] for i, t in enumerate(texts)}
