"""Archives: exact round trips, revisits, and damage that must be noticed."""

import base64
import hashlib
import io

import pytest
from pyarrow.fs import FileSystem

from sumwise.llm import warc

HTML = ["<p>same</p>" * 40, "", None, "é漢🙂\r\n\r\nx", "z" * 300_000, "WARC/1.1\r\n\r\n"]


def pages(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")


def expected(rows, least):
    out = []
    for i, _, h in rows:
        data = (h or "").encode()
        same = [j for j, _, g in rows if (g or "") == (h or "") and j is not None]
        top = max(same, default=None)
        revisit = len(data) >= least and top is not None and i != top
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=str)


ROWS = [(i, f"http://h/{i}?a b\r\nx" if i % 5 else None, HTML[i % len(HTML)]) for i in range(40)]
ROWS += [(39, "http://h/39", HTML[39 % 6]), (3, "u", "own"), (None, "u", HTML[0]), (None, None, "only null"), (None, None, "only null")]


@pytest.mark.parametrize("least", [0, 100])
def test_round_trip(spark, least):
    got = warc.archive_digests(pages(spark, ROWS), least=least)
    assert sorted(map(tuple, got.collect()), key=str) == expected(ROWS, least)


def test_payloads_come_back(spark):
    many = [(i, f"u{i}", f"<p>{i}</p>" * (i % 50)) for i in range(3000)]
    archives = warc.write_archives(pages(spark, many))
    assert archives.agg({"records": "sum"}).first()[0] == 3000
    found = {r.id: r for r in warc.read_archives(archives).collect()}
    for i, u, h in many:
        r = found[str(i)]
        assert r.url == u and bytes((r if r.refers_to is None else found[r.refers_to]).payload) == h.encode()


def test_empty_table(spark):
    assert warc.archive_digests(pages(spark, [])).collect() == []


def one_archive(spark):
    row = warc.write_archives(pages(spark, [(i, "u", f"page {i} " * 50) for i in range(20)])).first()
    fs, where = FileSystem.from_uri(row.path)
    return fs.open_input_file(where).read(), row.records


def read_all(data):
    return [warc.parsed(f, "a") for f in warc.frames(io.BytesIO(data), "a")]


def test_damage_raises(spark):
    data, records = one_archive(spark)
    assert len(read_all(data)) == records + 1
    for bad in (data[:-3], data[:6], b"x" + data[1:], data[:40]):
        with pytest.raises((ValueError, warc.zstandard.ZstdError)):
            read_all(bad)
    good = warc.page_record("1", "u", b"body", None, None, "d")
    assert warc.parsed(good, "a")["payload"] == b"body"
    for bad in (good.replace(b"body", b"bod!"), good.replace(b"body", b"bodyy"), good.replace(b"1.1", b"1.0", 1), good[:-2], good.replace(b"WARC-Date", b"X")):
        with pytest.raises(ValueError):
            warc.parsed(bad, "a")


def test_dictionary_helps_small_records():
    samples = [f"<html><body><nav>menu</nav><p>{i * 7919}</p></body></html>".encode() * 3 for i in range(2000)]
    known = warc.dictionary_of(samples)
    assert known
    zipped = [len(warc.zstandard.ZstdCompressor(dict_data=d).compress(samples[5])) for d in (warc.zstandard.ZstdCompressionDict(known), None)]
    assert zipped[0] < zipped[1]
