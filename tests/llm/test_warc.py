"""WARC: round trips through whole-file streams, members and offsets."""

from __future__ import annotations

import gzip
import io
import zlib
from hashlib import sha256

import pytest

from classlens.llm import warc
from classlens.llm.warc import (
    _inflated,
    archive_pages,
    member,
    normalise,
    read_records,
    records,
    split_records,
    write_monolithic,
)

SCHEMA = "page_id long, url string, html string, key string, value int"
LONG = "<p>" + "é payload \r\n\r\n WARC/1.1\r\n" * 20


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", 1) for i, u, h in rows], SCHEMA)


def brute(rows):
    first, out = {}, []
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 100 and first.get(h or "", i) != i
        out.append((i, len(data), sha256(data).hexdigest(), "revisit" if again else "response", first[h] if again else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most", [0, 100_000])
def test_round_trip(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_DIGESTS", most)
    rows = [(i, f"http://x/{i}", LONG if i % 3 else f"page {i} " * (i % 30)) for i in range(50, 0, -1)]
    rows += [(100, None, None), (101, "http://a b\r\nc", ""), (102, "u", "x" * 99), (103, "u", "x" * 99), (104, "u", "y" * 100)]
    rows += [(105, "u", "y" * 100), (106, "u", "z" * 3_000_000), (None, "u", LONG), (None, "u", "w" * 200), (1, "u", LONG)]
    got = archive_pages(pages(spark, rows)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute(rows)


def test_empty_table(spark):
    out = archive_pages(pages(spark, []))
    assert out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    assert out.collect() == []


def test_members_and_sidecar(spark, tmp_path):
    rows = [(i, "u", f"<p>{i}") for i in range(20)]
    write_monolithic(records(pages(spark, rows).coalesce(2), "page_id", "url", "html"), str(tmp_path / "whole"))
    made = normalise(spark, str(tmp_path / "whole"), str(tmp_path / "single"))
    assert sum(r["records"] for r in made.collect()) == 20
    for index in (tmp_path / "single").glob("*.idx"):
        data = (tmp_path / "single" / f"{index.stem}.warc.gz").read_bytes()
        whole, end = gzip.decompress(data), 0
        assert whole == b"".join(r for _, r in split_records(iter([whole])))
        for line in index.read_text().splitlines():
            _, offset, length, name = line.split("\t")
            assert int(offset) == end
            end += int(length)
            inflate = zlib.decompressobj(31)
            record = inflate.decompress(data[int(offset) : end])
            assert inflate.eof and not inflate.unused_data and name.encode() in record
        assert end == len(data)
    assert read_records(spark, str(tmp_path / "single")).count() == 20


def test_streams_of_one_or_more_members():
    record = b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab\r\nc\r\n\r\n"
    whole = gzip.compress(record * 3)
    for data in (whole, member(record) * 3, member(record * 2) + member(record)):
        assert [r for _, r in split_records(_inflated(io.BytesIO(data)))] == [record] * 3
    with pytest.raises(ValueError):
        list(split_records(_inflated(io.BytesIO(whole[:-10]))))
    with pytest.raises(ValueError):
        list(split_records(iter([record[:-6]])))
    with pytest.raises(ValueError):
        list(split_records(iter([b"HTTP/1.1 200 OK\r\n\r\n"])))
    assert list(split_records(_inflated(io.BytesIO(b"")))) == []
