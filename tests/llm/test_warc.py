"""Archives: round trips, cuts anywhere, damage, odd rows."""

from __future__ import annotations

import gzip
import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from orograph.llm import warc

ODD = [
    (1, "http://a/ b\r\nX: y", None),
    (2, None, ""),
    (3, "u", "x" * 99),
    (4, "u", "x" * 99),
    (6, "u", "é" * 50),
    (5, "u", "é" * 50),
    (6, "u", "é" * 50),
    (None, "u", "é" * 50),
    (None, "u", "only here " * 20),
    (7, "u", "WARC/1.1\r\n\r\n\r\n\r\n" * 20),
    (8, "u", "long " * 400_000),
]


def frame(spark, rows):
    docs = spark.createDataFrame(rows, "page_id long, url string, html string")
    return docs.withColumns({c: F.lit("x") for c in ("digest", "payload", "first", "n", "error", "offset", "end", "path", "sha256")})


def expected(rows):
    first: dict = {}
    for page, _, html in rows:
        body = (html or "").encode()
        if len(body) >= 100:
            old = first.get(body)
            first[body] = page if old is None else old if page is None else min(page, old)
    for page, _, html in rows:
        body = (html or "").encode()
        to = first.get(body) if len(body) >= 100 else None
        to = None if to == page else to
        yield page, len(body), hashlib.sha256(body).hexdigest(), "response" if to is None else "revisit", to


@pytest.mark.parametrize("split", [1 << 9, 1 << 14, 1 << 25])
def test_odd_pages_come_back(spark, split):
    got = warc.through_archives(frame(spark, ODD), split_bytes=split).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, expected(ODD)))


def test_no_pages(spark):
    assert warc.through_archives(frame(spark, [])).count() == 0


def test_payloads_addresses_and_links(spark, tmp_path):
    root = str(tmp_path / "archives")
    warc.write_archives(frame(spark, ODD), root, file_bytes=1000)
    found = warc.read_archives(spark, root).where("record_type <> 'warcinfo'").collect()
    assert len({r.path for r in found}) > 1
    assert {r.payload.decode() for r in found if r.record_type == "response"} == {h or "" for _, _, h in ODD}
    assert all(r.sha256 == r.payload_digest for r in found if r.record_type == "response")
    ids = {r.record_id for r in found if r.record_type == "response"}
    assert all(r.refers_to_id in ids and r.payload is None for r in found if r.record_type == "revisit")
    assert {r.target_uri for r in found if r.page_id == 1} == {"http://a/%20b%0D%0AX:%20y"}
    assert warc.gaps(warc.read_archives(spark, root, columns=["path", "offset", "end"])).count() == 0


def _archive(n: int, seed: int) -> tuple[bytes, list[int]]:
    rng, data, places = random.Random(seed), b"", []
    for i in range(n):
        body = rng.choice([b"", warc.MAGIC * 9, b"a" * rng.randrange(3000), rng.randbytes(rng.randrange(40_000)), gzip.compress(b"WARC/1.1\r\nno header")])
        places.append(len(data))
        data += warc.record(i, "http://a", body, hashlib.sha256(body).hexdigest(), len(body), None)
    return data, places


def _read(data: bytes, cuts: list[int]) -> list[tuple]:
    bounds = [0, *sorted(cuts), len(data)]
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        out += [(at, stop, int(f["x-page-id"]), e) for at, stop, f, _, e in warc.records(pa.BufferReader(data), a, b)]
    return out


def test_each_record_has_one_owner_for_any_cuts():
    rng = random.Random(5)
    for seed in range(25):
        data, places = _archive(12, seed)
        cuts = [rng.randrange(len(data)) for _ in range(rng.randrange(9))] + rng.sample(places, 3)
        assert _read(data, cuts) == [(a, b, i, None) for i, (a, b) in enumerate(zip(places, [*places[1:], len(data)], strict=True))]


def test_damaged_records_are_told_and_passed(spark, tmp_path):
    rng, data, places = random.Random(3), b"", []
    for i in range(12):
        body = rng.randbytes(5000)
        places.append(len(data))
        data += warc.record(i, None, body, hashlib.sha256(body).hexdigest(), len(body), None)
    hurt = bytearray(data)
    hurt[places[4] + 2000 : places[4] + 2003] = b"\xff\xff\xff"  # within a member's data
    hurt[places[7]] = 0  # no magic any more
    found = _read(bytes(hurt)[: places[11] + 2000], [places[4] + 5, places[9] - 1])
    assert [(p, e is None) for _, _, p, e in found] == [(i, i not in (4, 11)) for i in range(12) if i != 7]
    (tmp_path / "x.warc.gz").write_bytes(bytes(hurt))
    read = warc.read_archives(spark, str(tmp_path), split_bytes=700)
    assert read.where("error is not null").count() == 1
    assert {(r.offset, r.end) for r in warc.gaps(read.where("error is null")).collect()} == {(places[4], places[5]), (places[7], places[8])}
