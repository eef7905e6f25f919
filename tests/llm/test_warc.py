"""WARC archives: exact round trips, standard readers of gzip, damage."""

import base64
import glob
import gzip
import hashlib
import io
import random

import pytest

from webloom.llm import warc


def sha(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 3) for i, u, h in rows], "page_id long, url string, html string, record_type string, payload_bytes int")


ROWS = [
    (5, "https://x.example/a", "same"), (2, "https://x.example/b", "same"), (9, "https://x.example/c", "same"), (3, None, None), (4, "https://x.example/\r\nEvil: 1", ""), (7, "https://x.example/ü", "日本語 🙂\x00\r\n\r\nWARC/1.1"),
    (8, "u" * (1 << 21), "z" * 300_000), (6, "v", "HTTP/1.1 200 OK\r\n\r\n"), (11, "w", "dup"), (11, "w", "dup"), (11, "v", "dup"), (12, "w", "dup"), (None, "n", "same"), (None, "n", "alone"), (None, "m", "alone"),
]


@pytest.mark.parametrize("longest,least", [(warc.LONGEST, 0), (100, 0), (1000, 4)])
def test_round_trip(spark, tmp_path, longest, least):
    warc.write(pages(spark, ROWS).repartition(3), f"file://{tmp_path}/a", least, longest, most_records=2)
    found = warc.read(spark, f"file://{tmp_path}/a", payload=True)
    out = found.withColumn("page_id", warc.page_of(found["record_id"])).withColumn("to", warc.page_of(found["refers_to"])).collect()
    assert all(r["error"] is None for r in out) and len(out) == len({(r["archive"], r["offset"]) for r in out})
    body = lambda h: (h or "").encode()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"]) for r in out) == sorted((i or 0, len(body(h)), sha(body(h))) for i, _, h in ROWS)
    smallest = {}
    for i, _, h in ROWS:
        if i is not None:
            smallest[body(h)] = min(i, smallest.get(body(h), i))
    for payload, first in smallest.items():
        of = [r for r in out if r["payload_digest"] == sha(payload)]
        if len(payload) < least:
            assert all(r["record_type"] == "response" for r in of)
        else:
            assert [r["page_id"] for r in of if r["record_type"] == "response"] == [first]
            assert all(r["to"] == first for r in of if r["record_type"] == "revisit")
    assert [r["record_type"] for r in out if r["payload_digest"] == sha(b"alone")] == ["response"] * 2
    whole = warc.resolved(found).select("payload", "payload_digest").collect()
    assert len(whole) == len(ROWS) and all(sha(bytes(r["payload"])) == r["payload_digest"] for r in whole)
    urls = {warc_id: u for warc_id, u in ((r["record_id"], r["target_uri"]) for r in out)}
    assert urls["urn:page:4"] == "https://x.example/%0D%0AEvil:%201" and urls["urn:page:8"] is None and urls["urn:page:7"] == "https://x.example/ü"


def test_members_are_what_gzip_reads(spark, tmp_path):
    warc.write(pages(spark, ROWS), str(tmp_path / "a"))
    files = glob.glob(f"{tmp_path}/a/*.warc.gz")
    text = b"".join(gzip.open(f).read() for f in files)
    assert files and text.count(b"WARC/1.1\r\nWARC-Type: ") == len(ROWS)
    for f in files:
        data = open(f, "rb").read()
        for r in warc.Reader(io.BytesIO(data)).records():  # each record begins a member
            assert data[r["offset"] : r["offset"] + 3] == b"\x1f\x8b\x08"


def archive(n=30):
    rng = random.Random(2)
    out = []
    for i in range(n):
        payload = bytes(rng.randrange(256) for _ in range(rng.randrange(3000)))
        out += warc.record(f"urn:page:{i}", "u", payload, hashlib.sha1(payload).digest(), "urn:page:0" if i % 7 == 6 else None, longest=1000)
    return out


class Drip(io.BytesIO):
    """A stream that gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7))


def test_small_pieces_read_the_same():
    data = b"".join(archive())
    want = [warc.row(r) for r in warc.Reader(io.BytesIO(data)).records()]
    assert want == [warc.row(r) for r in warc.Reader(Drip(data)).records()]
    assert len(want) == 30 and all(r[-1] is None for r in want)


def test_damage_is_told():
    members = archive()
    data = b"".join(members)
    rows = lambda b: [warc.row(r) for r in warc.Reader(io.BytesIO(b)).records()]
    whole = rows(data)
    for cut in random.Random(1).sample(range(1, len(data)), 60):
        got = rows(data[:cut])
        kept = [r for r in got if r[-1] is None]
        assert kept == whole[: len(kept)]
        assert any(r[-1] for r in got) or cut in {sum(map(len, members[:k])) for k in range(len(members))}
    broken = bytearray(data)
    broken[len(members[0]) + 40] ^= 0xFF
    assert rows(bytes(broken))[-1][-1]
    lies = warc.member([("WARC-Type", "response"), ("WARC-Payload-Digest", "sha1:AAAA"), ("Content-Type", "application/http")], b"HTTP/1.1 200 OK\r\n\r\nx")
    assert [r[-1] for r in rows(lies + members[0])][0] == "payload digest" and len(rows(lies + members[0])) >= 2
    assert rows(b"no gzip at all")[0][-1] and rows(gzip.compress(b"no record\r\n\r\n"))[0][-1] and rows(b"") == []
    other = gzip.compress(b"WARC/1.0\r\nwarc-type: warcinfo\r\ncontent-length: 3\r\n\r\nabc\r\n\r\n")
    assert rows(other)[0][2] == "warcinfo"


def test_no_pages(spark, tmp_path):
    warc.write(pages(spark, []), str(tmp_path / "a"))
    assert warc.read(spark, str(tmp_path / "a")).collect() == []
