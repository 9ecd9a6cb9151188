"""Archives: round trip, revisits, damage and what is salvaged behind it."""

import base64
import gzip
import hashlib
import os

import pytest

from riverine.llm import warc
from riverine.llm.warc import _readable, read_or_quarantine, read_warc, salvage, warc_round_trip, write_warc


def digest(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


PAGES = [(5, "http://a/1", "<p>é</p>"), (2, "http://a/2", "<p>é</p>"), (7, None, None), (8, "u\r\nX: y", ""), (9, "v", "WARC/1.1\r\n\r\nHTTP/1.1 200 OK\r\n\r\nx\r\n\r\n"), (10, "w", "x" * 70000), (None, "n", "no id"), (2, "http://a/2", "<p>é</p>"), (11, "dup", "one"), (11, "dup", "two")]


def frame(spark, rows=PAGES):
    return spark.createDataFrame([(*r, "z", 1) for r in rows], "page_id long, url string, html string, digest string, payload int")


def expected(rows, least=0):
    first = {}
    for i, _, t in rows:
        if i is not None:
            first[digest(t)] = min(first.get(digest(t), i), i)
    out = []
    for i, _, t in rows:
        n = len((t or "").encode())
        again = n >= least and i is not None and i > first[digest(t)]
        out.append((i, n, digest(t), "revisit" if again else "response", first[digest(t)] if again else None))
    return sorted(out, key=repr)


def test_round_trip(spark):
    for least in (0, 5):
        assert sorted(map(tuple, warc_round_trip(frame(spark), least).collect()), key=repr) == expected(PAGES, least)
    assert warc_round_trip(frame(spark, []).limit(0)).collect() == []


def archive(spark, tmp_path):
    path = str(tmp_path / "w")
    write_warc(frame(spark, [(i, "u", f"<p>{i}</p>") for i in range(6)]).coalesce(1), f"file://{path}")
    return b"".join((tmp_path / "w" / n).read_bytes() for n in sorted(os.listdir(path)) if n.startswith("part"))


def test_salvage(spark, tmp_path):
    data = archive(spark, tmp_path)
    whole = list(salvage(data))
    assert len(whole) == 6 and all(r["reason"] is None for r in whole) and whole[-1]["end"] == len(data)
    hurt = bytearray(data)
    hurt[whole[2]["end"] - 6] ^= 1  # a byte of the third payload
    got = list(salvage(bytes(hurt)))
    assert [r["reason"] for r in got] == [None, None, "block digest differs", None, None, None]
    assert (got[2]["offset"], got[2]["end"]) == (whole[2]["offset"], whole[2]["end"])
    torn = data[: whole[3]["offset"] + 40] + b"junk" + data[whole[4]["offset"] :]
    got = list(salvage(b"\0\0" + torn + b"WARC/1.1 tail"))
    assert [r["reason"] is None for r in got] == [False, True, True, True, False, True, True, False]
    assert sum(r["end"] - r["offset"] for r in got) == len(torn) + 15


def test_gzip_members(spark, tmp_path):
    data = archive(spark, tmp_path)
    records = [data[r["offset"] : r["end"]] for r in salvage(data)]
    members = [gzip.compress(r) for r in records]
    members[1] = members[1][:-12] + b"\0" * 12
    folder = tmp_path / "gz"
    folder.mkdir()
    (folder / "a.warc.gz").write_bytes(b"".join(members))
    (folder / "b.warc").write_bytes(records[0] + b"")
    (folder / "empty.warc").write_bytes(b"")
    rows = read_warc(spark, f"file://{folder}").orderBy("file", "offset").collect()
    assert len([r for r in rows if r.reason is None]) == 6
    gaps = [r for r in rows if r.reason]
    assert len(gaps) == 1 and gaps[0].reason.startswith("gzip") and gaps[0].end - gaps[0].offset == len(members[1]) and gaps[0].record_id is None
    assert {bytes(r.payload) for r in rows if r.reason is None} <= {f"<p>{i}</p>".encode() for i in range(6)}


@pytest.mark.parametrize("level", [0, 9])
def test_damage_within_a_gzip_member(spark, tmp_path, level):
    data = archive(spark, tmp_path)
    at = [r["offset"] for r in salvage(data)]
    ids = [r["record_id"] for r in salvage(data)]
    reasons = lambda rows: [r["reason"] for r in rows if r["reason"]]
    read = lambda rows: [r["record_id"] for r in rows if not r["reason"]]
    hurt = bytearray(data)
    hurt[at[3] - 6] ^= 1  # a byte of the third payload
    got = list(salvage(gzip.compress(bytes(hurt), level)))
    assert read(got) == ids[:2] + ids[3:] and reasons(got) == [f"in gzip member, bytes {at[2]} to {at[3]}: block digest differs"]
    last = gzip.compress(data[at[5] :], level)
    member = gzip.compress(data[: at[5]], level)
    _, cut = _readable(member, 0, at[3] + 40)  # within the fourth record
    for behind in (b"", last):
        got = list(salvage(member[:cut] + behind))
        # at level 0 the cut block reads on into the next member
        assert read(got) == ids[:3] + ids[5:] * bool(behind) and len(reasons(got)) == (1 if level or not behind else 2) and reasons(got)[-1].startswith("gzip")
    got = list(salvage(member[:-8] + b"\0" * 8 + last))  # a wrong checksum
    assert read(got) == ids and len(reasons(got)) == 1 and reasons(got)[0].startswith("gzip")
    assert [r["end"] for r in got][-3:] == [r["offset"] for r in got][-2:] + [len(member + last)]


def test_gaps_are_quarantined(spark, tmp_path):
    data = archive(spark, tmp_path)
    at = [r["offset"] for r in salvage(data)]
    hurt = bytearray(data)
    hurt[at[3] - 6] ^= 1
    (tmp_path / "hurt").mkdir()
    (tmp_path / "hurt" / "a.warc").write_bytes(bytes(hurt))
    records, gaps = read_or_quarantine(spark, f"file://{tmp_path}/hurt", f"file://{tmp_path}/gaps")
    assert records.count() == 5 and gaps == 1
    assert [(r.offset, r.end, r.reason) for r in spark.read.parquet(f"file://{tmp_path}/gaps").collect()] == [(at[2], at[3], "block digest differs")]


def test_large_pages_get_small_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "LARGE", 1000)
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    rows = [(i, "u", "y" * (3000 if i % 2 else 10) + str(i)) for i in range(20)]
    write_warc(frame(spark, rows).coalesce(1), f"file://{tmp_path}/w")
    sizes = [(tmp_path / "w" / n).stat().st_size for n in os.listdir(tmp_path / "w") if n.startswith("part")]
    assert max(sizes) <= 20_000 and len(sizes) >= 4
    assert sorted(map(tuple, warc_round_trip(frame(spark, rows)).collect()), key=repr) == expected(rows)
