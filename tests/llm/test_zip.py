"""Archives made by others and by us, read by their directories."""

import io
import zipfile

import pyarrow as pa
import pytest

from citeflow.llm import warc_zip


def opened(data):
    return pa.BufferReader(data)


def packed(members, force64=False, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in members:
            with z.open(name, "w", force_zip64=force64) as f:
                f.write(data)
        z.comment = comment
    return out.getvalue()


@pytest.mark.parametrize("force64", [False, True])
@pytest.mark.parametrize("comment", [b"", b"x" * 3000, b"PK\x05\x06 in the comment" + b"y" * 40])
def test_members_are_found(force64, comment):
    data = packed([("a.txt", b"alpha"), ("d/ü.bin", bytes(range(256)))], force64, comment)
    members = warc_zip.directory(opened(data), len(data))
    assert [m.name for m in members] == ["a.txt", "d/ü.bin"]
    for m, want in zip(members, (b"alpha", bytes(range(256))), strict=True):
        at = warc_zip.place(opened(data), m)
        assert data[at : at + m.size] == want


def test_zip64_end_record():
    """More members than the short end record can count."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for i in range(66_000):
            z.writestr(f"{i}", b"")
    data = out.getvalue()
    assert len(warc_zip.directory(opened(data), len(data))) == 66_000


def test_zip64_entry_fields():
    import struct

    extra = struct.pack("<HHQQQ", 1, 24, 5_000_000_001, 5_000_000_002, 5_000_000_003)
    full = warc_zip.FULL32
    assert warc_zip._sizes64(extra, full, full, full) == (5_000_000_002, 5_000_000_003)
    only = struct.pack("<HHQ", 1, 8, 7_000_000_000)
    assert warc_zip._sizes64(only, 5, 5, full) == (5, 7_000_000_000)


def test_broken_archives_are_refused():
    data = packed([("a", b"1")])
    with pytest.raises(ValueError):
        warc_zip.directory(opened(data[:-30]), len(data) - 30)
    squeezed = io.BytesIO()
    with zipfile.ZipFile(squeezed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", b"x" * 100)
    data = squeezed.getvalue()
    with pytest.raises(ValueError, match="not stored"):
        warc_zip.place(opened(data), warc_zip.directory(opened(data), len(data))[0])


def test_records_round_trip():
    url = "https://x.org/a%0Ab\r\nInjected: 1"
    for payload in (b"", b"<html>\r\n\r\n</html>", bytes(range(256)) * 9):
        row = warc_zip.parse(next(warc_zip.members_of(warc_zip.record(7, url, payload, None))))
        assert (row["page_id"], row["url"], row["payload"], row["payload_bytes"]) == (7, url, payload, len(payload))
        row = warc_zip.parse(next(warc_zip.members_of(warc_zip.record(None, None, payload, 7))))
        assert (row["page_id"], row["url"], row["refers_to"], row["payload"], row["payload_bytes"]) == (None, None, 7, None, len(payload))


def test_pages_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc_zip, "ARCHIVE_BYTES", 3000)
    monkeypatch.setattr(warc_zip, "RANGE_BYTES", 500)
    big = "é" * 600
    rows = [(i, f"u{i}", big if i % 3 else f"page {i}", 5) for i in range(40)] + [(None, None, None, 1), (None, "n", big, 1), (38, "again", big, 1), (50, "", "", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, payload int")
    got = warc_zip.archived(pages.repartition(3)).collect()
    assert len(got) == len(rows)
    want = sorted((str(i), str(u), (h or "").encode()) for i, u, h, _ in rows)
    back = {r["page_id"]: r["payload"] for r in got if r["record_type"] == "response"}
    assert sorted((str(r["page_id"]), str(r["url"]), r["payload"] if r["refers_to"] is None else back[r["refers_to"]]) for r in got) == want
    assert {r["record_type"] for r in got if r["page_id"] == 38} == {"response"}
    assert all(r["refers_to"] == 38 for r in got if r["record_type"] == "revisit")
    assert warc_zip.archived(pages.limit(0)).count() == 0
