"""Documents written once, read back, and what becomes of broken ones; image sizes from made headers."""

import json
import os
import random
import struct

import pytest

from cairn.operators import retrieval
from cairn.sources import archives, images

DATA = "struct<sample_id:string,ingestion_review:struct<needs_review:boolean>>"


def made(spark, rows):
    docs = spark.createDataFrame([(p, (s, (r,))) for p, s, r in rows], f"proposal_id string, data {DATA}")
    return docs, spark.createDataFrame(rows, "proposal_id string, sample_id string, needs_review boolean")


def jobs(spark, *pairs):
    return spark.createDataFrame(list(pairs), "proposal_id string, output_relative_path string")


def test_refused_and_verified_documents(spark, rows, tmp_path):
    docs, proposals = made(spark, [("a", "D1", False), ("b", None, True), ("c", "D3", False)])
    asked = jobs(spark, ("a", "x/a"), ("b", "x/b"), ("c", "x/a"), ("d", "x/d"), ("e", "x/e"))
    existing = spark.createDataFrame([("x/e",)], "relative_path string")
    folder = str(tmp_path / "out")
    done = archives.generate(docs, asked, proposals, folder, existing)
    assert rows(done.outputs, "proposal_id") == [("a", f"{folder}/x/a", "x/a"), ("b", f"{folder}/x/b", "x/b")]
    assert rows(done.failures, "proposal_id") == [
        ("c", archives.DUPLICATE), ("d", archives.UNKNOWN), ("e", "collision: output target already exists"),
    ]
    assert tuple(done.counts().first()) == (5, 2, 3)
    with pytest.raises(Exception, match="already exists"):
        archives.write_archives(docs, asked, folder)


def test_broken_and_changed_rows_fail_their_read_back(spark, rows, tmp_path):
    docs, proposals = made(spark, [("a", "D1", False), ("b", "D2", False), ("c", "D3", False)])
    asked = jobs(spark, ("a", "x/a"), ("b", "x/b"), ("c", "x/c"))
    folder = str(tmp_path / "out")
    archives.write_archives(docs, asked, folder)
    for name in os.listdir(folder):
        path = os.path.join(folder, name)
        if name.endswith(".crc"):
            os.unlink(path)
        elif name.endswith(".json"):
            lines = open(path).read().splitlines()
            out = []
            for line in lines:
                row = json.loads(line)
                if row["proposal_id"] == "a":
                    out.append(line[: len(line) // 2])
                elif row["proposal_id"] == "b":
                    row["data"]["sample_id"] = "other"
                    out.append(json.dumps(row))
                else:
                    out.append(line)
            open(path, "w").write("\n".join(out))
    done = archives.verify(spark, asked, proposals, folder, DATA)
    assert rows(done.failures, "proposal_id") == [("a", archives.BROKEN), ("b", "sample id differs")]
    assert [r["proposal_id"] for r in done.outputs.collect()] == ["c"]
    assert archives.read_archives(spark, folder, DATA)[2].count() == 1


def test_no_documents(spark, tmp_path):
    docs, proposals = made(spark, [])
    done = archives.generate(docs, jobs(spark), proposals, str(tmp_path / "out"))
    assert tuple(done.counts().first()) == (0, 0, 0)


def jpeg(rng, width, height):
    parts = [b"\xff\xd8"]
    for _ in range(rng.randrange(4)):
        body = rng.randbytes(rng.randrange(30))
        parts.append(b"\xff" * rng.randrange(1, 3) + bytes([rng.choice([0xE0, 0xE1, 0xDB, 0xC4, 0xFE])]) + struct.pack(">H", len(body) + 2) + body)
    frame = struct.pack(">BHHB", 8, height, width, 3) + bytes(9)
    parts.append(b"\xff" + bytes([rng.choice([0xC0, 0xC1, 0xC2])]) + struct.pack(">H", len(frame) + 2) + frame)
    return b"".join(parts)


def tiff(rng, width, height):
    order = rng.choice("<>")
    entries = [(256, rng.choice([3, 4]), width), (257, rng.choice([3, 4]), height), (262, 3, 1)]
    rows = [struct.pack(f"{order}HHI", tag, kind, 1) + (struct.pack(f"{order}Hxx", v) if kind == 3 else struct.pack(f"{order}I", v)) for tag, kind, v in entries]
    gap = rng.randbytes(rng.randrange(9))
    head = {"<": b"II*\0", ">": b"MM\0*"}[order] + struct.pack(f"{order}I", 8 + len(gap))
    return head + gap + struct.pack(f"{order}H", len(rows)) + b"".join(rows)


@pytest.mark.parametrize("make,read", [(jpeg, images.jpeg_size), (tiff, images.tiff_size)])
def test_sizes_of_made_headers(make, read):
    rng = random.Random(5)
    for _ in range(300):
        size = rng.randrange(1, 65536), rng.randrange(1, 65536)
        data = make(rng, *size)
        assert read(data) == size
        for cut in range(len(data)):
            assert read(data[:cut]) in (None, size)
    assert read(b"") is None and read(rng.randbytes(64)) is None


@pytest.mark.parametrize("ends", [(float("nan"), None), (None, float("inf")), (True, None), ("1", None), (2, 1)])
def test_ranges_that_are_none(ends):
    with pytest.raises(ValueError):
        retrieval.NumericRange(*ends)


@pytest.mark.parametrize("page", [(0, 0), (201, 0), (True, 0), (50, -1), (50, False), (1.0, 0), ("5", 0)])
def test_pages_that_are_none(page):
    with pytest.raises(ValueError):
        retrieval.check_page(*page)


def test_filters_outside_the_allowlist():
    assert retrieval.check_filters(None, ("a",), "x") == {} and retrieval.check_filters({"a": None}, ("a",), "x") == {"a": None}
    with pytest.raises(ValueError, match="no x filter on b"):
        retrieval.check_filters({"b": 1, "a": 2}, ("a",), "x")
    with pytest.raises(TypeError):
        retrieval.check_filters([("a", 1)], ("a",), "x")
