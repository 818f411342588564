"""Readers, writers, flows and the streaming discovery on generated files."""

import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from cairn import schemas
from cairn.operators import inventory, previews, quality
from cairn.plans import flows
from cairn.sources import catalog, images, listing, manifests, slides, tables
from cairn.streaming import discovery

P = "http://schemas.openxmlformats.org/presentationml/2006/main"
A = "http://schemas.openxmlformats.org/drawingml/2006/main"
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def put(root, files):
    for name, body in files.items():
        target = root / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_bytes(body if isinstance(body, bytes) else body.encode())


def rels(*items):
    inner = "".join(f'<Relationship Id="{i}" Type="x/{k}" Target="{t}"/>' for i, k, t in items)
    return f'<Relationships xmlns="p">{inner}</Relationships>'


def shape(text, title=False):
    ph = '<p:nvPr><p:ph type="title"/></p:nvPr>' if title else ""
    runs = "".join(f"<a:t>{t}</a:t>" for t in text)
    return f"<p:sp>{ph}{runs}</p:sp>"


def slide(*shapes):
    return f'<p:sld xmlns:p="{P}" xmlns:a="{A}"><p:cSld><p:spTree>{"".join(shapes)}</p:spTree></p:cSld></p:sld>'


def deck():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/presentation.xml", f'<p:p xmlns:p="{P}" xmlns:r="{R}"><p:sldIdLst><p:sldId r:id="b"/><p:sldId r:id="a"/></p:sldIdLst></p:p>')
        z.writestr("ppt/_rels/presentation.xml.rels", rels(("a", "slide", "slides/slide1.xml"), ("b", "slide", "slides/slide2.xml")))
        z.writestr("ppt/slides/slide1.xml", slide(shape(["One"], True), shape(["x", " y "]), shape(["x"])))
        z.writestr("ppt/slides/slide2.xml", slide(shape(["two"])))
        z.writestr("ppt/slides/_rels/slide1.xml.rels", rels(("n", "notesSlide", "../notes/n1.xml"), ("i", "image", "../media/i.png")))
        z.writestr("ppt/notes/n1.xml", slide(shape([" said ", ""])))
    return out.getvalue()


def png(w, h):
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", w, h)


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0" + struct.pack(">HBHHB", 8, 8, h, w, 1) + b"\xff\xd9"


def tiff(w, h):
    entries = struct.pack("<HHIHH", 256, 3, 1, w, 0) + struct.pack("<HHII", 257, 4, 1, h)
    return b"II" + struct.pack("<HIH", 42, 8, 2) + entries


def test_listing_and_selection(spark, tmp_path, rows):
    put(tmp_path, {"a b/x+1.csv": "1", "a b/é.dat": "22", "r.txt": "333"})
    found = listing.list_folder(spark, str(tmp_path))
    assert rows(found.select("relative_path", "size_bytes"), "relative_path") == [("a b/x+1.csv", 1), ("a b/é.dat", 2), ("r.txt", 3)]
    wanted = spark.createDataFrame([("a b//x+1.csv",), ("a b/x+1.csv",), ("none",)], "relative_path string")
    got, missing = listing.pick(found, wanted)
    assert rows(got.select("relative_path")) == [("a b/x+1.csv",)] and rows(missing) == [("none",)]


def test_slides_and_package_facts(spark, tmp_path, rows):
    put(tmp_path, {"d/deck.pptx": deck(), "d/bad.pptx": b"no zip"})
    files = listing.contents(spark, str(tmp_path), ("pptx",), previews.POLICY.source_bytes)
    got = slides.read_slides(files).orderBy("slide_index").collect()
    assert [(s["slide_index"], s["title"], s["text_runs"], s["labels"], s["notes"], s["image_refs"]) for s in got] == [
        (1, None, ["two"], ["two"], None, []), (2, "One", ["x", " y ", "x"], ["x", "y"], "said", ["../media/i.png"]),
    ]
    text = previews.slide_search_text(slides.read_slides(files)).first()["search_text"]
    assert text == "two One x y x said"
    facts = slides.inspect_packages(files)
    assert {r["relative_path"]: (r["slides"], r["problem"]) for r in facts.collect()} == {
        "d/deck.pptx": (2, None), "d/bad.pptx": (None, "not a readable package"),
    }
    tight = previews.PreviewPolicy(slides=1, package_members=3)
    assert {r["rule"] for r in quality.preview_cap_violations(facts, tight).collect()} == {"member count exceeds the cap", "slide count exceeds the cap"}


def test_image_dimensions(spark, tmp_path, rows):
    put(tmp_path, {"a.png": png(3, 4), "b.jpg": jpeg(50, 60), "c.tif": tiff(7, 8), "d.jpeg": b"\xff\xd8nope", "e.png": b"short", "f.tiff": b"MM"})
    files = listing.contents(spark, str(tmp_path), ("png", "jpg", "jpeg", "tif", "tiff"), 1000)
    sizes = images.read_dimensions(files)
    assert rows(sizes, "relative_path") == [
        ("a.png", 3, 4), ("b.jpg", 50, 60), ("c.tif", 7, 8), ("d.jpeg", None, None), ("e.png", None, None), ("f.tiff", None, None),
    ]
    found = previews.image_problems(sizes, previews.PreviewPolicy(image_axis=55))
    assert {r["relative_path"]: r["finding"] for r in found.collect()} == {"b.jpg": "too_large", "d.jpeg": "malformed", "e.png": "malformed", "f.tiff": "malformed"}


def test_table_cells(spark, tmp_path):
    put(tmp_path, {"t.csv": "﻿time,value\n1,2\n2,5\n", "q.csv": 'a;"b;c"\n1;2\n', "w.dat": "x  y\n1 2\n", "long.csv": "h\n" + "z" * 600})
    files = listing.contents(spark, str(tmp_path), ("csv", "dat"), 10_000)
    cells = tables.read_cells(files)
    texts = {r["relative_path"]: r["search_text"] for r in previews.table_search_text(cells, "relative_path").collect()}
    assert (texts["t.csv"], texts["q.csv"], texts["w.dat"]) == ("time value 1 2 2 5", "a b;c 1 2", "x y 1 2")
    assert {r["relative_path"] for r in tables.table_findings(cells, files).collect()} == {"long.csv"}


def test_manifests_round_trip_and_malformed(spark, tmp_path):
    base = dict(
        manifest_version=1, batch_id="B1", batch_number=1, dataset_label=None, status="planned", proposal_ids=["p"],
        archive_files=[dict(source_path="s", destination_path="../d", role="archive")], companion_files=[], expected_entry_count=1,
        expected_file_count=1, publish=False, upload_name="u", upload_id=None, entry_ids=[], processing_status=None, verification_status=None,
        created_utc="2024-01-01T00:00:00Z", updated_utc="2024-01-01T00:00:00",
    )
    put(
        tmp_path,
        {
            "batch-001.json": json.dumps(base, indent=1), "batch-001.final.json": json.dumps(base | {"status": "success"}),
            "batch-002.json": "{broken", "batch-x.json": "{}", "batch-003.odd.json": json.dumps(base),
        },
    )
    good, bad = manifests.read_manifests(spark, str(tmp_path))
    assert sorted((r["batch_number"], r["stage"], r["status"]) for r in good.collect()) == [(1, "base", "planned"), (1, "final", "success")]
    assert {r["file_name"]: r["problem"] for r in bad.collect()} == {
        "batch-002.json": "invalid batch manifest", "batch-x.json": "unrecognized batch artifact name", "batch-003.odd.json": "unrecognized lifecycle artifact suffix",
    }
    rules = {r["rule"] for r in quality.manifest_violations(good).collect()}
    assert rules == {"updated_utc is not UTC"}
    docs = spark.createDataFrame([("s", None, None)], "source_path string, data struct<ingestion_review:struct<needs_review:boolean,warnings:array<string>>>, _corrupt_record string")
    existing = spark.createDataFrame([("other", True)], "relative_path string, is_regular boolean")
    problems = {r["problem"] for r in quality.preflight_problems(good.where("stage = 'base'"), existing, docs).collect()}
    assert problems == {
        "missing source file: s", "unsafe traversal relative path: ../d", "unsafe traversal transport destination: ../d", "archive read-back failed: s",
    }
    out = str(tmp_path / "out")
    manifests.write_manifests(good.drop("stage"), out)
    with pytest.raises(Exception, match="(?i)exist"):
        manifests.write_manifests(good.drop("stage"), out)


NAMES = [
    "D345 a/Initial Data/D345_4K_633nm.csv", "D345 a/Processed Data/D345_4K_633nm_PL.dat", "D345 a/Processed Data/D345_4K_633nm_PL_log.png",
    "D345 a/Initial Data/D345_5K_633nm.csv", "D345 a/doc.pdf",
]


def test_catalog_versions_and_linkage_are_repeatable(spark, tmp_path):
    from cairn.operators.devices import scan_devices
    from cairn.operators.proposals import classified_files

    files = spark.createDataFrame([(n, 1, 1) for n in NAMES], schemas.LISTING)
    ids = classified_files(files).select("group_key").distinct().withColumn("experiment_id", F.concat(F.lit("X-"), "group_key"))
    scan = scan_devices(files, "src")
    made = flows.assemble_catalog(files, ids, "src", "v1", scan.devices, scan.artifacts, scan.claims, scan.relationships)
    root = str(tmp_path / "cat")
    assert flows.replace_catalog(spark, root, made) == 1
    first = catalog.read_catalog(spark, root)
    assert {n: first[n].count() for n in first} == {
        "experiments": 2, "experiment_files": 4, "devices": 1, "artifacts": 5, "metadata_claims": 8, "relationships": 7,
        "derivations": 0,
        "unresolved_links": 0,
    }
    assert flows.link_catalog(spark, root) == 2
    second = catalog.read_catalog(spark, root)
    assert second["experiments"].count() == 4 and second["relationships"].where("predicate = 'measured_on'").count() == 2
    assert flows.link_catalog(spark, root) == 3
    assert flows.compare_catalogs(second, catalog.read_catalog(spark, root)).count() == 0
    broken = dict(first, devices=first["devices"].limit(0))
    with pytest.raises(ValueError, match="catalog is not valid"):
        flows.replace_catalog(spark, root, broken)
    assert catalog.current_version(spark, root) == 3


def lab_catalog(spark, names):
    from cairn.operators.devices import scan_devices
    from cairn.operators.proposals import classified_files

    files = spark.createDataFrame([(n, 1, 1) for n in names], schemas.LISTING)
    ids = classified_files(files).select("group_key").distinct().withColumn("experiment_id", F.concat(F.lit("X-"), "group_key"))
    scan = scan_devices(files, "src")
    return flows.assemble_catalog(files, ids, "src", "v1", scan.devices, scan.artifacts, scan.claims, scan.relationships)


def test_wide_experiments_answer_all_their_edges(spark, tmp_path):
    from cairn.functions import ids
    from cairn.operators import lineage

    # One raw stem in two folders and several sources of processed files: 120 x 120 pairs.
    stem = "D345_4K_633nm"
    artifacts = spark.range(240).select(
        F.concat(F.lit("art-"), "id").alias("artifact_id"), F.lit("D345").alias("device_id"),
        F.concat(F.lit("src"), (F.col("id") % 120).cast("string")).alias("storage_source_id"),
        F.when(F.col("id") < 120, f"D345 a/Initial Data/{stem}.csv").otherwise(f"D345 a/Processed Data/{stem}_PL.dat").alias("relative_path"),
        F.when(F.col("id") < 120, "csv").otherwise("dat").alias("extension"),
        F.lit("UNKNOWN").alias("role"), F.lit("UNKNOWN").alias("category"), F.lit("UNKNOWN").alias("media_type"), F.lit("unknown").alias("review_state"),
        F.lit(1).cast("long").alias("size_bytes"), F.lit(1).cast("long").alias("mtime_ns"), F.lit("{}").alias("metadata_json"),
    )
    made = lab_catalog(spark, NAMES[:1]) | {"artifacts": artifacts}
    made["relationships"] = made["relationships"].limit(0)
    root = str(tmp_path / "wide")
    flows.replace_catalog(spark, root, made)
    flows.link_catalog(spark, root)
    tables = catalog.read_catalog(spark, root)
    assert tables["derivations"].count() == 240 and tables["relationships"].where("predicate = 'derived_from'").count() == 0
    files = tables["derivations"].where("side = 'upstream'").select("file_id")
    edges = lineage.edges_of_files(tables["relationships"], tables["derivations"], files)
    assert edges.select("relationship_id").distinct().count() == 120 * 120
    one = spark.range(1).select(ids.file_id(F.lit("src7"), F.lit(f"D345 a/Processed Data/{stem}_PL.dat")).alias("file_id"))
    assert lineage.edges_of_files(tables["relationships"], tables["derivations"], one).select("source_id").distinct().count() == 120


def test_of_two_writers_the_second_starts_over(spark, tmp_path):
    root = str(tmp_path / "raced")
    first = lab_catalog(spark, NAMES)
    flows.replace_catalog(spark, root, first)
    mine = catalog.stage_catalog(spark, root, first)
    theirs = catalog.stage_catalog(spark, root, first | {"devices": first["devices"].withColumn("review_state", F.lit("accepted"))})
    assert mine.version == theirs.version == 2 and mine.folder != theirs.folder
    catalog.commit_catalog(spark, root, theirs)
    with pytest.raises(catalog.CommitConflict):
        catalog.commit_catalog(spark, root, mine)
    assert catalog.read_catalog(spark, root)["devices"].first()["review_state"] == "accepted"
    calls = []

    def change(tables):
        calls.append(tables["devices"].first()["review_state"])
        if len(calls) == 1:  # another writer comes in between
            catalog.commit_catalog(spark, root, catalog.stage_catalog(spark, root, tables | {"devices": tables["devices"].withColumn("review_state", F.lit("rejected"))}))
        return tables

    assert flows.update_catalog(spark, root, change) == 4 and calls == ["accepted", "rejected"]
    assert catalog.read_catalog(spark, root)["devices"].first()["review_state"] == "rejected"


def test_indexing_run(spark):
    names = [*NAMES, "D1/Initial Data/D1_4K_p1_633nm.csv", "D1/Initial Data/D1_4K_P1_633nm.csv"]
    records = spark.createDataFrame(
        [(n, 1, 1, "present", "pending", None, None, None, None, None, 1, "t0", "t0") for n in names], schemas.INVENTORY
    )
    files = records.select("relative_path", "size_bytes", "mtime_ns")
    got = {r["relative_path"]: (r["metadata_status"], r["parser_version"]) for r in flows.run_indexing(records, files, "v1", "t1").collect()}
    assert got[NAMES[0]] == ("indexed", "v1") and got[NAMES[4]] == ("failed", None)
    assert got["D1/Initial Data/D1_4K_p1_633nm.csv"] == ("pending", None)


def test_stream_discovery_resumes(spark, tmp_path):
    src, out, chk = tmp_path / "src", str(tmp_path / "out"), str(tmp_path / "chk")
    put(src, {f"u/f{i}.csv": "x" * (i + 1) for i in range(5)})

    def run():
        discovery.start_discovery(spark, str(src), out, chk, "s1", 1, "t0", 2).awaitTermination()
        return {r["relative_path"]: r["outcome"] for r in discovery.read_discovered(spark, out).collect()}

    assert run() == {f"u/f{i}.csv": "new" for i in range(5)}
    assert len(list((tmp_path / "out" / "generation=1").glob("batch=*"))) == 3
    put(src, {"u/g.csv": "new"})
    assert set(run()) == {f"u/f{i}.csv" for i in range(5)} | {"u/g.csv"}
    with pytest.raises(ValueError):
        discovery.discovered_files(spark, str(src), 0)
    later = inventory.unseen_in_generation(
        spark.createDataFrame([("u/g.csv", 3, 1), ("u/h.csv", 3, 1)], schemas.LISTING), discovery.read_discovered(spark, out), 1
    )
    assert [r["relative_path"] for r in later.collect()] == ["u/h.csv"]
