"""Operators against small hand-made cases and plain-Python brute force."""

import hashlib
import itertools
import random
import re
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from cairn import schemas
from cairn.operators import (
    batches, devices, documents, fingerprint, indexing, inventory, lineage, linkage, ordering, previews, proposals, quality, relocation, retrieval,
)
from cairn.plans import linkage_queries
from cairn.session import cut_lineage

LISTING = schemas.LISTING


def listing(spark, *names):
    return spark.createDataFrame([(n, i + 1, 10 * i) for i, n in enumerate(names)], LISTING)


def test_position_within_equals_brute_force_with_a_hot_key(spark, rows):
    rng = random.Random(7)
    data = [("hot" if rng.random() < 0.4 else f"k{rng.randrange(20)}", i) for i in rng.sample(range(5000), 1500)]
    df = spark.createDataFrame(data, "k string, v int").repartition(7)
    expect = {}
    for key, group in itertools.groupby(sorted(data), key=lambda r: r[0]):
        expect |= {r: n for n, r in enumerate(group)}
    got = {(r["k"], r["v"]): r["ordinal"] for r in ordering.position_within(df, ["k"], ["v"]).collect()}
    assert got == expect
    ranked = {(r["k"], r["v"]): r["ordinal"] for r in ordering.position_within(df, [], ["k", "v"]).collect()}
    assert ranked == {r: n for n, r in enumerate(sorted(data))}


@pytest.fixture(scope="module")
def scan(spark):
    return proposals.scan(
        listing(
            spark,
            "s/Initial Data/D356.csv", "s/Processed Data/D356_PL.dat", "s/Processed Data/D356_PL_linear.png",
            "s/Processed Data/D356_PL_log.png", "s/Processed Data/D357_4K.png", "s/Initial Data/D400_4K.csv", "s/Initial Data/d400_4k_raw.csv",
            "s/Initial Data/YZ9_5K_633nm.csv", "s/Processed Data/YZ9_5K_633nm_PL.dat", "s/Processed Data/b/YZ9_5K_633nm_PL.dat",
            "s/notes.txt", "s/other/D1.csv", "s/Initial Data/D8_TG+BG=1_p1.csv", "s/Initial Data/D8_TG+BG=1_P1.csv",
        )
    )


def test_scan_groups_and_warnings(scan):
    got = {r["group_key"]: r for r in scan.proposals.collect()}
    assert set(got) == {"d356", "d357_4k", "d400_4k", "yz9_5k_633nm", "d8_tg_bg_1_p1"}
    assert got["d357_4k"]["warnings"] == ["figures found without associated raw or processed data"]
    assert (got["d400_4k"]["n_raw"], got["d400_4k"]["temperature_K"]) == (2, 4.0)
    assert got["d8_tg_bg_1_p1"]["measurement_point_label"] is None
    assert got["d8_tg_bg_1_p1"]["warnings"] == [
        "conflicting measurement_point_label values: ['P1', 'p1']", "unsupported electrical expression: TG+BG=1",
    ]
    assert got["d356"]["confidence"] == 0.7


def test_unclassified_reasons(scan, rows):
    assert rows(scan.unclassified.select("relative_path", "reason"), "relative_path") == [
        ("s/notes.txt", "unsupported extension '.txt': s/notes.txt"),
        ("s/other/D1.csv", "outside recognised data directories: s/other/D1.csv"),
    ]


def test_lineage_edges_and_unresolved(scan, rows):
    edges, unresolved = proposals.lineage(scan.files)
    d = "s/Processed Data/D356_PL"
    assert set(rows(edges.select("source", "target", "relation"))) == {
        ("s/Initial Data/D356.csv", f"{d}.dat", "derived_from"),
        (f"{d}.dat", f"{d}_linear.png", "visualization_of"), (f"{d}.dat", f"{d}_log.png", "visualization_of"),
    }
    got = rows(unresolved.select("source", "reason", "n_candidates"), "source")
    assert got == [
        ("s/Initial Data/YZ9_5K_633nm.csv", "ambiguous processed stem", 2),
        ("s/Processed Data/YZ9_5K_633nm_PL.dat", "no figure file with a known derivation", None),
        ("s/Processed Data/b/YZ9_5K_633nm_PL.dat", "no figure file with a known derivation", None),
    ]


def test_import_proposals_provenance_and_documents(scan):
    edges, unresolved = proposals.lineage(scan.files)
    imported = proposals.import_proposals(scan, unresolved)
    flags = {r["group_key"]: r["needs_review"] for r in imported.select("group_key", "needs_review").collect()}
    assert flags == {"d356": False, "d357_4k": True, "d400_4k": False, "yz9_5k_633nm": True, "d8_tg_bg_1_p1": True}
    rows_ = proposals.provenance(imported, ["group_key"])
    d356 = [(r["field"], r["value_json"]) for r in rows_.where("group_key = 'd356'").orderBy("ordinal").collect()]
    assert d356 == [("sample_id", '"D356"'), ("measurement_type", '"photoluminescence"')]
    named = {"group_key": "proposal_id"}
    for limit, external in ((10, False), (2, True)):
        docs = documents.build_documents(
            imported.withColumnsRenamed(named), scan.files.withColumnsRenamed(named), edges.withColumnsRenamed(named),
            rows_.withColumnsRenamed(named), inline_limit=limit,
        )
        doc = docs.where("proposal_id = 'd356'").first()
        assert doc["external"] is external
        assert (doc["data"]["files"] is None) is external
        assert doc["data"]["raw_data_file"] == "s/Initial Data/D356.csv"


def test_scan_sample_is_set_only_when_unique(spark, scan):
    assert proposals.scan_sample(scan.proposals).first()["warning"] == proposals.MULTIPLE_SAMPLES
    one = scan.proposals.where("group_key = 'd356'")
    assert proposals.scan_sample(one).first()["sample_id"] == "D356"


def test_scan_is_the_same_on_any_partitioning(scan, spark):
    names = [r[0] for r in scan.files.select("relative_path").collect()]
    again = proposals.scan(listing(spark, *reversed(names)).repartition(5)).proposals
    columns = ["group_key", "n_raw", "sample_id", "warnings", "confidence"]
    assert sorted(again.select(columns).collect()) == sorted(scan.proposals.select(columns).collect())


@pytest.fixture(scope="module")
def device_scan(spark):
    return devices.scan_devices(
        listing(
            spark, "D345 a/Initial Data/D345_4K.csv", "D345 a/Processed Data/D345_4K_PL.dat", "D345 a/Processed Data/D345_4K_PL_log.png",
            "D345 a/Processed Data/D345_4.0K_PL.dat", "D345 a/Processed Data/D345_9T_633nm_PL.dat", "D345 a/Initial Data/D345_7T_633nm.csv",
            "D71/x.ppt", "D71abc/y.pdf", "D9abc_tok en/z.pdf", "YZ123_mystery/q.csv", "root.pdf",
        ),
        "src",
    )


def test_device_folders(device_scan, rows):
    assert rows(device_scan.devices.select("device_id", "aliases"), "device_id") == [("D345", ["D345 a"]), ("D9", ["D9abc_tok en"])]
    unresolved = rows(device_scan.unresolved.select("folder_name", "candidate_device_id"), "folder_name")
    assert unresolved == [("D71", "D71"), ("D71abc", "D71"), ("YZ123_mystery", None)]
    tokens = rows(device_scan.claims.where("subject_id = 'D9'").select("ordinal", "value_json"), "ordinal")
    assert tokens == [(0, '"abc"'), (1, '"tok"'), (2, '"en"')]
    warnings = {r[0] for r in device_scan.warnings.collect()}
    assert "legacy PPT extraction unsupported: D71/x.ppt" in warnings
    assert "ambiguous compact device candidate D9: D9abc_tok en" in warnings
    assert device_scan.artifacts.where("relative_path = 'root.pdf'").first()["device_id"] is None


def test_identity_decisions(spark, device_scan):
    decisions = spark.createDataFrame(
        [("D71", "QC", "148", "QC 148", "review.md", ["old"], []), ("YZ123_mystery", "YZ", "D345", "D345", "note", [], ["seen"])],
        "relative_folder string, maker_namespace string, local_device_id string, display_label string, provenance_source string, "
        "aliases array<string>, evidence array<string>",
    )
    assert devices.decision_problems(decisions, device_scan.unresolved, device_scan.devices).count() == 0
    result = devices.apply_decisions(device_scan, decisions)
    got = {r["device_id"]: r for r in result.devices.collect()}
    qc = "dev-89884074b3d573960d5de098f7894deefe3a0572c61d419dbbff014c9f036cc3"
    assert got[qc]["aliases"] == ["D71", "old"] and got[qc]["display_label"] == "QC 148"
    assert got["D345"]["aliases"] == ["D345 a", "YZ123_mystery"] and got["D345"]["maker_namespace"] == "YZ"
    owners = {r["relative_path"]: r["device_id"] for r in result.artifacts.collect()}
    assert owners["D71/x.ppt"] == qc and owners["YZ123_mystery/q.csv"] == "D345" and owners["D71abc/y.pdf"] is None
    accepted = result.relationships.where("review_state = 'accepted'").collect()
    assert {r["target_id"] for r in accepted} == {qc, "D345"} and len(accepted) == 2
    assert [r[0] for r in result.unresolved.select("folder_name").collect()] == ["D71abc"]
    bad = decisions.withColumn("relative_folder", F.lit("a/b"))
    problems = {r["problem"] for r in devices.decision_problems(bad, device_scan.unresolved, device_scan.devices).collect()}
    assert {"relative_folder must identify one canonical folder", "duplicate identity decisions are not allowed", "unknown unresolved folder"} <= problems


@pytest.fixture(scope="module")
def linked(device_scan):
    return linkage.derive_experiments(device_scan.devices, device_scan.artifacts)


def test_linkage_experiments_and_fallback(linked, rows):
    got = rows(linked.experiments.select("experiment_id", "canonical", "needs_review", "n_raw", "n_processed", "figure_log"), "experiment_id")
    log = "D345 a/Processed Data/D345_4K_PL_log.png"
    assert got == [
        ("D345-0000", "D345_4K", False, 1, 2, log), ("D345-0001", "D345_7T_633nm", False, 1, 0, None), ("D345-0002", "D345_9T_633nm_PL", True, 0, 1, None),
    ]
    warning = linked.experiments.where("needs_review").first()["warnings"]
    assert warning == ["processed files without a deterministically matching raw measurement: D345 a/Processed Data/D345_9T_633nm_PL.dat"]


def test_members_give_the_same_edges_for_named_files(linked):
    full = {(r["source_id"], r["target_id"]) for r in linkage.derived_from_edges(linked).collect()}
    assert len(full) == 3
    members = linkage.derivation_members(linked)
    for name in {r["file_id"] for r in members.collect()}:
        asked = members.where(F.col("file_id") == name).select("file_id")
        got = {(r["source_id"], r["target_id"]) for r in linkage.derived_from_edges(linked, asked).collect()}
        assert got == {pair for pair in full if name in pair}


def scanned(spark, names):
    listing = spark.createDataFrame([(n, 1, 1) for n in names], schemas.LISTING)
    return devices.scan_devices(listing, "src")


REVIEWED = "processed_stem string, raw_stem string, source_reference string, evidence array<string>"


def test_reviewed_matches_chain_and_roles_are_counted_again(spark, rows):
    names = [f"D9 x/Initial Data/D9_{k}K.csv" for k in (1, 2, 3)] + [f"D9 x/Processed Data/D9_{k}K_PL.dat" for k in (1, 2)]
    scan = scanned(spark, names)
    # The later link of the chain is decided first.
    reviewed = spark.createDataFrame([("D9_2K", "D9_3K", "n", []), ("D9_1K", "D9_2K", "n", [])], REVIEWED)
    result = linkage.derive_experiments(scan.devices, scan.artifacts, reviewed)
    got = rows(result.experiments.select("experiment_id", "n_raw", "n_processed", "review_state"), "experiment_id")
    assert got == [("D9-0000", 3, 1, "accepted")]
    assert rows(result.absorbed.select("absorbed_id", "experiment_id"), "absorbed_id") == [("D9-0001", "D9-0000"), ("D9-0002", "D9-0000")]


def test_reviewed_matches_in_a_ring_keep_the_smallest(spark, rows):
    steps = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "b"), ("y", "x"), ("p", "q")], "absorbed_id string, experiment_id string")
    got = rows(linkage.final_experiments(steps), "absorbed_id")
    assert got == [("b", "a"), ("c", "a"), ("p", "q"), ("x", "a"), ("y", "a")]


def test_rounds_follow_the_longest_chain(spark, rows, monkeypatch):
    stored = []
    monkeypatch.setattr(linkage, "cut_lineage", lambda df: stored.append(1) or cut_lineage(df))
    pairs = [(f"{k:03}-c", f"{k:03}-b") for k in range(100)] + [(f"{k:03}-b", f"{k:03}-a") for k in range(100)]
    steps = spark.createDataFrame(pairs, "absorbed_id string, experiment_id string")
    got = rows(linkage.final_experiments(steps), "absorbed_id")
    assert got == sorted((gone, f"{gone[:3]}-a") for gone, _ in pairs)
    assert len(stored) == 2


def test_rounds_do_not_multiply_the_estimated_size(spark, rows, capsys):
    chain = spark.createDataFrame([(f"{k + 1:03}", f"{k:03}") for k in range(200)], "absorbed_id string, experiment_id string")
    ends = linkage.final_experiments(chain)
    capsys.readouterr()
    ends.explain("cost")
    told = capsys.readouterr().out
    assert "sizeInBytes" in told and not re.search(r"sizeInBytes=\S*E\+", told)
    assert {r[1] for r in rows(ends)} == {"000"} and ends.count() == 200


def test_reviewed_merge_derives_the_files_once(spark, rows, monkeypatch):
    names = [f"D9 x/Initial Data/D9_{k}K.csv" for k in (1, 2, 3)] + [f"D9 x/Processed Data/D9_{k}K_PL.dat" for k in (1, 2)]
    scan, derived, data_files = scanned(spark, names), [], linkage.data_files
    monkeypatch.setattr(linkage, "data_files", lambda *tables: derived.append(1) or data_files(*tables))
    found = linkage_queries.reviewed_merge(SimpleNamespace(devices=scan.devices, artifacts=scan.artifacts))
    assert rows(found.select("experiment_id", "n_raw", "n_processed", "review_state")) == [("D9-0000", 3, 1, "accepted")]
    assert len(derived) == 1


def test_reviewed_match_absorbs_the_raw_experiment(spark, device_scan, rows):
    reviewed = spark.createDataFrame(
        [("D345_9T_633nm", "D345_7T_633nm", "packet.md", ["same gate"])], "processed_stem string, raw_stem string, source_reference string, evidence array<string>"
    )
    result = linkage.derive_experiments(device_scan.devices, device_scan.artifacts, reviewed)
    got = rows(result.experiments.select("experiment_id", "needs_review", "review_state"), "experiment_id")
    assert got == [("D345-0000", False, "unknown"), ("D345-0002", False, "accepted")]
    files = rows(result.files.where("experiment_id = 'D345-0002'").select("role", "stem"), "role")
    assert files == [("processed", "D345_9T_633nm_PL"), ("raw", "D345_7T_633nm")]
    (claim,) = linkage.reviewed_claims(result, reviewed).collect()
    assert claim["subject_id"] == "D345-0002" and claim["evidence"] == ["same gate"]


def test_edges_touching_counts_a_self_edge_once(spark):
    edges = spark.createDataFrame(
        [("file", "a", "p", "file", "a", "1"), ("file", "a", "p", "file", "b", "2"), ("file", "c", "p", "file", "a", "3"), ("x", "a", "p", "y", "b", "4")],
        "source_type string, source_id string, predicate string, target_type string, target_id string, relationship_id string",
    )
    wanted = spark.createDataFrame([("file", "a")], "entity_type string, entity_id string")
    assert sorted(r["relationship_id"] for r in lineage.edges_touching(edges, wanted).collect()) == ["1", "2", "3"]


def test_artifact_derivations_for_pages_and_tables_agree(spark, linked, device_scan):
    refs = lineage.file_references(linked.files, device_scan.artifacts)
    edges = linkage.derived_from_edges(linked)
    whole = sorted(tuple(r) for r in lineage.artifact_derivations(device_scan.artifacts, edges, refs).collect())
    page = sorted(tuple(r) for r in lineage.artifact_derivations(device_scan.artifacts, edges, refs, few=True).collect())
    assert whole == page and len(whole) == 6


def experiments(spark):
    df = spark.createDataFrame(
        [("E1", "D1", 4.0, ["sample_id", "temperature_K"]), ("E2", None, None, ["sample_id", "temperature_K"]), ("E3", None, None, ["sample_id"]), ("E4", "", 5.0, ["sample_id", "temperature_K"])],
        "experiment_id string, sample_id string, temperature_K double, metadata_keys array<string>",
    )
    constraint = F.array(
        F.struct(
            F.lit("TG+BG=0").alias("raw_expression"),
            F.array(F.struct(F.lit("BG").alias("gate"), F.lit(1.0).alias("value")), F.struct(F.lit("TG").alias("gate"), F.lit(1.0).alias("value"))).alias("coefficients"),
            F.lit("constant_doping").alias("control_mode"), F.lit(None).cast("string").alias("sweep_direction"),
        )
    )
    keyed = df.withColumn("metadata_keys", F.array_append("metadata_keys", F.lit("gate_constraints")))
    return keyed.withColumns(
        {"measurement_type": F.lit("absorption"), "gate_constraints": constraint, "confidence": F.lit(0.5), "needs_review": F.lit(True)}
    )


def test_experiment_filters(spark):
    df = experiments(spark)

    def hits(**filters):
        return sorted(r[0] for r in retrieval.filter_experiments(df, filters).select("experiment_id").collect())

    assert hits(temperature_K=None) == ["E2"]
    assert hits(temperature_K=4) == ["E1"]
    assert hits(needs_review=1, confidence=0.5) == ["E1", "E2", "E3", "E4"]
    assert hits(temperature_K=retrieval.NumericRange(4.0, 5.0, include_minimum=False)) == ["E4"]
    assert hits(sample_id=7) == []
    want = [{"raw_expression": "TG+BG=0", "coefficients": {"TG": 1, "BG": 1}, "control_mode": "constant_doping", "sweep_direction": None}]
    assert len(hits(gate_constraints=want)) == 4
    assert hits(gate_constraints=[{**want[0], "sweep_direction": "reverse"}]) == []
    with pytest.raises(ValueError):
        retrieval.filter_experiments(df, {"nope": 1})
    with pytest.raises(ValueError):
        retrieval.filter_experiments(df, {"sample_id": retrieval.NumericRange(1, 2)})
    with pytest.raises(ValueError):
        retrieval.NumericRange(2, 1)


def test_pages_are_disjoint_and_complete(spark):
    df = experiments(spark)
    pages = [retrieval.search_experiments(df, limit=2, offset=o) for o in (0, 2)]
    got = [[r["experiment_id"] for r in p.items.collect()] for p in pages]
    assert got == [["E2", "E3"], ["E4", "E1"]]
    assert pages[0].payload()["total_count"] == 4
    for bad in (0, 201, True):
        with pytest.raises(ValueError):
            retrieval.search_experiments(df, limit=bad)


def test_artifact_filters(spark):
    df = spark.createDataFrame(
        [("a1", ".PDF", "x", "D1", "Dir/100%_done.pdf", "UNKNOWN"), ("a2", "pptx", "x", "D1", "b.pptx", "Slide"), ("a3", "bin", "IMAGE/x", None, None, "UNKNOWN"), ("a4", "zip", "x", None, "back\\slash.zip", "UNKNOWN")],
        "artifact_id string, extension string, media_type string, device_id string, relative_path string, category string",
    )

    def hits(**kw):
        return sorted(r[0] for r in retrieval.filter_artifacts(df, **kw).select("artifact_id").collect())

    assert hits(kind="document") == ["a1", "a2"] and hits(kind="image") == ["a3"] and hits(kind="other") == ["a4"]
    assert hits(q="DIR/%done") == ["a1"] and hits(q="back\\slash") == ["a4"] and hits(q=" ") == ["a1", "a2", "a3", "a4"]
    assert hits(filters={"device_id": None}) == ["a3", "a4"]
    assert hits(extensions=("pdf", ".pptx"), exclude_slides=True) == ["a1"]
    with pytest.raises(ValueError):
        retrieval.filter_artifacts(df, kind="video")


def prior(spark):
    base = [("same", 1, 1, "present", "indexed"), ("grown", 1, 1, "present", "indexed"), ("back", 1, 1, "missing", "indexed"), ("gone", 1, 1, "present", "failed"), ("lost", 1, 1, "missing", "pending"), ("back2", 2, 1, "missing", "indexed")]
    rows = [(*r, None, "v1", None, None, "s1", 1, "t0", "t0") for r in base]
    return spark.createDataFrame(rows, schemas.INVENTORY)


def test_reconcile_outcomes(spark):
    now = spark.createDataFrame([("same", 1, 1), ("grown", 2, 1), ("back", 1, 1), ("back2", 3, 1), ("fresh", 5, 5)], LISTING)
    done = {r["relative_path"]: r for r in inventory.reconcile(prior(spark), now, "s2", 2, "t1").collect()}
    assert {k: (r["outcome"], r["inventory_status"], r["metadata_status"]) for k, r in done.items()} == {
        "same": ("unchanged", "present", "indexed"), "grown": ("changed", "present", "stale"), "back": ("restored", "present", "indexed"),
        "back2": ("restored", "present", "stale"), "gone": ("marked_missing", "missing", "failed"), "lost": ("still_absent", "missing", "pending"),
        "fresh": ("new", "present", "pending"),
    }
    assert (done["same"]["created_utc"], done["same"]["updated_utc"], done["lost"]["updated_utc"]) == ("t0", "t1", "t0")
    assert done["grown"]["parser_version"] == "v1" and done["gone"]["last_seen_generation"] == 1
    partial = {r["relative_path"]: r["inventory_status"] for r in inventory.reconcile(prior(spark), now, "s2", 2, "t1", complete=False).collect()}
    assert partial["gone"] == "present"


def test_sessions_accumulate(spark):
    session = spark.createDataFrame(
        [("s2", 2, "active", None, 3, 1, 1, 1, 0, 0, 0, [], "t0", "t0")],
        "session_id string, generation long, status string, checkpoint_path string, files_seen long, files_new long, files_unchanged long, files_changed long, "
        "files_restored long, files_marked_missing long, errors_count long, errors array<string>, created_utc string, updated_utc string",
    )
    counters = inventory.scan_counters(inventory.reconcile(prior(spark), listing(spark, "same", "new"), "s2", 2, "t1"))
    row = inventory.close_session(session, counters, "completed", "t1").first()
    assert (row["files_seen"], row["files_new"], row["files_marked_missing"], row["status"]) == (5, 2, 2, "completed")
    assert inventory.next_generation(session).first()[0] == 3
    assert inventory.active_session(session).count() == 1


def test_relocation(spark):
    records = prior(spark).unionByName(prior(spark).where("relative_path = 'same'").withColumn("relative_path", F.lit("../x"))).unionByName(
        prior(spark).where("relative_path = 'same'").withColumn("relative_path", F.lit("odd")).withColumn("inventory_status", F.lit("weird"))
    )
    checked = relocation.outcomes(records, spark.createDataFrame([("same", 1, 9), ("grown", 3, 1)], LISTING), compare_mtime=True)
    assert {r["relative_path"]: r["outcome"] for r in checked.collect()} == {
        "same": "mtime_mismatch", "grown": "size_mismatch", "gone": "missing", "../x": "unsafe_path",
    }
    row = relocation.summary(records, checked).first()
    assert (row["total_records"], row["present_records"], row["missing_records"], row["problems"], row["complete"]) == (8, 4, 3, 4, True)
    lines = {r[0] for r in relocation.blockers(records, checked, limit=2).collect()}
    assert "2 additional relocation problems omitted from details" in lines and "inventory record has unknown status: weird" in lines
    assert "gone: candidate is missing" in lines and len(lines) == 4


def test_index_plan_and_outcome(spark, scan):
    planned = indexing.plan(prior(spark), include_failed=True, parser_version="v2")
    assert {r["relative_path"]: r["choice"] for r in planned.collect()} == {
        "same": "parser_stale", "grown": "parser_stale", "back": "skipped_missing", "gone": "selected", "lost": "skipped_missing", "back2": "skipped_missing",
    }
    with pytest.raises(ValueError):
        indexing.check_parser_version("a\x01")
    _, unresolved = proposals.lineage(scan.files)
    imported = proposals.import_proposals(scan, unresolved).withColumn("scanner_unit", F.lit("s"))
    files = scan.files.withColumn("scanner_unit", F.lit("s"))
    chosen = files.select("scanner_unit", "relative_path").unionByName(scan.unclassified.select(F.lit("s").alias("scanner_unit"), "relative_path"))
    got = {r["relative_path"]: r["result"] for r in indexing.outcome(chosen, files, imported, scan.unclassified).collect()}
    assert got["s/Initial Data/D356.csv"] == "indexed" and got["s/notes.txt"] == "failed" and got["s/Initial Data/YZ9_5K_633nm.csv"] == "unchanged"


def manifest(spark, number, stage, **kw):
    row = dict(
        batch_number=number, stage=stage, batch_id=f"B{number}", status="planned", upload_id=None, publish=False, verification_status=None,
        proposal_ids=[f"p{number}"], expected_entry_count=1, entry_ids=[],
    ) | kw
    return tuple(row.values())


MANIFESTS = (
    "batch_number long, stage string, batch_id string, status string, upload_id string, publish boolean, verification_status string, "
    "proposal_ids array<string>, expected_entry_count long, entry_ids array<struct<proposal_id:string,entry_id:string>>"
)
DONE = dict(status="success", upload_id="u1", verification_status="verified", entry_ids=[("p1", "e1")])


@pytest.mark.parametrize(
    "rows_,expect",
    [
        ([], (None, "no prepared batches")),
        ([(1, "base", {}), (1, "final", DONE)], (None, "no eligible batches")),
        ([(1, "base", {})], (1, "preflight manifest missing")),
        ([(1, "base", {}), (1, "preflight_passed", {}), (1, "upload_created", dict(upload_id="u"))], (1, "known upload requires reconciliation")),
        ([(1, "base", {}), (1, "preflight_passed", dict(publish=True))], (1, "batch publish is True")),
        ([(1, "final", DONE), (1, "base", {}), (3, "base", {}), (3, "preflight_passed", {})], (3, "predecessor batch is not final and verified")),
        ([(1, "final", DONE), (1, "base", {}), (2, "base", {}), (2, "preflight_passed", {})], (2, "eligible")),
    ],
)
def test_next_eligible_batch(spark, rows_, expect):
    df = spark.createDataFrame([manifest(spark, n, s, **kw) for n, s, kw in rows_], MANIFESTS)
    row = batches.eligibility(batches.batch_states(df)).first()
    assert (row["batch_number"], row["reason"]) == expect


def test_reconcile_batches(spark):
    m = spark.createDataFrame(
        [(i, f"b{i}", u, "upload_created", False, 1) for i, u in enumerate([None, "u", "u", "u", "u", "u", "u", "u"])],
        "batch_number long, batch_id string, upload_id string, status string, publish boolean, expected_entry_count long",
    )
    cases = [
        ("u", "SUCCESS", False, False, 1, False), ("u", None, False, False, 0, True), ("x", "SUCCESS", False, False, 1, False), ("u", "Running", False, True, 1, False),
        ("u", "FAILED", False, False, 0, False), ("u", "Completed", False, False, 1, False), ("u", "success", False, False, 3, False), ("u", None, False, False, 1, False),
    ]
    o = spark.createDataFrame(
        [(f"b{i}", u, s, run, pub, n, nf, [], []) for i, (u, s, run, pub, n, nf) in enumerate(cases)],
        "batch_id string, observed_upload_id string, process_status string, process_running boolean, published boolean, entry_count int, not_found boolean, errors array<string>, warnings array<string>",
    )
    got = [(r["state"], r["reconciled"], r["errors"]) for r in batches.reconcile(m, o).orderBy("batch_number").collect()]
    assert [g[0] for g in got] == [
        "not_created", "not_found", "id_mismatch", "processing", "processing_failed", "success", "reconciliation_error", "reconciliation_error",
    ]
    assert [g[1] for g in got] == [False, False, False, False, True, True, False, False]
    assert got[3][2] == [batches.PUBLISHED] and got[7][2] == ["unsupported or missing process status: None"]
    assert got[6][2] == ["entry count mismatch: expected 1, observed 3"]


def test_batch_plan_splits_in_order(spark):
    df = spark.createDataFrame([(f"p{i:04d}", i) for i in range(1505)], "proposal_id string, position int").repartition(6)
    planned = batches.plan_batches(batches.plan_members(df, 50), 50, "main").orderBy("batch_number").collect()
    assert len(planned) == 31 and planned[-1]["item_count"] == 5
    assert [p for b in planned for p in b["proposal_ids"]] == [f"p{i:04d}" for i in range(1505)]
    with pytest.raises(ValueError):
        batches.plan_members(df, 0)


def test_quality_rules(spark):
    claims = spark.createDataFrame(
        [("device", "d", 0, "f", "x", "m", None, None, float("nan"), "corrected", None), ("device", "d", 1, "f", "x", "m", "", None, 0.5, "unknown", "1")],
        "subject_type string, subject_id string, ordinal long, field string, source_type string, extraction_method string, source_reference string, category string, "
        "confidence double, review_status string, reviewed_value_json string",
    )
    assert sorted((r["entity_id"], r["rule"]) for r in quality.claim_violations(claims).collect()) == [
        ("device/d/0", "confidence is not finite"), ("device/d/0", "corrected without reviewed value"),
        ("device/d/1", "reviewed value without correction"), ("device/d/1", "source_reference is empty"),
    ]
    vectors = spark.createDataFrame([(1, [1.0]), (2, []), (3, None), (4, [float("inf")]), (5, [None])], "vec_id int, embedding array<double>")
    assert sorted(r["entity_id"] for r in quality.embedding_violations(vectors).collect()) == ["2", "3", "4", "5"]
    results = spark.createDataFrame(
        [("r1", "p", None, ["s"], False, False), ("r2", "p", None, [], True, False), ("r3", "p", "", ["s"], True, True)],
        "result_id string, provider_id string, model_id string, suggestions array<string>, abstained boolean, requires_review boolean",
    )
    assert sorted(r["entity_id"] for r in quality.suggestion_violations(results).collect()) == ["r1", "r3", "r3"]


def test_fingerprint_is_order_free_and_sees_changes(spark):
    df = spark.createDataFrame([(i, str(i)) for i in range(50)], "a int, b string")
    same = df.orderBy(F.desc("a")).repartition(3)
    changed = df.withColumn("b", F.when(F.col("a") == 7, "x").otherwise(F.col("b")))
    assert fingerprint.parity({"t": df}, {"t": same}).count() == 0
    assert fingerprint.parity({"t": df}, {"t": changed}).first()["problem"] == "content differs"
    assert fingerprint.parity({"t": df}, {"t": df.limit(3)}).first()["problem"] == "row count differs"


def test_preview_points_and_status(spark):
    cells = [("t", 0, 0, "time"), ("t", 0, 1, "value"), ("t", 1, 0, "1"), ("t", 1, 1, "2"), ("t", 2, 0, "2"), ("t", 2, 1, "5"), ("w", 0, 0, "h"), ("w", 1, 0, "3"), ("w", 2, 0, "x"), ("n", 0, 0, "h"), ("n", 1, 0, "a")]
    df = spark.createDataFrame(cells, "relative_path string, row int, col int, cell string")
    points = previews.plot_points(previews.table_points(df, "relative_path"), "relative_path").orderBy("relative_path", "row")
    assert [(r["relative_path"], r["x"], r["y"], r["plot_x"], r["plot_y"]) for r in points.collect()] == [
        ("t", 1.0, 2.0, 40.0, 320.0), ("t", 2.0, 5.0, 600.0, 40.0), ("w", 1.0, 3.0, 40.0, 320.0),
    ]
    marks = spark.createDataFrame([("a,b;c;d",), ("a\tb,c",), ("a b",)], "s string")
    assert [r[0] for r in marks.select(previews.delimiter(F.col("s"))).collect()] == [";", ",", None]
    arts = spark.createDataFrame(
        [("a", "csv", 5, 1), ("b", "csv", 5, 1), ("c", "csv", 5, 1), ("d", "zip", 5, 1), ("e", "png", 70_000_000, 1), ("f", "pptx", 5, 1)],
        "artifact_id string, extension string, size_bytes long, mtime_ns long",
    ).withColumns({"storage_source_id": F.lit("s"), "relative_path": F.col("artifact_id")})
    now = spark.createDataFrame([("s", "a", 5, 1), ("s", "b", 6, 1), ("s", "d", 5, 1), ("s", "e", 70_000_000, 1), ("s", "f", 5, 1)], "storage_source_id string, relative_path string, size_bytes long, mtime_ns long")
    finding = spark.createDataFrame([("f", "malformed")], "artifact_id string, finding string")
    got = {r["artifact_id"]: (r["status"], r["kind"], r["fresh"]) for r in previews.preview_status(arts, now, finding).collect()}
    assert got == {
        "a": ("ready", "table", True), "b": ("stale_catalog", "placeholder", False), "c": ("unavailable", "placeholder", False),
        "d": ("unsupported", "placeholder", True), "e": ("too_large", "placeholder", True), "f": ("malformed", "placeholder", True),
    }


def test_preview_assets_are_stored_once_and_checked(spark):
    states = spark.createDataFrame([("p1", "ready"), ("p2", "ready"), ("p3", "malformed"), ("p4", "ready"), ("p5", "unavailable"), ("p6", "ready")], "preview_id string, status string")
    texts = spark.createDataFrame([("p1", "same"), ("p2", "same"), ("p3", "lost"), ("p4", ""), ("p6", "replaced")], "preview_id string, search_text string")
    parts = spark.createDataFrame(
        [("p2", "table.json", "table", "application/json", b"{}"), ("p3", "table.json", "table", "application/json", b"[]"), ("p6", "search_text.txt", "search", "text/plain", "\u00e9".encode())],
        "preview_id string, name string, kind string, media_type string, content binary",
    )
    built = previews.preview_assets(states, texts, parts)
    got = {(r["preview_id"], r["name"]): (r["size_bytes"], r["sha256"]) for r in built.assets.collect()}
    of = lambda b: (len(b), hashlib.sha256(b).hexdigest())
    empty = of(previews.PLACEHOLDER.encode())
    assert got == {
        ("p1", "search_text.txt"): of(b"same"), ("p2", "search_text.txt"): of(b"same"), ("p2", "table.json"): of(b"{}"), ("p3", "placeholder.svg"): empty,
        ("p4", "placeholder.svg"): empty, ("p5", "placeholder.svg"): empty, ("p6", "search_text.txt"): of("\u00e9".encode()),
    }
    held = built.contents.collect()
    assert len(held) == 4 and all(hashlib.sha256(bytes(r["content"])).hexdigest() == r["sha256"] for r in held)
    assert not previews.asset_problems(built.assets, built.contents).count()
    broken = spark.createDataFrame([(r["sha256"], b"other" if bytes(r["content"]) == b"{}" else bytes(r["content"])) for r in held if bytes(r["content"]) != b"same"], "sha256 string, content binary")
    assert {tuple(r) for r in previews.asset_problems(built.assets, broken).collect()} == {
        ("p1", "search_text.txt", "content is missing"), ("p2", "search_text.txt", "content is missing"), ("p2", "table.json", "content differs from its digest"),
    }
    assert previews.preview_assets(states.limit(0), texts, parts).assets.count() == 0


def test_entry_pairs_are_not_broadcast(spark):
    listed = spark.range(40).groupBy((F.col("id") % 4).alias("batch_number")).agg(F.array_sort(F.collect_list("id")).alias("p"))
    members = listed.select("batch_number", F.posexplode("p").alias("item", "proposal_id"))
    entries = listed.select("batch_number", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("item")).withColumn("entry_id", F.concat_ws("-", "batch_number", "item"))
    pairs = batches.entry_pairs(members, entries)
    plan = pairs._jdf.queryExecution()
    assert plan.toRdd().count() == 40
    assert "BroadcastHashJoin [batch_number" in plan.executedPlan().toString()
    assert not [line for line in plan.executedPlan().toString().splitlines() if "BroadcastHashJoin" in line and "item#" in line]
