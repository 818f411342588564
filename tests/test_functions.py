"""Column expressions: golden ids, path rules, filename tokens, gate tokens."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from cairn.functions import filename, gates, ids, paths, text
from cairn.functions.registry import FeatureRegistry


def one(spark, expr, **values):
    df = spark.createDataFrame([tuple(values.values())], schema=", ".join(f"{k} string" for k in values))
    return df.select(expr.alias("x")).first()[0]


def test_device_and_file_ids_are_golden(spark):
    qc = one(spark, ids.device_id(F.col("a"), F.col("b")), a="QC", b="148")
    assert qc == "dev-89884074b3d573960d5de098f7894deefe3a0572c61d419dbbff014c9f036cc3"
    assert one(spark, ids.device_id(F.col("a"), F.col("b")), a="YZ", b="D71") == "D71"
    assert one(spark, ids.device_id(F.col("a"), F.col("b")), a="YZ", b="D71x").startswith("dev-")


def column(spark, expr, values):
    """Evaluate one expression over many strings in a single plan."""
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[1] for r in df.select("i", expr.alias("x")).orderBy("i").collect()]


def test_file_id_escapes_like_ascii_json(spark):
    names = ["plain/a.csv", "mesure à 5K/é.csv", "日本/測定.dat", "emoji 😀/a.csv", 'quote"d/x.csv', "tab\tx/\x7f.csv", "esc\x1b.csv"]
    expect = [
        "file-" + hashlib.sha256(json.dumps(["src", n], separators=(",", ":")).encode()).hexdigest() for n in names
    ]
    assert column(spark, ids.file_id(F.lit("src"), F.col("v")), names) == expect


def test_relationship_id_keeps_null(spark):
    parts = ["file", "a", "derived_from", "file", "b", None]
    expect = "rel-" + hashlib.sha256(json.dumps(parts, separators=(",", ":")).encode()).hexdigest()
    got = one(
        spark,
        ids.relationship_id(*[F.lit(p).cast("string") for p in parts]),
        a="x",
    )
    assert got == expect


def test_batch_and_preview_ids(spark):
    body = json.dumps(
        {"batch_number": 2, "batch_size": 2, "dataset_label": None, "proposals": ["ä", "b"]},
        ensure_ascii=False, separators=(",", ":"), sort_keys=True,
    )
    expect = "dataset-batch-002-" + hashlib.sha256(body.encode()).hexdigest()[:12]
    got = one(
        spark,
        ids.batch_id(F.lit(2), F.lit(2), F.lit(None), F.array(F.lit("ä"), F.lit("b"))),
        a="x",
    )
    assert got == expect
    payload = {
        "generator": "artifact-preview-1", "schema_version": 1, "policy_version": "bounded-1",
        "artifact_id": "art-1", "storage_source_id": None, "relative_path": None,
        "catalog_size_bytes": 5, "catalog_mtime_ns": None,
    }
    raw = json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False) + "\n"
    null = F.lit(None).cast("string")
    got = one(spark, ids.preview_id(F.col("a"), null, null, F.lit(5), F.lit(None)), a="art-1")
    assert got == hashlib.sha256(raw.encode()).hexdigest()


def test_derived_experiment_id_never_truncates(spark):
    got = [
        one(spark, ids.derived_experiment_id(F.col("a"), F.lit(None), F.lit(n)), a="D1")
        for n in (3, 123456)
    ]
    assert got == ["D1-0003", "D1-123456"]


def test_canonical_path(spark):
    cases = {
        "a/b.csv": "a/b.csv", "a\\b//./c.csv": "a/b/c.csv", "/a": None, "C:/a": None,
        "a/../b": None, "./.": None, "": None, "a/...": "a/...", "a/": "a",
    }
    assert column(spark, paths.canonical_path(F.col("v")), list(cases)) == list(cases.values())


def test_stem_and_suffix(spark):
    cases = {
        "d/x.CSV": ("x", ".csv"), "d/.keep": (".keep", ""), "d/x": ("x", ""), "d/x.": ("x.", ""),
        "a.b/x": ("x", ""), "d/x.tar.gz": ("x.tar", ".gz"), "D356_3.6K.csv": ("D356_3.6K", ".csv"),
    }
    assert column(spark, paths.stem(F.col("v")), list(cases)) == [c[0] for c in cases.values()]
    assert column(spark, paths.suffix(F.col("v")), list(cases)) == [c[1] for c in cases.values()]


def test_scan_role(spark):
    cases = {
        "D1/Initial Data/a.csv": "raw", "D1/initial_data/x/a.csv": "raw",
        "D1/Initial Data after process/a.csv": "intermediate",
        "D1/Initial-data AFTER processing/a.png": "intermediate",
        "D1/Processed Data/a.dat": "processed", "D1/Processed Data/a.PNG": "figure",
        "D1/Initial Data 2/a.csv": None, "a.csv": None, "Processed Data/Initial Data/a.png": "raw",
    }
    assert column(spark, paths.scan_role(F.col("v")), list(cases)) == list(cases.values())


def features(spark, stems):
    norm = filename.normalize_stem(F.col("v"))
    rows = column(spark, filename.metadata_struct(F.col("v"), norm), stems)
    return [{k: v for k, v in r.asDict().items() if v is not None} for r in rows]


def test_filename_features(spark):
    cases = {
        "D356_3.6K_9T_633nm_PL": dict(
            sample_id="D356", temperature_K=3.6, magnetic_field_T=9.0, excitation_wavelength_nm=633.0, measurement_type="photoluminescence"
        ),
        "YZ356_REF": dict(sample_id="D356", measurement_type="absorption"),
        "sample_run_2024": {},
        "YZ356_9Tp1n1_3.6KPL_633nm_700nmc_2sx1_FixTG=-0.2_Vb0to+20": dict(
            sample_id="D356", magnetic_field_T=9.0, temperature_K=3.6, measurement_type="photoluminescence", excitation_wavelength_nm=633.0,
            center_wavelength_nm=700.0, integration_time_s=2.0, averages=1, measurement_point_label="p1n1",
        ),
        "YZ356_p1_3.6KREF_720nmc_0p06sx10_TGonly": dict(
            sample_id="D356", temperature_K=3.6, measurement_type="absorption", center_wavelength_nm=720.0, integration_time_s=0.06,
            averages=10, measurement_point_label="p1",
        ),
        "YZ247_pc1_300g_3.6KPL_730nm0.03uW_940nmc_5sx1_Rot1195p8deg_Rot295deg_Stage50_TG+BG=0": dict(
            sample_id="YZ247", grating_grooves_per_mm=300, temperature_K=3.6, measurement_type="photoluminescence",
            excitation_wavelength_nm=730.0, excitation_power_uW=0.03, center_wavelength_nm=940.0, integration_time_s=5.0, averages=1,
            rotations_deg=[1195.8, 295.0], stage_position=50, measurement_point_label="pc1",
        ),
        "plot_phase_power_peak": {},
    }
    assert features(spark, list(cases)) == list(cases.values())


def test_each_pattern_of_a_stem_is_searched_for_once(spark):
    df = spark.createDataFrame([("a", "b")], "stem string, norm string")
    plan = df.select(filename.metadata_struct(F.col("stem"), F.col("norm")).alias("m"))._jdf.queryExecution().optimizedPlan().toString()
    once = ["SAMPLE", "TEMPERATURE", "FIELD", "EXCITATION", "LUMINESCENCE", "ABSORPTION", "CENTER", "POWER", "INTEGRATION", "GRATING", "ROTATION", "STAGE"]
    assert {name: plan.count(getattr(filename, name) + ",") + plan.count(getattr(filename, name) + ")") for name in once} == dict.fromkeys(once, 1)


def test_markers_spare_only_patterns_that_cannot_match(spark):
    pieces = ["4k", "kpl", "4kref", "٣k", "2tp3", "1p5t", "rot45deg", "stage3", "300g", "g", "dr_r", "drr", "absorb", "ref", "pl", "5p5sx1", "sx1", "3sx", "10uw", "633nm", "7.5nmc", "yz356", ""]
    stems = [f"{a}_{b}" for a in pieces for b in pieces] + [None]
    df = spark.createDataFrame([(s,) for s in stems], "norm string")

    def found(pattern, group=1):
        return F.nullif(F.regexp_extract("norm", pattern, group), F.lit(""))

    def number(pattern, group=1):
        return F.replace(found(pattern, group), F.lit("p"), F.lit(".")).try_cast("double")

    expect = {
        "temperature_K": number(filename.TEMPERATURE), "magnetic_field_T": number(filename.FIELD), "excitation_wavelength_nm": number(filename.EXCITATION),
        "measurement_type": F.when(F.col("norm").rlike(filename.LUMINESCENCE), "photoluminescence").when(F.col("norm").rlike(filename.ABSORPTION), "absorption"),
        "center_wavelength_nm": number(filename.CENTER), "integration_time_s": number(filename.INTEGRATION), "averages": found(filename.INTEGRATION, 2).try_cast("long"),
        "excitation_power_uW": number(filename.POWER), "grating_grooves_per_mm": found(filename.GRATING).try_cast("long"), "stage_position": found(filename.STAGE).try_cast("long"),
    }
    read = df.withColumn("m", filename.metadata_struct(F.col("norm"), F.col("norm")))
    for name, value in expect.items():
        assert read.where(~F.col(f"m.{name}").eqNullSafe(value)).count() == 0, name
        assert read.where(F.col(f"m.{name}").isNotNull()).count() > 0, name


def test_point_labels_keep_case(spark):
    labels = ["p1", "p1n1", "pa1", "pc1", "pX", "pX1", "PX1"]
    got = features(spark, [f"D1000x_{label}_x" for label in labels])
    assert [g["measurement_point_label"] for g in got] == labels


def electrical(spark, stems):
    rows = column(spark, gates.electrical_reading(F.col("v")), stems)
    return [None if r is None else r.asDict(recursive=True) for r in rows]


def test_gate_scalars(spark):
    cases = [
        ("FixTG4V", "fixed_top_gate_V", 4.0), ("FixTG4p5V", "fixed_top_gate_V", 4.5),
        ("FixTG=-0.2", "fixed_top_gate_V", -0.2), ("TGonly", "active_gate_configuration", "TG_only"),
        ("bg1only", "active_gate_configuration", "BG1_only"), ("Vb0to+20", "bias_stop_V", 20.0),
        ("TG=BG=0", "fixed_gates", ["BG", "TG"]), ("TG=BG=0", "back_gate_topology", "single"),
        ("TG+BG=0", "back_gate_topology", "single"), ("BG1+BG2=0", "back_gate_topology", "split"),
        ("BG2-CG", "back_gate_topology", "split"),
    ]
    got = electrical(spark, [f"D356_{c[0]}" for c in cases])
    assert [g[c[1]] for g, c in zip(got, cases, strict=True)] == [c[2] for c in cases]


def test_gate_constraints(spark):
    cases = {
        "TG+BG=0": ({"BG": 1.0, "TG": 1.0}, "constant_doping", None),
        "TG-BG=0": ({"BG": -1.0, "TG": 1.0}, "constant_displacement_field", None),
        "0.7TG+BG=0": ({"BG": 1.0, "TG": 0.7}, "constant_doping", None),
        "TG+1.8BG=0": ({"BG": 1.8, "TG": 1.0}, "constant_doping", None),
        "TG+TG+BG=0": ({"BG": 1.0, "TG": 2.0}, "constant_doping", None),
        "TG+BG=0Rev": ({"BG": 1.0, "TG": 1.0}, "constant_doping", "reverse"),
        "BG1+BG2=0": ({"BG1": 1.0, "BG2": 1.0}, None, None),
    }
    for token, row in zip(cases, electrical(spark, [f"D356_{t}" for t in cases]), strict=True):
        (c,) = row["gate_constraints"]
        spelled = {x["gate"]: x["value"] for x in c["coefficients"]}
        assert (c["raw_expression"], spelled, c["control_mode"], c["sweep_direction"]) == (token, *cases[token])


def test_gate_notes(spark):
    cases = {
        "D1_TG+BG=1": ["unsupported electrical expression: TG+BG=1"],
        "D1_TG*BG=0": ["unsupported electrical expression: TG*BG=0"],
        "D1_FixTG4V-SweepBG1=2": ["unsupported electrical expression: SweepBG1=2"],
        "D1_FixTG=4-x": ["unsupported electrical expression: x"],
        "D1_TG+BG=0_BG1only": [gates.TOPOLOGY_CONFLICT],
    }
    assert [e["notes"] for e in electrical(spark, list(cases))] == list(cases.values())


def test_unsupported_fix_without_unit_is_silent(spark):
    assert electrical(spark, ["D1_FixTG4"]) == [None]


def keys(spark, *stems):
    both = gates.electrical_and_key(F.col("v"), filename.normalize_stem(F.col("v")))
    return [r["group_key"] for r in column(spark, both, list(stems))]


def test_group_keys(spark):
    base, *same, mystery, words = keys(
        spark, "D356_3.6K_9T_633nm", "D356_3.6K_9T_633nm_PL", "D356_raw_3.6K_9T_633nm_PL_log",
        "d356_3.6K_data_9T_633nm_avg2_DR_R_Self", "D356_3.6K_9T_633nm_mystery", "raw_data",
    )
    assert set(same) == {base}
    assert mystery != base and words == "raw_data"


def test_group_keys_split_by_electrical_state(spark):
    plus, minus, one, reverse, swapped = keys(
        spark, "D1_BG1+BG2=0", "D1_BG1-BG2=0", "D1_TG+BG=0", "D1_TG+BG=0Rev", "D1_BG+TG=0"
    )
    assert plus != minus and one != reverse
    assert one == swapped.replace("bg_tg", "tg_bg")


def test_float_spelling(spark):
    values = (3.6, 633.0, 0.06, 1e-3, 2.5e-4, 1e-5, 1.5e-7, 12345678.5, 1e15, 1e16, 1e22, -0.0005)
    got = column(spark, text.float_text(F.col("v").cast("double")), [repr(v) for v in values])
    assert got == [repr(v) for v in values]


def test_feature_registry_adds_columns(spark):
    registry = FeatureRegistry()
    registry.register("cooldown", lambda s: F.regexp_extract(s, r"cd(\d+)", 1))
    with pytest.raises(ValueError):
        registry.register("cooldown", lambda s: s)
    df = registry.apply(spark.createDataFrame([("D1_cd7_x",)], "stem string"))
    assert df.first()["cooldown"] == "7"
