"""Projections of the given tables into catalog, inventory and batch shapes.

Each projection exists twice, as a DataFrame method and as a SQL text, and every
one covers all rows of the tables it reads.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import ids, paths
from cairn.functions.binding import computed
from cairn.operators import proposals
from cairn.operators.lineage import with_file_id, with_relationship_id

SQL: dict[str, str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}


def view(name: str, sql: str, *needs: str) -> None:
    SQL[name] = sql.strip()
    NEEDS[name] = needs


def with_views(body: str, views: Iterable[str]) -> str:
    """Prefix a SQL body with the projections it needs, each once, dependencies first."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for need in NEEDS[name]:
            visit(need)
        if name not in ordered:
            ordered.append(name)

    for name in views:
        visit(name)
    if not ordered:
        return body.strip()
    parts = ",\n".join(f"{n} AS (\n{SQL[n]}\n)" for n in ordered)
    return f"WITH {parts}\n{body.strip()}"


view(
    "fx_lines",
    """
SELECT 'D' || CAST(100 + l_partkey % 9000 AS VARCHAR) AS device_id,
       'D' || CAST(100 + l_partkey % 9000 AS VARCHAR) || '_' || CAST(2 + l_suppkey % 3 AS VARCHAR) || '.5K_'
         || CAST(1 + l_linenumber % 2 AS VARCHAR) || 'T_' || CAST(600 + 50 * (l_partkey % 3) AS VARCHAR) || 'nm' AS base,
       l_partkey % 2 AS parity, l_orderkey, l_linenumber, l_quantity, l_returnflag, l_linestatus,
       CASE l_suppkey % 4 WHEN 0 THEN 'txt' WHEN 1 THEN 'pdf' WHEN 2 THEN 'pptx' ELSE 'PPT' END AS doc_ext
FROM lineitem""",
)
view(
    "fx_paths",
    """
SELECT device_id, base, parity, l_orderkey, device_id || ' chip/' || CASE
         WHEN l_quantity = 1 THEN 'notes/' || base || '.' || doc_ext
         WHEN l_returnflag = 'R' THEN 'Initial Data/' || base || '.csv'
         WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'Processed Data/' || base || '_PL.dat'
         WHEN l_returnflag = 'A' AND l_linenumber % 2 = 0 THEN 'Processed Data/' || base || '_PL_linear.png'
         WHEN l_returnflag = 'A' THEN 'Processed Data/' || base || '_PL_log.png'
         ELSE 'Initial data after processing/' || base || '.csv' END AS relative_path
FROM fx_lines""",
    "fx_lines",
)
view(
    "fx_artifacts",
    """
SELECT 'art-' || sha256(relative_path) AS artifact_id, device_id, base, relative_path,
       lower(regexp_extract(relative_path, '\\.([^./]+)$', 1)) AS extension,
       CASE WHEN relative_path LIKE '%.png' THEN 'image/png' WHEN relative_path LIKE '%.pdf' THEN 'application/pdf'
            ELSE 'UNKNOWN' END AS media_type,
       CASE WHEN relative_path LIKE '%.pptx' AND min(parity) = 0 THEN 'slide' ELSE 'UNKNOWN' END AS category,
       CAST(min(l_orderkey) AS BIGINT) AS size_bytes, CAST(1000 * max(l_orderkey) AS BIGINT) AS mtime_ns
FROM fx_paths GROUP BY device_id, base, relative_path""",
    "fx_paths",
)
view(
    "fx_files",
    """
SELECT base AS experiment_id, CASE WHEN relative_path LIKE '% chip/Initial Data/%' THEN 'raw'
         WHEN relative_path LIKE '% chip/Initial data after processing/%' THEN 'intermediate'
         WHEN relative_path LIKE '%.png' THEN 'figure' ELSE 'processed' END AS role,
       'src' AS storage_source_id, relative_path,
       'file-' || sha256(to_json(['src', relative_path])) AS file_id
FROM fx_artifacts WHERE relative_path NOT LIKE '% chip/notes/%'""",
    "fx_artifacts",
)
view(
    "fx_devices",
    """
SELECT 'D' || CAST(100 + p_partkey AS VARCHAR) AS device_id, p_type AS device_type, p_name AS display_label, p_name AS alias,
       'D' || CAST(100 + p_partkey AS VARCHAR) || ' chip' AS folder_alias,
       CASE WHEN p_size % 4 <> 0 THEN p_brand END AS maker_namespace,
       CASE WHEN p_size % 4 <> 0 THEN 'D' || CAST(100 + p_partkey AS VARCHAR) END AS local_device_id
FROM part""",
)
view(
    "fx_folders",
    """
SELECT DISTINCT split_part(relative_path, '/', 1) AS folder_name FROM fx_artifacts
UNION SELECT device_id || '_2' FROM fx_artifacts WHERE CAST(substr(device_id, 2) AS BIGINT) % 10 = 0
UNION SELECT 'X' || substr(device_id, 2) || '_mystery' FROM fx_artifacts WHERE CAST(substr(device_id, 2) AS BIGINT) % 17 = 0""",
    "fx_artifacts",
)
view(
    "fx_experiments",
    """
SELECT 'EXP-' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS experiment_id,
       CASE WHEN o_orderkey % 9 <> 0 THEN 'D' || CAST(o_custkey AS VARCHAR) END AS sample_id,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'photoluminescence' WHEN '2' THEN 'absorption' END AS measurement_type,
       CASE WHEN o_orderkey % 4 <> 0 THEN (o_orderkey % 40) / 4.0 END AS temperature_K,
       o_orderkey % 7 <> 0 AS has_temperature,
       o_orderstatus = 'P' AS needs_review, (o_orderkey % 21 * 5) / 100.0 AS confidence, o_orderkey
FROM orders""",
)
view(
    "fx_edges",
    """
SELECT 'experiment' AS source_type, 'EXP-' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS source_id, 'measured_on' AS predicate,
       'device' AS target_type, 'D' || CAST(100 + l_partkey % 9000 AS VARCHAR) AS target_id,
       'line ' || CAST(l_suppkey AS VARCHAR) AS provenance_source
FROM lineitem WHERE l_linenumber = 1
UNION
SELECT 'file', a.file_id, 'derived_from', 'file', b.file_id, NULL
FROM fx_files a JOIN fx_files b ON a.experiment_id = b.experiment_id
WHERE (a.role = 'raw' AND b.role = 'processed') OR (a.role = 'processed' AND b.role = 'figure')""",
    "fx_files",
)
view(
    "fx_relationships",
    """
SELECT *, 'rel-' || sha256(to_json([source_type, source_id, predicate, target_type, target_id, provenance_source])) AS relationship_id
FROM fx_edges""",
    "fx_edges",
)
view(
    "fx_claims",
    """
SELECT 'experiment' AS subject_type, 'EXP-' || lpad(CAST(event_id // 2 AS VARCHAR), 10, '0') AS subject_id, event_id AS ordinal,
       CASE event_type WHEN 'click' THEN 'measured_on_device' WHEN 'view' THEN 'measured_on_raw_match' ELSE event_type END AS field,
       props AS value_json, CASE WHEN event_id % 31 = 0 THEN '' ELSE 'scan' END AS source_type,
       'note ' || CAST(user_id AS VARCHAR) AS source_reference, 'rule' AS extraction_method,
       CASE event_id % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'rejected' WHEN 3 THEN 'unknown' ELSE 'maybe' END
         AS review_status,
       event_id % 3 <> 0 AS has_evidence,
       CASE WHEN event_id % 5 = 1 AND event_id % 2 = 0 THEN props WHEN event_id % 50 = 3 THEN props END AS reviewed_value_json
FROM events""",
)
view(
    "fx_prior",
    """
SELECT 'U' || CAST(o_custkey % 20 AS VARCHAR) || '/f' || CAST(o_orderkey AS VARCHAR) || '.csv' AS relative_path,
       o_orderkey % 1000 AS size_bytes, o_orderkey * 1000 AS mtime_ns,
       CASE WHEN o_orderkey % 11 = 0 THEN 'missing' ELSE 'present' END AS inventory_status,
       CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'pending' WHEN '2' THEN 'stale' WHEN '3' THEN 'failed' ELSE 'indexed' END
         AS metadata_status,
       CASE o_orderkey % 3 WHEN 1 THEN 'v0' WHEN 2 THEN 'v1' END AS parser_version,
       CASE o_orderkey % 4 WHEN 1 THEN 'table' WHEN 2 THEN '' END AS file_kind
FROM orders""",
)
view(
    "fx_listing",
    """
SELECT 'U' || CAST(o_custkey % 20 AS VARCHAR) || '/f' || CAST(o_orderkey AS VARCHAR) || '.csv' AS relative_path,
       o_orderkey % 1000 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS size_bytes, o_orderkey * 1000 AS mtime_ns
FROM orders WHERE o_orderkey % 7 <> 0
UNION ALL
SELECT 'N' || CAST(c_nationkey AS VARCHAR) || '/c' || CAST(c_custkey AS VARCHAR) || '.csv', c_custkey, c_custkey * 10 FROM customer""",
)
view(
    "fx_gates",
    """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN 'TG+BG=0' WHEN 1 THEN 'TG-BG=0' WHEN 2 THEN '0.7TG+BG=0'
         WHEN 3 THEN 'TG+BG=0Rev' WHEN 4 THEN 'BG1+BG2=0' WHEN 5 THEN 'TG=BG=0' WHEN 6 THEN 'TG+BG=1' ELSE 'FixTG4p5V' END AS token
FROM lineitem""",
)
view(
    "fx_members",
    """
SELECT CAST(o_orderkey // 150 AS BIGINT) + 1 AS batch_number, 'P-' || CAST(o_orderkey AS VARCHAR) AS proposal_id FROM orders
UNION ALL
SELECT CAST(o_orderkey // 150 AS BIGINT) + 2, 'P-' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 1000 = 0""",
)
view(
    "fx_stages",
    """
SELECT s_suppkey + 1 AS batch_number, s.stage, s.rank,
       CASE WHEN s.stage = 'final' AND s_nationkey % 2 = 0 THEN 'success' WHEN s.stage = 'final' THEN 'processing_failed'
            WHEN s.stage = 'upload_created' AND s_nationkey % 3 = 0 THEN 'verification_failed'
            WHEN s.stage = 'upload_created' THEN 'processing'
            WHEN s.stage = 'preflight_passed' THEN 'preflight_passed' ELSE 'planned' END AS status,
       CASE WHEN s.rank <= 4 THEN 'U-' || CAST(s_suppkey % 50 AS VARCHAR) END AS upload_id,
       s.stage = 'upload_created' AND s_nationkey % 7 = 0 AS publish,
       CASE WHEN s.stage = 'final' AND s_nationkey % 2 = 0 THEN 'verified' END AS verification_status
FROM supplier JOIN (VALUES ('final', 1), ('upload_created', 4), ('preflight_passed', 5), ('base', 9)) s(stage, rank)
  ON s.rank = 9 OR (s.rank = 5 AND s_suppkey % 4 >= 1) OR (s.rank = 4 AND s_suppkey % 4 >= 2) OR (s.rank = 1 AND s_suppkey % 4 = 3)""",
)
view(
    "fx_states",
    """
SELECT f.batch_number, 'B-' || CAST(f.batch_number AS VARCHAR) AS batch_id, f.has_preflight, f.has_final, f.is_verified,
       f.beyond_preflight, s.stage, s.status, s.upload_id, s.publish AS published
FROM (SELECT batch_number, bool_or(stage = 'preflight_passed') AS has_preflight, bool_or(stage = 'final') AS has_final,
             bool_or(stage IN ('final', 'upload_created')) AS beyond_preflight, min(rank) AS rank,
             bool_or(coalesce(stage = 'final' AND status = 'success' AND verification_status = 'verified', FALSE)) AS is_verified
      FROM fx_stages GROUP BY batch_number) f
JOIN fx_stages s ON s.batch_number = f.batch_number AND s.rank = f.rank""",
    "fx_stages",
)
view(
    "fx_uploads",
    """
SELECT 'upload-' || CAST(1 + c_custkey // 15 AS VARCHAR) AS upload_name, c_custkey, 1 + c_custkey // 15 AS batch_number,
       CASE WHEN (c_custkey % 15 = 0 AND (c_custkey // 15) % 3 >= 1) OR (c_custkey % 15 = 1 AND (c_custkey // 15) % 3 = 2)
            THEN 'R-' || CAST(c_custkey AS VARCHAR) END AS upload_id,
       CASE c_nationkey % 5 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'Processing' WHEN 2 THEN 'FAILED' WHEN 3 THEN 'odd' END AS process_status,
       c_nationkey % 6 = 0 AS process_running, c_nationkey % 4 = 0 AS published, c_nationkey % 9 = 0 AS not_found, c_nationkey
FROM customer""",
)
view(
    "fx_evaluations",
    """
SELECT 'case-' || CAST(doc_id AS VARCHAR) AS case_id, CASE WHEN doc_id % 17 = 0 THEN '' ELSE 'provider' END AS provider_id,
       (doc_id % 13) / 10.0 AS recall, CAST(doc_id - 5 AS DOUBLE) AS latency_ms FROM labels""",
)
view("fx_vectors", "SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN [CAST('nan' AS FLOAT)] ELSE embedding END AS embedding FROM embeddings")
view("fx_points", "SELECT user_id AS artifact, event_id AS row, CAST(event_id AS DOUBLE) AS x, value AS y FROM events")
view(
    "fx_page_refs",
    """
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS storage_source_id,
       regexp_extract(url, '^https?://[^/?#]+/([^?#]*)', 1) AS relative_path FROM pages""",
)


def _text(column: Column) -> Column:
    return column.cast("string")


def experiment_key(column: Column) -> Column:
    return F.concat(F.lit("EXP-"), F.lpad(_text(column), 10, "0"))


class Views:
    """DataFrame side of the projections over one table folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.sf_dir = sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def lines(self) -> DataFrame:
        li = self.table("lineitem")
        device = F.concat(F.lit("D"), _text(F.lit(100) + F.col("l_partkey") % 9000))
        doc = F.element_at(F.array(*[F.lit(x) for x in ("txt", "pdf", "pptx", "PPT")]), (F.col("l_suppkey") % 4 + 1).cast("int"))
        base = F.concat(
            device, F.lit("_"), _text(F.lit(2) + F.col("l_suppkey") % 3), F.lit(".5K_"), _text(F.lit(1) + F.col("l_linenumber") % 2),
            F.lit("T_"), _text(F.lit(600) + F.lit(50) * (F.col("l_partkey") % 3)), F.lit("nm"),
        )
        kind = F.col("l_returnflag")
        place = (
            F.when(F.col("l_quantity") == 1, F.concat(F.lit("notes/"), base, F.lit("."), doc))
            .when(kind == "R", F.concat(F.lit("Initial Data/"), base, F.lit(".csv")))
            .when((kind == "A") & (F.col("l_linestatus") == "O"), F.concat(F.lit("Processed Data/"), base, F.lit("_PL.dat")))
            .when((kind == "A") & (F.col("l_linenumber") % 2 == 0), F.concat(F.lit("Processed Data/"), base, F.lit("_PL_linear.png")))
            .when(kind == "A", F.concat(F.lit("Processed Data/"), base, F.lit("_PL_log.png")))
            .otherwise(F.concat(F.lit("Initial data after processing/"), base, F.lit(".csv")))
        )
        # A stored listing has its path as a column; here it is spelled once per row
        # behind a barrier, so filters on it are not pushed into the spelling.
        spelled = F.struct(
            device.alias("device_id"), base.alias("base"), F.concat(device, F.lit(" chip/"), place).alias("relative_path")
        )
        used = li.select("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus", "l_orderkey")
        return computed(used, spelled).select("device_id", "base", (F.col("l_partkey") % 2).alias("parity"), "l_orderkey", "relative_path")

    @cached_property
    def stored_paths(self) -> DataFrame:
        """Distinct paths of the order lines with size, time and parity."""
        return self.lines.groupBy("device_id", "base", "relative_path").agg(
            F.min("parity").alias("parity"), F.min("l_orderkey").alias("size_bytes"), (F.max("l_orderkey") * 1000).alias("mtime_ns")
        )

    @cached_property
    def artifacts(self) -> DataFrame:
        """One artifact per distinct path of the order lines."""
        path = F.col("relative_path")
        slide = path.endswith(".pptx") & (F.col("parity") == 0)
        identified = computed(
            self.stored_paths, F.struct(ids.artifact_id(path).alias("artifact_id"), paths.extension(path).alias("extension"))
        )
        return identified.select(
            "artifact_id", "device_id", "base", path, "extension",
            F.when(path.endswith(".png"), "image/png").when(path.endswith(".pdf"), "application/pdf").otherwise("UNKNOWN").alias("media_type"),
            F.when(slide, "slide").otherwise("UNKNOWN").alias("category"),
            "size_bytes", "mtime_ns",
            F.lit("src").alias("storage_source_id"), F.lit("UNKNOWN").alias("role"), F.lit("unknown").alias("review_state"),
            F.lit(None).cast("string").alias("experiment_id"), F.lit("{}").alias("metadata_json"),
        )

    @cached_property
    def listing(self) -> DataFrame:
        """The paths as a plain file listing."""
        return self.stored_paths.select("relative_path", "size_bytes", "mtime_ns")

    @cached_property
    def files(self) -> DataFrame:
        placed = proposals.classify(self.stored_paths).where(F.col("role").isNotNull())
        return with_file_id(
            placed.select(F.col("base").alias("experiment_id"), "role", F.lit("src").alias("storage_source_id"), "relative_path")
        )

    @cached_property
    def devices(self) -> DataFrame:
        p = self.table("part")
        device = F.concat(F.lit("D"), _text(F.lit(100) + F.col("p_partkey")))
        qualified = F.col("p_size") % 4 != 0
        return p.select(
            device.alias("device_id"), F.col("p_type").alias("device_type"), F.col("p_name").alias("display_label"),
            F.array(F.col("p_name"), F.concat(device, F.lit(" chip"))).alias("aliases"),
            F.when(qualified, F.col("p_brand")).alias("maker_namespace"), F.when(qualified, device).alias("local_device_id"),
            F.lit("unknown").alias("review_state"), F.lit("{}").alias("metadata_json"),
        )

    @cached_property
    def folders(self) -> DataFrame:
        names = self.artifacts.select("device_id", paths.first_component(F.col("relative_path")).alias("folder_name")).distinct()
        number = F.substring("device_id", 2, 20).cast("long")
        second = names.where(number % 10 == 0).select(F.concat(F.col("device_id"), F.lit("_2")).alias("folder_name"))
        odd = names.where(number % 17 == 0).select(F.concat(F.lit("X"), F.substring("device_id", 2, 20), F.lit("_mystery")).alias("folder_name"))
        return names.select("folder_name").union(second).union(odd).distinct()

    @cached_property
    def experiments(self) -> DataFrame:
        o = self.table("orders")
        key = F.col("o_orderkey")
        priority = F.substring("o_orderpriority", 1, 1)
        always = ["sample_id", "measurement_type"]
        return o.select(
            experiment_key(key).alias("experiment_id"),
            F.when(key % 9 != 0, F.concat(F.lit("D"), _text(F.col("o_custkey")))).alias("sample_id"),
            F.when(priority == "1", "photoluminescence").when(priority == "2", "absorption").alias("measurement_type"),
            F.when(key % 4 != 0, (key % 40) / F.lit(4.0)).alias("temperature_K"),
            F.when(key % 7 != 0, F.array(*[F.lit(k) for k in [*always, "temperature_K"]]))
            .otherwise(F.array(*[F.lit(k) for k in always]))
            .alias("metadata_keys"),
            (F.col("o_orderstatus") == "P").alias("needs_review"),
            ((key % 21) * 5 / F.lit(100.0)).alias("confidence"),
            F.lit("unknown").alias("review_state"), F.lit(None).cast("string").alias("parser_version"),
        )

    @cached_property
    def edges(self) -> DataFrame:
        null = F.lit(None).cast("string")
        first = self.table("lineitem").where(F.col("l_linenumber") == 1)
        measured = first.select(
            F.lit("experiment").alias("source_type"), experiment_key(F.col("l_orderkey")).alias("source_id"),
            F.lit("measured_on").alias("predicate"), F.lit("device").alias("target_type"),
            F.concat(F.lit("D"), _text(F.lit(100) + F.col("l_partkey") % 9000)).alias("target_id"),
            F.concat(F.lit("line "), _text(F.col("l_suppkey"))).alias("provenance_source"),
        )
        files = self.files.select("experiment_id", "role", "file_id")

        def linked(up: str, down: str) -> DataFrame:
            a = files.where(F.col("role") == up).select("experiment_id", F.col("file_id").alias("source_id"))
            b = files.where(F.col("role") == down).select("experiment_id", F.col("file_id").alias("target_id"))
            return a.join(b, on="experiment_id").select(
                F.lit("file").alias("source_type"), "source_id", F.lit("derived_from").alias("predicate"),
                F.lit("file").alias("target_type"), "target_id", null.alias("provenance_source"),
            )

        return measured.union(linked("raw", "processed")).union(linked("processed", "figure")).distinct()

    @cached_property
    def relationships(self) -> DataFrame:
        """Edges with id; the id also serves as their order."""
        return with_relationship_id(self.edges).withColumn("review_state", F.lit("unknown")).withColumn("ordinal", F.col("relationship_id"))

    @cached_property
    def claims(self) -> DataFrame:
        e = self.table("events")
        n = F.col("event_id")
        states = F.array(*[F.lit(s) for s in ("accepted", "corrected", "rejected", "unknown", "maybe")])
        kind = F.col("event_type")
        return e.select(
            F.lit("experiment").alias("subject_type"), experiment_key(F.floor(n / 2)).alias("subject_id"), n.alias("ordinal"),
            F.when(kind == "click", "measured_on_device").when(kind == "view", "measured_on_raw_match").otherwise(kind).alias("field"),
            F.col("props").alias("value_json"), F.when(n % 31 == 0, "").otherwise("scan").alias("source_type"),
            F.concat(F.lit("note "), _text(F.col("user_id"))).alias("source_reference"), F.lit("rule").alias("extraction_method"),
            F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("category"),
            F.when(n % 3 != 0, F.array(F.lit("first"), F.lit("second"))).otherwise(F.array().cast("array<string>")).alias("evidence"),
            F.element_at(states, (n % 5 + 1).cast("int")).alias("review_status"),
            F.when(((n % 5 == 1) & (n % 2 == 0)) | (n % 50 == 3), F.col("props")).alias("reviewed_value_json"),
        )

    @cached_property
    def prior(self) -> DataFrame:
        o = self.table("orders")
        key = F.col("o_orderkey")
        priority = F.substring("o_orderpriority", 1, 1)
        null = F.lit(None).cast("string")
        return o.select(
            F.concat(F.lit("U"), _text(F.col("o_custkey") % 20), F.lit("/f"), _text(key), F.lit(".csv")).alias("relative_path"),
            (key % 1000).alias("size_bytes"), (key * 1000).alias("mtime_ns"),
            F.when(key % 11 == 0, "missing").otherwise("present").alias("inventory_status"),
            F.when(priority == "1", "pending").when(priority == "2", "stale").when(priority == "3", "failed").otherwise("indexed").alias("metadata_status"),
            null.alias("content_hash"), F.when(key % 3 == 1, "v0").when(key % 3 == 2, "v1").alias("parser_version"),
            F.when(key % 4 == 1, "table").when(key % 4 == 2, "").alias("file_kind"), null.alias("sample_hint"),
            null.alias("last_seen_session_id"), F.lit(1).cast("long").alias("last_seen_generation"),
            F.lit("2024-01-01T00:00:00Z").alias("created_utc"), F.lit("2024-01-01T00:00:00Z").alias("updated_utc"),
        )

    @cached_property
    def new_listing(self) -> DataFrame:
        key = F.col("o_orderkey")
        kept = self.table("orders").where(key % 7 != 0).select(
            F.concat(F.lit("U"), _text(F.col("o_custkey") % 20), F.lit("/f"), _text(key), F.lit(".csv")).alias("relative_path"),
            (key % 1000 + F.when(key % 5 == 0, 1).otherwise(0)).alias("size_bytes"), (key * 1000).alias("mtime_ns"),
        )
        c = F.col("c_custkey")
        added = self.table("customer").select(
            F.concat(F.lit("N"), _text(F.col("c_nationkey")), F.lit("/c"), _text(c), F.lit(".csv")), c, c * 10
        )
        return kept.union(added)

    @cached_property
    def gate_stems(self) -> DataFrame:
        tokens = ("TG+BG=0", "TG-BG=0", "0.7TG+BG=0", "TG+BG=0Rev", "BG1+BG2=0", "TG=BG=0", "TG+BG=1", "FixTG4p5V")
        pick = ((F.col("l_orderkey") + F.col("l_linenumber")) % 8 + 1).cast("int")
        token = F.element_at(F.array(*[F.lit(t) for t in tokens]), pick)
        return self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", token.alias("token"), F.concat(F.lit("D356_"), token).alias("stem")
        )

    @cached_property
    def batch_members(self) -> DataFrame:
        key = F.col("o_orderkey")
        name = F.concat(F.lit("P-"), _text(key)).alias("proposal_id")
        o = self.table("orders")
        own = o.select((F.floor(key / 150) + 1).cast("long").alias("batch_number"), name)
        again = o.where(key % 1000 == 0).select((F.floor(key / 150) + 2).cast("long").alias("batch_number"), name)
        return own.union(again)

    @cached_property
    def manifests(self) -> DataFrame:
        """Stored manifests of each batch: base plus the stages it has reached."""
        s = self.table("supplier")
        key, nation = F.col("s_suppkey"), F.col("s_nationkey")
        reached = F.array_compact(
            F.array(
                F.lit("base"), F.when(key % 4 >= 1, F.lit("preflight_passed")), F.when(key % 4 >= 2, F.lit("upload_created")),
                F.when(key % 4 == 3, F.lit("final")),
            )
        )
        rows = s.select((key + 1).alias("batch_number"), key, nation, F.explode(reached).alias("stage"))
        stage = F.col("stage")
        verified = (stage == "final") & (nation % 2 == 0)
        status = (
            F.when(verified, "success").when(stage == "final", "processing_failed")
            .when((stage == "upload_created") & (nation % 3 == 0), "verification_failed")
            .when(stage == "upload_created", "processing").when(stage == "preflight_passed", "preflight_passed").otherwise("planned")
        )
        members = self.batch_members.groupBy("batch_number").agg(F.array_sort(F.collect_list("proposal_id")).alias("proposal_ids"))
        pair = F.struct(F.lit("P").alias("proposal_id"), F.lit("E").alias("entry_id"))
        return rows.join(members, on="batch_number").select(
            "batch_number", stage, F.concat(F.lit("B-"), _text(F.col("batch_number"))).alias("batch_id"), status.alias("status"),
            F.when(stage.isin("upload_created", "final"), F.concat(F.lit("U-"), _text(key % 50))).alias("upload_id"),
            ((stage == "upload_created") & (nation % 7 == 0)).alias("publish"),
            F.when(verified, "verified").alias("verification_status"), "proposal_ids",
            F.size("proposal_ids").cast("long").alias("expected_entry_count"),
            F.when(stage == "final", F.array_repeat(pair, 3)).otherwise(F.array().cast("array<struct<proposal_id:string,entry_id:string>>")).alias("entry_ids"),
        )

    @cached_property
    def uploads(self) -> DataFrame:
        c, n = F.col("c_custkey"), F.col("c_nationkey")
        batch = (F.floor(c / 15) + 1).cast("long")
        group = F.floor(c / 15) % 3
        named = ((c % 15 == 0) & (group >= 1)) | ((c % 15 == 1) & (group == 2))
        return self.table("customer").select(
            F.concat(F.lit("upload-"), _text(batch)).alias("upload_name"), c, batch.alias("batch_number"),
            F.when(named, F.concat(F.lit("R-"), _text(c))).alias("upload_id"),
            F.when(n % 5 == 0, "SUCCESS").when(n % 5 == 1, "Processing").when(n % 5 == 2, "FAILED").when(n % 5 == 3, "odd").alias("process_status"),
            (n % 6 == 0).alias("process_running"), (n % 4 == 0).alias("published"), (n % 9 == 0).alias("not_found"), n,
        )

    @cached_property
    def evaluations(self) -> DataFrame:
        d = F.col("doc_id")
        return self.table("labels").select(
            F.concat(F.lit("case-"), _text(d)).alias("benchmark_question_id"),
            F.when(d % 17 == 0, "").otherwise("provider").alias("provider_id"), F.lit(None).cast("string").alias("model_id"),
            ((d % 13) / F.lit(10.0)).alias("recall"), (d - 5).cast("double").alias("latency_ms"), F.lit(None).cast("double").alias("cost"),
        )

    @cached_property
    def vectors(self) -> DataFrame:
        bad = F.array(F.lit(float("nan")).cast("float"))
        return self.table("embeddings").select(
            "vec_id", F.when(F.col("vec_id") % 50 == 0, bad).otherwise(F.col("embedding")).alias("embedding")
        )

    @cached_property
    def points(self) -> DataFrame:
        return self.table("events").select(
            F.col("user_id").alias("artifact"), F.col("event_id").alias("row"), F.col("event_id").cast("double").alias("x"), F.col("value").alias("y")
        )

    @cached_property
    def page_refs(self) -> DataFrame:
        return self.table("pages").select(
            "page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("storage_source_id"),
            F.regexp_extract("url", "^https?://[^/?#]+/([^?#]*)", 1).alias("relative_path"),
        )


__all__ = ["Views", "view", "with_views"]
