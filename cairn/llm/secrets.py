"""Secret scan with multipart credential linking.

One pass over the whole texts finds the base spans (assignments, access ids, hex
strings) and weak candidates: account names, long mixed strings that nothing
assigns, endpoints.  Every found part becomes a row (text key, part, position).
An interval join within scopes then brings complementary parts together: parts
of one text whose starts lie at most ``REACH`` code points apart.  Positions fall
into strips of that width; each secret-side row is listed in its own strip and
both neighbours, so the join is an equality on (text, strip) with the distance
as residual, and the spans of one strip are bounded by its width.

A weak candidate alone means nothing.  It is reported only

* weak secret (``blob``): next to an access id or an account name,
* account name (``account``): next to an assigned or weak secret,
* endpoint (``endpoint``): next to an access id or account name and also to a secret.

Cases: null text is empty; overlapping kinds are separate spans; repeated rows
give repeated result rows, their parts are joined once; an empty table gives no
row; further columns are not read.  Positions are code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm.common import cut_lineage, table

REACH = 400
BASE = ("assign", "access", "hex")
WEAK = ("account", "blob", "endpoint")
KINDS = BASE + WEAK

ASSIGN = re.compile(
    r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# Runs of 24 and more; a shorter run fails as a whole, as the rule asks.
HEX = re.compile(r"[0-9a-f]{24,}")
ACCOUNT = re.compile(r"(?i:user(?:name)?|login|account|client_?id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9._@-]{3,64})", re.ASCII)
# A whole run of 16 and more, URL-safe ones included, with a digit and both cases.
RUN = "[A-Za-z0-9+/_-]"
BLOB = re.compile(f"(?<!{RUN})(?={RUN}*[0-9])(?={RUN}*[A-Z])(?={RUN}*[a-z]){RUN}{{16,}}+={{0,2}}")
ENDPOINT = re.compile(r"(?:https?|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9._~:@/?&=%-]+|(?i:host|endpoint|server)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9.-]{3,}(?::[0-9]{2,5})?", re.ASCII)

FOUND = (
    "doc_id long, text_key string, n_assign long, n_access long, n_hex long, base_sha256 string, "
    "parts array<struct<kind:string,start:int,end:int>>"
)


def parts_of(text: str) -> list[tuple[str, int, int]]:
    """All parts of a text as (kind, start, end), weak ones outside the base spans."""
    base = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
    base += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    base += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    weak = [(k, m.start(), m.end()) for k, rule in (("account", ACCOUNT), ("blob", BLOB), ("endpoint", ENDPOINT)) for m in rule.finditer(text)]
    taken = sorted((s, e) for _, s, e in base)
    return base + [part for w in weak for part in _outside(text, *w, taken)]


def _outside(text: str, kind: str, start: int, end: int, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
    """A weak part without the base spans in it: all rests of an endpoint, those rests of a long string that are one, no account cut in two."""
    inside = [(s, e) for s, e in taken if s < end and start < e]
    if not inside:
        yield kind, start, end
    elif kind != "account":
        for s, e in [*inside, (end, end)]:
            if start < s and (kind == "endpoint" or BLOB.fullmatch(text[start:s])):
                yield kind, start, s
            start = max(start, e)


def _in_order(parts):
    return sorted(parts, key=lambda p: (p[1], KINDS.index(p[0])))


def _find(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for doc_id, text in zip(frame["doc_id"], frame["text"]):
            text = text if isinstance(text, str) else ""
            parts = parts_of(text)
            base = _in_order(p for p in parts if p[0] in BASE)
            kinds = [p[0] for p in base]
            digest = hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()
            key = f"{'' if pd.isna(doc_id) else int(doc_id)}:{hashlib.md5(text.encode()).hexdigest()}" if parts else None
            rows.append((doc_id, key, *(kinds.count(k) for k in BASE), digest, [dict(zip(("kind", "start", "end"), p)) for p in parts]))
        yield pd.DataFrame(rows, columns=["doc_id", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", "parts"]).astype({"doc_id": "Int64"})


def find_parts(docs: DataFrame) -> DataFrame:
    """One row per document: base counts, base digest and all parts (bounded by the text)."""
    return docs.select("doc_id", "text").mapInPandas(_find, FOUND)


def linked_spans(found: DataFrame, reach: int = REACH) -> DataFrame:
    """Weak parts with complementary parts in reach: text_key, kind, start, end."""
    parts = found.where("text_key IS NOT NULL").select("text_key", F.inline("parts")).distinct()
    strip = F.floor(F.col("start") / reach)
    weak = parts.where(F.col("kind").isin(*WEAK)).withColumn("strip", strip)
    near = parts.select("text_key", F.col("kind").alias("near_kind"), F.col("start").alias("near_start"), F.explode(F.array(strip - 1, strip, strip + 1)).alias("strip"))
    met = weak.join(near, ["text_key", "strip"]).where((F.abs(F.col("start") - F.col("near_start")) <= reach) & (F.col("start") != F.col("near_start")))
    by_id, by_secret = F.col("near_kind").isin("access", "account"), F.col("near_kind").isin("assign", "blob", "hex")
    seen = met.groupBy("text_key", "kind", "start", "end").agg(F.bool_or(by_id).alias("has_id"), F.bool_or(by_secret).alias("has_secret"))
    complete = F.when(F.col("kind") == "blob", F.col("has_id")).when(F.col("kind") == "account", F.col("has_secret")).otherwise(F.col("has_id") & F.col("has_secret"))
    return seen.where(complete).select("text_key", "kind", "start", "end")


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """Every document with its base results and all spans: base ones and linked weak ones."""
    found = cut_lineage(find_parts(docs))
    added = linked_spans(found, reach).groupBy("text_key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("added"))
    # Only rows with parts meet the join; the others have no key and would all fall into one task.
    keyed_rows = found.where("text_key IS NOT NULL").join(added, "text_key", "left").select(*found.columns, "added")
    joined = keyed_rows.unionByName(found.where("text_key IS NULL"), allowMissingColumns=True)
    base = F.filter("parts", lambda p: p["kind"].isin(*BASE))
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k).cast("int")
    keyed = F.transform(F.concat(base, F.coalesce("added", F.array().cast("array<struct<kind:string,start:int,end:int>>"))), lambda p: F.struct(p["start"].alias("start"), rank(p["kind"]).alias("rank"), p["kind"].alias("kind"), p["end"].alias("end")))
    return joined.select("doc_id", "text_key", "n_assign", "n_access", "n_hex", "base_sha256", F.array_sort(keyed).alias("found"))


def _merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans that touch become one; last first, so that replacing keeps earlier positions."""
    for frame in frames:
        merged = []
        for spans in frame["spans"]:
            out: list[list[int]] = []
            for start, end in sorted((int(s["start"]), int(s["end"])) for s in spans):
                if out and start <= out[-1][1]:
                    out[-1][1] = max(out[-1][1], end)
                else:
                    out.append([start, end])
            merged.append([{"start": s, "end": e} for s, e in reversed(out)])
        yield pd.DataFrame({"text_key": frame["text_key"], "spans": merged})


def redact(docs: DataFrame, mark: str = "<secret>", reach: int = REACH) -> DataFrame:
    """Documents with every reported span replaced by a mark and n_chars to match; all others unchanged."""
    found = scan(docs, reach).where((F.size("found") > 0) & F.col("text_key").isNotNull())
    spans = F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    spans = found.select("text_key", spans.alias("spans")).dropDuplicates(["text_key"])
    spans = spans.mapInPandas(_merge, "text_key string, spans array<struct<start:int,end:int>>")
    # Names that no table uses; the table's own columns stay as they are.
    spans = spans.select(F.col("text_key").alias("__key"), F.col("spans").alias("__spans"))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5("text"))
    met = docs.withColumn("__key", key).join(spans, "__key", "left")
    changed = F.col("__spans").isNotNull()
    put = F.aggregate("__spans", F.col("text"), lambda text, s: F.overlay(text, F.lit(mark), s["start"] + 1, s["end"] - s["start"]))
    out = met.withColumn("text", F.when(changed, put).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    text = F.transform("found", lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.array_join(text, ",").alias("spans"))
