"""Personal data and the terms that give it away, in DataFrame operations only.

Base spans come from four patterns over the whole text.  Spark's functions return
matches without positions, so each text is also split at the pattern: the start
of a match is the length of all gaps up to it and of all matches before it, a
running sum over the pieces of one text.

The words of a text that holds a base span (its entity) are the entity's terms,
wherever in the text they stand.  Counts over the corpus say how much a term tells
about the entity:

* documents that hold the term, with and without the entity, whose ratio is the
  chance of the entity given the term,
* the information in bits, log2 of that chance over the entity's own share of documents.

Terms with the same entity in at least ``SUPPORT`` different texts, with a chance of
at least ``CHANCE`` and at least ``BITS`` bits, disclose it.  All their places in the
texts with the entity are added: ``term`` (generalised) or, from a chance of
``CERTAIN``, ``reveal`` (removed).  An entity of fewer different texts can have no
such term, so only the texts of the others are cut into words.

Cases: null text is empty; parts of addresses above 255, card numbers failing the
check digit and numbers of other lengths are dropped without another try;
repeated rows are rows of their own but one text as support; an empty table gives
no row; further columns are not read.  Positions are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import cut_lineage, table

SUPPORT = 2
CHANCE, CERTAIN = 0.5, 0.9
BITS = 8.0
TERM = r"[\p{L}\p{N}]+"
BROADCAST_TERMS = 100_000
KINDS = ("email", "ip", "card", "phone")
ADDED = ("term", "reveal")

# The loops are possessive where nothing behind them could make them give back, which
# changes no match and keeps the matcher from recursing on long runs.  A run that fails
# from its first character fails from every later one, so matches are only tried where a
# run begins or the last match ended; a long run is then read once and not once a character.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A cheap test that a text can hold the kind at all.
HINT_TEXT = {"email": "@", "phone": "+"}


def _pieces(text: Column, kind: str) -> Column:
    """Matches of a kind with the length of the gap before each."""
    pattern = F.lit(PATTERNS[kind])
    gaps = F.transform(F.split(text, PATTERNS[kind], -1), F.length)
    both = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(0)).alias("value"), gaps.alias("gap"))
    hint = text.contains(HINT_TEXT[kind]) if kind in HINT_TEXT else text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9][\x20-]?[0-9]")
    return F.struct(F.lit(kind).alias("kind"), F.when(hint, both).alias("pieces"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit fits: from the right, every second digit doubled."""
    reverse = F.reverse(digits)
    doubled = lambda i: F.substr(reverse, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda s, i: s + F.when(doubled(i) > 9, doubled(i) - 9).otherwise(doubled(i)))
    return total % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    n = F.length(digits)
    part = lambda p: F.regexp_replace(p, "^0+", "")
    fits = F.forall(F.split(value, r"\."), lambda p: F.when(F.length(part(p)) > 3, False).otherwise(F.coalesce(F.nullif(part(p), F.lit("")), F.lit("0")).cast("int") <= 255))
    return (
        F.when(kind == "ip", fits)
        .when(kind == "card", F.when(n.between(13, 19), _luhn(digits)).otherwise(False))
        .when(kind == "phone", n.between(9, 15))
        .otherwise(True)
    )


def matches(docs: DataFrame) -> DataFrame:
    """One stored row per document with its row number and the pieces of each kind; the text where there are any."""
    text = F.coalesce("text", F.lit(""))
    kinds = F.filter(F.array(*[_pieces(text, k) for k in KINDS]), lambda k: F.coalesce(F.size(k["pieces"]), F.lit(0)) > 1)
    return cut_lineage(docs.select("doc_id", F.monotonically_increasing_id().alias("row"), F.xxhash64(text).alias("text_hash"), kinds.alias("kinds"), F.when(F.size(kinds) > 0, text).alias("text")))


def base_spans(found: DataFrame) -> DataFrame:
    """row, text_hash, kind, value, start, end of every valid base match."""
    pieces = found.select("row", "text_hash", F.inline("kinds")).select("row", "text_hash", "kind", F.posexplode("pieces").alias("place", "piece"))
    pieces = pieces.select("row", "text_hash", "kind", "place", F.col("piece.value").alias("value"), F.col("piece.gap").alias("gap"))
    order = Window.partitionBy("row", "kind").orderBy("place")
    passed = F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    placed = pieces.withColumn("start", (F.coalesce(passed, F.lit(0)) + F.col("gap")).cast("int"))
    placed = placed.where("value IS NOT NULL").where(_valid(F.col("kind"), F.col("value")))
    return placed.withColumn("end", F.col("start") + F.length("value"))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def with_entity(spans: DataFrame) -> DataFrame:
    """Spans with the entity they name."""
    return spans.withColumn("entity", F.xxhash64("kind", F.lower("value")))


def repeated_entities(spans: DataFrame, support: int = SUPPORT) -> DataFrame:
    """Spans of the entities that stand in at least ``support`` different texts."""
    spans = with_entity(spans)
    held = spans.groupBy("entity").agg(F.count_distinct("text_hash").alias("texts")).where(F.col("texts") >= support)
    return spans.join(held.select("entity"), "entity", "left_semi")


def context_terms(spans: DataFrame, found: DataFrame) -> DataFrame:
    """All words of the texts with an entity: row, text_hash, entity, term, start, end; a word with several spans of one entity once."""
    entities = with_entity(spans).select("row", "text_hash", "entity").distinct()
    texts = found.where("text IS NOT NULL").join(entities.select("row").distinct(), "row", "left_semi")
    # As with base spans: a word starts behind all gaps and words before it.
    pieces = F.arrays_zip(_words(F.col("text")).alias("value"), F.transform(F.split("text", TERM, -1), F.length).alias("gap"))
    placed = texts.select("row", F.posexplode(pieces).alias("place", "piece")).select("row", "place", "piece.value", "piece.gap")
    before = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    passed = F.coalesce(F.sum(F.col("gap") + F.coalesce(F.length("value"), F.lit(0))).over(before), F.lit(0))
    words = placed.withColumn("start", (passed + F.col("gap")).cast("int")).where("value IS NOT NULL")
    words = words.select("row", F.lower("value").alias("term"), "start", (F.col("start") + F.length("value")).alias("end"))
    return words.join(entities, "row").select("row", "text_hash", "entity", "term", "start", "end")


def disclosing(docs: DataFrame, terms: DataFrame, support: int = SUPPORT, chance: float = CHANCE, bits: float = BITS) -> DataFrame:
    """entity, term and chance of the terms over the thresholds.

    Only terms with the asked support are counted in the corpus.  They are
    broadcast when their number, taken first, is small; else the counts meet
    them in a shuffle.
    """
    near = terms.groupBy("entity", "term").agg(F.count_distinct("row").alias("together"), F.count_distinct("text_hash").alias("texts"))
    near = cut_lineage(near.where(F.col("texts") >= support))
    wanted = near.select("term").distinct()
    if wanted.count() <= BROADCAST_TERMS:
        wanted = F.broadcast(wanted)
    words = docs.select(F.explode(F.array_distinct(F.transform(_words(F.col("text")), F.lower))).alias("term"))
    corpus = words.join(wanted, "term").groupBy("term").agg(F.count(F.lit(1)).alias("everywhere"))
    entities = terms.groupBy("entity").agg(F.count_distinct("row").alias("entity_rows"))
    met = near.join(corpus, "term").join(entities, "entity")
    share = F.least(F.lit(1.0), F.col("together") / F.col("everywhere"))
    information = F.log2(share / (F.col("entity_rows") / F.lit(float(max(1, docs.count())))))
    return met.select("entity", "term", share.alias("chance")).where((F.col("chance") >= chance) & (information >= bits))


def detect(docs: DataFrame, bits: float = BITS) -> tuple[DataFrame, DataFrame]:
    """Stored matches per document row, and all spans: row, kind, start, end."""
    found = matches(docs)
    spans = base_spans(found)
    terms = cut_lineage(context_terms(repeated_entities(spans), found))
    shown = terms.join(disclosing(docs, terms, bits=bits), ["entity", "term"])
    kind = F.when(F.col("chance") >= CERTAIN, F.lit("reveal")).otherwise(F.lit("term"))
    added = shown.groupBy("row", "start", "end").agg(F.max("chance").alias("chance")).select("row", kind.alias("kind"), "start", "end")
    # A word inside another base span is part of that span already.
    base = spans.select("row", "kind", "start", "end")
    inside = base.select(F.col("row").alias("r"), F.col("start").alias("s"), F.col("end").alias("e"))
    added = added.join(inside, (F.col("row") == F.col("r")) & (F.col("start") < F.col("e")) & (F.col("s") < F.col("end")), "left_anti")
    return found, base.unionByName(added)


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, bits: float = BITS) -> DataFrame:
    """doc_id, text_hash and the ordered array of spans of every row."""
    found, spans = detect(docs, bits)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS + ADDED]), F.col("kind")).cast("int")
    # The spans of one document: bounded by its text.
    per_row = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(rank.alias("rank"), "start", "end", "kind"))).alias("spans"))
    nothing = F.array().cast("array<struct<rank:int,start:int,end:int,kind:string>>")
    return found.join(per_row, "row", "left").select("doc_id", "text_hash", F.coalesce("spans", nothing).alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """Documents with base spans replaced by their kind, generalised terms by a mark and revealing terms removed."""
    ranges = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.when(s["kind"] == "reveal", F.lit("")).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">"))).alias("mark")))
    last_first = F.reverse(F.array_sort(ranges))
    # Of overlapping spans the one that ends last is replaced, the other is inside or cut off by it.
    kept = F.aggregate(last_first, F.array().cast("array<struct<start:int,end:int,mark:string>>"), lambda got, s: F.when((F.size(got) > 0) & (F.coalesce(F.get(got, F.size(got) - 1)["start"], F.lit(-1)) < s["end"]), F.concat(F.slice(got, F.lit(1), F.size(got) - 1), F.array(F.struct(s["start"].alias("start"), F.greatest(s["end"], F.get(got, F.size(got) - 1)["end"]).alias("end"), s["mark"].alias("mark"))))).otherwise(F.concat(got, F.array(s))))
    spans = report(docs).where(F.size("spans") > 0).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash"), kept.alias("__kept")).dropDuplicates(["__id", "__hash"])
    met = docs.join(spans, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__hash")), "left")
    put = F.aggregate("__kept", F.col("text"), lambda text, s: F.overlay(text, s["mark"], s["start"] + 1, s["end"] - s["start"]))
    return met.select(*[F.coalesce(F.when(F.col("__kept").isNotNull(), put), docs["text"]).alias("text") if c == "text" else docs[c] for c in docs.columns])


def op8_privacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = report(table(spark, sf_dir, "documents"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda s: s["kind"].isin(*KINDS))
    return got.select("doc_id", *[of(k) for k in KINDS], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))
