"""Mix sources to target weights with a low-discrepancy schedule, in DataFrame operations only.

Every source is one stream of words: its documents in hash order, one behind the
other, cut into blocks of equally many words.  The mix is a sequence of slots.
Slot ``i`` looks at the golden-ratio point ``frac((i + 1/2) * phi)``; the source
whose part of the cumulative weights holds that point fills the slot.  Slots are
ranked within their source, and the slot of rank ``k`` takes the block
``k mod blocks`` of the stream, so a second pass over a source begins only after
its first.  The points are evenly spread over every stretch of slots, so any
prefix of the mix has the same proportions.

Ranks and stream positions are two-level: counts or sums per (source, bucket),
running totals over the buckets, then a window inside one bucket.  No source is
ever one group of a window, however large its share.

Cases: null text has size 0 and is never taken; null sources form the last
source; repeated rows are documents of their own; an empty table gives no row;
other columns are kept out of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairn.llm.common import WORD, cut_lineage, shuffle_width, table

GOLDEN = 0.6180339887498949
WEIGHTS = (3, 1, 2)
BLOCK_WORDS = 64
CELLS = 1024


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the hash that orders a source's stream."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    digest = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.coalesce("source", F.lit(""))))
    return docs.select("doc_id", "source", size.alias("size"), F.conv(F.substring(digest, 1, 15), 16, 10).cast("long").alias("ticket"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per source: its size, weight and target.

    Sources in order of the ratio cap / weight fill up first; the water level of
    the rest is what the filled ones leave, shared by weight.  The windows run
    over one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", weight)
    rows = rows.withColumn("cap", most * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("level", (share * F.sum("source_size").over(everything) - before) / rest)
    full = F.col("cap") <= F.col("level") * F.col("weight")
    level = F.max(F.when(~full, F.col("level"))).over(everything)
    target = F.when(full, F.col("cap")).otherwise(F.least("cap", F.col("weight") * level))
    return rows.select("source", "source_size", "weight", target.alias("target"))


def _key(source: Column) -> Column:
    """A join key that also matches null sources."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def _offsets(rows: DataFrame, value: Column) -> DataFrame:
    """Running total of ``value`` over the buckets before each (source_key, bucket)."""
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source_key", "bucket").agg(value.alias("amount"))
    return sums.select("source_key", "bucket", F.coalesce(F.sum("amount").over(before), F.lit(0)).alias("offset"))


def stream_positions(sizes: DataFrame, buckets: int) -> DataFrame:
    """Each document's first word in its source's stream of words."""
    rows = sizes.withColumn("source_key", _key(F.col("source"))).withColumn("bucket", F.floor(F.col("ticket") / F.lit((1 << 60) // buckets + 1)))
    inside = Window.partitionBy("source_key", "bucket").orderBy("ticket", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    offsets = _offsets(rows, F.sum("size"))
    return local.join(offsets, ["source_key", "bucket"]).withColumn("first", F.col("inside") + F.col("offset")).drop("inside", "offset", "bucket")


def schedule(spark: SparkSession, goals: DataFrame, block: int) -> DataFrame:
    """Slots: slot, source_key, rank of the slot within its source, block it takes.

    Points meet sources through equal cells of [0, 1): a source lists the cells
    it touches, a point has one cell, and within the cell its bounds decide.
    """
    parts = goals.where("target > 0").withColumn("slots", F.col("target") / block)
    total = parts.agg(F.sum("slots")).first()[0] or 0.0
    # Not 0.5: totals are multiples of 1/128 up to rounding, and none of them is near 0.497.
    n = int(total + 0.503)
    bucket = max(4096, n // (4 * shuffle_width(spark)))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    upper = F.sum("slots").over(by_name.rowsBetween(Window.unboundedPreceding, 0)) / F.lit(total or 1.0)
    parts = parts.withColumn("upper", upper).withColumn("lower", F.coalesce(F.lag("upper").over(by_name), F.lit(0.0)))
    parts = parts.withColumn("upper", F.when(F.lead("upper").over(by_name).isNull(), F.lit(2.0)).otherwise(F.col("upper")))
    cells = F.sequence(F.floor(F.col("lower") * CELLS).cast("int"), F.least(F.lit(CELLS - 1), F.floor(F.col("upper") * CELLS).cast("int")))
    blocks = F.ceil(F.col("source_size") / block)
    parts = parts.select(_key(F.col("source")).alias("source_key"), "lower", "upper", blocks.alias("blocks"), F.explode(cells).alias("cell"))
    point = (F.col("id") + 0.5) * GOLDEN
    points = spark.range(n).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point"))
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    slots = points.join(parts, "cell").where("point >= lower AND point < upper").withColumn("bucket", F.floor(F.col("slot") / bucket))
    inside = F.row_number().over(Window.partitionBy("source_key", "bucket").orderBy("slot")) - 1
    ranked = slots.withColumn("inside", inside).join(_offsets(slots, F.count(F.lit(1))), ["source_key", "bucket"])
    rank = F.col("inside") + F.col("offset")
    return ranked.select("slot", "source_key", rank.alias("rank"), F.pmod(rank, F.col("blocks")).alias("block"), "blocks")


def mix_sources(docs: DataFrame, block: int = BLOCK_WORDS, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """One row per document: size, source_size, target of the source, words taken.

    A document gives the words of its blocks that slots took.  A slot beyond two
    passes over its source (rounding of the schedule) stays empty.
    """
    spark = docs.sparkSession
    sizes = cut_lineage(sized(docs))
    goals = targets(sizes, weights, share, most)
    placed = stream_positions(sizes, 4 * shuffle_width(spark))
    taken = schedule(spark, goals, block).where(F.col("rank") < most * F.col("blocks")).groupBy("source_key", "block").agg(F.count(F.lit(1)).alias("times"))
    last = F.col("first") + F.col("size")
    spans = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("first") / block), F.floor((last - 1) / block)))
    pieces = placed.select("doc_id", "source", "source_key", "ticket", "size", "first", F.explode_outer(spans).alias("block"))
    overlap = F.least(last, (F.col("block") + 1) * block) - F.greatest(F.col("first"), F.col("block") * block)
    met = pieces.join(taken, ["source_key", "block"], "left").withColumn("words", F.coalesce(overlap * F.col("times"), F.lit(0)))
    per_doc = met.groupBy("doc_id", "source", "source_key", "size", "first", "ticket").agg(F.sum("words").cast("long").alias("taken"))
    goals = goals.select(_key(F.col("source")).alias("source_key"), "source_size", "target")
    return _restore(per_doc, sizes).join(goals, "source_key").select("doc_id", "source", "size", "source_size", "target", "taken")


def _restore(per_doc: DataFrame, sizes: DataFrame) -> DataFrame:
    """Documents of size 0 share a position with their neighbour; the grouping keeps one of equal rows, the rest come back here."""
    nothing = (F.col("size") == 0)
    empty = sizes.where(nothing).select("doc_id", "source", _key(F.col("source")).alias("source_key"), "size", F.lit(0).cast("long").alias("taken"))
    return per_doc.where(~nothing).select("doc_id", "source", "source_key", "size", "taken").unionByName(empty)


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


# The same rules over whole streams: DuckDB ranks slots and words with plain windows.
SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || CASE WHEN source IS NULL THEN ':' ELSE ':' || source END), 1, 15) AS BIGINT) AS ticket
  FROM documents),
sources AS (
  SELECT source, source_size, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source)),
levels AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources),
goals AS (
  SELECT source, source_size, weight,
    CASE WHEN cap <= level * weight THEN cap ELSE least(cap, weight * max(CASE WHEN cap > level * weight THEN level END) OVER ()) END AS target
  FROM levels),
parts AS (
  SELECT *, sum(target / {BLOCK_WORDS}) OVER (ORDER BY source NULLS LAST) / sum(target / {BLOCK_WORDS}) OVER () AS upper_end,
    row_number() OVER (ORDER BY source NULLS LAST) AS place, count(*) OVER () AS places
  FROM goals WHERE target > 0),
bounds AS (
  SELECT source, source_size, coalesce(lag(upper_end) OVER (ORDER BY place), 0) AS lo,
    CASE WHEN place = places THEN 2.0 ELSE upper_end END AS hi
  FROM parts),
points AS (
  SELECT i AS slot, (i + 0.5::DOUBLE) * {GOLDEN}::DOUBLE - floor((i + 0.5::DOUBLE) * {GOLDEN}::DOUBLE) AS point
  FROM range((SELECT CAST(floor(coalesce(sum(target / {BLOCK_WORDS}), 0) + 0.503) AS BIGINT) FROM goals)) t(i)),
ranked AS (
  SELECT b.source, row_number() OVER (PARTITION BY b.source ORDER BY slot) - 1 AS rank, CAST(ceil(source_size / {BLOCK_WORDS}) AS BIGINT) AS blocks
  FROM points JOIN bounds b ON point >= lo AND point < hi),
taken AS (
  SELECT source, rank % blocks AS block, count(*) AS times FROM ranked WHERE rank < 2 * blocks GROUP BY ALL),
placed AS (
  SELECT *, row_number() OVER () AS line,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY ticket, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first
  FROM sized),
pieces AS (
  SELECT line, source, first, size, unnest(range(CAST(first // {BLOCK_WORDS} AS BIGINT), CAST((first + size - 1) // {BLOCK_WORDS} AS BIGINT) + 1)) AS block
  FROM placed WHERE size > 0),
met AS (
  SELECT line, sum((least(first + size, (p.block + 1) * {BLOCK_WORDS}) - greatest(first, p.block * {BLOCK_WORDS})) * coalesce(times, 0)) AS words
  FROM pieces p LEFT JOIN taken t ON p.block = t.block AND p.source IS NOT DISTINCT FROM t.source GROUP BY line)
SELECT doc_id, p.source, size, source_size, target, CAST(coalesce(words, 0) AS BIGINT) AS taken
FROM placed p JOIN goals g ON p.source IS NOT DISTINCT FROM g.source LEFT JOIN met USING (line)
"""
