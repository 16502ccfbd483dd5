"""Mixing sources to target weights by a low-discrepancy schedule, DataFrame functions only.

The words of a source, its documents shuffled, form a line of ``source_size`` words that repeats
once. The line is cut into blocks of equal numbers of words. Slots of the mix are the points of the
golden-ratio sequence, mapped through the cumulative targets: each slot belongs to the source whose
share holds its point, and the j-th slot of a source takes its j-th block. So any stretch of the mix
holds the sources close to their weights. Slots that a source still lacks at the end follow behind;
its last block ends at the target, so the words taken are the rounded target, and as no target is
above twice the source, no document is taken more than twice.

Running totals of documents and slots are taken in two steps (inside hash buckets or runs of slots,
and over their sums), so a hot source is never ordered by one task. The bounds are settings:
``BUCKET_DIGITS`` gives 16 ** 4 buckets a source, ``MAX_SLOTS`` the length of the schedule, and
blocks grow with the corpus instead. Sources are a table like any other and are not collected.

Defined cases: a null text has size 0 and is never taken; a null source is a source, ordered last;
repeated rows are documents of their own; an empty table, or one without words, takes nothing;
further columns are ignored by ``mix`` and kept by ``mixture``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seriesmill.llm.text import table, word_count
from seriesmill.session import written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
MIN_BLOCK = 32
MAX_SLOTS = 1 << 20
BUCKET_DIGITS = 4
RUN = 4096
CELLS = 4096
SEED = "mix-1:"
GOLDEN = 0.6180339887498949


def source_targets(sizes: DataFrame) -> DataFrame:
    """Rows source, source_size -> also sid, target: weights in turn, filled up to the caps.

    In the order of cap per weight, a source is capped if an equal share of what the capped ones
    before it leave would be above its cap; the first that isn't sets the level of all others.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    numbered = sizes.withColumn("sid", (F.row_number().over(by_name) - 1).cast("long"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("sid") % len(WEIGHTS) + 1).cast("int"))
    ready = numbered.withColumn("weight", weight).withColumn(
        "cap", MAX_REPEATS * F.col("source_size").cast("double")
    )
    ordered = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (
        ready.withColumn("total", SHARE * F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("filled", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("used", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("total") - F.col("filled")) / (F.col("weights") - F.col("used")))
        .withColumn("capped", F.col("level") * F.col("weight") >= F.col("cap"))
        .withColumn("at", F.row_number().over(ordered))
    )
    open_level = F.min_by(F.col("level"), F.when(~F.col("capped"), F.col("at"))).over(everything)
    return level.withColumn("open_level", open_level).select(
        "source",
        "sid",
        "source_size",
        F.when(F.col("capped"), F.col("cap")).otherwise(F.col("open_level") * F.col("weight")).alias("target"),
    )


def _with_block(sources: DataFrame) -> DataFrame:
    """Add what a source takes in words, its place among the targets, and the words of a block."""
    named = Window.orderBy("sid")
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    quota = sources.withColumn("quota", F.round("target").cast("long"))
    total = F.sum("quota").over(everything)
    return (
        quota.withColumn("total", total)
        .withColumn("to", F.sum("quota").over(named) / F.greatest(F.lit(1), F.col("total")))
        .withColumn("from", F.col("to") - F.col("quota") / F.greatest(F.lit(1), F.col("total")))
        .withColumn("block", F.greatest(F.lit(MIN_BLOCK), F.ceil(F.col("total") / MAX_SLOTS)).cast("long"))
    )


def schedule(sources: DataFrame, total: int, block: int) -> DataFrame:
    """Rows slot, sid, rank: which block of which source each slot of the mix takes."""
    spark = sources.sparkSession
    slots = -(-total // block)
    points = spark.range(slots).select(
        F.col("id").alias("slot"), ((F.col("id") + 1) * F.lit(GOLDEN) % F.lit(1.0)).alias("point")
    )
    points = points.withColumn("cell", F.floor(F.col("point") * CELLS))
    held = sources.where("quota > 0").select(
        "sid",
        "from",
        "to",
        F.explode(F.sequence(F.floor(F.col("from") * CELLS), F.ceil(F.col("to") * CELLS))).alias("cell"),
    )
    dealt = (
        points.join(held, "cell")
        .where("point >= `from` and point < `to`")
        .select("slot", "sid", F.floor(F.col("slot") / RUN).alias("run"))
    )
    runs = dealt.groupBy("sid", "run").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("sid").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = runs.select("sid", "run", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    inside = Window.partitionBy("sid", "run").orderBy("slot")
    ranked = (
        dealt.withColumn("at", F.row_number().over(inside))
        .join(starts, ["sid", "run"])
        .select("slot", "sid", (F.col("start") + F.col("at") - 1).alias("rank"))
    )
    need = sources.where("quota > 0").select("sid", F.ceil(F.col("quota") / F.lit(block)).cast("long").alias("need"))
    have = runs.groupBy("sid").agg(F.sum("n").alias("have"))
    lacking = need.join(have, "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    behind = lacking.select("sid", F.explode(F.sequence(F.col("have"), F.col("need") - 1)).alias("rank")).select(
        (F.col("rank") * F.lit(1) + slots).alias("slot"), "sid", "rank"
    )
    used = ranked.join(need, "sid").where("rank < need").select("slot", "sid", "rank")
    return used.unionAll(behind)


def _lines(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """Documents with their place on the shuffled line of their source."""
    key = F.md5(F.concat(F.lit(SEED), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = (
        docs.join(sources, docs["source"].eqNullSafe(sources["source"]))
        .drop("source")
        .withColumn("key", key)
        .withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    )
    sums = rows.groupBy("sid", "bucket").agg(F.sum("size").alias("held"))
    earlier = Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("sid", "bucket", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("begins"))
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "doc_id", "size", "row")
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.withColumn("at", F.row_number().over(inside))
        .withColumn("ahead", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .join(starts, ["sid", "bucket"])
        .withColumn("place", F.col("begins") + F.col("ahead"))
    )


def mix(docs: DataFrame) -> DataFrame:
    """Rows doc_id, size, source_size, target, taken: one per row of ``docs``."""
    return _mixed(docs, F.lit(0))[0].drop("row")


def _mixed(docs: DataFrame, row: Column) -> tuple[DataFrame, DataFrame]:
    """The plan with the rows' own keys, and the sizes that it was made from."""
    sized = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), row.alias("row")), "sizes")
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(_with_block(source_targets(sizes)), "sources")
    bound = sources.select("total", "block").first()
    if bound is None:
        none = [F.lit(0).cast("long").alias("source_size"), F.lit(0.0).alias("target"), F.lit(0).cast("long").alias("taken")]
        return sized.select("row", "doc_id", "size", *none), sized
    block = bound["block"]
    slots = schedule(sources, bound["total"], block).select("sid", F.col("rank").alias("block"), F.lit(1).alias("used"))
    lines = _lines(sized, sources.select("source", "sid", "source_size", "target", "quota"))
    rounds = lines.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(MAX_REPEATS - 1)))).withColumn(
        "start", F.col("place") + F.col("round") * F.col("source_size")
    )
    rounds = rounds.withColumn("end", F.least(F.col("start") + F.col("size"), F.col("quota")))
    touched = F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))
    pieces = rounds.withColumn("block", F.explode(F.when(F.col("end") > F.col("start"), touched).otherwise(F.array(F.lit(None).cast("long")))))
    overlap = F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block)
    taken = pieces.join(slots, ["sid", "block"], "left").withColumn(
        "part", F.when(F.col("used") == 1, overlap).otherwise(F.lit(0))
    )
    plan = (
        taken.groupBy("sid", "bucket", "at", "row", "doc_id", "size", "source_size", "target")
        .agg(F.sum("part").cast("long").alias("taken"))
        .select("row", "doc_id", "size", "source_size", "target", "taken")
    )
    return plan, sized


def mixture(docs: DataFrame) -> DataFrame:
    """The documents with all their columns and size, source_size, target and taken, one row per row.

    Ids that are there and differ are the rows' keys; otherwise the table is written once with keys of its own.
    """
    names = ["size", "source_size", "target", "taken"]
    own = docs.select(*[c for c in docs.columns if c not in names])
    key = "__row"
    while key in own.columns:
        key += "_"
    keyed = own.withColumn(key, F.col("doc_id"))
    plan, sized = _mixed(keyed, F.col(key))
    clash = sized.groupBy("row").agg(F.count("*").alias("n")).where("n > 1 or row IS NULL")
    if not clash.isEmpty():
        keyed = written(own.withColumn(key, F.monotonically_increasing_id()), "keyed")
        plan, _ = _mixed(keyed, F.col(key))
    return keyed.join(plan.select(F.col("row").alias(key), *names), key).select(*own.columns, *names)


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


#: The same targets, and the words below the target on each source's shuffled line, in closed form.
ORACLE_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
    len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size
  FROM documents),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
numbered AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM sizes),
weighed AS (
  SELECT *, CASE sid % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
    2 * source_size::DOUBLE AS cap FROM numbered),
levels AS (
  SELECT *, (1.5 * sum(source_size::DOUBLE) OVER () - coalesce(sum(cap) OVER prior, 0))
      / (sum(weight) OVER () - coalesce(sum(weight) OVER prior, 0)) AS level,
    row_number() OVER (ORDER BY cap / weight, sid) AS nth
  FROM weighed WINDOW prior AS (ORDER BY cap / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
opened AS (
  SELECT *, level * weight >= cap AS capped,
    (SELECT min_by(level, nth) FROM levels WHERE level * weight < cap) AS open_level FROM levels),
targets AS (
  SELECT source, source_size, CASE WHEN capped THEN cap ELSE open_level * weight END AS target FROM opened),
lined AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS quota,
    coalesce(sum(d.size) OVER (PARTITION BY d.source
      ORDER BY md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS place
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(greatest(0, least(size, quota - place)) + greatest(0, least(size, quota - source_size - place)) AS BIGINT) AS taken
FROM lined
"""
