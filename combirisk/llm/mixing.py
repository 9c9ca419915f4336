"""Mixing sources to target weights along a time-varying curriculum, with DataFrame operations only.

Every source has a weight and a schedule: its rate of demand over training time t
in [0, 1], rate(t) = 1 + slope * (2t - 1), with slope in (-1, 1).  Its integral
C(t) = (1 - slope) * t + slope * t^2 runs from 0 to 1, so a source with target T
has demanded T * C(t) words by time t.  The copies of a source's documents lie end
to end on its word axis; a copy whose middle is at word c is placed at the time
that solves T * C(t) = c.  Sorting all copies by that time gives the training order.

Targets: sources share the whole size by weight, but none exceeds ``most`` times
its own size; what is left over is shared again by weight.  With the sources in
the order of cap / weight, the capped ones are a prefix, so one running sum gives
the exact solution without rounds.

A hot source is no hot task: word offsets inside a source are running sums inside
hash buckets, shifted by the running sums of the bucket totals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from combirisk.llm.common import table, text_key, word_count
from combirisk.session import cut_lineage

# Documents that one bucket of a source should hold; buckets only bound a window's rows.
BUCKET_DOCS = 4096


def source_weights(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Add weight and slope to ``sources(source, ...)``: weights repeat in code point order, null last.

    The slopes alternate, too: the lightest sources fade out, the heaviest fade in.
    """
    # Byte order of UTF-8 is code point order.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    pick = lambda values: F.array(*[F.lit(v) for v in values])[place % len(values)]
    half = (len(weights) - 1) / 2
    slopes = [(i - half) / (len(weights) + 1) * 2 for i in range(len(weights))]
    return sources.withColumn("weight", pick([float(w) for w in weights])).withColumn("slope", pick(slopes))


def source_targets(sources: DataFrame, most: float = 3.0) -> DataFrame:
    """Add target to ``sources(source, source_size, weight)``; one row a source.

    The level L solves sum(min(most * size, L * weight)) = sum(size); a source's
    target is min(most * size, L * weight).  Empty sources have target 0.
    """
    ordered = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    everything = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * F.lit(float(most))
    shaped = sources.withColumn("cap", cap).withColumn("ratio", F.col("cap") / F.col("weight"))
    sums = shaped.select(
        "*",
        F.sum("source_size").over(everything).alias("total"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))).alias("weight_left"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("cap_before"),
    )
    # The level if exactly the sources before this one are capped; the first that its own cap admits is the level.
    level = sums.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    found = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return level.withColumn("target", F.least("cap", F.col("weight") * F.coalesce(found, F.col("ratio")))).select(*sources.columns, "target")


def _offsets(sized: DataFrame) -> DataFrame:
    """Add ``offset``: the words of a source before this document, in the order of a hash of the document."""
    per_source = sized.groupBy("source").agg(F.count(F.lit(1)).alias("docs"))
    buckets = F.greatest(F.lit(1), F.ceil(F.col("docs") / BUCKET_DOCS)).cast("long")
    # The hash range is cut evenly, so buckets keep the order of the hash.
    spread = F.col("draw") / F.lit(float(1 << 48))
    per_source = per_source.withColumn("buckets", buckets).drop("docs").withColumnRenamed("source", "_source")
    dealt = sized.join(per_source, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    dealt = cut_lineage(dealt.withColumn("bucket", F.floor(spread * F.col("buckets")).cast("long")).drop("buckets"))
    totals = dealt.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), F.coalesce(F.sum("bucket_size").over(running), F.lit(0)).alias("start"))
    inside = Window.partitionBy("source", "bucket").orderBy("draw", F.col("doc_id").asc_nulls_first(), "key", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = local.join(starts, F.col("source").eqNullSafe(F.col("_source")) & (F.col("bucket") == F.col("_bucket")))
    return placed.withColumn("offset", F.col("start") + F.col("inside")).drop("_source", "_bucket", "start", "inside", "bucket")


def _time_at(share: Column, slope: Column) -> Column:
    """Inverse of C(t) = (1 - slope) t + slope t^2 on [0, 1], in the form without cancellation."""
    linear = 1 - slope
    root = F.sqrt(linear * linear + 4 * slope * share)
    return F.coalesce(F.try_divide(2 * share, linear + root), F.lit(0.0))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """Plan of the mix, one row for every row of ``docs(doc_id, text, source)``.

    Returns doc_id, key, source, size, source_size, target, copies and positions
    (training time of each copy, in [0, 1]).  A source goes through its documents
    whole-pass after whole-pass in one fixed order; the last pass takes the
    documents whose middle lies before the target.  Documents without words are
    taken once with their first pass and add nothing.  Null texts have size 0,
    null sources are a source of their own.  An empty table gives no row.
    """
    sized = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        "source",
        word_count("text").alias("size"),
        text_key("text").alias("key"),
        # 48 bits of an md5, which any engine repeats.
        F.conv(F.substring(F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("mix")).cast("binary")), 1, 12), 16, 10).cast("long").alias("draw"),
    )
    sized = cut_lineage(sized)
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = cut_lineage(source_targets(source_weights(sources, weights), most)).withColumnRenamed("source", "_source")
    placed = _offsets(sized).join(sources, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    middle = F.col("offset") + F.col("size") / 2
    # Pass p takes a document when p * source_size + middle <= target.
    wanted = F.floor(F.try_divide(F.col("target") - middle, F.col("source_size"))) + 1
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.least(F.greatest(wanted, F.lit(0)), F.lit(int(most)))).cast("int")
    share = lambda p: F.least(F.try_divide(p * F.col("source_size") + middle, F.col("target")), F.lit(1.0))
    at = lambda p: F.when(F.col("target") > 0, _time_at(share(p), F.col("slope"))).otherwise(F.lit(0.0))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), at)).otherwise(F.array().cast("array<double>"))
    return placed.withColumn("copies", copies).withColumn("positions", positions).select("doc_id", "key", "source", "size", "source_size", "target", "copies", "positions")


def training_order(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """The documents as training reads them: one row per copy, range-sorted by position.

    Adds ``copy`` and ``position`` to the columns of ``docs`` (and replaces columns
    of these names); documents that the mix does not take are absent.
    """
    plan = mix(docs, weights, most)
    same = Window.partitionBy("_doc", "_key", "_source")
    plan = plan.select(F.col("doc_id").alias("_doc"), F.col("key").alias("_key"), F.col("source").alias("_source"), "positions")
    plan = plan.withColumn("_n", F.row_number().over(same.orderBy("positions"))).where(F.size("positions") > 0)
    # Rows equal in id, text and source share their copies in the order of their other columns.
    # The row travels as one struct, so no column of it can clash.
    keyed = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("_doc"), text_key("text").alias("_key"), F.col("source").alias("_source"))
    keyed = keyed.withColumn("_n", F.row_number().over(same.orderBy("row")))
    joined = keyed.alias("d").join(
        plan.alias("p"),
        F.col("d._doc").eqNullSafe(F.col("p._doc")) & (F.col("d._key") == F.col("p._key")) & F.col("d._source").eqNullSafe(F.col("p._source")) & (F.col("d._n") == F.col("p._n")),
    )
    copies = joined.select("d.row", F.col("d._doc").alias("_doc"), F.posexplode("p.positions").alias("_copy", "_position"))
    ordered = copies.repartitionByRange("_position", "_doc", "_copy").sortWithinPartitions("_position", "_doc", "_copy")
    kept = [F.col(f"row.`{c}`") for c in docs.columns if c not in ("copy", "position")]
    return ordered.select(*kept, F.col("_copy").alias("copy"), F.col("_position").alias("position"))


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    plan = mix(table(spark, sf_dir, "documents"))
    columns = ["doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", F.try_element_at("positions", F.lit(1)).alias("first_position")]
    return plan.select(*columns).repartitionByRange("first_position", "doc_id").sortWithinPartitions("first_position", "doc_id")


# The same mix over any relation ``docs(doc_id, text, source)``.
MIX_SQL = r"""
sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || 'mix'), 1, 12))::bigint as draw
  from docs),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (select *, (row_number() over (order by source nulls last) - 1) % 3 as place from sources),
shaped as (select *, (place + 1)::double as weight, (place - 1.0::double) / 4 * 2 as slope, source_size * 3.0::double as cap from weighed),
summed as (
  select *, cap / weight as ratio, sum(source_size) over () as total,
         (sum(weight) over ()) - coalesce(sum(weight) over w, 0.0) as weight_left, coalesce(sum(cap) over w, 0.0) as cap_before
  from shaped window w as (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding)),
levels as (select *, (total - cap_before) / weight_left as level from summed),
targets as (
  select source, source_size, slope,
         least(cap, weight * coalesce((select first(level order by ratio, level) from levels where level <= ratio), ratio)) as target
  from levels),
placed as (
  select s.*, t.source_size, t.target, t.slope,
         coalesce(sum(s.size) over (partition by s.source order by s.draw, s.doc_id nulls first rows between unbounded preceding and 1 preceding), 0) + s.size / 2 as middle
  from sized s join targets t on s.source is not distinct from t.source),
plan as (
  select *, case when size = 0 then 1 else least(greatest(floor((target - middle) / nullif(source_size, 0)) + 1, 0), 3) end::int as copies,
         case when target > 0 then least(middle / target, 1.0) else 0.0 end as share
  from placed)
"""

OP8_SQL = (
    "with docs as (select * from documents)," + MIX_SQL + """
select doc_id, size, source_size, target, size * copies as taken, copies,
       case when copies > 0 then case when target > 0 then coalesce(2 * share / nullif((1 - slope) + sqrt((1 - slope) * (1 - slope) + 4 * slope * share), 0), 0.0) else 0.0 end end as first_position
from plan
"""
)
