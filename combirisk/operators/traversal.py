"""Level-synchronous breadth-first kernels: betweenness, closeness, path lengths.

The sources of a block advance together.  Each level is one join of the frontier
with the edges, pre-aggregated per node, and is checkpointed so that lost executors
cost one level, not the whole walk.

Where only distances count, a node carries the sources that have reached it as bits
of long columns, and a level is one ``bit_or`` over the neighbours.  Where paths
count, too, a row holds a node and a group of 32 sources, one column of path counts
for each source, and a level is one ``sum`` of the columns over the neighbours.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from combirisk.operators.pairs import symmetric
from combirisk.session import cut_lineage

# Sources that walk together where paths are counted, sources in one of their rows, and 64-bit columns of sources where only distances are.
SOURCE_BLOCK = 2048
GROUP = 32
WORDS = 32


def first_sources(edges: DataFrame, k: int | None = 100) -> DataFrame:
    """The first k items by name as sources; ``None`` takes every item."""
    items = symmetric(edges.select("a", "b")).select(F.col("item").alias("source")).distinct()
    return items if k is None else items.orderBy("source").limit(k)


def walk_levels(neighbours: DataFrame, sources: DataFrame, max_depth: int | None = None) -> list[DataFrame]:
    """Frontiers (source, node, sigma) of level 0, 1, …; sigma counts shortest paths."""
    level = cut_lineage(sources.select("source", F.col("source").alias("node"), F.lit(1.0).alias("sigma")))
    levels = [level]
    reached = level.count()
    everything = reached * neighbours.select("item").distinct().count()
    while reached < everything and (max_depth is None or len(levels) <= max_depth):
        # Edges lead one level up, down or along, so only the last two levels can come again.
        seen = reduce(DataFrame.unionByName, [lv.select("source", "node") for lv in levels[-2:]])
        step = (
            level.join(neighbours.select(F.col("item").alias("node"), "other"), "node")
            .groupBy("source", F.col("other").alias("node"))
            .agg(F.sum("sigma").alias("sigma"))
            .join(seen, ["source", "node"], "left_anti")
        )
        level = cut_lineage(step)
        size = level.count()
        if size == 0:
            break
        levels.append(level)
        reached += size
    return levels


def distances(levels: list[DataFrame]) -> DataFrame:
    """(source, node, dist) of every reached pair, the source itself included."""
    parts = [lv.select("source", "node", F.lit(d).alias("dist")) for d, lv in enumerate(levels)]
    return reduce(DataFrame.unionByName, parts)


def _counts(text: str) -> list[str]:
    """One SQL expression for each source of a group: ``text`` with its number in place of ``#``."""
    return [f"{text.replace('#', str(k))} AS s{k}" for k in range(GROUP)]


def _spread(rows: DataFrame, links: DataFrame) -> DataFrame:
    """(group, node, s0, …): the columns of every row added up at the neighbours of its node."""
    return rows.join(links, "node").groupBy("group", F.col("other").alias("node")).agg(*[F.expr(c) for c in _counts("sum(s#)")])


def path_levels(links: DataFrame, sources: DataFrame, n_items: int) -> list[DataFrame]:
    """Frontiers (group, node, s0, …, bits) of level 0, 1, …: numbers of shortest paths from the sources of a group, and which of them arrive.

    ``links(node, other)`` hold both directions, ``sources(group, slot, node)`` up to ``GROUP`` sources a group.
    """
    level = cut_lineage(sources.selectExpr("group", "node", *_counts("double(slot = #)"), "shiftleft(1L, slot) AS bits"))
    levels = [level]
    reached = level.count()
    everything = reached * n_items
    arrived = " | ".join(f"if(s{k} > 0, {1 << k}L, 0L)" for k in range(GROUP))
    while reached < everything:
        # Edges lead one level up, down or along, so only the last two levels can come again.
        seen = reduce(DataFrame.unionByName, [lv.select("group", "node", "bits") for lv in levels[-2:]]).groupBy("group", "node").agg(F.bit_or("bits").alias("seen"))
        step = _spread(levels[-1].drop("bits"), links).join(seen, ["group", "node"], "left").fillna(0, ["seen"])
        fresh = step.selectExpr("group", "node", *_counts("if(seen & shiftleft(1L, #) = 0, s#, 0D)"))
        level = cut_lineage(fresh.selectExpr("*", f"{arrived} AS bits").filter("bits <> 0"))
        size = level.agg(F.sum(F.bit_count("bits"))).first()[0]
        if not size:
            break
        levels.append(level)
        reached += size
    return levels


def dependencies(links: DataFrame, sources: DataFrame, n_items: int) -> DataFrame | None:
    """(node, b): dependency sums over the sources of ``path_levels``; ``None`` if no source has a neighbour.

    With c the sum of (1 + delta) / sigma over the next level's neighbours, a node's
    delta is sigma * c and what it hands up is 1 / sigma + c.
    """
    levels = path_levels(links, sources, n_items)
    below = None
    scores = []
    for depth in range(len(levels) - 1, 0, -1):
        level = levels[depth].drop("bits")
        if below is None:
            level = level.selectExpr("*", *[f"0D AS c{k}" for k in range(GROUP)])
        else:
            came = below.selectExpr("group", "node", *[f"s{k} AS c{k}" for k in range(GROUP)])
            level = level.join(came, ["group", "node"], "left").fillna(0.0, [f"c{k}" for k in range(GROUP)])
        score = " + ".join(f"s{k} * c{k}" for k in range(GROUP)) + " AS delta"
        if depth == 1:
            scores.append(level.selectExpr("node", score))
            break
        level = cut_lineage(level.selectExpr("group", "node", score, *_counts("if(s# > 0, 1 / s# + c#, 0D)")))
        scores.append(level.select("node", "delta"))
        below = _spread(level.drop("delta"), links)
    if not scores:
        return None
    return reduce(DataFrame.unionByName, scores).groupBy("node").agg(F.sum("delta").alias("b"))


def betweenness(edges: DataFrame, sources: DataFrame, block: int = SOURCE_BLOCK, undefined: float = 0.0) -> DataFrame:
    """(item, betweenness): dependency sums over the sources, divided by the largest.

    Sources are walked in blocks of ``block``, so at most ``block / GROUP`` rows an item and level exist at a time.
    Where no path leads through any item (every pair is an edge), the share is 0 / 0 and all items get ``undefined``.
    """
    neighbours = cut_lineage(symmetric(edges.select("a", "b")))
    items = cut_lineage(neighbours.select("item").distinct())
    n_items = items.count()
    ids = cut_lineage(numbered(items, max(1, n_items // 1024)))
    one, two = (ids.select(F.col("item").alias(c), F.col("number").alias(n)) for c, n in (("item", "node"), ("other", "other_node")))
    links = cut_lineage(neighbours.join(one, "item").join(two, "other").select("node", F.col("other_node").alias("other")))
    starts = sources.select(F.col("source").alias("item")).distinct().join(ids, "item")
    n_sources = starts.count()
    walked = cut_lineage(numbered(starts.select(F.col("number").alias("item")), max(1, n_sources // 1024)).select(F.col("item").alias("node"), "number"))
    parts = []
    for start in range(0, n_sources, block):
        inside = walked.filter(F.col("number").between(start, start + block - 1))
        part = dependencies(links, inside.select("node", F.floor(F.col("number") / GROUP).alias("group"), F.pmod("number", F.lit(GROUP)).cast("int").alias("slot")), n_items)
        if part is not None:
            parts.append(cut_lineage(part) if n_sources > block else part)
    if not parts:
        return items.withColumn("betweenness", F.lit(undefined))
    total = parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("b").alias("b"))
    total = total.join(ids.withColumnRenamed("number", "node"), "node").select("item", "b")
    top = total.agg(F.max("b")).scalar()
    share = F.when(top > 0, F.coalesce("b", F.lit(0.0)) / F.nullif(top, F.lit(0.0))).otherwise(undefined)
    return items.join(total, "item", "left").select("item", share.alias("betweenness"))


def _bit_columns(word: Column, bit: Column, words: int) -> list[Column]:
    return [F.when(word == k, F.expr("shiftleft(1L, bit)")).otherwise(F.lit(0).cast("long")).alias(f"f{k}") for k in range(words)]


def numbered(items: DataFrame, buckets: int) -> DataFrame:
    """(item, number): distinct items numbered from 0, counted inside hash buckets that start where the ones before end."""
    dealt = items.select("item", F.pmod(F.xxhash64("item"), F.lit(buckets)).alias("bucket"))
    sizes = dealt.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    starts = sizes.select("bucket", (F.sum("n").over(Window.orderBy("bucket")) - F.col("n")).alias("start"))
    inside = F.row_number().over(Window.partitionBy("bucket").orderBy("item")) - 1
    return dealt.withColumn("inside", inside).join(starts, "bucket").select("item", (F.col("start") + F.col("inside")).alias("number"))


def distance_sums(edges: DataFrame, words: int = WORDS) -> DataFrame:
    """(item, total, reached, far): sum of distances, number of reached items with itself, and largest distance.

    Edges have no direction, so what a node learns about the sources that reach it
    is what the node as a source reaches.  A block has 64 sources in each of
    ``words`` long columns; a level joins the nodes whose frontier is not empty to
    their neighbours, partial ``bit_or`` shrinks a hub's incoming rows, and what was
    not seen before is counted at once.  One row an item exists at any time.
    """
    neighbours = cut_lineage(symmetric(edges.select("a", "b")))
    items = cut_lineage(neighbours.select("item").distinct())
    total = items.count()
    ranked = cut_lineage(numbered(items, max(1, total // 1024)))
    size = 64 * words
    seen, fresh = [f"s{k}" for k in range(words)], [f"f{k}" for k in range(words)]
    parts = []
    for start in range(0, total, size):
        inside = ranked.filter(F.col("number").between(start, start + size - 1)).withColumn("at", F.col("number") - start)
        inside = inside.select("item", F.floor(F.col("at") / 64).cast("int").alias("word"), F.pmod(F.col("at"), F.lit(64)).cast("int").alias("bit"))
        first = inside.select("item", *_bit_columns(F.col("word"), F.col("bit"), words))
        zero = F.lit(0).cast("long")
        state = ranked.select("item").join(first, "item", "left").fillna(0, fresh)
        own = sum(F.bit_count(c) for c in fresh)
        state = cut_lineage(state.select("item", *fresh, *[F.col(f).alias(s) for f, s in zip(fresh, seen)], zero.alias("total"), own.cast("long").alias("reached"), zero.alias("far")))
        depth = 0
        while True:
            depth += 1
            moving = reduce(lambda x, y: x | y, [F.col(f) != 0 for f in fresh])
            spread = state.filter(moving).select("item", *fresh).join(neighbours, "item").groupBy(F.col("other").alias("item")).agg(*[F.bit_or(f).alias(f"g{k}") for k, f in enumerate(fresh)])
            came = [F.coalesce(F.col(f"g{k}"), zero).bitwiseAND(F.bitwise_not(s)).alias(f"f{k}") for k, s in enumerate(seen)]
            met = state.drop(*fresh).join(spread, "item", "left").select("item", "total", "reached", "far", *seen, *came)
            news = sum(F.bit_count(f) for f in fresh).cast("long")
            kept = met.select(
                "item", *fresh, *[F.col(s).bitwiseOR(F.col(f)).alias(s) for s, f in zip(seen, fresh)],
                (F.col("total") + depth * news).alias("total"), (F.col("reached") + news).alias("reached"), F.when(news > 0, depth).otherwise(F.col("far")).cast("long").alias("far"),
            )
            state = cut_lineage(kept)
            if state.filter(F.col("far") == depth).isEmpty():
                break
        parts.append(state.select("item", "total", "reached", "far"))
    if not parts:
        return items.select("item", *[F.lit(0).cast("long").alias(c) for c in ("total", "reached", "far")])
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("item").agg(F.sum("total").alias("total"), F.sum("reached").alias("reached"), F.max("far").alias("far"))


def sums_of(reached: DataFrame) -> DataFrame:
    """What ``distance_sums`` gives, from (source, node, dist) rows of all sources."""
    return reached.groupBy(F.col("node").alias("item")).agg(F.sum("dist").alias("total"), F.count(F.lit(1)).alias("reached"), F.max("dist").alias("far"))


def closeness(sums: DataFrame, n: int) -> DataFrame:
    """(item, closeness) from ``distance_sums`` or rows of distances, scaled by the reached share."""
    sums = sums if "total" in sums.columns else sums_of(sums)
    r = F.col("reached") - 1
    value = F.when(F.col("total") > 0, r / F.col("total") * r / (n - 1)).otherwise(0.0)
    return sums.select("item", value.alias("closeness"))


def path_statistics(sums: DataFrame) -> DataFrame:
    """Diameter, mean length and number of ordered reachable pairs, from ``distance_sums`` or rows of distances."""
    sums = sums if "total" in sums.columns else sums_of(sums)
    pairs = F.sum(F.col("reached") - 1)
    return sums.agg(F.nullif(F.max("far"), F.lit(0)).alias("diameter"), F.round(F.try_divide(F.sum("total"), pairs), 6).alias("average_path_length"), F.coalesce(pairs, F.lit(0)).alias("pairs"))
