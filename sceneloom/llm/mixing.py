"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source has a target, a number of words. The documents of a source stand in a seeded random
order, end to end, and the mix takes those that the first `target` words of that line hold whole, starting over at its
end where the target is more than the source. The gap that this leaves is filled by FILLERS more documents at most, of the rest of the
line: the largest that fits, again and again, and at last the one that comes nearest, if that is better than none. So documents are only ever taken whole. The words taken are cut into blocks of equal
length; the number of a source's blocks is its exact quota. A binary tree splits the quotas among
the output shards: at each node the quota units are permuted, and the first half of them goes
left. Which sources that half holds is one draw from the multivariate hypergeometric
distribution. A leaf is a shard: it gets, of each source, a run of blocks that no other shard has,
and shuffles what it draws locally.

DataFrame functions only. The plan is made of ids and sizes; texts are moved once, when the rows of the mix are
put together. Quota units number QUOTA_UNITS plus one a source at most; all that
grows with the documents stays distributed, and no source is ever gathered in one task. Sources, a row each, are weighed in one
task: MOST_SOURCES at most, more are an error.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from .common import checkpointed, free_name, if_few, n_words_of

#: No source is taken more often than this.
MOST_REPEATS = 3
#: Blocks in the whole mix, about. It bounds the quota table, whatever the input is.
QUOTA_UNITS = 2048
#: So many documents at most fill what a source's whole documents leave of its target.
FILLERS = 4
#: A row of some 60 bytes each, in one task.
MOST_SOURCES = 1_000_000
#: Lines and shards are laid out in pieces of about so many rows, each sorted on its own. They don't change the result.
PIECE_ROWS = 5_000


def source_targets(by_source: DataFrame, weights: Sequence[int] = (5, 2, 1)) -> DataFrame:
    """From rows (source, source_size) the same with target (double), the words to take.

    Sources in code point order, null last, weigh as in weights, repeating. All targets sum to all
    sizes. No target is above MOST_REPEATS times its source; what is over is shared among the others
    by weight, until none is above. So a target is min(MOST_REPEATS * size, level * weight), and
    the level follows from the sources in the order in which they reach their cap.
    """
    by_code_point = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_code_point) - 1, F.lit(len(weights))) + 1
    weighed = by_source.select("source", "source_size", F.element_at(F.array(*map(F.lit, weights)), place.cast("int")).cast("double").alias("weight"))
    weighed = weighed.withColumn("cap", F.col("source_size").cast("double") * MOST_REPEATS)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    ranked = weighed.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("total"),
        (F.sum("weight").over(everything) - F.sum("weight").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) + F.col("weight")).alias("weight_left"),
        (F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap")).alias("capped"),
    )
    # The level if all sources before this one are capped; the first for which this one stays below its cap holds.
    level = (F.col("total") - F.col("capped")) / F.col("weight_left")
    ranked = ranked.withColumn("level", F.when(level * F.col("weight") <= F.col("cap"), level))
    ranked = ranked.withColumn("level", F.first("level", ignorenulls=True).over(by_cap.rowsBetween(Window.unboundedPreceding, 0)))
    return ranked.select("source", "source_size", F.least(F.coalesce(F.col("level") * F.col("weight"), F.col("cap")), F.col("cap")).alias("target"))


def with_quotas(targets: DataFrame, units: int = QUOTA_UNITS) -> DataFrame:
    """targets with quota, a source's number of blocks, and block_words, the length of one.

    A quota is the source's share of the units, rounded, at least 1 if anything of the source is taken.
    """
    share = F.col("target") * units / F.sum("target").over(Window.partitionBy())
    quota = F.when(F.col("target") > 0, F.greatest(F.lit(1), F.round(share))).otherwise(0).cast("int")
    return targets.withColumn("quota", quota).withColumn("block_words", F.when(F.col("quota") > 0, F.col("target") / F.col("quota")))


def quota_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """Rows (source, block, shard): which shard draws which block of each source's line."""
    # A node holds the shards from low to high - 1. Those of one shard split no more.
    units = F.explode(F.sequence(F.lit(0), F.col("quota") - 1)).alias("unit")
    node = quotas.filter("quota > 0").select("source", units, F.lit(0).alias("low"), F.lit(shards).alias("high"))
    for level in range(max(0, shards - 1).bit_length()):
        there = Window.partitionBy("low", "high")
        drawn = F.row_number().over(there.orderBy(F.xxhash64(F.lit(seed), F.lit(level), "source", "unit"), "source", "unit"))
        half, width = F.floor((F.col("low") + F.col("high")) / 2).cast("int"), F.col("high") - F.col("low")
        goes_left = drawn <= F.floor(F.count(F.lit(1)).over(there) * (half - F.col("low")) / width)
        node = node.select("source", "unit", "low", "high", half.alias("half"), goes_left.alias("left"))
        low, high = F.when(F.col("left"), F.col("low")).otherwise(F.col("half")), F.when(F.col("left"), F.col("half")).otherwise(F.col("high"))
        node = node.select("source", "unit", F.when(width > 1, low).otherwise(F.col("low")).alias("low"), F.when(width > 1, high).otherwise(F.col("high")).alias("high"))
    block = F.row_number().over(Window.partitionBy("source").orderBy("low", "unit")) - 1
    return node.select("source", block.alias("block"), F.col("low").alias("shard"))


def bits_of(rows: int) -> int:
    """Bits that number pieces of PIECE_ROWS."""
    return max(1, (rows // PIECE_ROWS).bit_length())


def keys_of(seed: int, id_column: str, text_column: str, source_column: str) -> list:
    """The columns doc_id, key, source and same, a hash of all three, in which a null is not the same as nothing."""
    doc_id, text, source = F.col(id_column), F.col(text_column), F.col(source_column)
    key = F.xxhash64(F.lit(seed), doc_id, text)
    return [doc_id.alias("doc_id"), key.alias("key"), source.alias("source"), F.xxhash64(doc_id, doc_id.isNull(), text, text.isNull(), source, source.isNull()).alias("same")]


def copy_number() -> F.Column:
    """Tells rows of one id, text and source apart, which are all alike to the mix."""
    return F.row_number().over(Window.partitionBy("same").orderBy("doc_id", "source", "key"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), seed: int = 23, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> tuple[DataFrame, DataFrame, int]:
    """What the mix takes of each document, the targets and quotas of the sources, and the number of rows.

    The first table has doc_id, key, same, copy, source and size, and source_size, target,
    block_words, line_start (where the document's words begin in its source's line), whole (how often the line takes it), fills (where in the gap at the line's end it stands, null if it doesn't) and taken, the
    words of it that the mix takes, repeats counted: a whole number of times its size. The sum of taken over a source is its target,
    but for what no document fills. The order of the line depends on the seed, the id and the text; rows equal in both share
    their places. A null or empty text has no words and is never taken. A null source is one like
    others. An empty table gives empty tables.
    """
    rows = docs.select(*keys_of(seed, id_column, text_column, source_column), n_words_of(F.col(text_column)).alias("size"))
    rows = checkpointed(rows.withColumn("copy", copy_number()))
    n_rows = rows.count()
    piece = F.shiftrightunsigned("key", 64 - bits_of(n_rows)).cast("int")
    # A null source has a partition and a join key too.
    rows = rows.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), piece.alias("piece"), "doc_id", "key", "same", "copy", "size")
    by_source = Window.partitionBy("name", "unnamed")
    pieces = rows.groupBy("name", "unnamed", "piece").agg(F.sum("size").alias("words"))
    pieces = pieces.select("*", (F.sum("words").over(by_source.orderBy("piece")) - F.col("words")).alias("piece_start"))
    targets = pieces.groupBy("name", "unnamed").agg(F.sum("words").alias("source_size"))
    targets = targets.select(F.when(~F.col("unnamed"), F.col("name")).alias("source"), "source_size")
    targets = checkpointed(targets)
    if (n_sources := targets.count()) > MOST_SOURCES:
        raise ValueError(f"{n_sources} sources, more than {MOST_SOURCES}")
    targets = checkpointed(with_quotas(source_targets(targets, weights)))
    named = targets.select(F.coalesce("source", F.lit("")).alias("name"), F.col("source").isNull().alias("unnamed"), "*")
    pieces = pieces.drop("words").join(named, ["name", "unnamed"])

    rows = rows.join(pieces, ["name", "unnamed", "piece"])
    order = Window.partitionBy("name", "unnamed", "piece").orderBy("key", "doc_id", "copy").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("line_start", F.col("piece_start") + F.sum("size").over(order) - F.col("size"))
    wanted = F.round("target").cast("long")
    times = F.when(F.col("source_size") > 0, F.floor(wanted / F.col("source_size"))).otherwise(0).cast("int")
    rest = wanted - times * F.col("source_size")
    inside = F.col("line_start") + F.col("size") <= rest
    rows = checkpointed(rows.withColumns({"times": times, "inside": inside, "rest": rest}))
    # The gap that the whole documents leave at each source's end, and the documents that fill it.
    by = ["name", "unnamed"]
    ends = rows.groupBy(*by).agg(F.max(F.when(F.col("inside"), F.col("line_start") + F.col("size"))).alias("filled"), F.max("rest").alias("goal"))
    ends = checkpointed(ends.withColumn("filled", F.coalesce("filled", F.lit(0).cast("long"))))
    spare = rows.filter("not inside and size > 0").select(*by, "size", "key", "doc_id", "same", "copy")
    fillers = None
    for turn in range(FILLERS):
        off, gap = F.abs(F.col("size") - F.col("gap")), F.col("goal") - F.col("filled")
        fits = (off < F.col("gap")) if turn == FILLERS - 1 else (F.col("size") <= F.col("gap"))
        left = spare if fillers is None else spare.join(if_few(fillers.select("same", "copy")), ["same", "copy"], "left_anti")
        best = left.join(if_few(ends.select(*by, gap.alias("gap"))), by).filter(fits).groupBy(*by).agg(F.min(F.struct(off.alias("off"), "size", "key", "doc_id", "same", "copy")).alias("best"))
        ends = checkpointed(ends.join(best, by, "left").select(*by, "goal", F.coalesce("best.size", F.lit(0).cast("long")).alias("more"), "filled", "best.same", "best.copy"))
        found = ends.filter("more > 0").select("same", "copy", F.col("filled").alias("fills"))
        fillers = checkpointed(found if fillers is None else fillers.unionByName(found))
        ends = ends.select(*by, "goal", (F.col("filled") + F.col("more")).alias("filled"))
    rows = rows.join(if_few(fillers), ["same", "copy"], "left")
    whole = F.col("times") + F.col("inside").cast("int")
    taken = F.col("size") * (whole + F.col("fills").isNotNull().cast("int"))
    planned = rows.select("doc_id", "key", "same", "copy", "source", "size", "source_size", "target", "block_words", "line_start", whole.alias("whole"), "fills", "times", taken.alias("taken"))
    return checkpointed(planned), targets, n_rows


def drawn(planned: DataFrame, quotas: DataFrame, n_rows: int, shards: int, seed: int) -> DataFrame:
    """Rows (doc_id, same, copy, source, size, line_start, epoch, to, slot), one for each time a document is drawn.

    The document goes to the output shard `to`, where slot is the number of the row in the shard's random order.
    A shard is ordered in pieces, so that none is sorted in one task; where a piece begins follows from the sizes of
    those before it. Documents that are not taken have no row here. One that fills a gap stands where the gap begins.
    """
    takes = planned.filter("taken > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("whole") + F.col("fills").isNotNull().cast("int") - 1)).alias("epoch"))
    begin = F.when(F.col("epoch") < F.col("whole"), F.col("epoch") * F.col("source_size") + F.col("line_start")).otherwise(F.col("times") * F.col("source_size") + F.col("fills"))
    takes = takes.withColumn("block", F.floor(begin / F.col("block_words")).cast("int"))
    draws = quota_tree(quotas, shards, seed).select(F.col("source").alias("from"), F.col("block").alias("drawn"), F.col("shard").alias("to"))
    takes = takes.join(if_few(checkpointed(draws)), F.col("source").eqNullSafe(F.col("from")) & (F.col("block") == F.col("drawn")))
    local = F.xxhash64(F.lit(seed), F.lit("local"), "epoch", "doc_id", "line_start")
    bits = bits_of(MOST_REPEATS * n_rows // shards)
    takes = takes.select("doc_id", "same", "copy", "source", "size", "line_start", "epoch", "to", local.alias("local"), F.shiftright(local, 64 - bits).cast("int").alias("piece"))
    takes = checkpointed(takes)
    starts = takes.groupBy("to", "piece").count()
    starts = starts.select("to", "piece", (F.sum("count").over(Window.partitionBy("to").orderBy("piece")) - F.col("count")).alias("start"))
    order = Window.partitionBy("to", "piece").orderBy("local", "epoch", "source", "line_start")
    takes = takes.withColumn("place", F.row_number().over(order)).join(if_few(checkpointed(starts)), ["to", "piece"])  # a row for PIECE_ROWS rows, or a shard
    return takes.withColumn("slot", F.col("start") + F.col("place") - 1).drop("piece", "local", "place", "start")


def mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), shards: int = 32, seed: int = 23, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mix: the columns of docs, with mix_shard and mix_slot, one row for each time a document is taken.

    Texts are whole. mix_slot
    numbers a shard's rows, from 0, in their local random order. Shards hold about as many words each.
    Columns of docs stay apart from those of the plan, so no name can clash.
    """
    planned, quotas, n_rows = plan_mix(docs, weights, seed, id_column, text_column, source_column)
    takes = drawn(planned, quotas, n_rows, shards, seed)
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("row"), *keys_of(seed, id_column, text_column, source_column))
    wanted = takes.select("same", "to", "slot", F.col("copy").alias("_copy"))
    if planned.agg(F.max("copy")).first()[0] == 1:  # as a rule; then texts are moved once
        found = rows.join(wanted, "same")
    else:
        found = rows.withColumn("copy", copy_number()).join(wanted.withColumnRenamed("same", "_same"), (F.col("same") == F.col("_same")) & (F.col("copy") == F.col("_copy")))
    columns = [F.col(f"row.{c}").alias(c) for c in docs.columns]
    return found.select(*columns, F.col("to").alias(free_name(docs, "mix_shard")), F.col("slot").alias(free_name(docs, "mix_slot")))


def mixed_words(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), shards: int = 32, seed: int = 23, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken, source, places), one for each row of docs, of what mix() draws.

    taken is the sum of the words that the leaves of the tree draw of the document, a whole number of times its size, 0 if none draws it. places lists
    the shard and the slot of each draw, as in `3:17,20:4`; it is empty if there are none.
    """
    planned, quotas, n_rows = plan_mix(docs, weights, seed, id_column, text_column, source_column)
    draw = F.struct("epoch", F.concat_ws(":", "to", "slot").alias("place"))
    found = drawn(planned, quotas, n_rows, shards, seed).groupBy("same", "copy").agg(F.sum("size").alias("n"), F.array_join(F.array_sort(F.collect_list(draw))["place"], ",").alias("places"))
    return planned.join(found, ["same", "copy"], "left").select("doc_id", "size", "source_size", "target", F.coalesce("n", F.lit(0).cast("long")).alias("taken"), "source", F.coalesce("places", F.lit("")).alias("places"))
