"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

1. ``targets``: sources share the corpus by weight; a target stops at ``max_repeat``
   times its source's size and the excess is shared again, in closed form.
2. ``apportion``: ``n_blocks`` blocks of equal size go to the highest quotients
   ``target / (2 q + 1)``: integer quotas, also for each output shard, since the
   ranked blocks are dealt to the shards in turn.
3. ``select_blocks``: a source's documents lie on a line in seeded order, cut into
   blocks; whole passes over the line first, then blocks in another seeded order.  A
   source whose quota is more than ``NEAR`` below its target, since it is small beside a
   block, takes its target: its last block is a partial one.
4. ``mix``: what each document gives: passes times its size plus its overlap with
   the chosen blocks, by two prefix lookups; no document is compared to another.
5. ``copies``: whole documents.  Each is repeated once a pass; the rest of a source's
   words is filled by the documents at the start of its line, up to the end nearest to it.
   A source's copied words miss its taken words by half a document at most.

The line is laid by two-level prefix sums (``2 ** 12`` slices a source), so that a
source with a third of all rows is spread over as many tasks.  Tables of sources and
blocks have at most ``n_blocks`` plus the number of sources rows.

Defined results: null text has size 0 and gives nothing; null sources form one source,
last in order; repeated rows each give their part; if nothing has a word, all targets
are 0.  Columns of the input that bear the name of a result are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm.common import stored, words

RESULTS = ("size", "source_size", "target", "taken", "copies")
N_BLOCKS = 32_768
MAX_REPEAT = 3
NEAR = 0.01
SLICE_HEX = 3


def targets(sizes: DataFrame, max_repeat: int = MAX_REPEAT, n_blocks: int = N_BLOCKS) -> DataFrame:
    """(source, source_size) with src (rank from 1), weight, cap, target, and the words of a block.

    Its windows hold one row for each source.
    """
    ranked = sizes.withColumn("src", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("weight", (F.col("src") - 1) % 3 + 1).withColumn("cap", max_repeat * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap") / F.col("weight")).asc(), "src")
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(rest)
    levelled = ranked.withColumn("level", level).withColumn("free", F.col("cap") >= F.col("weight") * F.col("level"))
    first = F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, 0))
    return levelled.withColumn("first", first).select(
        "src", "source", "source_size", "weight", "cap", F.coalesce(F.col("weight") * F.col("first"), F.col("cap").cast("double")).alias("target"),
        F.sum("source_size").over(everything).alias("total"),
        F.greatest(F.ceil(F.sum("source_size").over(everything) / n_blocks), F.lit(1).cast("long")).alias("block"),
    )


def apportion(sources: DataFrame, n_shards: int = 1) -> DataFrame:
    """Quotas: (shard, src, n_blocks).  At most twice as many quotients as blocks, and 2 a source."""
    sized = sources.withColumn("seats", F.ceil(F.col("total") / F.col("block"))).where("target > 0")
    most = F.ceil(2 * F.col("target") / F.col("block")) + 1
    quotients = sized.select("src", "seats", "target", F.explode(F.sequence(F.lit(0).cast("long"), most)).alias("q"))
    place = F.row_number().over(Window.orderBy((F.col("target") / (2 * F.col("q") + 1)).desc(), "src"))
    won = quotients.withColumn("place", place).where("place <= seats")
    return won.groupBy(((F.col("place") - 1) % n_shards).alias("shard"), "src").agg(F.count("*").alias("n_blocks"))


def select_blocks(sources: DataFrame, quotas: DataFrame, seed: int) -> DataFrame:
    """(src, b, before, take, passes, rest): words taken of each block of a line, and beyond whole passes."""
    won = quotas.groupBy("src").agg(F.sum("n_blocks").alias("won"))
    lines = (
        sources.where("source_size > 0")
        .join(won, "src", "left")
        .withColumn("words", F.least(F.coalesce("won", F.lit(0)) * F.col("block"), F.ceil("target"), F.col("cap")))
        .withColumn("words", F.when(F.col("words") < (1 - NEAR) * F.col("target"), F.least(F.ceil("target"), F.col("cap"))).otherwise(F.col("words")))
        .withColumn("passes", F.floor(F.col("words") / F.col("source_size")))
        .withColumn("rest", F.col("words") - F.col("passes") * F.col("source_size"))
    )
    each = lines.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("source_size") - 1) / F.col("block")))))
    each = each.withColumn("length", F.least(F.col("block"), F.col("source_size") - F.col("b") * F.col("block")))
    drawn = Window.partitionBy("src").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "src", "b").cast("binary")), "b")
    left = F.col("rest") - F.coalesce(F.sum("length").over(drawn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.withColumn("take", F.greatest(F.least(F.col("length"), left), F.lit(0).cast("long")))
    upto = Window.partitionBy("src").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    return each.withColumn("before", F.coalesce(F.sum("take").over(upto), F.lit(0).cast("long"))).select("src", "b", "before", "take", "passes", "rest")


def mix(docs: DataFrame, seed: int = 7, n_blocks: int = N_BLOCKS) -> DataFrame:
    """``docs`` (doc_id, source, text and any others) with size, source_size, target, taken, copies."""
    return _mix(docs, [c for c in docs.columns if c not in RESULTS], seed, n_blocks)


def mix_sizes(docs: DataFrame, seed: int = 7, n_blocks: int = N_BLOCKS) -> DataFrame:
    """``mix`` without any column but doc_id and source: no text is moved."""
    return _mix(docs, ["doc_id", "source"], seed, n_blocks)


def _mix(docs: DataFrame, rest: list[str], seed: int, n_blocks: int) -> DataFrame:
    key = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary"))
    sized = stored(docs.select(*rest, F.size(words(F.col("text"))).cast("long").alias("size"), key.alias("_h")), "mix")
    sources = stored(targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), n_blocks=n_blocks), "sources")
    blocks = stored(select_blocks(sources, apportion(sources), seed), "blocks")
    joined = sized.alias("d").join(
        sources.select(F.col("source").alias("_source"), "src", "source_size", "target", "block").alias("s"),
        F.col("d.source").eqNullSafe(F.col("_source")), "left",
    ).drop("_source").withColumn("_slice", F.substring("_h", 1, SLICE_HEX))
    slices = joined.groupBy("src", "_slice").agg(F.sum("size").alias("_n"))
    offset = F.coalesce(F.sum("_n").over(Window.partitionBy("src").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    slices = slices.select("src", "_slice", offset.alias("_offset"))
    inside = Window.partitionBy("src", "_slice").orderBy("_h", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = joined.join(slices, ["src", "_slice"]).withColumn("_end", F.col("_offset") + F.sum("size").over(inside))
    placed = placed.withColumn("_start", F.col("_end") - F.col("size"))
    for at in ("start", "end"):
        found = blocks.select(
            F.col("src").alias("_src"), F.col("b").alias("_b"), F.col("before").alias("_before"), F.col("take").alias("_take"),
            *([F.col("passes").alias("_passes"), F.col("rest").alias("_rest")] if at == "start" else []),
        )
        # a document that ends with its line ends in its last block
        x = F.col(f"_{at}")
        b = F.floor((x if at == "start" else F.greatest(x - 1, F.lit(0).cast("long"))) / F.col("block"))
        placed = placed.withColumn("_at", b)
        placed = placed.join(found, (F.col("src") == F.col("_src")) & (F.col("_at") == F.col("_b")), "left")
        placed = placed.withColumn(f"_f_{at}", F.col("_before") + F.least(F.col("_take"), x - F.col("_b") * F.col("block")))
        placed = placed.drop("_src", "_b", "_before", "_take", "_at")
    taken = F.when(F.col("size") > 0, F.col("_passes") * F.col("size") + F.col("_f_end") - F.col("_f_start")).otherwise(0)
    # the end of a line's documents that is nearest to the rest is that of the last one with half its words before it
    times = F.when(F.col("size") > 0, F.col("_passes") + (2 * F.col("_start") + F.col("size") <= 2 * F.col("_rest")).cast("long")).otherwise(0)
    return placed.select(*rest, "size", "source_size", "target", taken.cast("long").alias("taken"), times.cast("int").alias("copies"))


def copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus in whole documents: a source's words are those taken of it, to half a document."""
    return mixed.where("copies > 0").select(*columns, F.explode(F.array_repeat(F.lit(1), F.col("copies"))).alias("_n")).drop("_n")
