"""As-of and interval lookups: sequences of a position, move structures, balancing.

An as-of join is a union sorted by place, in which every query takes the last start seen:
one shuffle by the group, no range join.  Groups are documents or other keys of moderate
size; a single global order is cut in slices of ``SLICE`` places, whose last starts are
carried over by a join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICE = 1 << 20


def as_of(queries: DataFrame, starts: DataFrame, at: str, start: str, payload: list[str]) -> DataFrame:
    """Each query row with the payload (and start) of the largest start at most its ``at``; null if none.

    Places are longs; within a slice the last start comes by a window, and slices without a
    start of their own take that of the slices before, a row for each slice.
    """
    value = F.struct(F.col(start).alias("_start"), *payload)
    firsts = starts.select(F.col(start).alias("_at"), F.lit(0).alias("_kind"), value.alias("_value"), *(F.lit(None).cast(queries.schema[c].dataType).alias(c) for c in queries.columns))
    asks = queries.select(F.col(at).alias("_at"), F.lit(1).alias("_kind"), F.lit(None).cast(firsts.schema["_value"].dataType).alias("_value"), *queries.columns)
    rows = firsts.union(asks).withColumn("_slice", F.floor(F.col("_at") / SLICE))
    order = Window.partitionBy("_slice").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_seen", F.last("_value", ignorenulls=True).over(order))
    last = starts.select(F.floor(F.col(start) / SLICE).alias("_slice"), value.alias("_value")).groupBy("_slice").agg(F.max("_value").alias("_value"))
    slices = rows.select("_slice").distinct().join(last, "_slice", "left")
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = slices.select("_slice", F.last("_value", ignorenulls=True).over(before).alias("_carried"))
    rows = rows.where("_kind = 1").join(carried, "_slice").withColumn("_found", F.coalesce("_seen", "_carried"))
    return rows.select(*queries.columns, F.col("_found._start").alias(start), *(F.col(f"_found.{c}").alias(c) for c in payload))


#: How a start must lie to a place: sign of both, and what is added to the place.
RELATIONS = {"max<=": (1, 0), "max<": (1, -1), "min>=": (-1, 0), "min>": (-1, 1)}


def nearest(queries: DataFrame, starts: DataFrame, at: str, start: str, relation: str, name: str) -> DataFrame:
    """Each query row with, as ``name``, the largest start at most or below its ``at``, or the smallest
    at least or above it; null if none.  Places are longs: a strict bound is the next place, and
    the smallest above is the largest below with signs turned."""
    sign, more = RELATIONS[relation]
    asked = queries.withColumn("_turned", sign * (F.col(at) + more))
    found = as_of(asked, starts.select((sign * F.col(start)).alias("_start_")).distinct(), "_turned", "_start_", [])
    return found.select(*queries.columns, (sign * F.col("_start_")).alias(name))


def collection(texts: DataFrame) -> DataFrame:
    """(seq_id, start, length): where each text would begin were all joined, a separator before each.

    Lengths are summed in two levels: per slice of 4096 ids, then within slices.
    """
    rows = texts.select(F.col("doc_id").alias("seq_id"), F.char_length("text").cast("long").alias("length")).withColumn("_slice", F.floor(F.col("seq_id") / 4096))
    sums = rows.groupBy("_slice").agg(F.sum(F.col("length") + 1).alias("_n"))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy("_slice").orderBy("seq_id").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("_base") + 1 + F.coalesce(F.sum(F.col("length") + 1).over(inside), F.lit(0))
    return rows.join(sums, "_slice").select("seq_id", start.cast("long").alias("start"), "length")


def sequence_of(positions: DataFrame, sequences: DataFrame, at: str = "pos") -> DataFrame:
    """Positions with seq_id and local position; null where they are on a separator."""
    found = as_of(positions, sequences, at, "start", ["seq_id", "length"])
    local = F.col(at) - F.col("start")
    inside = local < F.col("length")
    return found.select(*positions.columns, F.when(inside, F.col("seq_id")).alias("seq_id"), F.when(inside, local).alias("local"))


def move_structure(table: DataFrame) -> DataFrame:
    """(doc_id, x, p, len, q, idx, offs) of a table's LF-mapping: a row a BWT run.

    Positions p to p + len - 1 move to q and on; q lies in the input interval idx, offs behind its start.
    """
    from lexiloom.operators.suffix import runs

    rows = runs(table).select("doc_id", F.col("run").alias("x"), F.col("start").alias("p"), "len", "q")
    return with_targets(rows)


def with_targets(rows: DataFrame) -> DataFrame:
    """(doc_id, x, p, len, q) with idx and offs, by a union sorted by place for each document."""
    both = rows.select("doc_id", F.col("p").alias("_at"), F.lit(0).alias("_kind"), F.col("x").alias("_x"), F.col("p").alias("_p"), *(F.lit(None).cast("long").alias(c) for c in ("x", "p", "len", "q"))).union(
        rows.select("doc_id", "q", F.lit(1), F.lit(None).cast("long"), F.lit(None).cast("long"), "x", "p", "len", "q")
    )
    order = Window.partitionBy("doc_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("idx", F.last("_x", ignorenulls=True).over(order)).withColumn("offs", F.col("_at") - F.last("_p", ignorenulls=True).over(order))
    return both.where("_kind = 1").select("doc_id", "x", "p", "len", "q", "idx", "offs")


def moved(positions: DataFrame, structure: DataFrame) -> DataFrame:
    """(doc_id, i, x, target): the input interval of each position and where it moves."""
    starts = structure.select("doc_id", F.col("p").alias("_at"), F.lit(0).alias("_kind"), F.struct("x", "p", "q").alias("_v"), F.lit(None).cast("long").alias("i"))
    asks = positions.select("doc_id", F.col("i").alias("_at"), F.lit(1), F.lit(None).cast(starts.schema["_v"].dataType), "i")
    order = Window.partitionBy("doc_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    rows = starts.union(asks).withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_kind = 1")
    return rows.select("doc_id", "i", F.col("_v.x").alias("x"), (F.col("_v.q") + F.col("i") - F.col("_v.p")).alias("target"))


def balanced(structure: DataFrame, a: int, stored=lambda df: df.checkpoint()) -> DataFrame:
    """The structure with intervals split until no output interval holds 2 a input intervals or more.

    Each round cuts every heavy output interval at the a-th input start in it, for all
    documents at once; the rounds end when none is heavy.
    """
    rows = structure.select("doc_id", "x", "p", "len", "q")
    while True:
        outs = rows.select("doc_id", F.col("q").alias("_at"), F.lit(0).alias("_kind"), F.struct("p", "q", "len").alias("_v"))
        ins = rows.select("doc_id", F.col("p").alias("_at"), F.lit(1), F.lit(None).cast(outs.schema["_v"].dataType))
        order = Window.partitionBy("doc_id").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
        held = outs.union(ins).withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_kind = 1")
        held = held.where(F.col("_at") > F.col("_v.q"))  # a start on the interval's own is no cut
        k = Window.partitionBy("doc_id", "_v.q")
        held = held.withColumn("_n", F.count("*").over(k)).withColumn("_k", F.row_number().over(k.orderBy("_at")))
        cuts = held.where((F.col("_n") + 1 >= 2 * a) & (F.col("_k") == a)).select("doc_id", (F.col("_v.p") + F.col("_at") - F.col("_v.q")).alias("_cut"), F.col("_v.p").alias("p"))
        if cuts.isEmpty():
            order = Window.partitionBy("doc_id").orderBy("p")
            return with_targets(rows.withColumn("x", (F.row_number().over(order) - 1).cast("long")))
        joined = rows.join(cuts, ["doc_id", "p"], "left")
        first = joined.select("doc_id", "x", "p", F.coalesce(F.col("_cut") - F.col("p"), F.col("len")).alias("len"), "q")
        second = joined.where("_cut IS NOT NULL").select("doc_id", "x", F.col("_cut").alias("p"), (F.col("p") + F.col("len") - F.col("_cut")).alias("len"), (F.col("q") + F.col("_cut") - F.col("p")).alias("q"))
        rows = stored(first.union(second))


def parse_intervals(text):
    """Column expression: array of (p, q) from ``(0,1),(1,0)``."""
    found = F.regexp_extract_all(text, F.lit(r"\((\d+),\s*\d+\)"), 1), F.regexp_extract_all(text, F.lit(r"\(\d+,\s*(\d+)\)"), 1)
    return F.zip_with(*found, lambda p, q: F.struct(p.cast("long").alias("p"), q.cast("long").alias("q")))
