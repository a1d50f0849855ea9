"""Compressed suffix arrays: relative Lempel-Ziv and LZ-End over differences.

A suffix array's differences repeat where its text does.  Both encodings are made document
by document in a grouped map, since parsing is sequential by nature, and decoded by
table operations; an encoding's phrases are not a contract, the decoded array is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.operators.suffix import reverted

RLZ = "doc_id long, ph long, kind string, start long, len long, src long, literal long"
REFERENCE = "doc_id long, at long, value long"
LZEND = "doc_id long, ph long, src long, end_pos long, ext long, len long"
MOST_LENGTH = 65_535
#: Places of an array that phrases and ranges are matched by.
PIECE = 256


def reference_of(table: DataFrame, segment: int = 64, segments: int = 16) -> DataFrame:
    """(doc_id, at, value): for each document the segments of its differences whose values are
    most frequent, each value counted once; the text-order of segments is kept."""
    counts = table.groupBy("doc_id", "dsa").agg(F.count("*").alias("n"))
    rows = table.join(counts, ["doc_id", "dsa"]).withColumn("seg", F.floor(F.col("i") / segment))
    firsts = rows.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id", "dsa").orderBy("i"))).where("_k = 1")
    scores = firsts.groupBy("doc_id", "seg").agg(F.sum(F.sqrt("n")).alias("score"))
    best = scores.withColumn("_k", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "seg"))).where(F.col("_k") <= segments)
    chosen = rows.join(best.select("doc_id", "seg"), ["doc_id", "seg"])
    at = (F.row_number().over(Window.partitionBy("doc_id").orderBy("i")) - 1).cast("long")
    return chosen.select("doc_id", at.alias("at"), F.col("dsa").cast("long").alias("value"))


def rlz(table: DataFrame, reference: DataFrame) -> DataFrame:
    """Phrases of each document's differences: copies from its reference, or literals.

    Greedy: the longest match from where it stands, literals for matches of one or none.
    """

    def parse(key, rows, ref):
        x, r = rows.sort_values("i").dsa.to_numpy(), ref.sort_values("at").value.to_numpy()
        starts: dict[tuple[int, int], list[int]] = {}
        for at, pair in enumerate(zip(r[:-1].tolist(), r[1:].tolist(), strict=True)):
            starts.setdefault(pair, []).append(at)
        out, i = [], 0
        while i < len(x):
            n, src = 0, -1
            for at in starts.get((int(x[i]), int(x[i + 1])), ()) if i + 1 < len(x) else ():
                m = min(len(x) - i, len(r) - at, MOST_LENGTH)
                differ = np.flatnonzero(x[i : i + m] != r[at : at + m])
                got = int(differ[0]) if len(differ) else m
                if got > n:
                    n, src = got, at
            if n > 1:
                out.append(("copy", i, n, src, None))
            else:
                n = 1
                out.append(("literal", i, 1, None, int(x[i])))
            i += n
        return pd.DataFrame([(key[0], ph, *o) for ph, o in enumerate(out)], columns=["doc_id", "ph", "kind", "start", "len", "src", "literal"]).astype(
            {"src": "Int64", "literal": "Int64"}
        )

    both = table.select("doc_id", "i", "dsa").groupBy("doc_id").cogroup(reference.toDF("ref_doc", "at", "value").groupBy("ref_doc"))
    return both.applyInPandas(parse, RLZ)


def rlz_decoded(phrases: DataFrame, reference: DataFrame) -> DataFrame:
    """(doc_id, i, sa): copied and literal differences, summed."""
    steps = phrases.select("doc_id", "start", "src", "literal", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("o"))
    rows = steps.select("doc_id", (F.col("start") + F.col("o")).alias("i"), (F.col("src") + F.col("o")).alias("at"), "literal")
    values = rows.join(reference, ["doc_id", "at"], "left").select("doc_id", "i", F.coalesce("literal", "value").alias("dsa"))
    return summed(values)


def with_bases(phrases: DataFrame, sa: DataFrame) -> DataFrame:
    """Phrases with ``base``, the array's value before each of them (0 before the first): from
    there a phrase is decoded without those before it."""
    before = sa.select("doc_id", (F.col("i") + 1).alias("start"), F.col("sa").alias("_before"))
    return phrases.join(before, ["doc_id", "start"], "left").withColumn("base", F.coalesce("_before", F.lit(0).cast("long"))).drop("_before")


def met(phrases: DataFrame, queries: DataFrame) -> DataFrame:
    """Phrases (doc_id, ph, start, stop, ...) beside the ranges (query, doc_id, left, right) that meet
    them: an equi-join on the pieces of PIECE places that both touch."""
    pieces = lambda a, z: F.explode(F.sequence(F.floor(a / PIECE), F.floor(z / PIECE)))
    held = phrases.withColumn("piece", pieces(F.col("start"), F.col("stop")))
    asked = queries.where("left <= right").select("query", "doc_id", "left", "right", pieces(F.col("left"), F.col("right")).alias("piece"))
    found = held.join(asked, ["doc_id", "piece"]).where("start <= right AND stop >= left")
    return found.drop("piece").dropDuplicates(["query", "doc_id", "ph", "left", "right"])


def places(found: DataFrame) -> DataFrame:
    """The places i of each phrase ``met``, from its start to where it or the range ends."""
    return found.withColumn("i", F.explode(F.sequence("start", F.least("stop", "right"))))


def from_bases(values: DataFrame) -> DataFrame:
    """(query, doc_id, i, sa) from the differences ``dsa`` of ``places``."""
    order = Window.partitionBy("query", "doc_id", "left", "right", "ph").orderBy("i")
    return values.withColumn("sa", (F.col("base") + F.sum("dsa").over(order)).cast("long")).where("i >= left").select("query", "doc_id", "i", "sa")


def rlz_ranges(phrases: DataFrame, reference: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc_id, i, sa) for ranges (query, doc_id, left, right): only the phrases that a range
    meets are decoded, each by itself; phrases are ``with_bases``."""
    held = phrases.select("doc_id", "ph", "start", (F.col("start") + F.col("len") - 1).alias("stop"), "src", "literal", "base")
    rows = places(met(held, queries)).withColumn("at", F.col("src") + F.col("i") - F.col("start"))
    return from_bases(rows.join(reference, ["doc_id", "at"], "left").withColumn("dsa", F.coalesce("literal", "value")))


def cursor_ranges(cursors: DataFrame, sizes: DataFrame) -> DataFrame:
    """(query, doc_id, left, right) that cursors (query, doc_id, at, turned, skip, n) report.

    A cursor stands before the place ``at`` (after it, if ``turned``), skips ``skip`` places and
    reports the next ``n`` in its direction; it ends with its array, whose length is ``n_rows`` in
    ``sizes``.  Cursors with nothing to report have no row.
    """
    near = F.when(F.col("turned"), F.col("at") - F.col("skip")).otherwise(F.col("at") + F.col("skip"))
    far = F.when(F.col("turned"), near - F.col("n") + 1).otherwise(near + F.col("n") - 1)
    rows = cursors.join(sizes.select("doc_id", "n_rows"), "doc_id").where("n > 0")
    rows = rows.select("query", "doc_id", F.greatest(F.least(near, far), F.lit(0)).alias("left"), F.least(F.greatest(near, far), F.col("n_rows") - 1).alias("right"))
    return rows.where("left <= right")


def summed(values: DataFrame) -> DataFrame:
    """(doc_id, i, sa) from (doc_id, i, dsa)."""
    order = Window.partitionBy("doc_id").orderBy("i")
    return values.select("doc_id", "i", F.sum("dsa").over(order).cast("long").alias("sa"))


def lz_end(table: DataFrame, longest: int = 8192) -> DataFrame:
    """LZ-End phrases of each document's differences: a copy that ends where an earlier phrase
    ends, then one more value; src is that phrase, or null for none."""

    def parse(key, rows):
        x = rows.sort_values("i").dsa.tolist()
        ends: dict[int, list[int]] = {}  # value at a phrase's end -> phrases
        stops: list[int] = []
        out, i = [], 0
        while i < len(x):
            best, src = 0, None
            room = min(longest, len(x) - i) - 1
            for n in range(room, 0, -1):
                for ph in ends.get(x[i + n - 1], ()):
                    e = stops[ph]
                    if e + 1 >= n and x[e + 1 - n : e + 1] == x[i : i + n]:
                        best, src = n, ph
                        break
                if best:
                    break
            stop = i + best
            out.append((key[0], len(out), src, stop, x[stop], best + 1))
            ends.setdefault(x[stop], []).append(len(stops))
            stops.append(stop)
            i = stop + 1
        return pd.DataFrame(out, columns=["doc_id", "ph", "src", "end_pos", "ext", "len"]).astype({"src": "Int64"})

    return table.select("doc_id", "i", "dsa").groupBy("doc_id").applyInPandas(parse, LZEND)


def lz_end_decoded(phrases: DataFrame) -> DataFrame:
    """(doc_id, i, sa) of LZ-End phrases."""

    def decode(key, rows):
        x: list[int] = []
        stops: list[int] = []
        for src, ext, n in rows.sort_values("ph")[["src", "ext", "len"]].itertuples(index=False):
            if n > 1:
                e = stops[int(src)]
                x += x[e + 2 - int(n) : e + 1]
            x.append(int(ext))
            stops.append(len(x) - 1)
        return pd.DataFrame({"doc_id": key[0], "i": range(len(x)), "dsa": x})

    return summed(phrases.groupBy("doc_id").applyInPandas(decode, "doc_id long, i long, dsa long"))


def lz_end_with_bases(phrases: DataFrame, sa: DataFrame) -> DataFrame:
    """LZ-End phrases with ``start`` and ``base``, as ``with_bases`` adds it."""
    return with_bases(phrases.withColumn("start", F.col("end_pos") - F.col("len") + 1), sa)


def lz_end_ranges(phrases: DataFrame, queries: DataFrame, stored) -> DataFrame:
    """(query, doc_id, i, sa) for ranges (query, doc_id, left, right), without the rest of an array;
    phrases are ``lz_end_with_bases``.

    Places of the phrases that a range meets are followed to their sources, all at once, until
    each stands at a phrase's end, whose value is given.  A round is an equi-join on pieces; their
    number is that of the longest chain of copies.
    """
    ends = phrases.select("doc_id", F.col("ph").alias("src"), F.col("end_pos").alias("_end"))
    held = phrases.join(ends, ["doc_id", "src"], "left").select(
        "doc_id", "ph", "start", F.col("end_pos").alias("stop"), "ext", "base", (F.col("_end") + 2 - F.col("len") - F.col("start")).alias("shift")
    )
    held = stored(held)
    asked = stored(places(met(held, queries)).select("query", "doc_id", "left", "right", "ph", "base", "i"))
    by_piece = held.select("doc_id", "start", "stop", "ext", "shift", F.explode(F.sequence(F.floor(F.col("start") / PIECE), F.floor(F.col("stop") / PIECE))).alias("piece"))
    walking = asked.select("doc_id", "i").distinct().withColumn("at", F.col("i"))
    known = None
    while True:
        step = walking.withColumn("piece", F.floor(F.col("at") / PIECE)).join(by_piece, ["doc_id", "piece"]).where("start <= at AND at <= stop")
        step = stored(step.select("doc_id", "i", F.when(F.col("at") < F.col("stop"), F.col("at") + F.col("shift")).alias("at"), "ext"))
        ended = step.where("at IS NULL").select("doc_id", "i", F.col("ext").alias("dsa"))
        known = ended if known is None else known.union(ended)
        walking = step.where("at IS NOT NULL").select("doc_id", "i", "at")
        if walking.isEmpty():
            return from_bases(asked.join(known, ["doc_id", "i"]))


def converted(runs: DataFrame, phrases: DataFrame, reference: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a plain encoding (texts, phrases with bases[, reference]) from those of one over
    the runs (doc_id, sym, start, len) of a transform.

    The phrases stay as they are; the texts, which the plain form searches, are read off the
    transform.  Without ``reference`` the phrases are LZ-End.
    """
    array = lz_end_decoded(phrases) if reference is None else rlz_decoded(phrases, reference)
    bwt = runs.select("doc_id", F.col("sym").alias("bwt"), F.explode(F.sequence("start", F.col("start") + F.col("len") - 1)).alias("i"))
    texts = reverted(array.join(bwt, ["doc_id", "i"]))
    if reference is None:
        return {"texts": texts, "phrases": lz_end_with_bases(phrases, array)}
    return {"texts": texts, "phrases": with_bases(phrases, array), "reference": reference}


def inspected(runs: DataFrame) -> DataFrame:
    """(doc_id, n_rows, n_runs, longest, n_symbols): what the transform of a document is made of."""
    return runs.groupBy("doc_id").agg(
        F.sum("len").cast("long").alias("n_rows"), F.count("*").alias("n_runs"), F.max("len").alias("longest"), F.countDistinct("sym").alias("n_symbols")
    )


def phrase_lengths(phrases: DataFrame) -> DataFrame:
    """(doc_id, n_phrases, n_copies, longest) of either encoding."""
    return phrases.groupBy("doc_id").agg(F.count("*").alias("n_phrases"), F.count(F.when(F.col("len") > 1, 1)).alias("n_copies"), F.max("len").alias("longest"))


def random_access(sa: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, doc_id, i, sa) for ranges (query, doc_id, left, right): an equi-join on each place."""
    places = queries.select("query", "doc_id", F.explode(F.sequence("left", "right")).alias("i"))
    return places.join(sa.select("doc_id", "i", "sa"), ["doc_id", "i"]).select("query", "doc_id", "i", "sa")
