from __future__ import annotations

import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import mixing, vector_dedup
from lexiloom.llm.bloom import id_filter
from lexiloom.llm.common import shared_dir
from lexiloom.llm.components import connected_components
from lexiloom.llm.q_mixing import MIX_CTES
from lexiloom.llm.sharding import Conflict, Shard, Store, tiers
from tests.llm import data
from tests.llm.test_text_operators import collected, expected


# ---- mixing


def by_duckdb(some):
    con = duckdb.connect()
    con.execute("CREATE TABLE d0 (doc_id BIGINT, source VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO d0 VALUES (?, ?, ?)", [(r[0], r[3], r[1]) for r in some])
    return con.execute(f"WITH d AS (SELECT * FROM d0), {MIX_CTES} SELECT doc_id, source, size, source_size, target, taken FROM mixed").fetchall()


def test_mix_equals_sql_and_meets_its_targets(spark):
    some = data.rows(n=120)
    mixed = mixing.mix(data.frame(spark, some).withColumn("size", F.lit("clash")))
    got = mixed.select("doc_id", "source", "size", "source_size", "target", "taken").collect()
    assert collected(mixed, "doc_id", "source", "size", "taken") == expected([(r[0], r[1], r[2], r[5]) for r in by_duckdb(some)])
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= max(2, 0.01 * own[0].target)
    assert all(0 <= r.taken <= 3 * r.size for r in got)
    assert abs(sum({r.source: r.target for r in got}.values()) - sum(r.size for r in got)) < 1e-6
    assert collected(mixing.mix_sizes(data.frame(spark, some)), "doc_id", "size", "taken") == collected(mixed, "doc_id", "size", "taken")
    times = {}
    for r in mixing.copies(mixed, ["doc_id"]).collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert all(n <= 3 for i, n in times.items() if i not in (0, None))


@pytest.mark.parametrize("some", [[], [(1, None, "en", "a", 0)], [(1, "x", "en", "a", 1)], [(1, "", "en", None, 0), (2, "a b c", "en", "q", 1)]])
def test_mix_of_next_to_nothing(spark, some):
    got = mixing.mix(data.frame(spark, some) if some else data.empty(spark))
    assert got.count() == len(some)
    assert sum(r.taken for r in got.collect()) == sum(r.size for r in got.collect())


@pytest.mark.parametrize("n_blocks", [40, mixing.N_BLOCKS])
def test_copied_words_meet_the_words_taken(spark, n_blocks):
    some = [(i, f"w{i} " * (150 + i % 90), "en", "a" if i < 300 else "bcdefg"[i % 6], 1) for i in range(420)]
    mixed = mixing.mix(data.frame(spark, some), n_blocks=n_blocks)
    taken, copied = {}, {}
    for r in mixed.collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for r in mixing.copies(mixed, ["source", "size"]).collect():
        copied[r.source] = copied.get(r.source, 0) + r.size
    assert taken["a"] < 0.45 * sum(r.size for r in mixed.collect() if r.source == "a")
    assert all(abs(copied.get(s, 0) - n) <= 120 for s, n in taken.items())


@pytest.mark.parametrize("n_blocks", [10, 300])
def test_sources_smaller_than_a_block_take_their_target(spark, n_blocks):
    some = [(i, "w " * 100, "en", "ab"[i % 2], 1) for i in range(400)]
    some += [(1000 + 10 * k + i, "w " * (k + 1), "en", f"small{k:03}", 1) for k in range(40) for i in range(5)]
    got = mixing.mix(data.frame(spark, some), n_blocks=n_blocks).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert len(got) == 42
    assert all(abs(r.taken - r.target) <= max(1, 0.01 * r.target) for r in got if r.source > "b")
    assert all(r.taken >= 0.99 * r.target for r in got)


def test_quotas_are_the_highest_quotients(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 1000), ("c", 10)], "source string, source_size long")
    targets = mixing.targets(sizes, n_blocks=50)
    t = {r.source: r for r in targets.collect()}
    assert t["c"].target == 30 and abs(sum(r.target for r in t.values()) - 2010) < 1e-9
    assert abs(t["b"].target / t["a"].target - 2) < 1e-9
    quotas = {r.src: r.n for r in mixing.apportion(targets, 4).groupBy("src").agg(F.sum("n_blocks").alias("n")).collect()}
    block, seats = t["a"].block, -(-2010 // t["a"].block)
    ranked = sorted(((-r.target / (2 * q + 1), r.src) for r in t.values() for q in range(200)))[:seats]
    assert quotas == {s: n for s in (1, 2, 3) if (n := sum(x[1] == s for x in ranked))}
    assert sum(quotas.values()) == seats and block == 41
    per_shard = [r.n for r in mixing.apportion(targets, 4).groupBy("shard").agg(F.sum("n_blocks").alias("n")).collect()]
    assert max(per_shard) - min(per_shard) <= 1


# ---- shards


def test_arrivals_compaction_versions(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"), target_bytes=1 << 16, fan_in=3)
    assert store.compact() == 0 and store.version() == 0
    with pytest.raises(ValueError):
        store.read()
    some = data.rows()
    df = data.frame(spark, some)
    for k in range(4):
        store.append(df.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == k))
    store.append(data.empty(spark))
    before = store.manifest()
    version = store.compact()
    assert version == 6 and len(store.manifest()["shards"]) < len(before["shards"])
    want = expected([tuple(r) for r in some])
    assert collected(store.read()) == want == collected(store.read(5))
    assert store.read(1).count() < len(some)
    assert store.vacuum(keep=1) > 0
    assert collected(store.read()) == want
    with pytest.raises(Conflict):
        store._commit(version, before["schema"], [])
    assert store.compact() == version


def test_tiers_hold_similar_sizes():
    got = tiers([Shard(str(i), n, 1) for i, n in enumerate([100, 7, 30, 8, 29, 400, 401, 1])])
    assert [[s.n_bytes for s in t] for t in got] == [[1], [7, 8], [29, 30, 100], [400, 401]]


# ---- vectors


def links_of(some, threshold=0.98):
    ok = [r for r in some if r[0] is not None and r[2] is not None and r[1] and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    up, n = {r[0]: r[0] for r in some if r[0] is not None}, {r[0]: 0 for r in some}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, r in enumerate(ok):
        for s in ok[:a]:
            x, y = np.array(r[1], float), np.array(s[1], float)
            if r[2] == s[2] and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= threshold:
                n[r[0]] += 1
                n[s[0]] += 1
                p, q = find(r[0]), find(s[0])
                up[max(p, q)] = min(p, q)
    return expected([(i, n[i], None if i is None else find(i), i is None or find(i) == i) for i in n])


def vectors(seed, n, hot):
    draw = np.random.default_rng(seed)
    base = draw.normal(size=16)
    out = []
    for i in range(n):
        x = base + draw.normal(size=16) * 0.02 * base.std() * draw.integers(1, 12) if i < hot else draw.normal(size=16)
        out.append((i, [float(np.float32(v)) for v in x], int(draw.integers(2)) if i >= hot else 1))
    for i in range(0, n, 17):
        out.append((n + i, list(out[i][1]), out[i][2]))
    return out + [(9000, None, 1), (9001, [], 1), (9002, [0.0] * 16, 1), (9003, [float("nan")] + [1.0] * 15, 1), (9004, [None] + [1.0] * 15, 1), (9005, out[0][1], None), (9006, out[0][1][:8], 1), (None, out[0][1], 1)]


@pytest.mark.parametrize(
    ("region", "growth", "levels", "hot", "threshold"),
    [(8192, 3, 10, 300, 0.98), (120, 99, 10, 300, 0.98), (120, 0, 10, 120, 0.98), (120, 0, 1, 120, 0.95)],
)
def test_links_equal_brute_force(spark, monkeypatch, region, growth, levels, hot, threshold):
    """One region; proven splits; splits without proof; a region that is not split any more."""
    for name, value in (("REGION", region), ("GROWTH", growth), ("LEVELS", levels)):
        monkeypatch.setattr(vector_dedup, name, value)
    some = vectors(region + hot, 400, hot)
    df = spark.createDataFrame(some, "vec_id long, embedding array<float>, label int").withColumn("x", F.lit("clash"))
    found = vector_dedup.near_vectors(df, threshold)
    assert collected(found.select("vec_id", "n_links", "component_id", "kept")) == links_of(some, threshold)
    assert {r.recall for r in found.collect()} == {1.0}


@pytest.mark.parametrize("threshold", [0.95, 0.9])
def test_low_thresholds_in_few_dimensions(spark, monkeypatch, threshold):
    monkeypatch.setattr(vector_dedup, "REGION", 200)
    draw = np.random.default_rng(9)
    x = draw.normal(size=(500, 3))
    x /= np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    want = (x @ x.T >= threshold).sum(axis=1) - 1
    assert {r.vec_id: r.n_links for r in vector_dedup.near_vectors(df, threshold).collect()} == dict(enumerate(want.tolist()))


def test_ids_may_repeat_across_labels(spark):
    some = [(1, [1.0, 0.0], 0), (1, [0.0, 1.0], 1), (2, [0.0, 1.0], 1), (3, [1.0, 0.001], 0), (4, [1.0, 1.0], 0)]
    rows = vector_dedup.near_vectors(spark.createDataFrame(some, "vec_id long, embedding array<double>, label int")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in rows) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 0, 4)]


@pytest.mark.parametrize(("between", "u", "w"), [(90, 43, 54.3), (115, 52, 63.4)])
def test_links_along_the_line_between_two_pivots(between, u, w):
    """Both ends are rows of both cells."""

    def at(degrees):
        return [float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))] + [0.0] * 62

    rows = [(0, 0, None, 0, 0, None, True, None, False, True), *((0, v, v, 1, 0, at(d), True, None, False, True) for v, d in ((1, u), (2, w), (3, -40)))]
    names = ["cell", "v", "lead", "w", "slice", "x", "own", "ball", "ring", "sure"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_()]
    columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
    pivots = pa.array([[at(0), at(between)], None, None, None], pa.list_(pa.list_(pa.float64())))
    (out,) = vector_dedup._placed(0.98)(iter([pa.RecordBatch.from_arrays([*columns, pivots], [*names, "pivots"])]))
    cells: dict = {}
    for c, v in zip(out.column("cell").to_pylist(), out.column("v").to_pylist(), strict=True):
        cells.setdefault(v, set()).add(c)
    assert cells[1] == cells[2] and len(cells[1]) == 2


def test_links_lost_beside_a_hot_ball_are_searched_again(spark, monkeypatch):
    draw = np.random.default_rng(5)
    ball = draw.normal(size=32)
    some = [(i, (ball + 0.02 * draw.normal(size=32)).tolist(), 1) for i in range(600)]
    for k in range(50):
        x = draw.normal(size=32)
        some += [(1000 + 2 * k + j, (x + 0.02 * draw.normal(size=32)).tolist(), 1) for j in range(2)]
    real = vector_dedup.search

    def lossy(rows, balls, threshold, width):
        counts, links = real(rows, balls, threshold, width)
        return (counts, links) if width > vector_dedup.BEAM else (counts.where("links > 1"), links.where("a < 1000"))

    monkeypatch.setattr(vector_dedup, "search", lossy)
    df = spark.createDataFrame(some, "vec_id long, embedding array<double>, label int")
    got = vector_dedup.near_vectors(df).collect()
    assert {r.n_links for r in got if r.vec_id < 1000} == {599}
    assert all(r.n_links == 1 and r.component_id == r.vec_id // 2 * 2 for r in got if r.vec_id >= 1000)


def test_no_vectors(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_every_vector_in_range_is_reached():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(600, 32))
    x[:250] = draw.normal(size=32) + 0.05 * draw.normal(size=(250, 32))
    x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
    shards = vector_dedup.shards_of(x)
    lists = vector_dedup.united_graph(x, shards)
    assert min(map(len, lists)) > 0
    near = np.full((600, max(map(len, lists))), -1)
    for i, each in enumerate(lists):
        near[i, : len(each)] = each
    medoids = vector_dedup.medoids_of(x, shards)
    q, at = vector_dedup.range_search(x, medoids[shards], x, near, 0.98)
    found = np.zeros((600, 600), bool)
    found[q, at] = True
    assert (found == (x @ x.T >= 0.98)).mean() > 0.999


# ---- shared parts


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    draw = random.Random(seed)
    links = [(draw.randrange(60), draw.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 140)]
    up = {x: x for p in links for x in p}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = dict(tuple(r) for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect())
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}


def test_id_filter_has_no_false_negatives(spark):
    ids = spark.createDataFrame([(i * 7 - 1000,) for i in range(3000)] + [(None,)], "i long")
    f = id_filter(ids)
    assert f(np.array([i * 7 - 1000 for i in range(3000)])).all()
    assert f(np.arange(10**6, 10**6 + 2000)).mean() < 0.05


def test_the_shared_folder_is_the_sessions(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")
