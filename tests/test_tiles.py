import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import programs as P, pyramid as Y
from fieldloom.sources import grids, tiles as T

KEYS = "source_file_id string, field_key string, component int, sample_index int, time_index int, height int, width int, values array<double>"


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(0)
    rows = []
    for file in ("a", "b"):
        for sample in range(2):
            rows += [(file, "p", None, sample, time, 37, 53, rng.normal(size=37 * 53).tolist()) for time in range(3)]
            rows += [(file, "v", 1, sample, None, 37, 53, rng.normal(size=37 * 53).tolist())]
        rows += [(file, "s", None, None, None, 37, 53, rng.normal(size=37 * 53).tolist())]
    return spark.createDataFrame(rows, KEYS)


@pytest.fixture(scope="module")
def store(spark, frames, tmp_path_factory):
    return T.write_store(T.tiles_of_frames(frames, 8), 8, f"file://{tmp_path_factory.mktemp('tiles')}/store")


def test_crops_equal_those_of_whole_frames(spark, frames, store):
    rows = [("a", "p", None, 0, 1, 0, 0, 37, 53), ("a", "p", None, 1, 2, 7, 8, 9, 17), ("b", "v", 1, 1, None, 36, 52, 1, 1), ("b", "s", None, None, None, 3, 5, 30, 2), ("b", "p", None, 1, 0, 8, 16, 8, 8)]
    states = spark.createDataFrame([(f"s{i}", *r) for i, r in enumerate(rows)], "state_ref string, source_file_id string, field_key string, component int, sample_index int, time_index int, top int, left int, h int, w int")
    want = {r.state_ref: r.x for r in grids.crop_states(frames, states).collect()}
    got = {r.state_ref: r.x for r in T.read_crops(store, states).collect()}
    assert got == want and all(len(got[f"s{i}"]) == r[7] * r[8] for i, r in enumerate(rows))


@pytest.mark.parametrize("bad", [("a", "p", None, 0, 9, 0, 0, 2, 2), ("a", "p", None, 0, 0, 30, 0, 8, 2), ("a", "p", None, 0, 0, -1, 0, 2, 2)])
def test_bad_crops_fail(spark, store, bad):
    states = spark.createDataFrame([("s", *bad)], "state_ref string, source_file_id string, field_key string, component int, sample_index int, time_index int, top int, left int, h int, w int")
    with pytest.raises(Exception, match="frame"):
        T.read_crops(store, states).collect()


def test_filters_reach_the_scan_and_only_touched_tiles_are_read(spark, frames, store):
    one = T.read_region(store, "a", "p", None, 1, 2, 9, 17, 6, 6)
    plan = one._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    pushed = plan[plan.index("PushedFilters") :].split("\n")[0]
    assert all(x in pushed for x in ("EqualTo(source_file_id,a)", "EqualTo(sample_index,1)", "EqualTo(time_index,2)", "LessThanOrEqual(tr,1)", "GreaterThanOrEqual(tc,2)"))
    rows = one.collect()
    assert sorted((r.tr, r.tc) for r in rows) == [(1, 2)]
    cells = {(p.r, p.c + i): v for r in rows for p in r.pieces for i, v in enumerate(p.v)}
    whole = np.array(frames.filter("source_file_id = 'a' and field_key = 'p' and sample_index = 1 and time_index = 2").first()["values"]).reshape(37, 53)
    assert cells == {(r, c): whole[r, c] for r in range(9, 15) for c in range(17, 23)}


def test_pages_of_other_frames_are_skipped(spark, tmp_path):
    """The scan's own metric: of a store of many pages one crop reads few rows."""
    rows = [("f", "p", None, i, None, 64, 64, [float(i)] * 4096) for i in range(200)]  # 3,200 tiles
    wide = spark.createDataFrame(rows, KEYS)
    store = T.write_store(T.tiles_of_frames(wide, 16).repartition(8), 16, f"file://{tmp_path}/store")
    one = T.read_region(store, "f", "p", None, 77, None, 0, 0, 16, 16)
    one.collect()
    nodes, scanned = [one._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan"):
            scanned.append(node.metrics().apply("numOutputRows").value())
        for i in range(node.children().size()):
            nodes.append(node.children().apply(i))
    assert len(one.collect()) == 1 and 0 < sum(scanned) <= 2 * T.PAGE_ROWS


def test_sound_layout_and_its_breaks(spark, frames, tmp_path):
    sound = T.write_store(T.tiles_of_frames(frames, 8), 8, f"file://{tmp_path}/sound")
    assert T.layout_problems(sound).count() == 0
    cells = frames.filter("field_key = 's'").select(*T.FRAME, "height", "width", F.posexplode("values").alias("i", "x")).withColumn("r", (F.floor(F.col("i") / 53) + 1).cast("int")).withColumn("c", (F.col("i") % 53 + 1).cast("int"))
    same = T.write_store(T.tiles_of_cells(cells, 8), 8, f"file://{tmp_path}/cells")
    assert T.layout_problems(same).count() == 0 and same.tiles.exceptAll(sound.tiles.filter("field_key = 's'")).count() == 0
    file = lambda f: F.col("source_file_id") == f
    t = sound.tiles
    bent = t.filter(~(file("a") & (F.col("field_key") == "p") & (F.col("tr") == 1) & (F.col("time_index") == 2)))  # tiles that are gone
    bent = bent.withColumn("values", F.when(file("b") & (F.col("field_key") == "v") & (F.col("tc") == 0), F.slice("values", 1, 3)).when(file("b") & (F.col("field_key") == "s"), F.transform("values", lambda v: v / F.lit(0.0) if False else F.lit(float("nan")))).otherwise(F.col("values")))
    bent = bent.unionByName(t.filter(file("a") & (F.col("field_key") == "s"))).unionByName(t.filter(file("a") & (F.col("field_key") == "v")).withColumn("source_file_id", F.lit("c")))
    bent = bent.filter(~(file("b") & (F.col("field_key") == "p") & (F.col("time_index") == 1)))  # a time step that is gone
    got = {}
    for r in T.layout_problems(T.TileStore(bent, sound.layout.withColumn("dtype", F.when(file("a") & (F.col("field_key") == "v"), "float16").otherwise(F.col("dtype"))), 8, "")).collect():
        got.setdefault((r.source_file_id, r.field_key), set()).add(r.problem)
    assert got == {("a", "p"): {"missing_tiles", "value_count"}, ("b", "v"): {"short_tiles", "value_count"}, ("b", "s"): {"not_finite"}, ("a", "s"): {"repeated_tiles", "value_count"}, ("a", "v"): {"dtype"}, ("c", "v"): {"undeclared"}, ("b", "p"): {"frames", "missing_tiles", "value_count"}}
    with pytest.raises(Exception, match="exist"):
        T.write_store(t, 8, f"file://{tmp_path}/sound")


# ---------------------------------------------------------------- pyramid


def regions_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "region int, state_ref string, height int, width int, r1 int, r2 int, c1 int, c2 int")


@pytest.mark.parametrize(("h", "w", "side", "factor", "levels"), [(512, 512, 16, 8, 3), (37, 61, 4, 2, 3), (16, 16, 16, 8, 2), (5, 90, 8, 4, 1)])
def test_statistics_and_ties_equal_whole_grids(spark, h, w, side, factor, levels):
    rng = np.random.default_rng(h)
    grid = rng.integers(-40, 40, (h, w)).astype(float) / 8
    grid[: h // 2, : w // 3] = 2.0
    rows = [("s", h, w, 1, h, 1, w), ("s", h, w, 1, 1, 1, 1), ("s", h, w, h, h, w, w)]
    for _ in range(25):
        r, c = np.sort(rng.integers(1, h + 1, 2)), np.sort(rng.integers(1, w + 1, 2))
        rows.append(("s", h, w, int(r[0]), int(r[1]), int(c[0]), int(c[1])))
    regions = regions_of(spark, rows)
    tiles = Y.tiles_of_grids(spark.createDataFrame([("s", h, w, grid.ravel().tolist())], "state_ref string, h int, w int, z array<double>"), side).cache()
    levels_of = Y.pyramid(tiles, levels, factor).cache()
    stats = Y.region_statistics(regions, tiles, levels_of, levels, side, factor).cache()
    got = {r.region: r for r in stats.collect()}
    for i, (_, _, _, r1, r2, c1, c2) in enumerate(rows):
        part, s = grid[r1 - 1 : r2, c1 - 1 : c2], got[i]
        assert (s.n, s.low, s.high) == (part.size, part.min(), part.max())
        assert abs(s.mean - part.mean()) < 1e-12 and abs(s.std - part.std()) < 1e-9
        around = 2 * ((r2 - r1) + (c2 - c1) + 2)
        assert s.rows_read <= around * side + 4 * factor * (around // side + 4)  # by the perimeter, not by the area
    programs = regions.filter("region in (0, 5, 9)").select(F.col("state_ref"), F.col("region").cast("string").alias("task"), F.explode(F.array(F.lit("argmin"), F.lit("argmax"))).alias("op"), F.lit(None).cast("double").alias("target"), P.region_spans(F.col("r1"), F.col("c1"), F.col("r2") - F.col("r1") + 1, F.col("c2") - F.col("c1") + 1).cast(P.SPANS).alias("left"), F.lit(None).cast(P.SPANS).alias("right"))
    want = {(int(r.task), r.op): sorted((x.r, x.c0, x.c1) for x in r.runs) for r in P.execute(programs, spark.createDataFrame([("s", h, w, grid.ravel().tolist())], "state_ref string, h int, w int, z array<double>")).collect()}
    for op in ("argmin", "argmax"):
        runs = {}
        for r in Y.region_extrema(regions, stats, tiles, levels_of, op, levels, side, factor).collect():
            runs.setdefault((r.region, op), []).append((r.r, r.c0, r.c1))
        for (region, o), ties in want.items():
            if o == op:
                assert sorted(runs[region, op]) == ties
        for i, (_, _, _, r1, r2, c1, c2) in enumerate(rows):
            part = grid[r1 - 1 : r2, c1 - 1 : c2]
            assert sum(c1_ - c0 + 1 for _, c0, c1_ in runs[i, op]) == (part == (part.min() if op == "argmin" else part.max())).sum()


def test_shipments_in_tiles(spark, tmp_path):
    """Tiles made from shipped cells alone, among them short ones at both edges and whole ones without any shipment, and digests of strips against those of whole frames."""
    import datetime

    from pyspark.sql import functions as F

    from fieldloom.operators import audit
    from fieldloom.sources import grids

    day = lambda y, m: datetime.date(y, m, 3)
    sold = [("R", "F", 1, 3, day(1995, 1), 5.0), ("R", "F", 1, 3, day(1995, 1), 2.0), ("R", "F", 1, 21, day(2001, 12), 4.0), ("R", "O", 2, 12, day(1997, 6), 1.0), ("A", "F", 1, 12, day(1997, 6), None)]
    spark.createDataFrame(sold, "l_returnflag string, l_linestatus string, l_linenumber int, l_suppkey long, l_shipdate date, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(3,), (21,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    want = {(f, s, t): [[0.0] * 84 for _ in range(19)] for f, s, t in (("R", 0, 0), ("R", 1, 1), ("A", 0, 0))}
    want["R", 0, 0][0][0], want["R", 0, 0][18][83], want["R", 1, 1][9][29] = 7.0, 4.0, 1.0
    rows = grids.shipment_tiles(spark, f"file://{tmp_path}", 16, 16).collect()
    assert len(rows) == 3 * 2 * 6 and {(r.height, r.width) for r in rows} == {(19, 84)}
    for r in rows:
        part = [v[r.tc * 16 : r.tc * 16 + 16] for v in want[r.source_file_id, r.sample_index, r.time_index][r.tr * 16 : r.tr * 16 + 16]]
        assert list(r["values"]) == [x for v in part for x in v]
    strips = grids.shipment_tiles(spark, f"file://{tmp_path}", 4, 84).withColumn("source_id", F.lit("ship"))
    frames = spark.createDataFrame([("ship", f, "quantity", None, s, t, 19, 84, [x for v in g for x in v]) for (f, s, t), g in want.items()], "source_id string, source_file_id string, field_key string, component int, sample_index int, time_index int, height int, width int, values array<double>")
    assert sorted(audit.digests_of_frames(audit.strip_digests(strips)).collect()) == sorted(audit.trajectory_digests(frames).collect())
