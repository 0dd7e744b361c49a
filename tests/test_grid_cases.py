"""Hand-computed cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.functions import labels as L, numeric as N
from fieldloom.functions.answers import parse_answer
from fieldloom.operators import audit, batching, normalize, programs as P, sampling, scoring
from fieldloom.sources import files, grids


def grid(spark, rows, ref="g"):
    cells = [(ref, i + 1, j + 1, float(v)) for i, row in enumerate(rows) for j, v in enumerate(row)]
    return spark.createDataFrame(cells, "state_ref string, r int, c int, z double")


def leaf(task, op, spans, right=None, target=None, h=20, w=20):
    return ("g", h, w, task, op, spans, right, target)


SCHEMA = f"state_ref string, h int, w int, task string, op string, left {P.SPANS}, right {P.SPANS}, target double"


def region(r, c, h, w):
    return [(0, r, r + h - 1, c, c + w - 1)]


def run(spark, rows, *leaves):
    return {x.task: x for x in P.execute(spark.createDataFrame(list(leaves), SCHEMA), packed(grid(spark, rows), len(rows), len(rows[0]))).collect()}


def packed(cells, h, w):
    return grids.grids_of(cells.withColumn("h", F.lit(h)).withColumn("w", F.lit(w)))


def test_reverse_line_and_region_statistics(spark):
    ramp = [[7 * i + j for j in range(7)] for i in range(5)]
    line = [(k, 3, 3, 7 - 2 * k, 7 - 2 * k) for k in range(4)]
    got = run(spark, ramp, leaf("line_profile", "read", line, h=5, w=7))
    assert got["line_profile"]["values"] == [20, 18, 16, 14]
    block = [[1, 3, 0], [5, 7, 0]]
    ops = [leaf(f"region_{o}", o, region(1, 1, 2, 2)) for o in ("mean", "std", "min", "max")]
    got = run(spark, block, *ops)
    assert [got[f"region_{o}"]["values"][0] for o in ("mean", "min", "max")] == [4, 1, 7] and got["region_std"]["values"][0] == pytest.approx(math.sqrt(5))


def test_difference_fraction_and_nearest_ties(spark):
    z = [[1, 4, 9], [2, 5, 8]]
    got = run(spark, z, leaf("point_difference", "read", region(1, 1, 1, 1), region(2, 3, 1, 1)), leaf("threshold_fraction", "fraction_gt", region(1, 1, 2, 3), target=4.0))
    assert got["point_difference"]["values"] == [-7] and got["point_difference"].operands == [1, 8] and got["threshold_fraction"]["values"] == [0.5]
    near = run(spark, [[0.125, 0.375, 0.875]], leaf("nearest_value_location", "nearest", region(1, 1, 1, 3), target=0.25))["nearest_value_location"]
    assert near["values"] == [1, 1] and [tuple(x) for x in near.runs] == [(1, 1, 2)] and near.encoding == "row_runs"


def test_tie_runs(spark):
    z = [[0, 0, 5, 0], [5, 0, 0, 5], [5, 5, 5, 5]]
    got = run(spark, z, leaf("region_argmin", "argmin", region(1, 1, 3, 4)))["region_argmin"]
    assert [tuple(x) for x in got.runs] == [(1, 1, 2), (1, 4, 4), (2, 2, 3)]
    flat = run(spark, [[2, 2], [2, 2]], leaf("region_argmax", "argmax", region(1, 1, 2, 2)))["region_argmax"]
    assert flat.encoding == "rectangle" and flat["values"] == [1, 1]


def test_two_region_geometry(spark):
    p = spark.createDataFrame([leaf("region_mean_difference", "mean", region(1, 1, 2, 3), region(2, 2, 2, 3))], SCHEMA)
    g = P.with_geometry(p).first()
    assert (g.query_point_count, g.operand_point_count, g.operation_count, g.query_extent_cells) == (10, 12, 5, 12)
    assert P.block_diagnostics(p, 2, 2).first().distinct_blocks == 4
    inside = spark.createDataFrame([leaf("region_mean", "mean", region(3, 5, 2, 2)), leaf("point_difference", "read", region(1, 1, 1, 1), region(3, 1, 1, 1)), leaf("line_profile", "read", [(0, 1, 1, 1, 1), (1, 1, 1, 3, 3)])], SCHEMA)
    got = {r.task: r for r in P.block_diagnostics(inside, 2, 2).join(inside.select("task", P.block_relation(2, 2).alias("closed")), "task").collect()}
    assert all(r.closed == r.block_relation for r in got.values()) and got["region_mean"].closed == "single_block" != got["line_profile"].closed


def test_half_precision_and_rounding(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 3, 500), [0.0, 1.5, -2.5, 6.1e-5, 3e-8, 65504.0, 0.05, 0.15, 0.25, -0.05, 2.675, 0.0005]])
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for r in df.select("v", N.fp16(F.col("v")).alias("h"), *[N.exact_round(F.col("v"), d).alias(f"d{d}") for d in (1, 2, 3)]).collect():
        assert r.h == float(np.float16(r.v)) and all(r[f"d{d}"] == (round(r.v, d) or 0.0) for d in (1, 2, 3))
    assert spark.createDataFrame([(65520.0,)], "v double").select(N.fp16(F.col("v"))).first()[0] is None


def test_parse_outcomes(spark):
    cases = {"[1]": None, " [1, -2.5e3]\n": None, "[NaN]": "nonfinite_number", "[true]": "nonnumeric_item", "[]": "not_nonempty_array", "[0.2,]": "invalid_json", "[1e999]": "nonfinite_number", "0.2": "not_nonempty_array", "[0.2] or [0.3]": "invalid_json", '["a"]': "nonnumeric_item", '[1, "b"]': "nonnumeric_item", "[null]": "nonnumeric_item", '{"a":[1]}': "not_nonempty_array", "": "invalid_json", "[1]]": "invalid_json", "[+1]": "invalid_json"}
    df = spark.createDataFrame([(k,) for k in cases], "t string").select("t", parse_answer(F.col("t")).alias("p"))
    assert {r.t: r.p.error for r in df.collect()} == cases


def test_macro_and_units(spark):
    rows = [("a", 4, 4, True, True), ("b", 1, 0, False, True)]
    sc = spark.createDataFrame(rows, "task string, units int, hits int, all_correct boolean, valid boolean")
    whole = scoring.summarize(sc, ["task"]).filter("dim = 'all'").first()
    assert whole.units == 5 and whole.unit_accuracy == pytest.approx(0.8)
    assert scoring.macro(sc).first().macro_unit_accuracy == 0.5


def test_sampled_programs_are_legal_and_independent(spark):
    states = spark.createDataFrame([(f"s{i}", h, w) for i, (h, w) in enumerate([(1, 1), (1, 2), (2, 1), (3, 4), (17, 19), (128, 128)] * 6)], "state_ref string, h int, w int")
    drawn = P.sample_programs(states).cache()
    assert P.violations(drawn.withColumn("target", F.lit(0.0))).count() == 0
    few = P.sample_programs(states.filter("state_ref = 's4'"), tasks=("line_profile",)).collect()
    assert few == drawn.filter("state_ref = 's4' and task = 'line_profile'").collect()
    assert {r.task for r in drawn.filter("h = 1 and w = 1").collect()} == set(L.TASKS) - {"multi_point", "point_difference", "line_profile", "region_mean", "region_std", "region_mean_difference"}


def test_standardize_constant_and_roughness(spark):
    cells = spark.createDataFrame([("k", 1, c, 3.0) for c in (1, 2)] + [("v", 1, c, float(c)) for c in (1, 2)], "state_ref string, r int, c int, x double")
    z = {(r.state_ref, r.c): r.z for r in normalize.standardize(cells).collect()}
    assert z["k", 1] == z["k", 2] == 0 and z["v", 2] == -z["v", 1] == 1
    rough = {r.state_ref: r for r in normalize.roughness(normalize.standardize(cells)).collect()}
    assert rough["k"].roughness_bin == "constant" and rough["v"].roughness == 2 and rough["v"].roughness_bin == "sharp"


def test_scaling_round_trip(spark):
    v = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 5.0)], "ch string, v double")
    for mode in ("none", "minmax", "zscore"):
        for keys in (["ch"], []):
            y = normalize.restore_channels(normalize.scale_channels(v, mode, keys).withColumnRenamed("v", "old"))
            assert all(r.v == pytest.approx(r.old) for r in y.collect())


def test_efficiency_case(spark):
    rows = [("serialized", "m", "b", "q", 0, "complete", 20.0, 1.0, 4, 1.0), ("interface", "m", "b", "q", 0, "complete", 10.0, 1.0, 2, 1.0), ("interface", "m", "b", "r", 0, "length_limit", 10.0, 1.0, 2, 1.0), ("interface", "m", "b", "s", 0, "oom", 10.0, None, 0, 2.0)]
    t = spark.createDataFrame(rows, "method string, decode_mode string, bin string, qa_id string, repeat int, status string, request_ms double, ttft_ms double, generated_tokens long, peak_gib double")
    fast = {r.method: r for r in batching.efficiency(t).collect()}["interface"]
    assert fast.completed_per_second == pytest.approx(1 / 0.03) and fast.oom_peak_gib == 2
    assert batching.paired_speed(t).first().time_ratio == 2


def test_balance_beats_contiguous(spark):
    lengths = [800, 180, 200, 190] * 12
    rows = spark.createDataFrame([(0, i, n) for i, n in enumerate(lengths)], "batch int, id long, length int")
    parts = {}
    for r in batching.length_balanced(rows, 3).collect():
        parts.setdefault(r.part, []).append(r.length)
    assert [len(parts[p]) for p in range(3)] == [16] * 3
    cost = sum(max(p) * len(p) for p in parts.values())
    assert cost < 0.6 * sum(max(lengths[i : i + 16]) * 16 for i in range(0, 48, 16))


def test_json_lines_guards(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5)], "id long, v double")
    files.write_jsonl(df, f"file://{tmp_path}/a")
    assert files.read_jsonl(spark, f"file://{tmp_path}/a", df.schema).collect() == df.collect()
    with pytest.raises(Exception):
        files.write_jsonl(df, f"file://{tmp_path}/a")
    with pytest.raises(Exception):
        files.write_jsonl(spark.createDataFrame([(1, float("nan"))], "id long, v double"), f"file://{tmp_path}/b")


def test_inventory_and_stale(spark, tmp_path):
    (tmp_path / "x.bin").write_bytes(b"abc")
    inv = files.inventory(spark, f"file://{tmp_path}").cache()
    row = inv.first()
    assert row.sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and row.git_sha1 == "f2ba8f84ab5c1bce84a7b441cb1959cfc7093b7f"
    assert files.stale(spark, f"file://{tmp_path}", inv).count() == 0
    (tmp_path / "x.bin").write_bytes(b"abcd")
    assert files.stale(spark, f"file://{tmp_path}", inv).count() == 1


def test_round_robin_keeps_the_largest(spark):
    rows = spark.createDataFrame([("b", f"q{i}", f"t{i % 3}", i) for i in range(30)], "bin string, qa_id string, task string, cells int")
    got = sampling.round_robin(rows, "bin", ["task"], 6).collect()
    assert len(got) == 6 and 29 in [r.cells for r in got]


def test_grids_round_trip_and_crop(spark):
    z = grid(spark, [[1, 2, 3], [4, 5, 6]]).withColumn("h", F.lit(2)).withColumn("w", F.lit(3))
    back = grids.cells_of(grids.grids_of(z)).select("state_ref", "r", "c", "z")
    assert sorted(back.collect()) == sorted(z.select("state_ref", "r", "c", "z").collect())
    assert [(r.r, r.c, r.z) for r in grids.crop(z, 1, 1, 1, 2).orderBy("c").collect()] == [(1, 1, 5.0), (1, 2, 6.0)]


def test_offsets_over_partitions(spark):
    rows = spark.range(1000).select(F.col("id"), (F.col("id") % 7).alias("n"))
    got = batching.running_offsets(rows, "id", "n").orderBy("id").collect()
    assert [r.offset for r in got] == np.cumsum([0] + [i % 7 for i in range(999)]).tolist()
    assert audit.repeated_ids(rows, "id").count() == 0


def test_changed_answers_run_the_same_program(spark):
    rng = np.random.default_rng(6)
    names = [f"s{i}" for i in range(9)]
    fields = {n: rng.integers(0, 3, (4, 4)).astype(float) for n in names}
    cells = spark.createDataFrame([(n, r + 1, c + 1, float(z[r, c])) for n, z in fields.items() for r in range(4) for c in range(4)], "state_ref string, r int, c int, z double")
    at = {n: (1 + i % 3 // 2, 1) for i, n in enumerate(names)}  # six states have one program, three another
    leaves = [(n, 4, 4, "single_point", "read", [(0, r, r, c, c)], None, None) for n, (r, c) in at.items()]
    leaves += [(n, 4, 4, "region_argmin", "argmin", region(1, 1, 2, 2), None, None) for n in names]
    rec = P.records(P.execute(spark.createDataFrame(leaves, SCHEMA), packed(cells, 4, 4)))
    rows = {r.qa_id: r for r in rec.collect()}
    order = {r.qa_id: r.k for r in rec.select("qa_id", N.order_key("query", F.col("qa_id")).alias("k")).collect()}
    ring = [r.s for r in spark.createDataFrame([(n,) for n in names], "s string").orderBy(N.order_key("pair", F.col("s"))).collect()]
    ids = {(r.state_ref, r.task, str(r.left)): q for q, r in rows.items()}

    def answer(n, r):
        if r.task == "single_point":
            return fields[n][r.left[0].r1 - 1, r.left[0].c1 - 1]
        z = fields[n][:2, :2]
        return set(zip(*np.where(z == z.min()), strict=True))

    def pairs(max_pairs, max_candidates, per_query):
        used, want, tried = set(), {}, 0
        for q in sorted(rows, key=lambda q: (order[q], q)):
            r = rows[q]
            if q in used:
                continue
            for step in range(1, per_query + 1):
                if len(want) >= max_pairs or tried >= max_candidates:
                    return want
                tried += 1
                n = ring[(ring.index(r.state_ref) + step) % 9]
                program = (n, r.task, str(r.left))
                other = ids.get(program, program)
                x, y = answer(r.state_ref, r), answer(n, r)
                if other in used or (x & y if isinstance(x, set) else abs(x - y) <= 2 * r.tolerance):
                    continue
                used |= {q, other}
                want[q] = n
                break
        return want

    grid_rows = packed(cells, 4, 4)
    for limits in ((128, 4096, 8), (3, 4096, 8), (128, 6, 8), (128, 4096, 2)):
        got = scoring.changed_answer_pairs(rec, grid_rows, *limits).collect()
        assert {r.qa_id: r.other_state for r in got} == pairs(*limits), limits
        assert len({x for r in got for x in (r.qa_id, r.other_qa_id)}) == 2 * len(got)
    assert len(pairs(128, 4096, 8)) > 4


def test_replay_finds_every_change(spark):
    """Sound records raise no alarm, whatever the partitions; each claim that is changed is named."""
    rng = np.random.default_rng(1)
    fields = {f"s{i}": rng.normal(size=(5, 6)).round(3) for i in range(6)}
    cells = spark.createDataFrame([(n, r + 1, c + 1, float(np.float16(z[r, c]))) for n, z in fields.items() for r in range(5) for c in range(6)], "state_ref string, r int, c int, z double")
    g = packed(cells, 5, 6)
    leaves = [(n, 5, 6, t, P.OPS[t], region(1, 2, 3, 4), None, 0.1 if t in ("nearest_value_location", "threshold_fraction") else None) for n in fields for t in ("region_std", "region_mean", "region_argmax", "nearest_value_location", "threshold_fraction")]
    leaves += [(n, 5, 6, "region_std", "std", region(2, 1, 2, 5), None, None) for n in fields]  # two programs of one task
    rec = P.records(P.execute(spark.createDataFrame(leaves, SCHEMA), g), ("direct", "relative")).cache()
    assert rec.count() == 72 and P.tampered(rec.repartition(7), g.repartition(3)).count() == 0
    changes = {
        "answer": ("answer", F.lit("[0.0]")), "values": ("values", F.transform("values", lambda v: v + 1e-3)), "metadata": ("operation_count", F.lit(9)), "question": ("question", F.lit("?")),
        "precision": ("tolerance", F.lit(9.0)), "ties": ("encoding", F.lit("rows")), "qa_id": ("qa_id", F.lit("x")), "missing_state": ("state_ref", F.lit("gone")), "semantic_id": ("semantic_id", F.lit("x")),
    }
    for problem, (column, value) in changes.items():
        assert {r.problem for r in P.tampered(rec.withColumn(column, value), g).collect()} == {problem}, problem


def test_greatest_common_divisor(spark):
    rng = np.random.default_rng(3)
    pairs = [(96, 192), (0, 7), (7, 0), (1, 1), (832040, 514229), (2**62, 2**40 * 3)] + [tuple(map(int, rng.integers(1, 1 << 40, 2))) for _ in range(30)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", N.gcd(F.col("a"), F.col("b")).alias("g")).collect()
    assert all(r.g == math.gcd(r.a, r.b) for r in got)


def test_crops_of_static_and_moving_fields(spark):
    frames = [("f", "u", None, s, t, 3, 4, [float(100 * (s or 0) + 10 * (t or 0) + k) for k in range(12)]) for s in (0, 1) for t in (0, 1)] + [("f", "mask", None, None, None, 3, 4, [float(k) for k in range(12)]), ("f", "v", 1, 0, 0, 2, 2, [1.0, 2.0, 3.0, 4.0])]
    schema = "source_file_id string, field_key string, component int, sample_index int, time_index int, height int, width int, values array<double>"
    frame = spark.createDataFrame(frames, schema)
    want = "source_file_id string, field_key string, component int, sample_index int, time_index int, top int, left int, h int, w int"
    states = [("f", "u", None, 1, 0, 1, 2, 2, 2), ("f", "mask", None, None, None, 0, 0, 1, 3), ("f", "v", 1, 0, 0, 1, 0, 1, 2)]
    got = {r.field_key: r.x for r in grids.crop_states(frame, spark.createDataFrame(states, want)).collect()}
    assert got == {"u": [106.0, 107.0, 110.0, 111.0], "mask": [0.0, 1.0, 2.0], "v": [3.0, 4.0]}
    for bad in (("f", "u", None, 1, 0, 2, 2, 2, 2), ("f", "u", None, 9, 0, 0, 0, 1, 1)):
        with pytest.raises(Exception):
            grids.crop_states(frame, spark.createDataFrame([bad], want)).collect()


def test_partly_annotated_dimensions_fail(spark):
    rows = [("a", "x", None, 1, 1, True, True), ("b", None, None, 1, 0, False, True)]
    sc = spark.createDataFrame(rows, "task string, half string, none string, units int, hits int, all_correct boolean, valid boolean")
    assert {r.dim for r in scoring.summarize(sc, ["task", "none"]).collect()} == {"all", "task"}
    with pytest.raises(Exception, match="half"):
        scoring.summarize(sc, ["task", "half"]).collect()


def test_runs_have_to_hold_the_same_ids(spark):
    a = spark.createDataFrame([("q1", "t", True), ("q2", "t", False)], "qa_id string, task string, ok boolean")
    assert scoring.compare_runs(a, a.withColumn("ok", F.lit(True)), "task", "ok").first().delta_points == 50
    with pytest.raises(ValueError):
        scoring.compare_runs(a, a.limit(1), "task", "ok")


def test_allocation_differs_by_one_at_most(spark):
    groups = [("f1", "a"), ("f1", "b"), ("f1", "c"), ("f2", "d")]
    got = {(r.f, r.s): r.quota for r in sampling.allocation(spark.createDataFrame(groups, "f string, s string"), 11, "f", "s").collect()}
    assert got == {("f1", "a"): 2, ("f1", "b"): 2, ("f1", "c"): 2, ("f2", "d"): 5}


def test_missing_splits_and_states(spark):
    f = spark.createDataFrame([("a", "train"), ("b", None), ("c", "val")], "path string, split string")
    assert [r.split for r in audit.missing_splits(f).collect()] == ["test"]
    have, named = spark.createDataFrame([("s1",)], "state_ref string"), spark.createDataFrame([("s1",), ("s2",), ("s2",)], "state_ref string")
    assert [r.state_ref for r in audit.missing_states(named, have).collect()] == ["s2"]
