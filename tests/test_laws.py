"""Laws of draws, loads of shards, and reports that merge."""

import itertools
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldloom.functions import numeric as N
from fieldloom.operators import batching as B, programs as P, sampling as S


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 49, 64, 100, 720])
def test_permuted_is_a_permutation(spark, n):
    rows = spark.range(n).select(N.permuted(F.col("id"), F.lit(n), "seed", n).alias("x"), N.permuted(F.col("id"), F.lit(n), "other", n).alias("y")).collect()
    assert sorted(r.x for r in rows) == list(range(n)) == sorted(r.y for r in rows)
    assert n < 8 or [r.x for r in rows] != [r.y for r in rows]


def test_first_pairs_are_uniform(spark):
    """Over 6,000 keys every ordered pair of five cells comes first about equally often (chi-square with 19 degrees of freedom, 0.9999 quantile 50.8)."""
    rows = spark.range(6000).select(*[N.permuted(F.lit(i), F.lit(5), "k", F.col("id")).alias(f"p{i}") for i in range(2)]).collect()
    seen = Counter((r.p0, r.p1) for r in rows)
    assert len(seen) == 20 and sum((v - 300) ** 2 / 300 for v in seen.values()) < 50.8


def law(items, weights, k):
    """Probability of every ordered draw, by enumeration."""
    out = {}

    def go(rest, done, p):
        if len(done) == min(k, len(items)):
            out[done] = out.get(done, 0) + p
            return
        share = [weights[kind] / sum(y == kind for _, y in rest) for _, kind in rest]
        for (task, kind), w in zip(rest, share, strict=True):
            go([x for x in rest if x[0] != task], (*done, task), p * w / sum(share))

    go(items, (), 1.0)
    return out


@pytest.mark.parametrize("k", [1, 2, 3])
def test_sequential_draws_follow_the_enumerated_law(spark, k):
    items, weights = [("a", "x"), ("b", "x"), ("c", "y"), ("d", "z"), ("e", "x")], {"x": 4.0, "y": 3.0, "z": 1.0}
    array = F.array(*[F.struct(F.lit(t).alias("task"), F.lit(g).alias("kind")) for t, g in items])
    n = 20_000
    got = Counter(tuple(r.d) for r in spark.range(n).select(S.sequential_draw(array, weights, k, 5, F.col("id")).alias("d")).collect())
    want = law(items, weights, k)
    assert set(got) <= set(want) and abs(sum(want.values()) - 1) < 1e-12
    assert sum((got[x] - n * p) ** 2 / (n * p) for x, p in want.items()) < len(want) + 5 * (2 * len(want)) ** 0.5
    # not the law of fixed weights: two of x in a row are likelier than that law has it
    assert all(len(x) == k and len(set(x)) == k for x in got)


def test_sequential_draw_of_fewer_items(spark):
    items = F.array(F.struct(F.lit("a").alias("task"), F.lit("x").alias("kind")), F.struct(F.lit("b").alias("task"), F.lit("y").alias("kind")))
    got = spark.range(50).select(S.sequential_draw(items, {}, 4, F.col("id")).alias("d"), S.sequential_draw(F.slice(items, 1, 0), {}, 4, F.col("id")).alias("e")).collect()
    assert all(sorted(r.d) == ["a", "b"] and r.e == [] for r in got)


def test_shortfall(spark):
    groups = spark.createDataFrame([("s1", "train"), ("s2", "train"), ("s3", "val")], "k string, split string")
    made = spark.createDataFrame([("s1",)] * 4 + [("s2",)] * 2, "k string")
    assert {tuple(r) for r in S.shortfall(groups, made, 4, "split", "k").collect()} == {("train", 2, 8, 6, 2), ("val", 1, 4, 0, 4)}


def test_sampled_points_are_distinct_and_second_regions_differ(spark):
    states = spark.createDataFrame([(f"s{i}", h, w) for i, (h, w) in enumerate([(1, 2), (2, 1), (2, 2), (1, 3), (3, 3), (40, 7)] * 40)], "state_ref string, h int, w int")
    drawn = P.sample_programs(states, 3, ("multi_point", "region_mean_difference"))
    assert P.violations(drawn.withColumn("target", F.lit(0.0))).count() == 0
    rows = drawn.collect()
    two = [r for r in rows if r.task == "region_mean_difference"]
    assert len(two) == 240 and all(r.left != r.right for r in two)
    big = [r for r in two if r.h == 3]
    singles = sum((r.right[0].r1, r.right[0].c1) == (r.right[0].r2, r.right[0].c2) for r in big)
    assert singles < len(big)  # redrawn, not all replaced by single cells


@pytest.mark.parametrize(("sizes", "shards"), [([1] * 100, 7), ([1000, 900, 10, 10] + [1] * 300, 4), ([5000] + [3] * 50, 3), ([60, 60, 60, 60, 60], 2), ([7], 3), (list(range(1, 60)), 5)])
def test_shards_are_balanced(spark, sizes, shards):
    rows = spark.createDataFrame([(f"s{i}", j) for i, n in enumerate(sizes) for j in range(n)], "state_ref string, j int")
    placed = B.least_loaded_shards(rows, shards).collect()
    assert sorted(r.state_ref for r in placed) == sorted(f"s{i}" for i in range(len(sizes))) and sum(r.n for r in placed) == sum(sizes)
    loads = Counter()
    for r in placed:
        assert 0 <= r.shard < shards
        loads[r.shard] += r.n
    mean = sum(sizes) / shards
    assert max(loads.values()) <= max(4 / 3 * mean, max(sizes)) + max(n for n in sizes if n * shards * 16 <= sum(sizes) or n == min(sizes))


def test_filled_levels():
    for loads, room in (([0, 0, 0], 7), ([5, 0, 2], 3), ([5, 0, 2], 100), ([9], 0), ([3, 3], 1)):
        out = B._filled(loads, room)
        full = [a + b for a, b in zip(loads, out, strict=True)]
        assert sum(out) == room and min(out) >= 0 and max((f for f, o in zip(full, out, strict=True) if o), default=0) <= min(full) + 1


def test_reports_of_parts_merge_to_that_of_the_whole(spark):
    rows = [(i, f"q{i}", f"t{i % 3}", "direct", (i * 37) % 100, (i * 53) % 41) for i in range(200)]
    df = spark.createDataFrame([(*r, r[0] % 4, r[0] // 50, (r[0] * 7) % 11 % 3) for r in rows], "position long, qa_id string, task string, template_family string, prompt_tokens int, target_tokens int, a int, b int, c int")
    whole = B.token_budget_report(df, 90, 38).collect()[0]
    over = [r for r in rows if r[4] > 90 or r[5] > 38]
    assert whole.overflow == len(over) and [x.position for x in whole.examples] == [r[0] for r in over[:8]] and whole.status == "overflow"
    assert whole.max_prompt_tokens == 99 and whole.max_prompt_record.position == next(r[0] for r in rows if r[4] == 99)
    for part in ("a", "b", "c"):
        parts = B.token_budget_report(df, 90, 38, [part])
        merged = B.merged_token_reports(parts).select(*whole.asDict())
        assert merged.collect()[0] == whole
        steps = [p for (p,) in parts.select(part).collect()]
        for order in itertools.permutations(steps, 2):  # two first, then the rest
            two = B.merged_token_reports(parts.filter(F.col(part).isin(*order)))
            rest = parts.filter(~F.col(part).isin(*order)).drop(part)
            assert B.merged_token_reports(two.unionByName(rest)).select(*whole.asDict()).collect()[0] == whole
            break
    none = B.token_budget_report(df, 1000, 1000).collect()[0]
    assert none.status == "ok" and none.examples == [] and none.overflow == 0


def test_block_diagnostics_equal_listed_cells(spark):
    import random

    rng = random.Random(4)
    spans = "array<struct<pos:int,r1:int,r2:int,c1:int,c2:int>>"
    rows, want = [], {}
    for i in range(300):
        points = lambda n: [(k, r, r, c, c) for k, (r, c) in enumerate(rng.sample([(r, c) for r in range(1, 10) for c in range(1, 12)], n))]

        def region():
            r, c = sorted(rng.choices(range(1, 30), k=2)), sorted(rng.choices(range(1, 25), k=2))
            return [(0, r[0], r[1], c[0], c[1])]

        left, right = [(points(3), None), (points(1), points(1)), (region(), None), (region(), region())][i % 4]
        rows.append((f"s{i}", "t", left, right))
        cells = {(r, c) for s in left + (right or []) for r in range(s[1], s[2] + 1) for c in range(s[3], s[4] + 1)}
        blocks = {((r - 1) // 4, (c - 1) // 5) for r, c in cells}
        want[f"s{i}"] = (len(blocks), sum(r % 4 == 0 or c % 5 == 0 for r, c in cells) / len(cells), "single_block" if len(blocks) == 1 else "multiple_blocks")
    df = spark.createDataFrame(rows, f"state_ref string, task string, left {spans}, right {spans}")
    got = {r.state_ref: (r.distinct_blocks, r.boundary_point_fraction, r.block_relation) for r in P.block_diagnostics(df, 4, 5).collect()}
    assert {k: (a, round(b, 12), c) for k, (a, b, c) in got.items()} == {k: (a, round(b, 12), c) for k, (a, b, c) in want.items()}


def test_a_program_without_its_state_fails(spark):
    p = spark.createDataFrame([("gone", "region_mean", "mean", 0.0, [(0, 1, 1, 1, 1)], None)], "state_ref string, task string, op string, target double, left array<struct<pos:int,r1:int,r2:int,c1:int,c2:int>>, right array<struct<pos:int,r1:int,r2:int,c1:int,c2:int>>")
    grids = spark.createDataFrame([("here", 1, 1, [0.0])], "state_ref string, h int, w int, z array<double>")
    with pytest.raises(Exception, match="no grid for state gone"):
        P.execute(p, grids).collect()


def test_older_programs_keep_to_what_is_configured(spark):
    states = spark.createDataFrame([(f"s{i}", *[(4, 5), (5, 4), (9, 3), (3, 9)][i % 4]) for i in range(80)], "state_ref string, h int, w int")
    drawn = P.sample_legacy(states, 2, areas=((2, 2), (3, 3), (4, 4)))
    assert P.violations(drawn.withColumn("target", F.lit(0.0))).filter("problem <> 'whole_grid'").count() == 0
    assert P.unit_lines(drawn).count() == drawn.filter("task = 'line_profile'").count() == 80
    sizes = Counter((r.task, len(r.left) if r.task in ("multi_point", "line_profile") else (r.left[0].r2 - r.left[0].r1 + 1, r.left[0].c2 - r.left[0].c1 + 1)) for r in drawn.collect())
    assert {n for t, n in sizes if t == "multi_point"} == {2, 3, 4} and {n for t, n in sizes if t == "line_profile"} == {3, 4, 5}
    assert {n for t, n in sizes if t == "region_values"} == {(2, 2)} and {n for t, n in sizes if t == "region_mean"} == {(2, 2), (3, 3), (4, 4)}
    with pytest.raises(Exception, match="no configured selector fits"):
        P.sample_legacy(spark.createDataFrame([("s", 1, 2)], "state_ref string, h int, w int"), tasks=("line_profile",)).collect()


def test_batches_are_balanced_many_at_a_time(spark):
    """Parts are those of the definition, in bulk and not by a call a batch."""
    import random

    from fieldloom.operators import batching

    rng = random.Random(3)
    rows = [(b, 100 * b + i, rng.choice([1, 2, 2, 5, 9, 40])) for b in range(60) for i in range(rng.randint(1, 20))]
    found = batching.length_balanced(spark.createDataFrame(rows, "batch int, id long, length int"), 3)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().executedPlan().toString()
    got = {(r.batch, r.id): (r.length, r.part) for r in found.collect()}
    assert len(got) == len(rows)
    for b in range(60):
        own = sorted((r for r in rows if r[0] == b), key=lambda r: (-r[2], r[1]))
        parts = [[], [], []]
        for _, i, length in own:
            cost = lambda p: max(p, default=0) * len(p)
            free = [p for p in range(3) if len(parts[p]) < -(-len(own) // 3)]
            p = min(free, key=lambda p: (cost([*parts[p], length]) - cost(parts[p]), -max(parts[p], default=0), p))
            parts[p].append(length)
            assert got[b, i] == (length, p)
