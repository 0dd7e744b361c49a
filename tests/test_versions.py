"""Commits of several tables, digest trees, the loader and its checks."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import audit
from fieldloom.plans import build
from fieldloom.sources import versions as V

KEYS = {"a": "k", "b": "name"}


def tables(spark, n=5000, shift=0):
    a = spark.range(n).select(F.col("id").alias("k"), F.when(F.col("id") == 4321, F.col("id") * 2 + shift).otherwise(F.col("id") * 2).alias("x"), F.array(F.lit(1.5), F.lit(None)).alias("z"))
    return {"a": a, "b": spark.createDataFrame([("p", 1), ("q", None)], "name string, v int")}


def fails(df, column):
    return df.withColumn(column, F.raise_error(F.lit("injected")).cast(df.schema[column].dataType))


@pytest.fixture
def folder(tmp_path):
    return f"file://{tmp_path}/set"


def test_old_version_stays_readable_whatever_breaks(spark, folder, monkeypatch):
    first = V.commit(spark, folder, tables(spark), KEYS, {"run": "1"})
    good = {n: t.collect() for n, t in ((n, first.table(n)) for n in KEYS)}

    def unharmed():
        now = V.open_version(spark, folder)
        assert now.number == 1 and now.manifest == first.manifest and {n: now.table(n).collect() for n in KEYS} == good

    with pytest.raises(FileExistsError):
        V.commit(spark, folder, tables(spark), KEYS, {"run": "2"})
    for bad in ("a", "b"):  # a table breaks while it is written
        broken = tables(spark, shift=1)
        broken[bad] = fails(broken[bad], "x" if bad == "a" else "v")
        with pytest.raises(Exception, match="injected"):
            V.commit(spark, folder, broken, KEYS, {"run": "2"}, replace=True)
        unharmed()
    for step in ("tree_of", "open_version", "_log"):  # the trees, and the last steps, break
        with monkeypatch.context() as m:
            real, calls = getattr(V, step), []

            def broken_step(*args, real=real, calls=calls, step=step, **kw):
                calls.append(1)
                if step == "_log" and len(calls) == 1:
                    return real(*args, **kw)
                raise RuntimeError("injected")

            m.setattr(V, step, broken_step)
            with pytest.raises(RuntimeError):
                V.commit(spark, folder, tables(spark, shift=1), KEYS, {"run": "2"}, replace=True)
        if step != "open_version":  # that one fails after the commit
            unharmed()
        else:
            assert V.open_version(spark, folder).number == 2 and V.open_version(spark, folder, 1).table("a").collect() == good["a"]
            V.vacuum(spark, folder, keep=2)
            os.remove([f.path for f in os.scandir(folder[7:] + "/log") if f.name.startswith("00000002")][0])
            unharmed()
    again = V.commit(spark, folder, tables(spark, shift=1), KEYS, {"run": "2"}, replace=True)
    assert again.number == 2 and again.manifest["identity"] == {"run": "2"} and V.open_version(spark, folder, 1).table("a").collect() == good["a"]
    left = V.vacuum(spark, folder, keep=2)
    assert left and V.open_version(spark, folder, 1).table("b").count() == 2 and V.vacuum(spark, folder, keep=2) == []
    V.vacuum(spark, folder, keep=1)
    with pytest.raises(KeyError):
        V.open_version(spark, folder, 1)
    assert V.open_version(spark, folder).number == 2


def test_a_changed_row_is_found_among_few_nodes(spark, folder, monkeypatch):
    monkeypatch.setattr(V, "LEAF", 16)
    monkeypatch.setattr(V, "FANOUT", 4)
    old = V.commit(spark, folder, tables(spark), KEYS, {})
    new = V.commit(spark, folder, tables(spark, shift=1), KEYS, {}, replace=True)
    assert old.tree().filter("name = 'a'").agg(F.max("level")).first()[0] == 5  # 313 leaves
    got = V.differing_leaves(old, new, "a").collect()
    assert [(r.node, r.first_key, r.last_key) for r in got] == [(4321 // 16, str(4321 // 16 * 16), str(4321 // 16 * 16 + 15))]
    assert V.differing_leaves(old, new, "b").count() == 0 and V.differing_leaves(new, new, "a").count() == 0
    longer = V.commit(spark, folder, tables(spark, n=5010, shift=1), KEYS, {}, replace=True)
    assert {r.node for r in V.differing_leaves(new, longer, "a").collect()} == {312, 313}


def test_damage_is_named(spark, folder, monkeypatch):
    monkeypatch.setattr(V, "LEAF", 16)
    version = V.commit(spark, folder, tables(spark), KEYS, {})
    assert V.damage(version).count() == 0 and V.leaf_is_sound(version, "a", 100)
    bent = version.table("a").withColumn("x", F.when(F.col("k") == 77, F.lit(-1).cast("long")).otherwise(F.col("x"))).toPandas()
    spark.createDataFrame(bent, version.table("a").schema).write.mode("overwrite").parquet(f"{version.path}/a")
    spark.catalog.clearCache()
    assert [(r.name, r.node, r.first_key, r.last_key) for r in V.damage(version).collect()] == [("a", 4, "64", "79")]
    assert not V.leaf_is_sound(version, "a", 4) and V.leaf_is_sound(version, "a", 5)


def test_trees_don_t_depend_on_partitions(spark, folder):
    one = {r.digest for r in V.tree_of(tables(spark)["a"], "a", "k").collect()}
    assert one == {r.digest for r in V.tree_of(tables(spark)["a"].repartition(7), "a", "k").collect()}
    assert V.tree_of(tables(spark)["a"].limit(0), "a", "k").count() == 0
    with pytest.raises(FileNotFoundError):
        V.open_version(spark, folder)


# ---------------------------------------------------------------- datasets

SCHEMA = "source_id string, family string, source_file_id string, field_key string, component int, sample_index int, time_index int, height int, width int, values array<double>"


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(5)
    rows = [("a", "f", f"a{i % 2}", "u", None, i, t, 6, 7, rng.normal(size=42).round(3).tolist()) for i in range(20) for t in range(3)]
    return build.build_dataset(spark, spark.createDataFrame(rows, SCHEMA), CONFIG)


CONFIG = build.BuildConfig(train_states=30, eval_states=8, heights=(2, 5), widths=(2, 6), tasks_per_state=3, diagnostic_states=2)


def change(d, **tables):
    return build.Dataset(**{n: tables.get(n, getattr(d, n)) for n in ("states", "grids", "records", "diagnostics", "splits")})


def test_the_loader_names_what_is_wrong(spark, data, tmp_path):
    one = data.states.filter("split = 'val'").orderBy("state_ref").first()
    ref = F.col("state_ref") == one.state_ref
    faults = {
        "budget": {"states": data.states.filter(~ref)},
        "leak": {"splits": data.splits.withColumn("split", F.when((F.col("source_file_id") == one.source_file_id) & (F.col("sample_index") == one.sample_index), "train").otherwise(F.col("split")))},
        "grid": {"grids": data.grids.withColumn("h", F.when(ref, F.col("h") + 1).otherwise(F.col("h")))},
        "wording": {"records": data.records.withColumn("language_group", F.when(ref, "heldout").otherwise(F.col("language_group")))},
    }
    sound = f"file://{tmp_path}/sound"
    build.publish(data, sound, CONFIG)
    loaded, _ = build.load_dataset(spark, sound, scan=True)
    assert loaded.shortfall(CONFIG).filter("missing > 0").count() == 0 and loaded.counters().count() == data.counters().count()
    for problem, tables_ in faults.items():
        folder = f"file://{tmp_path}/{problem}"
        build.publish(change(data, **tables_), folder, CONFIG)
        with pytest.raises(ValueError, match=problem):
            build.load_dataset(spark, folder)


def test_a_broken_publish_leaves_the_old_set(spark, data, tmp_path):
    folder = f"file://{tmp_path}/set"
    build.publish(data, folder, CONFIG)
    before = build.load_dataset(spark, folder)[0].records.count()
    for table, column in (("states", "field"), ("grids", "h"), ("records", "answer"), ("diagnostics", "answer"), ("splits", "split")):
        with pytest.raises(Exception, match="injected"):
            build.publish(change(data, **{table: fails(getattr(data, table), column)}), folder, CONFIG, replace=True)
        loaded, version = build.load_dataset(spark, folder)
        assert version.number == 1 and loaded.records.count() == before
    assert build.publish(data, folder, CONFIG, replace=True).number == 2


def test_first_frames_that_trajectories_share(spark):
    grid = lambda x: [float(x)] * 4
    rows = [("s", "f", "u", None, i, t, 2, 2, grid(10 * (i % 2) + t + (100 if i == 2 and t == 1 else 0))) for i in range(4) for t in range(2)] + [("s", "f", "mask", None, None, None, 2, 2, grid(7))]
    frames = spark.createDataFrame(rows, "source_id string, source_file_id string, field_key string, component int, sample_index int, time_index int, height int, width int, values array<double>")
    d = {r.sample_index: (r.digest, r.initial) for r in audit.trajectory_digests(frames).collect()}
    assert len(d) == 4 and d[1] == d[3] and d[0][1] == d[2][1] and d[0][0] != d[2][0] and d[0][1] != d[1][1]
    splits = spark.createDataFrame([("s", "f", i, "train" if i < 3 else "test") for i in range(4)], "source_id string, source_file_id string, sample_index int, split string")
    got = {r.initial: (r.trajectories, r["distinct"], r.splits) for r in audit.shared_initial_states(audit.trajectory_digests(frames), splits).collect()}
    assert got == {d[0][1]: (2, 2, 1), d[1][1]: (2, 1, 2)}
    other = frames.withColumn("values", F.when(F.col("field_key") == "mask", F.array(*[F.lit(8.0)] * 4)).otherwise(F.col("values")))
    assert not {r.initial for r in audit.trajectory_digests(other).collect()} & {x for _, x in d.values()}
