"""Dataset builds: budgets, splits, crops, replay, training arrays, and what has to fail."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import programs as P
from fieldloom.plans import build

SCHEMA = "source_id string, family string, source_file_id string, field_key string, component int, sample_index int, time_index int, height int, width int, values array<double>"


@pytest.fixture(scope="module")
def frames(spark):
    rng = np.random.default_rng(5)
    rows = []
    for source, family, fields in (("a", "f1", [("u", None), ("v", 0), ("v", 1)]), ("b", "f1", [("p", None)]), ("c", "f2", [("q", None)])):
        for sample in range(24):
            for t in range(4):
                rows += [(source, family, f"{source}{sample % 2}", k, c, sample, t, 6, 7, rng.normal(size=42).round(3).tolist()) for k, c in fields]
    rows += [("c", "f2", "c0", "mask", None, None, None, 6, 7, [float(i % 5) for i in range(42)])]
    return spark.createDataFrame(rows, SCHEMA).cache()


CONFIG = build.BuildConfig(train_states=130, eval_states=30, heights=(1, 5), widths=(1, 6), tasks_per_state=4, diagnostic_states=3)


@pytest.fixture(scope="module")
def data(spark, frames):
    return build.build_dataset(spark, frames, CONFIG)


def test_budgets_and_disjoint_crops(data):
    states = data.states.toPandas()
    assert states.groupby("split").size().to_dict() == {"train": 130, "val": 30, "test": 30}
    by = states.groupby(["split", "family"]).size()
    assert by["train", "f1"] == by["train", "f2"] == 65 and states.groupby(["split", "source_id"]).size()["train", "a"] == 33
    assert states.state_ref.is_unique
    own = states.assign(sample_index=states.sample_index.fillna(-1), time_index=states.time_index.fillna(-1), component=states.component.fillna(-1))
    assert not own.duplicated(list(build.IDENTITY)).any()
    moving = states[states.sample_index.notna()]
    assert (moving.groupby(["source_id", "source_file_id", "sample_index"]).split.nunique() == 1).all()
    assert states[states.field == "mask"][["sample_index", "time_index"]].isna().all().all() and (states.field == "mask").sum() > 10
    assert {"u", "v[0]", "v[1]", "p", "q", "mask"} == set(states.field)


def test_plans_cover_corners_trajectories_and_heldout_shapes(data):
    states = data.states.toPandas()
    for (_, source), rows in states.groupby(["split", "source_id"]):
        corners = {(h, w) for h in (1, 5) for w in (1, 6)}
        if len(rows) >= 4 * rows.field.nunique():
            assert {(h, w, f) for h, w in corners for f in rows.field.unique()} <= set(zip(rows.h, rows.w, rows.field, strict=True)), source
    train = states[(states.split == "train") & states.sample_index.notna()]
    turns = train.groupby(["source_id", "field", "source_file_id", "sample_index"]).size()
    assert turns.groupby(level=["source_id", "field"]).agg(lambda x: x.max() - x.min()).max() <= 1  # none again before all
    seen = set(zip(train.h, train.w, strict=True))
    assert {(h, w) for h, w in zip(states[states.split == "val"].h, states[states.split == "val"].w, strict=True)} - seen


def test_grids_are_standardized_crops(data, frames):
    z = {r.state_ref: r for r in data.grids.collect()}
    raw = {(r.source_file_id, r.field_key, r.component, r.sample_index, r.time_index): np.array(r["values"]).reshape(6, 7) for r in frames.collect()}
    for r in data.states.collect():
        x = raw[r.source_file_id, r.field_key, r.component, r.sample_index, r.time_index][r.top : r.top + r.h, r.left : r.left + r.w]
        want = np.zeros_like(x) if x.min() == x.max() else ((x - x.mean()) / (x.std() + 1e-6)).astype(np.float16).astype(float)
        got = np.array(z[r.state_ref].z).reshape(r.h, r.w)
        assert np.allclose(got, want, atol=2e-3) and r.is_constant == (x.min() == x.max())
        d = np.concatenate([np.diff(got, axis=0).ravel(), np.diff(got, axis=1).ravel()])
        assert r.roughness == pytest.approx(0.0 if r.is_constant or not len(d) else float(np.sqrt((d**2).mean())), abs=1e-9)


def test_records_replay_and_counters(data):
    assert P.tampered(data.records, data.grids).count() == 0 and P.tampered(data.diagnostics, data.grids).count() == 0
    per = [r["count"] for r in data.records.groupBy("state_ref").count().collect()]
    assert len(per) == 190 and max(per) == 4
    counts = data.counters().toPandas()
    for dim, rows in counts.groupby("dim"):
        assert rows.records.sum() == data.records.count(), dim
    assert data.coverage().filter("split = 'train'").agg(F.sum("sampled_crops")).first()[0] == 130
    groups = {(r.state_ref, r.semantic_id): r.g for r in data.diagnostics.groupBy("state_ref", "semantic_id").agg(F.sort_array(F.collect_list("language_group")).alias("g")).collect()}
    assert groups and set(map(tuple, groups.values())) == {("heldout", "seen")}


def test_same_rows_whatever_the_partitions(spark, frames, data):
    again = build.build_dataset(spark, frames.repartition(3), CONFIG)
    key = lambda d: sorted(d.records.select("qa_id", "answer").collect())
    assert key(again) == key(data)


def test_publish_and_training_arrays(spark, data, tmp_path):
    build.publish(data, f"file://{tmp_path}/set", CONFIG)
    with pytest.raises(FileExistsError):
        build.publish(data, f"file://{tmp_path}/set", CONFIG)
    loaded, version = build.load_dataset(spark, f"file://{tmp_path}/set", scan=True)
    assert version.table("records").groupBy("split").count().count() == 3
    for name in ("states", "records", "diagnostics", "splits"):
        assert getattr(loaded, name).exceptAll(getattr(data, name)).count() == 0 == getattr(data, name).exceptAll(getattr(loaded, name)).count()
    assert version.manifest["identity"]["config"]["train_states"] == 130 and len(version.manifest["identity"]["run"]) == 64
    words = lambda texts: texts.map(lambda t: [len(w) for w in t.split()])
    rows = build.training_arrays(data, "val", words, end_id=9).orderBy("token_offset").collect()
    assert len(rows) == data.records.join(data.states.filter("split = 'val'").select("state_ref"), "state_ref", "left_semi").count()
    assert [r.token_offset for r in rows] == np.cumsum([0] + [r.tokens for r in rows])[:-1].tolist() and all(r.target[-1] == 9 and r.tokens == len(r.prompt) + len(r.target) for r in rows)
    assert all(build.byte_tokens(pd.Series(["é"])).map(lambda x: x == [195, 169]))
    with pytest.raises(Exception):
        build.training_arrays(data, "val", prompt_limit=3).collect()


def test_bad_configurations_and_budgets_fail(spark, frames):
    small = dict(train_states=5, eval_states=5, heights=(1, 2), widths=(1, 2))
    for bad in ({"train_states": 0}, {"tasks": ("single_point", "single_point")}, {"capability_weights": {"readout": 0.0}}, {"tasks_per_state": 0}):
        with pytest.raises(ValueError):
            build.BuildConfig(**{**small, **bad}).check()
    with pytest.raises(ValueError, match="too few"):
        build.build_dataset(spark, frames.filter("sample_index < 10"), build.BuildConfig(**small))
    one = frames.filter("source_id = 'b' and time_index = 0")
    with pytest.raises(ValueError, match="distinct crops"):
        build.sampled_states(spark, one, build.trajectory_partition(one, 1, 20), build.BuildConfig(train_states=1200, eval_states=1, heights=(6, 6), widths=(7, 7), attempts=2))
