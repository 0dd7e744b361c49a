import json

import pytest

from fieldloom.operators import batching, programs as P
from fieldloom.plans import config


def test_profiles_variables_and_identity(tmp_path, monkeypatch):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"a": {"x": 1, "y": [1]}, "output": "o", "profiles": {"small": {"a": {"y": [2]}}}}))
    small = config.load(str(path), "small")
    assert small == {"a": {"x": 1, "y": [2]}, "output": "o"}
    assert config.identity(small) == config.identity(small | {"output": "p"}) != config.identity(config.load(str(path)))
    monkeypatch.setenv("GRID_ROOT", "/data")
    assert config.expanded("${GRID_ROOT}/x") == "/data/x"
    for bad in ("${NOT_SET_HERE}/x",):
        with pytest.raises(ValueError):
            config.expanded(bad)
    with pytest.raises(ValueError):
        config.load(str(path), "none")


@pytest.mark.parametrize("policy", [{"caps": {"a": 0}}, {"caps": {"a": True}}, {"weights": {"a": float("inf")}}, {"budgets": {"a": 1}, "total": 2}])
def test_policy_checks(policy):
    config.check_policy({"caps": {"a": 3}, "weights": {"a": 0.5}, "budgets": {"a": 2}, "total": 2})
    with pytest.raises(ValueError):
        config.check_policy(policy)


def test_order_helpers_and_unit_lines(spark):
    rows = spark.createDataFrame([("a", 2), ("b", 1), ("a", 1)], "qa_id string, k int")
    assert sorted((r.qa_id, r.k) for r in batching.first_of_each(rows, "qa_id", "k").collect()) == [("a", 1), ("b", 1)]
    order = spark.createDataFrame([("b", 0), ("a", 1)], "qa_id string, pos int")
    assert [r.qa_id for r in batching.in_order_of(rows, order).collect()] == ["b", "a", "a"]
    lines = [("x", "line_profile", [(0, 1, 1, 1, 1), (1, 1, 1, 2, 2)]), ("y", "line_profile", [(0, 1, 1, 3, 3), (1, 1, 1, 1, 1)])]
    df = spark.createDataFrame(lines, f"state_ref string, task string, left {P.SPANS}")
    assert [r.state_ref for r in P.unit_lines(df).collect()] == ["x"]


def run_config():
    return {
        "training": {"batch_size": 8, "gradient_accumulation_steps": 1, "epochs": 1, "max_prompt_tokens": 9, "max_target_tokens": 4, "log_interval": 1, "save_every_updates": 1, "eval_every_updates": 1, "max_updates": None, "lr": 1e-4, "gate_lr": 1e-3, "grad_clip_norm": 1.0},
        "evaluation": {"max_new_tokens": 4}, "runtime": {}, "memory": {}, "model": {"torch_dtype": "float32"}, "cross_attention": {"layers_1based": [2, 4], "heads": 2, "bridge_dim": 8},
    }


def test_run_configuration():
    from fieldloom.plans.config import run_problems

    assert run_problems(run_config()) == []
    changes = {
        "training.batch_size": True, "training.lr": float("nan"), "training.max_updates": 0, "runtime.max_micro_batch_size": 0, "runtime.auto_micro_batch": 1, "runtime.micro_batch_token_budget": -1, "runtime.eval_parity_check_questions": 1.5,
        "evaluation.max_new_tokens": 3, "training.value_reconstruction_weight": -1, "cross_attention.layers_1based": [2, 2], "cross_attention.bridge_dim": 7, "model.torch_dtype": "float16", "memory.block_shape": [0, 1],
    }
    for name, value in changes.items():
        config = run_config()
        section, key = name.split(".")
        config[section][key] = value
        assert [p.split(":")[0] for p in run_problems(config)] == [name], name


def test_sinks_and_command_line(spark, tmp_path, capsys):
    from fieldloom.__main__ import main
    from fieldloom.sources import files

    df = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    files.write_csv(df, f"file://{tmp_path}/c")
    assert sorted(spark.read.option("header", "true").csv(f"file://{tmp_path}/c").collect()) == [("1", "a"), ("2", None)]
    for step in (1, 2, 2):
        files.append_log(df.limit(1), f"file://{tmp_path}/log", step)
    assert spark.read.json(f"file://{tmp_path}/log").count() == 2
    files.publish(df, f"file://{tmp_path}/t")
    assert spark.read.parquet(f"file://{tmp_path}/t").count() == 2 and not (tmp_path / "t.building").exists()
    for bad in (lambda: files.publish(df, f"file://{tmp_path}/t"), lambda: files.write_csv(spark.sql("select array(1) as a"), f"file://{tmp_path}/x")):
        with pytest.raises((FileExistsError, ValueError)):
            bad()
    assert main(["--list"]) == 0 and "region_mean:" in capsys.readouterr().out
    spark.sql("select 1 as n_nationkey").write.parquet(f"file://{tmp_path}/d/nation.parquet")
    assert main(["schedule", f"file://{tmp_path}/d", "--out", f"file://{tmp_path}/o", "--format", "json"]) == 0
    assert spark.read.json(f"file://{tmp_path}/o").first().step == 1
