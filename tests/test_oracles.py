"""Every registered query against its SQL, on the smallest tables."""

import os

import pytest

duckdb = pytest.importorskip("duckdb")

from fieldloom.plans.oracle import ORACLE  # noqa: E402
from fieldloom.plans.queries import REGISTRY  # noqa: E402

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{FOLDER}/{t}.parquet')")
    return c


def plain(v):
    return repr(v + 0.0) if isinstance(v, float) else repr(v)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, db, name):
    df = REGISTRY[name](spark, FOLDER)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = db.execute(ORACLE[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in result.fetchall()), key=str)
    assert got == want


def test_question_texts(spark):
    """Every family words every program, in its own way and with the program's numbers."""
    from fieldloom.functions.labels import TASKS, TEMPLATES

    rows = REGISTRY["record_questions"](spark, FOLDER).filter("state_ref in ('emb:0', 'emb:7')").collect()
    families = [t for names in TEMPLATES.values() for t in names]
    assert len(rows) == 2 * len(TASKS) * len(families)
    by = {(r.state_ref, r.task, r.template_family): r.question for r in rows}
    for state in ("emb:0", "emb:7"):
        for task in TASKS:
            texts = [by[state, task, f] for f in families]
            assert len(set(texts)) == len(families) and all("null" not in t for t in texts)
            place = task in ("region_argmin", "region_argmax", "nearest_value_location")
            assert all(t.endswith("any tied cell counts." if place else "numbers only.") for t in texts)
    assert "(8, 1)" in by["emb:7", "single_point", "direct"] and "7 down, 0 right" in by["emb:7", "single_point", "relative"]


def test_sampled_programs(spark):
    from fieldloom.functions.labels import TASKS
    from fieldloom.operators.programs import LIMITS

    got = {r.task: r for r in REGISTRY["sampled_programs"](spark, FOLDER).collect()}
    assert set(got) == set(TASKS) and all(r.problems == 0 and r.programs == 500 for r in got.values())
    assert got["single_point"].most == 1 and 2 <= got["multi_point"].fewest <= got["multi_point"].most <= LIMITS["read"] and got["region_values"].most <= LIMITS["region_values"]


def test_changed_answers(spark):
    got = REGISTRY["changed_answers"](spark, FOLDER).collect()
    ids = [x for r in got for x in (r.qa_id, r.other_qa_id)]
    assert len(got) == 128 and len(set(ids)) == 256 and len({r.pair_id for r in got}) == 128


def test_dataset_queries(spark):
    counts = {}
    for r in REGISTRY["dataset_build"](spark, FOLDER).collect():
        counts.setdefault((r.split, r.dim), {})[r.key] = (r.records, r.states)
    for split, budget in (("train", 240), ("val", 48), ("test", 48)):
        assert {k: v[1] for k, v in counts[split, "family"].items()} == {"trade": budget // 2, "use": budget // 2}
        assert len({sum(v[0] for v in counts[split, dim].values()) for dim in ("family", "source_id", "field", "shape", "task", "capability", "difficulty")}) == 1
    assert REGISTRY["dataset_audit"](spark, FOLDER).collect() == []


def test_file_verification(spark):
    import hashlib

    rows = {r.name: r for r in REGISTRY["file_verification"](spark, FOLDER).collect()}
    assert set(rows) == {f"{t}.parquet" for t in TABLES}
    for name, r in rows.items():
        with open(f"{FOLDER}/{name}", "rb") as f:
            body = f.read()
        assert (r.size_bytes, r.sha256, r.same, r.changed) == (len(body), hashlib.sha256(body).hexdigest(), True, False)


def test_every_query_is_tested():
    assert set(REGISTRY) - set(ORACLE) == {"record_questions", "sampled_programs", "changed_answers", "dataset_build", "dataset_audit", "file_verification"}


def test_error_counts_keep_a_small_plan(spark):
    """A filter on the error, pushed below all that it is made from, made a plan of 7.6 million characters."""
    plan = REGISTRY["score_errors"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 500_000
