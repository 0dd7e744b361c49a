"""Building a question dataset: splits, budgets, crops, grids, programs, records, counters and training arrays.

Every draw is a hash of the seed and of what is drawn for, so a build gives the same rows however
it is dealt to tasks, and one source's rows don't depend on the others.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import labels as L
from ..functions.numeric import draw, order_key
from ..operators import audit, batching, normalize, programs as P, sampling
from ..sources import versions
from ..sources.grids import crop_states
from ..sources.tables import written
from .config import identity as run_identity

#: Of a frame: source_id, family and these, then height, width, values (row-major); nulls as crop_states has them.
FRAME = ("source_file_id", "field_key", "component", "sample_index", "time_index")
IDENTITY = ("source_id", *FRAME, "top", "left", "h", "w")
SPLITS = ("train", "val", "test")


@dataclass(frozen=True)
class BuildConfig:
    """Budgets are states; tasks_per_state of null takes every task that fits a state's shape."""

    train_states: int
    eval_states: int
    heights: tuple[int, int]
    widths: tuple[int, int]
    heldout_fraction: float = 0.2
    tasks: tuple[str, ...] = L.TASKS
    tasks_per_state: int | None = None
    capability_weights: dict[str, float] = field(default_factory=dict)
    diagnostic_states: int = 16
    attempts: int = 100
    least_trajectories: int = 20
    seed: int = 1

    def check(self) -> None:
        if min(self.train_states, self.eval_states, self.attempts) < 1:
            raise ValueError("budgets and attempts must be positive")
        if not self.tasks or len(set(self.tasks)) != len(self.tasks) or set(self.tasks) - set(L.TASKS):
            raise ValueError("select unique supported tasks")
        if self.tasks_per_state is not None and self.tasks_per_state < 1:
            raise ValueError("tasks_per_state must be positive or null")
        if any(not 0 < w < float("inf") for w in self.capability_weights.values()):
            raise ValueError("capability weights must be positive and finite")


@dataclass
class Dataset:
    states: DataFrame
    grids: DataFrame
    records: DataFrame
    diagnostics: DataFrame
    splits: DataFrame

    def counters(self) -> DataFrame:
        """Records and states of each split, by family, source, field, shape, task, capability and difficulty."""
        rows = self.records.join(self.states.select("state_ref", "split", "family", "source_id", "field"), "state_ref").withColumn("shape", L.shape_label(F.col("h"), F.col("w")))
        return audit.counters(rows, "split", ["family", "source_id", "field", "shape", "task", "capability", "difficulty"])

    def shortfall(self, config: BuildConfig) -> DataFrame:
        """Per split, records wanted and made; missing ones are tasks that a state's shape doesn't allow."""
        return sampling.shortfall(self.states, self.records, config.tasks_per_state or len(config.tasks), "split", "state_ref")

    def coverage(self) -> DataFrame:
        """Distinct files, trajectories, frames, corners, shapes and crops by split and source."""
        one = {"source_files": ["source_file_id"], "trajectories": ["source_file_id", "sample_index"], "field_trajectories": ["source_file_id", "field", "sample_index"], "field_frames": ["source_file_id", "field", "sample_index", "time_index"]}
        return audit.coverage(self.states, ["split", "source_id"], {**one, "top_left_coordinates": ["top", "left"], "shapes": ["h", "w"], "sampled_crops": ["state_ref"]})


def trajectory_partition(frames: DataFrame, seed: int, least: int) -> DataFrame:
    """(source_id, source_file_id, sample_index, split): 80/10/10 of each source's trajectories in hash order. A source with too few fails."""
    one = frames.filter("sample_index is not null").select("source_id", "source_file_id", "sample_index").distinct()
    order = F.concat_ws(":", "source_id", order_key(seed, "split", F.col("source_id"), F.col("source_file_id"), F.col("sample_index")))
    placed = sampling.ranked(one.withColumn("order_", order), "order_", "place")
    bases = placed.groupBy("source_id").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    few = [r.source_id for r in bases.filter(F.col("n") < least).collect()]  # sources, of which there are few
    if few:
        raise ValueError(f"too few trajectories: {few}")
    i, n = F.col("place") - F.col("first"), F.col("n")
    split = F.when(i < F.floor(n * 8 / 10), "train").when(i < F.floor(n * 9 / 10), "val").otherwise("test")
    return placed.join(bases, "source_id").select("source_id", "source_file_id", "sample_index", split.alias("split"))


def state_plan(spark: SparkSession, fields: DataFrame, config: BuildConfig) -> DataFrame:
    """(split, source_id, family, i, h, w, field_key, component, visit): each split's budget over families, then sources; per source every corner shape with every field, then drawn shapes with the fields in turn.

    fields: (source_id, family, fields array<struct<field_key,component>>), a row per source. Evaluation alternates held-out and training shapes.
    """
    pools = written(sampling.shape_pools(spark, config.heights, config.widths, config.heldout_fraction, config.seed), "pools")
    named = pools.select("pool", "h", "w").unionByName(pools.filter("anchor").select(F.lit("anchor").alias("pool"), "h", "w"))  # corners are training shapes, too
    numbered = named.withColumn("j", F.row_number().over(Window.partitionBy("pool").orderBy("h", "w")) - 1)  # at most all shapes
    sizes = {r.pool: r.n for r in numbered.groupBy("pool").agg(F.count("*").alias("n")).collect()}
    budget = lambda split: config.train_states if split == "train" else config.eval_states
    quotas = [sampling.allocation(fields.select("family", "source_id"), budget(s), "family", "source_id").withColumn("split", F.lit(s)) for s in SPLITS]
    every = quotas[0].unionByName(quotas[1]).unionByName(quotas[2]).join(fields.select("source_id", "fields"), "source_id")
    k, f = F.size("fields"), F.col("fields")
    rows = every.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("quota") - 1).cast("int")))).filter("quota > 0")
    anchors = sizes.get("anchor", 0)
    rest = F.col("i") - anchors * k
    other = sizes.get("heldout", 0)
    pool = F.when(rest < 0, "anchor").when((F.col("split") != "train") & (rest % 2 == 0) & F.lit(other > 0), "heldout").otherwise("train")
    drawn = draw(F.when(F.col("pool") == "heldout", max(1, other)).otherwise(max(1, sizes.get("train", 0))), config.seed, "shape", F.col("split"), F.col("source_id"), F.col("i"))
    rows = rows.withColumn("pool", pool).withColumn("j", F.when(F.col("pool") == "anchor", F.floor(F.col("i") / k).cast("int")).otherwise(drawn))
    own = f[F.col("i") % k]
    return rows.join(numbered.select("pool", "j", "h", "w"), ["pool", "j"]).select("split", "source_id", "family", "i", "h", "w", own["field_key"].alias("field_key"), own["component"].alias("component"), F.floor(F.col("i") / k).cast("int").alias("visit"))


def sampled_states(spark: SparkSession, frames: DataFrame, splits: DataFrame, config: BuildConfig) -> DataFrame:
    """Plan rows with a distinct crop each: trajectories in shuffled cycles, times by a co-prime stride, corners drawn; a crop that is taken already is drawn anew, up to config.attempts times.

    Shared fields have no sample, static ones no time, so neither makes crops look distinct.
    """
    of = frames.groupBy("source_id", "family", "field_key", "component").agg(F.count("sample_index").alias("samples"), F.count("time_index").alias("times"))
    fields = of.groupBy("source_id", "family").agg(F.array_sort(F.collect_list(F.struct("field_key", "component"))).alias("fields"))  # a source's fields
    plan = written(state_plan(spark, fields, config), "plan")
    kinds = of.select("source_id", "field_key", "component", (F.col("samples") > 0).alias("moving"), (F.col("times") > 0).alias("timed"))
    steps = frames.groupBy("source_id").agg((F.coalesce(F.max("time_index"), F.lit(0)) + 1).cast("int").alias("steps"))
    extent = frames.groupBy("source_id", "field_key", "component").agg(F.min("height").alias("height"), F.min("width").alias("width"))
    members = splits.select(F.concat_ws("/", "split", "source_id").alias("group"), F.concat_ws("/", "source_file_id", F.col("sample_index").cast("string")).alias("trajectory"))
    most = plan.agg(F.max("visit")).first()[0]
    turns = sampling.cycled(members, "group", "trajectory", (most or 0) + 1, config.seed)
    shared = frames.filter("sample_index is null").groupBy("source_id", "field_key", "component").agg(F.min("source_file_id").alias("shared_file"))
    key = ["source_id", "field_key"]
    same = lambda d, a, b: (d.source_id == F.col(f"{b}.source_id")) & (d.field_key == F.col(f"{b}.field_key")) & d.component.eqNullSafe(F.col(f"{b}.component"))  # noqa: E731, ARG005
    rows = plan.withColumn("group", F.concat_ws("/", "split", "source_id")).join(turns.select("group", F.col("i").alias("visit"), "trajectory", "cycle"), ["group", "visit"])
    for name, table in (("k", kinds), ("e", extent), ("s", shared)):
        rows = rows.join(table.alias(name), same(rows, rows, name), "left").drop(*[F.col(f"{name}.{c}") for c in (*key, "component")])
    rows = rows.join(steps, "source_id")
    parts = F.split("trajectory", "/(?=[^/]*$)")
    rows = rows.withColumn("source_file_id", F.coalesce("shared_file", parts[0])).withColumn("sample_index", F.when(F.col("moving"), parts[1].cast("int")))
    timed = rows.withColumn("key", F.concat_ws("/", "group", "field_key", "component", "trajectory"))
    timed = sampling.coprime_times(timed.withColumn("visit_", F.col("visit")).withColumn("visit", F.col("cycle")), F.col("steps"), config.seed).withColumn("visit", F.col("visit_"))
    base = timed.withColumn("time_index", F.when(F.col("timed"), F.col("time"))).select("split", "source_id", "family", "i", "visit", *FRAME, "height", "width", "h", "w")
    waiting, done = written(base, "waiting"), None
    for attempt in range(config.attempts):
        corner = lambda side, size: draw(F.col(side) - F.col(size) + 1, config.seed, "corner", side, F.col("split"), F.col("source_id"), F.col("i"), attempt)  # noqa: B023, E731
        tried = waiting.withColumn("top", corner("height", "h")).withColumn("left", corner("width", "w"))
        tried = tried.withColumn("state_ref", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in IDENTITY]), 256))
        if done is not None:
            tried = tried.join(done.select("state_ref").withColumn("taken", F.lit(True)), "state_ref", "left")
        else:
            tried = tried.withColumn("taken", F.lit(None).cast("boolean"))
        first = F.row_number().over(Window.partitionBy("state_ref").orderBy("split", "source_id", "i")) == 1
        tried = written(tried.withColumn("won", F.col("taken").isNull() & first), "tried")
        won = tried.filter("won").drop("won", "taken")
        done = won if done is None else done.unionByName(won)  # a written table of each attempt
        waiting = tried.filter("not won").select(waiting.columns)
        if waiting.isEmpty():
            break
    else:
        raise ValueError("a budget exceeds the distinct crops")
    field_name = F.when(F.col("component").isNull(), F.col("field_key")).otherwise(F.concat("field_key", F.lit("["), F.col("component").cast("string"), F.lit("]")))
    return done.withColumn("field", field_name)


def build_dataset(spark: SparkSession, frames: DataFrame, config: BuildConfig) -> Dataset:
    """States of every split with exact budgets, their standardized grids, and a record per drawn program; some evaluation states have both wordings as diagnostics.

    frames: source_id, family, FRAME, height, width, values. One source is a build of one family.
    """
    config.check()
    frames = frames.select("source_id", "family", *FRAME, "height", "width", "values")
    splits = written(trajectory_partition(frames, config.seed, config.least_trajectories), "splits")
    states = sampled_states(spark, frames, splits, config)
    crops = crop_states(frames, states.select("state_ref", *FRAME, "top", "left", "h", "w"))
    grids = written(normalize.standardize_grids(crops.select("state_ref", "h", "w", "x")), "grids")
    facts = grids.select("state_ref", "mean", "std", "is_constant", "roughness", "roughness_bin")
    states = written(states.join(facts, "state_ref").withColumn("is_static", F.col("time_index").isNull()), "built-states")
    grids = grids.select("state_ref", "h", "w", "z")
    drawn = P.sample_programs(states.select("state_ref", "h", "w"), config.seed, config.tasks)
    if config.tasks_per_state is not None:
        fits = F.transform(P.fitting_tasks(F.col("h"), F.col("w")), lambda t: F.struct(t.alias("task"), L.capability(t).alias("kind")))
        allowed = F.filter(fits, lambda x: x["task"].isin(*config.tasks))
        picks = states.select("state_ref", F.explode(sampling.sequential_draw(allowed, config.capability_weights, config.tasks_per_state, config.seed, F.col("state_ref"), "pick")).alias("task"))
        drawn = drawn.join(picks, ["state_ref", "task"], "left_semi")
    done = written(P.execute(drawn, grids), "executed")
    names = L.TEMPLATES["train"]
    rows = P.records(done, names)
    chosen = F.element_at(F.array(*[F.lit(t) for t in names]), draw(len(names), config.seed, "wording", F.col("state_ref"), F.col("task")) + 1)
    records = rows.filter(F.col("template_family") == chosen)
    turn = Window.partitionBy("split", "source_id").orderBy(order_key(config.seed, "diagnostic", F.col("state_ref")))
    few = states.filter("split <> 'train'").withColumn("turn", F.row_number().over(turn)).filter(F.col("turn") <= config.diagnostic_states).select("state_ref", "split")
    own = F.lit(None).cast("string")
    for split in ("val", "test"):
        own = F.when(F.col("split") == split, L.TEMPLATES[split][0]).otherwise(own)
    both = P.records(done.join(few.select("state_ref"), "state_ref", "left_semi"), names + L.TEMPLATES["val"] + L.TEMPLATES["test"]).join(few, "state_ref")
    diagnostics = both.filter((F.col("template_family") == chosen) | (F.col("template_family") == own)).drop("split")
    return Dataset(states, grids, records, diagnostics, splits)


#: Each published table's column without equal values.
KEYS = {"states": "state_ref", "grids": "state_ref", "records": "qa_id", "diagnostics": "diagnostic_id", "splits": "trajectory_id"}


def publish(data: Dataset, folder: str, config: BuildConfig, replace: bool = False) -> versions.Version:
    """All tables of a build as one version of a set: states, grids with running cache offsets, records, diagnostics, splits. A set that has a version stays as it is unless replace is given."""
    sizes = batching.running_offsets(data.grids.withColumn("size", F.col("h") * F.col("w")), "state_ref", "size", "cache_offset")
    records = data.records.join(data.states.select("state_ref", "split"), "state_ref")
    trajectory = F.concat_ws("/", "source_id", "source_file_id", F.col("sample_index").cast("string"))
    tables = {"states": data.states, "grids": sizes, "records": records, "diagnostics": data.diagnostics.withColumn("diagnostic_id", F.concat_ws("/", "state_ref", "qa_id")), "splits": data.splits.withColumn("trajectory_id", trajectory)}
    settings = json.loads(json.dumps(vars(config)))
    identity = {"run": run_identity(settings), "config": settings, "templates": {k: list(v) for k, v in L.TEMPLATES.items()}, "normalization": "population z-score, epsilon 1e-6, half precision, constant to zero"}
    return versions.commit(data.states.sparkSession, folder, tables, KEYS, identity, replace)


def load_dataset(spark: SparkSession, folder: str, number: int | None = None, scan: bool = False) -> tuple[Dataset, versions.Version]:
    """The current version of a published set, or an earlier one, after its checks: what dataset_problems() finds is an error that names the first problems. With scan, all rows are compared to the digest trees, too."""
    version = versions.open_version(spark, folder, number)
    found = dataset_problems(version)
    if scan:
        found = found.unionByName(versions.damage(version).select(F.concat(F.lit("damaged_"), "name").alias("problem"), F.concat_ws(" to ", "first_key", "last_key").alias("detail")))
    few = found.orderBy("problem", "detail").limit(8).collect()
    if few:
        raise ValueError("the set has problems: " + "; ".join(f"{r.problem} ({r.detail})" for r in few))
    tables = {name: version.table(name) for name in KEYS}
    return Dataset(tables["states"], tables["grids"], tables["records"].drop("split"), tables["diagnostics"].drop("diagnostic_id"), tables["splits"].drop("trajectory_id")), version


def dataset_problems(version: versions.Version) -> DataFrame:
    """(problem, detail) of a published set: rows and roots that the manifest doesn't have, budgets, states of no split or of another trajectory's, grids of another shape or with gaps between offsets, records of no state, of another split's wording, or counted twice."""
    spark, told, config = version.spark, version.manifest["tables"], version.manifest["identity"]["config"]
    states, grids, records, splits = (version.table(n) for n in ("states", "grids", "records", "splits"))
    tops = version.tree().groupBy("name").agg(F.max_by("digest", "level").alias("root"), F.max_by("n", "level").alias("n"))
    said = spark.createDataFrame([(n, t["root"], t["rows"]) for n, t in told.items()], "name string, said_root string, said_n long")
    where = lambda rows, problem, detail: rows.select(F.lit(problem).alias("problem"), F.col(detail).cast("string").alias("detail"))
    roots = said.join(tops, "name", "left").filter(~F.col("root").eqNullSafe(F.col("said_root")) | (F.coalesce("n", F.lit(0)) != F.col("said_n")))
    counts = None
    for name in told:
        one = version.table(name).agg(F.count("*").alias("here")).select(F.lit(name).alias("name"), "here")
        counts = one if counts is None else counts.unionByName(one)
    lost = said.join(counts, "name").filter("here <> said_n")
    wanted = spark.createDataFrame([(s, config["train_states"] if s == "train" else config["eval_states"]) for s in SPLITS], "split string, wanted long")
    budgets = wanted.join(states.groupBy("split").count(), "split", "left").filter(F.coalesce("count", F.lit(0)) != F.col("wanted"))
    key = ["source_id", "source_file_id", "sample_index"]
    leaks = states.filter("sample_index is not null").join(splits.select(*key, F.col("split").alias("own")), key, "left").filter(~F.col("split").eqNullSafe(F.col("own")))
    shapes = states.select("state_ref", "h", "w").join(grids.select("state_ref", F.col("h").alias("gh"), F.col("w").alias("gw"), F.size("z").alias("cells")), "state_ref", "full")
    shapes = shapes.filter(~(F.col("h").eqNullSafe(F.col("gh")) & F.col("w").eqNullSafe(F.col("gw")) & (F.col("cells") == F.col("h") * F.col("w"))))
    gaps = batching.running_offsets(grids.select("state_ref", "size", "cache_offset"), "state_ref", "size", "sum_").filter("cache_offset <> sum_")
    orphans = records.join(states.select("state_ref", F.col("split").alias("own")), "state_ref", "left").filter(~F.col("split").eqNullSafe(F.col("own")))
    names = F.array(*[F.lit(t) for t in L.TEMPLATES["train"]])
    wording = records.filter(~F.array_contains(names, F.col("template_family")) | (F.col("language_group") != "seen"))
    twice = audit.repeated_ids(records, "qa_id")
    parts = [
        where(roots, "root", "name"), where(lost, "rows", "name"), where(budgets, "budget", "split"), where(leaks, "leak", "state_ref"), where(shapes, "grid", "state_ref"), where(gaps, "offset", "state_ref"),
        where(orphans, "record_state", "qa_id"), where(wording, "wording", "qa_id"), where(twice, "repeated_record", "qa_id"), where(audit.repeated_ids(states, "state_ref"), "repeated_state", "state_ref"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def byte_tokens(texts: pd.Series) -> pd.Series:
    """UTF-8 bytes as ids: the encoder where none is given."""
    return texts.map(lambda t: list(t.encode()))


def training_arrays(data: Dataset, split: str, encode: Callable[[pd.Series], pd.Series] = byte_tokens, end_id: int = 256, prompt_limit: int | None = None) -> DataFrame:
    """(qa_id, state_ref, cache_offset, h, w, prompt, target, token_offset, tokens): records of a split with token ids by a callback, which works on whole columns of texts, and running offsets of grids and tokens.

    Every record has to replay on its grid, and no prompt may be longer than prompt_limit, or the job fails.
    """
    rows = data.records.join(data.states.filter(F.col("split") == split).select("state_ref"), "state_ref", "left_semi")
    bad = P.tampered(rows, data.grids).limit(1).count()
    if bad:
        raise ValueError("a record doesn't replay")
    ids = F.pandas_udf(encode, "array<int>")
    packed = batching.running_offsets(data.grids.withColumn("size", F.col("h") * F.col("w")), "state_ref", "size", "cache_offset")
    prompt = F.format_string("Grid of %d rows and %d columns. %s", "h", "w", "question")
    encoded = rows.select("qa_id", "state_ref", "h", "w", ids(prompt).alias("prompt"), F.concat(ids("answer"), F.array(F.lit(end_id))).alias("target"))
    if prompt_limit is not None:
        fits = F.size("prompt") <= prompt_limit
        encoded = encoded.withColumn("prompt", F.when(fits, F.col("prompt")).otherwise(F.raise_error(F.lit("a prompt is too long")).cast("array<int>")))
    encoded = written(encoded.withColumn("tokens", F.size("prompt") + F.size("target")), "encoded")
    placed = batching.running_offsets(encoded, "qa_id", "tokens", "token_offset")
    return placed.join(packed.select("state_ref", "cache_offset"), "state_ref")
