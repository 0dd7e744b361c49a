"""Sets of tables that change together: a commit log, digest trees, and their verification.

A set is a folder with a log and versions. All tables of a version are written first, then its digest
trees and its manifest, and one rename of a log entry makes it the current one: a reader sees the old
version or the new one, whatever breaks on the way, and a broken try is simply made again. Earlier
versions stay readable under their numbers until they are removed.

A table's digest tree has a leaf for every LEAF rows in order of its key and a node for every FANOUT
children. Two versions are compared from their roots down, so that a changed row is found among few
nodes and without reading either table; a table is checked against its own tree by one scan, or for a
range of keys only.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .tables import discarding, removed, written

LEAF, FANOUT = 1024, 64
TREE = "name string, level int, node long, digest string, n long, first_key string, last_key string"


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def row_digest(columns: list[str]) -> Column:
    """SHA-256 of a row's values by name, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def _leaves(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Leaves of rows with place_ (from 0, in order of key) and digest_."""
    leaf = F.floor(F.col("place_") / LEAF).cast("long")
    ordered = F.array_sort(F.collect_list(F.struct("place_", "digest_")))  # LEAF at most
    made = rows.groupBy(leaf.alias("node")).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["digest_"]), ""), 256).alias("digest"), F.count("*").alias("n"), F.min(key).alias("first_key"), F.max(key).alias("last_key"))
    return made.select(F.lit(name).alias("name"), F.lit(0).alias("level"), "node", "digest", "n", F.col("first_key").cast("string").alias("first_key"), F.col("last_key").cast("string").alias("last_key"))


def leaves_of(table: DataFrame, name: str, key: str) -> DataFrame:
    """(TREE) of level 0 of a table whose key has no equal values."""
    from ..operators.batching import running_offsets

    rows = table.select(key, row_digest(table.columns).alias("digest_"), F.lit(1).alias("one_"))
    return _leaves(running_offsets(rows, key, "one_", "place_"), name, key)


def tree_of(table: DataFrame, name: str, key: str) -> DataFrame:
    """(TREE) of all levels; the root is the only node of the highest. An empty table has no nodes."""
    level = written(leaves_of(table, name, key), "leaves")
    out, number, nodes = level, 0, level.count()
    while nodes > 1:
        up = F.floor(F.col("node") / FANOUT).cast("long")
        ordered = F.array_sort(F.collect_list(F.struct("node", "digest")))  # FANOUT at most
        number += 1
        level = level.groupBy("name", up.alias("up")).agg(F.sha2(F.array_join(F.transform(ordered, lambda x: x["digest"]), ""), 256).alias("digest"), F.sum("n").alias("n"), F.min_by("first_key", "node").alias("first_key"), F.max_by("last_key", "node").alias("last_key"))
        level = written(level.select("name", F.lit(number).alias("level"), F.col("up").alias("node"), "digest", "n", "first_key", "last_key"), "nodes")
        out, nodes = out.unionByName(level), -(-nodes // FANOUT)
    return out


@dataclass
class Version:
    """One version of a set: its number in the log, its folder and its manifest (identity, keys, rows, roots)."""

    spark: SparkSession
    number: int
    path: str
    manifest: dict

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def tree(self) -> DataFrame:
        return self.spark.read.schema(TREE).parquet(f"{self.path}/digests")


def _log(spark: SparkSession, folder: str) -> dict[int, str]:
    """Version folder by number; a log has as many entries as commits were made."""
    at, store = _files(spark, f"{folder}/log")
    if not store.exists(at):
        return {}
    names = [s.getPath().getName() for s in store.listStatus(at)]
    return {int(n.split("-")[0]): n.split("-", 1)[1] for n in names if n[:8].isdigit()}


def open_version(spark: SparkSession, folder: str, number: int | None = None) -> Version:
    """The current version of a set, or an earlier one by its number."""
    log = _log(spark, folder)
    if not log:
        raise FileNotFoundError(f"no committed version in {folder}")
    number = max(log) if number is None else number
    path = f"{folder}/versions/{log[number]}"
    return Version(spark, number, path, json.loads(spark.read.text(f"{path}/manifest", wholetext=True).first()[0]))


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame], keys: dict[str, str], identity: dict, replace: bool = False) -> Version:
    """Write all tables as a new version and make it the current one. keys: each table's column without equal values.

    A set that has a version is left alone unless replace is given. Whatever fails before the last
    step leaves the current version as it is, and leftover folders that vacuum() removes.
    """
    log = _log(spark, folder)
    if log and not replace:
        raise FileExistsError(f"{folder} has a version")
    name = uuid.uuid4().hex[:16]
    path = f"{folder}/versions/{name}"
    with discarding(spark):
        trees = None
        for table, df in tables.items():
            df.write.mode("errorifexists").parquet(f"{path}/{table}")
            tree = tree_of(spark.read.parquet(f"{path}/{table}"), table, keys[table])
            trees = tree if trees is None else trees.unionByName(tree)
        trees.coalesce(1).write.mode("errorifexists").parquet(f"{path}/digests")
    tops = spark.read.schema(TREE).parquet(f"{path}/digests").groupBy("name").agg(F.max_by("digest", "level").alias("root"), F.max_by("n", "level").alias("n"))
    found = {r.name: r for r in tops.collect()}  # a row per table
    notes = {t: {"key": keys[t], "rows": found[t].n if t in found else 0, "root": found[t].root if t in found else None} for t in tables}
    spark.createDataFrame([(json.dumps({"identity": identity, "tables": notes}),)], "value string").coalesce(1).write.text(f"{path}/manifest")
    number = max(log, default=0) + 1
    entry, store = _files(spark, f"{folder}/log/{number:08d}-{name}")
    draft, _ = _files(spark, f"{folder}/drafts/{name}")
    store.create(draft, False).close()
    store.mkdirs(entry.getParent())
    if number in _log(spark, folder):
        raise FileExistsError(f"version {number} of {folder} was committed meanwhile")
    if not store.rename(draft, entry):
        raise OSError(f"can't commit to {folder}")
    return open_version(spark, folder, number)


def vacuum(spark: SparkSession, folder: str, keep: int = 2) -> list[str]:
    """Remove versions that no log entry names, and log entries and versions before the last `keep`; returns the removed folders' names."""
    log = _log(spark, folder)
    old = sorted(log)[: max(0, len(log) - keep)]
    for number in old:
        removed(spark, f"{folder}/log/{number:08d}-{log[number]}")
    live = {log[n] for n in log if n not in old}
    at, store = _files(spark, f"{folder}/versions")
    gone = [s.getPath().getName() for s in store.listStatus(at) if s.getPath().getName() not in live] if store.exists(at) else []
    for name in gone:
        removed(spark, f"{folder}/versions/{name}")
    return gone


def differing_leaves(old: Version, new: Version, name: str) -> DataFrame:
    """(node, first_key, last_key) of a table's leaves that two versions don't share: from the highest level that both have down, only children of nodes that differ. Neither table is read."""
    own = lambda v: v.tree().filter(F.col("name") == name)
    top = min(own(v).agg(F.max("level")).first()[0] or 0 for v in (old, new))
    parents = None
    for level in range(top, -1, -1):
        side = lambda v, c: own(v).filter(F.col("level") == level).select("node", F.col("digest").alias(c), F.struct("first_key", "last_key").alias(f"{c}_keys"))  # noqa: B023, E731
        both = side(old, "a").join(side(new, "b"), "node", "full")
        if parents is not None:
            both = both.withColumn("up", F.floor(F.col("node") / FANOUT).cast("long")).join(parents, "up", "left_semi")
        bad = both.filter(~F.col("a").eqNullSafe(F.col("b")))
        parents = bad.select(F.col("node").alias("up"))
    keys = F.coalesce("b_keys", "a_keys")
    return bad.select("node", keys["first_key"].alias("first_key"), keys["last_key"].alias("last_key"))


def damage(version: Version, names: list[str] | None = None) -> DataFrame:
    """(name, node, first_key, last_key) of leaves whose rows aren't those that the version's tree was made of, by one scan of each table."""
    out = None
    for name in names or version.manifest["tables"]:
        now = leaves_of(version.table(name), name, version.manifest["tables"][name]["key"])
        was = version.tree().filter((F.col("name") == name) & (F.col("level") == 0))
        both = was.select("name", "node", F.col("digest").alias("was"), "first_key", "last_key").join(now.select("name", "node", F.col("digest").alias("now"), F.col("first_key").alias("f"), F.col("last_key").alias("l")), ["name", "node"], "full")
        bad = both.filter(~F.col("was").eqNullSafe(F.col("now"))).select("name", "node", F.coalesce("first_key", "f").alias("first_key"), F.coalesce("last_key", "l").alias("last_key"))
        out = bad if out is None else out.unionByName(bad)
    return out


def leaf_is_sound(version: Version, name: str, node: int) -> bool:
    """Whether the rows of one leaf are as published: only rows within its keys are read, by a filter that reaches the scan."""
    key, table = version.manifest["tables"][name]["key"], version.table(name)
    leaf = version.tree().filter((F.col("name") == name) & (F.col("level") == 0) & (F.col("node") == node)).first()
    within = F.col(key).between(*[F.lit(x).cast(table.schema[key].dataType) for x in (leaf.first_key, leaf.last_key)])
    rows = F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), F.col("digest_").alias("d"))))  # a leaf's rows
    now = table.filter(within).select(key, row_digest(table.columns).alias("digest_")).agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["d"]), ""), 256)).first()[0]
    return now == leaf.digest
