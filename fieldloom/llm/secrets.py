"""Secret scans over every historical version, by an incremental ledger of blobs.

A version's blob is its text's SHA-256. The ledger holds, for each blob and each rule version that
has scanned it, the spans found (none included), so a run scans only pairs it hasn't: new blobs
by all rules, known blobs by new or changed rules. Findings then join back to every path that
holds the blob. DataFrame functions only: a rule's matches are extracted, the text is split by
the same pattern, and running lengths of the pieces give the offsets, in code points.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .common import materialize


@dataclass(frozen=True)
class Rule:
    """pattern: Java regular expression, never matching the empty text; a match counts if its group has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    version: int = 1

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: Fixed: the base kinds, in the order in which equal starts are listed.
BASE = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
)
_BLANK, _BASE64 = r"[\x09-\x0D\x20]", "[A-Za-z0-9+/]"
#: A key block: from BEGIN to END if no other line of five dashes comes first, else over headers, base64 lines (with the first word of a line after them) and long runs of base64 that are indented or follow spaces, with a short padded one at their end. Every repeat is possessive: nothing is bounded, nothing is tried twice and no stack grows with the text.
PEM = (
    r"-----BEGIN [A-Z ]*PRIVATE KEY-----(?:(?:[^-]++|-{1,4}+[^-])*+-----END [A-Z ]*PRIVATE KEY-----"
    r"|(?:\r?\n(?:Proc-Type|DEK-Info):[^\r\n]*+)*+[A-Za-z0-9+/=\r\n]*+" + f"(?:{_BLANK}++{_BASE64}{{16,}}+={{0,2}}+)*+[A-Za-z0-9+/=\\r\\n]*+(?:{_BLANK}++{_BASE64}++={{1,2}}+)?+)"
)
#: A web token, group 1 its second and third parts. Where these don't follow, the match takes the whole head without counting, so that no head is read again from within.
JWT = "eyJ(?:W{8,}+(\\.eyJW{8,}+\\.W{8,}+)?+)?+".replace("W", "[A-Za-z0-9_-]")
#: Kinds that the ledger's rule set adds: key blocks, web tokens, and tokens with an issuer's prefix.
ADDED = (
    Rule("pem", PEM, version=3),
    Rule("jwt", JWT, group=1, version=3),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
)
RULES = BASE + ADDED

#: Matches of one text that are placed, and cut, at once.
BLOCK = 256
SPANS = "array<struct<start:int,end:int>>"
LEDGER = f"blob binary, found map<string,{SPANS}>"


def blob_id(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def bound(value: Column, use) -> Column:
    """use(value), the value computed once however often it is used."""
    return F.transform(F.array(value), use)[0]


def blocks_of(items: Column) -> Column:
    """An array cut into arrays of BLOCK items."""
    n = F.ceil(F.size(items) / BLOCK).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda b: F.slice(items, b * BLOCK + 1, BLOCK))).otherwise(F.array(items))


def running(values: Column, combine) -> Column:
    """Of an array of whole numbers, what those before each one combine to (0 before the first). Blocks are combined first, so that no long array is copied at each step."""

    def along(x: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(x, zero, lambda acc, v: F.struct(combine(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])

    total = lambda x: F.aggregate(x, F.lit(0), combine)
    return bound(blocks_of(values), lambda blocks: F.flatten(F.zip_with(blocks, along(F.transform(blocks, total), F.lit(0)), along)))


def rule_spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule's matches, leftmost and not overlapping: start and end (exclusive) in code points."""
    pattern = F.lit(rule.pattern)
    parts = F.transform(
        F.arrays_zip(
            F.split(text, rule.pattern, -1).alias("gap"),
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("hit"),
            F.regexp_extract_all(text, pattern, F.lit(rule.group)).alias("value"),
        ),
        lambda x: F.struct(F.length(x["gap"]).alias("gap"), F.coalesce(F.length(x["hit"]), F.lit(0)).alias("hit"), F.coalesce(F.length(x["value"]) >= rule.least, F.lit(False)).alias("counts")),
    )

    def placed(x: Column) -> Column:
        before = running(F.transform(x, lambda y: y["gap"] + y["hit"]), lambda a, b: a + b)
        spans = F.zip_with(x, before, lambda y, at: F.struct((at + y["gap"]).alias("start"), (at + y["gap"] + y["hit"]).alias("end"), y["counts"].alias("counts")))
        return F.transform(F.filter(spans, lambda y: y["counts"]), lambda y: F.struct(y["start"], y["end"]))

    return F.when(text.rlike(rule.pattern), bound(parts, placed)).otherwise(F.array()).cast(SPANS)


def scan_versions(versions: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """The ledger's new rows for these versions, (blob, found): what is known of each blob, and the pairs scanned now.

    Each distinct text is scanned once whatever the number of versions that hold it; with a ledger,
    a blob all of whose rules are there gives no row and its text is not kept for a scan.
    """
    keys = F.array(*[F.lit(r.key) for r in rules])
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    seen = versions.select(blob_id(text).alias("blob"), text.alias("text"))
    if ledger is not None:
        known = ledger.select("blob", "found").filter(F.size(F.array_except(keys, F.map_keys("found"))) == 0)
        seen = seen.join(known, "blob", "left_anti")
    blobs = seen.groupBy("blob").agg(F.first("text").alias("text"))
    if ledger is None:
        old = F.create_map().cast(f"map<string,{SPANS}>")
    else:
        blobs = blobs.join(ledger.select("blob", F.col("found").alias("old")), "blob", "left")
        old = F.coalesce(F.col("old"), F.create_map().cast(f"map<string,{SPANS}>"))
    blobs = blobs.select("blob", "text", old.alias("old"))
    fresh = F.array(*[F.struct(F.lit(r.key).alias("key"), F.when(~F.map_contains_key("old", r.key), rule_spans(F.col("text"), r)).alias("value")) for r in rules])
    new = F.map_from_entries(F.filter(fresh, lambda e: e["value"].isNotNull()))
    return blobs.select("blob", F.map_concat("old", new).alias("found"))


def merge_ledger(ledger: DataFrame | None, new: DataFrame) -> DataFrame:
    """The ledger after a run: new rows stand for their blobs."""
    return new if ledger is None else ledger.select("blob", "found").join(new.select("blob"), "blob", "left_anti").unionByName(new)


def findings(versions: DataFrame, ledger: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, all: array of (start, rank, end, kind)): the ledger's findings at each path, a row per version row.

    Spans are in order of start, then of the rules' order.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    paths = versions.select(F.col(id_col).alias("path_id"), blob_id(text).alias("blob"))
    return paths.join(_marked(ledger, rules), "blob").select(F.col("path_id").alias(id_col), "all")


def _marked(ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, all) of the ledger's rows."""
    found = ledger.select("blob", *[F.col("found")[r.key].alias(r.kind) for r in rules])

    def marked(rank: int, kind: str) -> Column:
        spans = F.coalesce(F.col(kind), F.array().cast(SPANS))
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")))

    return found.select("blob", F.array_sort(F.concat(*[marked(k, r.kind) for k, r in enumerate(rules)])).alias("all"))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def read_ledger(spark: SparkSession, path: str) -> DataFrame | None:
    """(blob, found) of a ledger that scan_into() keeps, the latest row of each blob; None before its first run."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    rows = spark.read.schema(f"{LEDGER}, run long").parquet(path)
    return rows.groupBy("blob").agg(F.max_by("found", "run").alias("found"))


def scan_into(versions: DataFrame, path: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The whole ledger at path, after scanning what it lacks of these versions and appending that as one run.

    A run that breaks appends nothing and is simply done again. Versions or rules that are known
    add no rows.
    """
    spark, known = versions.sparkSession, read_ledger(versions.sparkSession, path)
    run = 0 if known is None else (spark.read.schema(f"{LEDGER}, run long").parquet(path).agg(F.max("run")).first()[0] or 0) + 1
    scan_versions(versions, text_col, rules, known).withColumn("run", F.lit(run).cast("long")).write.mode("append").option("compression", "zstd").parquet(path)
    return read_ledger(spark, path)


def find_secrets(versions: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, path: str | None = None) -> DataFrame:
    """Scan what the ledger lacks and return the findings of every version row: (id, all).

    Null text: empty, no findings. Null id: kept. Repeated rows and copies: scanned once, a row
    each. Empty table: no rows. Other columns are ignored, whatever their names. With a path,
    the ledger lies there and keeps what this run scans; else new rows go to the shared folder. Either
    way they are written before findings join back, so that a large group of copies is an ordinary
    join side that Spark may split.
    """
    if path is not None:
        return findings(versions, scan_into(versions, path, text_col, rules), id_col, text_col, rules)
    return findings(versions, merge_ledger(ledger, materialize(scan_versions(versions, text_col, rules, ledger), "ledger")), id_col, text_col, rules)


def redact(text: Column, spans: Column, mark: str = "[secret]") -> Column:
    """text with every span (from `all`) replaced by mark; overlapping spans are replaced together.

    The text between spans is cut block by block, so that a long text isn't walked from its start for each span.
    """
    cut = lambda t, a, b: F.substring(t, a + 1, b - a)

    def kept(x: Column) -> Column:
        """(from, to) of the text before each group of overlapping spans."""
        before = running(F.transform(x, lambda y: y["end"]), lambda a, b: F.greatest(a, b))
        return F.filter(F.zip_with(x, before, lambda y, at: F.struct(at.alias("a"), y["start"].alias("b"))), lambda y: y["b"] >= y["a"])

    def block_text(block: Column) -> Column:
        first, last = block[0]["a"], F.element_at(block, -1)["b"]
        return bound(cut(text, first, last), lambda t: F.array_join(F.transform(block, lambda y: cut(t, y["a"] - first, y["b"] - first)), mark))

    head = bound(kept(spans), lambda x: F.array_join(F.transform(blocks_of(x), block_text), mark))
    tail = F.substring(text, F.array_max(F.transform(spans, lambda y: y["end"])) + 1, F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(head, F.lit(mark), tail))


def redacted(docs: DataFrame, text_col: str = "text", count_col: str | None = None, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None) -> DataFrame:
    """docs, a row each, with every finding of the rules replaced in the text; count_col, if named, follows the changed texts' length.

    Rows meet the ledger by their blob, so ids play no part: null and repeated ids are as good as
    any. Rows without findings stay as they are, null texts too. Empty table: no rows.
    """
    full = merge_ledger(ledger, materialize(scan_versions(docs, text_col, rules, ledger), "ledger"))
    hits = _marked(full, rules).filter(F.size("all") > 0)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    row = docs.select(blob_id(text).alias("blob"), F.struct(*docs.columns).alias("row")).join(hits, "blob", "left")
    clean = F.when(F.col("all").isNull(), F.col("row")[text_col]).otherwise(redact(F.col("row")[text_col], F.col("all")))
    made = row.select("row", clean.alias("clean"), F.col("all").isNotNull().alias("changed"))
    size = lambda c: F.when(F.col("changed"), F.length("clean")).otherwise(F.col("row")[c]).cast(docs.schema[c].dataType)
    return made.select(*[F.col("clean").alias(c) if c == text_col else (size(c) if c == count_col else F.col("row")[c]).alias(c) for c in docs.columns])


def secret_digest(docs: DataFrame) -> DataFrame:
    """Per document: counts of the base kinds, SHA-256 over the base spans, and all spans."""
    own = lambda kinds: F.filter("all", lambda s: s["kind"].isin(*kinds))
    found = find_secrets(docs)
    return found.select(
        "doc_id",
        *[F.size(own([r.kind])).cast("long").alias(f"n_{r.kind}") for r in BASE],
        F.sha2(written(own([r.kind for r in BASE])), 256).alias("base_sha256"),
        written(F.col("all")).alias("spans"),
    )
