"""File states: what is opened, and what is found."""

import hashlib
import os
import time

from fieldloom.sources import files as S


def put(folder, **texts):
    os.makedirs(folder, exist_ok=True)
    for name, text in texts.items():
        with open(f"{folder}/{name}", "w") as f:
            f.write(text)


def test_only_changed_files_are_opened(spark, tmp_path):
    folder, state = f"{tmp_path}/in", f"file://{tmp_path}/state"
    put(folder, a="one", b="two", c="three")
    got = {os.path.basename(r.path): r.sha256 for r in S.verify_files(spark, f"file://{folder}", state).collect()}
    assert got == {n: hashlib.sha256(t.encode()).hexdigest() for n, t in {"a": "one", "b": "two", "c": "three"}.items()}
    runs = lambda: {r.run: r["count"] for r in spark.read.parquet(state).groupBy("run").count().collect()}
    assert runs() == {1: 3}
    # nothing changed: unreadable content isn't even tried
    for n in "abc":
        stamp = os.stat(f"{folder}/{n}")
        with open(f"{folder}/{n}", "r+b") as f:
            f.write(b"#")  # same size and, below, same time: only the content differs
        os.utime(f"{folder}/{n}", ns=(stamp.st_atime_ns, stamp.st_mtime_ns))
    again = {os.path.basename(r.path): r.sha256 for r in S.verify_files(spark, f"file://{folder}", state).collect()}
    assert again == got and runs() == {1: 3} and S.changed_files(spark, f"file://{folder}", state).count() == 0
    time.sleep(1.1)
    put(folder, b="TWO!", d="four")
    os.remove(f"{folder}/c")
    third = {os.path.basename(r.path): r.sha256 for r in S.verify_files(spark, f"file://{folder}", state).collect()}
    assert third == {"a": got["a"], "b": hashlib.sha256(b"TWO!").hexdigest(), "d": hashlib.sha256(b"four").hexdigest()} and runs() == {1: 3, 2: 2}


def test_the_scan_lists_changed_files_only(spark, tmp_path):
    folder = f"{tmp_path}/in"
    put(folder, **{f"f{i}": str(i) for i in range(20)})
    files = spark.read.format("binaryFile").load(f"file://{folder}")
    from pyspark.sql import functions as F

    one = files.filter(F.col("_metadata.file_path").isin([r.path for r in S.listing(spark, f"file://{folder}").collect() if r.path.endswith("/f7")])).select(F.sha2("content", 256))
    assert len(one.collect()) == 1
    nodes, numbers = [one._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName().startswith("Scan"):
            numbers.append(node.metrics().apply("numFiles").value())
        for i in range(node.children().size()):
            nodes.append(node.children().apply(i))
    assert numbers == [1]


def test_many_changed_files_by_their_time(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(S, "BY_PATH", 2)
    folder, state = f"{tmp_path}/in", f"file://{tmp_path}/state"
    put(folder, **{f"f{i}": str(i) for i in range(9)})
    assert S.verify_files(spark, f"file://{folder}", state).count() == 9
    time.sleep(1.1)
    put(folder, **{f"f{i}": f"new {i}" for i in range(4)})
    assert S.verify_files(spark, f"file://{folder}", state).count() == 9
    assert {r.run: r["count"] for r in spark.read.parquet(state).groupBy("run").count().collect()} == {1: 9, 2: 4}


def test_problems_against_a_manifest(spark):
    told = [("a", "train", 3, "x"), ("b", "val", 3, "y"), ("c", "test", 9, "z"), ("d", "train", 2, "w"), ("e", "train", 4, "v"), ("f", "test", 4, "v")]
    here = [("a", 3, "x"), ("b", 3, "Q"), ("c", 5, "z2"), ("d", 7, "w2"), ("e", 4, "v"), ("f", 4, "v"), ("new", 1, "n")]
    m, f = spark.createDataFrame(told, "path string, split string, size_bytes long, sha256 string"), spark.createDataFrame(here, "path string, size_bytes long, sha256 string")
    got = sorted((r.path, r.problem) for r in S.file_problems(m, f).collect())
    assert got == [("b", "digest"), ("c", "truncated"), ("d", "size"), ("e", "shared_by_splits"), ("f", "shared_by_splits"), ("new", "unlisted")]
    assert [(r.path, r.problem) for r in S.file_problems(m.filter("path = 'a'"), f.limit(0)).collect()] == [("a", "missing")]


def test_large_files_pass_in_lines(spark, tmp_path, monkeypatch):
    """Spark's reader of whole files refuses those above a length: 2 GB, lowered here. A file's bytes come out whatever they are, by one task, however it would be split."""
    import random

    draw = random.Random(3)
    noise, mark = draw.randbytes(300_000), b"\xef\xbb\xbf"
    runs = b"".join(draw.randbytes(draw.randrange(50)) + bytes(draw.randrange(300)) for _ in range(3000))
    bodies = {
        "noise": noise, "ended": noise + b"\n", "twice": noise + b"\n\n", "begun": b"\n" + noise, "marked": mark + noise, "marked and ended": mark + mark + noise + b"\n",
        "breaks": b"a\r\nb\rc\n\n\r" * 2000, "feeds": b"\n" * 25_000, "text": "ä\u2028ß\x85\n".encode() * 3000, "runs": runs, "zeros": bytes(200_001), "holes": b"x" + bytes(90_000) + noise[:9000] + bytes(90_063), "small": b"s", "a.gz.parquet": noise[1:],
    }
    folder, state = f"{tmp_path}/in", f"file://{tmp_path}/state"
    os.makedirs(f"{folder}/deeper")
    for name, body in bodies.items():
        with open(f"{folder}/{'deeper/' if name == 'text' else ''}{name}", "wb") as f:
            f.write(body)
    monkeypatch.setattr(S, "WHOLE", 1000, raising=False)
    monkeypatch.setattr(S, "LINE", 20_000, raising=False)
    settings = {"spark.sql.sources.binaryFile.maxLength": "1000", "spark.sql.files.maxPartitionBytes": "50000"}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        got = {os.path.basename(r.path).replace("%20", " "): (r.size_bytes, r.sha256) for r in S.verify_files(spark, f"file://{folder}", state).collect()}
        assert {k: spark.conf.get(k) for k in settings} == settings
    finally:
        for k in settings:
            spark.conf.unset(k)
    assert got == {n: (len(b), hashlib.sha256(b).hexdigest()) for n, b in bodies.items()}
    assert spark.read.parquet(state).count() == len(bodies) and S.changed_files(spark, f"file://{folder}", state).count() == 0


def test_large_files_that_lines_dont_give(spark, tmp_path, monkeypatch):
    """One long line, and names by which the reader of lines would unpack a file, are read whole after all."""
    import random

    noise = random.Random(4).randbytes(100_000)
    bodies = {"line": b"x" * 100_000, "marked": b"\xef\xbb\xbf" + bytes(100_000), "a.gz": noise, "a.ZST": noise, "b.lz4": b"y\n" * 5000, "d.zstd": noise[1:], "e.snappy": noise[2:], "noise": noise[3:]}
    folder, state = f"{tmp_path}/in", f"file://{tmp_path}/state"
    os.makedirs(folder)
    for name, body in bodies.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(body)
    monkeypatch.setattr(S, "WHOLE", 1000)
    monkeypatch.setattr(S, "LINE", 20_000)
    monkeypatch.setattr(S, "BY_PATH", 2)
    got = {os.path.basename(r.path): r.sha256 for r in S.verify_files(spark, f"file://{folder}", state).collect()}
    assert got == {n: hashlib.sha256(b).hexdigest() for n, b in bodies.items()}
    assert spark.read.parquet(state).count() == len(bodies)
    with S._settings(spark, {"spark.sql.sources.binaryFile.maxLength": "1000"}):  # nothing is left to read
        assert S.verify_files(spark, f"file://{folder}", state).count() == len(bodies)


def test_lines_of_several_files_in_a_batch():
    import pyarrow as pa

    batch = lambda *rows: pa.RecordBatch.from_pydict({"path": [r[0] for r in rows], "size": [r[1] for r in rows], "line": pa.array([r[2] for r in rows], pa.binary())})
    files = lambda *mark: {r["path"]: r["sha256"] for b in S._digest_lines("\n", *mark)([batch(("a", 3, b"x"), ("a", 3, b"y"), ("b", 2, b"z")), batch(), batch(("c", 6, b"cut")), batch(("d", 5, b"p"), ("d", 5, b"q"), ("d", 5, b"")), batch(("e", 7, b"two"))]) for r in b.to_pylist()}
    digests = lambda **texts: {k: v and hashlib.sha256(v).hexdigest() for k, v in texts.items()}
    assert files() == digests(a=b"x\ny", b=b"z\n", c=None, d=b"p\nq\n\n", e=None)
    # three or four bytes less are a mark only where no read error can have lost them
    assert files(b"\xef\xbb\xbf") == digests(a=None, b=None, c=b"\xef\xbb\xbfcut", d=None, e=b"\xef\xbb\xbftwo\n")
