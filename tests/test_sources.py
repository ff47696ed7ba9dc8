"""Files in splits, versions, gzip members, digests, and an index kept up by a stream."""

import gzip
import hashlib
import json
import random
import shutil
import threading

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import text as X
from quern.operators import ordinals, validate
from quern.sources import readers, writers
from quern.streaming import corpus

SCHEMA = T.StructType([T.StructField("k", T.StringType()), T.StructField("a", T.IntegerType())])


@pytest.fixture
def small_splits(spark):
    """Splits of 1 KB."""
    for name, value in (("spark.sql.files.maxPartitionBytes", "1024"), ("spark.sql.files.openCostInBytes", "16")):
        spark.conf.set(name, value)
    yield
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        spark.conf.unset(name)


def lines(seed, n):
    r = random.Random(seed)
    return [r.choice(["", "  ", "é" * r.randint(1, 30), "x" * r.randint(1, 300), json.dumps({"k": f"k{r.randrange(40)}", "a": k})]) for k in range(n)]


def test_lines_of_split_files_have_their_numbers(spark, tmp_path, small_splits):
    want = {}
    for name, n, end in (("a", 700, "\n"), ("b", 900, ""), ("empty", 0, ""), ("one", 1, "\r\n"), ("long", 3, "\n")):
        rows = lines(n, n) if name != "long" else ["y" * 5000, "", "z"]
        (tmp_path / name).write_text("\n".join(rows) + end if rows else "", newline="")
        rows = rows[:-1] if rows and not end and rows[-1] == "" else rows
        want |= {(name, k): x for k, x in enumerate(rows, 1)}
    (tmp_path / "z.gz").write_bytes(gzip.compress("\n".join(lines(3, 300)).encode() + b"\n"))
    want |= {("z.gz", k): x for k, x in enumerate(lines(3, 300), 1)}
    d = readers.numbered_lines(spark, str(tmp_path))
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 50
    got = {(r["path"].rsplit("/", 1)[-1], r["line_no"]): r["raw"] for r in d.collect()}
    assert got == want and "wholetext" not in d._jdf.queryExecution().toString().lower()
    whole = readers.numbered_in_splits(readers.split_lines(spark.read.text(str(tmp_path))))  # the join planned by size
    assert {(r["path"].rsplit("/", 1)[-1], r["line_no"]): r["raw"] for r in whole.collect()} == want


def test_errors_name_lines_of_split_files(spark, tmp_path, small_splits):
    rows = [json.dumps({"k": f"k{k % 7}", "a": k}) for k in range(400)]
    (tmp_path / "good.jsonl").write_text("\n".join(rows))
    assert readers.corpus_rows(spark, SCHEMA, str(tmp_path / "good.jsonl")).count() == 400
    rows[333] = '{"k":"broken'
    (tmp_path / "bad.jsonl").write_text("\n".join(rows))
    with pytest.raises(Exception, match=r"bad\.jsonl:334: not a row"):
        readers.jsonl_strict(spark, SCHEMA, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "none.jsonl").write_text("\n\n")
    with pytest.raises(ValueError, match="no rows in .*none"):
        readers.corpus_rows(spark, SCHEMA, str(tmp_path / "none.jsonl"))
    index, report = readers.corpus_index(spark, SCHEMA, "k", str(tmp_path / "bad.jsonl"))
    assert {r["k"]: r["a"] for r in index.collect()} == {f"k{(399 - j) % 7}": 399 - j for j in range(7)}
    assert report.first()["bad_lines"] == 1 and report.first()["samples"][0].endswith("bad.jsonl:334")


def test_documents_and_lines_are_told_by_the_first_line(spark, tmp_path, small_splits):
    rows = [{"k": f"k{k}", "a": k} for k in range(300)]
    (tmp_path / "lines").write_text("\n \n" + "\n".join(map(json.dumps, rows)))
    (tmp_path / "array").write_text("﻿" + json.dumps(rows, indent=1))
    (tmp_path / "object").write_text(json.dumps(rows[0], indent=4))
    (tmp_path / "packed.gz").write_bytes(gzip.compress("\n".join(map(json.dumps, rows)).encode()))
    (tmp_path / "wide").write_text(json.dumps({"k": "x" * 200_000, "a": 1}) + "\n" + json.dumps({"k": "y", "a": 2}))
    every = sorted((r["k"], r["a"]) for r in rows)
    read = lambda name: sorted(tuple(r) for r in readers.any_json(spark, str(tmp_path / name), SCHEMA).collect())
    assert read("lines") == read("packed.gz") == every and read("object") == every[:1] and len(read("wide")) == 2
    assert [x for x in read("array") if x[0]] == every
    assert readers.any_json(spark, str(tmp_path / "lines"), "k string, a int").rdd.getNumPartitions() > 5
    assert len(read(".")) == 3 * 300 + 3


def test_readers_see_whole_versions(spark, tmp_path):
    """A reader in a loop during 50 writes never fails, and never sees a mix."""
    path, seen, failed, done = str(tmp_path / "t"), [], [], threading.Event()
    with pytest.raises(FileNotFoundError):
        writers.read_atomic(spark, path)
    version = lambda k: spark.range(40).select(F.lit(k).alias("v"), F.col("id")).repartition(3)
    writers.write_atomic(version(0), path)

    def look():
        while not done.is_set():
            try:
                seen.append(sorted(tuple(r) for r in writers.read_atomic(spark, path).groupBy("v").count().collect()))
            except Exception as e:  # noqa: BLE001
                failed.append(e)

    reader = threading.Thread(target=look)
    reader.start()
    for k in range(1, 51):
        writers.write_atomic(version(k), path)
    done.set()
    reader.join()
    assert not failed and len(seen) > 3 and all(len(s) == 1 and s[0][1] == 40 for s in seen) and [s[0][0] for s in seen] == sorted(s[0][0] for s in seen)
    assert writers.read_atomic(spark, path).first()["v"] == 50
    # a writer that died leaves nothing that is read; versions long replaced go
    version(99).write.parquet(f"{path}/versions/died")
    writers.write_atomic(version(51), path, keep_hours=0.0)
    assert writers.read_atomic(spark, path).first()["v"] == 51
    writers.write_atomic(version(52), path, keep_hours=0.0)
    assert writers.read_atomic(spark, path).first()["v"] == 52 and len(list((tmp_path / "t" / "current").glob("0*"))) <= 2


def test_numbers_in_order(spark):
    r = random.Random(1)
    values = [r.randrange(500) for _ in range(2000)]
    d = spark.createDataFrame([(v, k) for k, v in enumerate(values)], "v int, k int").repartition(7)
    got = ordinals.numbered(d, "v", "k").orderBy("row").collect()
    assert [x["row"] for x in got] == list(range(2000)) and [(x["v"], x["k"]) for x in got] == sorted((v, k) for k, v in enumerate(values))
    assert ordinals.numbered(d.limit(0), "v").count() == 0
    got = validate.in_manifest_order(spark.createDataFrame([("b", 1), ("B", 2), ("é", 3), ("a", 4)], "module string, rows int")).collect()
    assert [(x["module"], x["place"]) for x in sorted(got, key=lambda x: x["place"])] == [("B", 1), ("a", 2), ("b", 3), ("é", 4)]


def test_gzip_members_and_digests_are_the_same_every_time(spark, tmp_path):
    rows = [(k % 90, f"text {k} é") for k in range(5000)]
    text = "".join(json.dumps({"m": m, "t": t}, ensure_ascii=False, separators=(",", ":")) + "\n" for m, t in sorted(rows))
    seen, digests = [], []
    for n, parts in ((4, 2), (7, 5), (4, 3)):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        d = spark.createDataFrame(rows, "m int, t string").repartition(parts)
        writers.write_gzip(d, str(tmp_path / f"g{n}{parts}"), "m", rows=700)
        size = writers.join_gzip(spark, str(tmp_path / f"g{n}{parts}"), str(tmp_path / f"all{n}{parts}.gz"))
        seen.append((tmp_path / f"all{n}{parts}.gz").read_bytes())
        digests.append(writers.digest(d, "m"))
        assert len(writers.gzip_members(spark, str(tmp_path / f"g{n}{parts}"))) == 8 and size == len(seen[-1])
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert gzip.decompress(seen[0]).decode() == text and seen[0] == seen[1] == seen[2]
    line = [hashlib.sha256(x.encode()).hexdigest() for x in text.splitlines(keepends=True)]
    blocks = [hashlib.sha256("".join(line[k : k + 4096]).encode()).hexdigest() for k in (0, 4096)]
    assert digests == [{"rows": 5000, "bytes": len(text.encode()), "sha256": hashlib.sha256("".join(blocks).encode()).hexdigest()}] * 3
    none = spark.createDataFrame([], "m int, t string")
    assert writers.digest(none, "m") == {"rows": 0, "bytes": 0, "sha256": hashlib.sha256(b"").hexdigest()}


def test_stream_keeps_the_index_of_a_whole_read(spark, tmp_path):
    """Batches with repeats and bad lines, a late file, a restart after a batch that was written but not noted, a merge: as one read over all files."""
    source, folder = tmp_path / "in", str(tmp_path / "index")
    source.mkdir()
    r = random.Random(5)

    def add(name, n):
        rows = [json.dumps({"k": f"k{r.randrange(25)}", "a": r.randrange(10**6)}) for _ in range(n)]
        for k in range(0, n, 13):
            rows[k] = r.choice(["broken", '{"a":1}', "", "[1]"])
        (source / f"{name}.jsonl").write_text("\n".join(rows))

    def agree():
        want, said = readers.corpus_index(spark, SCHEMA, "k", str(source))
        got, told = corpus.followed_index(spark, folder, SCHEMA, "k")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert tuple(told.first()) == tuple(said.first())

    follow = lambda most: corpus.follow_corpus(spark, str(source), SCHEMA, "k", folder, most_files=1, most_deltas=most)
    for name in ("f2", "f3"):
        add(name, 60)
    follow(16)
    agree()
    add("f1", 80)  # late, and earlier by its path: changes only keys that nothing later names
    follow(16)
    agree()
    for note in sorted((tmp_path / "index" / "stream" / "commits").glob("*"))[-1:]:  # as if the run had ended before its last batch was noted
        note.unlink()
    for note in (tmp_path / "index" / "stream" / "commits").glob(".*2.crc"):
        note.unlink()
    follow(16)
    agree()
    shutil.rmtree(tmp_path / "index" / "bad" / "batch=000000000002")  # as if it had ended within its last batch
    for note in [*(tmp_path / "index" / "stream" / "commits").glob("2"), *(tmp_path / "index" / "stream" / "commits").glob(".2.crc")]:
        note.unlink()
    follow(2)
    agree()
    add("f4", 40)
    follow(0)
    agree()
    follow(0)
    agree()


def test_whole_rows_are_normalised(spark):
    rows = [(" a/b.agda ", "  ", " lem\n x", None, " p  q ", ["<b.lem x>", "lem x", "Foo.y.", " Foo.y", "", "z"]), (None, "M", "n", "", None, None)]
    d = spark.createDataFrame(rows, "file string, module string, name string, type string, proof string, premises array<string>")
    got = [r["v"] for r in d.select(X.normal_row(*(F.col(c) for c in d.columns)).alias("v")).collect()]
    assert tuple(got[0]) == ("a/b.agda", None, "lem x", None, "p q", ["Foo.y", "z"]) and tuple(got[1]) == ("", "M", "n", "", None, [])


def test_notes_and_source_paths(spark):
    text = "a\n @@NOTE_START\\| T x @@\nb\n\n@@NOTE_END@@\nc\n@@NOTE_END@@\n@@NOTE_START@@\nd\n"
    d = spark.createDataFrame([(text,), ("",), (None,)], "t string").select(X.noted(F.col("t"), "@@NOTE_START", "@@NOTE_END@@", "Note").alias("v"))
    assert [r["v"] for r in d.collect()] == ['a\n\n??? note "T x"\n    b\n    \nc\n@@NOTE_END@@\n\n??? note "Note"\n    d\n', "\n", None]
    paths = spark.createDataFrame([(p,) for p in ("src/B.agda", "src/a.lagda.md", "src/x.lagda/readme", "src/A.agdai", "other/C.agda", "src/n.md")], "path string")
    assert [r["path"] for r in readers.sources_among(paths, "src/").collect()] == ["src/B.agda", "src/a.lagda.md"]
    assert readers.sources_among(paths, "").count() == 3


def test_a_digest_has_two_levels_however_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(writers, "BLOCK", 4)
    d = spark.range(70).select("id")
    line = [hashlib.sha256(f'{{"id":{k}}}\n'.encode()).hexdigest() for k in range(70)]
    block = lambda k: hashlib.sha256("".join(line[k : k + 4]).encode()).hexdigest()
    assert writers.digest(d, "id")["sha256"] == hashlib.sha256("".join(block(k) for k in range(0, 70, 4)).encode()).hexdigest()
    assert writers.digest(d.limit(4), "id")["sha256"] == block(0)
    assert writers.digest(d.limit(1), "id")["sha256"] == hashlib.sha256(line[0].encode()).hexdigest()
