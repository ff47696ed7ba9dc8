"""Sources: JSON lines in four error modes, whole JSON documents, CSV, Parquet, module lists, module graphs, source trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import module_of_path
from quern.operators.ordinals import numbered_in_splits
from quern.sources.shared import hadoop_path


def raw_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(raw) of text or .gz files."""
    return spark.read.text(list(paths)).withColumnRenamed("value", "raw")


def lines_from(spark: SparkSession, stream) -> DataFrame:
    """(raw) of an open text stream, as standard input is: it has no place of its own that executors could read, so its lines go through the driver."""
    return spark.createDataFrame([(line.rstrip("\n"),) for line in stream], "raw string")


#: Splits of files whose counts may go to every task: some 100 bytes each.
MOST_SPLITS = 200_000


def split_lines(lines: DataFrame) -> DataFrame:
    """(path, block, raw) of a text read, batch or stream: each line's file, and where its split begins."""
    return lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("raw"))


def numbered_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """(path, line_no, raw), lines from 1 in each file.

    Files are read in splits, by many tasks each: the lines of a split are counted, and the counts before it give its first
    number. The text is read twice, once to count; its splits are planned once for both. Compressed files are one split.
    """
    lines = split_lines(spark.read.text(list(paths)))
    small = len(lines.inputFiles()) + lines.rdd.getNumPartitions() <= MOST_SPLITS  # no more splits than that, known without a job
    return numbered_in_splits(lines, small=small).select("path", "line_no", "raw")


def jsonl_strict(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame:
    """Typed JSON lines; the first bad one stops the read, and the error names its path:line. Blank lines don't count."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    d = numbered_lines(spark, *paths).where(F.trim("raw") != "")
    d = d.withColumn("r", F.from_json("raw", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    stop = F.raise_error(F.concat("path", F.lit(":"), F.col("line_no").cast("string"), F.lit(": not a row: "), F.substring("raw", 1, 200)))
    checked = F.when(bad, stop.cast(T.StructType(wide.fields))).otherwise(F.col("r"))
    return d.select(checked.alias("r")).select(*[F.col(f"r.{f.name}") for f in schema])


def corpus_rows(spark: SparkSession, schema: T.StructType, *paths: str) -> DataFrame:
    """Typed rows of a corpus: a bad line is an error that names its path:line, and so is a corpus without rows."""
    rows = jsonl_strict(spark, schema, *paths)
    if rows.isEmpty():
        raise ValueError(f"no rows in {', '.join(paths)}")
    return rows


def judged(lines: DataFrame, schema: T.StructType, key: str) -> DataFrame:
    """(path, line_no, r, bad) of numbered lines that aren't blank: r as the schema says, bad where a line is no row or lacks its key."""
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    d = lines.where(F.trim("raw") != "").withColumn("r", F.from_json("raw", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}))
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull() | F.col(f"r.{key}").isNull()
    return d.select("path", "line_no", "r", bad.alias("bad"))


def corpus_index(spark: SparkSession, schema: T.StructType, key: str, *paths: str, samples: int = 3) -> tuple[DataFrame, DataFrame]:
    """(the last row of each key, one row: bad lines and the first of them as path:line)."""
    from quern.operators.curate import keep_last

    d = judged(numbered_lines(spark, *paths), schema, key)
    rows = d.where(~F.col("bad")).select(*[F.col(f"r.{f.name}") for f in schema], "path", "line_no")
    first = d.where("bad").orderBy("path", "line_no").limit(samples)
    said = first.agg(F.array_sort(F.collect_list(F.struct("path", "line_no"))).alias("l")).select(F.transform("l", lambda x: F.concat(x["path"], F.lit(":"), x["line_no"].cast("string"))).alias("samples"))
    report = d.where("bad").agg(F.count("*").alias("bad_lines")).crossJoin(said)  # one row each
    return keep_last(rows, [key], ["path", "line_no"]).select(*[f.name for f in schema]), report


def files_under(spark: SparkSession, path: str) -> list[str]:
    """The files that a read of this path takes."""
    return sorted(spark.read.text(path).inputFiles())


def first_line(spark: SparkSession, path: str, step: int = 1 << 16) -> str:
    """The first line of a file that isn't blank, from its first bytes; unpacked if need be. Longer ones are read to their end."""
    fs, p = hadoop_path(spark, path)
    codec = spark.sparkContext._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark.sparkContext._jsc.hadoopConfiguration()).getCodec(p)
    stream = fs.open(p) if codec is None else codec.createInputStream(fs.open(p))
    try:
        read = b""
        while True:
            more = bytes(stream.readNBytes(step))
            read = (read + more).lstrip(b" \t\r\n\xef\xbb\xbf")
            if b"\n" in read or len(more) < step:
                return read.split(b"\n", 1)[0].decode("utf-8", "replace")
    finally:
        stream.close()


def any_json(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Rows of files that are each one JSON document, an array or an object, or JSON lines.

    A file's first line decides: a whole object by itself begins JSON lines (or is a document of one line, which is the same), anything else
    a document. Lines are read in splits, by many tasks; a document is one value, as its parts can't be told without the whole.
    """
    order_mark = F.lit("\ufeff")
    files = files_under(spark, path)
    first = spark.createDataFrame([(f, first_line(spark, f)) for f in files], "path string, line string")
    lined = {r["path"] for r in first.where(F.json_object_keys("line").isNotNull()).collect()}
    documents = [f for f in files if f not in lined]
    row = schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)
    text = row.simpleString()
    parts = []
    if lined:
        lines = spark.read.text(sorted(lined)).where(F.trim("value") != "")
        parts.append(lines.select(F.from_json(F.ltrim("value", order_mark), row).alias("r")))
    if documents or not parts:
        whole = spark.read.text(documents or path, wholetext=True).select(F.ltrim("value", order_mark).alias("raw"))
        listed = F.when(F.startswith(F.ltrim("raw"), F.lit("[")), F.from_json("raw", f"array<{text}>")).otherwise(F.array(F.from_json("raw", text)))
        parts.append(whole.select(F.explode(listed).alias("r")))
    out = parts[0] if len(parts) == 1 else parts[0].unionAll(parts[1])
    return out.select("r.*")


def inferred(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines whose columns are found by reading them."""
    return spark.read.json(path)


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str, mode: str = "FAILFAST") -> DataFrame:
    """Typed JSON lines: FAILFAST stops at a bad line, DROPMALFORMED leaves it out."""
    return spark.read.schema(schema).option("mode", mode).json(path)


def jsonl_partitioned(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad raw lines): blank lines and those that start with # are neither."""
    lines = raw_lines(spark, path).where((F.trim("raw") != "") & ~F.startswith(F.ltrim("raw"), F.lit("#")))
    wide = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    parsed = lines.select("raw", F.from_json("raw", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r"))
    bad = F.col("r._bad").isNotNull() | F.col("r").isNull()
    return parsed.where(~bad).select(*[F.col(f"r.{f.name}") for f in schema]), parsed.where(bad).select("raw")


def json_objects(spark: SparkSession, path: str) -> DataFrame:
    """Raw lines that are JSON objects."""
    return raw_lines(spark, path).where(F.json_object_keys("raw").isNotNull())


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A whole-file JSON document: an array gives many rows, an object one."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def two_shapes(lines: DataFrame, item: str, raw: str = "raw") -> DataFrame:
    """Items of a JSON root that is an array, or an object with a local and a private list."""
    both = F.from_json(raw, f"struct<`scope-local`: array<{item}>, `scope-private`: array<{item}>>")
    empty = F.array().cast(f"array<{item}>")
    listed = F.when(F.startswith(F.ltrim(raw), F.lit("[")), F.from_json(raw, f"array<{item}>")).otherwise(F.concat(F.coalesce(both["scope-local"], empty), F.coalesce(both["scope-private"], empty)))
    return lines.select(F.inline(listed))


def csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings, by header."""
    return spark.read.option("header", True).csv(path)


def parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def module_list(spark: SparkSession, path: str) -> DataFrame:
    """(module): trimmed, distinct, sorted, without blanks and # lines."""
    m = F.trim("raw")
    return raw_lines(spark, path).select(m.alias("module")).where((F.col("module") != "") & ~F.startswith("module", F.lit("#"))).distinct().orderBy("module")


def dot_graph(lines: DataFrame, exclude: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(nodes (label), edges (src, dst)) of id[label="L"]; and a -> b; lines; edges with an unknown or excluded end go."""
    label = F.regexp_extract("raw", r'^\s*(\w+)\s*\[label="([^"]*)"', 2)
    nodes = lines.select(F.regexp_extract("raw", r'^\s*(\w+)\s*\[label=', 1).alias("id"), label.alias("label")).where((F.col("id") != "") & ~F.col("label").isin(*exclude, ""))
    ends = lines.select(F.regexp_extract("raw", r"^\s*(\w+)\s*->\s*(\w+)", 1).alias("a"), F.regexp_extract("raw", r"^\s*(\w+)\s*->\s*(\w+)", 2).alias("b")).where(F.col("a") != "")
    a, b = nodes.select(F.col("id").alias("a"), F.col("label").alias("src")), nodes.select(F.col("id").alias("b"), F.col("label").alias("dst"))
    return nodes.select("label").distinct(), ends.join(a, "a").join(b, "b").select("src", "dst").distinct()


def source_modules(spark: SparkSession, root: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """(module, path) of source files under root; their content isn't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{agda,lagda,lagda.md,lagda.rst,lagda.tex,lagda.org}").load(root).select("path")
    inner = F.regexp_replace("path", r"^file:/*", "/")
    return files.select(module_of_path(inner, root).alias("module"), inner.alias("path")).where(~F.col("module").isin(*exclude) if exclude else F.lit(True))


#: How names of plain source files end, and what names of literate ones hold.
PLAIN_END, LITERATE = ".agda", ".lagda"


def is_source_path(path):
    """Whether a path column names a source file, plain or literate."""
    return F.endswith(path, F.lit(PLAIN_END)) | F.contains(F.substring_index(path, "/", -1), F.lit(LITERATE))


def sources_among(paths: DataFrame, folder: str, path: str = "path") -> DataFrame:
    """The source files under a folder (a relative one; "" is all) among rows of paths, in order."""
    prefix = F.lit(folder.rstrip("/") + "/" if folder else "")
    return paths.where(F.startswith(path, prefix) & is_source_path(F.col(path))).orderBy(path)


def library(lines: DataFrame) -> DataFrame:
    """One row of a library descriptor: its name (default library) and include folders (default .)."""
    name, include = F.regexp_extract("raw", r"^name:\s*(\S+)", 1), F.regexp_extract("raw", r"^\s*include:\s*(.+?)\s*$", 1)
    return lines.agg(F.coalesce(F.max(F.nullif(name, F.lit(""))), F.lit("library")).alias("name"), F.split(F.coalesce(F.max(F.nullif(include, F.lit(""))), F.lit(".")), r"\s+").alias("include"))


#: What pins a locked input.
PINS = ("type", "owner", "repo", "rev", "ref", "narHash", "url")


def lock_pins(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """(node, key, value) of a lock file's locked nodes; the root goes."""
    nodes = F.from_json(F.get_json_object(raw, "$.nodes"), "map<string, struct<locked: map<string, string>>>")
    d = lines.select(F.explode(nodes).alias("node", "v")).where((F.col("node") != "root") & F.col("v.locked").isNotNull())
    return d.select("node", F.explode("v.locked").alias("key", "value")).where(F.col("key").isin(*PINS))


def synthetic(spark: SparkSession, n: int, modules: int = 7, premises: int = 4) -> DataFrame:
    """n made-up rows by arithmetic: the same on every run."""
    i = F.col("id")
    deps = F.transform(F.sequence(F.lit(1), F.lit(premises)), lambda k: F.concat(F.lit("M"), ((i + k) % modules).cast("string"), F.lit(".p"), ((i * 3 + k) % 11).cast("string")))
    return spark.range(n).select(F.concat(F.lit("M"), (i % modules).cast("string"), F.lit(".agda")).alias("file"), F.concat(F.lit("M"), (i % modules).cast("string")).alias("module"), F.concat(F.lit("lem"), i.cast("string")).alias("name"),
                                 F.concat(F.lit("T"), (i % 5).cast("string"), F.lit(" → T"), (i % 3).cast("string")).alias("type"), F.slice(deps, 1, (i % (premises + 1)).cast("int") + 1).alias("premises"))
