"""Derived rows: features, contexts, completion rows, training triples, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import ast as A
from quern.functions import telescope as S
from quern.functions import text as X

#: Sort tags of types that completion rows are made for.
SORTS = ("Inf", "OtherSort", "Set")
#: Rows of a group whose contexts are made in one place on end.
TOLD = 64
FEATURES = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("module", T.StringType()), T.StructField("name", T.StringType()), T.StructField("qname", T.StringType()),
    T.StructField("type", T.StringType()), T.StructField("typeAst", T.StringType()), T.StructField("defKind", T.StringType()), T.StructField("dependencies", T.ArrayType(T.StringType())),
    T.StructField("astSize", T.StringType()), T.StructField("body", T.StringType()), T.StructField("hasBody", T.StringType()),
])


def features(lines: DataFrame, raw: str = "raw") -> DataFrame:
    """Feature rows of JSON lines that have a type. Each line is parsed once; nested trees stay JSON text, invalid lines give nulls and go."""
    row = F.from_json(raw, FEATURES)
    d = lines.select(row.alias("r")).select("r.*")
    n = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))).cast("long")
    d = d.withColumns({
        "dependencies": F.coalesce("dependencies", F.array().cast("array<string>")), "astSize": F.col("astSize").try_cast("int"), "hasBody": F.col("hasBody").try_cast("boolean"),
        "len_type": n("type"), "len_body": n("body"), "len_proof": n("body"), "has_type_ast": F.col("typeAst").isNotNull(), "type_ast_chars": n("typeAst"),
    })
    return d.where(F.length("type") > 0)


def row_summary(df: DataFrame) -> DataFrame:
    """Fallbacks for what a row lacks: module for its pretty form, the type's length for the size, a body for the flag, unknown for the kind."""
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    return df.select("pretty_qname", F.coalesce(filled("pretty_module"), F.col("module")).alias("module"), F.coalesce(filled("def_kind"), F.lit("unknown")).alias("def_kind"),
                     F.coalesce("ast_size", F.length("type")).cast("long").alias("ast_size"), F.coalesce("has_body", F.coalesce(F.length("body"), F.lit(0)) > 0).alias("has_body"))


def theories(rows: DataFrame, by: list[str], name: str, type_: str, order: str) -> DataFrame:
    """(*by, lines array<struct<ord, name, line>>): what each group's rows with a type say, once, in order."""
    line = F.struct(F.col(order).alias("ord"), F.col(name).alias("name"), F.concat(name, F.lit(" : "), type_).alias("line"))
    return rows.where(F.col(type_).isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(line)).alias("lines"))


def context_of(lines: Column, name: Column) -> Column:
    """A row's context, read from its group's lines: all but those of its own name."""
    return F.transform(F.filter(lines, lambda x: x["name"] != name), lambda x: x["line"])


def proof_contexts(rows: DataFrame, by: list[str], name: str, type_: str, order: str) -> DataFrame:
    """(*by, goal, goal_type, context): for each row with a type the other names of its group with theirs, in order.

    A group's lines are stored once (theories) and met by each of its rows, one row of theirs for each; a context is made where it is read.
    As long as a context is asked for whole, one group's lines are a value of a row. Rows of a group are dealt out, TOLD and TOLD in turn,
    to as many units as there are cores, and each unit has a copy of the lines: few bytes, of which far more are made.
    A context may have megabytes, and Parquet's writer gathers a hundred values before it looks at their size: for the session, it looks after each row.
    """
    spark = rows.sparkSession
    for key, value in (("parquet.page.size.check.estimate", "false"), ("parquet.page.size.row.check.min", "1"), ("parquet.block.size.row.check.min", "1")):
        spark.conf.set(key, value)
    cores = spark.sparkContext.defaultParallelism
    group = F.struct(*[F.col(c).alias(c) for c in by]).alias("group")  # nulls within are equal
    goal = rows.where(F.col(type_).isNotNull()).select(group, F.col(name).alias("goal"), F.col(type_).alias("goal_type"), F.col(order).alias("goal_ord"))
    nth = F.row_number().over(Window.partitionBy("group").orderBy("goal_ord")) - 1
    goal = goal.withColumn("part", F.pmod(F.floor(nth / TOLD), F.lit(cores)).cast("int"))
    parts = F.sequence(F.lit(0), F.least(F.lit(cores), F.ceil(F.size("lines") / TOLD)).cast("int") - 1)
    told = theories(rows, by, name, type_, order).select(group, "lines", F.inline(F.transform(parts, lambda k: F.struct(k.alias("part")))))
    # a number of partitions that stays, by their bytes alone all would come to lie in one; units of a group lie in one each
    placed = lambda d: d.withColumn("at", F.pmod(F.hash("group") % (4 * cores) + F.col("part"), F.lit(4 * cores)).cast("int")).repartitionById(4 * cores, "at")
    met = placed(goal).join(placed(told), ["at", "group", "part"])
    return met.select("group.*", "goal", "goal_type", "goal_ord", context_of(F.col("lines"), F.col("goal")).alias("context"))


def skip_reason(raw_ok: Column, has_body: Column, body: Column, ast: Column) -> Column:
    """Why a row gives no completion row; null if it gives one. The first that holds."""
    return (
        F.when(~F.coalesce(raw_ok, F.lit(False)), "parse_error")
        .when(~F.coalesce(has_body, F.lit(False)) | (F.coalesce(F.trim(body), F.lit("")) == ""), "no_body")
        .when(F.trim(body).rlike(r"\s"), "not_simple_body")
        .when(ast.isNull(), "output_row:type_ast")
        .when(F.coalesce(A.sort_tag(ast), F.lit("")).isin("", *SORTS) == F.lit(False), "output_row:unsupported_sort")
        .when(F.get_json_object(ast, "$").isNull(), "output_row:type_ast")
    )


def completion_rows(rows: DataFrame) -> DataFrame:
    """(qname, goal, context, target_raw, target, resolver, resolved, had_anonymous, head) of rows (qname, type, body, ast)."""
    d = rows.withColumn("binders", A.pi_binders(F.col("ast"))).withColumn("names", A.binder_names(F.col("binders")))
    d = d.withColumn("parsed", S.telescope("type"))
    d = d.withColumn("parts", X.split_arrows(F.col("parsed.rest"))).withColumn("cg", S.context_and_goal(F.col("parsed"), F.col("parts"), F.col("names")))
    body = F.trim("body")
    at, had = A.resolve_index(body, F.col("names")), X.anonymous(body)
    resolver = F.when(at.isNotNull(), "at_index").when(had, "anonymous_module").otherwise("raw")
    target = F.coalesce(at, F.when(had, X.drop_anonymous(body)), body)
    return d.select("qname", "cg.goal", "cg.context", body.alias("target_raw"), target.alias("target"), resolver.alias("resolver"), at.isNotNull().alias("resolved"), had.alias("had_anonymous"), X.head_symbol(body).alias("head"))


def instruction_triples(df: DataFrame, module: str, name: str, type_: str, body: str, instruction: str = "Complete the proof.") -> DataFrame:
    head = F.concat_ws("\n", F.when(F.length(F.trim(module)) > 0, F.concat(F.lit("module "), F.trim(module))), F.when(F.length(F.trim(name)) > 0, F.concat(F.lit("lemma "), F.trim(name))))
    text = F.concat_ws("\n", F.when(head != "", head), F.when(head != "", F.lit("")), F.trim(type_))
    return df.select(F.lit(instruction).alias("instruction"), text.alias("input"), F.coalesce(F.trim(body), F.lit("")).alias("output"))


def train_records(df: DataFrame, module: str, name: str, type_: str, premises: str) -> DataFrame:
    return df.select(F.coalesce(module, F.lit("<none>")).alias("module"), F.col(name).alias("name"), F.coalesce(type_, F.lit("")).alias("type"), F.array_join(premises, " ").alias("premises"))


def ports(ast: Column) -> Column:
    """struct(inputs, outputs): a type's binders, and 1 for what it gives."""
    return F.struct(A.pi_arity(ast).cast("long").alias("inputs"), F.lit(1).cast("long").alias("outputs"))


def wires(dependencies: Column, body: Column) -> Column:
    """Names that the type or the body mentions, sorted."""
    return F.array_sort(F.array_union(F.coalesce(dependencies, F.array().cast("array<string>")), F.coalesce(X.dependency_tokens(body), F.array().cast("array<string>"))))


#: The columns of a feature row, in the order that readers rely on, and the keys of a minimal row.
CONTRACT = ("file", "module", "name", "qname", "prettyModule", "prettyName", "prettyQname", "type", "typeAstVersion", "typeAst", "defKind", "dependencies", "astSize", "body", "hasBody")
MINIMAL = (*CONTRACT[:10], "kind", *CONTRACT[10:])


def contract_order(df: DataFrame, columns: tuple[str, ...] = CONTRACT) -> DataFrame:
    """The contract's columns that df has, in the contract's order, and what else it has after them."""
    first = [c for c in columns if c in df.columns]
    return df.select(*first, *[c for c in df.columns if c not in first])


def minimal(df: DataFrame, keys: tuple[str, ...] = MINIMAL) -> DataFrame:
    """The columns of the whitelist that df has."""
    return df.select(*[c for c in keys if c in df.columns])


def corpus_entries(df: DataFrame, required: tuple[str, ...] = ("pretty_qname", "pretty_name", "module", "type")) -> DataFrame:
    """Rows for a search index: without tree and body, of which a flag is left; rows that lack a required field go."""
    keep = F.lit(True)
    for c in required:
        keep &= F.col(c).isNotNull()
    out = df.where(keep).withColumn("has_body", F.coalesce(F.length("body"), F.lit(0)) > 0)
    return out.drop("body", "type_ast")


def trainer_features(df: DataFrame, type_: str = "type", body: str = "body", label: str = "label") -> DataFrame:
    """(len_type, len_body, label): lengths, null as empty, and the label, 0 where there is none."""
    n = lambda c: F.length(F.coalesce(F.col(c), F.lit(""))).cast("long")
    y = F.coalesce(F.col(label), F.lit(0)) if label in df.columns else F.lit(0)
    return df.select(n(type_).alias("len_type"), n(body).alias("len_body"), y.cast("long").alias("label"))


def file_rows(files: DataFrame, module: str, text: str) -> DataFrame:
    """(module, size_bytes, num_lines, raw) of source files: a last line counts also without its end."""
    raw = F.col(text)
    ends = F.length(raw) - F.length(F.replace(raw, F.lit("\n"), F.lit("")))
    return files.select(F.col(module).alias("module"), F.octet_length(raw).cast("long").alias("size_bytes"), (ends + F.when((raw == "") | F.endswith(raw, F.lit("\n")), 0).otherwise(1)).cast("long").alias("num_lines"), raw.alias("raw"))
