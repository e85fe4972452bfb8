"""Sinks: tables for SQL, schemas, index-encoded catalogs, pair files, fine-tuning sets, run outputs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skemara.operators.catalog import Schema, Tables
from skemara.sources.scratch import small, stored


def materialise(tables: Tables, folder: str, keys: dict[str, str] | None = None, partitions: int | None = None) -> Tables:
    """Write tables as Parquet, replacing what is there, sorted by their join key where one is named so that row groups can be skipped; register them as views."""
    out = {}
    for name, df in tables.items():
        key = (keys or {}).get(name)
        if key:
            df = (df.repartitionByRange(partitions, key) if partitions else df.repartitionByRange(key)).sortWithinPartitions(key)
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
        out[name] = df.sparkSession.read.parquet(f"{folder}/{name}")
        out[name].createOrReplaceTempView(name)
    return out


def bucketed(df: DataFrame, name: str, key: str, buckets: int) -> None:
    """A warehouse table bucketed and sorted by its join key: joins on it need no shuffle."""
    df.write.mode("overwrite").bucketBy(buckets, key).sortBy(key).saveAsTable(name)


def save_schema(spark: SparkSession, schema: Schema, path: str) -> None:
    """The schema as one JSON object."""
    row = ([(t, k) for t, k in sorted(schema.primary.items())], [(f.child, list(f.columns), f.parent, list(f.parent_columns), float(f.coverage)) for f in schema.foreign], schema.target)
    kind = "primary array<struct<table:string,key:string>>, foreign array<struct<child:string,columns:array<string>,parent:string,parent_columns:array<string>,coverage:double>>, target string"
    spark.createDataFrame([row], kind).coalesce(1).write.mode("overwrite").json(path)


def encode_catalog(columns: DataFrame, fks: DataFrame, target: str | None = None) -> DataFrame:
    """(db_id, table_names_original, column_names_original, column_types, foreign_keys): the target first, then tables by name; self references and repeats are left out."""
    order = Window.partitionBy("db_id").orderBy(F.when(F.col("table") == F.lit(target), 0).otherwise(1), "table")
    tables = columns.select("db_id", "table").distinct().withColumn("t", F.row_number().over(order) - 1)
    at = columns.join(tables, ["db_id", "table"]).withColumn("c", F.row_number().over(Window.partitionBy("db_id").orderBy("t", "ordinal")))
    names = tables.groupBy("db_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("t", "table"))), lambda x: x["table"]).alias("table_names_original"))
    cols = at.groupBy("db_id").agg(F.array_sort(F.collect_list(F.struct("c", "t", "column", "dtype"))).alias("_c"))
    star = F.array(F.array(F.lit("-1"), F.lit("*")))
    cols = cols.select("db_id", F.concat(star, F.transform("_c", lambda x: F.array(x["t"].cast("string"), x["column"]))).alias("column_names_original"), F.concat(F.array(F.lit("text")), F.transform("_c", lambda x: x["dtype"])).alias("column_types"))
    end = lambda n: at.select("db_id", F.col("table").alias(f"{n}_table"), F.col("column").alias(f"{n}_column"), F.col("c").alias(n))
    keys = ["db_id", "{0}_table", "{0}_column"]
    pairs = fks.filter("child_table <> parent_table").join(end("child"), [k.format("child") for k in keys]).join(end("parent"), [k.format("parent") for k in keys])
    pairs = pairs.select("db_id", F.array("child", "parent").alias("p")).distinct().groupBy("db_id").agg(F.array_sort(F.collect_list("p")).alias("foreign_keys"))
    return names.join(cols, "db_id").join(pairs, "db_id", "left").withColumn("foreign_keys", F.coalesce("foreign_keys", F.array().cast("array<array<int>>")))


def tuning_rows(pairs: DataFrame, form: str, system: str = "Write the SQL that answers the question.") -> DataFrame:
    """(value): a JSON line per valid pair in the form alpaca, sharegpt, openai or gemini."""
    good = pairs.filter(F.coalesce("is_valid", F.lit(True)))
    q, a, s = F.col("question"), F.col("sql"), F.lit(system)
    turn = lambda x, y, ka, kb: F.struct(F.lit(x).alias(ka), y.alias(kb))
    shapes: dict[str, Column] = {
        "alpaca": F.struct(s.alias("instruction"), q.alias("input"), a.alias("output")),
        "sharegpt": F.struct(F.array(turn("system", s, "from", "value"), turn("human", q, "from", "value"), turn("gpt", a, "from", "value")).alias("conversations")),
        "openai": F.struct(F.array(turn("system", s, "role", "content"), turn("user", q, "role", "content"), turn("assistant", a, "role", "content")).alias("messages")),
        "gemini": F.struct(F.array(F.struct(F.lit("user").alias("role"), F.array(F.struct(F.concat_ws("\n", s, q).alias("text"))).alias("parts")), F.struct(F.lit("model").alias("role"), F.array(F.struct(a.alias("text"))).alias("parts"))).alias("contents")),
    }
    if form not in shapes:
        raise ValueError(f"unknown form {form}; there are {', '.join(shapes)}")
    return good.select(F.to_json(shapes[form]).alias("value"))


def distributions(pairs: DataFrame) -> DataFrame:
    """(axis, key, n) by class and by tier."""
    one = lambda c: pairs.groupBy(F.lit(c).alias("axis"), F.col(c).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return one("strategy").unionByName(one("tier"))


def review_rows(pairs: DataFrame) -> DataFrame:
    """Pairs flat for a CSV: arrays joined by "; "."""
    flat = [F.array_join(F.col(c).cast("array<string>"), "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in pairs.dtypes]
    return pairs.select(*flat)


def markdown(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(line) of a Markdown table's body."""
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), F.lit(" |")).alias("line"))


def write_summary(summary: DataFrame, per_class: DataFrame, folder: str, label: str) -> None:
    """A run's summary as JSON, its tables as CSV and Markdown."""
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/{label}.json")
    per_class.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/{label}_classes.csv")
    markdown(per_class, per_class.columns).coalesce(1).write.mode("overwrite").text(f"{folder}/{label}.md")


def todo(wanted: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """What a run has still to do."""
    return wanted.join(done.select(*keys).distinct(), keys, "left_anti")


def write_resumable(rows: DataFrame, path: str, keys: list[str]) -> None:
    """Write partitions by key, replacing only those that are written; a partition appears when its job commits."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def failures(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    """(db_id, reason, failed_at) to append to a run's failures."""
    return spark.createDataFrame(rows, "db_id string, reason string").withColumn("failed_at", F.current_timestamp())


def with_provenance(rows: DataFrame, **facts: str) -> DataFrame:
    """`rows` with a struct of facts about where they come from."""
    return rows.withColumn("provenance", F.struct(*(F.lit(v).alias(k) for k, v in sorted(facts.items()))))


#: Records of one nested row at most; a larger shard is several rows, told apart by `part`.
CHUNK = 1000


def chunked(rows: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """`rows` with part, so that a part of a key has about `size` rows, as many parts as the key's count asks for.

    Parts go by a number that each row gets once, in a stored table, so rows that are alike or lack a key are spread like others.
    """
    rows = stored(rows.withColumn("_i", F.monotonically_increasing_id()), "numbered")
    counts = rows.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / size).alias("_parts"))
    same = reduce(lambda a, b: a & b, (F.col(f"x.{k}").eqNullSafe(F.col(f"c.{k}")) for k in keys))
    met = rows.alias("x").join(small(stored(counts, "shard-sizes")).alias("c"), same)
    return met.select("x.*", F.pmod(F.xxhash64("x._i"), F.col("_parts")).cast("int").alias("part")).drop("_i")


def evaluation_document(details: DataFrame, size: int = CHUNK) -> DataFrame:
    """(mode, db_id, part, n, results): nested records per mode and cluster, results in order of uid. Details have mode, db_id, uid and more.

    A cluster of more than `size` results is several rows, so no row grows with the data.
    """
    rest = [c for c in details.columns if c not in ("mode", "db_id")]
    parts = chunked(details, ["mode", "db_id"], size)
    return parts.groupBy("mode", "db_id", "part").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("uid", *(c for c in rest if c != "uid")))).alias("results"))


def evaluation_shards(records: DataFrame, size: int = CHUNK) -> DataFrame:
    """(value): a JSON line {db_id, model, records} per shard and part of about `size` records. Records have db_id, model, uid and more."""
    rest = [c for c in records.columns if c not in ("db_id", "model")]
    shards = chunked(records, ["db_id", "model"], size).groupBy("db_id", "model", "part").agg(F.collect_list(F.struct(*rest)).alias("records"))
    return shards.select(F.to_json(F.struct("db_id", "model", "records")).alias("value"))


def pair_documents(pairs: DataFrame, size: int = CHUNK) -> DataFrame:
    """(value): a JSON line {db_id, qa_pairs} per database and part of about `size` pairs. Pairs have db_id, sql and more."""
    rest = [c for c in pairs.columns if c != "db_id"]
    parts = chunked(pairs, ["db_id"], size).groupBy("db_id", "part").agg(F.collect_list(F.struct(*rest)).alias("qa_pairs"))
    return parts.select(F.to_json(F.struct("db_id", "qa_pairs")).alias("value"))
