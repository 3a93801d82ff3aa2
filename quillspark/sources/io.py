"""Readers and writers of the file formats around the engine."""

from __future__ import annotations

import glob
import json
import platform
from dataclasses import dataclass
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillspark.sources import schemas


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, observation: Observation | None = None) -> DataFrame:
    """JSON lines; blank lines are skipped, and so are malformed ones (an error with
    ``strict``). With an ``observation`` the scan that reads the rows also counts
    ``lines`` and ``malformed`` ones; it has them after the first action."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    lines = spark.read.text(path).where("trim(value) <> ''")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}
    raw = lines.select(F.from_json("value", f"{schema}, _corrupt string", options).alias("r")).select("r.*")
    if observation is not None:
        raw = raw.observe(observation, F.count(F.lit(1)).alias("lines"), F.count("_corrupt").alias("malformed"))
    return raw.where("_corrupt IS NULL").drop("_corrupt")


def checked(df: DataFrame) -> DataFrame:
    """``df`` with its label, prob, span and candidate rules enforced as rows are read."""
    for column, rule in schemas.CHECKS.items():
        if column in df.columns:
            fault = F.raise_error(F.concat(F.lit(f"{column} breaks its rule: "), F.to_json(F.struct(column)))).cast(df.schema[column].dataType)
            df = df.withColumn(column, F.when(F.expr(f"coalesce({rule}, {column} IS NULL)"), F.col(column)).otherwise(fault))
    return df


def load_models(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A strict typed scan."""
    return checked(read_jsonl(spark, path, schema, strict=True))


def guarded_path(path: str, root: str) -> str:
    """``path`` if it lies below ``root``, else an error. For local paths."""
    full = Path(root, path).resolve()
    if not full.is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} is outside {root}")
    return str(full)


def write_jsonl(df: DataFrame, path: str, single: bool = False) -> None:
    """JSON lines; ``single`` writes one part, for small results."""
    (df.coalesce(1) if single else df).write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)


def read_topics_document(spark: SparkSession, path: str, last: int = 9) -> DataFrame:
    """(cid, text) of a JSON document with a nested criteria array; codes past ``last`` go."""
    from quillspark.functions.text import short_code

    doc = spark.read.schema("diagnosis string, criteria array<struct<id:string,text:string>>").option("multiLine", True).json(path)
    rows = doc.select(F.explode("criteria").alias("c")).select(short_code(F.col("c.id"), last).alias("cid"), F.col("c.text").alias("text"))
    return rows.where("cid IS NOT NULL")


@dataclass(frozen=True)
class RawDataset:
    """The five raw tables, read lazily."""

    posts: DataFrame
    sentences: DataFrame
    labels_sc: DataFrame
    labels_pc: DataFrame
    criteria: DataFrame


def load_raw_dataset(spark: SparkSession, raw_dir: str) -> RawDataset:
    at = lambda name, schema: checked(read_jsonl(spark, f"{raw_dir}/{name}.jsonl", schema))
    criteria = spark.read.schema(schemas.TOPIC).option("multiLine", True).json(f"{raw_dir}/criteria.json")
    return RawDataset(at("posts", schemas.DOCUMENT), at("sentences", schemas.PASSAGE), at("labels_sc", schemas.LABEL_SC), at("labels_pc", schemas.LABEL_PC), criteria)


def filter_dataset(data: RawDataset, post_ids: DataFrame | None) -> RawDataset:
    """Restricted to some posts; None or an empty table is no filter."""
    if post_ids is None or post_ids.isEmpty():
        return data
    ids = post_ids.select("post_id").distinct()
    keep = lambda df: df.join(ids, "post_id", "left_semi")
    return RawDataset(keep(data.posts), keep(data.sentences), keep(data.labels_sc), keep(data.labels_pc), data.criteria)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """post_id of lines that hold post_id or id; other lines are skipped."""
    v = F.col("value")
    found = spark.read.text(path).select(F.coalesce(F.get_json_object(v, "$.post_id"), F.get_json_object(v, "$.id")).alias("post_id"))
    return found.where("post_id IS NOT NULL").distinct()


def _trimmed(c: str) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _listed(v: str, other: Column) -> Column:
    """Items of a JSON list (none of one that breaks off), of {"posts": []}, or ``other``."""
    posts = F.when(F.col(v).startswith("{"), F.get_json_object(v, "$.posts"))
    return F.when(F.col(v).startswith("["), F.from_json(v, "array<string>")).when(posts.isNotNull(), F.from_json(posts, "array<string>")).otherwise(other)


def read_post_ids(spark: SparkSession, path: str) -> DataFrame:
    """post_id from a JSON list of strings or objects, {"posts": []}, {"post_id"}, JSON lines or plain lines.

    Files go by line, so a list of any length is spread over tasks. Only a file
    with a JSON value that runs over several lines is read as one text; the driver
    learns the names of these files.
    """
    lines = spark.read.text(path).select(_trimmed("value").alias("v"), F.col("_metadata.file_path").alias("file")).where("v <> ''")
    value = F.when(F.col("v").startswith("["), F.from_json("v", "array<string>").isNotNull()).when(F.col("v").startswith("{"), F.from_json("v", "map<string,string>").isNotNull())
    broken = ~F.coalesce(value, F.lit(True))
    whole = [r.file for r in lines.where(broken).select("file").distinct().collect()]
    items = lines.where(~F.col("file").isin(whole)).select(F.explode(_listed("v", F.array("v"))).alias("x"))
    if whole:
        texts = spark.read.text([unquote(f) for f in whole], wholetext=True).select(_trimmed("value").alias("v"))
        rows = F.filter(F.transform(F.split("v", "\n"), F.trim), lambda x: x != "")
        one = F.col("v").startswith("{") & (F.size(F.filter(rows, lambda x: x.startswith("{"))) == 1)
        items = items.union(texts.select(F.explode(_listed("v", F.when(one, F.array("v")).otherwise(rows))).alias("x")))
    x = F.col("x")
    of_object = F.coalesce(F.get_json_object(x, "$.post_id"), F.get_json_object(x, "$.id"))
    ids = items.select(F.when(x.startswith("{"), of_object).otherwise(F.regexp_replace(x, '^"|"$', "")).alias("post_id"))
    return ids.where("post_id IS NOT NULL AND post_id <> ''").distinct()


def read_folds(spark: SparkSession, directory: str, schema: str = schemas.OOF_SC) -> DataFrame:
    """The union of fold_N_predictions.jsonl with its fold; none found is an error."""
    paths = sorted(glob.glob(f"{directory}/fold_*_predictions.jsonl")) if "://" not in directory else [f"{directory}/fold_*_predictions.jsonl"]
    if not paths:
        raise FileNotFoundError(f"no fold predictions in {directory}")
    df = spark.read.schema(schema).json(paths)
    return df.withColumn("fold", F.regexp_extract(F.input_file_name(), r"fold_(\d+)_predictions", 1).cast("int"))


def read_optional(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON lines table, or an empty one where there is no file."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    at = jvm.org.apache.hadoop.fs.Path(path)
    return read_jsonl(spark, path, schema) if at.getFileSystem(conf).exists(at) else spark.createDataFrame([], schema)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """A small tidy metric table as one nested JSON object {scope: {metric: value}}."""
    rows = metrics.select("scope", "metric", "value").collect()
    out: dict[str, dict[str, float]] = {}
    for r in rows:
        out.setdefault(str(r.scope), {})[r.metric] = r.value
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(json.dumps(out, indent=2, sort_keys=True))


def flatten(tree: dict, sep: str = ".", prefix: str = "") -> dict:
    """Nested keys joined by ``sep``."""
    out = {}
    for k, v in tree.items():
        key = f"{prefix}{sep}{k}" if prefix else str(k)
        out |= flatten(v, sep, key) if isinstance(v, dict) else {key: v}
    return out


def capture_env(spark: SparkSession) -> DataFrame:
    """One row of versions."""
    return spark.createDataFrame([(platform.python_version(), spark.version, platform.platform())], "python string, spark string, platform string")


def write_index(df: DataFrame, path: str, by: str = "post_id", files: int = 64) -> None:
    """An index table (postings, vectors, vocabulary) as Parquet, clustered by ``by``."""
    df.repartition(files, by).sortWithinPartitions(by).write.mode("overwrite").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_graph(tables: dict[str, DataFrame], path: str) -> None:
    """Node and edge tables, and a one-row metadata table of their sizes."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    sizes = [(name, spark.read.parquet(f"{path}/{name}").count()) for name in tables]
    spark.createDataFrame(sizes, "relation string, n long").write.mode("overwrite").parquet(f"{path}/metadata")
