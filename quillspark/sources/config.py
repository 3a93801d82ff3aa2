"""Run configurations, and the small jobs that read them."""

from __future__ import annotations

import json
import logging
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from quillspark.operators import fusion, splits
from quillspark.sources.io import read_jsonl, read_post_ids, write_jsonl

try:
    import yaml
except ImportError:  # JSON files still work
    yaml = None

LOG = logging.getLogger(__name__)


def load_config(path: str) -> dict:
    """A nested configuration from a JSON or YAML file."""
    text = Path(path).read_text()
    if Path(path).suffix == ".json":
        return json.loads(text)
    if yaml is None:
        raise RuntimeError(f"{path} needs a YAML reader; none is installed")
    return yaml.safe_load(text) or {}


def save_config(config: dict, path: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    as_json = yaml is None or Path(path).suffix == ".json"
    Path(path).write_text(json.dumps(config, indent=2) if as_json else yaml.safe_dump(config, sort_keys=False))


def cfg_get(config: Any, path: str, default: Any = None) -> Any:
    """The value at a dotted path, or ``default`` where a step is missing."""
    for step in path.split("."):
        if not isinstance(config, dict) or step not in config:
            return default
        config = config[step]
    return config


def update_runtime_config(path: str, selection: dict) -> dict:
    """Writes the chosen K, overall and by topic, back into a configuration."""
    config = load_config(path)
    config.setdefault("retrieval", {}).update(k_infer_default=selection["k_infer_default"], k_infer_overrides=selection["k_infer_overrides"])
    save_config(config, path)
    return config


def materialise_splits(docs: DataFrame, path: str, train: float = 0.8, dev: float = 0.1, seed: int = 42, id_col: str = "post_id") -> DataFrame:
    """Writes (id, split) of a ratio split as Parquet and returns what was written."""
    out = splits.ratio_split(docs, train, dev, seed, id_col)
    out.write.mode("overwrite").parquet(path)
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def fold_filter_job(spark: SparkSession, config: dict, ids_path: str, candidates_path: str, schema: str, out_path: str, k: int) -> DataFrame | None:
    """Restricts a file of candidates (doc_id, cid, sent_idx, score, ordinal) to
    the documents of a fold and the k best of each pair, and writes it.

    Any scope but same_post and a missing candidate file are errors; an empty
    id list is a warning, and nothing is written.
    """
    scope = cfg_get(config, "retrieval.scope", "same_post")
    if scope != "same_post":
        raise ValueError(f"fold retrieval stays within a document; the scope is {scope}")
    ids = read_post_ids(spark, ids_path)
    if ids.isEmpty():
        LOG.warning("no ids in %s; nothing to do", ids_path)
        return None
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(candidates_path)
    if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
        raise FileNotFoundError(candidates_path)
    rows = fusion.fold_filter(read_jsonl(spark, candidates_path, schema), ids.withColumnRenamed("post_id", "doc_id"), k)
    write_jsonl(rows, out_path)
    return rows
