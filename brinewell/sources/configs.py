"""Small configuration files as tables (S19) and report documents."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CONSTRAINTS = "group_id string, pos int, lhs string, op string, rhs string, lhs_market string, rhs_market string"
OPS = ("<=", ">=")


def _load(path: str):
    text = Path(path).read_text()
    try:
        import yaml
    except ImportError:
        import json

        return json.loads(text)
    return yaml.safe_load(text)


def constraint_rows(config: dict) -> list[tuple]:
    """One row per constraint. Unknown keys of markets, equal sides, unknown operators and repeated keys or ids are errors."""
    rows, ids = [], set()
    for g in config.get("groups") or []:
        keys = {m["key"]: m["manifold_market_id"] for m in g["markets"]}
        if g["id"] in ids or len(keys) != len(g["markets"]):
            raise ValueError(f"repeated id or key in group {g['id']}")
        ids.add(g["id"])
        for k, c in enumerate(g["constraints"]):
            op = c.get("op", "<=")
            if op not in OPS or c["lhs"] == c["rhs"] or not {c["lhs"], c["rhs"]} <= set(keys):
                raise ValueError(f"constraint {k} of group {g['id']}")
            rows.append((g["id"], k, c["lhs"], op, c["rhs"], keys[c["lhs"]], keys[c["rhs"]]))
    return rows


def read_constraints(spark: SparkSession, path: str) -> DataFrame:
    return spark.createDataFrame(constraint_rows(_load(path)), CONSTRAINTS)


def read_mappings(spark: SparkSession, path: str) -> DataFrame:
    """Confirmed pairs of a mapping file."""
    rows = [(m["manifold_market_id"], m["polymarket_market_id"], m.get("note")) for m in _load(path).get("mappings") or _load(path).get("matches") or []]
    return spark.createDataFrame(rows, "manifold_market_id string, external_market_id string, note string")


def read_reports(spark: SparkSession, directory: str, pattern: str) -> DataFrame:
    """Name and text of the Markdown files whose name matches the regular expression."""
    files = spark.read.text(f"{directory}/*.md", wholetext=True).withColumn("name", F.element_at(F.split(F.input_file_name(), "/"), -1))
    return files.where(F.col("name").rlike(pattern)).select("name", F.col("value").alias("text"))


def throughput(text) -> list:
    """The three rates of a report's throughput row, without thousands separators; null where there is none."""
    rate = r"\s*([\d,]+)\s*ev/s\s*\|"
    line = r"(?i)throughput\s*\|" + rate * 2 + rate[:-2]
    return [F.regexp_replace(F.regexp_extract(text, line, k), ",", "").try_cast("double") for k in (1, 2, 3)]
