"""Tool policy: a nested JSON document as small tables."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewall import fixed

_SERVER = "struct<name:string,endpoint:string,enabled:boolean,allowed_tools:array<string>,blocked_tools:array<string>>"
POLICY_SCHEMA = (
    f"mcp_servers map<string,{_SERVER}>, "
    "network_policies struct<allowed_domains:array<string>,block_unknown_domains:boolean>, "
    "execution_policies struct<block_destructive_operations:boolean,destructive_operation_keywords:array<string>>"
)


class Policy(NamedTuple):
    tools: DataFrame  # server, position, enabled, tool, allowed, blocked
    domains: tuple[str, ...]
    keywords: tuple[str, ...]
    check_domains: bool
    check_keywords: bool


def load_policy(spark: SparkSession, path: str | None = None, text: str | None = None) -> Policy:
    """Policy from a JSON file or text; built-in defaults where there is none.

    A policy is configuration: one document, read once.  Only its keyword and domain lists come to the driver, as
    they become constants of the guard's expressions.
    """
    if path is None and text is None:
        empty = spark.createDataFrame([], "server string, position int, enabled boolean, tool string, allowed boolean, blocked boolean")
        return Policy(empty, fixed.DEFAULT_ALLOWED_DOMAINS, fixed.DEFAULT_DESTRUCTIVE_KEYWORDS, True, True)
    if text is not None:
        doc = spark.range(1).select(F.from_json(F.lit(text), T._parse_datatype_string(POLICY_SCHEMA)).alias("d")).select("d.*")
    else:
        doc = spark.read.schema(POLICY_SCHEMA).json(path, multiLine=True)
    servers = doc.select(F.posexplode(F.map_entries("mcp_servers")).alias("position", "e")).select(
        F.col("e.key").alias("server"), "position", F.coalesce("e.value.enabled", F.lit(False)).alias("enabled"),
        F.coalesce("e.value.allowed_tools", F.array().cast("array<string>")).alias("a"),
        F.coalesce("e.value.blocked_tools", F.array().cast("array<string>")).alias("b"),
    )
    tools = servers.select(
        "server", "position", "enabled", F.explode(F.array_union("a", "b")).alias("tool"), "a", "b"
    ).select(
        "server", "position", "enabled", "tool",
        F.array_contains("a", F.col("tool")).alias("allowed"), F.array_contains("b", F.col("tool")).alias("blocked"),
    )
    rules = doc.select(
        F.coalesce("network_policies.allowed_domains", F.array().cast("array<string>")).alias("domains"),
        F.coalesce("execution_policies.destructive_operation_keywords", F.array().cast("array<string>")).alias("keywords"),
        F.coalesce("network_policies.block_unknown_domains", F.lit(True)).alias("d"),
        F.coalesce("execution_policies.block_destructive_operations", F.lit(True)).alias("k"),
    ).first()
    return Policy(tools, tuple(rules["domains"]), tuple(rules["keywords"]), rules["d"], rules["k"])
