"""Policy checks over a log of tool calls: permission, destructive words, domains."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewall.functions.plan import pinned
from tidewall.sources.policy import Policy

# Explanation texts
ALLOWED_TEXT = "Tool call matches active heuristic policy constraints."

UNREADABLE_TEXT = "Tool arguments are not readable as JSON."


def _said(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def tool_permission(calls: DataFrame, policy: Policy, tool: str = "tool") -> DataFrame:
    """Add `permission_reason`: NULL unless a server blocks the tool or lists it without allowing it."""
    rules = policy.tools.groupBy(F.col("tool").alias("_tool")).agg(
        F.min_by("server", F.when(F.col("blocked"), F.col("position"))).alias("_blocked_on"),
        F.bool_or("allowed").alias("_allowed"),
    )
    # the policy side is small and measured by the planner, which broadcasts it; the log side is not moved
    joined = calls.join(rules, calls[tool] == rules["_tool"], "left")
    reason = F.when(
        F.col("_blocked_on").isNotNull(),
        _said("Tool '", F.col(tool), "' is explicitly blacklisted on server '", F.col("_blocked_on"), "'."),
    ).when(~F.col("_allowed"), _said("Tool '", F.col(tool), "' is not authorized under the active MCP policies."))
    return joined.withColumn("permission_reason", reason).drop("_tool", "_blocked_on", "_allowed")


def decoded(calls: DataFrame, args_json: str = "args_json") -> DataFrame:
    """Adds `_args` (the arguments as a variant, null if unreadable) and `_said` (their lower-cased text once escapes are
    decoded), each computed once however many checks read them."""
    out = calls.withColumn("_args", pinned(F.try_parse_json(F.col(args_json))))
    return out.withColumn("_said", pinned(F.lower(F.coalesce(F.to_json("_args"), F.col(args_json)))))


def destructive_keyword(policy: Policy) -> Column:
    """First listed keyword that occurs anywhere in the decoded arguments (`_said`)."""
    if not policy.check_keywords or not policy.keywords:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(F.contains("_said", F.lit(k)), F.lit(k)) for k in policy.keywords])


def host_of(value: Column) -> Column:
    """Network location of a URL or bare host, without port."""
    url = F.when(F.contains(value, F.lit("://")), value).otherwise(F.concat(F.lit("http://"), value))
    scheme = r"[A-Za-z][A-Za-z0-9+.\-]*://"
    place = F.regexp_extract(url, rf"^{scheme}([^/?#]*)", 1)
    path = F.regexp_extract(url, rf"^(?:{scheme}[^/?#]*)?([^?#]*)", 1)
    return F.substring_index(F.when(F.length(place) > 0, place).otherwise(path), ":", 1)


def string_arguments(args_json: Column) -> Column:
    """Top-level string values of a JSON object, in order.  A variant sorts its keys, so the order is read off the text."""
    entries = F.map_entries(F.from_json(args_json, "map<string,variant>"))
    texts = F.filter(entries, lambda e: F.schema_of_variant(e["value"]) == "STRING")
    return F.transform(texts, lambda e: e["value"].cast("string"))


def foreign_domain(args_json: Column, policy: Policy) -> Column:
    """First argument host that is no listed domain and no sub-domain of one; off without a list."""
    if not policy.check_domains or not policy.domains:
        return F.lit(None).cast("string")
    dotted = F.filter(
        string_arguments(args_json),
        lambda v: v.startswith("http://") | v.startswith("https://") | F.contains(v, F.lit(".")),
    )

    longest = max(d.count(".") for d in policy.domains) + 1

    def listed(host: Column) -> Column:
        # The host is a listed domain or lies below one if one of its ends, cut at dots, is in the list: a few lookups in
        # a set, however long the list is.
        ends = F.transform(F.sequence(F.lit(-1), F.lit(-longest), F.lit(-1)), lambda k: F.call_function("substring_index", host, F.lit("."), k))
        return F.exists(ends, lambda end: among(end, policy.domains))

    hosts = F.transform(dotted, host_of)
    return F.try_element_at(F.filter(hosts, lambda h: (F.length(h) > 0) & ~listed(h)), F.lit(1))


def among(value: Column, texts: Sequence[str]) -> Column:
    """Whether the value is one of the texts: one set lookup.  A long list goes to the JVM in one call, not text by text."""
    jvm = SparkContext._active_spark_context._jvm
    listed = jvm.java.util.regex.Pattern.compile("\n").splitAsStream("\n".join(dict.fromkeys(texts))).toList()
    return type(value)(value._jc.isInCollection(listed))


def unreadable(args_json: Column) -> Column:
    """Arguments that are there but do not parse (`_args` is null): no check can look into them."""
    return args_json.isNotNull() & F.col("_args").isNull()


def guard(calls: DataFrame, policy: Policy, tool: str = "tool", args_json: str = "args_json") -> DataFrame:
    """Add `is_allowed` and `explanation`: the first failing check decides.  Arguments that do not parse are denied."""
    out = tool_permission(calls, policy, tool)
    out = decoded(out, args_json)
    out = out.withColumn("_word", destructive_keyword(policy))
    out = out.withColumn("_host", foreign_domain(F.col(args_json), policy))
    reason = F.coalesce(
        F.col("permission_reason"),
        F.when(unreadable(F.col(args_json)), F.lit(UNREADABLE_TEXT)),
        _said("Destructive command keyword '", F.col("_word"), "' detected in execution arguments."),
        _said("Network domain '", F.col("_host"), "' is not on the firewall allowed domains list."),
    )
    return out.withColumn("_reason", reason).select(
        *calls.columns,
        F.col("_reason").isNull().alias("is_allowed"),
        F.coalesce("_reason", F.lit(ALLOWED_TEXT)).alias("explanation"),
    )


def server_tool_allowed(pairs: DataFrame, policy: Policy, server: str = "server", tool: str = "tool") -> DataFrame:
    """Strict check per (server, tool): known, enabled, listed and not blocked."""
    open_tools = policy.tools.filter(F.col("enabled") & F.col("allowed") & ~F.col("blocked")).select(
        F.col("server").alias("_server"), F.col("tool").alias("_tool"), F.lit(True).alias("_ok")
    )
    return (
        pairs.join(open_tools, (pairs[server] == open_tools["_server"]) & (pairs[tool] == open_tools["_tool"]), "left")
        .withColumn("is_allowed", F.coalesce("_ok", F.lit(False)))
        .drop("_server", "_tool", "_ok")
    )


def server_tools(policy: Policy, server: str | None = None) -> DataFrame:
    """Allowed tools per server."""
    rows = policy.tools.filter("allowed")
    return (rows if server is None else rows.filter(F.col("server") == server)).select("server", "tool")
