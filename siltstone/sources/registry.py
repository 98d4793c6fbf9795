"""The registry of sources in the form that rules are checked against."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def normal_hosts(hosts: Column) -> Column:
    """Hosts in lower case."""
    return F.transform(hosts, F.lower)


def normal_paths(paths: Column) -> Column:
    """Paths without slashes at their end; the root stays."""
    return F.transform(paths, lambda p: F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", "")))


def registry(sources: DataFrame) -> DataFrame:
    """sources with hosts and paths in normal form and `invalid`: why a source can't be used (no host, or a path that does not begin at the root), null for a good one."""
    hosts, paths = F.coalesce("allowed_hosts", F.array().cast("array<string>")), F.coalesce("allowed_path_prefixes", F.array().cast("array<string>"))
    invalid = F.when(F.size(hosts) == 0, "no_hosts").when(F.exists(paths, lambda p: ~F.coalesce(p.startswith("/"), F.lit(False))), "relative_path")
    return sources.withColumn("invalid", invalid).withColumn("allowed_hosts", normal_hosts(hosts)).withColumn("allowed_path_prefixes", normal_paths(paths))
