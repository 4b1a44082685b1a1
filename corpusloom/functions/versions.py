"""Version requirements of a plugin registry, and safety of base URLs."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def parse(version: str) -> tuple[int, int, int] | None:
    m = re.fullmatch(r"v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:[-+].*)?", version.strip())
    return tuple(int(x or 0) for x in m.groups()) if m else None


def satisfies(version: str, requirement: str) -> bool:
    """A bare version is exact; ^ keeps the leftmost non-zero part, ~ the minor one; comparisons join with commas."""
    have = parse(version)
    if have is None:
        return False
    for part in requirement.split(","):
        part = part.strip()
        if part in ("", "*"):
            continue
        m = re.match(r"(\^|~|>=|<=|>|<|=)?\s*(.+)", part)
        op, want = m[1] or "=", parse(m[2])
        if want is None:
            return False
        if op == "^":
            head = next((i for i, x in enumerate(want) if x), 2)
            ok = have >= want and have[: head + 1] == want[: head + 1]
        elif op == "~":
            ok = have >= want and have[:2] == want[:2]
        else:
            ok = {"=": have == want, ">=": have >= want, "<=": have <= want, ">": have > want, "<": have < want}[op]
        if not ok:
            return False
    return True


def satisfies_column(version: Column, requirement: Column) -> Column:
    return F.udf(lambda v, r: bool(v is not None and r is not None and satisfies(v, r)), "boolean", useArrow=True)(version, requirement)


def best_match(registry: DataFrame, requirement: str) -> DataFrame:
    """The highest version of each plugin (plugin_id, version) that meets a requirement."""
    parts = F.transform(F.split(F.regexp_replace("version", r"^v|[-+].*$", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(0)))
    ok = registry.where(satisfies_column(F.col("version"), F.lit(requirement)))
    return ok.groupBy("plugin_id").agg(F.max_by("version", parts).alias("version"))


def safe_base_url(url: str) -> bool:
    """https only; no loopback, private, link-local or .local host."""
    try:
        parts = urlsplit(url)
        host = (parts.hostname or "").rstrip(".")
    except ValueError:
        return False
    if parts.scheme != "https" or not host or host == "localhost" or host.endswith((".local", ".localhost", ".internal")):
        return False
    try:
        return ipaddress.ip_address(host).is_global
    except ValueError:
        return True


def safe_base_url_column(url: Column) -> Column:
    return F.udf(lambda u: u is not None and safe_base_url(u), "boolean", useArrow=True)(url)
