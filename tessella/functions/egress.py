"""What may leave: names, paths and addresses without credentials, and remotes that were opted in."""

from __future__ import annotations

import re
import tomllib
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.operators import detectors

_ANY = "|".join(f"(?:{p})" for p in detectors.HIGH.values()) + "|" + "|".join(f"(?:{p})" for p in detectors.SUSPECT.values())


def safe_path(path: Column) -> Column:
    """A path in which every credential is masked: its first four characters and its length stay. Where detectors overlap, the leftmost is masked."""
    found = F.array_distinct(F.regexp_extract_all(path, F.lit(_ANY), F.lit(0)))
    masked = F.aggregate(F.array_sort(found, lambda a, b: F.length(b) - F.length(a)), path, lambda t, v: F.replace(t, v, detectors.mask(v)))
    return F.when(path.rlike(_ANY), masked).otherwise(path)


def safe_url(url: Column) -> Column:
    """An address without the name and password before its host; what has no `//` host stays."""
    return F.regexp_replace(url, r"^([A-Za-z][A-Za-z0-9+.-]*:)?//[^/?#]*@", "$1//")


def leaks(findings: DataFrame) -> DataFrame:
    """The findings that keep a derived artefact from being written: issuers' formats only."""
    return findings.where("tier = 'high'")


def push_allowed(config: str | None, remote: str) -> tuple[bool, str]:
    """(allowed, reason or the address) from a configuration's text. Nothing is allowed that isn't opted in, and no address with a credential in it."""
    if config is None:
        return False, "no configuration; push is opt-in"
    try:
        entry = tomllib.loads(config).get("remote")
    except tomllib.TOMLDecodeError as e:
        return False, f"unreadable configuration ({e})"
    entry = entry.get(remote) if isinstance(entry, dict) else None
    if not isinstance(entry, dict):
        return False, f"no remote {remote}"
    if entry.get("allow_push") is not True:
        return False, f"{remote} doesn't set allow_push"
    url = str(entry.get("url") or "")
    if not url:
        return False, f"{remote} has no url"
    parts = urlsplit(url)
    user = parts.netloc.rpartition("@")[0]
    # A name alone is a login over ssh, and the token itself over http.
    if ":" in user or (user and re.fullmatch("https?", parts.scheme)):
        return False, f"{remote}: the url holds a credential"
    return True, url
