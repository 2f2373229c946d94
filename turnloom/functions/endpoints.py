"""Endpoints of engines with their keys, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that count as blank at an address's ends.
_BLANK = "[\\s\\x{1c}-\\x{1f}\\x{85}\\p{Z}]+"


def root(url: Column) -> Column:
    """An address without blanks around it, closing slashes and then the version path."""
    bare = F.regexp_replace(F.regexp_replace(url, f"^{_BLANK}|{_BLANK}$", ""), "/+$", "")
    return F.regexp_replace(bare, "/v1$", "")


def wired(urls: Column, keys: Column) -> Column:
    """Struct of endpoints (root, key) and error of lists of addresses and of keys.

    No keys (null) leave endpoints without one, and a single key is for all of them. Errors: none (no
    address), blank (an address without a root), keys (another number of keys than of addresses).
    """
    roots = F.transform(urls, root)
    blank = F.exists(roots, lambda r: F.coalesce(r, F.lit("")) == "")
    fits = keys.isNull() | (F.size(keys) == 1) | (F.size(keys) == F.size(urls))
    error = F.when(urls.isNull() | (F.size(urls) == 0), "none").when(blank, "blank").when(~fits, "keys")
    pairs = F.transform(roots, lambda r, i: F.struct(r.alias("root"), F.when(F.size(keys) == 1, F.get(keys, F.lit(0))).otherwise(F.get(keys, i)).alias("key")))
    return F.struct(F.when(error.isNull(), pairs).alias("endpoints"), error.alias("error"))
