"""Stateless random draws.

A draw is a function of its keys, so it does not depend on partitioning, task retries or the order of
rows, and any SQL engine with md5 gives the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_SCALE = 2.0 ** 52


def _as_text(part) -> Column:
    if isinstance(part, Column):
        return part.cast("string")
    return F.lit(str(part))


def uniform(*parts) -> Column:
    """Uniform in [0, 1) from the md5 of the parts joined by ``|``.

    Columns are used as they are, Python values as literals. Use integer or string columns only: engines
    print floats differently.
    """
    digest = F.md5(F.concat_ws("|", *[_as_text(p) for p in parts]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(_SCALE)
