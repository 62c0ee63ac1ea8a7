"""Repeatable random draws.

``randn(seed)`` depends on how rows are partitioned. These draws depend only on the key
of the row, so a retried task, another executor count or another engine gives the same value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_POW_32 = 4294967296.0


def _digest(parts: tuple[Column, ...]) -> Column:
    return F.md5(F.concat_ws("|", *[part.cast("string") for part in parts]))


def _uniform_from(digest: Column, start: int) -> Column:
    whole = F.conv(F.substring(digest, start, 8), 16, 10).cast("bigint")
    return (whole.cast("double") + 0.5) / _TWO_POW_32


def keyed_uniform(*parts: Column) -> Column:
    """Uniform draw in (0, 1) decided by ``parts``."""
    return _uniform_from(_digest(parts), 1)


def keyed_fraction(*parts: Column) -> Column:
    """Like ``keyed_uniform`` with 52 bits, for choices among very many."""
    whole = F.conv(F.substring(_digest(parts), 1, 13), 16, 10).cast("bigint")
    return (whole.cast("double") + 0.5) / float(1 << 52)


def keyed_normal(*parts: Column) -> Column:
    """Standard normal draw decided by ``parts`` (Box-Muller on two 32-bit uniforms)."""
    digest = _digest(parts)
    radius = F.sqrt(F.lit(-2.0) * F.log(_uniform_from(digest, 1)))
    return radius * F.cos(F.lit(2.0 * math.pi) * _uniform_from(digest, 9))
