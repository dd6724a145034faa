"""Seeded draws that depend on a row's key alone, never on partitioning or order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEED = 42


def digits(step: str | Column, *key: Column | str, seed: int = SEED) -> Column:
    """A draw as eight hexadecimal digits: the first 32 bits of an MD5 of seed, key and step."""
    parts = [F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key], F.lit(step) if isinstance(step, str) else step]
    return F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8)


def head(*key: Column | str, seed: int = SEED) -> Column:
    """What stands before the step in a draw's text."""
    return F.concat(F.concat_ws("|", F.lit(str(seed)), *[(F.col(k) if isinstance(k, str) else k).cast("string") for k in key]), F.lit("|"))


def continued(head: Column, *more: Column | str) -> Column:
    """A head with more of a key."""
    parts = [F.concat((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("|")) for k in more]
    return F.concat(head, *[F.coalesce(p, F.lit("")) for p in parts])


def digits_after(head: Column, step: str | Column) -> Column:
    """The digits of the draw with this head."""
    return F.substring(F.md5(F.concat(head, F.lit(step) if isinstance(step, str) else step)), 1, 8)


def number(digits: Column) -> Column:
    return F.conv(digits, 16, 10).cast("bigint")


def draw(step: str | Column, *key: Column | str, seed: int = SEED) -> Column:
    """A uniform integer in [0, 2^32)."""
    return number(digits(step, *key, seed=seed))


def under(d: Column, least: int) -> Column:
    """Whether a draw's digits stand for less than a whole number; digits order as the numbers do, so none is converted."""
    return F.lit(least > 0) if not 0 < least < 1 << 32 else d < F.lit(f"{least:08x}")


def draw_sql(step: str, *key: str, seed: int = SEED) -> str:
    parts = [f"'{seed}'", *[f"CAST({k} AS VARCHAR)" for k in key], f"'{step}'"]
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) AS BIGINT)"


def chance(h: Column, p: float) -> Column:
    """Whether a draw falls under probability p."""
    return h < int(p * (1 << 32))


def chance_sql(h: str, p: float) -> str:
    return f"({h} < {int(p * (1 << 32))})"
