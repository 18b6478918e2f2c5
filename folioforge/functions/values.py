"""Values as reports and folders show them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of a unit, and the price of a page.
KILO, RUPEES_A_PAGE = 1024, 0.5


def format_bytes(n: Column) -> Column:
    """A size in B, whole KB or MB with one place."""
    mega = F.floor(n / (KILO * KILO) * 10 + 0.5) / 10
    return F.when(n < KILO, F.concat(n.cast("string"), F.lit(" B"))).when(n < KILO * KILO, F.concat(F.floor(n / KILO + 0.5).cast("string"), F.lit(" KB"))).otherwise(F.concat(mega.cast("string"), F.lit(" MB")))


def estimate_rupees(pages: Column) -> Column:
    return pages * F.lit(RUPEES_A_PAGE)


def page_file_name(page: Column, pages: Column, least: int = 4) -> Column:
    """``page-0007.png``: as many places as the last page needs, four at least."""
    width = F.greatest(F.lit(least), F.length(pages.cast("string")), F.length(page.cast("string")))
    return F.concat(F.lit("page-"), F.lpad(page.cast("string"), width, F.lit("0")), F.lit(".png"))


def colourway(fnv_hex: Column, n: int) -> Column:
    """The bucket below n (at most 2**15) of a 64-bit hash in 16 hexadecimal digits."""
    high, low = F.conv(F.left(fnv_hex, F.lit(8)), 16, 10).cast("long"), F.conv(F.right(fnv_hex, F.lit(8)), 16, 10).cast("long")
    return (high % n * (2**32 % n) + low) % n


def common_root(files: DataFrame, keys: list[str], file: str) -> DataFrame:
    """(keys, root, n): the longest folder that all files of a group lie in: what its least and its greatest path share."""
    g = files.groupBy(*keys).agg(F.min(file).alias("a"), F.max(file).alias("b"), F.count("*").alias("n"))
    a, b = F.split("a", "/"), F.split("b", "/")
    depth = F.least(F.size(a), F.size(b)) - 1
    same = F.when(depth > 0, F.transform(F.sequence(F.lit(1), F.greatest(depth, F.lit(1))), lambda i: F.when(F.element_at(a, i) == F.element_at(b, i), 1).otherwise(0))).otherwise(F.array().cast("array<int>"))
    first = F.array_position(same, F.lit(0)).cast("int")  # 0: they part nowhere
    shared = F.when(first == 0, depth).otherwise(first - 1)
    return g.select(*keys, F.array_join(F.slice(a, F.lit(1), shared), "/").alias("root"), "n")
