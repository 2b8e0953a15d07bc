"""Which pages of a document to read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def sample_pages(total: int, n: int, strategy: str = "thirds", seed: int = 0) -> list[int]:
    """Up to n of the pages 1..total: from the head, spread evenly, at random, or a third each from head, middle and tail."""
    if total <= 0 or n <= 0:
        return []
    if n >= total:
        return list(range(1, total + 1))
    if strategy == "head":
        return list(range(1, n + 1))
    if strategy == "uniform":
        return sorted({1 + round(i * (total - 1) / max(1, n - 1)) for i in range(n)})
    if strategy == "random":
        import random

        return sorted(random.Random(seed).sample(range(1, total + 1), n))
    third, ends = total // 3, max(1, n // 3)
    bounds = [(1, third, ends), (third + 1, 2 * third, n - 2 * ends), (2 * third + 1, total, ends)]
    out: list[int] = []
    for first, last, k in bounds:
        size = last - first + 1
        k = min(k, size)
        if k > 0:  # of n = 2 pages none is left for the middle
            out += range(first, last + 1, max(1, size // k))[:k]
    return out[:n]


def _along(first: Column, step: Column) -> Callable[[Column], Column]:
    return lambda i: (first + i * step).cast("int")


def sampled(total: str | Column, n: int, strategy: str = "thirds") -> Column:
    """``sample_pages`` as a column: the pages of each document, from its number of pages; "random" is left to ``sample_pages``."""
    t = F.coalesce(F.col(total) if isinstance(total, str) else total, F.lit(0))
    none = F.array().cast("array<int>")
    if n <= 0:
        return none
    head = F.sequence(F.lit(1), F.lit(n))
    if strategy == "uniform":
        some = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.bround(i * (t - 1) / max(1, n - 1)) + 1).cast("int"))))
    elif strategy == "thirds":
        third, ends = F.floor(t / 3).cast("int"), max(1, n // 3)
        out = []
        for first, last, k in ((F.lit(1), third, ends), (third + 1, 2 * third, n - 2 * ends), (2 * third + 1, t, ends)):
            size = last - first + 1
            if k > 0:
                m = F.least(F.lit(k), size)
                step = F.greatest(F.lit(1), F.floor(size / F.greatest(m, F.lit(1))).cast("int"))
                out.append(F.when(m > 0, F.transform(F.sequence(F.lit(0), F.greatest(m, F.lit(1)) - 1), _along(first, step))).otherwise(none))
        some = F.slice(F.concat(*out), 1, n)
    else:
        some = head
    return F.when(t <= 0, none).when(t <= n, F.sequence(F.lit(1), F.greatest(t, F.lit(1)).cast("int"))).otherwise(some)


def clamp(pages: str | Column, total: str | Column) -> Column:
    """Distinct pages in order, within 1..total."""
    t = F.col(total) if isinstance(total, str) else total
    return F.array_sort(F.array_distinct(F.filter(pages, lambda p: (p >= 1) & (p <= t))))


def parse_range(text: str) -> list[int]:
    """``3-7`` or ``1,4,9``; raises ValueError for anything else."""
    if m := re.fullmatch(r"\s*(\d+)\s*-\s*(\d+)\s*", text):
        a, b = map(int, m.groups())
        if 1 <= a <= b:
            return list(range(a, b + 1))
    elif re.fullmatch(r"\s*\d+(\s*,\s*\d+)*\s*", text):
        pages = [int(x) for x in text.split(",")]
        if min(pages) >= 1:
            return sorted(set(pages))
    raise ValueError(f"not a page range: {text!r}")
