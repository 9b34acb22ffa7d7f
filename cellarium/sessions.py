"""Sessions: the engine's services as plain objects, one user's state each."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellarium.operators.analytics import page, rename_counts
from cellarium.operators.cube import Cube


class MaterializeSession:
    """Choose which cuboids to build, by a strategy or by hand, page through them, build them."""

    def __init__(self, cube: Cube):
        self.cube, self.chosen = cube, []

    def select_strategy(self, strategy: Callable[..., list], **options) -> int:
        self.chosen = [s for s in strategy(**options) if len(s) < self.cube.n_bits]
        return len(self.chosen)

    def add(self, bits: Sequence[int]) -> None:
        s = tuple(sorted(bits))
        if s not in self.chosen:
            self.chosen.append(s)

    def delete(self, bits: Sequence[int]) -> None:
        self.chosen.remove(tuple(sorted(bits)))

    def available(self, number: int, rows: int, text: str = "") -> list[tuple[str, int]]:
        """A page of the binary dimensions that cuboids can be made of, those whose column's name contains a text."""
        found = [x for x in self.cube.bits if text in x[0]]
        return found[number * rows : (number + 1) * rows]

    def page(self, number: int, rows: int) -> list[tuple[int, ...]]:
        return sorted(self.chosen)[number * rows : (number + 1) * rows]

    def materialize(self, path: str) -> Cube:
        return self.cube.materialize([*self.chosen, tuple(range(self.cube.n_bits))], path)


class ExploreSession:
    """Schema drift: is one column another's new name, and since when."""

    def __init__(self, rows: DataFrame, time: str = "Time"):
        self.rows, self.time = rows, time

    def is_rename(self, a: str, b: str) -> dict:
        return rename_counts(self.rows, F.col(a).isNotNull(), F.col(b).isNotNull(), F.lit(1)).first().asDict()

    def rename_time(self, a: str, b: str) -> int | None:
        """The first row that has b and not a, if a is never seen from there on."""
        r = self.rows.agg(F.max(F.when(F.col(a).isNotNull(), F.col(self.time))).alias("last"), F.min(F.when(F.col(b).isNotNull(), F.col(self.time))).alias("first")).first()
        return r["first"] if None not in (r["last"], r["first"]) and r["last"] < r["first"] else None

    def rename_search(self, a: str, b: str, parts: int = 8) -> Iterator[tuple[int, int]]:
        """Narrows down when b took over from a: (first, last) of the times that are still possible, shorter each time the
        caller goes on. One aggregate over the open times answers a step."""
        low, high = self.rows.agg(F.min(self.time), F.max(self.time)).first()
        while low is not None and high > low:
            yield low, high
            width = -(-(high - low + 1) // parts)
            part = F.floor((F.col(self.time) - low) / width).alias("p")
            open_ = self.rows.where(F.col(self.time).between(low, high))
            found = sorted((r["p"], r["a"], r["b"]) for r in open_.groupBy(part).agg(F.bool_or(F.col(a).isNotNull()).alias("a"), F.bool_or(F.col(b).isNotNull()).alias("b")).collect())  # parts rows
            last = max((p for p, has, _ in found if has), default=None)
            first = min((p for p, _, has in found if has), default=None)
            if last is None or first is None or last > first:
                return  # one of them never comes, or both stand side by side
            new = (low + last * width, min(high, low + (first + 1) * width - 1))
            if new == (low, high):
                if width == 1:
                    return
                parts *= 2
            low, high = new
        if low is not None:
            yield low, high

    def merged(self, a: str, b: str, name: str) -> DataFrame:
        """One column from two names."""
        return self.rows.withColumn(name, F.coalesce(a, b)).drop(*[c for c in (a, b) if c != name])


class QuerySession:
    """Axes, filters, then an exact, a batch or a progressive answer."""

    def __init__(self, cube: Cube):
        self.cube, self.filters, self._steps = cube, {}, None

    def slice_values(self, values: DataFrame, column: str, text: str, number: int, rows: int) -> DataFrame:
        """A page of a dictionary's values that contain a text."""
        return page(values.where(F.col(column).cast("string").contains(text)), [column], number, rows)

    def set_filter(self, column: str, codes: Sequence[int]) -> None:
        self.filters[column] = list(codes)

    def delete_filter(self, column: str) -> None:
        self.filters.pop(column, None)

    def _where(self):
        out = None
        for c, codes in self.filters.items():
            f = F.col(c).isin(*codes)
            out = f if out is None else out & f
        return out

    def cuboids(self, number: int, rows: int) -> list[tuple[int, tuple[int, ...]]]:
        """A page of the cube's materialized cuboids: number and bits; the base is the last."""
        return list(enumerate(self.cube.sets))[number * rows : (number + 1) * rows]

    def select_cube(self, cube: Cube) -> None:
        """Another cube; filters and a running query go."""
        self.cube, self.filters, self._steps = cube, {}, None

    def run(self, axes: dict[str, int], aggregation: str = "sum") -> DataFrame:
        """Exact: sums, counts or averages by prefixes of the axes; filters are pushed below the aggregate."""
        base = self.cube.base if (w := self._where()) is None else self.cube.base.where(w)
        keys = [F.shiftright(F.col(c), self.cube.columns[c] - k).alias(c) for c, k in axes.items()]
        total, count = F.sum("measure"), F.sum("cnt") if "cnt" in base.columns else F.count("*")
        made = {"sum": total, "count": count, "avg": total / count}
        if aggregation not in made:
            raise ValueError(f"aggregation is one of {sorted(made)}")
        return base.groupBy(*keys).agg(made[aggregation].alias("measure"))

    def start(self, axes: dict[str, int], primary: tuple | None = None) -> tuple[int, np.ndarray]:
        """The first answer of a progressive query under the filters, and its degrees of freedom."""
        query = sorted(b for c, k in axes.items() for b in self.cube.prefix_bits(c, k))
        self._steps: Iterator = self.cube.online(query, primary=primary, codes=self.filters)
        return next(self._steps)

    def next(self) -> tuple[int, np.ndarray] | None:
        return next(self._steps, None)
