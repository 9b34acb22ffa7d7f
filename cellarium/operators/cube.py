"""The cube: a base cuboid of typed code columns, a catalog of materialized cuboids, exact and approximate queries.

Binary dimensions are numbered over the columns in order, each from its least significant bit. Materialized cuboids
stand in one Parquet table partitioned by ``cuboid_id``: (key, measure), the key packed over the cuboid's sorted bits.
Each materialization writes to a folder of its own and then adds a row to the catalog, whose last row counts: a build that
breaks off or is run again leaves the answers as they were.
Exact queries never leave Spark; approximate ones bring at most the cells of the marginals they need to the driver, in
one job.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellarium.functions.bits import gather
from cellarium.operators.cuboid import cells, densify
from cellarium.plans.index import CuboidIndex, Found, parents
from cellarium.solvers.extrapolate import CoMoment
from cellarium.solvers.linear import Bounds
from cellarium.storage import delete

#: Cuboids that one job builds from a parent.
BATCH = 64
#: Most bits of a packed key.
KEY_BITS = 62
#: Most column bits of a pivot.
PIVOT_BITS = 12
#: Expected cells of a cuboid that one task writes.
PART_CELLS = 2_000_000


@dataclass
class Cube:
    """columns: name -> width in bits. base: the code columns and ``measure``."""

    columns: dict[str, int]
    base: DataFrame
    sets: list[tuple[int, ...]] = field(default_factory=list)
    path: str | None = None
    base_path: str | None = None
    build_path: str | None = None  # of the build whose cuboids count

    def __post_init__(self):
        self.bits = [(c, b) for c, w in self.columns.items() for b in range(w)]
        self.at = {x: i for i, x in enumerate(self.bits)}
        if not self.sets:
            self.sets = [tuple(range(len(self.bits)))]
        self.index = CuboidIndex(self.sets, len(self.bits))

    # dimensions -----------------------------------------------------------------------------------------------------
    @property
    def n_bits(self) -> int:
        return len(self.bits)

    def column_bits(self, name: str) -> list[int]:
        """A column's bits, least significant first."""
        return [self.at[name, b] for b in range(self.columns[name])]

    def prefix_bits(self, name: str, k: int) -> list[int]:
        """The k most significant bits of a column."""
        own = self.column_bits(name)
        if k > len(own):
            raise ValueError(f"{name} has {len(own)} bits")
        return own[len(own) - k :]

    def bit_column(self, b: int) -> Column:
        name, i = self.bits[b]
        return F.shiftright(F.col(name), i).bitwiseAND(F.lit(1))

    # materialization ------------------------------------------------------------------------------------------------
    def materialize(self, sets: Sequence[Sequence[int]], path: str) -> Cube:
        """Builds the cuboids, each from its cheapest materialized superset, in batches of one job, and saves a catalog.

        Parents come before children; what has no materialized superset of few bits is built from the base cuboid. A base
        that is stored already is referred to, not copied."""
        sets = [tuple(sorted(s)) for s in sets]
        if sets[-1] != tuple(range(self.n_bits)):
            raise ValueError("the last set has to be the base cuboid")
        spark, parent = self.base.sparkSession, parents(sets)
        depth: dict[int, int] = {}

        def level(i: int) -> int:
            if i not in depth:
                depth[i] = 0 if parent[i] in (-1, len(sets) - 1) else 1 + level(parent[i])
            return depth[i]

        todo = [i for i in range(len(sets) - 1) if len(sets[i]) <= KEY_BITS]
        if len(todo) < len(sets) - 1:
            raise ValueError(f"a cuboid has {KEY_BITS} bits at most")
        last = len(sets) - 1
        own = f"{path}/build-{uuid.uuid4().hex}"
        base_path = self.base_path or f"{own}/base"
        if not self.base_path:
            self.base.write.parquet(base_path)
        stored = Cube(self.columns, spark.read.parquet(base_path))
        rows = stored.base.count()
        for d in sorted({level(i) for i in todo}):
            of_level = sorted((i for i in todo if depth[i] == d), key=lambda i: (parent[i] == last, parent[i], i))
            for from_base in (True, False):
                mine = [i for i in of_level if (parent[i] == last) == from_base]
                for k in range(0, len(mine), BATCH):
                    stored._build(spark, sets, parent, mine[k : k + BATCH], from_base, own, rows)
        if not todo:
            spark.createDataFrame([], "key long, measure long, cuboid_id int").write.parquet(f"{own}/cuboids")
        catalog = json.dumps({"columns": self.columns, "sets": [list(s) for s in sets], "parents": parent, "base": base_path, "cuboids": own})
        number = 1 + (Cube._versions(spark, path)[-1][0] if Cube._exists(spark, f"{path}/catalog") else 0)
        spark.createDataFrame([(number, catalog)], "number long, catalog string").coalesce(1).write.mode("append").parquet(f"{path}/catalog")
        return Cube.load(spark, path)

    @staticmethod
    def _exists(spark: SparkSession, path: str) -> bool:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)

    @staticmethod
    def _versions(spark: SparkSession, path: str) -> list[tuple[int, dict]]:
        return [(r["number"], json.loads(r["catalog"])) for r in spark.read.parquet(f"{path}/catalog").orderBy("number").collect()]

    @classmethod
    def vacuum(cls, spark: SparkSession, path: str) -> int:
        """Deletes what only earlier builds in the catalog refer to; how many folders went."""
        *old, (_, now) = cls._versions(spark, path)
        gone = {c["cuboids"] for _, c in old} - {now["cuboids"]}
        used = {now["base"], now["cuboids"]}
        for g in gone:
            for part in ([g] if not any(u.startswith(f"{g}/") for u in used) else [f"{g}/cuboids"]):
                delete(spark, part)
        return len(gone)

    def _build(self, spark: SparkSession, sets, parent, batch: list[int], from_base: bool, path: str, base_rows: int) -> None:
        """One job: every row of a parent gives a row to each of its cuboids in the batch; sums combine before the shuffle.
        A cuboid is written by as many tasks as its expected cells ask for."""
        by: dict[int, list[int]] = {}
        for i in batch:
            by.setdefault(parent[i], []).append(i)
        keys = {p: F.array(*[F.struct(F.lit(i).alias("cuboid_id"), self._key(sets, p, i).alias("key")) for i in made]) for p, made in by.items()}
        if from_base:
            source, made = self.base, keys[len(sets) - 1]
        else:
            source = spark.read.parquet(f"{path}/cuboids").where(F.col("cuboid_id").isin(list(by)))
            made = F.coalesce(*[F.when(F.col("cuboid_id") == p, a) for p, a in keys.items()])
        rows = source.select(F.explode(made).alias("c"), "measure").groupBy("c.cuboid_id", "c.key").agg(F.sum("measure").alias("measure"))
        parts = F.element_at(F.create_map(*[F.lit(x) for i in batch for x in (i, 1 + min(1 << len(sets[i]), base_rows) // PART_CELLS)]), F.col("cuboid_id"))
        rows.repartition("cuboid_id", F.pmod(F.xxhash64("key"), parts)).write.mode("append").partitionBy("cuboid_id").parquet(f"{path}/cuboids")

    def _key(self, sets, p: int, i: int) -> Column:
        """The packed key of cuboid i from the rows of p."""
        if p == len(sets) - 1:
            out = F.lit(0).cast("long")
            for k, b in enumerate(sets[i]):
                out = out + F.shiftleft(self.bit_column(b).cast("long"), k)
            return out
        return gather(F.col("key"), [sets[p].index(b) for b in sets[i]])

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Cube:
        _, catalog = cls._versions(spark, path)[-1]
        return cls(catalog["columns"], spark.read.parquet(catalog["base"]), [tuple(s) for s in catalog["sets"]], path, catalog["base"], catalog["cuboids"])

    def partial(self, sets: Sequence[Sequence[int]], path: str) -> Cube:
        """Other cuboids over the same base, which is referred to where it is stored."""
        return Cube(self.columns, self.base, base_path=self.base_path).materialize(sets, path)

    # exact queries --------------------------------------------------------------------------------------------------
    def cuboids(self) -> DataFrame:
        """All materialized cuboids: key, measure, cuboid_id."""
        return self.base.sparkSession.read.parquet(f"{self.build_path}/cuboids")

    def cuboid(self, i: int) -> DataFrame:
        return self.cuboids().where(F.col("cuboid_id") == i).select("key", "measure")

    def _is_base(self, found: Found) -> bool:
        return found.cuboid == len(self.sets) - 1

    def fetch(self, found: Found, query: Sequence[int]) -> DataFrame:
        """(idx, measure) of a projection's part in the query, sparse, packed over that part's bits."""
        query = sorted(query)
        if self._is_base(found):
            return cells(self.base, [self.bit_column(b) for i, b in enumerate(query) if found.covered >> i & 1])
        return self.cuboid(found.cuboid).groupBy(gather(F.col("key"), found.positions).alias("idx")).agg(F.sum("measure").alias("measure"))

    def naive(self, query: Sequence[int], dense: bool = False, where: Column | None = None, fixed: dict[int, int] | None = None) -> DataFrame:
        """(idx, measure), exact, from the cheapest cuboid that covers the query and the bits that ``fixed`` gives values
        to (bit -> 0 or 1); its rows are filtered before they are summed. A filter ``where`` on codes goes to the base."""
        query = sorted(query)
        if where is not None:
            held = [self.bit_column(b) == v for b, v in (fixed or {}).items()]
            rows = self.base.where(where)
            for h in held:
                rows = rows.where(h)
            out = cells(rows, [self.bit_column(b) for b in query])
        elif fixed:
            out = self._sliced(query, fixed)
        else:
            out = self.fetch(self.index.prepare_naive(query), query)
        return densify(out, len(query)) if dense else out

    def _sliced(self, query: list[int], fixed: dict[int, int]) -> DataFrame:
        found = self.index.prepare_naive(sorted({*query, *fixed}))
        if self._is_base(found):
            rows = self.base
            for b, v in fixed.items():
                rows = rows.where(self.bit_column(b) == v)
            return cells(rows, [self.bit_column(b) for b in query])
        own = self.sets[found.cuboid]
        mask = sum(1 << own.index(b) for b in fixed)
        want = sum(v << own.index(b) for b, v in fixed.items())
        rows = self.cuboid(found.cuboid).where(F.col("key").bitwiseAND(F.lit(mask)) == want)
        return rows.groupBy(gather(F.col("key"), [own.index(b) for b in query]).alias("idx")).agg(F.sum("measure").alias("measure"))

    def query(self, rows: dict[str, int], cols: dict[str, int] | None = None, where: Column | None = None) -> DataFrame:
        """Sums by prefixes: column -> number of its most significant bits. With ``cols`` a pivot of their cells."""
        def keys(spec):
            return [F.shiftright(F.col(c), self.columns[c] - k).alias(c) for c, k in spec.items()]

        base = self.base if where is None else self.base.where(where)
        if not cols:
            return base.groupBy(*keys(rows)).agg(F.sum("measure").alias("measure"))
        if sum(cols.values()) > PIVOT_BITS:
            raise ValueError(f"a pivot has {PIVOT_BITS} column bits at most; ask for rows")
        parts = [F.lpad(F.bin(F.shiftright(F.col(c), self.columns[c] - k)), k, "0") for c, k in cols.items()]
        names = [f"{v:0{sum(cols.values())}b}" for v in range(1 << sum(cols.values()))]
        return base.select(*keys(rows), F.concat(*parts).alias("_p"), "measure").groupBy(*rows).pivot("_p", names).agg(F.sum("measure"))

    # approximate queries --------------------------------------------------------------------------------------------
    def marginals(self, query: Sequence[int], found: Sequence[Found]) -> list[tuple[int, np.ndarray]]:
        """All marginals of a plan from one job: sums tagged with their projection."""
        stored = [f for f in found if not self._is_base(f)]
        out: dict[int, np.ndarray] = {f.covered: np.zeros(1 << f.covered.bit_count()) for f in found}
        parts = []
        if stored:
            idx = F.coalesce(*[F.when(F.col("cuboid_id") == f.cuboid, gather(F.col("key"), f.positions)) for f in stored])
            tag = F.coalesce(*[F.when(F.col("cuboid_id") == f.cuboid, F.lit(f.covered)) for f in stored])
            table = self.cuboids().where(F.col("cuboid_id").isin([f.cuboid for f in stored]))
            parts.append(table.groupBy(tag.cast("long").alias("part"), idx.alias("idx")).agg(F.sum("measure").alias("measure")))
        parts += [self.fetch(f, query).select(F.lit(f.covered).cast("long").alias("part"), "idx", "measure") for f in found if self._is_base(f)]
        whole = parts[0]
        for p in parts[1:]:
            whole = whole.unionByName(p)
        for r in whole.toLocalIterator():
            out[r["part"]][r["idx"]] = r["measure"] or 0
        return [(f.covered, out[f.covered]) for f in found]

    def primary_moments(self) -> tuple[int, list[int]]:
        """Total, and the sum of each binary dimension's ones, in one aggregate."""
        aggs = [F.sum("measure").alias("t")] + [F.sum(F.col("measure") * self.bit_column(b)).alias(f"b{b}") for b in range(self.n_bits)]
        r = self.base.agg(*aggs).first()
        return r["t"] or 0, [r[f"b{b}"] or 0 for b in range(self.n_bits)]

    def save_primary_moments(self, path: str) -> None:
        total, ones = self.primary_moments()
        self.base.sparkSession.createDataFrame([(total, ones)], "total long, ones array<long>").coalesce(1).write.mode("overwrite").parquet(path)

    @staticmethod
    def load_primary_moments(spark: SparkSession, path: str) -> tuple[int, list[int]]:
        r = spark.read.parquet(path).first()
        return r["total"], list(r["ones"])

    def solve(self, query: Sequence[int], solver: Callable[[int, list], np.ndarray] | None = None, primary: tuple | None = None) -> np.ndarray:
        """The 2**q cells from the projections that don't cover the query, by central moments or the given solver."""
        query = sorted(query)
        found = self.index.prepare_batch(query)
        parts = self.marginals(query, found)
        if solver:
            return solver(len(query), parts)
        s = CoMoment(len(query), (primary[0], [primary[1][b] for b in query]) if primary else None)
        for mask, v in parts:
            s.add(mask, v)
        return s.solve()

    def online(self, query: Sequence[int], cheap: int = 2, primary: tuple | None = None, codes: dict[str, Sequence[int]] | None = None) -> Iterator[tuple[int, np.ndarray]]:
        """(degrees of freedom, cells) after each projection, small ones first; the caller stops when it has enough.

        codes: column -> the codes that rows may have. The query then runs over these columns' bits too, and each answer
        is summed over the cells that have such codes."""
        if codes:
            wide = sorted({*query, *(b for c in codes for b in self.column_bits(c))})
            for degrees, x in self.online(wide, cheap, primary):
                yield degrees, self._diced(x, wide, sorted(query), codes)
            return
        query = sorted(query)
        s = CoMoment(len(query), (primary[0], [primary[1][b] for b in query]) if primary else None)
        for f in self.index.prepare_online(query, cheap):
            for mask, v in self.marginals(query, [f]):
                s.add(mask, v)
            yield s.degrees, s.solve()

    def _diced(self, x: np.ndarray, wide: list[int], query: list[int], codes: dict[str, Sequence[int]]) -> np.ndarray:
        at = np.arange(len(x))
        packed = lambda bits: sum((at >> wide.index(b) & 1) << i for i, b in enumerate(bits))
        keep = np.ones(len(x), bool)
        for c, allowed in codes.items():
            keep &= np.isin(packed(self.column_bits(c)), list(allowed))
        out = packed(query) if query else np.zeros(len(x), int)
        return np.bincount(out[keep], weights=x[keep], minlength=1 << len(query))

    def online_bounds(self, query: Sequence[int], cheap: int = 2) -> Iterator[Bounds]:
        """Exact bounds of every cell after each projection that adds an equation."""
        query = sorted(query)
        b = Bounds(len(query))
        for f in self.index.prepare_online(query, cheap):
            if not b.independent(f.covered):
                continue
            for mask, v in self.marginals(query, [f]):
                b.add(mask, [int(x) for x in v])
            b.tighten()
            yield b
            if not b.degrees:
                return
