"""Embedding near-duplicates by binary codes of randomly rotated vectors.

Vectors of cosine THRESHOLD or more link. Unit vectors, less the mean of all, are turned by
random rotations; the signs of a turned vector are its code, and what the code keeps of the
vector (its inner product with it) is stored as the correction factor. The code of one
vector and another vector itself then give an unbiased estimate of their inner product,
with an error that the factor bounds at SURE standard deviations. Pairs whose upper bound
falls short of the threshold are done with; the others are computed exactly, in double
precision, from the vectors as given.

Which pairs are estimated. The first b turned places are cut at zero, into cells of about
CELL vectors. A vector lies in its own cell and asks every cell within a reach: crossing
into a cell costs the squares of the places that change sign. Of a pair at the threshold,
one asks the other's cell but with probability MISS at most over the rotation (less for
closer pairs); the reach is that quantile of the lesser cost of the two, drawn from
random pairs at plan time. What only one side asks counts for both. So nothing but MISS and
SURE (6e-5 a pair) stands between the result and all pairs; tests find all links.

Askers bring their codes first, and their vectors only to those cells where a bound passed.
Equal vectors are one row with a weight; other links are added up per cell, as numbers of
links and a spanning forest, so a group of near copies never becomes all its pairs. Cells
of many rows are cut into tiles, blocks of members by blocks of askers, in tasks of their own.

Rows whose vector is null, empty, zero or holds null or non-finite components link with
nothing, nor do vectors of different lengths. Null vec_ids take part; a component of
null ids only has component_id null and its rows stay. Rows of equal vec_id are different
vectors: each has its links. An empty table gives no rows. Only vec_id and embedding are read.

Scale. Broadcast are the tiled cells, fewer than 2 * MOST by their bounds, and the rotation.
The driver gets three counts and the mean. Compared are, for each vector, about CELL members of
each cell asked: some ten cells for 1e5 vectors of even directions, a hundred for 1e10.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, spread_join, stored
from .components import connected

THRESHOLD, SURE, MISS, SEED = 0.95, 4.0, 1e-4, 7
CELL, MOST_BITS = 1024, 24
BLOCK, ASKERS, MOST = 4096, 65_536, 100_000  #: rows of a tile, and how many cells may need more than one
UNIT = float(1 << 40)  #: costs are whole multiples of its inverse, so that both sides of a pair add up the same


def valid(c: str) -> F.Column:
    e = F.col(c)
    whole = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(e.isNotNull() & whole & F.exists(e, lambda x: x != 0), F.lit(False))


def matrix(column, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow list column as doubles, short rows filled with zeros, and their lengths."""
    import pyarrow as pa

    column = column.cast(pa.list_(column.type.value_type))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size == dim).all():
        return flat.reshape(-1, dim), size
    out = np.zeros((len(size), dim))
    out[np.arange(dim) < size[:, None]] = flat
    return out, size


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(dim: int, seed: int) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def reach(dim: int, bits: int, spread: float) -> int:
    """The MISS quantile, in UNIT, of the lesser cost between the cells of two vectors at the threshold; spread: the root mean square of their distance from the mean."""
    if not bits:
        return 0
    rng, n = np.random.default_rng(SEED), 100_000
    gap = math.sqrt(2 - 2 * THRESHOLD)
    most = 0.0
    for size in (spread, spread / 2, spread / 4):
        p, d = (z[:, :bits] / np.sqrt((z * z).sum(axis=1, keepdims=True)) for z in (rng.standard_normal((n, dim)) for _ in "pd"))
        p, q = p * size - d * gap / 2, p * size + d * gap / 2
        crossed = (p > 0) != (q > 0)
        cost = np.minimum((p * p * crossed).sum(axis=1), (q * q * crossed).sum(axis=1))
        most = max(most, float(np.quantile(cost, 1 - MISS)))
    return int(most * UNIT)


class Codes:
    """What all tasks share: rotations, mean, and the cells' bits and reach."""

    def __init__(self, dim: int, bits: int, mean: np.ndarray):
        self.dim, self.bits, self.mean = dim, bits, mean
        self.turns = [rotation(dim, SEED + i) for i in range(2)]
        self.reach = reach(dim, bits, math.sqrt(max(0.0, 1 - float(mean @ mean))))
        self.weight = 1 << np.arange(bits, dtype=np.int64)

    def cells(self, centred: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's cell, and what crossing each of its borders costs."""
        # not a matrix product, whose last digits depend on how many rows it has
        turned = np.einsum("ij,kj->ik", centred, self.turns[0][: self.bits])
        return (turned > 0) @ self.weight, np.rint(turned * turned * UNIT)

    def asked(self, cell: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Who, and a cell within reach: a row for each."""
        who, to, paid = np.arange(len(cell)), cell, np.zeros(len(cell))
        for k in range(self.bits):
            on = paid + cost[who, k]
            go = on <= self.reach
            who, to, paid = (np.concatenate([x, y[go]]) for x, y in ((who, who), (to, to ^ (1 << k)), (paid, on)))
        return who, to

    def encoded(self, centred: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signs under either rotation as bytes; for each, the correction; and the error's deviation times SURE, all for the vector's own length."""
        size = np.sqrt((centred * centred).sum(axis=1))
        signs, scale, var = [], [], np.zeros(len(size))
        for turn in self.turns:
            turned = centred @ turn.T
            kept = np.abs(turned).sum(axis=1) / math.sqrt(self.dim) / np.maximum(size, 1e-300)  # inner product of the unit vector and its code
            kept = np.where(size > 0, kept, 1.0)
            signs.append(np.packbits(turned > 0, axis=1))
            scale.append(size / kept / math.sqrt(self.dim) / len(self.turns))
            var += np.maximum(1 - kept * kept, 0) / (kept * kept)
        worst = min(SURE / math.sqrt(self.dim - 1), 1.0) if self.dim > 1 else 1.0
        error = size * np.sqrt(var) / len(self.turns) * worst if worst < 1 else size * np.sqrt(var)
        return np.concatenate(signs, axis=1), np.stack(scale, axis=1), error

    def decoded(self, codes: np.ndarray, scale: np.ndarray) -> np.ndarray:
        """Vectors whose inner product with a centred vector is the estimate."""
        width = codes.shape[1] // len(self.turns)
        out = np.zeros((len(codes), self.dim))
        for k, turn in enumerate(self.turns):
            signs = np.unpackbits(codes[:, k * width : (k + 1) * width], axis=1, count=self.dim).astype(np.float64) * 2 - 1
            out += (signs * scale[:, k : k + 1]) @ turn
        return out


def moments(reps: DataFrame) -> tuple[int, int, np.ndarray]:
    """Of distinct vectors: their number, the longest one's length, and the mean of the units."""
    n, dim = reps.agg(F.count("*"), F.max(F.size("embedding"))).first()
    dim = dim or 0

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa

        total = np.zeros(dim)
        for batch in batches:
            total += units(matrix(batch.column(0), dim)[0]).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim)), pa.array(total)], names=["k", "x"])

    mean = np.zeros(dim)
    if n:
        for k, x in reps.select("embedding").mapInArrow(add, "k long, x double").groupBy("k").agg(F.sum("x")).collect():  # a row a place of the vector
            mean[k] = x / n
    return n, dim, mean


def distinct_vectors(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows with h, a hash of the vector, and the different vectors: h, embedding, n, first_id. Another hash is taken if one is shared."""
    for seed in range(100):
        keyed = rows.withColumn("h", F.xxhash64("embedding", F.lit(seed)))
        reps = keyed.filter(valid("embedding")).groupBy("h").agg(F.min("embedding").alias("embedding"), F.max("embedding").alias("_last"), F.count("*").alias("n"), F.min("vec_id").alias("first_id"))
        reps = stored(reps)
        if reps.filter("embedding <> _last").isEmpty():
            return keyed, reps.drop("_last")
    raise RuntimeError("no hash tells the vectors apart")


def tiled(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """rows (cell, kind 0: member, 1: asker; h) with i, j: the tile; members in all blocks of askers and askers in all blocks of members."""
    big = rows.join(F.broadcast(hot), "cell", "left").withColumns({"_i": F.coalesce("_i", F.lit(1)), "_j": F.coalesce("_j", F.lit(1))})
    other = F.when(F.col("kind") == 0, F.col("_j")).otherwise(F.col("_i"))
    own = F.pmod(F.xxhash64("h"), F.when(F.col("kind") == 0, F.col("_i")).otherwise(F.col("_j"))).cast("int")
    each = big.withColumn("_own", own).withColumn("_other", F.explode(F.sequence(F.lit(0), other - 1)))
    member = F.col("kind") == 0
    return each.withColumns({"i": F.when(member, F.col("_own")).otherwise(F.col("_other")), "j": F.when(member, F.col("_other")).otherwise(F.col("_own"))}).drop("_i", "_j", "_own", "_other")


def tiles(batches: Iterator) -> Iterator[tuple[tuple, list, Iterator]]:
    """Of rows sorted by (cell, i, j, kind): each tile, its members, and its askers piece by piece."""
    import pyarrow as pa

    def pieces() -> Iterator:
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)], axis=1)
            cut = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(key)], strict=True):
                yield tuple(key[a].tolist()), batch.slice(a, b - a)

    at, members, askers = None, [], []
    for (*tile, kind), part in pieces():
        if tile != at:
            if members and askers:
                yield at, pa.Table.from_batches(members), askers
            at, members, askers = tile, [], []
        (askers if kind else members).append(part)
        if kind and members and sum(x.num_rows for x in askers) > 2 * BLOCK:
            yield at, pa.Table.from_batches(members), askers
            askers = []
    if members and askers:
        yield at, pa.Table.from_batches(members), askers


def column(table, name: str):
    import pyarrow as pa

    found = table[name]
    found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
    return found.chunk(0) if isinstance(found, pa.ChunkedArray) else found


def links(reps: DataFrame, codes: Codes, n: int) -> DataFrame:
    """a, b, k: links of a spanning forest (a, b: hashes), or, where b is null, how many rows other than copies of a it links with."""
    kind = reps.schema["embedding"].dataType
    bits = codes.bits

    def counted(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                x, _ = matrix(batch.column(0).slice(at, BLOCK), codes.dim)
                cell, cost = codes.cells(units(x) - codes.mean)
                _, to = codes.asked(cell, cost)
                for side, cells in ((0, cell), (1, to)):
                    key, m = np.unique(cells, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(m if side == 0 else m * 0), pa.array(m if side else m * 0)], names=["cell", "own", "asks"])

    cells = reps.select("embedding").mapInArrow(counted, "cell long, own long, asks long").groupBy("cell").agg(F.sum("own").alias("own"), F.sum("asks").alias("asks"))
    cells = checkpointed(cells)
    # so fewer than MOST cells hold more members than a block, and fewer than MOST more askers
    block, most_asks = max(BLOCK, n // MOST), max(ASKERS, cells.agg(F.sum("asks")).first()[0] // MOST)
    wide = cells.select("cell", F.ceil(F.col("own") / block).cast("int").alias("_i"), F.ceil(F.col("asks") / most_asks).cast("int").alias("_j")).filter("_i > 1 or _j > 1")
    hot = checkpointed(wide)  # fewer than 2 * MOST rows

    fields = "cell long, kind int, h long, n long, embedding array<%s>, code binary, s0 double, s1 double, error double, mean double" % kind.elementType.simpleString()

    def spread(batches: Iterator, asking: bool = True) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, _ = matrix(part.column(1), codes.dim)
                centred = units(x) - codes.mean
                cell, cost = codes.cells(centred)
                m = len(x)
                none = pa.nulls(m)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.zeros(m, np.int32)), part.column(0), part.column(2), part.column(1), none.cast(pa.binary()), *[none.cast(pa.float64())] * 4], names=names)
                if not asking:
                    continue
                who, to = codes.asked(cell, cost)
                code, scale, error = codes.encoded(centred)
                code = pa.array([r.tobytes() for r in code], pa.binary())
                mean = centred @ codes.mean
                for a in range(0, len(who), 1 << 16):
                    w = who[a : a + (1 << 16)]
                    pick, none = pa.array(w), pa.nulls(len(w))
                    yield pa.RecordBatch.from_arrays([pa.array(to[a : a + (1 << 16)]), pa.array(np.ones(len(w), np.int32)), part.column(0).take(pick), part.column(2).take(pick), none.cast(part.column(1).type), code.take(pick), pa.array(scale[w, 0]), pa.array(scale[w, 1]), pa.array(error[w]), pa.array(mean[w])], names=names)

    names = [f.split()[0] for f in fields.split(", ")]

    def estimate(batches: Iterator) -> Iterator:
        """Which askers have a pair in the tile that must be computed."""
        import pyarrow as pa

        c2 = float(codes.mean @ codes.mean)
        known, base = None, None
        for tile, members, askers in tiles(batches):
            if known is not members:
                x, _ = matrix(column(members, "embedding"), codes.dim)
                base = units(x) - codes.mean
                own = column(members, "h").to_numpy()
                along = base @ codes.mean
                known = members
            for part in askers:
                for at in range(0, part.num_rows, BLOCK):
                    p = part.slice(at, BLOCK)
                    code = np.frombuffer(b"".join(column(p, "code").to_pylist()), np.uint8).reshape(p.num_rows, -1)
                    get = lambda name, p=p: column(p, name).to_numpy(zero_copy_only=False)
                    size = np.sqrt((base * base).sum(axis=1))
                    est = codes.decoded(code, np.stack([get("s0"), get("s1")], axis=1)) @ base.T
                    # the cosine is that of the centred parts, and what either has along the mean
                    est += get("error")[:, None] * size[None, :]
                    est += (get("mean")[:, None] + along[None, :]) + c2
                    est[get("h")[:, None] == own[None, :]] = -1
                    some = np.flatnonzero((est >= THRESHOLD - 1e-9).any(axis=1))
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), tile[0])), *(pa.array(np.full(len(some), t, np.int32)) for t in tile[1:]), pa.array(get("h")[some])], names=["cell", "i", "j", "h"])

    def exact(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(a, b, k) -> pa.RecordBatch:
            none = pa.nulls(len(a)).cast(pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if k is None else pa.array(k)], names=["a", "b", "k"])

        for tile, members, askers in tiles(batches):
            y, long = matrix(column(members, "embedding"), codes.dim)
            v = units(y)
            own, weight = column(members, "h").to_numpy(), column(members, "n").to_numpy()
            _, cost = codes.cells(v - codes.mean)
            for part in askers:
                for at in range(0, part.num_rows, 1024):
                    p = part.slice(at, 1024)
                    x, short = matrix(column(p, "embedding"), codes.dim)
                    u = units(x)
                    h, m = column(p, "h").to_numpy(), column(p, "n").to_numpy()
                    linked = (u @ v.T >= THRESHOLD) & (h[:, None] != own[None, :]) & (short[:, None] == long[None, :])
                    i, j = np.nonzero(linked)
                    if not len(i):
                        continue
                    # members that don't ask the asker's cell get the link here
                    home, _ = codes.cells(u - codes.mean)
                    crossed = ((home[:, None] ^ tile[0]) >> np.arange(bits)) & 1
                    alone = (crossed.astype(np.float64) @ cost.T)[i, j] > codes.reach
                    got = np.bincount(i, weight[j], len(h)).astype(np.int64)
                    given = np.bincount(j[alone], m[i[alone]], len(own)).astype(np.int64)
                    some = np.flatnonzero(given)
                    yield out(np.r_[h[got > 0], own[some]], None, np.r_[got[got > 0], given[some]])
                    yield out(*forest(i, j, h, own), None)

    rows = reps.select("h", "embedding", "n").mapInArrow(spread, fields)
    dealt = lambda df: df.select("cell", "i", "j", "kind", *(c for c in df.columns if c not in ("cell", "i", "j", "kind"))).repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j", "kind")
    asks = stored(dealt(tiled(rows, hot)).mapInArrow(estimate, "cell long, i int, j int, h long"))
    come = asks.join(reps.select("h", "n", "embedding"), "h").withColumn("kind", F.lit(1))
    homes = reps.select("h", "embedding", "n").mapInArrow(lambda batches: spread(batches, False), fields)
    there = tiled(homes.select("cell", "kind", "h", "n", "embedding"), hot).join(asks.select("cell", "i", "j").distinct(), ["cell", "i", "j"], "left_semi")
    return stored(dealt(there.unionByName(come.select(*there.columns))).mapInArrow(exact, "a long, b long, k long"))


def forest(i: np.ndarray, j: np.ndarray, h: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs i, j connect, fewer than there are vectors."""
    root = np.arange(len(own))
    while True:
        top = np.full(len(h), len(own))
        np.minimum.at(top, i, root[j])
        new = root.copy()
        np.minimum.at(new, j, top[i])
        new = new[new]
        if (new == root).all():
            break
        root = new
    askers = np.flatnonzero(top < len(own))
    moved = np.flatnonzero(root != np.arange(len(own)))
    return np.r_[h[askers], own[moved]], np.r_[own[top[askers]], own[root[moved]]]


def near_duplicates(rows: DataFrame) -> DataFrame:
    """op12: vec_id, n_links, component_id, kept."""
    e = F.col("embedding")
    if not isinstance(rows.schema["embedding"].dataType.elementType, T.FloatType):
        e = e.cast("array<double>")
    keyed, reps = distinct_vectors(rows.select("vec_id", e.alias("embedding")))
    n, dim, mean = moments(reps)
    if not n:
        return keyed.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    bits = min(MOST_BITS, dim, max(0, round(math.log2(n / CELL))))
    found = links(reps, Codes(dim, bits, mean), n)
    counts = found.filter("b is null").groupBy(F.col("a").alias("h")).agg(F.sum("k").alias("k"))
    roots = connected(found.filter("b is not null").select("a", "b"))
    named = checkpointed(roots.withColumnRenamed("node", "h").join(reps.select("h", "first_id"), "h"))
    total = named.count()
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"), F.count("*").alias("n"))
    classes = reps.select("h", "n", "first_id").join(spread_join(named.select("root", "h"), least, "root", total).select("h", "component_id"), "h", "left").join(counts, "h", "left")
    known = classes.select("h", "n", (F.col("n") - 1 + F.coalesce("k", F.lit(0))).alias("n_links"), F.coalesce("component_id", "first_id").alias("component_id"))
    good = valid("embedding")
    linked = spread_join(keyed.filter(good).select("vec_id", "h"), stored(known), "h", keyed.count()).select("vec_id", "n_links", "component_id")
    alone = keyed.filter(~good).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
