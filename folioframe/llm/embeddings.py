"""Embedding near-dedup as an exact metric range join.

Equal vectors form a class with a multiplicity; one of each goes on. A bounded sample of
vectors serves as pivots; each vector is at home in the cell of its nearest pivot. The
angle is a metric, so by the triangle inequality a vector can only link into cell i if its
angle to that pivot is at most its angle to its own pivot plus twice the linking angle,
and at most the radius of cell i plus the linking angle: there it is replicated. A pair is
compared in the lesser of its two home cells, so a vector goes to cells up to its own. Each
cell finds the links of those at home in it against all its members, independently. A large
cell is dealt out in pairs of blocks. Per pair of blocks only link counts and a spanning
forest of the links leave the task, so what is written grows with the vectors, not with the
links.

Pivots decide how much is replicated, never what links. Classes of equal vectors have
numbers of their own, so an id may come with unlike vectors.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing; vectors of different length never link; repeated rows (the same id and
vector twice) count as two vectors of one component; rows of one id with unlike vectors are
vectors of their own, each linked by its own components, and a component is named by the
least id in it; a null id is kept, is no name of a component and has no links of its own; an
empty table gives an empty result. Only the id and vector columns are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.llm.components import connected_components, least_names
from folioframe.llm.scratch import Scratch, cut
from folioframe.llm.streams import groups

BLOCK_BYTES = 8 << 20  # of doubles in a block of vectors
PIVOT_BYTES = 64 << 20  # of pivots of one length, at most
_SLACK = 1e-9  # on angles, far above rounding and far below any use


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each valid vector as bytes of doubles, with its length and a 128-bit key."""
    for batch in batches:
        column = batch.column(1)
        raw, size, one, two = [], [], [], []
        for i in range(batch.num_rows):
            x = column[i].values if column[i].is_valid else None
            x = None if x is None or x.null_count or not len(x) else x.to_numpy(zero_copy_only=False).astype(np.float64)
            if x is None or not np.isfinite(x).all() or not x.any():
                raw.append(None)
                size.append(0)
                one.append(0)
                two.append(0)
                continue
            raw.append((x + 0.0).tobytes())  # -0 and 0 are equal
            size.append(len(x))
            digest = np.frombuffer(hashlib.blake2b(raw[-1], digest_size=16).digest(), np.int64)
            one.append(digest[0])
            two.append(digest[1])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(size, pa.int32()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array(raw, pa.binary())],
            ["vec_id", "size", "one", "two", "vector"],
        )


def unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _by_size(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, np.ndarray]]:
    sizes = batch.column(column).to_numpy()
    for size in np.unique(sizes):
        yield int(size), np.flatnonzero(sizes == size)


def _homes(shared):
    """Columns size, node, many, vector: with the cell of each row and the angle to its pivot."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[int, np.ndarray] = shared.value
        for batch in batches:
            for size, rows in _by_size(batch, 0):
                taken = batch.take(pa.array(rows))
                near = angles(unit([v.as_py() for v in taken.column(3)]), pivots[size])
                cell = near.argmin(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [*taken.columns, pa.array(cell.astype(np.int32)), pa.array(near.min(axis=1))],
                    ["size", "node", "many", "vector", "cell", "angle"],
                )

    return emit


_HOMES = "size int, node long, many long, vector binary, cell int, angle double"
_MEMBERS = "size int, cell int, home boolean, node long, many long, vector binary"


def _members(shared, reach: float):
    """Columns size, node, many, vector, cell: a row for each cell that the vector is a member of."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots, radii = shared.value
        for batch in batches:
            for size, rows in _by_size(batch, 0):
                for part in np.array_split(rows, max(1, len(rows) // 1000)):
                    taken = batch.take(pa.array(part))
                    near = angles(unit([v.as_py() for v in taken.column(3)]), pivots[size])
                    least = near.min(axis=1, keepdims=True)
                    own = taken.column(4).to_numpy()
                    reached = (near <= least + 2 * reach + _SLACK) & (near <= radii[size][None, :] + reach + _SLACK)
                    row, cell = np.nonzero(reached & (np.arange(near.shape[1])[None, :] <= own[:, None]))
                    at = pa.array(row)
                    yield pa.RecordBatch.from_arrays(
                        [
                            taken.column(0).take(at),
                            pa.array(cell.astype(np.int32)),
                            pa.array(own[row] == cell),
                            taken.column(1).take(at),
                            taken.column(2).take(at),
                            taken.column(3).take(at),
                        ],
                        ["size", "cell", "home", "node", "many", "vector"],
                    )

    return emit


def _near(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with a cosine of ``least`` or more: by single precision, and by double where that could err."""
    margin = max(1e-5, a.shape[1] * 1e-7)
    low_a, low_b = a.astype(np.float32), b.astype(np.float32)
    rows, columns = [], []
    for at in range(0, len(a), 512):
        cosine = low_a[at : at + 512] @ low_b.T
        row, column = np.nonzero(cosine >= least - margin)
        close = np.flatnonzero(cosine[row, column] < least + margin)
        good = np.ones(len(row), bool)
        for part in np.array_split(close, max(1, len(close) // 10_000)):
            good[part] = np.einsum("ij,ij->i", a[at + row[part]], b[column[part]]) >= least
        rows.append(at + row[good])
        columns.append(column[good])
    return np.concatenate(rows), np.concatenate(columns)


def _linked(least: float):
    """Of rows sorted by size, cell, i, j: link counts, and a forest of the links.

    Rows are of the block i of those at home (``as_home``) or of the block j of members; a
    pair of two vectors at home comes twice, once for each, and any other once for both.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in groups(batches, ["size", "cell", "i", "j"]):
            as_home = group["as_home"].to_numpy()
            ids, many, at_home = group["node"].to_numpy(), group["many"].to_numpy(), group["home"].to_numpy()
            x = unit(group["vector"].to_pylist())
            homes, members = np.flatnonzero(as_home), np.flatnonzero(~as_home)
            if not len(homes) or not len(members):
                continue
            row, column = _near(x[homes], x[members], least)
            other = ids[homes][row] != ids[members][column]
            row, column = row[other], column[other]
            counts = np.bincount(row, many[members][column], len(homes)).astype(np.int64)
            guest = ~at_home[members][column]
            counts_m = np.bincount(column[guest], many[homes][row[guest]], len(members)).astype(np.int64)
            label_h, label_m = ids[homes].copy(), ids[members].copy()
            while True:
                new_h, new_m = label_h.copy(), label_m.copy()
                np.minimum.at(new_h, row, label_m[column])
                np.minimum.at(new_m, column, new_h[row])
                if (new_h == label_h).all() and (new_m == label_m).all():
                    break
                label_h, label_m = new_h, new_m
            out = np.concatenate([ids[homes], ids[members]])
            label = np.concatenate([label_h, label_m])
            links = np.concatenate([counts, counts_m])
            keep = (links > 0) | (out != label)
            yield pa.RecordBatch.from_arrays([pa.array(out[keep]), pa.array(label[keep]), pa.array(links[keep])], ["node", "label", "links"])

    return emit


def embedding_duplicates(
    vectors: DataFrame,
    *,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    least: float = 0.9,
    pivots: int | None = None,
) -> DataFrame:
    """Per vector ``vec_id, n_links, component_id, kept``; a link is a cosine of ``least`` or more.

    ``pivots`` is the number of pivot vectors for each vector length (default: one for 4,096
    classes, at least 8 and at most ``PIVOT_BYTES`` of them), picked by hash.
    """
    if not 0 < least <= 1:
        raise ValueError("least must be in (0, 1]")
    spark = vectors.sparkSession
    reach = float(np.arccos(least))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    with Scratch(spark) as scratch:
        rows = scratch.put(rows.mapInArrow(_vectors, "vec_id long, size int, one long, two long, vector binary"), "rows")
        key = ["size", "one", "two"]
        valid = rows.where("size > 0 and vec_id is not null")
        classes = valid.groupBy(*key).agg(F.min("vec_id").alias("head"), F.count("*").alias("many"))
        classes = scratch.put_clean(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # written, so numbers stay
        own = classes.select("node", "many", F.col("head").alias("vec_id"), *key)
        heads = valid.join(own, ["vec_id", *key]).dropDuplicates(["node"])
        heads = scratch.put_clean(heads.select("size", "node", "many", "vector"), "heads")
        counts = {r["size"]: r["count"] for r in heads.groupBy("size").count().collect()}  # one row a vector length
        chosen = {}
        for size, n in counts.items():
            wanted = pivots or max(8, min(PIVOT_BYTES // (8 * size), n // 4096))
            order = F.xxhash64(F.col("node"), F.lit(3))
            chosen[size] = unit([r.vector for r in heads.where(F.col("size") == size).orderBy(order, "node").select("vector").limit(wanted).collect()])
        homes = heads.mapInArrow(_homes(spark.sparkContext.broadcast(chosen)), _HOMES)
        homes = scratch.put(homes, "homes")
        radii = {size: np.full(len(p), -np.inf) for size, p in chosen.items()}
        for r in homes.groupBy("size", "cell").agg(F.max("angle").alias("radius")).collect():  # one row a pivot
            radii[r["size"]][r["cell"]] = r["radius"]
        shared = spark.sparkContext.broadcast((chosen, radii))
        members = homes.select("size", "node", "many", "vector", "cell").mapInArrow(_members(shared, reach), _MEMBERS)
        members = scratch.put(members, "members")
        per_cell = members.groupBy("size", "cell").agg(F.count("*").alias("n"), F.count(F.when(F.col("home"), 1)).alias("n_home"))
        most = F.greatest(F.lit(BLOCK_BYTES) / (F.col("size") * 8), F.lit(1.0))
        per_cell = per_cell.select("size", "cell", F.ceil(F.col("n") / most).cast("int").alias("bm"), F.ceil(F.col("n_home") / most).cast("int").alias("bh"))
        placed = members.join(F.broadcast(per_cell), ["size", "cell"])  # one row a pivot
        spot = F.xxhash64("node")
        i, j = F.pmod(spot, "bh").cast("int"), F.pmod(spot, "bm").cast("int")
        common = ["size", "cell", "home", "node", "many", "vector"]
        at_home = placed.where("home").select(*common, i.alias("i"), F.explode(F.sequence(F.lit(0), F.col("bm") - 1)).alias("j"), F.lit(True).alias("as_home"))
        others = placed.where("bh > 0").select(*common, F.explode(F.sequence(F.lit(0), F.col("bh") - 1)).alias("i"), j.alias("j"), F.lit(False).alias("as_home"))
        pairs = at_home.unionByName(others).repartition("size", "cell", "i", "j").sortWithinPartitions("size", "cell", "i", "j")
        found = scratch.put(pairs.mapInArrow(_linked(least), "node long, label long, links long"), "found")
        links = found.groupBy("node").agg(F.sum("links").alias("links"))
        component = connected_components(found.select(F.col("node").alias("a"), F.col("label").alias("b")))
        named = least_names(component, classes.select("node", "head"))
        by_class = classes.join(links, "node", "left").join(named, "node", "left")
        by_class = by_class.select(*key, "head", "many", "links", "component_id")
        n_links = F.col("many") - 1 + F.coalesce("links", F.lit(0))
        linked = valid.select("vec_id", *key).join(by_class, key)
        linked = linked.select("vec_id", n_links.cast("long").alias("n_links"), F.coalesce("component_id", "head").alias("component_id"))
        alone = rows.where("size = 0 or vec_id is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
        result = linked.unionByName(alone)
        return cut(result.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))
