"""Embedding near-dedup by a subspace pigeonhole join.

Two unit vectors with cosine c are 2 - 2c apart, squared. Split into blocks of coordinates,
that distance is the sum of the blocks' distances, so a pair at or below the limit is at or
below its share of the limit in one block at least. The vectors are turned by a fixed random
rotation, which spreads the distance evenly, and every block gets the share of its dimensions.

Each block is range-joined on its own: a grid over the block's coordinates, cut at quantiles
and refined with the number of vectors of a label, gives each vector one home cell and as many
probes as cells lie within the block's radius. Vectors meet where one's probe is the other's
home. There the block's distances are computed as matrices, candidates within the radius are
verified by their exact cosine, and a pair is counted only in the first block that admits it,
so the union over blocks needs no table of pairs. What leaves a tile is one row per vector: its
number of links, and the vectors it hangs together with. Pairs are never written down.

Identical vectors are one class from the start. A cell with very many vectors is split into
tiles of bounded size, each pairing a part of the homes with a part of the probes; the number
of comparisons inside a dense cell remains what exact link counts ask for.

Defined results: vectors that are null, empty, zero, or hold null, NaN or infinite components,
vectors without label, and vectors without id link with nothing. Vectors of different length
never link. Rows that share an id are one vector with several values for the purpose of
components. An empty table gives an empty result. Only the three named columns are read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import store
from .components import components

COSINE = 0.93
BLOCK_DIMENSIONS = 16
#: Vectors of a label per cell of its grid, and the most vectors on either side of a tile.
CELL_VECTORS, TILE_VECTORS = 4096, 16384
#: Rows that the quantiles of the grid are taken from; they place cells, and decide no link.
GRID_SAMPLE = 10_000
#: The least of them for a length of vectors; lengths beyond what that leaves room for are not cut.
GRID_LEAST = 100
PAIRS_AT_ONCE = 1 << 21


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dims).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def blocks(dims: int, size: int) -> list[slice]:
    count = max(1, round(dims / size))
    edges = np.linspace(0, dims, count + 1).round().astype(int)
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True)]


def budgets(dims: int, size: int, cosine: float) -> list[float]:
    """Squared distance that each block may take; a hair more than its share, for rounding."""
    return [(2 - 2 * cosine) * (b.stop - b.start) / dims * (1 + 1e-9) + 1e-15 for b in blocks(dims, size)]


def unit(vectors: list) -> np.ndarray:
    x = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def near_cells(points: np.ndarray, cuts: np.ndarray, depth: int, budget: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, cell and whether it is home, for every cell that reaches into a point's radius.

    The first ``depth`` coordinates, going round, are halved at their quantiles; a cell is the
    path of halves, and its distance the sum of squares over coordinates.
    """
    n, dims = points.shape
    halvings = [depth // dims + (i < depth % dims) for i in range(min(depth, dims))]
    rows, codes = np.arange(n), np.zeros(n, dtype=np.int64)
    spent, home = np.zeros(n), np.ones(n, dtype=bool)
    for i, h in enumerate(halvings):
        slabs = 1 << h
        bounds = np.concatenate([[-np.inf], np.quantile(cuts[:, i], np.arange(1, slabs) / slabs), [np.inf]])
        x = points[rows, i]
        own = np.searchsorted(bounds[1:-1], x, side="right")
        found = []
        for s in range(slabs):
            away = np.maximum(0, np.maximum(bounds[s] - x, x - bounds[s + 1]))
            total = spent + away**2
            fits = (total <= budget) | (own == s) & home
            found.append((rows[fits], codes[fits] * slabs + s, total[fits], home[fits] & (own[fits] == s)))
        rows, codes, spent, home = (np.concatenate(parts) for parts in zip(*found, strict=True))
    return rows, codes, home


def pairs_in_tile(homes: np.ndarray, probes: np.ndarray, block: int, size: int, cosine: float):
    """Pairs (probe, home) that are links and belong to this block, in bounded portions."""
    dims = homes.shape[1]
    parts, limits, turn = blocks(dims, size), budgets(dims, size, cosine), rotation(dims)
    h, p = homes @ turn, probes @ turn
    mine = parts[block]
    h32, p32 = h[:, mine].astype(np.float32), p[:, mine].astype(np.float32)
    h_norm = (h32**2).sum(axis=1)
    step = max(1, PAIRS_AT_ONCE // max(1, len(homes)))
    for at in range(0, len(probes), step):
        some = slice(at, at + step)
        rough = (p32[some] ** 2).sum(axis=1)[:, None] + h_norm[None, :] - 2 * (p32[some] @ h32.T)
        i, j = np.nonzero(rough <= limits[block] + 1e-4)
        if len(i) * 20 > rough.size:
            linked = probes[some] @ homes.T >= cosine
            linked &= rough <= limits[block] + 1e-4
            i, j = np.nonzero(linked)
        for k in range(0, len(i), 1 << 15):
            a, b = i[k : k + (1 << 15)], j[k : k + (1 << 15)]
            exact = np.einsum("nd,nd->n", probes[some][a], homes[b]) >= cosine
            a, b = a[exact], b[exact]
            gap = (p[some][a] - h[b]) ** 2
            first = np.full(len(a), -1)
            for n in range(block, -1, -1):
                first[gap[:, parts[n]].sum(axis=1) <= limits[n]] = n
            keep = first == block
            yield a[keep] + at, b[keep]


def join_roots(roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Merge the sets that hold ``a`` and ``b``; a root is the smallest index of its set."""
    while True:
        x, y = roots[a], roots[b]
        differ = x != y
        if not differ.any():
            return
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(roots, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = roots[roots]
            if (up == roots).all():
                break
            roots[:] = up


def near_duplicates(
    vectors: DataFrame,
    cosine: float = COSINE,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    block_dimensions: int = BLOCK_DIMENSIONS,
    cell_vectors: int = CELL_VECTORS,
    tile_vectors: int = TILE_VECTORS,
) -> DataFrame:
    """One row per input row: id, n_links, component_id, kept."""
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")
    )
    number = F.lit(float("inf"))
    sound = (
        F.col("id").isNotNull()
        & F.col("label").isNotNull()
        & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < number))
        & F.exists("vector", lambda x: x != 0)
    )
    rows = store(rows.withColumn("sound", F.coalesce(sound, F.lit(False))), "vectors")
    sound_rows = rows.where("sound").drop("sound")
    classes = store(
        sound_rows.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes"
    )
    tiles = _tiles(classes, cosine, block_dimensions, cell_vectors, tile_vectors)
    kind = classes.schema["rep"].dataType.simpleString()

    def count_links(tile: pd.DataFrame) -> pd.DataFrame:
        x = unit(tile["vector"].tolist())
        rep, copies = tile["rep"].to_numpy(), tile["copies"].to_numpy()
        at_home = np.flatnonzero(tile["is_home"].to_numpy())
        probing = np.flatnonzero(tile["is_probe"].to_numpy())
        links, roots = np.zeros(len(tile), dtype=np.int64), np.arange(len(tile))
        block = int(tile["block"].iloc[0])
        for a, b in pairs_in_tile(x[at_home], x[probing], block, block_dimensions, cosine):
            a, b = probing[a], at_home[b]
            other = rep[a] != rep[b]
            a, b = a[other], b[other]
            np.add.at(links, a, copies[b])
            join_roots(roots, a, b)
        told = np.flatnonzero((links > 0) | (roots != np.arange(len(tile))))
        return pd.DataFrame({"rep": rep[told], "links": links[told], "with_rep": rep[roots[told]]})

    keys = ["label", "dims", "block", "cell", "home_part", "probe_part"]
    found = store(
        tiles.groupBy(*keys).applyInPandas(count_links, f"rep {kind}, links bigint, with_rep {kind}"), "tile-links"
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    same_id = sound_rows.join(classes, ["label", "vector"]).select("id", "rep", "copies")
    same_id = store(same_id, "members")
    hung = found.select(F.col("rep").alias("a"), F.col("with_rep").alias("b"))
    hung = hung.union(same_id.select(F.col("id").alias("a"), F.col("rep").alias("b")))
    parts = components(hung)
    counted = store(
        classes.select("rep", "label", "vector", "copies").join(links, "rep", "left"), "counted"
    ).select("label", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    out = rows.join(counted, ["label", "vector"], "left").join(
        parts.select(F.col("node").alias("id"), "component"), "id", "left"
    )
    component = F.when(F.col("sound"), F.coalesce("component", "id")).otherwise(F.col("id"))
    return out.select(
        "id",
        F.when(F.col("sound"), F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"),
    )


def _grids(classes: DataFrame, depths: DataFrame) -> dict[int, np.ndarray]:
    """Turned vectors to cut the cells at, for each length that has cells: a bounded sample of each."""
    lengths = depths.where("depth > 0").groupBy("dims").agg(F.sum("rows").alias("rows"))
    lengths = lengths.orderBy(F.desc("rows"), "dims").limit(max(1, GRID_SAMPLE // GRID_LEAST)).collect()
    if not lengths:
        return {}
    each = max(1, GRID_SAMPLE // len(lengths))
    shares = {r["dims"]: min(1.0, 2 * each / r["rows"]) for r in lengths}
    share = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])[F.col("dims")]
    place = F.xxhash64("vector", "rep")
    some = classes.select("dims", "vector", place.alias("place"))
    some = some.where(F.pmod("place", F.lit(1 << 40)) / F.lit(float(1 << 40)) < F.coalesce(share, F.lit(0.0)))
    nth = F.row_number().over(Window.partitionBy("dims").orderBy("place"))
    sample = some.withColumn("nth", nth).where(F.col("nth") <= each).select("dims", "vector").toPandas()
    return {int(dims): unit(part["vector"].tolist()) @ rotation(int(dims)) for dims, part in sample.groupby("dims")}


def _tiles(classes: DataFrame, cosine: float, size: int, cell_vectors: int, tile_vectors: int) -> DataFrame:
    """Vectors in all tiles they belong to: label, dims, block, cell, parts, roles and values."""
    classes = classes.withColumn("dims", F.size("vector"))
    depth = F.ceil(F.log2(F.count("*") / F.lit(cell_vectors)))
    depths = classes.groupBy("label", "dims").agg(
        F.greatest(F.lit(0), depth).cast("int").alias("depth"), F.count("*").alias("rows")
    )
    depths = store(depths, "depths")
    grids = _grids(classes, depths)
    classes = classes.join(depths.drop("rows"), ["label", "dims"])
    kinds = {c: classes.schema[c].dataType.simpleString() for c in ("label", "rep", "vector")}

    def cells(batches, values: bool):
        for batch in batches:
            for (dims, depth), part in batch.groupby(["dims", "depth"]):
                dims = int(dims)
                turned = unit(part["vector"].tolist()) @ rotation(dims)
                grid = grids.get(dims, turned[:0])
                # Cuts are the same for all rows, or there are none.
                depth = int(depth) if len(grid) else 0
                for n, (columns, budget) in enumerate(zip(blocks(dims, size), budgets(dims, size, cosine), strict=True)):
                    where, cell, home = near_cells(turned[:, columns], grid[:, columns], depth, budget)
                    head = part.iloc[where][["label", "dims"]].assign(block=n, cell=cell, is_home=home)
                    if values:
                        chosen = part.iloc[where][["rep", "copies", "vector"]]
                        yield pd.concat([head, chosen], axis=1)
                    else:
                        yield head

    schema = f"label {kinds['label']}, dims int, block int, cell bigint, is_home boolean"
    keys = ["label", "dims", "block", "cell"]
    sizes = classes.select("label", "dims", "depth", "vector").mapInPandas(lambda b: cells(b, False), schema)
    sizes = sizes.groupBy(*keys).agg(F.count_if("is_home").alias("homes"), F.count("*").alias("probes"))
    large = sizes.where(F.greatest("homes", "probes") > tile_vectors)
    up = lambda c: F.ceil(F.col(c) / tile_vectors).cast("int")
    large = store(large.select(*keys, up("homes").alias("home_parts"), up("probes").alias("probe_parts")), "large-cells")
    placed = classes.mapInPandas(
        lambda b: cells(b, True), f"{schema}, rep {kinds['rep']}, copies bigint, vector {kinds['vector']}"
    )
    one = F.lit(0)
    if large.isEmpty():
        return placed.withColumns({"is_probe": F.lit(True), "home_part": one, "probe_part": one})
    placed = placed.join(large, keys, "left")
    placed = placed.fillna(1, ["home_parts", "probe_parts"])
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    homes = placed.where("is_home").withColumn("is_probe", F.lit(False))
    homes = homes.withColumn("home_part", F.expr("cast(pmod(hash(rep), home_parts) as int)"))
    homes = homes.withColumn("probe_part", every("probe_parts"))
    probes = placed.withColumns({"is_probe": F.lit(True), "is_home": F.lit(False)})
    probes = probes.withColumn("probe_part", F.expr("cast(pmod(xxhash64(rep), probe_parts) as int)"))
    probes = probes.withColumn("home_part", every("home_parts"))
    return homes.unionByName(probes).drop("home_parts", "probe_parts")
