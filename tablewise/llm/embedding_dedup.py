"""Embedding near-duplicates by sorted projection passes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tablewise.llm.common import components, cut

# Sign bits of one pass, passes, and neighbours compared to either side.
BITS = 62
PASSES = 16
NEIGHBOURS = 12
# Chance of meeting any linked vector in a window below which a vector is compared exactly.
RECALL = 0.999
# Rows of a block, both in a pass and where a component is counted out.
BLOCK = 2048


def can_link(vector: str, label: str):
    """Whether a row takes part: label not null, vector not null or zero, components finite and not null."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(F.col(label).isNotNull() & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def pass_keys(dims: int, number: int) -> np.ndarray:
    """Random hyperplanes of one pass."""
    return np.random.default_rng(1000 + number).normal(size=(dims, BITS))


def normalised(rows: list[list[float]]) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square overflows."""
    x = np.array(rows, np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact-order dot products in double precision, the same for a pair wherever it is met."""
    return np.einsum("ij,ij->i", a, b)


def _ranked(classes: DataFrame, passes: int) -> DataFrame:
    """Classes in the order of each pass: (pass, label, dims, place), place counted from 0 within all rows.

    Rows are sorted by pass, label, length of the vector, and the concatenated hash
    bits. Counts per partition (one number for each) turn positions within partitions
    into places in the whole order.
    """

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        powers = 1 << np.arange(BITS - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                rows = batch.slice(at, BLOCK)
                units = rows.column(2).to_pylist()
                by_size: dict[int, list[int]] = {}
                for i, unit in enumerate(units):
                    by_size.setdefault(len(unit), []).append(i)
                for size, places in by_size.items():
                    x = np.array([units[i] for i in places])
                    some = rows.take(pa.array(places))
                    for number in range(passes):
                        plane = planes.setdefault((size, number), pass_keys(size, number))
                        bits = ((x @ plane) > 0) @ powers
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(np.full(len(places), number, np.int32)),
                                some.column(1),
                                pa.array(np.full(len(places), size, np.int32)),
                                pa.array(bits.astype(np.int64)),
                                some.column(0),
                                some.column(2),
                            ],
                            names=["pass", "label", "dims", "bits", "id", "unit"],
                        )

    kind = classes.schema["label"].dataType.simpleString()
    hashed = classes.select("id", "label", "unit").mapInArrow(
        hashes, f"pass int, label {kind}, dims int, bits long, id long, unit array<double>"
    )
    order = ["pass", "label", "dims", "bits", "id"]
    ranged = hashed.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(ranged.withColumn("_at", F.monotonically_increasing_id()))
    part, inside = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, total = [], 0
    for p in sorted(sizes):
        starts.append((p, total))
        total += sizes[p]
    if not starts:
        return placed.select(*order, "unit", F.lit(0).cast("long").alias("place"))
    offsets = placed.sparkSession.createDataFrame(starts, "p long, start long")
    return placed.withColumn("p", part).join(F.broadcast(offsets), "p").select(*order, "unit", (F.col("start") + inside).alias("place"))


def _window_links(ranked: DataFrame, least: float, reach: int) -> DataFrame:
    """Verified links (a, b) of rows at most ``reach`` places apart with equal pass, label and length.

    The order is dealt out in blocks of BLOCK places; a block also gets the ``reach``
    rows on either side of it, so no neighbour is missed at an edge.

    Further rows (a, null, miss) hold the logarithm of the chance that the pass misses a
    vector at the bound: two vectors at an angle agree in each bit with chance
    1 - angle / pi, and those that agree in more bits than the last neighbour does are
    inside the window. A pass whose window holds the whole label gives no such row.
    """
    agree = 1 - np.arccos(min(max(least, -1.0), 1.0)) / np.pi
    block = F.floor(F.col("place") / BLOCK)
    inside = F.col("place") - block * BLOCK
    # Blocks at most ``reach`` places away, which are several where blocks are small.
    homes = F.sequence(F.floor((F.col("place") - reach) / BLOCK), F.floor((F.col("place") + reach) / BLOCK))
    dealt = ranked.select(F.explode(homes).alias("block"), "place", "pass", "label", "dims", "bits", "id", "unit")

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", kind="stable")
        home = int(pdf["block"].iloc[0])
        found, misses = [], []
        for _, part in pdf.groupby("dims", sort=False):
            x = np.array(part["unit"].tolist())
            group = (part["pass"].astype(str) + "|" + part["label"].astype(str)).to_numpy()
            ids, places = part["id"].to_numpy(), part["place"].to_numpy()
            for gap in range(1, min(reach, len(x) - 1) + 1):
                near = (group[gap:] == group[:-gap]) & (places[gap:] - places[:-gap] <= reach)
                near &= cosines(x[gap:], x[:-gap]) >= least
                found.append(np.stack([ids[gap:][near], ids[:-gap][near]], axis=1))
            if len(x) > reach:
                bits = part["bits"].to_numpy()
                same = (group[reach:] == group[:-reach]) & (places[reach:] - places[:-reach] == reach)
                unlike = bits[reach:] ^ bits[:-reach]
                common = np.where(same, [BITS - int(u).bit_length() for u in unlike], -1)
                shared = np.full(len(x), -1)
                shared[:-reach] = common
                shared[reach:] = np.maximum(shared[reach:], common)
                own = (places // BLOCK == home) & (shared >= 0)
                met = np.where(shared[own] == BITS, 0.0, agree ** (shared[own] + 1.0))
                misses.append(pd.DataFrame({"a": ids[own], "miss": np.log1p(-np.minimum(met, 1 - 1e-12))}))
        pairs = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        links = pd.DataFrame({"a": pairs.max(axis=1), "b": pairs.min(axis=1)} if len(pairs) else {"a": [], "b": []})
        return pd.concat([links, *misses]).reindex(columns=["a", "b", "miss"]).astype({"a": "int64", "b": "Int64", "miss": "float64"})

    return dealt.where("block >= 0").groupBy("block").applyInPandas(compare, "a long, b long, miss double")


def _dealt_pairs(rows: DataFrame, group: list[str]) -> DataFrame:
    """Rows dealt into hashed blocks of their group, copied to a task (shelf, i, j) for every two blocks.

    Groups of one block, nearly all, meet once, several of them in a task.
    """
    sizes = rows.groupBy(*group).agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    numbered = rows.join(sizes, group).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    low = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("block")).alias("i"), F.greatest(k, F.col("block")).alias("j")))
    dealt = numbered.withColumn("p", F.explode(low))
    shelf = F.when(F.col("blocks") > 1, F.xxhash64(*group)).otherwise(F.pmod(F.xxhash64(*group), F.lit(512)) - 512)
    return dealt.select(shelf.alias("shelf"), "p.i", "p.j", "block", *rows.columns)


def _near(some: np.ndarray, y: np.ndarray, least: float) -> np.ndarray:
    """Which rows link; products that close to the bound are done over in the order used everywhere."""
    rough = some @ y.T
    near = rough >= least
    for r, c in zip(*np.nonzero(np.abs(rough - least) < 1e-9)):
        near[r, c] = cosines(some[r : r + 1], y[c : c + 1])[0] >= least
    return near


def _dense_links(dense: DataFrame, least: float) -> DataFrame:
    """Links (a, b) between the roots of all linked vectors of ``dense`` (id, root, label, dims, unit).

    Every two vectors of a label and length are compared. A link inside a component is
    left out, and two components that meet in a task give one row.
    """

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros((0, 2), np.int64)]
        for _, part in pdf.groupby(["label", "dims"], sort=False):
            left, right = part[part["block"] == part["i"]], part[part["block"] == part["j"]]
            if not len(left) or not len(right):
                continue
            x, y = np.array(left["unit"].tolist()), np.array(right["unit"].tolist())
            roots_x, roots_y = left["root"].to_numpy(), right["root"].to_numpy()
            for at in range(0, len(x), 256):
                some = roots_x[at : at + 256]
                r, c = np.nonzero(_near(x[at : at + 256], y, least) & (some[:, None] != roots_y[None, :]))
                if len(r):
                    pairs = np.stack([some[r], roots_y[c]], axis=1)
                    found.append(np.unique(np.sort(pairs, axis=1), axis=0))
        pairs = np.unique(np.concatenate(found), axis=0)
        return pd.DataFrame({"a": pairs[:, 1], "b": pairs[:, 0]})

    return _dealt_pairs(dense, ["label", "dims"]).groupBy("shelf", "i", "j").applyInPandas(compare, "a long, b long")


def _component_counts(members: DataFrame, least: float) -> DataFrame:
    """(id, links): links of each class within its component, weighted by copies.

    Members of a component are dealt into blocks, and every two blocks meet in one
    task, which adds up counts and returns one row for each member: no pair leaves it.
    Components of one block, nearly all, meet once.
    """
    dealt = _dealt_pairs(members, ["root"])

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, part in pdf.groupby("root", sort=False):
            i, j = int(part["i"].iloc[0]), int(part["j"].iloc[0])
            left = part[part["block"] == i]
            right = part[part["block"] == j]
            if not len(left) or not len(right):
                continue
            x, y = np.array(left["unit"].tolist()), np.array(right["unit"].tolist())
            nx, ny = left["copies"].to_numpy(), right["copies"].to_numpy()
            links_x, links_y = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
            for at in range(0, len(x), 256):
                some = x[at : at + 256]
                near = _near(some, y, least)
                if i == j:
                    near[np.arange(len(some)), at + np.arange(len(some))] = False
                links_x[at : at + 256] = near @ ny
                links_y += nx[at : at + 256] @ near
            out.append(pd.DataFrame({"id": left["id"], "links": links_x}))
            if i != j:
                out.append(pd.DataFrame({"id": right["id"], "links": links_y}))
        return pd.concat(out or [pd.DataFrame({"id": [], "links": []})]).astype("int64")

    return dealt.groupBy("shelf", "i", "j").applyInPandas(count, "id long, links long").groupBy("id").agg(F.sum("links").alias("links"))


def near_vectors(
    vectors: DataFrame,
    key: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    least: float = 0.98,
    passes: int = PASSES,
    reach: int = NEIGHBOURS,
) -> DataFrame:
    """key, n_links, component_id, kept of every row.

    Equal vectors of one label are one class, which links to itself where it has
    copies. Each pass sorts all classes of a label by the concatenated signs of random
    projections and compares each with its next ``reach``; links at or above ``least``
    are kept, and their union over the passes gives the components. Since a window is
    bounded, a dense group has links beyond it: they are counted exactly within
    each component, block by block, so n_links lacks only links between components,
    which no pass found.

    A vector that is null or zero, holds a null or non-finite component, or has a null
    label links with nothing: it is its own component. Repeated rows count as further
    vectors with the same key. Vectors of different length never link. An empty
    table gives no row.
    """
    plain = F.transform(vector, lambda x: x.cast("double") + F.lit(0.0))
    usable = vectors.where(can_link(vector, label)).select(F.col(key).alias("_key"), F.col(label).alias("label"), plain.alias("vec"))
    digest = F.sha2(F.concat_ws(",", F.col("vec").cast("array<string>")), 256)
    keyed = cut(usable.withColumn("digest", digest))
    grouped = keyed.groupBy("label", "digest").agg(
        F.min("_key").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("vec").alias("vec")
    )

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [normalised([v])[0] for v in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:4], pa.array(units, pa.list_(pa.float64())), batch.column(5)],
                names=["label", "digest", "least", "copies", "unit", "id"],
            )

    kind, key_kind = vectors.schema[label].dataType.simpleString(), vectors.schema[key].dataType.simpleString()
    classes = cut(
        grouped.withColumn("id", F.monotonically_increasing_id()).mapInArrow(
            scale, f"label {kind}, digest string, least {key_kind}, copies long, unit array<double>, id long"
        )
    )
    met = cut(_window_links(_ranked(classes, passes), least, reach))
    links = met.where("b IS NOT NULL").select("a", "b").distinct()
    roots = components(links).select(F.col("node").alias("id"), "root")
    missed = met.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.sum("miss").alias("miss"))
    dense = missed.where((F.col("n") == passes) & (F.exp("miss") > 1 - RECALL)).select("id")
    dense = classes.join(dense, "id").join(roots, "id", "left").select(
        "id", F.coalesce("root", "id").alias("root"), "label", F.size("unit").alias("dims"), "unit"
    )
    more = cut(_dense_links(cut(dense), least))
    if not more.isEmpty():
        roots = components(links.union(more)).select(F.col("node").alias("id"), "root")
    rooted = cut(classes.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    inside = rooted.join(roots.select("id"), "id", "left_semi").select("id", "root", "copies", "unit")
    counts = _component_counts(inside, least)
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = (
        rooted.join(names, "root")
        .join(counts, "id", "left")
        .select("label", "digest", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    linked = keyed.select("_key", "label", "digest").join(cut(named), ["label", "digest"]).select(
        F.col("_key").alias(key), "n_links", "component_id"
    )
    alone = vectors.where(~can_link(vector, label)).select(
        key, F.lit(0).cast("long").alias("n_links"), F.col(key).alias("component_id")
    )
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False)))
