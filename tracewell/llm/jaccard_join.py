"""N-gram Jaccard join in metric space: pivots, regions around them, triangle-inequality windows, recursion.

Nearly all documents are at distance 1 from each other, so the join first leaves out what cannot have a partner: a document of which under
the threshold's share of shingles is in any other document. Two of the rest that are linked share one of their rarest shingles and are of about one size, so the
least holder of each of these in each class of sizes is a pivot, and a document is in the region of every pivot that it meets so. Its exact distances to them give links, and
the shells of a region in which two documents can be near: by the triangle inequality their distances to the pivot differ by the reach at
most, so a shell is joined with the documents of the next one as its window. Regions that hold more than a task joins are split by further pivots.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.common import id_or_lowest, id_or_null, written
from tracewell.llm.components import connected_components
from tracewell.llm.hashing import LOWERED, NOT_BLANK, mix, prefix_hashes, shingle_hashes, span_hashes, text_chunks, words

#: UTF-8 bytes of text in a block, and in the corpus for each bucket of shingles.
BLOCK_BYTES, BUCKET_BYTES = 3 << 20, 12 << 20
#: Documents of a region that one task joins, and pivots by which a larger one is split.
REGION, PIVOTS = 2000, 16
#: Bytes of shingle sets that such a region holds at most, unless it is a single document.
REGION_BYTES = 48 << 20
#: Pivots whose distances a task keeps to rule out pairs.
KEPT = 16
#: Documents that are this far from every pivot make a region of their own.
FAR = 0.7
SLACK = 1e-9


def shingle_sets(column: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: of ``size`` words, or of all its words if it has fewer."""
    for lo, hi, data, offsets in text_chunks(column):
        data = LOWERED[data]
        starts, ends, first = words(data, offsets, NOT_BLANK)
        hashes = mix(span_hashes(prefix_hashes(data), starts, ends))
        long = shingle_hashes(hashes, size)
        for i in range(hi - lo):
            a, b = int(first[i]), int(first[i + 1])
            if b - a >= size:
                yield np.unique(long[a : b - size + 1])
            else:
                yield shingle_hashes(hashes[a:b], b - a) if b > a else np.zeros(0, np.uint64)


def bucket_keys(shingles: np.ndarray, buckets: int) -> np.ndarray:
    """A shingle's bucket and, below it, 32 bits of it: enough to see that it is in no other document."""
    return (shingles >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | shingles & np.uint64(0xFFFFFFFF)


def column_of(table: pa.Table, name: str) -> pa.Array:
    column = table.column(name).combine_chunks()
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks)


def block_counts(size: int, buckets: int):
    """A block's documents to rows (bucket, block, keys, counts): the distinct shingles of the block by bucket."""

    def run(table: pa.Table) -> pa.Table:
        block = table.column("_b")[0].as_py()
        sets = list(shingle_sets(column_of(table, "_t"), size))
        keys, counts = np.unique(bucket_keys(np.concatenate(sets), buckets), return_counts=True)
        held, first = np.unique(keys >> np.uint64(32), return_index=True)
        parts = np.split(keys.astype(np.uint32), first[1:])
        sums = np.split(np.minimum(counts, 255).astype(np.uint8), first[1:])
        return pa.table(
            {
                "bucket": pa.array(held.astype(np.int32)),
                "block": pa.array(np.full(len(held), block, np.int32)),
                "keys": pa.array([x.tobytes() for x in parts][: len(held)], pa.binary()),
                "counts": pa.array([x.tobytes() for x in sums][: len(held)], pa.binary()),
            }
        )

    return run


def repeated_shingles(table: pa.Table) -> pa.Table:
    """A bucket's rows of all blocks to rows (_b, bucket, keys, classes): each block's shingles that are in two documents
    or more anywhere, with the logarithm of their number."""
    keys = [np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("keys")]
    counts = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in table.column("counts")]).astype(np.int64)
    flat = np.concatenate(keys)
    order = np.argsort(flat, kind="stable")
    new = np.append(True, flat[order][1:] != flat[order][:-1])
    totals = np.add.reduceat(counts[order], np.flatnonzero(new)) if len(flat) else counts
    documents = np.zeros(len(flat), np.int64)
    documents[order] = totals[np.cumsum(new) - 1]
    classes = np.log2(np.maximum(documents, 1)).astype(np.uint8)
    ends = np.cumsum([len(x) for x in keys])
    kept = [(c >= 1) for c in np.split(classes, ends[:-1])]
    return pa.table(
        {
            "_b": table.column("block"),
            "bucket": table.column("bucket"),
            "keys": pa.array([k[m].tobytes() for k, m in zip(keys, kept, strict=True)], pa.binary()),
            "classes": pa.array([c[m].tobytes() for c, m in zip(np.split(classes, ends[:-1]), kept, strict=True)], pa.binary()),
        }
    )


def judged_sets(size: int, buckets: int, percent: int):
    """A block's documents and its repeated shingles to rows (_d, n, h1, h2, shingles, prefix).

    A document that could have a partner keeps its shingles and its prefix: of its shingles from the rarest, as many as
    must hold one that a partner has too, without those that no other document has. The others keep n only.
    """

    def run(docs: pa.Table, found: pa.Table) -> pa.Table:
        rows = sorted(zip(found.column("bucket").to_pylist(), found.column("keys"), found.column("classes"), strict=True), key=lambda x: x[0])
        known = np.concatenate([np.frombuffer(k.as_buffer(), np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, k, _ in rows] or [np.zeros(0, np.uint64)])
        classes = np.concatenate([np.frombuffer(c.as_buffer(), np.uint8) for _, _, c in rows] or [np.zeros(0, np.uint8)])
        out: dict[str, list] = {x: [] for x in ("n", "h1", "h2", "shingles", "prefix")}
        for own in shingle_sets(column_of(docs, "_t"), size) if docs.num_rows else ():
            n = len(own)
            rarity = np.zeros(n, np.uint8)
            if n and len(known):
                keys = bucket_keys(own, buckets)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                rarity = np.where(known[at] == keys, classes[at], 0)
            shared = int((rarity > 0).sum())
            out["n"].append(n)
            if not n or 100 * shared < percent * n:
                for x in ("h1", "h2", "shingles", "prefix"):
                    out[x].append(None)
                continue
            long = n - -(-percent * n // 100) + 1
            order = np.lexsort((own, rarity))[:long]
            out["h1"].append(int(mix(own).sum().view(np.int64)))
            out["h2"].append(int(np.bitwise_xor.reduce(mix(own + np.uint64(n))).view(np.int64)))
            out["shingles"].append(own.tobytes())
            out["prefix"].append(own[order[rarity[order] > 0]].view(np.int64))
        kinds = {"n": pa.int64(), "h1": pa.int64(), "h2": pa.int64(), "shingles": pa.binary(), "prefix": pa.list_(pa.int64())}
        return pa.table({"_d": column_of(docs, "_d"), **{x: pa.array(v, kinds[x]) for x, v in out.items()}})

    return run


class Sets:
    """Documents as ranges of one array of numbered shingles."""

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.sizes = np.array([len(x) for x in sets], np.int64)
        _, self.flat = np.unique(np.concatenate(sets), return_inverse=True)
        self.first = np.cumsum(self.sizes) - self.sizes
        self.mark = np.zeros(int(self.flat.max(initial=0)) + 1, np.int32)

    def common(self, pivot: int, others: np.ndarray) -> np.ndarray:
        """Sizes of the intersections of the pivot with each of the others."""
        own = self.flat[self.first[pivot] : self.first[pivot] + self.sizes[pivot]]
        self.mark[own] = 1
        sizes = self.sizes[others]
        at = np.repeat(self.first[others] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        out = np.add.reduceat(self.mark[self.flat[at]], np.cumsum(sizes) - sizes)
        self.mark[own] = 0
        return out

    def distances(self, pivot: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intersections and Jaccard distances."""
        both = self.common(pivot, others)
        return both, 1 - both / (self.sizes[others] + self.sizes[pivot] - both)


class Linked:
    """Union-find over a region's documents, which remembers the links that joined two classes."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)
        self.links: list[tuple[int, int]] = []

    def roots(self, of: np.ndarray) -> np.ndarray:
        out = self.parent[of]
        while not np.array_equal(out, up := self.parent[out]):
            out = up
        self.parent[of] = out
        return out

    def join(self, a: int, others: np.ndarray) -> None:
        for b in others.tolist():
            x, y = (int(self.roots(np.array([i]))[0]) for i in (a, b))
            if x != y:
                self.parent[max(x, y)] = min(x, y)
                self.links.append((a, b))


def windows_of(near: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray]:
    """For distances (documents x pivots) the home region of each document, -1 for far from all, and a table of the
    regions that it belongs to (its home, or a window around another), the far region last.

    If two documents are within ``reach``, their distances to a pivot differ by that much at most. So one at home with pivot i
    meets the other there if that one is within 2 reach of its own least distance at i, and no further from i than FAR + reach; and a far one
    meets all whose least distance is over FAR - reach.
    """
    least = near.min(axis=1)
    home = np.where(least < FAR, near.argmin(axis=1), -1)
    member = (near <= least[:, None] + 2 * reach + SLACK) & (near <= FAR + reach + SLACK)
    rows = np.flatnonzero(home >= 0)
    member[rows, home[rows]] = True
    far = least >= FAR - reach - SLACK
    return home, np.column_stack([member, far])


def join_region(sets: Sets, linked: Linked, at: np.ndarray, percent: int) -> None:
    """Link the documents of a region, exactly: every link between two classes is found, no matter which.

    Pivots split it into Voronoi regions with windows, as long as these are smaller together. What is left is joined with each document as a pivot: it is
    held against those alone that no earlier pivot's distances rule out.
    """
    reach = 1 - percent / 100
    while len(at) > 2 * KEPT:
        rng = np.random.default_rng(len(at))
        pivots = rng.choice(at, min(8, len(at) // 8), replace=False)
        near = np.empty((len(at), len(pivots)))
        for k, p in enumerate(pivots):
            both, near[:, k] = sets.distances(int(p), at)
            linked.join(int(p), at[(100 * both >= percent * (sets.sizes[at] + sets.sizes[p] - both)) & (at != p)])
        if len(np.unique(linked.roots(at))) == 1:
            return
        _, member = windows_of(near, reach)
        if member.sum(axis=0).max() > 0.8 * len(at) or member.sum() > 2 * len(at):
            break
        for k in range(member.shape[1]):
            part = at[member[:, k]]
            if len(part) > 1:
                join_region(sets, linked, part, percent)
        return
    # by size, so that a document's partners of at least its size are a range: the empty set as a pivot
    at = at[np.argsort(sets.sizes[at], kind="stable")]
    ends = np.searchsorted(sets.sizes[at] * percent, sets.sizes[at] * 100, "right")
    near = np.zeros((0, len(at)))
    for i, p in enumerate(at.tolist()):
        others = np.arange(i + 1, ends[i])
        others = others[(np.abs(near[:, others] - near[:, [i]]) <= reach + SLACK).all(axis=0)] if len(others) else others
        others = others[linked.roots(at[others]) != linked.roots(np.array([p]))[0]] if len(others) else others
        if not len(others):
            continue
        if len(near) < KEPT:  # a pivot for all that follow
            both, distance = sets.distances(p, at)
            near, both = np.vstack([near, distance]), both[others]
        else:
            both = sets.common(p, at[others])
        linked.join(p, at[others[100 * both >= percent * (sets.sizes[at[others]] + sets.sizes[p] - both)]])


def pivot_distances(percent: int):
    """A slice of a pivot's documents and the pivot's sets (one, unless rows of one id differ) to rows (p, h, _d, distance, linked), h the set's hash."""

    def run(docs: pa.Table, pivot: pa.Table) -> pa.Table:
        n, held = docs.num_rows, [np.frombuffer(x.as_buffer(), np.uint64) for x in pivot.column("_shingles")] if pivot.num_rows else []
        if not n or not held:
            return pa.table({"p": pa.array([], pa.int64()), "h": pa.array([], pa.int64()), "_d": pa.array([], pa.int64()), "distance": pa.array([], pa.float64()), "linked": pa.array([], pa.bool_())})
        sets = Sets([np.frombuffer(x.as_buffer(), np.uint64) for x in docs.column("shingles")] + held)
        at, out = np.arange(n), []
        for k, own in enumerate(held, n):
            both, distance = sets.distances(k, at)
            linked = 100 * both >= percent * (sets.sizes[at] + sets.sizes[k] - both)
            name = pa.array(np.full(n, int(mix(own).sum().view(np.int64))))
            out.append(pa.table({"p": column_of(docs, "p"), "h": name, "_d": column_of(docs, "_d"), "distance": pa.array(distance), "linked": pa.array(linked)}))
        return pa.concat_tables(out)

    return run


def shells(measured: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Rows (p, h, _d, distance, linked): rows (region, _d) of the shells around pivots in which unconnected documents can be within reach of each other.

    Two documents in reach differ by it at most in their distance to the pivot. A shell is one reach wide, and documents of the next shell are its window.
    Documents linked with the pivot are connected by it, so they matter only where an unlinked one is within reach.
    """
    reach = 1 - percent / 100
    least = measured.filter("not linked").groupBy("p", "h").agg(F.min("distance").alias("_least"))
    held = measured.join(written(least, "least"), ["p", "h"]).filter(F.col("distance") >= F.col("_least") - reach - SLACK)
    ring = F.floor(F.col("distance") / F.lit(reach + SLACK)).cast("int")
    placed = held.select("_d", F.explode(F.array(F.xxhash64("p", "h", ring), F.xxhash64("p", "h", ring - 1))).alias("region"))
    placed = written(placed.distinct().join(roots, "_d", "left").select("region", "_d", F.coalesce("root", "_d").alias("_r")), "shells")
    state = placed.groupBy("region").agg(F.min("_r").alias("_a"), F.max("_r").alias("_z")).filter("_a < _z").select("region")
    return placed.join(written(state, "open-shells"), "region").select("region", "_d")


def region_links(percent: int):
    """A region's rows (region, _d, shingles) to rows (a, b): links that connect what its links connect."""

    def run(table: pa.Table) -> pa.Table:
        ids = column_of(table, "_d").to_numpy()
        sets = Sets([np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")])
        linked = Linked(len(ids))
        join_region(sets, linked, np.arange(len(ids)), percent)
        a = np.array([x for x, _ in linked.links], np.int64)
        b = np.array([x for _, x in linked.links], np.int64)
        return pa.table({"a": pa.array(ids[a]), "b": pa.array(ids[b])})

    return run


def split_slice(percent: int):
    """A slice of a large region and the region's pivots to rows (region, part, _d, a): the smaller regions of each document;
    a is a pivot that it links with, or null."""

    def run(docs: pa.Table, pivots: pa.Table) -> pa.Table:
        ids, chosen = column_of(docs, "_d").to_numpy(), column_of(pivots, "_pivot").to_numpy()
        raw = [np.frombuffer(x.as_buffer(), np.uint64) for x in docs.column("shingles")]
        sets = Sets(raw + [np.frombuffer(x.as_buffer(), np.uint64) for x in pivots.column("_shingles")])
        at = np.arange(len(ids))
        near = np.ones((len(ids), max(1, len(chosen))))  # without a pivot all are far
        named = chosen if len(chosen) else np.array([-2])
        link = np.full(len(ids), -1)
        for k in range(len(chosen)):
            both, near[:, k] = sets.distances(len(ids) + k, at)
            close = (100 * both >= percent * (sets.sizes[at] + sets.sizes[len(ids) + k] - both)) & (ids != chosen[k])
            link[close] = k
        _, member = windows_of(near, 1 - percent / 100)
        rows, regions = np.nonzero(member)
        first = np.append(True, rows[1:] != rows[:-1]) if len(rows) else np.zeros(0, bool)
        own = docs.column("region")[0].as_py() if len(ids) else 0
        names = mix(np.append(named, -1).astype(np.int64).view(np.uint64) + mix(np.array([own], np.int64).view(np.uint64))).view(np.int64)
        linked = first & (link[rows] >= 0)
        return pa.table(
            {
                "region": pa.array(np.full(len(rows), own)),
                "part": pa.array(names[regions]),
                "_d": pa.array(ids[rows]),
                "a": pa.array(np.where(linked, named[np.maximum(link[rows], 0)], 0), mask=~linked),
            }
        )

    return run


def sized(members: DataFrame) -> DataFrame:
    """Documents (_n) and bytes (_bytes) of each region."""
    return members.groupBy("region").agg(F.count(F.lit(1)).alias("_n"), F.sum(8 * F.col("n")).alias("_bytes"))


def join_regions(members: DataFrame, percent: int, most: int = REGION, most_bytes: int = REGION_BYTES) -> DataFrame:
    """Links (a, b) within regions, rows (region, _d, n, shingles; written), that connect all that their links connect.

    A region of up to ``most`` documents and ``most_bytes`` of sets is joined by one task. A larger one is first split by size, since linked sets are nearly equally large,
    with windows; then by pivots, a hashed choice of about PIVOTS of its documents, in slices: documents go to their Voronoi region and to every region whose window they are in.
    A region that its links to pivots connect is done; smaller ones are split again. One that neither sizes nor pivots split into parts that are
    smaller together is joined slice by slice against each other, in tasks of bounded size, so nothing is left out.
    """
    links, now, level = [], members, 0
    grain = F.log(F.lit(100 / percent))
    while True:
        large = written(sized(now).filter((F.col("_n") > most) | ((F.col("_bytes") > most_bytes) & (F.col("_n") > 1))), "large")
        if large.isEmpty():
            links.append(now.groupBy("region").applyInArrow(region_links(percent), "a long, b long"))
            break
        links.append(now.join(large.select("region"), "region", "left_anti").groupBy("region").applyInArrow(region_links(percent), "a long, b long"))
        big = now.join(large, "region")
        if level == 0:
            bin_ = F.floor(F.log(F.col("n").cast("double")) / grain + 1e-9).cast("int")
            parted = big.withColumn("_bin", F.explode(F.array(bin_, bin_ - 1)))
            now, level = written(parted.select(F.xxhash64("region", "_bin").alias("region"), "_d", "n", "shingles"), "sizes"), 1
            continue
        slices = F.greatest(F.ceil(F.col("_n") / F.lit(most // 2)), F.ceil(F.col("_bytes") / F.lit(most_bytes // 2))).cast("int")
        big = big.withColumn("_s", F.pmod(F.xxhash64("_d", F.lit(level)), slices).cast("int"))
        chosen = F.pmod(F.xxhash64("_d", F.lit(level + 100)), F.greatest(F.lit(1), F.col("_n") / F.lit(PIVOTS)).cast("long")) == 0
        every = F.explode(F.sequence(F.lit(0), slices - 1))
        pivots = big.filter(chosen).select(F.col("region").alias("_region"), every.alias("_slice"), F.col("_d").alias("_pivot"), F.col("shingles").alias("_shingles"))
        dealt = big.groupBy("region", "_s").cogroup(pivots.groupBy("_region", "_slice"))
        split = written(dealt.applyInArrow(split_slice(percent), "region long, part long, _d long, a long"), "regions")
        close = split.filter("a is not null").select("a", F.col("_d").alias("b"))
        links.append(close)
        roots = connected_components(close).select(F.col("id").alias("_d"), "root")
        root = F.coalesce("root", "_d")
        state = split.join(roots, "_d", "left").groupBy("region", "part").agg(F.count(F.lit(1)).alias("_k"), F.min(root).alias("_a"), F.max(root).alias("_z"))
        state = state.groupBy("region").agg(F.sum("_k").alias("_rows"), F.max("_k").alias("_most"), F.min("_a").alias("_a"), F.max("_z").alias("_z"))
        state = written(state.join(large, "region").filter("_a < _z"), "split")
        # windows that hold nearly all would only copy the region
        smaller = (F.col("_rows") <= 2 * F.col("_n")) & (F.col("_most") <= 0.8 * F.col("_n"))
        parted, whole = state.filter(smaller).select("region"), state.filter(~smaller).select("region")
        pairs = big.join(whole, "region").withColumn("_o", F.explode(F.sequence(F.lit(0), slices - 1)))
        pairs = pairs.withColumn("_i", F.least("_s", "_o")).withColumn("_j", F.greatest("_s", "_o"))
        links.append(pairs.groupBy("region", "_i", "_j").applyInArrow(region_links(percent), "a long, b long"))
        taken = split.join(parted, "region").select("region", "part", "_d").join(big.select("region", "_d", "n", "shingles"), ["region", "_d"])
        now, level = written(taken.select(F.col("part").alias("region"), "_d", "n", "shingles"), "parts"), level + 1
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def meetings(reps: DataFrame, percent: int) -> DataFrame:
    """Documents (_d, n, prefix) to rows (p, _d, n): the pivots that each is measured against.

    Linked documents share a shingle of their prefixes, and the smaller has ``percent`` of the larger one's size at least, so their size classes, each reaching that far, are equal or neighbours. The holders of a shingle in a class, with those of
    the next one as window, have their least one as pivot. So a document meets pivots of about its own size alone: one that quotes thousands of short ones is not sent to them.
    """
    class_ = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / percent)) + SLACK).cast("int")
    tokens = reps.select("_d", "n", F.explode(F.array(class_, class_ - 1)).alias("c"), "prefix").select("_d", "n", "c", F.explode("prefix").alias("s"))
    holders = written(tokens.groupBy("s", "c").agg(F.min("_d").alias("p"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("s", "c", "p"), "pivots")
    return tokens.join(holders, ["s", "c"]).filter("_d != p").groupBy("p", "_d").agg(F.max("n").alias("n"))


def jaccard_components(docs: DataFrame, size: int = 5, percent: int = 80, most: int = REGION) -> DataFrame:
    """Connect documents whose sets of ``size``-word shingles have a Jaccard similarity of ``percent`` or more.

    In: doc_id, text (others are ignored). Out: a row per input row with doc_id, n_shingles and component_id, the
    smallest doc_id that links reach, itself included.

    Words are lower-cased (A-Z) runs between blanks. A text of fewer words is one shingle, of none an empty set, linked
    with nothing; null is like empty. Rows of one doc_id are one vertex. A null doc_id is a vertex smaller than all others, and a
    component that holds it has component_id null. An empty table gives an empty table. Sets are of 64-bit shingle hashes.

    Equal sets are one vertex from the start. Texts are shuffled into blocks, twice; a block's distinct shingles are
    counted over all blocks as packed 32-bit keys in buckets, which grow in number with the corpus. Only documents whose shingles
    are shared enough send their sets on, once for each of their pivots. A region gives fewer links than it has documents: those that connect what its links connect.
    """
    base = docs.select(id_or_lowest("doc_id").alias("_d"), F.coalesce("text", F.lit("")).alias("_t"))
    total = base.agg(F.sum(F.octet_length("_t"))).first()[0] or 0
    least = docs.sparkSession.sparkContext.defaultParallelism
    blocks, buckets = int(total) // BLOCK_BYTES + least, int(total) // BUCKET_BYTES + least
    base = base.withColumn("_b", F.pmod(F.xxhash64("_d", F.xxhash64("_t")), F.lit(blocks)).cast("int"))
    counts = base.groupBy("_b").applyInArrow(block_counts(size, buckets), "bucket int, block int, keys binary, counts binary")
    found = counts.groupBy("bucket").applyInArrow(repeated_shingles, "_b int, bucket int, keys binary, classes binary")
    judged = base.groupBy("_b").cogroup(found.groupBy("_b")).applyInArrow(
        judged_sets(size, buckets, percent), "_d long, n long, h1 long, h2 long, shingles binary, prefix array<long>"
    )
    sets = written(judged, "sets")
    classes = written(sets.filter("h1 is not null").groupBy("h1", "h2", "n").agg(F.min("_d").alias("rep"), F.count(F.lit(1)).alias("copies")), "classes")
    reps = sets.filter("h1 is not null").select("_d", "h1", "h2", "n", "prefix").join(classes.select("h1", "h2", "n", F.col("rep").alias("_d")), ["h1", "h2", "n", "_d"])
    met = written(meetings(reps, percent), "met")
    # rows of one id with different sets
    twice = written(sets.groupBy("_d").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("_d"), "twice")
    held = sets.filter("h1 is not null").select("_d", "n", "shingles")
    if not twice.isEmpty():
        again = held.join(twice, "_d", "left_semi").groupBy("_d", "n", F.sha2("shingles", 256)).agg(F.first("shingles").alias("shingles")).select("_d", "n", "shingles")
        held = held.join(twice, "_d", "left_anti").unionByName(again)
    degrees = written(met.groupBy("p").agg(F.greatest(F.ceil(F.count(F.lit(1)) / F.lit(most)), F.ceil(F.sum(8 * F.col("n")) / F.lit(REGION_BYTES))).cast("int").alias("_n")), "degrees")
    slices = F.col("_n")
    mine = met.drop("n").join(degrees, "p").withColumn("_s", F.pmod(F.xxhash64("_d"), slices).cast("int")).join(held, "_d").select("p", "_s", "_d", "shingles")
    own = degrees.join(held, degrees.p == held._d).select(F.col("p").alias("_p"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("_slice"), F.col("shingles").alias("_shingles"))
    measured = mine.groupBy("p", "_s").cogroup(own.groupBy("_p", "_slice")).applyInArrow(pivot_distances(percent), "p long, h long, _d long, distance double, linked boolean")
    measured = written(measured, "distances")
    close = measured.filter("linked").select(F.col("p").alias("a"), F.col("_d").alias("b"))
    near = written(connected_components(close).select(F.col("id").alias("_d"), "root"), "near")
    regions = written(shells(measured, near, percent).join(held, "_d").select("region", "_d", "n", "shingles"), "members")
    links = join_regions(regions, percent, most).unionByName(near.filter("_d != root").select(F.col("_d").alias("a"), F.col("root").alias("b")))
    same_id = sets.filter("h1 is not null").select("_d", "h1", "h2", "n").join(twice, "_d").join(classes, ["h1", "h2", "n"]).select(F.col("rep").alias("a"), F.col("_d").alias("b"))
    roots = connected_components(links.unionByName(same_id)).select(F.col("id").alias("rep"), "root")
    classes = classes.join(roots, "rep", "left").select("h1", "h2", "n", F.coalesce("root", "rep").alias("root"))
    known = sets.filter("h1 is not null").select("_d", "h1", "h2", "n").join(classes, ["h1", "h2", "n"]).select("_d", "n", "root")
    rest = sets.filter("h1 is null").select("_d", "n")
    rest = rest.join(known.join(twice, "_d").groupBy("_d").agg(F.min("root").alias("root")), "_d", "left").select("_d", "n", F.coalesce("root", "_d").alias("root"))
    return known.unionByName(rest).select(id_or_null("_d").alias("doc_id"), F.col("n").alias("n_shingles"), id_or_null("root").alias("component_id"))
