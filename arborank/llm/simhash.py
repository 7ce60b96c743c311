"""SimHash near-dedup over a Gray-order hierarchical index.

Whole texts give 64-bit fingerprints of their word shingles. Fingerprints that differ in few bits are found among the
distinct ones only: `radius + 1` blocks of bits deal them out so that any two within the radius share a whole block, and in
each block value the fingerprints are sorted by Gray rank and gathered into nodes, bottom up. A node factors out the bits
that all of it share (a mask and a pattern); two nodes are compared by the differences their shared bits add up to, and
a pair of whole groups is dropped as soon as that passes the radius, or once all of both is known to be one component. A block value with very many fingerprints is
dealt out again by blocks of its remaining bits. Each group gives only the edges from its connected parts to their
smallest member, and the parts are joined across groups by rounds of star operations over written tables.

For similar texts, rather than nearly equal ones, 64 bits and a radius of two are too narrow: at a similarity of 0.8 of five-word
shingles about 15 % of the bits differ. one_of_each() therefore takes 256 bits of the distinct shingles and a wide radius, deals
fingerprints out by many samples of 16 bits or more, of which similar texts share some, and searches the groups by the same index. There, only
the exact similarity joins texts; texts that are equal but for white space and A-Z are one from the start, by a 64-bit hash.

Defined cases: a null or empty text has fingerprint zero and links like any other; rows that repeat a doc_id are documents of
their own with that id; a null doc_id takes part and never becomes a component's id unless the component has no other.
Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_key, free_names, slices, spread_join, written

#: A block value with more fingerprints than this is dealt out by its remaining bits.
HOT_GROUP = 1024
#: A group of samples with more fingerprints than this is compared in parts.
WIDE_GROUP = 2048
#: Groups up to this size are compared pair by pair.
SMALL = 16
NODE = 8


def fingerprint(text: bytes, n: int = 3, seed: int = 42) -> int:
    """64 bits by XXH64."""
    return int.from_bytes(majority(text, n, lambda x: xxhash.xxh64_digest(x, seed)).tobytes())


def wide_print(text: bytes, n: int) -> np.ndarray:
    """256 bits of the distinct shingles, as four numbers."""
    one = xxhash.xxh3_128_digest
    return majority(text, n, lambda x: one(x) + one(x, 1), 32, distinct=True).view(">u8").astype(np.uint64)


def text_node(text: bytes) -> int:
    """64 bits that are equal for texts of equal words in small letters."""
    return xxhash.xxh3_64_intdigest(b" ".join(text.lower().split())) - 2**63


def majority(text: bytes, n: int, digest: Callable[[bytes], bytes], size: int = 8, distinct: bool = False) -> np.ndarray:
    """The bits set in over half the shingles' hashes, packed. Fewer than n words are one shingle, none give zeros."""
    words = text.lower().split()
    if not words:
        return np.zeros(size, np.uint8)
    joined = b" ".join(words)
    if len(words) <= n:
        hashes = digest(joined)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = [0, *(ends[:-n] + 1).tolist()]
        shingles = [joined[a:b] for a, b in zip(starts, ends[n - 1 :].tolist(), strict=True)]
        hashes = b"".join(map(digest, set(shingles) if distinct else shingles))
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, size), axis=1)
    return np.packbits(2 * bits.sum(axis=0, dtype=np.uint32) > len(bits))


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fp (the 64 bits as a long)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            found = np.array([fingerprint(t, n) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray order, where neighbours differ in one bit."""
    x = x.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(shift)
    return x


def gray_order(codes: np.ndarray) -> np.ndarray:
    """The order of codes (n, words) by Gray rank, first word first."""
    return np.lexsort([gray_rank(codes[:, k]) for k in range(codes.shape[1])][::-1])


def node_levels(codes: np.ndarray, root: np.ndarray) -> list[tuple[np.ndarray, ...]]:
    """Of the nodes of each level, leaves first: mask, pattern, least and largest root. Codes (n, words) are in Gray order.

    Bits outside the mask vary within the node.
    """
    mask, pattern, low, high = np.full(codes.shape, ~np.uint64(0)), codes, root, root
    levels = [(mask, pattern, low, high)]
    while len(mask) > 1:
        at = np.arange(0, len(mask), NODE)
        every, common = np.bitwise_or.reduceat(pattern, at), np.bitwise_and.reduceat(pattern, at)
        mask = np.bitwise_and.reduceat(mask, at) & ~(every ^ common)
        pattern, low, high = common & mask, np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
        levels.append((mask, pattern, low, high))
    return levels


def linked_pairs(codes: np.ndarray, radius: int, root: np.ndarray | None = None, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of codes (in Gray order) that differ in at most `radius` bits, some `most` candidates at a time.

    root: pairs of one root are left out.
    """
    levels = node_levels(codes, np.arange(len(codes)) if root is None else root)
    zero = np.zeros(1, np.int64)
    stack = [(len(levels) - 1, zero, zero)]
    while stack:
        level, i, j = stack.pop()
        if not level:
            yield i, j
            continue
        if len(i) > most // NODE**2:
            half = len(i) // 2
            stack += [(level, i[:half], j[:half]), (level, i[half:], j[half:])]
            continue
        mask, pattern, low, high = levels[level - 1]
        n, child = len(mask), np.arange(NODE)
        a = (i[:, None, None] * NODE + child[:, None]).repeat(NODE, 2).ravel()
        b = (j[:, None, None] * NODE + child[None, :]).repeat(NODE, 1).ravel()
        keep = (a < n) & (b < n) & ((a < b) if level == 1 else (a <= b))
        a, b = a[keep], b[keep]
        near = differing(pattern[a] ^ pattern[b], mask[a] & mask[b]) <= radius
        near &= (np.minimum(low[a], low[b]) != np.maximum(high[a], high[b])) | ((a == b) & (low[a] != high[b]))
        if near.any():
            stack.append((level - 1, a[near], b[near]))


def differing(bits: np.ndarray, mask: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits & mask).sum(axis=1, dtype=np.int32)


def roots_of(parent: np.ndarray) -> np.ndarray:
    while not ((up := parent[parent]) == parent).all():
        parent = up
    return parent


def forest(codes: np.ndarray, radius: int, leaders: int = 4, root: np.ndarray | None = None, turn: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs of the codes (in Gray order) that connect all that the radius connects.

    A few leaders first gather all that is near them, so that a large group of near copies is one component before
    the index is searched for what links the rest. Past that, each pair joins two components. root: the first index of
    each code's component, where some are joined already. Another turn takes other leaders.
    """
    parent, free, found = np.arange(len(codes)) if root is None else root.copy(), np.ones(len(codes), bool), []
    for _ in range(leaders if len(codes) > 4 * NODE else 0):
        lone = np.flatnonzero(free)
        if not len(lone):
            break
        first = lone[len(lone) * (turn % 4) // 4]
        near = np.bitwise_count(codes ^ codes[first]).sum(axis=1, dtype=np.int32) <= radius
        near = near & (parent != parent[first])
        own = np.unique(parent[near], return_index=True)[1]
        found.append((np.full(len(own), first), np.flatnonzero(near)[own]))
        joined = np.isin(parent, parent[near]) | (parent == parent[first])
        parent[joined] = parent[joined].min()
        free &= ~near
        free[first] = False
    for i, j in linked_pairs(codes, radius, parent):
        while len(i):  # hook each root to a smaller one, until both ends of every pair agree
            parent = roots_of(parent)
            a, b = parent[i], parent[j]
            apart = a != b
            i, j, low, high = i[apart], j[apart], np.minimum(a, b)[apart], np.maximum(a, b)[apart]
            hooked, at = np.unique(high, return_index=True)
            parent[hooked] = low[at]
            found.append((i[at], j[at]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2


def blocks_of(bits: int, parts: int) -> list[int]:
    """The mask of each of `parts` blocks of the set bits of `bits`."""
    places = [k for k in range(64) if bits >> k & 1]
    cuts = [round(k * len(places) / parts) for k in range(parts + 1)]
    return [sum(1 << p for p in places[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def dealt(fps: DataFrame, radius: int) -> DataFrame:
    """fp, mask (bits that the group's key fixes), key: once for each block.

    Two fingerprints within the radius share all bits of one block at least, and of one block again among the remaining bits.
    """
    spread = fps.select("fp", F.lit(0).cast("long").alias("mask"), F.lit(0).cast("long").alias("key"))
    done, masks = None, [0]
    for _ in range(6):
        step = F.create_map(*[x for m in masks for x in (F.lit(signed(m)), F.array(*[F.lit(signed(m | b)) for b in blocks_of(~m & (2**64 - 1), radius + 1)]))])
        spread = spread.select("fp", F.explode(step[F.col("mask")]).alias("mask")).withColumn("key", F.col("fp").bitwiseAND(F.col("mask")))
        masks = list(dict.fromkeys(m | b for m in masks for b in blocks_of(~m & (2**64 - 1), radius + 1)))
        spread = written(spread, "simhash-blocks")
        hot = spread.groupBy("mask", "key").count().filter(F.col("count") > HOT_GROUP).select("mask", "key")
        hot = written(hot, "simhash-hot")
        if hot.isEmpty() or not ~masks[0] & (2**64 - 1) or (64 - bin(masks[0]).count("1")) <= 12:
            return spread if done is None else done.unionByName(spread)
        calm = spread.join(hot, ["mask", "key"], "left_anti").select("fp", "mask", "key")
        done = calm if done is None else done.unionByName(calm)
        spread = spread.join(hot, ["mask", "key"], "left_semi").select("fp", "mask", "key").distinct()
    return done.unionByName(spread)


def edges_of(fps: DataFrame, radius: int) -> DataFrame:
    """src, dst of 64-bit fingerprints: within each group enough links to connect what the radius connects."""
    groups = dealt(fps, radius).select(F.xxhash64("mask", "key").alias("group"), F.col("fp").alias("node"), F.col("fp").alias("f0"))
    return searched(groups, radius, 1).select("src", "dst").distinct()


def searched(groups: DataFrame, radius: int, words: int, turn: int = 0, every: bool = False) -> DataFrame:
    """src, dst, group: links within each group of (group, node, f0, ...), enough to connect what the radius connects.

    Nodes of one root, if that column is there, are connected already. With `every`, all links between different roots come
    back. group is null for a group of SMALL nodes or fewer, of which all links always do.
    """
    if "root" not in groups.columns:
        groups = groups.withColumn("root", F.col("node"))

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The groups of a sorted partition, one after another."""
        rest = [np.zeros(0, np.int64)] * (3 + words)
        for batch in parts:
            rows = [np.concatenate([old, new.to_numpy(zero_copy_only=False)]) for old, new in zip(rest, batch.columns, strict=True)]
            cuts = np.flatnonzero(np.diff(rows[0])) + 1
            last = int(cuts[-1]) if len(cuts) else 0
            yield from found([x[:last] for x in rows], cuts)
            rest = [x[last:] for x in rows]
        yield from found(rest, np.array([len(rest[0])]))

    def found(rows: list[np.ndarray], cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
        node, root, codes = rows[1], rows[2], np.stack(rows[3:], axis=1).view(np.uint64)
        starts = np.concatenate([[0], cuts[:-1]]).astype(np.int64)
        size = np.repeat(cuts - starts, cuts - starts) if len(node) else np.zeros(0, np.int64)
        src, dst = [], []
        for shift in range(1, SMALL):  # small groups: all pairs of the partition at once
            i = np.flatnonzero((rows[0][:-shift] == rows[0][shift:]) & (size[shift:] <= SMALL))
            i = i[(root[i] != root[i + shift]) & (np.bitwise_count(codes[i] ^ codes[i + shift]).sum(axis=1, dtype=np.int32) <= radius)]
            src.append(node[i + shift])
            dst.append(node[i])
        yield links(src, dst, pa.nulls(sum(map(len, src)), pa.int64()))
        src, dst, group = [], [], []
        for k in np.flatnonzero(cuts - starts > SMALL):
            own = slice(starts[k], cuts[k])
            order = gray_order(codes[own])
            ids, mine = node[own][order], codes[own][order]
            first, place = np.unique(root[own][order], return_index=True, return_inverse=True)[1:]
            for i, j in linked_pairs(mine, radius, first[place]) if every else [forest(mine, radius, root=first[place], turn=turn)]:
                src.append(ids[j])
                dst.append(ids[i])
                group.append(np.full(len(i), rows[0][own.start]))
                if sum(map(len, src)) > 1 << 16:
                    yield links(src, dst, pa.array(np.concatenate(group)))
                    src, dst, group = [], [], []
        if src:
            yield links(src, dst, pa.array(np.concatenate(group)))

    def links(src: list[np.ndarray], dst: list[np.ndarray], group: pa.Array) -> pa.RecordBatch:
        a, b = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (src, dst))
        return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b)), pa.array(np.minimum(a, b)), group], ["src", "dst", "group"])

    columns = ["group", "node", "root", *(f"f{k}" for k in range(words))]
    rows = groups.select(*columns).repartition("group").sortWithinPartitions("group")
    return rows.mapInArrow(each, "src long, dst long, group long").distinct()


#: Of the bits of two texts with a similarity of 0.8, the share that is equal; and how many of such pairs some sample shall hold.
EQUAL_BITS, FOUND = 0.85, 0.92


def samples_for(n: int) -> tuple[int, int]:
    """(bits a sample, samples) for n fingerprints: enough bits that values which agree by chance alone stay some 1000 a group, 16 at
    least, and as many samples as keep the share of similar pairs that meet at FOUND."""
    bits = max(16, math.ceil(math.log2(max(n, 2))) - 10)
    return bits, math.ceil(math.log(1 - FOUND) / math.log(1 - EQUAL_BITS**bits))


def sampled_groups(prints: DataFrame, words: int, tables: int, bits: int = 16) -> DataFrame:
    """group, node, f0, ...: each fingerprint once for each table, under the values of the table's sample of bits.

    A group above WIDE_GROUP is cut in parts, and any two of them are a group: all its pairs still meet, on many tasks.
    """
    names = [f"f{k}" for k in range(words)]
    picks = np.random.default_rng(0).permuted(np.tile(np.arange(64 * words), (tables, 1)), axis=1)[:, :bits]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            raw = np.stack(columns[1:], axis=1).view(np.uint64)
            on = np.unpackbits(raw.astype(">u8").view(np.uint8).reshape(len(raw), -1), axis=1)
            for k, pick in enumerate(picks):
                value = on[:, pick].astype(np.int64) @ (1 << np.arange(bits, dtype=np.int64))
                group = gray_rank(np.full(len(raw), k << 32, np.uint64)) ^ value.astype(np.uint64)
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(group.view(np.int64)), *(pa.array(c) for c in columns[1:])], ["node", "group", *names])

    now = written(prints.select("node", *names).mapInArrow(deal, f"node long, group long, {', '.join(f'{x} long' for x in names)}"), "simhash-tables")
    hot = now.groupBy("group").count().filter(F.col("count") > WIDE_GROUP)
    hot = written(hot.select("group", F.ceil(2 * F.col("count") / WIDE_GROUP).cast("int").alias("parts")), "simhash-hot")
    if hot.isEmpty():
        return now
    own, other = F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts")).cast("int"), F.col("other")
    # each row once for every part, so a part meets each other, and itself beside them
    cut = now.join(hot, "group").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cut = cut.filter("own <> other").withColumn("group", F.xxhash64("group", F.least("own", other), F.greatest("own", other)))
    return now.join(hot, "group", "left_anti").select("node", "group", *names).unionByName(cut.select("node", "group", *names))


def minima(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(u, m), the least v of each u, and (u, __n), its number of edges."""
    rows = written(edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("__n")), "cc-least")
    return rows.select("u", "m"), rows.select("u", "__n")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node it reaches), for the nodes on edges; alternating large-star and small-star.

    Each round is written, so its lineage is cut; minima are taken before rows are dealt by node, and the edges of a hub are dealt over several tasks.
    """
    edges = written(edges.filter("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct(), "cc-edges")
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, sizes = minima(both)
        large = spread_join(both, least.select("u", F.least("u", "m").alias("m")), ["u"], F.xxhash64("v"), sizes=sizes).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large, "cc-large")
        least, sizes = minima(large)
        small = spread_join(large, least, ["u"], F.xxhash64("v"), sizes=sizes).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        small = written(small, "cc-small")
        # done when every node has one edge and no root has any
        many = small.groupBy("u").count().filter("count > 1").limit(1)
        inner = small.select("v").join(small.select(F.col("u").alias("v")), "v", "left_semi").limit(1)
        edges = small
        if many.isEmpty() and inner.isEmpty():
            return small.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def near_duplicates(docs: DataFrame, n: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach), one row for each row of docs."""
    prints = written(fingerprints(docs, n), "simhash").withColumn("node", F.col("fp"))
    return grouped(prints, edges_of(prints.select("fp").distinct(), radius)).select("doc_id", "fp", "component_id")


def labelled_nodes(each: DataFrame, edges: DataFrame) -> DataFrame:
    """each (node, doc_id, one row a node) with root (a node of its component)."""
    roots = written(components(edges), "simhash-roots").withColumnRenamed("node", "__node")
    return each.join(roots, each["node"] == roots["__node"], "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))


def grouped(prints: DataFrame, edges: DataFrame) -> DataFrame:
    """prints (doc_id, node, further columns) with component_id."""
    each = written(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "simhash-distinct")
    labelled = labelled_nodes(each, edges)
    labelled = written(labelled, "simhash-labelled")
    least = labelled.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("__n"))
    found = spread_join(labelled, least.drop("__n"), ["root"], F.xxhash64("node"), sizes=least.select("root", "__n"))  # a component may be very large
    found = written(found.select("node", "component_id"), "simhash-components")
    return spread_join(prints, found, ["node"], F.xxhash64("doc_id"))


def similar_edges(edges: DataFrame, nodes: DataFrame, rows: DataFrame, n: int, least: float) -> DataFrame:
    """The edges between nodes whose texts share at least that part of their n-word shingles. Only texts on edges are read again.

    nodes: node, doc (doc_key of a row with that text), one row a node.
    """
    on = edges.select(F.col("src").alias("node")).unionByName(edges.select(F.col("dst").alias("node"))).distinct()
    chosen = nodes.join(on, "node", "left_semi").select("node", "doc")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            nodes, sets = [], []
            for node, t in zip(part.column(0).to_pylist(), texts, strict=True):
                words = t.lower().split()
                if text_node(t) == node:  # else another row of the same id
                    nodes.append(node)
                    sets.append(list({xxhash.xxh64_intdigest(b" ".join(words[i : i + n])) - 2**63 for i in range(max(1, len(words) - n + 1))}))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["node", "own"])

    texts = rows.withColumn("doc", doc_key()).join(chosen, "doc").select("node", "text")
    sets = written(texts.mapInArrow(each, "node long, own array<long>").dropDuplicates(["node"]), "shingles")
    a, b = (sets.select(F.col("node").alias(k), F.col("own").alias(f"own_{k}")) for k in ("src", "dst"))
    shared = F.size(F.array_intersect("own_src", "own_dst"))
    alike = shared >= least * (F.size("own_src") + F.size("own_dst") - shared)
    return edges.join(a, "src").join(b, "dst").filter(alike).select("src", "dst").distinct()


def alike_edges(groups: DataFrame, radius: int, words: int, alike: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """src, dst: links that `alike` (a filter of src, dst) confirms, enough to connect all that such links within the groups connect.

    A group is done once all links that connect it are confirmed. In the others what is confirmed so far is one component each and
    other leaders look for links between those; the last turn gives every link between different components to `alike`, so that
    none is left out because a link near it was refuted.
    """
    good = bad = None
    for turn in range(3):
        found = written(searched(groups, radius, words, turn, every=turn == 2), "simhash-edges")
        fresh = found.select("src", "dst").distinct()
        if bad is not None:
            fresh = fresh.join(bad, ["src", "dst"], "left_anti")
        fresh = written(fresh, "simhash-candidates") if bad is not None else fresh
        more = written(alike(fresh), "simhash-alike")
        good = more if good is None else good.unionByName(more)
        if turn == 2:
            return good
        none = fresh.join(more, ["src", "dst"], "left_anti")
        bad = written(none if bad is None else bad.unionByName(none), "simhash-refuted")
        wanting = found.filter("group is not null").join(bad, ["src", "dst"], "left_semi").select("group").distinct()
        wanting = written(wanting, "simhash-open")
        if wanting.isEmpty():
            return good
        roots = written(components(good), "simhash-roots").withColumnRenamed("root", "__root")
        now = groups.drop("root").join(wanting, "group", "left_semi").join(roots, "node", "left")
        groups = written(now.withColumn("root", F.coalesce("__root", "node")).drop("__root"), "simhash-open-groups")
    raise AssertionError


def one_of_each(docs: DataFrame, n: int = 5, least: float = 0.8, radius: int = 46) -> DataFrame:
    """docs, with all their columns, with one row of each component: one with the smallest doc_id (any one if rows repeat that).

    Texts link if they share `least` or more of their n-word shingles. Candidates are those whose 256-bit fingerprints differ in
    at most `radius` bits (a similarity of 0.8 gives 39 on average, and 46 or less nine times in ten) and that agree in one of many
    samples of bits; see samples_for().
    """
    words = 4
    names = [f"f{k}" for k in range(words)]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            codes = np.array([wide_print(t, n) for t in texts]).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([text_node(t) for t in texts], pa.int64()), *(pa.array(codes[:, k]) for k in range(words))], ["doc_id", "node", *names])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    prints = written(rows.mapInArrow(each, f"doc_id long, node long, {', '.join(f'{x} long' for x in names)}"), "simhash")
    # one row a text from here on, so copies, however many, are one
    nodes = written(prints.groupBy("node").agg(F.min("doc_id").alias("doc_id"), *[F.min(x).alias(x) for x in names]), "simhash-nodes").withColumn("doc", doc_key())
    bits, tables = samples_for(nodes.count())
    groups = sampled_groups(nodes.select("node", *names), words, tables, bits)
    edges = alike_edges(groups, radius, words, lambda some: similar_edges(some, nodes, rows, n, least))
    first = F.min_by(F.struct("doc", "node"), F.struct(F.col("doc_id").isNull(), "doc", "node"))
    chosen = labelled_nodes(nodes.select("node", "doc_id"), edges).withColumn("doc", doc_key()).groupBy("root").agg(first.alias("x"))
    doc, own, node = free_names(docs, "__doc", "__own", "__node")
    chosen = written(chosen.select(F.col("x.doc").alias(doc), F.col("x.node").alias(own)), "simhash-chosen")
    keyed, columns = docs.withColumn(doc, doc_key()), [F.col(f"`{c}`") for c in docs.columns]
    if prints.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return keyed.join(chosen, doc, "left_semi").select(*columns)

    # some id is repeated: of its rows the text tells which one is meant
    @F.arrow_udf("long")
    def node_of(text: pa.Array) -> pa.Array:
        return pa.array([text_node((t or "").encode()) for t in text.to_pylist()], pa.int64())

    kept = keyed.withColumn(node, node_of(F.col("text").cast("string"))).join(chosen, doc).filter(F.col(node) == F.col(own))
    return kept.dropDuplicates([doc, own]).select(*columns)
