import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from arborank.llm import common, line_dedup, simhash, substring

from . import brute
from .rows import LINE, documents, documents_df, ordered, prose


def lines_of(df):
    return ordered(tuple(r) for r in df.select("doc_id", "n_lines", "n_dropped", F.sha2("kept", 256)).collect())


def test_line_dedup(spark):
    assert lines_of(line_dedup.dedup_lines(documents_df(spark))) == ordered(brute.line_dedup(documents()))


def test_line_dedup_of_nothing(spark):
    assert lines_of(line_dedup.dedup_lines(documents_df(spark, []))) == []


def test_line_dedup_is_reversible(spark):
    rows = documents()
    more = [(100 + k, f"{LINE}\nline of a later batch, number one\n{prose(5, k)}") for k in range(4)]
    index = line_dedup.LineIndex.build(documents_df(spark, rows))
    grown = index.insert(documents_df(spark, more))
    assert lines_of(grown.decide(documents_df(spark, rows + more))) == ordered(brute.line_dedup(rows + more))
    back = grown.delete(spark.createDataFrame([(d,) for d, _ in more], "doc_id long"))
    assert ordered(tuple(r) for r in back.refs.select("key", "n_docs", "last_doc").collect()) == ordered(tuple(r) for r in index.refs.select("key", "n_docs", "last_doc").collect())
    assert lines_of(back.decide(documents_df(spark, rows))) == ordered(brute.line_dedup(rows))


def test_filters_that_get_full_are_built_anew(spark, monkeypatch):
    """A filter with room for 16 keys gets 22; the others are left as they are, and the index decides as one built from all documents."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 4)
    by_shard = {0: [], 1: [], 2: []}
    for k in range(200):
        line = f"shared line with the number {k}"
        by_shard[int.from_bytes(xxhash.xxh3_128_digest(line)[8:12]) % 3].append(line)
    rows = [(d, "\n".join(x for own in by_shard.values() for x in own[:4])) for d in range(3)]
    index = line_dedup.LineIndex.build(documents_df(spark, rows))
    was = {r.shard: r.n_buckets for r in index.filters.collect()}
    assert was == {0: 4, 1: 4, 2: 4}
    more = [(100 + d, "\n".join(by_shard[0][4:22])) for d in range(3)]
    grown = index.insert(documents_df(spark, more))
    assert {r.shard: r.n_buckets for r in grown.filters.collect()} == {0: 16, 1: 4, 2: 4}
    assert lines_of(grown.decide(documents_df(spark, rows + more))) == ordered(brute.line_dedup(rows + more))


def test_shards_are_probed_where_their_rows_are(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(k, 3 if k % 2 else k % 40) for k in range(2000)], "doc long, shard int")
    shards = spark.createDataFrame([(k, k % 7) for k in range(0, 60) if k % 5], "shard int, rest int")
    got = common.probed(rows, shards, F.xxhash64("doc"), lambda held, batch: np.array([d % 7 == held[0] for d in batch.column(0).to_pylist()]))
    assert sorted(r.doc for r in got.collect()) == [k for k in range(2000) for s in [3 if k % 2 else k % 40] if s % 5 and k % 7 == s % 7]


def test_line_dedup_keeps_all_columns(spark):
    docs = documents_df(spark)
    index = line_dedup.LineIndex.build(docs)
    out = index.applied(docs)
    assert out.columns == docs.columns
    assert ordered((r.doc_id, brute.sha(r.text or "")) for r in out.collect()) == ordered((d, s) for d, _, _, s in brute.line_dedup(documents()))


def test_cuckoo_filter():
    keys = np.frombuffer(b"".join(xxhash.xxh3_128_digest(str(k)) for k in range(5000)), "<u8").reshape(-1, 2)
    held = line_dedup.CuckooFilter.of(keys[:2000])
    assert held.has(keys[:2000]).all()
    assert held.has(keys[2000:]).mean() < 0.01
    for k in keys[:1000]:
        assert held.remove(k)
    assert held.has(keys[1000:2000]).all()
    assert held.has(keys[:1000]).mean() < 0.01


def test_simhash(spark):
    found = simhash.near_duplicates(documents_df(spark)).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id")
    assert ordered(tuple(r) for r in found.collect()) == ordered(brute.simhash(documents()))
    assert simhash.near_duplicates(documents_df(spark, [])).collect() == []


@pytest.mark.parametrize(("words", "radius"), [(1, 2), (1, 6), (4, 30)])
def test_gray_index_finds_all_links(words, radius):
    r = np.random.default_rng(radius)
    centre = r.integers(0, 2**63, (40, words), dtype=np.uint64)
    codes = np.repeat(centre, 30, axis=0)
    for _ in range(radius):
        flip = r.random(len(codes)) < 0.4
        codes[flip, r.integers(0, words)] ^= np.uint64(1) << r.integers(0, 64, flip.sum(), dtype=np.uint64)
    codes = np.unique(codes, axis=0)
    codes = codes[simhash.gray_order(codes)]
    apart = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(apart <= radius, 1)), strict=True)}
    pairs = {(int(a), int(b)) for i, j in simhash.linked_pairs(codes, radius) for a, b in zip(i, j, strict=True)}
    assert pairs == want
    i, j = simhash.forest(codes, radius)
    assert all(apart[a, b] <= radius for a, b in zip(i, j, strict=True))
    assert brute_parts(len(codes), zip(i.tolist(), j.tolist(), strict=True)) == brute_parts(len(codes), want)


def brute_parts(n, pairs):
    root = brute.components(range(n), pairs)
    parts = {}
    for k, r in root.items():
        parts.setdefault(r, set()).add(k)
    return {frozenset(x) for x in parts.values()}


def test_hot_groups_are_dealt_again(spark, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_GROUP", 8)
    r = random.Random(5)
    centre = r.getrandbits(64)
    codes = sorted({centre ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for _ in range(150)})
    fps = spark.createDataFrame([(c - 2**64 if c >> 63 else c,) for c in codes], "fp long")
    edges = [(a.src % 2**64, a.dst % 2**64) for a in simhash.edges_of(fps, 2).collect()]
    want = [(a, b) for k, a in enumerate(codes) for b in codes[:k] if (a ^ b).bit_count() <= 2]
    assert brute.components(codes, edges).keys() == set(codes)
    index = {c: k for k, c in enumerate(codes)}
    assert brute_parts(len(codes), [(index[a], index[b]) for a, b in edges]) == brute_parts(len(codes), [(index[a], index[b]) for a, b in want])


def test_one_of_each(spark):
    docs = documents_df(spark)
    out = simhash.one_of_each(docs)
    assert out.columns == docs.columns
    kept = [r.doc_id for r in out.collect()]
    # 1, 2, 3 and the null rows are near copies, as are 17 (in capitals), the empty ones and the two rows of 14
    assert sorted(k for k in kept if k is not None) == [1, 4, 5, 6, 9, 10, 11, 11, 12, 13, 14, 15, 16]
    assert simhash.one_of_each(documents_df(spark, [])).collect() == []


def test_texts_with_one_dominant_shingle_are_no_copies(spark):
    """A shingle that makes up over half of two texts doesn't make them alike, however often it is repeated; copies are still one."""
    r = random.Random(8)
    other = [" ".join(f"v{r.randrange(10**6)}" for _ in range(150)) for _ in range(3)]
    rows = [(1, "la " * 400 + other[0]), (2, "la " * 400 + other[1]), (3, prose(200, 3)), (4, "LA\n" * 400 + other[0]), (5, "la " * 900 + other[2]), (6, "la " * 900 + other[2] + " end")]
    assert sorted(x.doc_id for x in simhash.one_of_each(documents_df(spark, rows)).collect()) == first_of_alike([(k, t.lower()) for k, t in rows]) == [1, 2, 3, 5]


def test_rows_of_one_id_keep_their_own_texts(spark):
    rows = [(1, prose(100, 1)), (1, prose(100, 2)), (2, prose(100, 2)), (3, prose(100, 1) + " more"), (None, prose(100, 9)), (None, prose(100, 9)), (4, None), (None, "")]
    kept = sorted((r.doc_id or 0, r.text or "") for r in simhash.one_of_each(documents_df(spark, rows)).collect())
    assert kept == sorted([(1, prose(100, 1)), (1, prose(100, 2)), (0, prose(100, 9)), (4, "")])


def test_samples_grow_with_the_fingerprints():
    for n in (0, 10, 10**5, 10**9, 10**11):
        bits, tables = simhash.samples_for(n)
        assert n / 2**bits <= 1024 and 1 - (1 - simhash.EQUAL_BITS**bits) ** tables >= 0.92


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.createDataFrame([(k, 7 if k % 3 else k) for k in range(300)] + [(None, None), (301, None)], "doc_id long, node long")
    lookup = spark.createDataFrame([(k, f"v{k}") for k in range(0, 300, 6)] + [(7, "hot"), (1000, "no")], "node long, v string")
    for how in ("inner", "left"):
        got = common.spread_join(rows, lookup, ["node"], F.xxhash64("doc_id"), how)
        assert ordered(map(tuple, got.select("node", "doc_id", "v").collect())) == ordered(map(tuple, rows.join(lookup, "node", how).select("node", "doc_id", "v").collect()))


def template_family(size, pairs, words=600, changed=10):
    """Texts of about 0.72 of common shingles, and as many of them with a near copy as `pairs`."""
    r = random.Random(3)
    base = [f"b{k}" for k in range(words)]

    def edited(text, n, mark):
        at = set(r.sample(range(len(text)), n))
        return [f"{mark}x{k}" if k in at else w for k, w in enumerate(text)]

    texts = [edited(base, changed, f"m{k}") for k in range(size)]
    texts += [edited(texts[k], 2, f"c{k}") for k in range(pairs)]
    return [(k, " ".join(t)) for k, t in enumerate(texts)]


def first_of_alike(rows, least=0.8, n=5):
    """The smallest id of each component, by exact comparison of all texts."""
    sets = {k: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} for k, w in ((k, t.split()) for k, t in rows)}
    pairs = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    root = brute.components(list(sets), pairs)
    return sorted({min(k for k in root if root[k] == r) for r in root.values()})


def test_near_copies_beside_refuted_links(spark, monkeypatch):
    """In a group of texts that are nearly, but not quite, similar enough, links to a leader fail; the near copies among them are found all the same."""
    monkeypatch.setattr(simhash, "sampled_groups", lambda prints, words, tables, bits: prints.withColumn("group", F.lit(1).cast("long")))
    rows = template_family(120, 12)
    want = first_of_alike(rows)
    assert 100 < len(want) <= 120
    assert sorted(r.doc_id for r in simhash.one_of_each(documents_df(spark, rows)).collect()) == want


def test_pairs_of_large_samples_still_meet(spark, monkeypatch):
    """Whatever shares a sample shares a group, also where the sample's group is too large for one task."""
    r = np.random.default_rng(1)
    codes = np.repeat(r.integers(0, 2**63, (2, 4), dtype=np.uint64), 60, axis=0)
    bits = np.unpackbits(codes.view(np.uint8), axis=1) ^ (r.random((len(codes), 256)) < 0.08)
    codes = np.packbits(bits, axis=1).view(np.int64)
    prints = spark.createDataFrame([(k, *map(int, c)) for k, c in enumerate(codes)], "node long, f0 long, f1 long, f2 long, f3 long")

    def met(size):
        for name in ("HOT_GROUP", "WIDE_GROUP"):
            monkeypatch.setattr(simhash, name, size, raising=False)
        groups = simhash.sampled_groups(prints, 4, 8).groupBy("group").agg(F.sort_array(F.collect_list("node")).alias("nodes")).collect()
        return {(a, b) for g in groups for k, b in enumerate(g.nodes) for a in g.nodes[:k]}, max(len(g.nodes) for g in groups)

    (want, largest), (got, parts) = met(1000), met(8)
    assert want and got == want
    assert parts < largest


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "src long, dst long")
    found = {r.node: r.root for r in simhash.components(edges).collect()}
    assert found == {**dict.fromkeys(range(1, 61), 0), 101: 100}


@pytest.mark.parametrize("copies", [32 << 20, 0])
def test_substring(spark, copies):
    found = substring.dedup_windows(documents_df(spark), 50, max_copies_bytes=copies)
    got = ordered(tuple(r) for r in found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())
    assert got == ordered(brute.substring(documents()))


def test_substring_with_a_full_sketch(spark):
    """Estimates that are far too high lose nothing."""
    rows = [(k, prose(200, k % 7) + " " + prose(100, 50 + k)) for k in range(30)]
    found = substring.dedup_windows(documents_df(spark, rows), 20, max_sketch_bytes=1)
    got = ordered(tuple(r) for r in found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect())
    assert got == ordered(brute.substring(rows, 20))
    assert substring.dedup_windows(documents_df(spark, [])).collect() == []


def test_estimates_are_never_too_low():
    words = [b" ".join(b"w%d" % (k * j % 50) for j in range(120)) for k in range(1, 20)]
    start, text, least, _, first = substring.windows_of(words, substring.WordHashes(), 50)
    seen = {}
    for s, t, m in zip(start, text, least, strict=True):
        w = tuple(words[t].split()[s - first[t] : s - first[t] + 50])
        assert seen.setdefault(w, m) == m


def test_columns_with_names_of_the_operators_keep_their_values(spark):
    rows = [(1, f"{LINE}\nown one", 7, "a"), (2, f"{LINE}\nown two", 8, "b"), (3, f"{LINE}\nown three", 9, None), (4, prose(80, 1), 5, "c"), (5, prose(80, 1), 6, "d")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __doc long, __Drop string")
    index = line_dedup.LineIndex.build(df, min_docs=3, min_chars=20)
    found = index.applied(df, index.postings)
    assert found.columns == df.columns and sorted((r.doc_id, r["__doc"], r["__Drop"]) for r in found.collect()) == [(d, x, y) for d, _, x, y in rows]
    more = df.withColumnRenamed("__Drop", "__own").withColumn("__node", df["__doc"])
    kept = simhash.one_of_each(more)
    assert kept.columns == more.columns and sorted((r.doc_id, r["__doc"], r["__own"], r["__node"]) for r in kept.collect()) == [(1, 7, "a", 7), (2, 8, "b", 8), (3, 9, None, 9), (4, 5, "c", 5)]
    again = more.unionByName(more.filter("doc_id = 2"))
    assert sorted(r["__doc"] for r in simhash.one_of_each(again).collect()) == [5, 7, 8, 9]


def test_components_of_a_star_are_dealt(spark, monkeypatch):
    """A hub's edges and a giant component go to several tasks; the roots are the same."""
    from arborank.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 100)
    edges = spark.range(1, 3000).selectExpr("id as src", "case when id % 3 = 0 then 5000 else 4000 end as dst").union(spark.createDataFrame([(7, 9), (9, 5000), (6001, 6002)], "src long, dst long"))
    roots = {r.node: r.root for r in simhash.components(edges).collect()}
    assert len(roots) == 3001 and {r for n, r in roots.items() if n < 6000} == {1} and roots[6002] == 6001  # roots themselves have no row
    prints = spark.createDataFrame([(n, n) for n in [*range(1, 3000), 4000, 5000, 6001, 6002, 8000]], "doc_id long, node long")
    found = {r.doc_id: r.component_id for r in simhash.grouped(prints, edges).collect()}
    assert found == {**{n: 1 for n in [*range(1, 3000), 4000, 5000]}, 6001: 6001, 6002: 6001, 8000: 8000}
