import random
import re
from collections import Counter

import numpy as np
import pytest

from arborank.llm import collocations as col

from .rows import documents, documents_df, ordered, prose


def texts(n=60, seed=3):
    """Phrases that stand alone, within longer ones, beside each other and over ends of pieces, in two languages and none."""
    r = random.Random(seed)
    rows = [(d, t, "en") for d, t in documents()]
    for k in range(n):
        words = [r.choice(["new york city", "New York", "a b a b a", "der Hund", "der  Hund bellt", "x", "É à", "solo,solo", "a a a a", prose(6, 50 + k % 9)]) for _ in range(r.randrange(5, 40))]
        rows.append((100 + k, " ".join(words).replace("x", r.choice(["x", ".", "\n", "\t", "x. "])), r.choice(["en", "de", None, "und"])))
    return rows


def counted(rows, most):
    f = {}
    for _, t, lang in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        own = f.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", low):
            words = [w for w in re.split("[ \t]+", piece) if w]
            own.update(tuple(words[i : i + k]) for k in range(1, most + 1) for i in range(len(words) - k + 1))
    return f


def plain(rows, most=3, least=10, top=2000, inside=50):
    out = []
    for lang, f in counted(rows, most).items():
        n = sum(v for p, v in f.items() if len(p) == 1)
        good = {p: v for p, v in f.items() if len(p) > 1 and v >= least}
        held = {q for p, v in good.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * v >= inside * good[q := p[i : i + k]]}
        best = []
        for p, a in good.items():
            if p not in held:
                score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, k, p.decode(), -a, x, y, n, -s) for k, (s, a, p, x, y) in enumerate(sorted(best)[:top], 1)]
    return out


def docs_df(spark, rows):
    return documents_df(spark, [r[:2] for r in rows]).drop("lang").join(spark.createDataFrame([(k, r[2]) for k, r in enumerate(rows)], "node long, lang string"), "node")


@pytest.mark.parametrize(("most", "least", "words", "top"), [(3, 10, 2_000_000, 2000), (3, 2, 300, 2000), (2, 3, 50, 20), (4, 2, 500, 2000), (5, 2, 2_000_000, 7)])
def test_collocations(spark, most, least, words, top):
    rows = texts()
    found = col.collocations(docs_df(spark, rows).repartition(3), most, least, top, shard_words=words).collect()
    assert ordered(tuple(r) for r in found) == ordered(plain(rows, most, least, top))
    assert len({r.lang for r in found}) == 3


def test_nothing(spark):
    assert col.collocations(docs_df(spark, [])).collect() == []
    assert col.collocations(docs_df(spark, [(1, None, None), (2, "", "en"), (3, ". ,", "de"), (4, "one", None)])).collect() == []
    assert spark.catalog.listTables() == []


def test_phrases_know_their_extensions(spark):
    rows = texts()
    found, sizes = col.phrases(docs_df(spark, rows), 3, 2)
    f = counted(rows, 3)
    seen = {(r.lang, tuple(r.phrase.split(" "))): r for r in found.collect()}
    assert set(seen) == {(g, p) for g, c in f.items() for p, v in c.items() if len(p) > 1 and v >= 2}
    for (g, p), r in seen.items():
        more = [(q, v) for q, v in f[g].items() if len(q) == len(p) + 1 and v >= 2]
        assert r.a == f[g][p] and r.words == len(p)
        assert r.left == max((v for q, v in more if q[1:] == p), default=0) and r.right == max((v for q, v in more if q[:-1] == p), default=0)
    assert {r.lang: r.n for r in sizes.collect()} == {g: n for g, c in f.items() if (n := sum(v for p, v in c.items() if len(p) == 1))}


def test_scores_beyond_64_bits(spark):
    big = 3_000_000_000_000
    df = spark.createDataFrame([(big, [7 * big, big], [5 * big + 1, big]), (10, [10, 10], [10, 10])], "f long, starts array<long>, ends array<long>")
    assert [r.s.score for r in df.select(col.weakest_cut(2).alias("s")).collect()] == [1_000_000 * big * big // (7 * big * (5 * big + 1)), 1_000_000]


@pytest.mark.parametrize("seed", range(6))
def test_both_intervals_stay_in_step(seed):
    """Extending in turn on both sides finds every phrase with its count, and its intervals hold its suffixes and reversed prefixes."""
    r = random.Random(seed)
    ids = np.array([0, *[r.randrange(0, 5) for _ in range(200)], 0])
    counts = np.bincount(ids, minlength=5)[1:]
    shard = col.Shard(*col.Shard.transforms(ids, 5), counts)
    level = shard.single(np.flatnonzero(counts) + 1)
    back = ids[::-1]
    sorted_text, sorted_back = col.sorted_suffixes(ids, 5), col.sorted_suffixes(back, 5)
    for wanted in (np.array([False, True, True, True, True]), np.array([False, True, False, True, True])):
        now = level
        for d in range(2, 6):
            now = shard.extended(now, col.side_of(d), wanted)
            own = [tuple(int(x) for x in w) for w in now.words]
            want = Counter(p for i in range(len(ids) - d + 1) if wanted[list(p := tuple(int(x) for x in ids[i : i + d]))].sum() >= d - 1 and (ids[i : i + d] > 0).all())
            found = dict(zip(own, now.size.tolist(), strict=True))
            assert all(want[p] == n for p, n in found.items()) and set(found) >= {p for p in want if wanted[list(p)].all()}
            for k, p in enumerate(own):
                a, b, n = int(now.low[k]), int(now.back[k]), int(now.size[k])
                assert all(tuple(ids[i : i + d]) == p for i in sorted_text[a : a + n]) and all(tuple(back[i : i + d]) == p[::-1] for i in sorted_back[b : b + n])


def test_suffixes_are_sorted_as_deep_as_asked():
    ids = np.array([0, *[random.Random(9).randrange(1 << 25) % 3 + (1 << 25) for _ in range(500)], 0])
    for depth in (1, 2, 3, 5, 9):
        order = col.sorted_suffixes(ids, depth)
        keys = [tuple(ids[i : i + depth]) for i in order]
        assert keys == sorted(keys)


def test_packed_numbers_come_back():
    x = np.array([0, 1, 255, 256, 70_000, 2**31])
    assert (col.unpacked(col.packed(x), len(x)) == x).all()
