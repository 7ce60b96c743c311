import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborank.llm import infilling, queries

from . import brute
from .rows import documents, documents_df, ordered, prose

MORE = [(101, "a <P> b"), (102, "x<S>y"), (103, "<M>"), (104, "<<S><"), (105, "<" * 50 + " <S <P <M"), *[(200 + k, f"  <{prose(k % 37 + 1, k)}\n\té\U0001f600 S> M>" + " " * (k % 3)) for k in range(300)]]


def plain(rows):
    """Units by the pattern, cuts by joining them."""
    out = []
    for d, t in rows:
        t = t or ""
        units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", t)
        g = hashlib.sha256(f"42:{'' if d is None else d}".encode()).hexdigest()
        h = [int(g[8 * k : 8 * k + 8], 16) for k in range(4)]
        if not t or "<P>" in t or "<S>" in t or "<M>" in t or h[2] % 100 >= 50:
            out.append((d, len(units), "plain", None, None, brute.sha(t), brute.sha(t)))
            continue
        a, b = sorted(x % (len(units) + 1) for x in h[:2])
        p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        spm = h[3] % 100 < 80
        made = f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"
        out.append((d, len(units), "spm" if spm else "psm", len(p), len(m), brute.sha(made), brute.sha(t)))
    return out


def test_infilling(spark, tmp_path):
    rows = [*documents(), *MORE]
    documents_df(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = [tuple(r) for r in queries.op13_infilling(spark, str(tmp_path)).collect()]
    assert ordered(found) == ordered(plain(rows))
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_infilling_of_nothing(spark):
    assert infilling.fill_in_middle(documents_df(spark, [])).collect() == []


def test_every_text_can_be_changed_and_comes_back(spark):
    rows = [*documents(), *MORE]
    for spm in (0, 100):
        made = infilling.fill_in_middle(documents_df(spark, rows), percent=100, spm_percent=spm).withColumn("back", infilling.restored(F.col("output"), F.col("form")))
        found = made.select("doc_id", "back", "form").collect()
        assert ordered((r.doc_id, r.back) for r in found) == ordered((d, t or "") for d, t in rows)
        assert {r.form for r in found} == {"plain", "spm" if spm else "psm"}


@pytest.mark.parametrize("n", [0, 1, 2, 3, 17, 1000, 20_000])
def test_skip_list_reaches_every_rank(n):
    widths = np.array([random.Random(n + k).randrange(1, 30) for k in range(n)], np.int64)
    lanes, sums = infilling.SkipList.of(widths), np.concatenate([[0], np.cumsum(widths)])
    for rank in range(n + 1) if n < 2000 else random.Random(1).sample(range(n + 1), 500):
        assert lanes.reach(rank) == sums[rank]
    assert all(u.sum() <= n and len(p) == len(u) for u, p in zip(lanes.units, lanes.points, strict=True))
    assert len(lanes.units) <= 1 + 2 * max(1, np.log2(n + 1))


def test_bytes_beyond_utf8_stay():
    for k in range(40):
        _, form, _, _, out = infilling.infilled(k, b"a \xff\xfe b \xc3 c", 100, 50)
        assert form in ("psm", "spm") and sorted(out) == sorted(b"a \xff\xfe b \xc3 c" + b"<P><S><M>")
