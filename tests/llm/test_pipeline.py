import zlib

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from arborank.llm import toxicity

from . import brute
from .rows import LINE, ordered, prose


def test_pipeline_against_plain_python(spark, tmp_path):
    bad = [(k, f"{prose(60, k)}. You zorgle{k % 5} thing. {prose(40, k + 700)}", "en", "s", 0) for k in range(60)]
    fine = [(100 + k, f"{prose(60, k + 200)}\n{LINE if k % 9 == 0 else 'own line ' + str(k)}\n{prose(60, k + 400)}", "en", "s", 0) for k in range(90)]
    item = prose(40, 5000)
    copies = [(300 + k, fine[k][1], "en", "s", 0) for k in range(5)]
    leaks = [(400 + k, f"{prose(50, k + 800)} {item} {prose(20, k + 900)}", "en", "s", 0) for k in range(3)]
    rows = [*bad, *fine, *copies, *leaks, (500, None, None, None, None)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 100), 1) for r in rows[:150]], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    found = corpus_pipeline.run(spark, d).collect()

    docs = spark.read.parquet(f"{d}/documents.parquet")
    labels = spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic").filter(~toxicity.held_out())
    model = toxicity.train(docs, labels)
    words = toxicity.WordScores(model.weights)
    left = [(r[0], r[1]) for r in rows if toxicity.noisy_or(r[1] or "", model.bias, words)[0] < 0.7]
    assert {k for k, _ in left} == {r[0] for r in rows if r[0] >= 100}
    held = {}
    for k, t in left:
        for line in (t or "").split("\n"):
            held.setdefault(brute.low(line.strip(brute.BLANKS)), set()).add(k)
    left = [(k, "\n".join(x for x in (t or "").split("\n") if len(q := brute.low(x.strip(brute.BLANKS))) < 20 or len(held[q]) < 3 or max(held[q]) == k)) for k, t in left]

    def grams(t):
        w = brute.low(t).split()
        return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    sets = {k: grams(t) for k, t in left}
    near = [(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = brute.components(sets, near)
    least = {}
    for k, r in root.items():
        least[r] = min(k, least.get(r, k))
    left = [(k, t) for k, t in left if least[root[k]] == k]
    leaked = {k for k, _ in brute.contaminated(left, [(1, item)])}
    assert leaked == {400, 401, 402}
    left = [(k, t) for k, t in left if k not in leaked]
    want = brute.pieces(left, Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")))
    assert ordered(tuple(r)[:5] for r in found) == ordered(want)
    assert all(0 <= r.ids_crc32 < 2**32 for r in found) and zlib.crc32(b"") == 0


def test_stages_keep_the_columns(spark, tmp_path):
    from .rows import documents_df

    d = str(tmp_path)
    docs = documents_df(spark)
    spark.createDataFrame([(1, 0, 1)], "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, "nothing of the kind is in there")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        assert out.count() > 0
