import json

import pytest

from arborank import cli

DATA = "/root/testdata/sf0.001"


def test_graphs(spark, tmp_path):
    cli.main(["graph", "--data", DATA, "--graph-type", "g3", "--output", str(tmp_path)], spark)
    assert spark.read.parquet(str(tmp_path / "g3")).columns == ["user_id", "category", "n"]


@pytest.mark.parametrize(("model", "protocol"), [("item_knn", "full"), ("user_knn", "loo"), ("nmf", "full")])
def test_neighbour_models(spark, tmp_path, model, protocol):
    out = str(tmp_path / "m.json")
    found = cli.main(["knn", "--data", DATA, "--model", model, "--similarity", "pearson", "--protocol", protocol, "--factors", "4", "--output", out], spark)
    assert json.loads(found) == json.load(open(out)) and 0 <= json.loads(found)["recall@10"] <= json.loads(found)["recall@50"] <= 1


@pytest.mark.parametrize("model", ["lightgcl", "ma_hgn"])
def test_trained_models(spark, tmp_path, model):
    found = json.loads(cli.main(["train", "--data", DATA, "--model", model, "--gnn-type", "sage", "--hidden-dim", "4", "--n-layers", "1", "--svd-q", "3", "--epochs", "1", "--output", str(tmp_path)], spark))
    assert 0 <= found["ndcg@20"] <= 1 and spark.read.parquet(str(tmp_path / "users")).count() > 0


def test_texts_content_and_queries(spark, tmp_path):
    (tmp_path / "s.toml").write_text("[spark]\n'spark.sql.other.setting' = 3\n")
    cli.main(["texts", "--data", DATA, "--step", "segments", "--output", str(tmp_path / "t"), "--settings", str(tmp_path / "s.toml")], spark)
    assert spark.read.parquet(str(tmp_path / "t")).columns == ["doc_id", "term", "tf"] and spark.conf.get("spark.sql.other.setting") == "3"
    cli.main(["content", "--data", DATA, "--k", "3", "--output", str(tmp_path / "c")], spark)
    assert spark.read.parquet(str(tmp_path / "c")).filter("rk > 3").isEmpty()
    cli.main(["query", "--data", DATA, "--name", "popularity", "--output", str(tmp_path / "q")], spark)
    assert spark.read.parquet(str(tmp_path / "q")).count() > 0
    with pytest.raises(SystemExit):
        cli.main(["query", "--data", DATA, "--name", "none", "--output", "x"], spark)
