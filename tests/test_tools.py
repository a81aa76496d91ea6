import pytest
from pyspark.sql import functions as F

from trovewise.plans import strategy, tools
from trovewise.sources import runs


def test_from_a_collection_to_a_run(spark, tmp_path):
    (tmp_path / "c.txt").write_text("t1 cats playing with dogs\nt2 a dog sleeps\nt3 nothing here\nt4 birds sing\nt5 fish swim\n")
    (tmp_path / "q.txt").write_text("7:dogs play\n8:sleeping\n")
    path = str(tmp_path / "index")
    tools.main(["index", str(tmp_path / "c.txt"), path, "--check"])
    tools.main(["query", path, str(tmp_path / "q.txt"), str(tmp_path / "run")])
    got = [(r.qid, r.doc, r["rank"]) for r in runs.read(spark, str(tmp_path / "run")).collect()]
    assert sorted(got) == [("7", "t1", 1), ("7", "t2", 2), ("8", "t2", 1)]
    tools.main(["stats", path])
    tools.add_metadata(spark, path, block_size=2)
    assert spark.read.parquet(f"{path}/bm25/blocks").agg(F.sum("n")).first()[0] == spark.read.parquet(f"{path}/postings").count()
    with pytest.raises(ValueError):
        tools.add_metadata(spark, path, block_size=2, penalty=1.0)
    with pytest.raises(ValueError):
        tools.answer(spark, path, spark.range(0).select(F.lit("").alias("query")), algorithm="none")


def test_timing_summary(spark):
    assert len(strategy.timed(lambda: spark.range(3), 2)) == 2
    s = strategy.summary([[1.0, 3.0], [2.0, 2.0]])
    assert s["min"]["mean"] == 1.5 and s["none"]["q50"] == 2.0 and s["max"]["q99"] == 3.0
