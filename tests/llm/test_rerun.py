"""A task that runs again must send its rows to the same places: Spark keeps what other tasks have read already."""

from lociq.llm import near, substring


def copies(spark):
    body = " ".join(f"w{k}" for k in range(300))
    return spark.createDataFrame([(i, f"{body} only{i}") for i in range(200)], "id long, text string").repartition(2).cache()


def test_near_sends_hot_signatures_to_the_same_bucket(spark):
    docs = copies(spark)
    runs = [near.signature_runs(docs, 3, 90, 100, 1_000_003).where("kind = 1").collect() for _ in range(2)]
    assert len(runs[0]) == 2 and sorted(map(tuple, runs[0])) == sorted(map(tuple, runs[1]))


def test_substring_numbers_its_runs_alike(spark):
    docs = copies(spark)
    runs = [substring.build_runs(docs, 5, 16, 0).collect() for _ in range(2)]
    assert len({r["run"] for r in runs[0]}) == 2 and sorted(map(tuple, runs[0])) == sorted(map(tuple, runs[1]))
