"""How often whole texts are shuffled where marks have very many different strings."""

import random

from docquarry.llm import suffix_bcr


def written(spark) -> int:
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_cutting_further_shuffles_no_text(spark, monkeypatch):
    monkeypatch.setattr(suffix_bcr, "SPREAD", 8)
    r = random.Random(3)
    unlike = lambda n: "".join(map(chr, r.choices(range(97, 123), k=n)))
    passage = unlike(300)
    texts = [unlike(20000) + passage + unlike(20000) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = written(spark)
        assert min(x["n_removed"] for x in suffix_bcr.repeats_digest(df).collect()) >= 300  # neighbours may be alike
        # for the strings' bytes and for the result: 2.69 (3.70 before, once more to cut further)
        assert written(spark) - before < 3.2 * sum(map(len, texts))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
