"""The pipeline's language stage against op6's own verdict."""

import random

from docquarry.llm import langid_hd


def test_stage_rejects_exactly_what_is_und(spark):
    r = random.Random(3)
    words = {"aa": "the of and this with", "bb": "der die und nicht mit", "cc": "les des est dans pour"}
    made = [(i, " ".join(r.choice(words[k].split()) for _ in range(30)), k) for i, k in enumerate(r.choice(sorted(words)) for _ in range(300))]
    odd = ["A.", "A.\nAll rights reserved.", "x", "Q", "Zz", *("".join(chr(r.randrange(a, a + 24)) for _ in range(40)) for a in (0x3B1, 0x430) for _ in range(40)), None, "", "12 ?!", " \n"]
    df = spark.createDataFrame(made + [(1000 + i, t, None) for i, t in enumerate(odd)], "doc_id long, text string, lang string")
    learned = langid_hd.prototypes(df)
    named = {x["doc_id"] for x in langid_hd.predict(df, learned).collect() if x["lang_pred"] != "und"}
    assert named == {x[0] for x in made} | {1000 + i for i, t in enumerate(odd) if any(c.isalpha() for c in t or "")}
    assert {x["doc_id"] for x in langid_hd.keep_identified(df, learned).collect()} == named
    assert langid_hd.keep_identified(df, {}).count() == 0
