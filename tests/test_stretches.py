"""Documents of any size over many tasks: running totals in two levels, parsing by stretches."""

import random
import re

import pytest
from docquarry.operators import chunking, parsing
from docquarry.operators.prefix import running_total

LINES = ["ARTICLE A1:", "ARTICLE B2: TITLE", "A1.1", "A1.2.3", "Governance: x", "17", "Scope", "The rule holds.", "a;", "Other Scope"]


def test_running_totals(spark):
    r = random.Random(1)
    rows = [("hot", i, r.randrange(5)) for i in range(3000)] + [(f"k{i % 40}", i, r.randrange(9)) for i in range(600)] + [(None, 1, 4)]
    r.shuffle(rows)
    want, sums = {}, {}
    for k, i, v in sorted(rows, key=lambda x: (str(x[0]), x[1])):
        want[k, i], sums[k] = sums.get(k, 0), sums.get(k, 0) + v
    df = spark.createDataFrame(rows, "k string, i int, v int").where("k is not null")
    got = running_total(df, "k", ("i",), "v", "before")
    assert {(x["k"], x["i"]): x["before"] for x in got.collect()} == {k: v for k, v in want.items() if k[0] is not None}
    assert got.columns == ["k", "i", "v", "before"] and running_total(df.limit(0), "k", ("i",), "v", "before").count() == 0


def pages(spark, seed):
    r = random.Random(seed)
    docs = {"hot": 400, "one": 1, "two": 2, "none": 0} | {f"d{i}": r.randrange(1, 30) for i in range(12)}
    rows = [(name, "A", p + 1, "\n".join(r.choice(LINES) for _ in range(r.randrange(5))), False) for name, n in docs.items() for p in range(n)]
    r.shuffle(rows)
    return spark.createDataFrame(rows, "source_filename string, section string, page int, text string, is_toc boolean"), rows


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 100000])
def test_articles_do_not_depend_on_the_stretches(spark, stretch):
    df, rows = pages(spark, 4)
    stream = parsing.line_stream(df)
    lines = {}
    for name, _, page, text, _ in sorted(rows, key=lambda x: (x[0], x[2])):
        lines.setdefault(name, []).extend((line, page) for line in text.split("\n") if line)
    got = {}
    for x in stream.orderBy("source_filename", "seq").collect():
        got.setdefault(x["source_filename"], []).append((x["line"], x["page"]))
        assert x["seq"] == len(got[x["source_filename"]])
    assert got == {k: v for k, v in lines.items() if v}
    from test_operators import articles_by_grammar

    found = parsing.parse_articles(stream, stretch).orderBy("source_filename", "article_seq").collect()
    for name, own in lines.items():
        assert [(x["article_number"], x["heading"], x["text"]) for x in found if x["source_filename"] == name] == articles_by_grammar([line for line, _ in own])


def test_no_window_over_the_lines_of_a_document(spark):
    """Windows by document alone see a row per stretch or partition; those over lines and words are bounded by them."""
    df, _ = pages(spark, 2)
    for found in (parsing.parse_articles(parsing.line_stream(df)), chunking.chunk_fixed_window(df.selectExpr("source_filename", "section", "page as article_seq", "'A1' as article_number", "'A' as parent_article", "'h' as heading", "text", "page"))):
        plan = found._jdf.queryExecution().sparkPlan().toString()
        for window in re.findall(r"Window \[[^\n]*", plan):
            assert "_stretch" in window or "_part" in window, window
