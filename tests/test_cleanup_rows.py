"""Pages are cleaned within their rows; ends are trimmed without a pattern."""

from docquarry.functions import exprs as X
from docquarry.operators import cleanup
from pyspark.sql import functions as F


def test_strip_takes_what_the_pattern_takes(spark):
    df = spark.range(1, 0x3100).where("id < 55296").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    df = df.select("id", "c", F.concat("c", F.lit("\t x"), "c", F.lit("y \u3000"), "c").alias("t"))
    want = F.regexp_replace("t", r"(?U)^\s+|\s+$", "")
    assert df.where(F.length("c") != 1).count() == 0
    assert df.where(X.strip(F.col("t")) != want).count() == 0
    assert df.where(X.squeeze(F.col("t")) != F.regexp_replace(F.regexp_replace("t", r"(?U)\s+", " "), "^ | $", "")).count() == 0


def test_no_line_of_a_page_is_shuffled(spark):
    block = lambda text, y0, y1: {"text": text, "y0": y0, "y1": y1}
    rows = []
    for page in range(1, 6):
        body = f"A1.1.1 text of page {page}" if page > 2 else "Contents"
        rows.append(("f", page, f"Running head {page}\n{body}\nRunning HEAD\nD{page}", 800.0, [block(f"Running head {page}", 0.0, 20.0), block(body, 300.0, 400.0)]))
    rows.append(("g", 1, None, 800.0, []))
    df = spark.createDataFrame(rows, "source_filename string, page int, raw_text string, height double, blocks array<struct<text:string,y0:double,y1:double>>")
    cleaned = cleanup.clean_pages(df)
    got = {(r["source_filename"], r["page"]): r for r in cleaned.collect()}
    assert len(got) == 6
    assert got["f", 1]["text"] == "Contents" and got["f", 1]["is_toc"] and not got["f", 3]["is_toc"]
    assert got["f", 3]["removed_lines"] == ["Running head 3", "Running HEAD", "D3"] and got["f", 3]["page_label"] == "D3"
    assert got["g", 1]["text"] == "" and got["g", 1]["removed_lines"] == [] and got["g", 1]["page_label"] is None
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    # one generator for the blocks of the bands, one for their lines; none for the lines of all pages
    assert plan.count("Generate ") == 2, plan
