"""Distrust with several linkers of one blocked host and on a cycle, against plain iteration."""

import random

import pytest

from docquarry.llm import url_links
from docquarry.llm.queries import ORACLE_SQL, QUERIES

RULES = (("bad.net/es/", "block"), ("ring.net/es/", "block"))


def test_linkers_and_a_cycle(spark):
    to = lambda *hosts: " ".join(f'<a href="https://{h}/">' for h in hosts)
    rows = [("https://bad.net/es/1", ""), *((f"https://fan{i}.org/p", to("bad.net")) for i in range(4)), ("https://mixed.org/", to("bad.net", "a.org", "b.org", "c.org"))]
    # 5 of 36 pages are blocked; 0.85 to the power of 20 decides
    rows += [(f"https://ring.net/{'es' if i < 5 else 'en'}/{i}", to("back.org") if i < 9 else "") for i in range(36)] + [("https://back.org/p", to("ring.net"))]
    pages = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["host"]: r for r in url_links.judge(pages, RULES).collect() if r["rule"] is None}
    own = {"bad.net": 1.0, "ring.net": 5 / 36}
    out = {**{f"fan{i}.org": ["bad.net"] for i in range(4)}, "mixed.org": ["bad.net", "a.org", "b.org", "c.org"], "ring.net": ["back.org"], "back.org": ["ring.net"]}
    want = {}
    for _ in range(400):
        want = {h: own.get(h, 0.0) + 0.85 * sum(want.get(x, 0.0) for x in out.get(h, [])) / max(1, len(out.get(h, []))) for h in {*own, *out}}
    for h, r in got.items():
        assert r["distrust"] == pytest.approx(want[h], abs=1e-7) and r["verdict"] == ("block" if want[h] >= 0.5 else "allow")
    assert {h for h, r in got.items() if r["verdict"] == "block"} == {"fan0.org", "fan1.org", "fan2.org", "fan3.org", "ring.net"}


def test_query_equals_its_sql_on_a_linked_web(spark, tmp_path):
    """3000 pages of 300 hosts with planted links: fans of blocked hosts, fans of those, trusted ones, rings, a host that a third of all pages link to."""
    duckdb, r = pytest.importorskip("duckdb"), random.Random(9)
    bad = [f"shop{i}.net" for i in range(12)]
    fans, second = [f"fan{i}.org" for i in range(60)], [f"far{i}.org" for i in range(40)]
    good, ring = [f"site{i}.com" for i in range(50)], [f"ring{i}.org" for i in range(20)]
    rest = [f"host{i}.org" for i in range(118)]
    pages = []
    for i in range(3000):
        host = r.choice([*bad, *fans, *second, *good, *ring, *rest])
        to = {r.choice(bad) if host in fans else r.choice(fans) if host in second else ring[(ring.index(host) + 1) % 20] if host in ring else r.choice(rest + good)}
        if r.random() < 0.2:
            to.add(r.choice([*bad, *rest, *good]))
        if i % 3 == 0 and host in rest:
            to.add("hub.org")
        path = f"/{r.choice(['es', 'fr'])}/{i}" if host in bad else f"/{r.choice(['es', 'en'])}/{i}"
        pages.append((i, r.choice(["http", "https"]) + "://" + r.choice([host, host.upper()]) + path, " ".join(f'<a href="{r.choice(["https:", ""])}//{x}/p">' for x in sorted(to))))
    pages += [(3000, None, None), (3001, "no host", "<a href='//shop1.net/'>"), pages[5]]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(5).write.parquet(f"{tmp_path}/pages.parquet")
    got = [tuple(x) for x in QUERIES["op2_url_links"](spark, str(tmp_path)).collect()]
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted(map(str, got)) == sorted(map(str, duck.sql(ORACLE_SQL["op2_url_links"]).fetchall()))
    by_method = {h: v for _, h, _, rule, v in got if rule is None and h}
    assert sum(v == "block" for h, v in by_method.items() if h in fans) > 30 and sum(v == "block" for h, v in by_method.items() if h in second) > 5
    assert not any(v == "block" for h, v in by_method.items() if h in ring or h == "hub.org")
