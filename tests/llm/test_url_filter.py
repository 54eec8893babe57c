"""URL filters against their SQL, on generated hosts with wildcards, deep paths, merges and one hot host."""

import random

import duckdb
import pyarrow as pa
import pytest
from corvane.llm import url_filter
from corvane.llm.queries import op12_url_filters

COLUMNS = ["page_id", "host", "path", "rule", "verdict", "template", "purity"]
SCHEMA = "page_id long, url string, html string, host string, n string"


def in_duck(rows):
    c = duckdb.connect()
    given = pa.table({"page_id": pa.array([r[0] for r in rows], pa.int64()), "url": pa.array([r[1] for r in rows], pa.string())})  # noqa: F841
    c.sql("create table pages as select * from given")
    return c.sql(url_filter.sql()).select(*COLUMNS).fetchall()


def in_spark(spark, rows):
    df = spark.createDataFrame([(*r, "h", "clash", "clash") for r in rows], SCHEMA).repartition(4)
    out = url_filter.judge_urls(df)
    assert out.columns == COLUMNS
    return [tuple(r) for r in out.collect()]


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def generated():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    urls = [None, "", "no scheme", "mailto:x", "http://", "://", "http:///a", "HTTP://A.ORG", "http://a.org", "http://a.org?x=/fr/", "http://a.org#t/", "http://A.Example.ORG/es/x", "http://example.org/es", "http://notexample.org/es/9",
            "http://example.org/en/1", "http://x.example.org/en/19/z", "http://example.org/en/21", "https://com/fr/", "https://b.com/fr/1", "https://b.com/FR/1", "http://É.com/de/ü/日本", "http://a.com//x//", "http://a.com/*/**/q", "http://a.org/" + "deep/" * 300, "http://a.org/" + "9" * 20000, "http://h.com/de/0123456789abcdef0123?y", "a://b://c/d"]
    for _ in range(500):  # one host with many names at two depths
        urls.append(f"http://hot.com/{rng.choice(['de', 'fr', 'en', 'es'])}/{word()}/{rng.choice(['', 'x', 'page-' + str(rng.randint(1, 99))])}")
    for _ in range(300):
        urls.append(f"http://{rng.choice('abc')}.com/{rng.choice(['de', 'fr', 'en', 'it', word()])}/{rng.randint(1, 9)}{rng.choice(['', '/', '.html'])}")
    for _ in range(200):
        urls.append(f"http://{rng.choice(['', 'm.', 'www.'])}example.{rng.choice(['org', 'net'])}/{rng.choice(['es', 'en'])}/{rng.randint(1, 40)}")
    urls += [f"http://d.com/{rng.choice(['de', 'en'])}/{rng.randint(1, 99)}" for _ in range(80)]
    return [(k if k % 50 else None, u) for k, u in enumerate(urls + urls[:40])]


def test_generated_pages_equal_the_sql(spark):
    rows = generated()
    got, want = in_spark(spark, rows), in_duck(rows)
    assert ordered(got) == ordered(want) and len(got) == len(rows)
    templates = {r[5] for r in got}
    assert any("/*" in t for t in templates) and any(t.endswith("/**") for t in templates) and any("{id}" in t for t in templates)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_the_table_equals_the_sql(spark, sf_dir):
    want = duckdb.sql(url_filter.sql().replace("FROM pages", f"FROM '{sf_dir}/pages.parquet'")).select(*COLUMNS).fetchall()
    got = op12_url_filters(spark, sf_dir)
    assert got.dtypes[0] == ("page_id", "bigint") and ordered(map(tuple, got.collect())) == ordered(want)


def test_rules(spark):
    urls = {"http://a.org": None, "http://a.org/": "org/", "http://org/": "org/", "http://xorg/": None, "http://example.org/en/12": "example.org/en/1", "http://m.example.org/es/": "example.org/es/", "http://myexample.org/es/": "org/", "http://EXAMPLE.org/ES/": "org/", "http://a.com/de/1": "com/de/", "http://a.com.net/de/1": None}
    got = {r[0]: r for r in in_spark(spark, list(enumerate(urls)))}
    for k, rule in enumerate(urls.values()):
        assert got[k][3] == rule and (rule is None or got[k][4] == ("block" if rule in ("com/de/", "example.org/es/", "example.org/en/1") else "allow"))


def test_alike_branches_are_judged_together(spark):
    # on one host "shop" goes on as the blocked "de" does, on the other as the allowed "fr" does
    rows = [f"http://{h}.com/{s}/{k}{e}" for h in "xy" for k in range(40) for s, e in (("de", ""), ("fr", ".html"), ("shop", "" if h == "x" else ".html"))]
    got = {r[5]: r for r in in_spark(spark, list(enumerate(rows)))}
    assert got["x.com/shop/{n}"][4] == "block" and got["x.com/shop/{n}"][6] > 0.9
    assert got["y.com/shop/{n}.html"][4] == "allow" and got["y.com/shop/{n}.html"][6] < 0.1


def test_names_become_wildcards_and_common_ones_stay(spark):
    rows = [f"http://x.net/user{'abcdefghijklmnopqrstuvwxyz'[k % 26]}{'xyz'[k % 3]}/home" for k in range(78)] + ["http://x.net/about/home"] * 20
    assert {r[5] for r in in_spark(spark, list(enumerate(rows)))} == {"x.net/*/home", "x.net/about/home"}


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "http://a.net/x")] * 5])
def test_few_rows_and_no_labels(spark, rows):
    got = in_spark(spark, rows)
    assert ordered(got) == ordered(in_duck(rows)) and all(r[4] == "allow" and r[6] == 0.5 for r in got)
