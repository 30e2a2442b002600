"""Operators that SQL can express, against DuckDB on awkward rows."""

import random

import pytest
from fixtures import as_pandas, awkward, duck, frame, plain, same_as_sql

from tideline.llm import mixing, quality_rules, url_filters

URLS = [
    "http://a.b.example.com/en/7x?q#f", "https://EXAMPLE.com/en/8", "ftp://com/en/", "x://org", "http://nét.net/de/", "no scheme", "", None, "a://b://c/d",
    "http://example.net/de/8#x/de/", "http://example.net/DE/8", "http://xexample.net/de/9", "://?x", "http://com./en/", "http://user@h.org:80/es/1", "http://a.org/es",
]


def test_quality_rules(spark):
    rows = awkward()
    same_as_sql(quality_rules.op8(frame(spark, rows)), duck(documents=as_pandas(rows)), quality_rules.SQL)


def test_quality_filter_keeps_columns_of_any_name(spark):
    df = frame(spark, awkward()).selectExpr("*", "'x' AS kept", "1 AS n_words", "2 AS _row", "3 AS _words", "4 AS _lines", "5 AS _keys")
    judged = quality_rules.judge(df)
    assert {"_row", "_words", "_lines", "_keys"} <= set(judged.columns) and judged.filter("kept AND _keys = 5").count() > 0
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    want = quality_rules.op8(df.select("doc_id", "text")).filter("kept").count()
    assert kept.count() == want > 0


def test_url_filters(spark):
    pages = spark.createDataFrame([*enumerate(URLS), (None, URLS[0]), (0, URLS[0])], "page_id long, url string")
    con = duck(pages=pages.toPandas())
    got = url_filters.op7(pages)
    want = con.sql(url_filters.SQL.replace("FROM pages", "FROM (SELECT CAST(page_id AS BIGINT) AS page_id, url FROM pages)"))
    columns = sorted(got.columns)
    assert plain(tuple(r) for r in got.select(*columns).collect()) == plain(want.project(", ".join(columns)).fetchall())
    extra = url_filters.match(pages.selectExpr("*", "1 AS host", "2 AS rule"), url_filters.rule_table(spark))
    assert extra.count() == len(URLS) + 2


def test_verdicts_are_those_of_the_contract(spark):
    want = {
        "http://a.com/en/1": ("com/en/", "block"), "http://a.example.com/en/71": ("example.com/en/7", "allow"), "http://a.net/de/8": ("net/de/", "allow"),
        "http://example.net/de/9": ("net/de/", "allow"), "http://b.example.net/de/81": ("example.net/de/8", "block"), "http://a.org/es/": ("org/es/", "block"),
    }
    got = url_filters.match(spark.createDataFrame(list(enumerate(want)), "page_id long, url string"), url_filters.rule_table(spark)).collect()
    assert {r.url: (r.rule, r.verdict) for r in got} == want


def test_mixing(spark):
    rows = awkward()
    got = mixing.op4(frame(spark, rows))
    same_as_sql(got, duck(documents=as_pandas(rows)), mixing.SQL)


def test_mixing_carries_the_texts(spark):
    rows = awkward()
    df = frame(spark, rows).selectExpr("*", "1 AS block", "'x' AS _k0", "2 AS rank")
    got = mixing.mix(df, carry=("text", "lang")).collect()
    plain_rows = mixing.mix(df).collect()
    assert sorted((str(r.doc_id), r.epoch, r.rank) for r in got) == sorted((str(r.doc_id), r.epoch, r.rank) for r in plain_rows)
    texts = {(r[0], r[1], r[2]) for r in rows}
    assert len(got) > 10 and all((r.doc_id, r.text, r.lang) in texts for r in got)


def test_mixing_of_very_many_sources(spark):
    stats = spark.range(5000).selectExpr("CAST(id AS STRING) AS source", "1 + id * id % 7919 AS tokens")
    tokens = [1 + i * i % 7919 for i in range(5000)]
    total = sum(tokens)
    p = [t / total for t in tokens]
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        z = sum(x**a for x in p)
        if max(x**a / z / x for x in p) > 2.0:
            low = a
        else:
            high = a
    z = sum(x**high for x in p)
    got = {r.source: r.weight for r in mixing.exponent(stats, max_repeats=2.0).collect()}
    assert len(got) == 5000 and all(got[str(i)] == pytest.approx(x**high / z, abs=2e-9) for i, x in enumerate(p))


def test_filters_of_many_lengths_and_hosts(spark):
    rng = random.Random(5)
    name = lambda: ".".join(rng.choice("abc") for _ in range(rng.randrange(1, 4)))
    path = lambda: "/" + "".join(rng.choice("xy/") for _ in range(rng.randrange(6)))
    rules = list({(h, p): (rng.choice(["allow", "block"]), h, p) for h, p in ((name(), path()) for _ in range(200))}.values())
    urls = [(i, f"http://{name()}{path()}") for i in range(400)]
    got = url_filters.match(spark.createDataFrame(urls, "page_id long, url string"), url_filters.rule_table(spark, rules), otherwise="none")
    hits = 0
    for r in got.collect():
        fits = [(len(h), len(p), h + p, v) for v, h, p in rules if ("." + r.host).endswith("." + h) and r.path.startswith(p)]
        assert (r.rule, r.verdict) == (max(fits)[2:] if fits else (None, "none"))
        hits += bool(fits)
    assert hits > 100


def test_mixing_meets_its_target(spark):
    rows = [(i, "w " * 50, "en", s, 0) for s, n in (("a", 600), ("b", 150), ("c", 50)) for i in range(n)]
    df = frame(spark, rows)
    got = mixing.mix(df, max_repeats=2.0, block_tokens=1000).groupBy("source").sum("n_tokens").collect()
    tokens = {r[0]: r[1] for r in got}
    assert 1.9 <= max(tokens["c"] / 2500, tokens["b"] / 7500) <= 2.0 and tokens["a"] < 30000
    stats = spark.createDataFrame([("a", 900), ("b", 100)], "source string, tokens long")
    weights = [r.weight for r in mixing.exponent(stats, entropy=0.5).collect()]
    import math

    assert -sum(w * math.log(w) for w in weights) == pytest.approx(0.5, abs=1e-6)


def test_an_epoch_is_a_permutation(spark):
    rows = [(i, f"word{i} x y", "en", "a" if i % 3 else "b", 0) for i in range(300)]
    got = mixing.mix(frame(spark, rows), max_repeats=3.0, budget=1800, block_tokens=100)
    whole = got.filter("epoch = 0")
    assert whole.count() == whole.select("doc_id").distinct().count() == 300
    assert got.filter("epoch = 0").groupBy("source", "block", "rank").count().filter("count > 1").count() == 0


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert quality_rules.op8(empty).count() == 0 and mixing.op4(empty).count() == 0
    assert url_filters.op7(spark.createDataFrame([], "page_id long, url string")).count() == 0
