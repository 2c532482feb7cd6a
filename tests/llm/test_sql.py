import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))
import oracle
from pyspark.sql import functions as F

from rankspark.llm import lines, queries, warc


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    got, want = oracle.spark_rows(queries.queries()[name](spark, sf)), oracle.duck(sf, queries.oracle_sql()[name])
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    assert got[1] == want[1]


def test_lines_odd_rows(spark):
    passage = "\n".join(f"line {i} of the shared part" for i in range(60))
    rows = [(1, None, "x"), (2, "", "x"), (3, passage, None), (4, "own\n" + passage + "\nlast", "y"), (5, "one line", "z"), (5, "one line", "z"), (6, "\n\n\n\n", "z"), (7, "\n\n\n\n", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = {(r.doc_id, r.text): r for r in lines.dedup_lines(df).collect()}
    assert got[(1, None)].n_lines == 0 and got[(2, "")].n_lines == 1 and (3, passage) in got and (5, "one line") in got and (6, "\n\n\n\n") in got and (7, "\n\n\n\n") in got
    (four,) = [r for (i, _), r in got.items() if i == 4]
    assert four.n_removed_lines >= 40 and four.text.startswith("own\n") and four.text.endswith("last") and len(four.text) < len(passage) / 2
    assert lines.dedup_lines(df.where("false")).collect() == []


def test_boundaries_resist_shifts(spark):
    body = [f"sentence number {i * i % 97} {i}" for i in range(200)]
    df = spark.createDataFrame([(1, "\n".join(body)), (2, "\n".join(["new first", *body[:90], "new middle", *body[90:]]))], "doc_id long, text string")
    (two,) = [r for r in lines.dedup_lines(df).collect() if r.doc_id == 2]
    assert two.n_removed_lines > 170 and "new first" in two.text and "new middle" in two.text


def test_revisits(spark):
    h = {"etag": '"a"', "date": "1", "content-type": "t"}
    rows = [
        (1, "response", "http://www.A.com:80/x/?b=1&a=2", 10, 200, h),
        (2, "response", "http://a.com/x?a=2&b=1", 90_000, 200, {"last-modified": "m", "date": "2"}),
        (3, "revisit", "https://a.com/x?a=2&b=1#f", 11, 304, {"etag": 'W/"a"', "date": "9", "content-type": "no"}),
        (4, "revisit", "http://a.com/x?a=2&b=1", 10, 304, {}),
        (5, "revisit", "http://a.com/x?a=2&b=1", 89_000, 304, {"etag": '"z"'}),
        (6, "revisit", "http://a.com/x?a=2&b=1", 10**7, 304, {"last-modified": "m"}),
        (7, "revisit", None, 50, 304, None),
        (8, "response", "http://a.com/x?a=2&b=1", 10**6, 404, {}),
        (9, "metadata", "http://a.com/x?a=2&b=1", 12, None, None),
        (10, "revisit", "nothing", 5, 304, None),
        (10, "revisit", "nothing", 5, 304, None),
    ]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, at long, status int, headers map<string,string>")
    got = sorted(((r.record_id, r.response_id, r.verdict, r.merged) for r in warc.resolve_revisits(df).collect()), key=lambda r: r[0])
    assert got[0] == (3, 1, "resolved", {"etag": 'W/"a"', "date": "9", "content-type": "t"})
    assert [g[:3] for g in got[1:]] == [(4, None, "unresolved"), (5, 1, "mismatch"), (6, 2, "resolved"), (7, None, "unresolved"), (10, None, "unresolved"), (10, None, "unresolved")]
    assert warc.resolve_revisits(df.where("false")).collect() == []


def test_canonical_urls(spark):
    told = {
        "http://h/%7Ea%2fb%": "h/~a%2Fb%",
        "HTTP://User:p@ss@WWW.H.org:80/a/./b/../c/": "h.org/a/c",
        "https://h:80/": "h:80",
        "https://h:443/../../x": "h/x",
        "ftp://h:80/a": "h:80/a",
        "http://h:/a?&b=2&&a=%61%zz&": "h/a?a=a%zz&b=2",
        "http://h/a/..": "h",
        "http://h/..a/b.?": "h/..a/b.",
        "http://h/%2E%2e/a/%e4": "h/a/%E4",
        "no url": "no url",
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in told], "url string")
    assert {r.url: r.c for r in df.select("url", warc.canonical_url(F.col("url")).alias("c")).collect()} == told


def test_hot_response_is_dealt(spark):
    rows = [(0, "response", "http://h/a", 5, 200, {"etag": "e"})] + [(i, "revisit", "http://h/a" if i % 3 else None, 10 + i, 304, {"etag": "e"}) for i in range(1, 3001)]
    df = spark.createDataFrame(rows, "record_id long, kind string, url string, at long, status int, headers map<string,string>")
    out = warc.resolve_revisits(df)
    got = out.groupBy("verdict").count().collect()
    assert {r.verdict: r["count"] for r in got} == {"resolved": 2000, "unresolved": 1000}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        most = warc.resolve_revisits(df).groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert most < 1500


def test_repeated_responses_and_null_ids(spark):
    h = {"etag": "x"}
    rows = [(1, "response", "http://a/x", 10, 200, h), (1, "response", "http://a/x", 10, 200, h), (None, "response", "http://b/y", 10, 200, h)]
    rows += [(2, "revisit", "http://a/x", 11, 304, h), (2, "revisit", "http://b/y", 12, 304, {"etag": "z"}), (None, "revisit", "http://a/x", 13, 304, h), (None, "revisit", "http://b/y", 9, 304, h)]
    df = spark.createDataFrame([(*r, 5) for r in rows], "record_id long, kind string, url string, at long, status int, headers map<string,string>, k int")
    got = sorted(((r.record_id or 0, r.canonical_url, r.response_id, r.verdict) for r in warc.resolve_revisits(df).collect()))
    assert got == [(0, "a/x", 1, "resolved"), (0, "b/y", None, "unresolved"), (2, "a/x", 1, "resolved"), (2, "b/y", None, "mismatch")]


def test_recall_of_short_passages(spark):
    import random

    draw, rows, passages = random.Random(3), [], {}
    line = lambda: " ".join(draw.choice("abcdefgh") + str(draw.randint(0, 9999)) for _ in range(6))
    for n in (2, 4, 5, 8, 12):
        for k in range(60):
            passage = [line() for _ in range(n)]
            for copy in range(2):
                doc = 10_000 * copy + 100 * n + k
                rows.append((doc, "\n".join([*(line() for _ in range(draw.randint(3, 8))), *passage, *(line() for _ in range(draw.randint(3, 8)))])))
                passages[doc] = n
    got = {r.doc_id: r.n_removed_lines for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = {n: sum(got[d] > 0 for d in passages if d >= 10_000 and passages[d] == n) / 60 for n in (2, 4, 5, 8, 12)}
    assert all(got[d] == 0 for d in passages if d < 10_000)
    assert caught[4] > 0.3 and caught[5] > 0.5 and caught[8] > 0.85 and caught[12] > 0.95, caught
