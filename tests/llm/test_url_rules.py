import re

from limnos.llm import url_rules as U
from limnos.llm.components import connected_components
from limnos.llm.store import Stage

from .helpers import rows

SCHEMA = "page_id long, url string, html string"


def link(target):
    return f'<html><LINK class="x" rel="Canonical" href="{target}"></html>'


def refresh(target):
    return f"<meta http-equiv='refresh' content='0; URL={target}'>"


PAGES = [
    (0, "https://A.Example.ORG/es/1?x=1#top", None), (1, "http://x.com/de/3", ""), (2, "http://x.com/fr/de/", "<p>"), (3, "http://notcom/de/3", "<b>"),
    (4, "http://example.org/en/12", ""), (5, "http://example.org/en/21", ""), (6, None, link("http://x.com/de/3")), (7, "no url", ""), (8, "", ""),
    (9, "http://p.net/a", link("http://q.net/b#f")), (10, "http://q.net/b", refresh("http://x.com/de/3")), (11, "http://P.net/a#z", "x"),
    (12, "http://r.net/a/b", link("../c")), (13, "http://r.net/a/../c", link("//x.com/de/9?a=1&amp;b=2")),
    (14, "http://s.net/1", link("http://t.net/1")), (15, "http://t.net/1", link("http://y.org/z")), (16, "http://u.net/1", link("http://t.net/1") + refresh("http://x.com/de/77")),
    (17, "http://v.net/1", '<p>canonical</p><link rel="stylesheet" href="http://x.com/de/3">'), (18, "http://y.org", ""), (18, "http://y.org", ""),
    (19, "ftp://user@h.org:80/p?://q", ""), (20, "http://é.ORG/É", link("mailto:x@y")),
]


def test_verdicts(spark):
    df = spark.createDataFrame(PAGES, SCHEMA)
    for name in ("rule", "verdict", "host", "id", "own", "src"):
        df = df.withColumn(name, df.url)
    got = U.judge(df).collect()
    assert len(got) == len(PAGES)
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got}
    assert by[0] == ("a.example.org", "/es/1", "example.org/es/", "block")
    assert by[1] == ("x.com", "/de/3", "com/de/", "block") and by[2] == ("x.com", "/fr/de/", "com/fr/", "allow")
    assert by[3] == ("notcom", "/de/3", None, "allow")
    assert by[4][2:] == ("example.org/en/1", "block") and by[5][2:] == ("org/", "allow")
    assert by[6] == by[7] == by[8] == ("", "", None, "allow")
    assert by[9][2:] == by[10][2:] == by[11][2:] == (None, "block")  # over two links and without the fragment
    assert by[12][2:] == by[13][2:] == (None, "block")  # a relative target, a target that is no page
    assert by[14][2:] == by[15][2:] == by[16][2:] == (None, "allow")  # an explicit allow precedes a block
    assert by[17][2:] == (None, "allow") and by[18] == ("y.org", "", None, "allow")
    assert by[19][:3] == ("user@h.org:80", "/p", None) and by[20] == ("é.org", "/É", "org/", "allow")


def test_redirect_table_and_empty(spark):
    df = spark.createDataFrame([(1, "http://a.net/", None), (2, "http://b.net", None)], SCHEMA)
    more = spark.createDataFrame([("http://a.net/", "http://b.net/"), ("http://b.net/", "http://z.com/de/"), (None, "http://a.net/")], "src string, dst string")
    assert {r.verdict for r in U.judge(df, redirects=more).collect()} == {"block"}
    assert U.judge(df.limit(0)).count() == 0


def test_native_plan(spark):
    plan = U.judge(spark.createDataFrame(PAGES, SCHEMA))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow(Eval|Map)|MapInArrow", plan)


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 60)] + [(100, k) for k in range(101, 140)] + [(200, 200), (300, 250), (250, 300)]
    df = spark.createDataFrame(chain, "src long, dst long")
    got = rows(connected_components(df, Stage(spark, "cc")), "id")
    assert all(got[k]["component"] == 0 for k in range(61)) and all(got[k]["component"] == 100 for k in range(100, 140))
    assert got[300]["component"] == 250 and len(got) == 61 + 40 + 2
