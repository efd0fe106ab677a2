"""Link targets that are no pages, and targets without a scheme."""

from pyspark.sql import functions as F

from tidewatch.llm import url_equivalence

PAGES = "page_id long, url string, html string"


def link(href):
    return f'<link rel="canonical" href="{href}">'


def refresh(url):
    return f'<meta http-equiv="refresh" content="0; url={url}">'


def verdicts(spark, rows):
    return {r.page_id: r.verdict for r in url_equivalence.judge(spark.createDataFrame(rows, PAGES)).collect()}


def test_targets_that_are_no_page_spread_their_decision(spark):
    rows = [(1, "http://plain.com/a", link("https://bad.net/a")), (2, "http://plain.com/b", refresh("http://bad.net/b")),
            # an allowed target protects the component, also one that holds a blocked page
            (3, "http://plain.com/c", link("http://good.org/fr/c") + refresh("http://bad.net/c")), (4, "http://www.plain.com/a/", None),
            # the path is judged as it is written: /de is not under /de/
            (5, "http://plain.com/e", link("http://example.com/de")), (6, "http://plain.com/f", link("http://www.example.com/de/f.html")),
            (7, "http://plain.com/g", link("http://other.com/g")), (8, "no scheme", link("https://bad.net/a"))]
    assert verdicts(spark, rows) == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "block", 7: "allow", 8: "allow"}


def test_targets_without_a_scheme_are_resolved(spark):
    base = "http://plain.com/dir/sub/page?x=1"
    cases = {"/a": "plain.com/a", "//h.com/a": "h.com/a", "a": "plain.com/dir/sub/a", "./a?b=1": "plain.com/dir/sub/a?b=1", "../a": "plain.com/dir/a",
             "../../../a": "plain.com/a", "?b=2": "plain.com/dir/sub/page?b=2", "#f": None, "mailto:me@h.com": None, "javascript:x": None,
             "http://h.com/a": "h.com/a", "/go?to=http://h.com/a": "plain.com/go?to=http://h.com/a", "..": "plain.com/dir/", ".": "plain.com/dir/sub/",
             "/a/./b/../c": "plain.com/a/c", "a..b/..c": "plain.com/dir/sub/a..b/..c"}
    df = spark.createDataFrame(list(cases.items()), "t string, want string")
    got = df.select("t", url_equivalence.resolve(df.t, url_equivalence.after_scheme(F.lit(base))).alias("got")).collect()
    assert {r.t: r.got for r in got} == cases
    top = df.select(url_equivalence.resolve(F.lit("a"), F.lit("plain.com")).alias("p"), url_equivalence.resolve(F.lit("/a"), F.lit("")).alias("n")).first()
    assert (top.p, top.n) == ("plain.com/a", None)


def test_relative_links_are_edges(spark):
    rows = [(1, "http://new.com/en/old", refresh("/en/page")), (2, "http://new.com/en/page", link("//bad.net/p")), (3, "http://new.com/en/x", refresh("page.html")),
            (4, "http://new.com/en/y", '<base href="/fr/">' + refresh("page")), (5, "http://new.com/fr/page", link("https://bad.net/q")),
            (6, "http://new.com/en/z", refresh("other")), (7, "http://new.com/fr/w", '<base href="http://bad.net/">' + link("w")), (8, None, refresh("/en/page"))]
    assert verdicts(spark, rows) == {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "allow", 7: "block", 8: "allow"}
