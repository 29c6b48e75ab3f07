from pyspark.sql import functions as F

from tidemark.llm.bloom import BLOCK_BYTES, Shape, possible, shape
from tidemark.llm.queries import URL_RULES
from tidemark.llm.url_filter import canonical_url, filter_urls


CASES = [
    ("https://A.Example.com/en/x?q#f", "a.example.com", "/en/x", "example.com/en/", "block"),
    ("http://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/", "allow"),
    ("http://m.www.example.com/en/1", "m.www.example.com", "/en/1", "www.example.com/en/", "allow"),
    ("http://example.com/de/", "example.com", "/de/", "com/", "allow"),
    ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
    ("http://com", "com", "", None, "allow"),
    ("http://x.net/es/1", "x.net", "/es/1", "net/es/", "block"),
    ("http://x.net/ES/1", "x.net", "/ES/1", None, "allow"),
    ("http://x.net?/es/", "x.net", "", None, "allow"),
    ("http://bad.org/a/", "bad.org", "/a", None, "block"),
    ("http://www.bad.org/a?utm_source=x#y", "www.bad.org", "/a", None, "block"),
    ("http://bad.org/a?page=2", "bad.org", "/a", None, "allow"),
    ("http://bad.org:80/a", "bad.org:80", "/a", None, "block"),
    ("http://me:pw@bad.org./a", "me:pw@bad.org.", "/a", None, "block"),
    ("http://bad.org:8080/a", "bad.org:8080", "/a", None, "allow"),
    ("no scheme", "", "", None, "allow"),
    ("", "", "", None, "allow"),
    (None, "", "", None, "allow"),
    ("http://" + "l" * 50_000 + ".org/", "l" * 50_000 + ".org", "/", None, "allow"),
]


def run(spark, rows, listed, **options):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as host", "2 as rule", "3 as block", "4 as word")
    lists = spark.createDataFrame([(u,) for u in listed], "url string")
    return filter_urls(pages, lists, URL_RULES, **options)


def test_rules_and_list(spark):
    rows = [(i, c[0], None) for i, c in enumerate(CASES)]
    for options in ({}, {"max_filter_bytes": 0}):  # with a filter that fits, and with the smallest
        out = {r.page_id: r for r in run(spark, rows, ["https://bad.org/a", "http://bad.org/a/", None], **options).collect()}
        for i, (_, host, path, rule, verdict) in enumerate(CASES):
            path = path + "/" if rows[i][1] == "http://bad.org/a/" else path
            assert (out[i].host, out[i].path, out[i].rule, out[i].verdict) == (host, path, rule, verdict), rows[i][1][:80]


def test_false_positives_are_removed(spark):
    """Also with blocks so full that nearly all probes hit, only listed URLs are blocked."""
    rows = [(i, f"http://h.org/{i}", None) for i in range(3000)]
    for options in ({}, {"max_filter_bytes": 0}):
        out = run(spark, rows, [f"http://h.org/{i}" for i in range(0, 3000, 3)], **options)
        assert {r.page_id for r in out.where("verdict = 'block'").collect()} == set(range(0, 3000, 3))


def test_the_filter_stays_at_any_length_of_the_list():
    assert shape(10**6) == Shape(250_000, 6)
    for n in (10**8, 10**10):
        assert shape(n).blocks * BLOCK_BYTES <= 64 << 20 and shape(n).hashes >= 1


def test_the_filter_lets_few_others_pass(spark):
    keys = spark.range(5000).selectExpr("concat('k', id) as key")
    rows = spark.range(50_000).selectExpr("if(id = 7, null, concat('k', id)) as key")
    out = possible(rows, keys, "key", shape(5000))
    assert out.where("key is null and maybe").count() == 0
    assert 4999 <= out.where("maybe").count() < 5500


def test_empty_tables_repeats_and_null_ids(spark):
    assert run(spark, [], ["http://a.org/"]).count() == 0
    out = run(spark, [(1, "http://a.org/", None)] * 3 + [(None, "http://a.org/", None)], []).collect()
    assert len(out) == 4 and {r.verdict for r in out} == {"allow"}


def test_canonical(spark):
    one = lambda u: spark.range(1).select(canonical_url(F.lit(u)).alias("x")).first().x
    assert one("HTTPS://WWW.A.org/b/?utm_a=1&c=2&utm_b=3#d") == "a.org/b?c=2"
    assert one(None) == ""
