from scriptorium.llm.url_filter import RULES, filter_urls

SCHEMA = "page_id long, url string, host string, template string"


def run(spark, urls, **options):
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], SCHEMA)
    return {r.page_id: r for r in filter_urls(df, **options).collect()}


def test_hosts_paths_and_rules(spark):
    urls = ["http://A.Example.ORG/es/1?q", "https://example.org/en/12#x", "https://example.org/en/2", "http://badexample.org/es/1", "ftp://x.com/de/1", "x.com/de/1", None, "", "a://b", "a://com/fr/", "a://É.COM/fr/a://b", "http://org", "http://org?x", "s://user@h.com:80/de/"]
    got = run(spark, urls)
    seen = [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))]
    assert seen == [
        ("a.example.org", "/es/1", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("example.org", "/en/2", "org/"), ("badexample.org", "/es/1", "org/"),
        ("x.com", "/de/1", "com/de/"), ("", "", None), ("", "", None), ("", "", None), ("b", "", None), ("com", "/fr/", "com/fr/"), ("É.com", "/fr/a://b", "com/fr/"),
        ("org", "", None), ("org", "", None), ("user@h.com:80", "/de/", None),
    ]
    assert [got[i].verdict for i in range(5)] == ["block", "block", "allow", "allow", "block"]
    assert all(r.verdict in ("allow", "block") for r in got.values())


def test_templates_generalise_merge_and_reject(spark):
    urls = [f"http://s.net/item/slug-{chr(97 + i % 26)}{chr(97 + i // 26)}/buy" for i in range(60)]
    rules = (("block", "bad.com", "/"), ("allow", "good.com", "/"))
    urls += [f"http://bad.com/{a}/{i}" for a in ("x", "y") for i in range(40)] + [f"http://good.com/ok/{i}" for i in range(40)]
    urls += ["http://new.net/x/7", "http://new.net/ok/7", "http://new.net/never/7"]
    got = run(spark, urls, rules=rules)
    assert {got[i].template for i in range(60)} == {"/item/*/buy"}
    assert [got[len(urls) - 3 + i].verdict for i in range(3)] == ["block", "allow", "allow"]
    from pyspark.sql import functions as F

    from scriptorium.llm.url_filter import path_templates

    shapes = spark.createDataFrame([("h", "x/{n}", 50, 40, 10), ("h", "y/{n}", 50, 41, 9), ("h", "z/{n}", 50, 0, 50)], "host string, shape string, n long, block long, allow long")
    merged = {r.shape[0]: r.template for r in path_templates(shapes, min_labels=20).collect()}
    assert merged["z"] == "/z/{n}"
    shapes = shapes.filter(~F.col("shape").startswith("z"))
    assert {r.template for r in path_templates(shapes).collect()} == {"/*/{n}"}


def test_tree_goes_to_the_deepest_path(spark):
    names = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    urls = [f"http://h.net/a/b/c/{x}/item-{x}/z" for x in names] + ["http://h.net/a/b/c/aa/other", "http://h.net/a/b", "http://h.net/a//b/", "http://h.net/" + "/".join(f"d{x}" for x in names * 20)]
    got = run(spark, urls)
    assert {got[i].template for i in range(1, 40)} == {"/a/b/c/*/*/z"}
    # the tail of a path that is alone from its second segment on stays as it is
    assert [got[40 + i].template for i in range(4)] == ["/a/b/c/*/*", "/a/b", "/a//b", "/" + "/".join(f"d{x}" for x in names * 20)]
    # labels below the third segment decide there
    rules = (("block", "h.net", "/u/v/w/bad/"), ("allow", "h.net", "/u/v/w/good/"))
    urls = [f"http://h.net/u/v/w/{kind}/{i}/p" for kind in ("bad", "good") for i in range(40)] + ["http://h.net/u/v/w/bad", "http://x.net/u/v/w/bad/7/p", "http://x.net/u/v/w/good/7/p"]
    got = run(spark, urls, rules=rules)
    assert [got[81 + i].verdict for i in range(2)] == ["block", "allow"]


def test_repeats_and_empty(spark):
    got = run(spark, ["http://a.net/1"] * 3)
    assert len(got) == 3 and len({r.verdict for r in got.values()}) == 1
    assert run(spark, []) == {}
    assert len(RULES) == 5
