import re

from pagewright.llm import url_templates as urls


def plain_rule(host, path, rules=urls.RULES):
    fitting = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fitting, key=lambda r: len(r.text)).text if fitting else None


ODD_URLS = [None, "", "no scheme", "http://", "http://A.Example.ORG", "http://a.example.org/", "https://example.org/es/1?x=/y#z", "x://example.org/en/12/3",
            "http://notexample.org/es/", "http://b.com/fr/", "http://b.com/de/9", "http://org/x", "a://b://c.org/d", "http://É.com/de/", "http://h.net?q=://x.org/"]


def test_rules_and_parts(spark):
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(ODD_URLS)] + [(None, "http://a.org/b", "h"), (1, "", "h")], "page_id long, url string, host string")
    rows = urls.judge(pages).collect()
    assert len(rows) == len(ODD_URLS) + 2
    for r in rows:
        url = "http://a.org/b" if r["page_id"] is None else ODD_URLS[r["page_id"]] or ""
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]) if m else ""
        path = m[2] if m else ""
        assert (r["host"], r["path"], r["rule"]) == (host, path, plain_rule(host, path)), url
        if r["rule"]:
            assert r["verdict"] == next(x.verdict for x in urls.RULES if x.text == r["rule"])
        assert r["verdict"] in ("allow", "block")


def test_templates_generalise_merge_and_reject(spark):
    rules = (urls.Rule("block", "h.net", "/bad/0"), urls.Rule("allow", "h.net", "/good/0"))
    rows = [f"http://h.net/bad/0/{i}" for i in range(40)] + [f"http://h.net/good/0/{i}" for i in range(80)]
    rows += ["http://h.net/bad/7/1", "http://h.net/good/7/1"] + [f"http://many.net/{'abcdefghij'[i // 10]}{'klmnopqrst'[i % 10]}x/1" for i in range(100)]
    got = {r["path"]: r for r in urls.judge(spark.createDataFrame(list(enumerate(rows)), "page_id long, url string"), rules).collect()}
    assert got["/bad/7/1"]["verdict"] == "block" and got["/good/7/1"]["verdict"] == "allow"
    assert got["/bad/7/1"]["template"] == "/bad/{n}/{n}"
    assert {r["template"] for p, r in got.items() if p.endswith("x/1")} == {"/*/{n}"}


def test_urls_odd_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, rule string, verdict string")
    assert urls.judge(empty).count() == 0
    clash = spark.createDataFrame([(1, "http://x.net/a/b/c/d/e", "r", "v", "s")], "page_id long, url string, rule string, verdict string, s1 string")
    row = urls.judge(clash).collect()
    assert len(row) == 1 and row[0]["verdict"] == "allow" and row[0]["template"] == "/a/b/c/**"
