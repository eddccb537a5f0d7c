import re

import pytest

from slabscan.llm import queries, url_filter
from slabscan.llm.components import connected_components
from slabscan.llm.url_filter import RULES, Rule, filter_urls


def own_rule(url, rules=RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.text)) if fits else None


@pytest.mark.parametrize("edges_per_task", [1 << 20, 60])
def test_components(spark, edges_per_task):
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5000), (6000, 6001), (6001, 6000)]
    df = spark.createDataFrame([*edges, (None, 1)], "a long, b long").repartition(4)
    got = {r.node: r.component for r in connected_components(df, edges_per_task=edges_per_task).collect()}
    want = {i: 1 for i in range(1, 201)} | {1000 + i: 1000 for i in range(300)} | {6000: 6000, 6001: 6000}
    assert got == want
    assert connected_components(df.limit(0)).collect() == []


def test_components_of_random_edges(spark):
    """Bytes and numbers as nodes, in one task and in several, against union-find."""
    import random

    rng = random.Random(2)
    edges = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(1300)]
    root = list(range(3000))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    want = {i: find(i) for i in {x for a, b in edges if a != b for x in (a, b)}}
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    for n in (1 << 20, 100):
        assert {r.node: r.component for r in connected_components(df, edges_per_task=n).collect()} == want
    text = df.selectExpr("encode(lpad(a, 4, '0'), 'utf-8') as a", "encode(lpad(b, 4, '0'), 'utf-8') as b")
    assert {int(r.node): int(r.component) for r in connected_components(text).collect()} == want


def test_rules_and_aliases(spark):
    link = '<LINK href="https://shop.com/de/7" rel=canonical>'
    refresh = '<meta http-equiv="refresh" content="0; url=/moved">'
    rows = [
        (1, "http://Example.ORG/es/1", None),
        (2, "http://a.example.org/en/12?x", ""),
        (3, "http://example.org", "x"),
        (4, "https://mirror.net/7", link),
        (5, "https://www.mirror.net/7/#top", "x"),
        (6, "https://mirror.net/old", refresh),
        (7, "https://mirror.net/moved", link.replace("LINK", "link")),
        (8, "https://lonely.net/", "x"),
        (9, None, None),
        (10, "no scheme", "x"),
        (11, "https://both.net/", link),
        (12, "https://both.net/?utm_source=a", '<link rel="canonical" href="//ok.com/fr/1">'),
        (13, "http://example.org/es/1?q=1", "x"),
        (4, "https://mirror.net/7", link),
        (None, "https://mirror.net/7", "x" * 300_000),
    ]
    pages = spark.createDataFrame([(*r, "k") for r in rows], "page_id long, url string, html string, rule string")
    explicit = spark.createDataFrame([(1, "https://shop.com/de/7", ""), (2, "https://ok.com/fr/1", "")], "page_id long, url string, html string")
    known = {(r.page_id, r.verdict) for r in filter_urls(pages.where("page_id is null or page_id != 12")).collect()}
    for page in (4, 5, 6, 7, 11, None):
        assert (page, "block") in known
    for page in (3, 8, 9, 10):
        assert (page, "allow") in known
    # An explicit allow in the component goes first, whether its url is a page or only the target of a link.
    for table in (pages, pages.unionByName(explicit, allowMissingColumns=True)):
        allowed = {(r.page_id, r.verdict) for r in filter_urls(table).collect()}
        assert (11, "allow") in allowed and (12, "allow") in allowed and (4, "allow") in allowed
    for r in filter_urls(pages).collect():
        if r.page_id in (1, 2, 3, 9, 10, 13):
            host, path, rule = own_rule(next(u for i, u, _ in rows if i == r.page_id))
            assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
    assert filter_urls(pages.limit(0)).collect() == []


def test_many_rules_by_join(spark):
    rules = [*RULES, *(Rule("block", f"h{i}.net", "/") for i in range(100))]
    urls = ["http://h3.net/x", "http://a.h7.net/", "http://b.com/de/1", "http://b.com/x", "http://h3.net"]
    base = spark.createDataFrame([(u, *own_rule(u)[:2]) for u in urls], "url string, host string, path string")
    for r in url_filter.match_rules(base, rules).collect():
        rule = own_rule(r.url, rules)[2]
        assert (r.rule, r.rule_verdict) == ((rule.text, rule.verdict) if rule else (None, None))


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    urls = {r.page_id: r.url for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    rows = queries.op1_url_filter(spark, sf).collect()
    assert sorted(r.page_id for r in rows) == sorted(urls)
    for r in rows:
        host, path, rule = own_rule(urls[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.text)
        # No page of these data has a link, and no two share a form, so the method allows what has no rule.
        assert r.verdict == (rule.verdict if rule else "allow")


def test_ties_of_rules(spark):
    """Rules of equal length, by the expression and by the join."""
    ties = [Rule("block", "a.net", "/x"), Rule("allow", "net", "/x/yz"), Rule("allow", "b.net", "/"), Rule("block", "b.net", "/")]
    urls = [f"http://{h}{p}" for h in ("a.net", "s.a.net", "b.net", "net", "anet") for p in ("/x/yz", "/x", "/", "")]
    base = spark.createDataFrame([(u, *own_rule(u)[:2]) for u in urls], "url string, host string, path string")
    many = [*ties, *(Rule("block", f"h{i}.org", "/") for i in range(100))]
    one, two = ({(r.url, r.rule) for r in url_filter.match_rules(base, rules).collect()} for rules in (ties, many))
    assert one == two and len(one) == len(urls)


def test_resolved_targets(spark):
    from urllib.parse import urljoin

    bases = ["http://a.net/b/c/d.html?q=1", "https://a.net", "http://a.net/x/"]
    targets = ["e.html", "../e", "../../../e", "./e/./f", "?p=2", "/abs/../y?z=..", "//o.org/p", "https://o.org/q", "g/..", "g/h/..", "k?r=/../s"]
    df = spark.createDataFrame([(b, t) for b in bases for t in targets], "b string, t string")
    for r in df.select("b", "t", url_filter.resolved(df.t, df.b).alias("got")).collect():
        want = urljoin(r.b, r.t)
        if r.t.startswith("//"):
            want = want.replace("https:", "http:")
        assert r.got.rstrip("/") == want.replace("a.net?", "a.net/?").rstrip("/"), (r.b, r.t)
    odd = spark.createDataFrame([("http://a/", "#x"), ("http://a/", "mailto:x"), ("no scheme", "y"), (None, "y")], "b string, t string")
    assert [r.got for r in odd.select(url_filter.resolved(odd.t, odd.b).alias("got")).collect()] == [None] * 4


def form(url):
    """The canonical form, by hand."""
    if not url or "://" not in url:
        return None
    host, path, _ = own_rule(url)
    rest = url.split("://", 1)[1].split("#")[0]
    query = rest.partition("?")[2]
    query = "&".join(p for p in query.split("&") if not re.match(r"(utm_[^=&]*|gclid|fbclid|ref)=", p)) if query else ""
    host = re.sub(r"^www\.", "", host)
    return (host + re.sub("/$", "", path) + ("?" + query if query else "")) if host else None


def test_query_by_brute_force(spark, tmp_path):
    """All rows of the query on planted redirects and canonical links, against a union-find."""
    from random import Random

    rng = Random(9)
    hosts = [f"{w}h{i}.net" for i in range(300) for w in ("", "www.")]
    paths = ["/", "/p", "/p/", "/p/q?id=1&utm_source=z", "/p/q?id=1", "/r#s", ""]
    urls = [f"http://{h}{p}" for h in hosts for p in paths]
    ruled = [f"http://{h}{p}{i}" for h in ("shop.com", "Q.Com") for p in ("/fr/", "/de/", "/de/", "/de/") for i in range(9)] + ["http://example.org/es/3", "http://example.org/x"]
    tags = ['<link rel="canonical" href="{}">', "<LINK href='{}' REL=canonical />", '<meta http-equiv="refresh" content="0; url={}">', "<link rel=stylesheet href={}>"]
    rows = []
    for i in range(500):
        links = [(rng.choice(tags), rng.choice([rng.choice(ruled), rng.choice(urls), "/p", "q?id=1", "../p", f"//h{i}.net/p", "#top"])) for _ in range(rng.choice([0, 0, 1, 1, 2]))]
        rows.append((i, rng.choice([*urls, *ruled, f"http://only{i}.net/", None, "odd"]), "<html>" + "".join(t.format(u.replace("&", "&amp;")) for t, u in links), links))
    (tmp_path / "sf").mkdir()
    spark.createDataFrame([r[:3] for r in rows], "page_id long, url string, html string").write.parquet(str(tmp_path / "sf/pages.parquet"))
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    from urllib.parse import urljoin

    ends = [r[1] for r in rows]
    for _, url, _, links in rows:
        for tag, to in links:
            if "stylesheet" in tag or to == "#top" or not form(url):
                continue
            target = "http:" + to if to.startswith("//") else to if "://" in to else urljoin(url, to)
            if form(target):
                ends.append(target)
                root[find(form(url))] = find(form(target))
    votes = {}
    for url in ends:
        rule = own_rule(url)[2]
        if form(url) and rule:
            votes.setdefault(find(form(url)), set()).add(rule.verdict)
    want, aliased = {}, 0
    for i, url, _, _ in rows:
        host, path, rule = own_rule(url)
        found = votes.get(find(form(url)), set()) if form(url) else set()
        by_alias = "block" if "block" in found and "allow" not in found else "allow"
        aliased += rule is None and by_alias == "block"
        want[i] = (host, path, rule and rule.text, rule.verdict if rule else by_alias)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in queries.op1_url_filter(spark, str(tmp_path / "sf")).collect()}
    assert got == want
    assert aliased > 10 and sum(v[2] is None and v[3] == "allow" for v in want.values()) > 10
