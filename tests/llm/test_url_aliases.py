"""Alias groups against union-find, with relative targets, lists in rel, and odd tables."""

import random
from urllib.parse import urljoin, urlsplit

from sparkloom.llm import urlfilter


def rule_of(url):
    rest = url.partition("://")[2] if "://" in url else ""
    host = rest.split("/")[0].split("?")[0].split("#")[0].lower()
    path = rest[len(host) :].split("?")[0].split("#")[0]
    fit = [(len(h) + len(p), v == "block", v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[2] if fit else None


def test_groups_by_union_find(spark):
    rnd = random.Random(8)
    hosts = ["a.org", "b.com", "c.net", "x.example.com", "y.example.net", "d.io"]
    urls = [f"http://{rnd.choice(hosts)}/{rnd.choice(['en', 'de', 'es', 'fr'])}/{rnd.choice('78')}{i}/p" for i in range(150)]
    rows, edges = [], []
    for i, url in enumerate(urls):
        html = "<p>"
        if rnd.random() < 0.5:
            other = rnd.choice(urls)
            same = [u for u in urls if urlsplit(u).netloc == urlsplit(url).netloc]
            form = rnd.randrange(5)
            if form == 0:
                target, html = other, f'<link href="{other}" rel="alternate canonical">'
            elif form == 1:
                target = rnd.choice(same)
                html = f"<link rel='canonical nofollow' href='{urlsplit(target).path}'>"
            elif form == 2:
                target = rnd.choice(same)
                html = f'<link rel=canonical href="../../..{urlsplit(target).path}#part">'
            elif form == 3:
                target, html = other, f'<meta http-equiv="refresh" content="3; URL={other.replace("http:", "HTTP:")}">'
            else:
                target = urljoin(url, "p")
                html = '<link rel="not-canonical" href="http://a.org/es/"><link rel="canonical" href="p">'
            edges.append((url, target))
        rows.append((i, url, html, "clash"))
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    blocked = {find(u) for e in edges for u in e if rule_of(u) == "block"}
    expected = {i: rule_of(u) or ("block" if u in parent and find(u) in blocked else "allow") for i, u, *_ in rows}
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string, verdict string")
    got = {r.page_id: r.verdict for r in urlfilter.judge(table, urlfilter.rules_table(spark)).collect()}
    assert got == expected
    assert sum(rule_of(u) is None and expected[i] == "block" for i, u, *_ in rows) > 5


def test_spellings_of_one_address(spark):
    rows = [(1, "HTTP://Q.org:80/fr/é", '<link rel=canonical href="http://q.org/es/x">'), (2, "http://q.org/fr/%C3%A9#z", None), (3, "http://q.org/fr/e", ""), (4, None, '<link rel=canonical href="http://q.org/es/x">')]
    table = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    assert {r.page_id: r.verdict for r in urlfilter.judge(table, urlfilter.rules_table(spark)).collect()} == {1: "block", 2: "block", 3: "allow", 4: "allow"}
    assert urlfilter.judge(table.where("false"), urlfilter.rules_table(spark)).count() == 0


BLOCKED = '<link rel="canonical" href="http://b.org/es/1">'


def test_only_elements_make_edges(spark):
    pages = {
        "<!-- " + BLOCKED + " -->": None,
        "<script>var x = '" + BLOCKED + "'; // <!--</script>": None,
        "<STYLE media='a>b'>" + BLOCKED + "</STYLE >": None,
        "<title>" + BLOCKED: None,
        "<template>" + BLOCKED + "</template>": None,
        "<div data-x='" + BLOCKED + "'>": None,
        '<link data-rel="canonical" href="http://b.org/es/1">': None,
        '<link title=" rel=canonical " rel=next href="http://b.org/es/1">': None,
        '<meta name="refresh" content="0; url=http://b.org/es/1">': None,
        '<meta http-equiv="refresh" content="5">': None,
        "<![CDATA[ " + BLOCKED + " ]]>": None,
        "<!-->" + BLOCKED + "<!-- -->": "http://b.org/es/1",
        "<script>'<!--'</script>" + BLOCKED: "http://b.org/es/1",
        "<a title='>' b'>" + BLOCKED: "http://b.org/es/1",
        "<LINK HREF = http://b.org/es/1/ REL = Canonical>": "http://b.org/es/1/",
        "<link rel=canonical href='&#104;ttp&colon;&sol;&#x2F;b.org/es/1?a=1&amp;b=2&copy=&#x1F600;&nosuch;'>": "http://b.org/es/1?a=1&b=2&copy=\U0001f600&nosuch;",
        "<base target=x><base href='http://b.org/es/'><base href='http://c.org/'><link rel=canonical href=1>": "http://b.org/es/1",
        "<link rel=canonical href='q'><base href='/es/x'>": "http://a.org/es/q",
        "<link rel=canonical href=' http://b.\norg/es/1 '>": "http://b.org/es/1",
        "<meta http-equiv=Refresh content='0;http://b.org/es/1'>": "http://b.org/es/1",
        "<meta content=\"3, URL = 'http://b.org/es/1' x\" http-equiv=refresh>": "http://b.org/es/1",
    }
    rows = [(f"http://a.org/fr/{i}", html) for i, html in enumerate(pages)] + [("http://a.org/fr/null", None), (None, BLOCKED), ("http://a.org/fr/long", "<p title='" + "x" * 300_000 + "'>" + "<i>" * 100_000 + BLOCKED)]
    rows += [("http://a.org/fr/two", "<base href='http://b.org/es/'><link rel=canonical href=1>"), ("http://a.org/fr/two", "<link rel=canonical href=1>")] * 2
    edges = urlfilter.alias_edges(spark.createDataFrame(rows, "url string, html string")).collect()
    assert {r.dst for r in edges if r.src == "http://a.org/fr/two"} == {"http://b.org/es/1", "http://a.org/fr/1"}
    got = {r.src: r.dst for r in edges if r.src != "http://a.org/fr/two"}
    expected = {f"http://a.org/fr/{i}": to for i, to in enumerate(pages.values()) if to} | {"http://a.org/fr/long": "http://b.org/es/1"}
    assert got == expected
