import re
from collections import defaultdict

from tagmill.llm import url_filter as U

PAGES = [
    (1, "https://A.Example.COM/en/x?y", ""), (2, "http://www.example.com/en/", None), (3, "http://b.com", "x"), (4, "http://b.com/", '<a href="//evil.net/p">'), (5, "http://shop.net/es/1", ""), (6, "http://shop.net/fr/1#a", ""),
    (7, "http://shop.net/en/1", '<a HREF=http://evil.net/q>'), (8, "http://linker.org/a", "<a href='https://shop.net/es/1'><a href='https://SHOP.net/x'>" + "<a href='/local'>"), (9, "http://good.org/a", '<a href="http://b.com/">'),
    (10, None, None), (11, "no scheme", ""), (12, "http://notcom/x", ""), (13, "http://xcom/y", ""), (14, "http://b.com?q=/en/", '<a href="http://good.org/z">'), (14, "http://b.com?q=/en/", '<a href="http://good.org/z">'), (15, "ftp://net/es/", ""),
]


def brute(pages, rules=U.RULES, damping=U.DAMPING):
    parsed = []
    for p, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        raw = re.match(r"[^/?#]*", rest)[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), raw)
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        fits = [(len(h + q), h + q, v) for h, q, v in rules if (host == h or host.endswith("." + h)) and path.startswith(q)]
        parsed.append((p, host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else None, html or ""))
    count, seeds = defaultdict(int), {"allow": defaultdict(int), "block": defaultdict(int)}
    edges = set()
    for _, host, _, _, verdict, html in parsed:
        count[host] += 1
        if verdict:
            seeds[verdict][host] += 1
        edges |= {(host, d.lower()) for d in re.findall(U.HREF, html) if d and d.lower() != host}
    mass = {}
    unit = {}
    for kind, arcs in (("allow", edges), ("block", {(b, a) for a, b in edges})):
        unit[kind] = U.SCALE * (100 - damping) // 100 // max(1, sum(seeds[kind].values()))
        base = {h: n * unit[kind] for h, n in seeds[kind].items()}
        out = defaultdict(int)
        for a, _ in arcs:
            out[a] += 1
        now = defaultdict(int, base)
        while True:  # to the fixed point
            nxt = defaultdict(int, base)
            for a, b in arcs:
                nxt[b] += now.get(a, 0) * damping // 100 // out[a]
            if nxt == now:
                break
            now = nxt
        mass[kind] = now
    bad = {h for h, n in count.items() if 2 * (mass["block"].get(h, 0) - mass["allow"].get(h, 0)) > n * unit["block"]}
    return sorted((p, host, path, rule or "", verdict or ("block" if host in bad else "allow")) for p, host, path, rule, verdict, _ in parsed)


def test_equals_brute_force(spark):
    df = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in U.judge(df, U.RULES).collect())
    assert got == brute(PAGES)
    by = {g[0]: g for g in got}
    assert by[1][3:] == ("example.com/en/", "block") and by[2][3:] == ("www.example.com/en/", "allow") and by[3][3:] == ("", "allow") and by[4][3:] == ("com/", "allow")
    assert by[8][4] == "block" and by[9][4] == "allow" and by[7][4] == "block" and by[12][3] == ""


def test_empty_table(spark):
    assert U.judge(spark.createDataFrame([], "page_id long, url string, html string"), U.RULES).count() == 0


def linked_pages():
    """Chains of several hops, a cycle, and a hub that links to and is linked by many."""
    link = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts)
    pages = [(100 + k, f"http://h{k}.org/", link(f"h{k + 1}.org")) for k in range(6)]
    pages += [(106, "http://h6.org/", link("h2.org", "shop.net")), (107, "http://shop.net/es/", link("h0.org"))]
    pages += [(200 + k, f"http://m{k}.org/", link("hub.org")) for k in range(40)]
    pages += [(300, "http://hub.org/", link("shop.net", *(f"m{k}.org" for k in range(0, 40, 2)))), (301, "http://x.com/", link("h3.org", "m7.org"))]
    pages += [(400 + k, "http://shop.net/es/x", None) for k in range(6)]
    return pages


def test_several_hops_to_the_fixed_point(spark, monkeypatch):
    from tagmill.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 5)  # the hub's links are hot
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    pages = [*PAGES, *linked_pages()]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string")
    got = sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in U.judge(df, U.RULES, 55).collect())
    assert got == brute(pages, damping=55)
    assert {g[4] for g in got if g[0] >= 100 and g[0] < 400 and g[0] != 107} == {"allow", "block"}


def test_many_rules_are_joined(spark, monkeypatch):
    pages = [*PAGES, (20, "http://a.b.c.d/p/q", None), (21, "http://c.d/p/", None), (22, "http://xc.d/p/", None), (23, "http:///p/", None)]
    rules = [*U.RULES, ("c.d", "/p/", "block"), ("b.c.d", "/", "allow"), ("a.b.c.d", "/p", "block"), ("d", "/p/q", "allow"), *((f"r{k}.org", "/", "allow") for k in range(60))]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    rows = lambda: sorted((r.page_id, r.host, r.path, r.rule or "", r.verdict) for r in U.judge(df, rules, 8).collect())
    few = rows()
    monkeypatch.setattr(U, "LITERAL_RULES", 5)
    assert rows() == few == brute(pages, rules, 8)
