import random
import re

from postmill.llm import urls
from postmill.llm.queries import URL_RULES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return None
    host, path, query = re.match(r"(?s)([^/?#]*)([^?#]*)([^#]*)", url.split("://", 1)[1]).groups()
    return host.translate(LOWER), path, query


def by_rule(place, rules):
    best = None
    for action, host, path in rules:
        if place and (place[0] == host or place[0].endswith("." + host)) and place[1].startswith(path):
            best = max(best or (0,), (len(host) + len(path), len(host), action == "allow", host + path, action))
    return (best[3], best[4]) if best else (None, None)


def brute(pages, links, rules):
    node = lambda u: "".join(parts(u)) if parts(u) else None
    around = {}
    for a, b in links:
        if node(a) and node(b) and node(a) != node(b):
            around.setdefault(node(a), set()).add(node(b))
            around.setdefault(node(b), set()).add(node(a))
    blocked = [n for n in around if by_rule(parts("x://" + n), rules)[1] == "block"]
    reached = set(blocked)
    while blocked:
        more = around[blocked.pop()] - reached
        reached |= more
        blocked += more
    out = []
    for i, u in pages:
        rule, action = by_rule(parts(u), rules)
        host, path, _ = parts(u) or ("", "", "")
        out.append((i, host, path, rule, action or ("block" if node(u) in reached else "allow")))
    return sorted(out, key=str)


def test_blocks_reach_aliases_and_allowed_ones_stay(spark):
    link = '<html><head><LINK href="{}" rel="Canonical"></head></html>'
    refresh = "<meta http-equiv='refresh' content=\"0; url='{}'\">"
    pages = [
        (1, "https://a.example.net/es/1", link.format("https://a.example.org/de/1")),         # blocked, points to 2
        (2, "http://a.example.org/de/1#part", refresh.format("/de/2?x=1&amp;y=2")),          # same node as its target
        (3, "https://A.EXAMPLE.org/de/2?x=1&y=2", None),
        (4, "https://www.example.com/en/9", link.format("https://b.example.com/en/9")),       # allowed, its alias is blocked
        (5, "https://b.example.com/en/9", ""), (6, "https://b.example.com/de/9", link.format("../en/9")),
        (7, "https://c.example.org/en/9", "<!-- " + link.format("https://b.example.com/en/9") + " -->"),
        (8, "https://c.example.org/x", "<script>var s='" + link.format("https://b.example.com/en/9") + "'</script>"),
        (9, None, link.format("https://b.example.com/en/9")), (10, "no address", link.format("https://b.example.com/en/9")), (11, "", None),
        (12, "https://d.example.org", link.format("//e.example.org/q")), (13, "https://e.example.org/q", refresh.format("https://f.net/fr/")),
        (14, "https://net", None), (15, "https://net/fr/", None), (16, "x://inet/fr/1", None), (17, "https://com?x", None),
        (18, "https://g.example.org/a/b", '<link rel="stylesheet" href="https://f.net/fr/">'), (19, "https://h.org/a/b", link.format("c?d")),
        (20, "https://h.org/a/c?d", link.format("https://f.net/fr/#z")), (21, "https://u@i.com:80/en/", link.format("mailto:x@y")),
        (None, "https://h.org/a/b", None), (1, "https://h.org/a/c?d#e", None), (22, "https://" + "a." * 20_000 + "net/es/", None),
        (23, "https://j.org/" + "x" * 70_000, link.format("?" + "y" * 70_000)), (24, "a://b://c.net/fr/", None), (25, "http://k.org/\n/es/", None)]
    links = [(pages[0][1], "https://a.example.org/de/1"), (pages[1][1], pages[2][1]), (pages[3][1], pages[4][1]), (pages[5][1], "https://b.example.com/de/../en/9"),
             (pages[11][1], pages[12][1]), (pages[12][1], pages[14][1]), (pages[18][1], pages[19][1]), (pages[19][1], pages[14][1]),
             (pages[-3][1], pages[-3][1] + "?" + "y" * 70_000)]
    table = spark.createDataFrame([(*p, "x", "x") for p in pages], "page_id long, url string, html string, host string, verdict string").repartition(3)
    rules = urls.rule_table(spark, URL_RULES)
    got = sorted((tuple(r)[:5] for r in urls.judge(table, rules).collect()), key=str)
    assert got == brute([p[:2] for p in pages], links, URL_RULES)
    verdict = {r[0]: r[4] for r in got}
    assert [verdict[i] for i in (2, 3, 4, 5, 6, 7, 8, 9, 12, 13, 19, 20)] == [
        "block", "block", "allow", "block", "allow", "allow", "allow", "allow", "block", "block", "block", "block"]
    assert urls.judge(table.limit(0), rules).count() == 0
    assert {r["verdict"] for r in urls.judge(table, rules.limit(0)).collect()} == {"allow"}


def test_large_classes_and_many_rules_match_brute_force(spark):
    rng = random.Random(3)
    hosts = [f"{a}{b}.{c}" for a in ("", "www.", "m.") for b in "xyz" for c in ("com", "org", "co.uk")]
    pages = [(i, f"https://{rng.choice(hosts)}/{rng.choice('abc')}/{rng.randrange(300)}", None) for i in range(600)]
    hub = "https://hub.org/"
    redirects = [(p[1], hub) for p in pages[:200]] + [(rng.choice(pages)[1], rng.choice(pages)[1]) for _ in range(150)] + [(None, hub), (hub, None)]
    rules = [(rng.choice(["allow", "block"]), rng.choice([*hosts, "com", "uk"]), rng.choice(["", "/", "/a/", "/a/1", "/b/2", "/c"])) for _ in range(40)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)
    moved = spark.createDataFrame(redirects, "source string, target string")
    odd = spark.createDataFrame([("block", None, "/"), (None, "com", "/"), ("block", "com", None)], "action string, host string, path string")
    got = urls.judge(table, urls.rule_table(spark, rules).unionAll(odd), redirects=moved).drop("component").collect()
    want = brute([p[:2] for p in pages], redirects, rules)
    assert sorted(map(tuple, got), key=str) == want
    assert sum(w[3] is None and w[4] == "block" for w in want) > 20
