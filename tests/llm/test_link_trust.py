import random
import re

from churnkit.llm.link_trust import filter_urls

RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("com", "/de/", "block"), ("com", "/fr/", "allow")]


def brute(pages, threshold=0.75, damping=0.85, rounds=20):
    rows = []
    for pid, url, html in pages:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest, re.S).group(0)
        path = re.match(r"[^?#]*", rest[len(host):], re.S).group(0)
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fit = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fit, default=(0, None, None))
        rows.append([pid, host, path, rule, verdict, html])
    edges = {}
    for _, host, _, _, _, html in rows:
        for link in set(re.findall(r"""\b(?:href|src)\s*=\s*["']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^/?#"'\s>]*)""", html or "", re.I)):
            t = link.split("//", 1)[1].lower()
            if host and t and t != host:
                edges[host, t] = edges.get((host, t), 0) + 1

    def rank(verdict, pairs):
        seed, out = {}, {}
        for r in rows:
            if r[4] == verdict and r[1]:
                seed[r[1]] = seed.get(r[1], 0) + 1
        total = sum(seed.values()) or 1
        seed = {h: n / total for h, n in seed.items()}
        for (a, _), n in pairs.items():
            out[a] = out.get(a, 0) + n
        r = dict(seed)
        for _ in range(rounds):
            new = {h: w * (1 - damping) for h, w in seed.items()}
            for (a, b), n in pairs.items():
                if a in r:
                    new[b] = new.get(b, 0) + r[a] * n / out[a] * damping
            r = new
        return r
    good, bad = rank("allow", edges), rank("block", {(b, a): n for (a, b), n in edges.items()})
    out = []
    for pid, host, path, rule, verdict, _ in rows:
        t, d = good.get(host, 0), bad.get(host, 0)
        out.append((pid, host, path, rule, verdict or ("block" if d > threshold * (t + d) else "allow")))
    return sorted(out, key=repr)


def run(spark, pages):
    df = spark.createDataFrame([(*p, "x", 0.5) for p in pages], "page_id long, url string, html string, host string, trust double").repartition(3)
    got = filter_urls(df, RULES).select("page_id", "host", "path", "rule", "verdict").collect()
    return sorted((tuple(r) for r in got), key=repr)


def test_matches_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.org", "B.example.org", "c.com", "d.com", "e.net", "f.net", "g.net", "h.net", "com", "notcom"]
    pages = []
    for i in range(120):
        h = rng.choice(hosts)
        url = f"https://{h}/{rng.choice(['de', 'fr', 'en', 'es'])}/{i}" + rng.choice(["", "?q=/x", "#y"])
        near = hosts[4:] if h[0] in "efgh" else hosts
        html = "".join(f'<a href={q}{s}//{rng.choice(near)}/p{q}>' for q, s in rng.choices([('"', "http:"), ("'", "HTTPS:"), ("", ""), ('"', "")], k=rng.randint(0, 3)))
        pages.append((i, url, html + '<a href="/local">'))
    pages += [(200, None, None), (201, "no scheme", '<a href="//e.net">'), (202, "x://", ""), (203, "http://A.ORG?x/", None), (204, "http://c.com/de/\nx#", ""),
              (None, "http://g.net/", '<img src = "//c.com">'), (5, pages[5][1], pages[5][2]), (5, pages[5][1], pages[5][2])]
    pages += [(300, "http://blocked.com/de/1", ""), (301, "http://bad.net/x", '<a href="http://blocked.com/">')]
    got = run(spark, pages)
    assert got == brute(pages)
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_no_links_and_no_pages(spark):
    pages = [(1, "http://c.com/de/1", ""), (2, "http://c.com/en/1", None), (3, "http://z.net/", "")]
    assert run(spark, pages) == brute(pages)
    assert run(spark, []) == []
