import re
from collections import defaultdict

from docweave.llm import urls


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :]).group()


def rule(host, path):
    fits = [(len(t), t, v) for v, t in urls.RULES if (host == t.split("/", 1)[0] or host.endswith("." + t.split("/", 1)[0])) and path.startswith("/" + t.split("/", 1)[1])]
    return max(fits)[1:] if fits else (None, None)


def brute(all_urls):
    """Templates and verdicts of all pages, one host and node at a time."""
    rows = []
    for u in all_urls:
        host, path = split(u)
        shape = re.sub(r"(?<![0-9A-Za-z])(?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{8,}(?![0-9A-Za-z])", "{hex}", path)
        shape = re.sub("[0-9]+", "{n}", shape)
        pieces = (shape[1:] if shape.startswith("/") else shape).split("/")
        rows.append({"host": host, "path": path, "rule": rule(host, path), "pieces": pieces, "template": ""})
    for level in range(max(len(r["pieces"]) for r in rows)):
        nodes = defaultdict(lambda: defaultdict(list))
        for r in rows:
            if len(r["pieces"]) > level:
                nodes[r["host"], r["template"]][r["pieces"][level]].append(r)
        for children in nodes.values():
            everyone = [r for c in children.values() for r in c]
            of = lambda rs: [sum(r["rule"][1] == k for r in rs) for k in ("block", "allow", None)]
            whole, n = of(everyone), len(everyone)
            named = {}
            for segment, own in children.items():
                p = len(own) / n
                chi = sum((o - w * p) ** 2 / (w * p * (1 - p)) for o, w in zip(of(own), whole) if w > 0 and p < 1)
                if not (len(own) >= urls.COUNT and len(own) >= urls.SHARE * n):
                    named[segment] = re.sub(r"[^/{}.\-_]*[^/{}.\-_n0-9][^/{}.\-_]*", "*", segment)
                else:
                    named[segment] = "+" if chi < urls.DIFFERENT else "=" + segment
            for segment, own in children.items():
                for r in own:
                    r["template"] += "/" + named[segment]
    groups = defaultdict(list)
    for r in rows:
        groups[r["host"], r["template"]].append(r["rule"][1])
    for r in rows:
        g = groups[r["host"], r["template"]]
        r["purity"] = (g.count("block") + 1) / (len(g) - g.count(None) + 2)
        r["verdict"] = r["rule"][1] or ("block" if r["purity"] >= urls.PURITY else "allow")
    return rows


EXTRA = [None, "", "x", "http://", "HTTP://A.Example.NET", "http://a.net?x=/en/", "https://Example.com/de/1", "https://example.com/de", "https://notexample.com/de/1", "https://x.org/fr/", "https://x.org/fr", "ftp://h/a/b/c/d/e/f/g/h/i/j/k/1", "http://h//a//", "http://h/deadbeef01/xdeadbeef01", "a://b://c/d"]


def check(spark, all_urls):
    df = spark.createDataFrame(list(enumerate(all_urls)) + [(None, "http://h/1")], "page_id long, url string")
    want = brute(all_urls + ["http://h/1"])
    got = urls.judge(df.withColumn("host", df.url)).collect()
    assert len(got) == len(want)
    for r in got:
        w = want[r.page_id if r.page_id is not None else -1]
        assert (r.host, r.path, r.rule, r.template, r.verdict) == (w["host"], w["path"], w["rule"][0], w["template"], w["verdict"]), r
        assert abs(r.purity - w["purity"]) < 1e-12


def test_same_as_brute_force(spark, sf_dir):
    pages = [r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("url").collect()]
    check(spark, pages * 3 + EXTRA)


def test_mixed_template_is_rejected_by_purity(spark):
    bad = [f"http://s.example.com/de/{k}" for k in range(200)] + [f"http://s.example.com/shop/item-{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)]
    check(spark, bad + EXTRA)


def test_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_deep_paths(spark):
    deep = [f"http://s.example.com/de/a/b/c/d/e/f/g/h/i/{'x' if k % 2 else 'y'}/{k}" for k in range(40)] + [f"http://d.net/{'/'.join(['p'] * 12)}/{chr(97 + k)}" for k in range(4)]
    check(spark, deep + EXTRA + ["http://one.net/" + "/".join(f"s{k}q" for k in range(60)), "http://one.net/" + "very" * 20_000])
