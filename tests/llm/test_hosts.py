from pyspark.sql import functions as F

from quillsieve.llm import hosts

RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def rule_of(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, tail = rest[:cut], rest[cut:]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    fits = [(len(h + p), v, h + p) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[2] if fits else None, max(fits)[1] if fits else None


URLS = [None, "", "nothing", "http://", "http://COM", "http://com/", "https://x.Com/a?b#c", "http://example.com/en", "http://example.com/en/1", "http://m.www.example.com/en/?q", "http://notexample.com/en/", "http://a.net/es/#x", "http://a.net/fr/", "http://net?fr/", "ftp://u@É.net:80/fr/x", "x\ny://Q.com/\n/z?k", "http://a.org/://com/"]


def test_rules(spark):
    pages = spark.createDataFrame([(i, u, "html") for i, u in enumerate(URLS)] + [(None, "http://a.b.org/", None), (0, None, None)], "page_id long, url string, HOST string")
    labels = spark.createDataFrame([], "page_id long, bad int")
    got = [r for r in hosts.judge_urls(pages, labels).collect() if r.page_id is not None]
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule, verdict = rule_of(URLS[r.page_id])
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, rule, verdict or "allow")


def test_reputation_shrinks_by_level(spark):
    rows, labels = [], []
    for d in range(30):
        for h in range(4):
            for k in range(10):
                i = len(rows)
                rows.append((i, f"http://h{h}.d{d}.org/{k}"))
                if k < 8:
                    labels.append((i, int(d < 6) if h else int(d == 0)))
    rows.append((9999, "http://new.d0.org/"))
    rows.append((9998, "http://new.d20.org/"))
    got = hosts.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, "page_id long, bad int"))
    verdict = {r.page_id: r.verdict for r in got.collect()}
    assert verdict[9998] == "allow"
    assert all(verdict[i] == "block" for i, (_, u) in enumerate(rows[:40]) if "h0" not in u)
    assert all(verdict[i] == "allow" for i, u in rows[:1200] if int(u.split(".d")[1].split(".")[0]) >= 6)


def test_parts(spark):
    row = spark.createDataFrame([("u@www.a.co.uk:80", "10.0.0.1", "b.org", "")], "a string, b string, c string, d string")
    got = row.select(*[hosts.domain_of(F.col(c)) for c in "abcd"], *[hosts.suffix_of(hosts.domain_of(F.col(c))) for c in "abcd"]).first()
    assert tuple(got) == ("a.co.uk", "10.0.0.1", "b.org", "", "co.uk", "", "org", "")
