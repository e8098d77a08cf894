import re
from collections import Counter, defaultdict
from math import sqrt

import pytest

from leadlens.llm import urls
from tests.conftest import SF_SMALL


def brute_split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.match(r"[^?#]*", rest[len(host):])[0]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def brute(pages, labels):
    """pages: (page_id, url, key); labels: (key, label)."""
    marks = defaultdict(Counter)
    for k, v in labels:
        marks[k][v] += 1
    rows = []
    for page, url, key in pages:
        host, path = brute_split(url)
        rows.append([page, host, path, marks[key][1] if key else 0, marks[key][0] if key else 0,
                     re.sub("^/", "", path).split("/"), ""])
    for level in range(min(urls.DEPTH, max((len(r[5]) for r in rows), default=0))):
        child, parent = defaultdict(lambda: [0, 0, 0]), defaultdict(lambda: [0, 0])
        for _, host, _, g, b, seg, t in rows:
            if len(seg) > level:
                for total, one in ((child[host, t, seg[level]], (1, g, b)), (parent[host, t], (g, b))):
                    for i, x in enumerate(one):
                        total[i] += x
        for r in rows:
            if len(r[5]) > level:
                n, g, b = child[r[1], r[6], r[5][level]]
                pg, pb = parent[r[1], r[6]]
                own, others, stays = g + b, pg + pb - g - b, False
                if n >= urls.SUPPORT and own >= 5 and others >= 5:
                    pooled = pg / (pg + pb)
                    stays = abs(g / own - (pg - g) / others) > urls.Z * sqrt(pooled * (1 - pooled) * (1 / own + 1 / others))
                r[6] += "/" + (r[5][level] if stays else "*")
    counts, hosts, every = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), [0, 0]
    for r in rows:
        if len(r[5]) > urls.DEPTH:
            r[6] += "/**"
        for total in (counts[r[1], r[6]], hosts[r[1]], every):
            total[0] += r[3]
            total[1] += r[4]
    prior = (every[0] + 1) / (sum(every) + 2)
    out = []
    for page, host, path, _, _, _, t in rows:
        rule, verdict = brute_rule(host, path)
        hp = (hosts[host][0] + urls.STRENGTH * prior) / (sum(hosts[host]) + urls.STRENGTH)
        purity = (counts[host, t][0] + urls.STRENGTH * hp) / (sum(counts[host, t]) + urls.STRENGTH)
        out.append((page, host, path, rule, verdict or ("allow" if purity >= urls.THRESHOLD else "block"), t, round(purity, 9)))
    return sorted(out, key=repr)


def run(spark, pages, labels):
    p = spark.createDataFrame([(*r, "x", 0) for r in pages], "page_id int, url string, label_key string, template string, good int").repartition(3)
    got = urls.judge(p, spark.createDataFrame(labels, "label_key string, label int"))
    return sorted(((*tuple(r)[:6], round(r.purity, 9)) for r in got.collect()), key=repr)


def test_tree_equals_brute_force(spark):
    pages, labels = [], []
    for i in range(600):
        branch = ("spam", "news", "blog")[i % 3]
        host = ("A.Example.net", "m.b.net", "b.com")[i % 2 if i < 400 else 2]
        tail = f"/{i}.html?x=/y" if i % 5 else f"/a/b/c/d/e/f/{i}#z"
        pages.append((i, f"http://{host}/{branch}{tail}", str(i)))
        if i % 4:
            labels.append((str(i), int(branch != "spam" and i % 11 > 0)))
    odd = [None, "", "nothing", "http://", "://x.org", "http://x.org/", "http://ORG?a", "https://de.example.org/es/1", "http://xexample.org/es/1",
           "http://example.org/en/12", "ftp://a.com/fr/:://b", "http://a.com/de/#x", "http://a.com//", "http://É.com/fr/x\ny", "http://x.org"]
    pages += [(1000 + i, u, None) for i, u in enumerate(odd)] + [(None, "http://a.example.net/spam/1", "1"), (3, pages[3][1], "3")]
    labels += [("1", 0), ("2", None), (None, 1), ("5", 7)]
    got = run(spark, pages, labels)
    assert got == brute(pages, labels)
    assert any("/spam" in r[5] and r[4] == "block" for r in got) and any(r[4] == "allow" and r[3] is None for r in got)


def test_empty(spark):
    assert run(spark, [], []) == []


def test_query_uses_no_python_on_the_executors(spark):
    got = urls.query(spark, SF_SMALL)
    plan = got._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    pages = spark.read.parquet(f"{SF_SMALL}/pages.parquet").collect()
    keyed = [(r.page_id, r.url, (re.search(r"([0-9]+)(?:\.[A-Za-z]+)?/?$", brute_split(r.url)[1]) or [None, None])[1]) for r in pages]
    labels = [(str(r.doc_id), r.quality) for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()]
    rows = sorted(((*tuple(r)[:6], round(r.purity, 9)) for r in got.collect()), key=repr)
    assert rows == brute(keyed, labels)


def test_branches_below_the_sixth_segment(spark):
    pages, labels = [], []
    for i in range(400):
        branch, other = ("spam", "news")[i % 2], ("x", "y")[i // 2 % 2]
        pages.append((i, f"http://a.net/a/b/c/d/e/f/{other}/{branch}/{i}", str(i)))
        labels.append((str(i), int(branch == "news")))
    pages.append((900, "http://a.net/" + "z/" * 50, None))
    got = run(spark, pages, labels)
    verdicts = {r[0]: (r[4], r[5]) for r in got}
    top = verdicts[0][1].split("/spam")[0]
    for i in range(400):
        branch, verdict = (("spam", "block"), ("news", "allow"))[i % 2]
        assert verdicts[i] == (verdict, f"{top}/{branch}/**")
    assert top == "/*/*/*/*/*/*/*" and verdicts[900][1] == "/*/*/*/*/*/*/**"


def test_a_document_is_named_by_its_whole_number(spark):
    given = [("http://a.b/x/0042.html", "42"), ("http://a.b/x/42/", "42"), ("http://a.b/9" + "0" * 17 + "42", "9" + "0" * 17 + "42"),
            ("http://a.b/" + "0" * 30 + "7", "7"), ("http://a.b/000", "0"), ("http://a.b/x7y", None), (None, None)]
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(given)], "i int, url string")
    got = [r.k for r in df.select("i", urls.document_key(df.url).alias("k")).orderBy("i").collect()]
    assert got == [k for _, k in given]
