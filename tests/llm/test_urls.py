import math
import re
from collections import Counter

import pytest

from loomstore.llm import urls as U


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), re.match(r"[^?#]*", rest[len(host) :])[0]


def rule(host, path):
    best = None
    for kind, h, p in U.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, kind)
    return best or (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://A.COM/en/x", "http://a.com/en", "http://a.com/EN/1", "http://com/en/", "http://xcom/en/", "http://example.com/en/712?q#f", "http://b.example.com/en/7", "http://example.com/en/8",
        "http://x.net/de/1", "http://example.net/de/8", "http://example.net/de/80", "http://example.net/de/7", "http://x.org/es/", "http://x.org?/es/", "http://x.org#a/b", "http://u:p@x.org/es/1", "ftp://x.org:80/es/1", "a://b://c.org/es/1", "http://ünï.com/en/é", "http://x.net/de/\n1", "http://x.com/" + "y" * 5000]


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "x", "y") for i, u in rows], "page_id bigint, url string, rule string, figure string")


def test_hosts_paths_and_rules(spark):
    rows = list(enumerate(URLS)) + [(3, URLS[9]), (None, URLS[12])]
    found = U.judge(pages(spark, rows)).collect()
    assert len(found) == len(rows)
    by = {i: u for i, u in rows if i is not None and i != 3}
    for r in found:
        if r["page_id"] in by:
            host, path = host_path(by[r["page_id"]])
            name, kind = rule(host, path)
            assert (r["host"], r["path"], r["rule"]) == (host, path, name), by[r["page_id"]]
            assert r["verdict"] == kind if kind else r["verdict"] in ("allow", "block")


def ratio(model_urls, url):
    """Mean log ratio by the longest known context, from counts alone."""
    fold = lambda u: re.sub(r"[^a-z0./:\-_?=&#%+~]", "*", re.sub("[0-9]", "0", u.lower()))
    counts, totals = Counter(), Counter()
    for accepted, u in model_urls:
        s = "^" * U.ORDER + fold(u)
        for i in range(U.ORDER, len(s)):
            for k in range(U.ORDER + 1):
                counts[accepted, s[i - k : i + 1]] += 1
                totals[accepted, k, s[i - k : i]] += 1

    def p(accepted, gram):
        k = len(gram) - 1
        below = 1 / len(U.SYMBOLS) if k == 0 else p(accepted, gram[1:])
        return (counts[accepted, gram] + U.PULL * below) / (totals[accepted, k, gram[:-1]] + U.PULL)

    s = "^" * U.ORDER + fold(url)
    out = []
    for i in range(U.ORDER, len(s)):
        for k in range(U.ORDER, -1, -1):
            gram = s[i - k : i + 1]
            known = counts[True, gram] + counts[False, gram]
            if known and (k == 0 or totals[True, k, gram[:-1]] + totals[False, k, gram[:-1]] >= U.MIN_CONTEXT):
                out.append(math.log(p(True, gram)) - math.log(p(False, gram)))
                break
        else:
            out.append(0.0)
    return sum(out) / len(out)


@pytest.mark.parametrize("sent", [U.SENT, 0])
def test_figures_equal_brute_force(spark, monkeypatch, sent):
    monkeypatch.setattr(U, "SENT", sent)  # what is not broadcast is joined
    import hashlib

    urls = [f"http://{h}.net/de/{k}" for k in range(40) for h in ("good", "fine")] + [f"http://{h}.com/en/{k}x" for k in range(40) for h in ("spam", "junk")]
    open_ = ["http://good.info/de/1", "http://spam.info/xx", "q", "http://ZZZ.info/é"]
    found = {r["page_id"]: r for r in U.judge(pages(spark, list(enumerate(urls + open_)))).collect()}
    learned = [(rule(*host_path(u))[1] == "allow", u) for u in urls if hashlib.md5(u.encode()).hexdigest()[0] >= "4"]
    for i, u in enumerate(urls + open_):
        assert abs(found[i]["figure"] - ratio(learned, u)) < 1e-9, u
    assert found[len(urls)]["verdict"] == "allow" and found[len(urls) + 1]["verdict"] == "block"


def test_threshold_errs_least():
    assert U._threshold([(-5, 0, 4), (3, 5, 0)]) == -0.02
    assert U._threshold([(-5, 0, 4), (-1, 1, 9), (0, 2, 0), (3, 5, 0)]) == -0.01
    assert U._threshold([]) == 0.0


def test_no_model_and_empty_table(spark):
    assert {r["figure"] for r in U.judge(pages(spark, [(1, "http://x.net/de/1"), (2, "http://q.info/")])).collect()} == {0.0}
    assert U.judge(pages(spark, [])).count() == 0
