import math
import random
import re
import zlib

import numpy as np

from driftline.llm.urlfilter import ORDERS, RULES, SLOTS, SMOOTHING, Grams, filter_urls, log_ratio, threshold_of


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest)[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), re.split("[?#]", rest[len(host) :])[0]


def rule(host, path):
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def plain_log_ratio(url, by_class):
    """The same chain, with counts of the exact grams in dictionaries."""
    total = 0.0
    for sign, counts in ((-1, by_class[0]), (1, by_class[1])):
        padded = b"\x02" * (ORDERS - 1) + url
        for i in range(ORDERS - 1, len(padded)):
            p = 1 / 256
            for k in range(ORDERS):
                context = padded[i - k : i]
                p = (counts.get((k, context + padded[i : i + 1]), 0) + SMOOTHING * p) / (counts.get((k, context, "c"), 0) + SMOOTHING)
            total += sign * math.log(p)
    return total / max(1, len(url))


def test_models_against_plain_counts():
    r = random.Random(1)
    urls = [f"http{r.choice(('', 's'))}://{''.join(r.choice('abcde') for _ in range(6))}.example.{r.choice(('net', 'org'))}/{r.randint(0, 99)}".encode() for _ in range(60)]
    model, plain = np.zeros((2, ORDERS, 2, SLOTS)), ({}, {})
    for j, u in enumerate(urls):
        c = j % 2
        g = Grams([u])
        padded = b"\x02" * (ORDERS - 1) + u
        for k in range(ORDERS):
            np.add.at(model[c, k, 0], g.gram[k], 1)
            np.add.at(model[c, k, 1], g.context[k], 1)
            for i in range(ORDERS - 1, len(padded)):
                for key in ((k, padded[i - k : i + 1]), (k, padded[i - k : i], "c")):
                    plain[c][key] = plain[c].get(key, 0) + 1
    tried = [*urls[:10], b"", b"x", "http://é.example.org/".encode()]
    got = log_ratio(tried, model)
    assert np.abs(got - [plain_log_ratio(u, plain) for u in tried]).max() < 0.05  # hashed grams may meet
    assert got[10] == 0


def test_threshold():
    assert threshold_of({}) == threshold_of({(True, 5): 3}) == 0.0
    t = threshold_of({(False, -100): 10, (True, 100): 10})
    assert -0.2 < t <= 0.2


def test_query_on_odd_urls(spark):
    urls = ["http://a.net/x", "http://net/", "http://NET/x", "https://www.Example.net/en/1", "http://example.net/en", "http://example.net/en/", "http://badexample.net/en/", "http://example.com/de/x?u=1", "http://example.com/DE/x", "http://x.org/fr/", "http://org/fr/a#b", "http://org?fr/", "http://a.net", "no scheme", "://h/p", "http://", "", None, "http://h.com/a://b.net/c", "http://user@host.net:80/p", "x" * 5000, "http://é.net/é", "http://a.net/x", "a\nb://c.net/d\ne?f"]
    pages = spark.createDataFrame([(i, u, "<html>", 1, "x") for i, u in enumerate(urls)] + [(None, None, None, None, None)], "page_id bigint, url string, html string, score int, rule string")
    got = {r.page_id: r for r in filter_urls(pages).collect()}
    for i, u in enumerate(urls):
        host, path = parts(u)
        name, verdict = rule(host, path)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, name), u
        assert got[i].verdict == (verdict or got[i].verdict) and got[i].verdict in ("allow", "block")
    assert len(got) == len(urls) + 1
    assert filter_urls(pages.limit(0)).count() == 0


def test_models_tell_what_labels_say(spark):
    r = random.Random(4)
    rows = [(i, f"https://{'spam' if i % 2 else 'news'}{r.randint(0, 999)}.example.com/{r.randint(0, 999)}") for i in range(400)]
    judged = spark.createDataFrame([(u, i % 2 == 0) for i, u in rows], "url string, accepted boolean")
    got = filter_urls(spark.createDataFrame(rows, "page_id bigint, url string"), judged=judged).collect()
    assert sum((x.verdict == "allow") == (x.page_id % 2 == 0) for x in got) / len(got) > 0.98


def test_scores_are_those_of_exact_counts_however_many_grams_there_are(spark):
    r = random.Random(6)
    urls = [f"https://{''.join(r.choice('abcdefghijklmnopqrstuvwxyz0123456789-') for _ in range(40))}.com/" for _ in range(6000)]
    judged = spark.createDataFrame([(u, i % 2 == 0) for i, u in enumerate(urls)], "url string, accepted boolean")
    pages = [(i, u) for i, u in enumerate(urls[:60])] + [(60, ""), (61, "http://é/x")]
    plain, grams = ({}, {}), set()
    for j, u in enumerate(urls):
        if zlib.crc32(u.encode()) % 5:
            padded = b"\x02" * (ORDERS - 1) + u.encode()
            for k in range(ORDERS):
                for i in range(ORDERS - 1, len(padded)):
                    grams.add((k, padded[i - k : i + 1]))
                    for key in ((k, padded[i - k : i + 1]), (k, padded[i - k : i], "c")):
                        c = int(j % 2 == 0)
                        plain[c][key] = plain[c].get(key, 0) + 1
    assert len(grams) > 4 * SLOTS
    for x in filter_urls(spark.createDataFrame(pages, "page_id bigint, url string"), judged=judged).collect():
        assert abs(x.score - plain_log_ratio(dict(pages)[x.page_id].encode(), plain)) < 1e-9
