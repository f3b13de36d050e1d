import itertools
import math
import random
import re
from collections import Counter

import pytest

from lumenfold.llm import url_filter
from lumenfold.llm.queries import URL_RULES
from lumenfold.llm.url_filter import Rules, Segmenter, judged, train


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    path = rest[cut:].split("#")[0].split("?")[0]
    return rest[:cut].translate({i: i + 32 for i in range(65, 91)}), path


def rule_by_brute_force(host, path):
    fits = []
    for verdict, rule in URL_RULES:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fits.append((len(rule), rule, verdict))
    return max(fits)[1:] if fits else None


def test_rules_and_parts(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/1?x#y", "http://example.com/en", "http://a.example.com/en/", "http://www.example.com/en/q", "https://x.net/es/1", "https://x.net/de/1", "http://com/", "http://com", "http://a.com?q=/en/", "x://y://z/p", "http://É.com/a\nb"]
    r = random.Random(1)
    urls += [f"http://{r.choice(['', 'www.', 'blog.'])}{r.choice(['example', 'cheap-pills', 'net'])}.{r.choice(['com', 'net', 'org'])}/{r.choice(['en', 'es', 'fr', 'EN'])}/{i}" for i in range(60)]
    rows = [(i, u, "h") for i, u in enumerate(urls)] + [(None, urls[4], "h"), (3, urls[3], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = judged(pages, URL_RULES, train(pages, URL_RULES)).collect()
    assert len(got) == len(rows)
    by_url = {i: u for i, u, _ in rows}
    for g in got:
        host, path = parts(by_url[g.page_id])
        assert (g.host, g.path) == (host, path)
        want = rule_by_brute_force(host, path)
        assert g.rule == (want[0] if want else None)
        assert g.verdict in ("allow", "block")
        if want:
            assert g.verdict == want[1]
    none = pages.where("false")
    assert judged(none, URL_RULES, train(none, URL_RULES)).collect() == []


def test_longest_rule_wins():
    rules = Rules([("allow", "com/"), ("block", "a.com/x/"), ("allow", "a.com/x/y")])
    assert rules.find("b.a.com", "/x/yz") == ("a.com/x/y", "allow")
    assert rules.find("b.a.com", "/x/z") == ("a.com/x/", "block")
    assert rules.find("b.com", "/") == ("com/", "allow")
    assert rules.find("xcom", "/") is None


def test_viterbi_against_every_split():
    words = {"a": 3, "ab": 5, "b": 2, "abc": 1, "cab": 4}
    s = Segmenter(words)

    def price(split):
        return sum(s.cost.get(w, s.unknown + 2.5 * len(w)) for w in split)

    for name in ("abcab", "cababc", "xabx", "zz", "abab"):
        every = []
        for k in range(len(name)):
            for cuts in itertools.combinations(range(1, len(name)), k):
                at = [0, *cuts, len(name)]
                every.append([name[a:b] for a, b in itertools.pairwise(at)])
        assert price(s.split(name)) == pytest.approx(min(map(price, every)))
        assert "".join(s.split(name)) == name


NAMES = [("block", "pills.org/"), ("allow", "shoes.org/")]


def test_segmented_names(spark):
    hosts = ["cheap-pills.org", "best.pills.org", "cheap.pills.org", "red.shoes.org", "red-shoes.org", "blue.shoes.org", "blue-sky.net", "red-sky.net"]
    rows = [(i, f"http://{h}/en/{i}") for i, h in enumerate(hosts * 5)]
    model = train(spark.createDataFrame(rows, "page_id long, url string"), NAMES)
    assert model.segmenter.split("cheappills") == ["cheap", "pills"]
    assert model.score("cheappills.net", "/en/1") > 0.5 > model.score("redshoes.net", "/en/1")


def tokens_by_brute_force(segmenter, rules, host, path):
    labels = {x for _, rule in rules for x in rule.split("/")[0].split(".")}
    depth = max(rule.count("/") - 1 for _, rule in rules)
    names, suffix = host.split("."), []
    if names[-1] not in labels:
        suffix = ["t:" + names[-1]] if len(names) > 0 and names[-1] else []
        names = names[:-1]
    else:
        while names and names[-1] in labels:
            names.pop()
    rest = path
    for _ in range(depth):
        rest = re.sub(r"^/[^/]*/", "/", rest)
    out = suffix
    for mark, part in (("h:", ".".join(names)), ("p:", rest.lower())):
        for run in re.findall(r"[0-9]+|[a-z]+", part):
            out += [mark + "#"] if run.isdigit() else [mark + w for w in segmenter.split(run)]
    return out


def test_parts_that_rules_choose_by_teach_nothing(spark):
    rules = Rules(URL_RULES)
    assert rules.rest("www.red.example.com", "/en/fr/7/en") == ("www.red", "/fr/7/en")
    assert rules.rest("www.example.com", "/en") == ("", "/en")
    assert rules.rest("com.red.org", "/x/en/") == ("com.red.org", "/en/")
    assert rules.rest("", "") == ("", "/")
    urls = [f"http://{name}.{tld}/{code}/{i}" for i in range(40) for name in ("red", "blue") for tld in ("com", "net") for code in ("en", "es", "fr", "de")]
    model = train(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES)
    assert not {"t:com", "t:net", "p:en", "p:es", "p:fr", "p:de"} & set(model.odds)
    for code in ("en", "es", "fr", "de"):
        assert model.score("red.org", f"/{code}/1") == pytest.approx(model.score("red.org", "/en/1"))


def test_one_verdict_teaches_nothing(spark):
    pages = spark.createDataFrame([(1, "http://red.com/en/1"), (2, "http://red.org/en/1"), (3, None)], "page_id long, url string")
    for rule in ("allow", "block"):
        got = judged(pages, [(rule, "com/")], train(pages, [(rule, "com/")])).orderBy("page_id").collect()
        assert [r.verdict for r in got] == [rule, "allow", "allow"]
        assert [r.score for r in got] == [0.5] * 3


def test_words_of_compound_labels_split_names(spark):
    urls = ["http://www.casino-win.example.com/en/1", "http://free-bets.example.net/fr/2", "http://m.planet.example.org/fr/3"]
    model = train(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), URL_RULES)
    assert model.segmenter.split("casinowin") == ["casino", "win"]
    assert model.segmenter.split("freebets") == ["free", "bets"]
    assert model.segmenter.split("planet") == ["planet"]


def test_naive_bayes_against_brute_force(spark):
    r = random.Random(6)
    words = ["red", "blue", "pills", "shoes", "sky", "cheap", "best"]
    urls = [f"http://{r.choice(words)}{r.choice(['.', '-', ''])}{r.choice(words)}.{r.choice(['org', 'net', 'com'])}/{r.choice(['en', 'fr', '12'])}/{r.choice(words)}?q" for _ in range(300)] + [None, "no url", "http:///x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = [("block", "com/"), ("allow", "org/"), ("allow", "red.com/"), ("block", "sky.org/fr/")]
    model = train(pages, rules)
    known = Rules(rules)
    counts = {"block": Counter(), "allow": Counter()}
    for url in urls:
        host, path = parts(url)
        found = known.find(host, path) if host else None
        if found:
            counts[found[1]].update(tokens_by_brute_force(model.segmenter, rules, host, path))
    v = len(counts["block"] | counts["allow"])

    def log_share(side, t):
        return math.log((counts[side][t] + 0.5) / (sum(counts[side].values()) + 0.5 * v))

    got = {g.page_id: g for g in judged(pages, rules, model).collect()}
    for i, url in enumerate(urls):
        host, path = parts(url)
        own = tokens_by_brute_force(model.segmenter, rules, host, path)
        x = sum(log_share("block", t) - log_share("allow", t) for t in own if t in counts["block"] or t in counts["allow"])
        assert got[i].score == pytest.approx(1 / (1 + math.exp(-x)))
        found = known.find(host, path) if host else None
        assert got[i].verdict == (found[1] if found else "block" if got[i].score >= url_filter.BLOCK else "allow")


def test_no_rule_teaches_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c"), (2, None)], "page_id long, url string")
    assert [r.verdict for r in judged(pages, [], train(pages, [])).collect()] == ["allow", "allow"]


def test_words_in_and_of_long_runs(spark):
    s = Segmenter({"cheap": 5, "pills": 5, "b" * 80: 3})
    assert s.split("cheappills" * 30) == ["cheap", "pills"] * 30
    assert s.split("cheap" + "b" * 80 + "pills") == ["cheap", "b" * 80, "pills"]
    assert s.split("q" * 100_000) == ["q" * 100_000]
    long = "verylong" * 10
    rows = [(i, f"http://host{'xyz'[i]}.org/{long}/") for i in range(3)]
    assert train(spark.createDataFrame(rows, "page_id long, url string"), []).segmenter.split(long) == [long]


def test_rare_tokens_count_beyond_what_memory_holds(spark, monkeypatch):
    hosts = ["cheap.example-one.org", "red.shoes.org", "blue.shoes.org", "red-sky.org", "bluesky.net", "cheap.pills.org"]
    rows = [(i, f"http://{hosts[i % 6] if i % 40 else hosts[0]}/{'abcdefg'[i % 7] * 3}/redsky/{i}") for i in range(1, 201)] + [(None, None), (7, "x"), (7, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    key = lambda r: (r.page_id is None, r.page_id, r.host, r.path, r.rule, r.verdict, round(r.score, 9))
    want = sorted(map(key, judged(pages, NAMES, train(pages, NAMES)).collect()), key=str)
    assert {k[5] for k in want if k[2].startswith("cheap.example")} == {"block"}
    for name in ("TOKENS", "WORDS"):
        with monkeypatch.context() as m:
            m.setattr(url_filter, name, 3)
            assert sorted(map(key, judged(pages, NAMES, train(pages, NAMES)).collect()), key=str) == want
