import fnmatch
import re

import check
import pytest
from helpers import SF

from tallymart.llm import queries, url_filters as uf

URLS = [
    None, "", "no scheme/org/", "http://example.org", "http://example.org/", "HTTP://M.Example.ORG/es/1", "x://example.org/en/12?a=/de/", "x://example.org/en/2",
    "x://notexample.org/es/", "x://a.com/fr/", "x://a.com/de/x#y", "x://a.com/fr", "x://com/de/", "x://a.net?b/c", "x://a.net#q/c", "x://ads.x.net/", "x://a.net/login",
    "x://a.net/f.zip?x", "x://ü.net/" + "ä/" * 3000 + ".exe", "a://b://c.org/", "://org/", "x://a.net/*.zip", "x://a.gov/x.zip", "x://É.org/",
]


def plain(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = m.groups() if m else ("", "")
    host = re.sub("[A-Z]", lambda x: x[0].lower(), host)
    fits = [(len(r), r, v) for v, r in uf.BASE_RULES if ("." + host).endswith("." + r.partition("/")[0]) and path.startswith("/" + r.partition("/")[2])]
    if fits:
        return host, path, max(fits)[1], max(fits)[2]
    quote = lambda g: "*".join(re.escape(p) for p in g.split("*")).replace("*", "(?s:.*)")
    own = [(len(g), v) for v, g in uf.OWN_GLOBS if re.fullmatch(quote(g), f".{host}?{path}")]
    return host, path, None, max(own)[1] if own else uf.DEFAULT


@pytest.mark.parametrize("url", URLS)
def test_split(url):
    assert uf.split_url(url) == plain(url)[:2]


def test_judge_against_brute_force(spark):
    pages = spark.createDataFrame([(k, u, "v") for k, u in enumerate(URLS * 2)], "page_id long, url string, verdict string")
    got = uf.judge(pages).drop("glob").collect()
    assert {(r["page_id"], *tuple(r)[1:]) for r in got} == {(k, *plain(u)) for k, u in enumerate(URLS * 2)}
    assert uf.judge(pages.limit(0)).count() == 0


def test_many_rules_span_words(spark):
    globs = [f"*{'ab'[k % 2]}*{k}?x*{'q' * (k % 40)}" for k in range(120)]
    texts = [f"za{k}?xx{'q' * j}" for k in range(0, 120, 7) for j in (0, 5, 39)]
    got = uf.Automaton.of(globs).accepts([t.encode() for t in texts])
    for t, row in zip(texts, got):
        assert [fnmatch.fnmatchcase(t, g.replace("?", "[?]")) for g in globs] == row.tolist()


def test_query_matches_oracle(spark):
    name = "op7_url_filters"
    assert check.compare(spark, check.connect(SF), SF, queries.QUERIES[name], queries.ORACLES[name]) is None
