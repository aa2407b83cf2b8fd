"""Path rules and substrings as automata, against patterns one by one."""

import pickle
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from webloom.operators import robots, technology
from webloom.operators.automata import PathRules, Substrings


def plain(rules, path):
    """Every rule's own expression, the longest first."""
    hits = []
    for allow, pattern in rules:
        body, end = (pattern[:-1], r"\Z") if pattern.endswith("$") else (pattern, "")
        if re.match("(?s:" + ".*".join(map(re.escape, body.split("*"))) + end + ")", path):
            hits.append((len(pattern), allow, pattern))
    return max(hits, default=None)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 1), st.text("/ab*$.", min_size=1, max_size=6)), max_size=12), st.lists(st.text("/ab$.x", max_size=9), max_size=6))
def test_rules_decide_as_one_by_one(rules, paths):
    automaton = pickle.loads(pickle.dumps(PathRules(rules)))
    for path in paths:
        assert automaton.match(path) == plain(rules, path)


def test_kept_states_are_bounded(monkeypatch):
    from webloom.operators import automata

    monkeypatch.setattr(automata, "KEPT_STATES", 3)
    rules = [(1, "/a*b*c"), (0, "/*d$")]
    automaton = PathRules(rules)
    for path in ("/abc", "/aad", "/xd", "/a1b2c3", "/d", "/dd", "/"):
        assert automaton.match(path) == plain(rules, path)


def test_time_does_not_grow_with_rules():
    def took(n):
        automaton = PathRules([(k % 2, f"/shop/{k}/*.html$") for k in range(n)] + [(0, f"/*/part{k}") for k in range(n)])
        paths = [f"/shop/{k % n}/item{k}.html" for k in range(3000)]
        best = 9.0
        for _ in range(3):
            automaton._forget()
            began = time.perf_counter()
            for p in paths:
                automaton.match(p)
            best = min(best, time.perf_counter() - began)
        return best

    assert took(10_000) < 20 * took(100)  # a hundred times the rules


@pytest.fixture
def rules(spark):
    rows = [(f"s{k % 3}", "*" if k % 2 else "webloom", "allow" if k % 5 == 0 else "disallow", f"/p{k % 50}/" + ("*.x$" if k % 4 == 0 else str(k))) for k in range(600)]
    rows += [("s0", "other", "disallow", "/"), ("s0", "*", "disallow", ""), ("s0", "*", "sitemap", "https://s/x"), ("s1", "*", "allow", "/p1/"), ("s1", "*", "disallow", "/p1/")]
    return spark.createDataFrame(rows, "site string, user_agent string, kind string, value string")


@pytest.mark.parametrize("here", [True, False])
def test_allowed_by_site(spark, rules, monkeypatch, here):
    if not here:
        monkeypatch.setattr(robots, "BROADCAST_BYTES", 0)
    urls = [(f"s{k % 4}", f"https://h/p{k % 50}/{k}" + (".x" if k % 3 == 0 else "?q=1" if k % 3 == 1 else "")) for k in range(900)] * 2 + [("s1", "https://h/p1/"), (None, "https://h/p1/"), ("s0", None), ("s0", "")]
    pages = spark.createDataFrame(urls, "site string, url string").withColumn("pattern_before", F.lit(1))
    found = sorted(((r["site"], r["url"], r["allowed"], r["pattern"]) for r in robots.allowed(pages, rules, "Webloom", site="site").collect()), key=str)
    by_site = {}
    for r in rules.collect():
        if r["user_agent"] in ("*", "webloom") and r["kind"] in ("allow", "disallow") and r["value"]:
            by_site.setdefault(r["site"], []).append((int(r["kind"] == "allow"), r["value"]))
    want = []
    for site, url in urls:
        hit = plain(by_site.get(site, []), (url or "").removeprefix("https://h")) if url else None
        want.append((site, url, hit is None or hit[1] == 1, hit and hit[2]))
    assert found == sorted(want, key=str)


def test_substrings_of_a_text():
    words = ["he", "she", "hers", "", "he", "ß", "a.b"]
    find = Substrings(words).find
    for text in ("", "ushers", "he", "Straße a.b", "axb", None):
        assert find(text) == ([] if text is None else [k for k, w in enumerate(words) if w in text])
    assert Substrings([]).find("x") == [] and Substrings([""]).find("x") == [0]


def test_technologies_by_thousands_of_rules(spark):
    rules = technology.RULES + [(f"T{k}", "More", "low", k % 2 == 0, k % 3 == 0, (f"lib{k}-", f"Pkg{k}.js")) for k in range(3000)]
    rows = [("p1", "https://c/react.js", "javascript"), ("p1", "https://c/LIB30-x", "css"), ("p2", "https://c/lib31-x", "css"), ("p2", "https://c/pkg2000.js", "javascript"), ("p2", "https://c/Pkg2001.js", "css"), ("p3", None, "css"), ("p3", "https://c/aem.js", None)]
    resources = spark.createDataFrame(rows, "page string, url string, type string")
    want = set()
    for page, url, kind in rows:
        for name, category, confidence, scripts, case, words in rules:
            text = (url or "") if case else (url or "").lower()
            if any(w in text for w in words) and (not scripts or kind == "javascript"):
                want.add((page, category, name, confidence))
    assert {tuple(r) for r in technology.detect(resources, ["page"], rules).collect()} == want
    assert {tuple(r) for r in technology.detect(resources).collect()} == {("Framework", "React", "high")}
