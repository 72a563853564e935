"""Concatenated hosts end to end, and count tables that are whole at any number of words."""

import math

import pytest

from poplineage.llm import queries, urls

PROSE = "the day was long and the best farm had win after win so in the end they all went home " * 40


def judged(spark, hosts, texts):
    queries.importable(spark)
    pages = spark.createDataFrame([(k, f"http://{h}/x/{k}") for k, h in enumerate(hosts)], "page_id long, url string")
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    return {r.host: r for r in urls.filter_urls(pages, docs, queries.RULES).collect()}


def test_concatenated_hosts(spark):
    unwanted = {"freebets": "free bets", "bestcasino": "best casino", "cheappills": "cheap pills", "spamfarm": "spam farm", "casinowin": "casino win"}
    hosts = [f"{h}.example.xyz" for h in unwanted] + [f"{h}.example.xyz" for h in ("cheap-pills", "dayfarm", "homelong", "theday", "thebest")]
    found = judged(spark, hosts, [PROSE])
    for name, words in unwanted.items():
        row = found[f"{name}.example.xyz"]
        assert row.words.startswith(words + " ") and row.verdict == "block"
    assert all(found[f"{h}.example.xyz"].verdict == "allow" for h in ("dayfarm", "homelong", "theday"))
    assert found["dayfarm.example.xyz"].words.startswith("day farm ")


def test_whole_tables(spark):
    """Over 50,000 rarer words than those that count: the rare ones keep their counts and decide."""
    code = lambda k: "".join("abcdefghij"[int(c)] for c in f"{k:06d}")
    noise = " ".join(f"q{code(k)} q{code(k)}" for k in range(60_000))
    texts = ["zorp quib " + noise]
    hosts = [f"zorpquib.p{code(k)}.xyz" for k in range(3)] + [f"n{code(k)}.xyz" for k in range(60_000)] + ["n000.xyz"] + [f"n{code(k)}.xyz" for k in range(60_000)]
    found = judged(spark, hosts + ["rarename.casino.xyz", "rarename.xyz"], texts)
    assert found["zorpquib.p" + code(1) + ".xyz"].words.startswith("zorp quib ")
    # one blocked and one allowed URL against two allowed ones
    known, single = found["rarename.xyz"], found["n" + code(5) + ".xyz"]
    assert known.score - single.score == pytest.approx(math.log(2 / 2) - math.log(1 / 3))


def test_long_hosts(spark):
    """A host of 30,000 letters is split like a short one, in time that grows with its letters."""
    queries.importable(spark)
    long = "bestcasino" * 3000
    pages = spark.createDataFrame([(1, f"http://{long}/x"), (2, "http://bestcasino/x"), (3, "http://bücherbest.de/x")], "page_id long, url string")
    docs = spark.createDataFrame([("best " * 200 + "b cher de",)], "text string")
    found = {r.page_id: r for r in urls.filter_urls(pages, docs, ()).collect()}
    assert found[2].words.split() == ["best", "casino", "x"]
    assert found[1].words.split() == ["best", "casino"] * 3000 + ["x"]
    assert all(found[k].verdict in ("allow", "block") for k in found) and "best" in found[3].words.split()
