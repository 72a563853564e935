"""Line quality, source divergence and fill-in-middle: odd rows against plain Python."""

import hashlib
import math
import random
import re
import sys
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

from poplineage.llm import divergence, fim, linecrf, queries  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts():
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [make(rng.randint(1, 60)) for _ in range(60)] + [make(20) + "\n" + make(5) + "\n\n" + make(9)] * 3
    texts += [None, "", " \n ", "é", "中文" * 30 + "\n" + "\U0001f600 x", "a<P>b", "<", "<S", "x<<M", "q" * 200_000, "Z" * 70 + " " + "z" * 70, "\n" * 5000 + "a"]
    texts += [make(40_000), "12 345 !?", "it's_ok [A-Z] `x`"]
    return texts


ROWS = [(k, t, ["en", "de", None][k % 3], ["s", "t", None, "é"][k % 7 % 4], 1) for k, t in enumerate(_texts())]
ROWS += [ROWS[4], ROWS[4], (None, ROWS[5][1], "en", "s", 1), (None, None, "xx", None, None), (900, "alone", "yy", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    queries.importable(spark)
    clash = {"llm_fim": F.lit(1), "llm_lines": F.lit("x"), "term": F.lit("y"), "n": F.lit(2), "score": F.lit(0.5)}
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns(clash)


def cut(doc_id, text, unit):
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    text = text or ""
    starts = range(len(text)) if unit == "chars" else [m.start() for m in re.finditer("\n", text)]
    n, places = len(starts), [*starts, len(text)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text[: places[a]], text[places[a] : places[b]], text[places[b] :]
    if h[3] % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize("unit", ["chars", "lines"])
def test_fill_in_middle(docs, unit):
    made = fim.fill_in_middle(docs, unit)
    assert made.columns == [c for c in docs.columns if c != fim.RESULT] + [fim.RESULT]
    held = F.col(fim.RESULT)
    rows = made.select("doc_id", "text", held["n"], held["form"], held["prefix_units"], held["middle_units"], held["output"], fim.restored(held["output"], held["form"])).collect()
    assert len(rows) == len(ROWS) and {r[3] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert tuple(r[2:7]) == cut(r[0], r[1], unit)
        assert r[7] == (r[1] or "")


def test_fill_in_middle_of_nothing(docs):
    assert fim.fill_in_middle(docs.limit(0)).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for size in (0, 1, 63, 64, 65, 1000):
        values = rng.integers(0, 8, size).astype(np.uint8)
        matrix = fim.WaveletMatrix(values, 3)
        at = np.arange(size + 1)
        for value in range(8):
            assert matrix.rank(value, at).tolist() == [int((values[:k] == value).sum()) for k in at]


def audited(rows, min_docs, top=50):
    """The audit in plain Python."""
    found, docs_with, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower)
        groups.add((lang, source))
        found[lang, source].update(terms)
        docs_with[lang].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs_with[lang].items() if n >= min_docs]

        def share(counts):
            total = sum(counts[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 5) // total for t in kept}

        sources = sorted(s for g, s in groups if g == lang)
        p = {s: share(found[lang, s]) for s in sources}
        q = share(sum((found[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(q[t] - p[s][t], t.encode(), t) for t in kept if found[lang, s][t] and p[s][t] > q[t]]
            out += [(lang, s, "pair", o, -v, k) for k, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, k) for k, (v, _, t) in enumerate(sorted(terms)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("min_docs", [1, 4, 12, 1000])
def test_audit(docs, min_docs, monkeypatch):
    """Repeated rows count one by one; small bounds make tables and blocks be cut."""
    if min_docs == 4:
        monkeypatch.setattr(divergence, "HELD_ROWS", 50)
        monkeypatch.setattr(divergence, "BLOCK_TERMS", 7)
        monkeypatch.setattr(divergence, "BLOCK_CELLS", 16)
    found = divergence.audit(docs, min_docs)
    assert sorted(tuple(r) for r in found.select("lang", "source", "part", "item", "value", "rank").collect()) == audited(ROWS, min_docs)


def test_audit_of_nothing(docs):
    assert divergence.audit(docs.limit(0)).count() == 0


def test_prefixes_are_counted_by_document(spark):
    """A prefix that two terms of one document share is one document of it; a term alone is under the bound."""
    queries.importable(spark)
    rows = [(k, "prefixone prefixtwo", "en", "s") for k in range(3)] + [(9, "prefixone other", "en", "t")]
    held = divergence.term_rows(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    leads = held.groupBy(F.substring("term", 1, 4).cast("string").alias("p")).agg(F.sum("lead_1").alias("docs"))
    assert {tuple(r) for r in leads.collect()} == {("pref", 4), ("othe", 1)}
    assert {r.term.decode() for r in divergence.kept_terms(held, 4).collect()} == {"prefixone"}


def brute_marginals(unary, steps):
    n = len(unary)
    good, pair, total = np.zeros(n), np.zeros((n, 2, 2)), 0.0
    for labels in range(1 << n):
        y = [labels >> k & 1 for k in range(n)]
        weight = math.exp(sum(u for u, k in zip(unary, y) if k) + sum(steps[a][b] for a, b in zip(y, y[1:])))
        total += weight
        good += weight * np.array(y)
        for k in range(1, n):
            pair[k, y[k - 1], y[k]] += weight
    return good / total, pair / total


def test_marginals_of_chains():
    """Forward and backward products against all labellings, chains of 1 to 9 lines side by side."""
    rng = np.random.default_rng(4)
    steps = rng.normal(size=(2, 2))
    sizes = [1, 9, 0, 4, 2, 8]
    first = np.concatenate([[0], np.cumsum(sizes)])
    unary = rng.normal(size=first[-1]) * 3
    good, pair = linecrf.marginals(unary, steps, first)
    for a, b in zip(first[:-1], first[1:]):
        if b > a:
            expected = brute_marginals(unary[a:b], steps)
            assert np.allclose(good[a:b], expected[0]) and np.allclose(pair[a:b], expected[1])
    long, _ = linecrf.marginals(np.tile([30.0, -40.0], 50_000), steps, np.array([0, 100_000]))
    assert np.isfinite(long).all()


def test_the_fit_follows_the_slope():
    """At the fitted weights the likelihood's slope is near zero."""
    rng = np.random.default_rng(2)
    first = np.arange(0, 401, 4)
    good = np.repeat(rng.random(100) < 0.7, 4)
    x = rng.random((400, 3 * linecrf.N_OWN)).astype(np.float32) * 0.1
    x[:, 0] = good + rng.normal(size=400)
    field = linecrf.fit(x, good, first)
    p, _ = linecrf.marginals(x @ field.weights + field.bias, field.steps, first)
    assert np.abs(x[:, 0] @ (good - p) / 400 - linecrf.RIDGE * field.weights[0]) < 0.01
    assert p[good].mean() > 0.8 > 0.4 > p[~good].mean()


def test_line_quality_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 1), (3, 0), (None, 1), (5, None)], "doc_id long, quality int")
    scored = linecrf.classify(docs, labels)
    assert scored.columns == [c for c in docs.columns if c != linecrf.RESULT] + [linecrf.RESULT]
    rows = scored.select("doc_id", "text", f"{linecrf.RESULT}.*").collect()
    assert len(rows) == len(ROWS) and all(0.0 <= r.score <= 1.0 for r in rows)
    assert all(r.lines == sum(bool(line.strip(" \t\v\f\r")) for line in (r.text or "").split("\n")) for r in rows)
    assert all(r.score == 0.0 for r in rows if not r.lines)
    again = linecrf.classify(docs.repartition(1), labels).select("doc_id", "text", f"{linecrf.RESULT}.*").collect()
    near = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, round(r.score, 9)) for r in rows)
    assert near(rows) == near(again)
    assert linecrf.classify(docs.limit(0), labels).count() == 0
    for few in (labels.limit(0), labels.filter("quality = 1")):
        assert linecrf.classify(docs, few).count() == len(ROWS)
    taught = {r.doc_id for r in linecrf.training_lines(docs, labels).collect()}
    assert 3 not in taught and 5 not in taught and None not in taught
    assert not any(__import__("zlib").crc32(str(k).encode()) % 4 == 2 for k in taught)


def test_line_quality_held_out(spark):
    """Of the documents that teach nothing, at least 95 % of each label are told right."""
    folder = "/root/testdata/sf0.1"
    found = queries.op11_line_quality(spark, folder).filter("held_out").join(queries.table(spark, folder, "labels"), "doc_id")
    rows = found.groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")).alias("right"), F.count(F.lit(1)).alias("n")).collect()
    assert len(rows) == 2 and all(r.right >= 0.95 and r.n > 100 for r in rows)


def test_terms_shorter_than_a_level_are_settled_by_it(spark):
    """Lengths around every level; what later levels say of a settled term is not read any more."""
    names = [c * n for c in "ab" for n in (1, 2, 3, 4, 5, 8, 9, 16, 17, 32, 33, 50)]
    texts = [" ".join(names[: 1 + k % len(names)]) for k in range(4 * len(names))]
    made = divergence.term_rows(spark.createDataFrame([(t, "en", "s") for t in texts], "text string, lang string, source string"))
    docs = Counter(w for t in texts for w in set(t.split()))
    for least in (1, 9, 50, 90):
        kept = [r.term.decode() for r in divergence.kept_terms(made, least).collect()]
        assert sorted(kept) == sorted(w for w, n in docs.items() if n >= least)
    one = [("en", b"a", 9, 9, 0, 0, 0, 0), ("en", b"abc", 9, 9, 9, 0, 0, 0), ("en", b"zz", 3, 3, 3, 3, 3, 3)]
    sums = ", ".join(f"{s} long" for s in divergence.SUMS)
    rows = spark.createDataFrame(one, f"lang string, term binary, {sums}")
    assert {bytes(r.term) for r in divergence.kept_terms(rows, 5).collect()} == {b"a", b"abc"}
