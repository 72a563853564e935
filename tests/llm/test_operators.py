"""The operators on rows with nulls, empty and very long texts, ties, repeats and clashing columns, against plain Python."""

import hashlib
import random
import sys
import time
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402
from poplineage.llm import bpe, dom, html, lm, mixing, quality, queries, simhash, substrings, tokenfile, topk, urls  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _texts():
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("aeioustrn") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = make(60), make(120)
    near = base.split()
    near[50] = "changed"
    texts = [make(rng.randint(1, 150)) for _ in range(30)]
    texts += [f"{make(30)} {passage} {make(40)}" for _ in range(5)] + [base, base, " ".join(near), base.upper()]
    texts += [None, "", " \n\t ", "one", "two words", "a b c", "x " * 40, "same line\n" * 30 + make(60), "## ** | <a> & 50%\n" * 10]
    texts += ["caf\u00e9 na\u00efve \u4e2d\u6587 \U0001f600 " * 15, "don't 's   x <|endoftext|> y\r\n", make(20_000), "z" * 30_000, "a\u00a0b\u2003c\x1cd"]
    return texts


ROWS = [(k, t, "en", ["s", "t", None][k % 3] if k % 5 else "s", len(t or "")) for k, t in enumerate(_texts())]
ROWS += [ROWS[3], ROWS[3], (None, ROWS[4][1], "en", "s", 1), (None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    queries.importable(spark)
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).withColumns({"ids": F.lit("clash"), "llm_quality": F.lit(1), "_tie": F.lit(2)})


@pytest.fixture(scope="module")
def none(spark):
    queries.importable(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, int(k % 4 > 0), 0) for k in range(30)] + [(None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


def by_row(rows):
    return sorted(rows, key=repr)


def test_quality(docs, labels, none):
    found = quality.quality_rules(docs, labels).select("doc_id", "text", "llm_quality.*").collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert len(found) == len(ROWS)
    for row in found:
        assert tuple(row[n] for n in names) == brute.base_measures(row.text), row.text[:80]
        assert row.kept == (not row.base_failed and row.score >= quality.MIN_SCORE)
    assert quality.quality_rules(none, labels).count() == 0
    assert quality.quality_rules(docs, labels.limit(0)).count() == len(ROWS)


def test_simhash(docs, none):
    found = simhash.near_duplicates(docs).collect()
    rows = [(r[0], brute.fingerprint(r[1])) for r in ROWS]
    expected = [(r[0], r[1], c) for r, c in zip(rows, brute.components(rows))]
    assert by_row((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == by_row(expected)
    kept = simhash.one_of_each(docs).collect()
    assert by_row(r.doc_id for r in kept) == by_row({c for _, _, c in expected})
    assert simhash.one_of_each(none).count() == 0


def test_chain_of_links(spark):
    """A path of fingerprints, each two bits from the next, is one component."""
    prints = [(1 << 63) | ((1 << 2 * k) - 1) for k in range(31)]
    table = spark.createDataFrame([((p + (1 << 63)) % (1 << 64) - (1 << 63),) for p in prints], "fp long")
    labels = simhash.components(simhash.links(table)).collect()
    assert len(labels) == 31 and len({r.label for r in labels}) == 1


def test_bpe(docs, none):
    tokenizer = Tokenizer.from_file(queries.BPE_FILE)
    encoded = bpe.encode(docs, queries.BPE_FILE)
    for row in bpe.decode(encoded, queries.BPE_FILE).collect():
        expected = tokenizer.encode(row.text or "", add_special_tokens=False).ids
        assert row.ids == expected and row.decoded == tokenizer.decode(expected, skip_special_tokens=False)
    both = bpe.round_trip(docs, queries.BPE_FILE).select("ids", "decoded").collect()
    assert by_row(both) == by_row(bpe.decode(encoded, queries.BPE_FILE).select("ids", "decoded").collect())
    assert bpe.decode(bpe.encode(none, queries.BPE_FILE), queries.BPE_FILE).count() == 0


def test_bpe_of_odd_strings():
    rng, letters = random.Random(1), list(" \t\n\r'sdmtlvre<|>endoftx\u00e9!?#9\u00a0\u3000\U0001f600zqj.,\u00d7\u0250")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 30))) for _ in range(4000)]
    tokenizer, codec = Tokenizer.from_file(queries.BPE_FILE), bpe.Codec(bpe.read_vocabulary(queries.BPE_FILE))
    data = [t.encode() for t in texts]
    at = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    ids, begin = codec.encode(np.frombuffer(b"".join(data), np.uint8), at)
    expected = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == expected
    assert codec.decode(ids, begin) == tokenizer.decode_batch(expected, skip_special_tokens=False)
    assert codec.decode(np.array([-1, 60_000]), np.array([0, 2])) == [""]


def test_token_files(spark, docs, none):
    tokenizer = Tokenizer.from_file(queries.BPE_FILE)
    place = tokenfile.scratch_folder(spark)
    manifest = tokenfile.write_tokens(docs, queries.BPE_FILE, 0, place)
    found = tokenfile.read_tokens(manifest, place).orderBy("start").collect()
    ids = [r.doc_id for r in found]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0)) and len(ids) == len(ROWS)
    expected = by_row((r[0], zlib.crc32(np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4").tobytes())) for r in ROWS)
    assert by_row((r.doc_id, zlib.crc32(r.ids)) for r in found) == expected
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1].tolist()]
    shard = tokenfile.Shard(place, manifest.orderBy("shard").first()["file"])
    assert shard.ids(0).astype("<u4").tobytes() == found[0].ids
    empty = tokenfile.scratch_folder(spark)
    assert tokenfile.read_tokens(tokenfile.write_tokens(none, queries.BPE_FILE, 0, empty), empty).count() == 0


def test_substrings(docs, none):
    found = substrings.without_repeats(docs).select("doc_id", "llm_substrings.*").distinct().collect()
    expected = brute.without_repeats({(r[0], r[1]) for r in ROWS if r[0] is not None})
    assert by_row(tuple(r) for r in found if r.doc_id is not None) == by_row(expected)
    assert substrings.without_repeats(docs).count() == len(ROWS)
    copied = next(r for r in found if r.doc_id is None and r.n_words > 0)
    assert copied.n_removed == (copied.n_words if copied.n_words >= 20 else 0)
    assert substrings.without_repeats(none).count() == 0


def test_mixing(spark, docs, none):
    rows, plan = mixing.plan_for(docs)
    taken = mixing.with_copies(rows, plan).collect()
    assert len(taken) == len(ROWS) and all(r._mix_copies <= 2 for r in taken)
    sizes, total = {}, 0
    for r in ROWS:
        sizes[r[3]] = sizes.get(r[3], 0) + len(brute.words(r[1]))
        total += len(brute.words(r[1]))
    targets = {r.source: r.target for r in plan.collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    left, open_, expected = 1.5 * total, dict(zip(names, (5, 2, 1))), {}
    while True:
        level = left / sum(open_.values())
        full = [s for s in open_ if level * open_[s] > 2 * sizes[s]]
        if not full:
            break
        for s in full:
            expected[s] = 2 * sizes[s]
            left -= expected[s]
            del open_[s]
    expected |= {s: level * w for s, w in open_.items()}
    assert targets == pytest.approx(expected)
    assert mixing.mix(docs).count() == sum(r._mix_copies for r in taken)
    assert mixing.mix(none).count() == 0
    many = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("w w w").alias("text"), F.lit("s").alias("source"))
    rows, plan = mixing.plan_for(many)
    got = mixing.with_copies(rows, plan).agg(F.sum(F.col("_mix_copies") * F.col("_mix_size"))).first()[0]
    assert abs(got - 90_000) <= 3


def test_lm(docs, none):
    tokenizer = Tokenizer.from_file(queries.BPE_FILE)
    found = lm.scores(docs, queries.BPE_FILE).collect()
    tokens = [tokenizer.encode(r[1] or "", add_special_tokens=False).ids for r in ROWS]
    expected = [(r[0] is None, r[0] or 0, len(t), s) for r, t, s in zip(ROWS, tokens, brute.backoff_scores(tokens, lm.BACKOFF))]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.score) for r in found)
    assert got == [pytest.approx(e) for e in sorted(expected)]
    assert lm.scores(none, queries.BPE_FILE).count() == 0


@pytest.mark.parametrize("block", [512, 7])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    rng = random.Random(2)
    rows = [(k, [rng.uniform(-1, 1) for _ in range(6)]) for k in range(150)]
    rows += [(200 + k, [0.5] * 6) for k in range(60)] + [(300, [0.1]), (301, []), (302, None), (303, [None] * 6), (304, [float("nan")] * 6)]
    rows += [(None, [9.0] * 6), (320, [float("inf")] + [0.0] * 5), (340, [1e30] + [0.0] * 5)]
    rows = [r for r in rows if r[0] != 340]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    found = topk.top_k(table, 20, 20).collect()
    as_float = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    assert sorted(map(tuple, found)) == brute.top_k(as_float, 20, 20)
    assert topk.top_k(table.limit(0), 20, 20).count() == 0
    few = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (1, [-1.0])], "vec_id long, embedding array<float>")
    assert topk.top_k(few, 20, 20).count() == 4


def test_urls(spark, docs):
    given = [
        ("https://a.example.net/en/x?y", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://EXAMPLE.net/de", "example.net", "/de", "net/", "block"),
        ("http://example.net", "example.net", "", None, None),
        ("x://b.example.com/de/?q#f", "b.example.com", "/de/", "example.com/de/", "block"),
        ("http://c.org/fr/\u00c9a#z", "c.org", "/fr/\u00c9a", "org/fr/", "allow"),
        ("http://notnet/x", "notnet", "/x", None, None),
        ("no scheme", "", "", None, None),
        ("a://b://c/d", "b:", "//c/d", None, None),
        (None, "", "", None, None),
        ("", "", "", None, None),
    ]
    pages = spark.createDataFrame([(k, g[0], "clash") for k, g in enumerate(given)], "page_id long, url string, host string")
    found = urls.filter_urls(pages, docs, queries.RULES).orderBy("page_id").collect()
    for row, (_, host, path, rule, verdict) in zip(found, given):
        assert (row.host, row.path, row.rule) == (host, path, rule)
        assert row.verdict == verdict if verdict else row.verdict in ("allow", "block")
    assert urls.filter_urls(pages.limit(0), docs.limit(0), queries.RULES).count() == 0


def test_segmentation():
    segmenter = urls.Segmenter({"cheap": 5, "pills": 5, "che": 1, "ap": 1, "free": 9})
    assert segmenter.split("cheappills") == ["cheap", "pills"] and segmenter.split("") == []
    bayes = urls.Bayes({"": (10, 10), "cheap": (1, 9), "news": (9, 1)})
    assert bayes.score(["cheap"]) > 0 > bayes.score(["news"])


PAGE = """<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav>
<div class="ad">Buy this now.</div><article><h1>A title &amp; more</h1><p><b>First sentence of the text,&nbsp;here.<br><p>Second one is
  longer, with   spaces. <i>And</i> more.</p><script>var t="</p>";</script></article><footer>&copy; site</footer></body></html>"""


@pytest.fixture(scope="module")
def forest(spark):
    queries.importable(spark)
    return html.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))


def test_html(spark, forest):
    rows = [(1, PAGE, "u"), (2, None, "u"), (3, "", "u"), (4, "<div>" * 3000 + "deep", "u"), (5, "<p>a<b", None), (1, PAGE, "u")]
    pages = spark.createDataFrame([(a, b, c, "clash") for a, b, c in rows], "page_id long, html string, url string, text string")
    found = [(r.page_id, r.text, r.n_chars) for r in html.extract(pages, forest).collect()]
    text = "A title & more First sentence of the text, here. Second one is longer, with spaces. And more."
    assert found[0] == found[5] == (1, text, len(text)) and found[1][1:] == found[2][1:] == ("", 0)
    assert html.extract(pages.limit(0), forest).count() == 0
    assert html.train(pages.limit(0)).margins(np.zeros((2, len(dom.FEATURES)), np.float32)).tolist() == [1.0, 1.0]


def test_close_tags_that_end_nothing():
    """Tags that match nothing, under very many open ones: told without a walk, so the page is read in no time."""
    start = time.perf_counter()
    page = dom.Page("<div>" * 20_000 + "</p>" * 20_000 + "<span>" * 20_000 + "<li>" * 5 + "end")
    assert time.perf_counter() - start < 5 and page.text[-1] == "end"
    assert dom.Page("<p>a<b>b</p>c</b>d").tag == ["#page", "p", "#text", "b", "#text", "#text", "#text"]


def test_html_held_out(forest):
    """Layouts that the trees were not trained on: nearly every text run is told right, and no choice contradicts another."""
    right = total = 0
    for seed in range(5000, 5150):
        page, label = html._Layout([f"Sentence number {k} of {seed}, made up." for k in range(40)], seed).page()
        keep = page.consistent(forest.margins(page.features()))
        assert all(keep[page.parent[k]] or not keep[k] for k in range(1, len(keep)))
        runs = [k for k, tag in enumerate(page.tag) if tag == "#text"]
        right += sum(keep[k] == label[k] for k in runs)
        total += len(runs)
    assert right > 0.95 * total


def test_token_files_are_read_in_as_many_tasks_as_shards(spark):
    queries.importable(spark)
    names = spark.range(30).select(F.col("id").alias("shard"), F.lit("f").alias("file"), F.col("id").alias("start"))
    assert tokenfile.read_tokens(names, "/nowhere").rdd.getNumPartitions() == 30


def test_pipeline_of_odd_rows(spark, none, docs, tmp_path):
    """Nulls, ties, repeated rows and very long texts go through all stages, and so does nothing at all."""
    for k, rows in enumerate((docs.select("doc_id", "text", "lang", "source", "n_chars"), none)):
        count = rows.count()
        for name, stage in corpus_pipeline.STAGES:
            columns = rows.columns
            stage(spark, rows, "/root/testdata/sf0.001").write.parquet(f"{tmp_path}/{k}{name}")
            rows = spark.read.parquet(f"{tmp_path}/{k}{name}")
            assert rows.columns == columns or name == "bpe_ids"
            assert rows.count() <= 2 * count
        assert bool(rows.count()) == bool(count) and not rows.filter("not exact").count()


def test_pipeline(spark, tmp_path):
    """Every stage against plain Python on what the stage before has kept."""
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {"": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
    kept = seen["quality_rules"]
    assert {r.doc_id for r in kept} <= {r.doc_id for r in seen[""] if not brute.base_measures(r.text)[-1]}
    assert {r.doc_id for r in seen["near_dedup"]} == set(brute.near_copies([(r.doc_id, r.text) for r in kept]))
    cut = {d: (removed, text) for d, _, removed, text in brute.without_repeats({(r.doc_id, r.text) for r in seen["near_dedup"]})}
    texts = {r.doc_id: r.text for r in seen["near_dedup"]}
    assert {r.doc_id: r.text for r in seen["substring_dedup"]} == {d: t if n else texts[d] for d, (n, t) in cut.items()}
    assert {r.doc_id for r in seen["source_mix"]} <= set(cut)
    last = seen["bpe_ids"]
    assert len(last) == len(seen["source_mix"]) and all(r.exact for r in last)
    digests = {r.doc_id: hashlib.sha256(r.text.encode()).hexdigest() for r in seen["source_mix"]}
    assert all(r.decoded_sha256 == digests[r.doc_id] for r in last)
