"""URL filters: rules first, then word segmentation of the host and naive Bayes over the words.

A host such as ``freebets`` is split into words by the Viterbi path through a unigram model, which is counted over the
words of all documents, the words that URLs show apart, and the seeds, each of which has a fixed part of the counts. The
words of host and path are scored by multinomial naive Bayes. Its labelled rows are all URLs: those that a rule decides
have its verdict, of the others those with a seed among the words of the split host are to be blocked and the rest
allowed. So words that keep company with seeds or blocked sites count against a URL, also where it has no seed.

Both count tables stay whole, as Spark tables: a join finds the pieces of host names in the one and the words of URLs in
the other. Each different name and each different list of words is looked up once.

Defined cases: a null URL or one without ``://`` has an empty host and path and no words, so the prior decides; a tie
is allowed; without URLs of a class both classes are equally likely; repeated rows count again; hosts and paths may be of any
length; letters that are not ASCII part words; without documents only URLs and seeds are counted; columns named ``host``, ``path``,
``rule``, ``verdict``, ``words``, ``score`` or ``label`` are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import pin, small_table
from . import words as W

#: Parameters: the longest word, the weight of a class before any URL, the part (one in so many) of the unigram counts
#: that a seed has, the part from which a word is looked up without a shuffle, and the letters whose pieces are sent at once.
LONGEST_WORD = 20
SEED_PART = 1000
HOT_PART = 1000
PIECE_STARTS = 4096
SMOOTHING = 1.0
#: Parameter: words whose sites are known to be unwanted.
SEEDS = ("adult", "bets", "casino", "pills", "spam")

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_LETTERS = np.zeros(256, np.uint8)
_LETTERS[[ord(c) for c in UPPER + LOWER]] = 1
_TO_LOWER = np.arange(256, dtype=np.uint8)
_TO_LOWER[[ord(c) for c in UPPER]] = [ord(c) for c in LOWER]


class Rule(NamedTuple):
    """A verdict for a host with its subdomains and the paths that start with ``path``."""

    host: str
    path: str
    verdict: str

    @property
    def text(self) -> str:
        return self.host + self.path


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def decided_by(rules: Sequence[Rule], host: str = "host", path: str = "path") -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits, null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):
        inside = (F.col(host) == rule.host) | F.col(host).endswith("." + rule.host)
        fits = inside & F.col(path).startswith(rule.path)
        text, verdict = F.when(fits, rule.text).otherwise(text), F.when(fits, rule.verdict).otherwise(verdict)
    return text, verdict


def parsed(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    host, path = host_and_path()
    rule, verdict = decided_by(rules)
    return pages.withColumns({"host": host, "path": path}).withColumns({"rule": rule, "verdict": verdict})


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, count) of the ASCII words of all texts, in lower case; each slice sends its different words once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, data, offsets in W.text_slices(batch.column("text")):
                starts, ends, _ = W.spans(data, offsets, _LETTERS)
                short = ends - starts <= LONGEST_WORD
                starts, ends = starts[short], ends[short]
                low = _TO_LOWER[data]
                _, first, n = np.unique(W.span_hashes(low, starts, ends), return_index=True, return_counts=True)
                whole = low.tobytes()
                held = [whole[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary()).cast(pa.string()), pa.array(n)], ["word", "count"])

    return docs.select("text").mapInArrow(count, "word string, count long").groupBy("word").agg(F.sum("count").alias("count"))


class Segmenter:
    """The likeliest split of a name into words."""

    def __init__(self, counts: dict[str, int], total: int = 0):
        total = total or sum(counts.values()) or 1
        self.cost = {w: math.log(total / n) for w, n in counts.items()}
        self.unknown = math.log(10 * total)

    def _cost(self, word: str) -> float:
        return self.cost.get(word, self.unknown + math.log(10) * len(word))

    def split(self, name: str) -> list[str]:
        best = [(0.0, 0)]
        for end in range(1, len(name) + 1):
            starts = range(max(0, end - LONGEST_WORD), end)
            best.append(min((best[s][0] + self._cost(name[s:end]), s) for s in starts))
        out, end = [], len(name)
        while end:
            out.append(name[best[end][1] : end])
            end = best[end][1]
        return out[::-1]


def letters(text: str | Column) -> Column:
    """Runs of ASCII letters, as they come."""
    return F.regexp_extract_all(text, F.lit("([a-z]+)"), 1)


def unigrams(docs: DataFrame, judged: DataFrame) -> tuple[DataFrame, int]:
    """(word, count) over documents, words of URLs and seeds, whole, and the sum of the counts.

    A URL's words are those of its path and those that dashes part in its host. A name that stands between dots is what is
    to be split, so it counts for no word.
    """
    labels = F.split("host", "[.:@]")
    dashed = F.flatten(F.transform(F.filter(labels, lambda x: x.contains("-")), lambda x: F.split(x, "[^a-z]+")))
    alone = judged.select(F.explode(F.concat(dashed, letters(F.lower("path")))).alias("word"))
    alone = alone.filter(F.length("word").between(1, LONGEST_WORD)).groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    names = judged.select(F.explode(labels).alias("word")).distinct()
    held = pin(word_counts(docs).union(alone.join(names, "word", "left_anti")), "unigrams")
    base = held.agg(F.sum("count")).first()[0] or 0
    seed = base // SEED_PART + 1
    seeds = held.sparkSession.createDataFrame([(w, seed) for w in SEEDS], "word string, count long")
    return held.union(seeds).groupBy("word").agg(F.sum("count").alias("count")), base + seed * len(SEEDS)


def pieces_of(names: DataFrame) -> DataFrame:
    """(key, word): the pieces of a name that can be words, up to ``LONGEST_WORD`` letters from each of its letters.

    A name is cut in runs of ``PIECE_STARTS`` letters, so that one of any length is sent in parts; a piece may come once from each.
    Names of one key share their pieces, which does no harm: a split asks for pieces of its own name only.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, words = [], []
            for key, name in zip(batch.column("key").to_pylist(), batch.column("name").to_pylist()):
                for low in range(0, len(name), PIECE_STARTS):
                    starts = range(low, min(low + PIECE_STARTS, len(name)))
                    found = {name[s : s + n] for s in starts for n in range(1, min(LONGEST_WORD, len(name) - s) + 1)}
                    held += [key] * len(found)
                    words += found
                    if len(words) > 1 << 16:
                        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(words, pa.string())], ["key", "word"])
                        held, words = [], []
            if words:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(words, pa.string())], ["key", "word"])

    return names.select("key", "name").mapInArrow(cut, "key long, word string")


def segmented(judged: DataFrame, counts: DataFrame, total: int) -> DataFrame:
    """(host, host_words) of the different hosts. Each name is split by the counts of its own pieces, which a join finds."""
    hosts = judged.select("host").distinct().select("host", F.posexplode(letters("host")).alias("at", "name"))
    hosts = pin(hosts, "hosts")
    names = pin(hosts.select("name").distinct().withColumn("key", F.xxhash64("name")), "names")
    known = pieces_of(names).join(counts, "word").groupBy("key").agg(F.collect_list("word").alias("words"), F.collect_list("count").alias("counts"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*[batch.column(c).to_pylist() for c in ("name", "words", "counts")])
            held = [Segmenter(dict(zip(words or [], counts or [])), total).split(name) for name, words, counts in rows]
            yield pa.RecordBatch.from_arrays([batch.column("name"), pa.array(held, pa.list_(pa.string()))], ["name", "pieces"])

    parts = pin(names.join(known, "key", "left").select("name", "words", "counts").mapInArrow(split, "name string, pieces array<string>"), "pieces")
    placed = hosts.join(parts, "name").groupBy("host").agg(F.sort_array(F.collect_list(F.struct("at", "pieces"))).alias("held"))
    return placed.select("host", F.flatten("held.pieces").alias("host_words"))


def with_words(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """``judged`` with ``words``, joined by spaces, and ``label``: the rule's verdict, else whether a word of the host is a seed."""
    # One host may have a third of the URLs: they are the left side, and few hosts are sent to all tasks.
    hosts = small_table(segmented(judged, *unigrams(docs, judged)), "host-words")
    none = F.array().cast("array<string>")
    joined = judged.join(hosts, "host", "left").withColumn("host_words", F.coalesce("host_words", none))
    seeded = F.when(F.arrays_overlap("host_words", F.array(*map(F.lit, SEEDS))), "block").otherwise("allow")
    return joined.select(
        *judged.columns,
        F.array_join(F.concat("host_words", letters(F.lower("path"))), " ").alias("words"),
        F.coalesce("verdict", seeded).alias("label"),
    )


def taught(named: DataFrame) -> DataFrame:
    """(word, allow, block): words of all URLs by label, whole. The word '' counts the URLs themselves."""
    blocks = (F.col("label") == "block").cast("long")
    alike = named.groupBy("words").agg(F.sum(1 - blocks).alias("allow"), F.sum(blocks).alias("block"))
    held = F.concat(F.array(F.lit("")), F.filter(F.split("words", " "), lambda w: w != ""))
    dealt = alike.select(F.explode(held).alias("word"), "allow", "block")
    return dealt.groupBy("word").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"))


class Bayes:
    """Log odds of block against allow."""

    def __init__(self, counts: dict[str, tuple[int, int]]):
        urls = counts.get("", (0, 0))
        self.prior = math.log((urls[1] + SMOOTHING) / (urls[0] + SMOOTHING)) if min(urls) else 0.0
        held = {w: c for w, c in counts.items() if w}
        total = [sum(c[k] for c in held.values()) + SMOOTHING * (len(held) + 1) for k in (0, 1)]
        level = math.log(total[0] / total[1])
        self.odds = {w: math.log((b + SMOOTHING) / (a + SMOOTHING)) + level for w, (a, b) in held.items()}
        self.unknown = level

    def score(self, held: list[str]) -> float:
        return self.prior + sum(self.odds.get(w, self.unknown) for w in held)


def word_odds(counts: DataFrame) -> tuple[DataFrame, float, int]:
    """(word, n, odds) as ``Bayes`` has them, the prior, and the sum of n."""
    urls = counts.filter("word = ''").first()
    held = counts.filter("word <> ''")
    kinds, allow, block = held.agg(F.count(F.lit(1)), F.coalesce(F.sum("allow"), F.lit(0)), F.coalesce(F.sum("block"), F.lit(0))).first()
    none = Bayes({"": (urls.allow, urls.block) if urls else (0, 0)})
    level = math.log((allow + SMOOTHING * (kinds + 1)) / (block + SMOOTHING * (kinds + 1)))
    odds = F.log((F.col("block") + SMOOTHING) / (F.col("allow") + SMOOTHING)) + level
    return held.select("word", (F.col("allow") + F.col("block")).alias("n"), odds.alias("odds")), none.prior, allow + block


def scores(named: DataFrame, odds: DataFrame, total: int) -> DataFrame:
    """(words, sum): log odds of each different ``words``, summed in order of size, so that runs agree.

    At most ``HOT_PART`` words can each be that part of all words: those are sent to the tasks, the others are joined.
    """
    dealt = pin(named.select("words").distinct(), "bags").select("words", F.explode(F.filter(F.split("words", " "), lambda w: w != "")).alias("word"))
    hot = F.col("n") * HOT_PART >= total
    often = F.broadcast(odds.filter(hot).select("word", "odds"))
    others = dealt.join(often, "word", "left_anti").join(odds.filter(~hot).select("word", "odds"), "word")
    both = dealt.join(often, "word").select("words", "odds").union(others.select("words", "odds"))
    held = both.groupBy("words").agg(F.sort_array(F.collect_list("odds")).alias("held"))
    return held.select("words", F.aggregate("held", F.lit(0.0), lambda x, y: x + y).alias("sum"))


def filter_urls(pages: DataFrame, docs: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """``pages`` with host, path, rule, verdict, ``words`` and ``score`` (null where a rule decides)."""
    pages = pages.drop("host", "path", "rule", "verdict", "words", "score", "label")
    judged = parsed(pages, rules)
    named = pin(with_words(judged, docs), "named")
    odds, prior, total = word_odds(pin(taught(named), "taught"))
    # Equal lists of words are the left side; AQE splits them where the scores are too many to be sent to all tasks.
    scored = named.join(small_table(scores(named, odds, total), "scores"), "words", "left")
    score = F.lit(prior) + F.coalesce("sum", F.lit(0.0))
    return scored.select(
        *[c for c in judged.columns if c != "verdict"],
        F.coalesce("verdict", F.when(score > 0, "block").otherwise("allow")).alias("verdict"),
        "words",
        F.when(F.col("rule").isNull(), score).alias("score"),
    )
