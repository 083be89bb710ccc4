"""URL filters: allow and block rules first, then naive Bayes over segmented words.

Hosts and paths are cut at everything but letters; each different piece is split into words by Viterbi under unigram
counts of the words of all pages. Multinomial naive Bayes learns from a bounded sample of the URLs that a rule
decides, and scores the rest. Pieces, not pages, are segmented and scored; a page adds up the scores of its pieces.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.session import materialized

#: (verdict, host, path start)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
#: Parts of a piece of up to so many letters are listed; longer words are found by their beginning.
SHORT = 16
#: Parts that make one batch.
STEP = 50_000
SAMPLE_ROWS = 50_000
#: Scores are sums of whole millionths, so that no order of adding changes them.
UNIT = 1_000_000


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path; both empty without ``://``."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")
    return _lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*+([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, rule_host, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(rule_host + start)).otherwise(name), F.when(fits, F.lit(kind)).otherwise(verdict)
    return name, verdict


def pieces(host: str = "host", path: str = "path") -> Column:
    """Structs (place, piece) of the letter runs of host and path, lower-cased, and one for each run of digits."""
    runs = lambda place, c: F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\p{N}+"), F.lit(0)), lambda p: F.struct(F.lit(place).alias("place"), F.when(p.rlike(r"^\p{L}"), p).otherwise("#").alias("piece")))
    return F.concat(runs("host", F.col(host)), runs("path", F.col(path)))


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, piece) -> (key, at, word) for every part of a piece of up to SHORT letters."""
    keys, places, parts_ = [], [], []

    def batch_of() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(places, pa.int32()), pa.array(parts_, pa.string())], ["key", "at", "word"])

    for batch in batches:
        for key, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for at in range(len(piece)):
                own = [piece[at : at + size] for size in range(1, min(SHORT, len(piece) - at) + 1)]
                keys += [key] * len(own)
                places += [at] * len(own)
                parts_ += own
                if len(keys) >= STEP:
                    yield batch_of()
                    keys, places, parts_ = [], [], []
    yield batch_of()


def likeliest(piece: str, found: list[tuple[int, int, float]], total: int) -> list[str]:
    """The likeliest split of a piece; found: (start, size, log frequency) of the known words in it.

    A run that is no word has the frequency 10 / (total * 10 ** size). Such a run is best begun where the score plus
    log 10 times the place is highest, so runs of all sizes cost one comparison a letter.
    """
    ends: dict[int, list[tuple[int, float]]] = {}
    for start, size, log in found:
        ends.setdefault(start + size, []).append((start, log))
    step = math.log(10.0)
    rare = step - math.log(max(total, 1))
    scores, came, begin = [0.0], [0], 0
    for end in range(1, len(piece) + 1):
        best, start = scores[begin] + rare - step * (end - begin), begin
        for at, log in sorted(ends.get(end, ())):
            if scores[at] + log > best:
                best, start = scores[at] + log, at
        scores.append(best)
        came.append(start)
        if best > scores[begin] - step * (end - begin):
            begin = end
    words, end = [], len(piece)
    while end:
        words.append(piece[came[end] : end])
        end = came[end]
    return words[::-1]


def _best_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(piece, found = [(start, size, count)], total) -> (piece, words) of the likeliest split."""
    for batch in batches:
        rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
        out = [likeliest(piece, [(x["start"], x["size"], math.log(x["n"] / total)) for x in found or ()], total) for piece, found, total in rows]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.string()))], ["piece", "words"])


def segmented(found: DataFrame, counts: DataFrame) -> DataFrame:
    """(piece, words) for each different piece of ``found``, by the counts of words (word, n).

    Words of up to SHORT letters meet the parts of the pieces; longer ones meet the parts of SHORT letters by their
    beginning and are compared in full, so that no length is left out.
    """
    found = materialized(found.select("piece").distinct().select(F.md5("piece").alias("key"), "piece"), "pieces")
    cut = materialized(found.mapInArrow(_cuts, "key string, at int, word string"), "cuts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    short = cut.join(counts, "word").select("key", F.col("at").alias("start"), F.length("word").alias("size"), "n")
    long_words = counts.filter(F.length("word") > SHORT).select(F.substring("word", 1, SHORT).alias("begin"), F.col("word").alias("whole"), "n")
    begun = cut.filter(F.length("word") == SHORT).join(long_words, F.col("word") == F.col("begin")).join(found, "key")
    long_ = begun.filter(F.expr("substring(piece, at + 1, length(whole))") == F.col("whole")).select("key", F.col("at").alias("start"), F.length("whole").alias("size"), "n")
    known = short.unionByName(long_).groupBy("key").agg(F.collect_list(F.struct("start", "size", "n")).alias("found"))
    every = found.join(known, "key", "left").select("piece", "found", F.lit(total).cast("long").alias("total"))
    return materialized(every.mapInArrow(_best_words, "piece string, words array<string>"), "segmented")


def word_counts(pages: DataFrame, html: str = "html") -> DataFrame:
    """(word, n) of all words of the pages outside tags; counted before they meet anything."""
    text = F.lower(F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"<[^<>]*+>", " "))
    words = pages.select(F.explode(F.split(text, r"[^\p{L}]++")).alias("word")).filter("word <> ''")
    return materialized(words.groupBy("word").agg(F.count("*").alias("n")), "counts")


def judge(pages: DataFrame, rules=RULES, sample_rows: int = SAMPLE_ROWS, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score (log odds of block in millionths; null where a rule decides).

    * null url or one without ``://``: host and path are empty and the prior decides. Ties, and tables in which no
      rule decides any URL, give allow. Null ids and repeated rows pass through; null html counts as empty.
    * words of every length are counted and found; pieces of any length are split whole.
    * an empty table gives an empty result; other columns of the input are not looked at.
    """
    host, path = parts("_url")
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("_url")).select("page_id", F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    rows = materialized(rows.withColumns({"rule": rule, "ruled": verdict}), "urls")
    keys = rows.filter("rule is null").select("host", "path").distinct()
    n = rows.filter("rule is not null").count()
    taught = rows.filter("rule is not null").filter(F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / max(n, 1))))
    taught = materialized(taught.select((F.col("ruled") == "block").cast("int").alias("block"), pieces().alias("pieces")), "taught")
    keyed = materialized(keys.select("host", "path", F.explode_outer(pieces()).alias("p")).select("host", "path", "p.place", "p.piece"), "keyed")
    labelled = taught.select("block", F.explode("pieces").alias("p")).select("block", "p.place", "p.piece").groupBy("block", "place", "piece").agg(F.count("*").alias("n"))
    labelled = materialized(labelled, "labelled")
    words = segmented(labelled.select("piece").unionByName(keyed.filter("piece is not null").select("piece")), word_counts(pages, html))
    counted = labelled.join(words, "piece").select("block", "place", F.explode("words").alias("word"), "n")
    counted = counted.groupBy("place", "word").agg(*[F.sum(F.when(F.col("block") == b, F.col("n")).otherwise(0)).alias(f"n{b}") for b in (0, 1)])
    counted = materialized(counted, "counted")
    sums = counted.agg(F.count("*"), F.sum("n0"), F.sum("n1")).first()
    docs = taught.agg(F.sum(1 - F.col("block")), F.sum("block")).first()
    vocabulary, all0, all1 = sums[0], sums[1] or 0, sums[2] or 0
    micro = lambda c: F.round(c * UNIT).cast("long")
    odds = F.log((F.col("n1") + 1.0) / (all1 + vocabulary + 1.0)) - F.log((F.col("n0") + 1.0) / (all0 + vocabulary + 1.0))
    unseen = round(UNIT * (math.log(1.0 / (all1 + vocabulary + 1.0)) - math.log(1.0 / (all0 + vocabulary + 1.0))))
    prior = round(UNIT * math.log(((docs[1] or 0) + 1.0) / ((docs[0] or 0) + 1.0)))
    used = keyed.filter("piece is not null").select("place", "piece").distinct().join(words, "piece")
    scores = used.select("place", "piece", F.explode("words").alias("word")).join(counted.select("place", "word", micro(odds).alias("odds")), ["place", "word"], "left")
    scores = materialized(scores.groupBy("place", "piece").agg(F.sum(F.coalesce("odds", F.lit(unseen))).alias("odds")), "scores")
    judged = keyed.join(scores, ["place", "piece"], "left").groupBy("host", "path").agg((F.sum(F.coalesce("odds", F.lit(0))) + prior).alias("score"))
    judged = materialized(judged, "judged").withColumnsRenamed({"host": "_host", "path": "_path"})
    met = rows.join(judged, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")) & F.col("rule").isNull(), "left")
    by_score = F.when(F.col("score") > 0, "block").otherwise("allow")
    return met.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_score).alias("verdict"), F.when(F.col("rule").isNull(), F.col("score")).alias("score"))
