"""URL filters against a plain replay: rules, words of the pages, likeliest splits, naive Bayes."""

import math
from collections import Counter
from functools import lru_cache

import pytest
import regex

from tickloom.llm.catalog import QUERIES
from tickloom.llm.url_filter import RULES, judge, segmented, word_counts

SF = "/root/testdata/sf0.001"


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = regex.match(r"[^/?#]*", rest)[0]
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    return lower, regex.match(r"[^?#]*", rest[len(host):])[0]


def ruled(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


def pieces(host, path):
    return [(place, "#" if regex.match(r"\p{N}", run) else run) for place, c in (("host", host), ("path", path)) for run in regex.findall(r"\p{L}+|\p{N}+", c.lower())]


def judged(rows):
    """{page_id: (rule, verdict, score)}; the sample takes all labelled URLs of so small a table."""
    urls = {i: parts(u) for i, u, _ in rows}
    rules = {i: ruled(*u) for i, u in urls.items()}
    taught = [(v == "block", pieces(*urls[i])) for i, (_, v) in rules.items() if v]
    text = Counter()
    for _, _, html in rows:
        text.update(w for w in regex.split(r"[^\p{L}]+", regex.sub(r"<[^<>]*>", " ", html or "").lower()) if w)
    total = sum(text.values())

    def worth(word):
        unknown = math.log(10 / (max(total, 1) * 10.0 ** len(word)))
        return max(unknown, math.log(text[word] / total)) if text[word] else unknown

    @lru_cache(None)
    def split(piece):
        if not piece:
            return 0.0, ()
        tails = [(piece[:n], split(piece[n:])) for n in range(1, len(piece) + 1)]
        return max(((worth(w) + log, (w, *rest)) for w, (log, rest) in tails), key=lambda x: x[0])

    counts = {True: Counter(), False: Counter()}
    for block, own in taught:
        counts[block].update((place, w) for place, p in own for w in split(p)[1])
    vocabulary = len(set(counts[True]) | set(counts[False]))
    all_ = {b: sum(c.values()) for b, c in counts.items()}
    odds = lambda key: math.log((counts[True][key] + 1) / (all_[True] + vocabulary + 1)) - math.log((counts[False][key] + 1) / (all_[False] + vocabulary + 1))
    blocks = sum(b for b, _ in taught)
    prior = math.log((blocks + 1) / (len(taught) - blocks + 1))
    out = {}
    for i, (rule, verdict) in rules.items():
        score = prior + sum(odds((place, w)) for place, p in pieces(*urls[i]) for w in split(p)[1])
        out[i] = (rule, verdict, None) if verdict else (None, "block" if score > 0 else "allow", score)
    return out


def test_query_equals_the_replay(spark):
    rows = [(r.page_id, r.url, r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    want = judged(rows)
    found = {r.page_id: r for r in QUERIES["op4_url_filter"](spark, SF).collect()}
    assert set(found) == set(want) and any(s is not None for _, _, s in want.values())
    for i, (rule, verdict, score) in want.items():
        assert (found[i].host, found[i].path) == parts(dict((a, b) for a, b, _ in rows)[i]) and found[i].rule == rule
        assert found[i].score is None if score is None else found[i].score / 1e6 == pytest.approx(score, abs=1e-3)
        assert found[i].verdict == verdict or abs(score) < 1e-3


def test_words_of_every_length(spark):
    long_word = "donaudampfschifffahrtsgesellschaft"
    rows = [(1, f"http://{long_word}kapitaen.org/{'x' * 40}/a", f"<p>{long_word} kapitaen</p>"), (2, "http://kapitaen.com/a", "kapitaen xx"), (3, None, None)]
    rows += [(i, f"http://example.com/en/{long_word}", f"<b>{long_word}</b> und {'y' * i}") for i in range(4, 40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = judged(rows)
    for r in judge(pages).collect():
        rule, verdict, score = want[r.page_id]
        assert (r.rule, r.verdict) == (rule, verdict) and (r.score is None if score is None else r.score / 1e6 == pytest.approx(score, abs=1e-3))
    counts = word_counts(pages)
    found = spark.createDataFrame([(f"{long_word}kapitaen",), ("x" * 40,), ("q" * 30_000,)], "piece string")
    words = {r.piece: r.words for r in segmented(found, counts).collect()}
    assert words[f"{long_word}kapitaen"] == [long_word, "kapitaen"]
    assert words["x" * 40] == ["x" * 40] or "xx" in words["x" * 40]
    assert words["q" * 30_000] == ["q" * 30_000]
