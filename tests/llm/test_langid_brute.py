"""Language identification against a plain replay: counts of the labelled documents, words first, then shorter n-grams."""

import math
import zlib
from collections import Counter, defaultdict

import pytest
import regex

from tickloom.llm.langid import fit, identify

SF = "/root/testdata/sf0.001"


def words(text):
    return regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower())


def grams(word, size):
    marked = word if size == 1 else f"^{word}$"
    return [marked[i : i + size] for i in range(len(marked) - size + 1)]


def kept_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 4 == 2


def replay(rows):
    taught = [(lang, words(text)) for i, text, lang in rows if lang is not None and text is not None and not kept_out(i)]
    docs, counts = Counter(lang for lang, _ in taught), defaultdict(Counter)
    for lang, own in taught:
        for w in own:
            counts[lang, 0][w] += 1
            for size in (4, 3, 2, 1):
                counts[lang, size].update(grams(w, size))
    langs = sorted(docs)
    known = {size: set().union(*(counts[x, size] for x in langs)) for size in range(5)}
    total = {(x, size): sum(counts[x, size].values()) for x in langs for size in range(5)}

    def log(lang, size, entry):
        return math.log((counts[lang, size][entry] + 0.5) / (total[lang, size] + 0.5 * (len(known[size]) + 1)))

    def evidence(lang, word):
        if word in known[0]:
            return log(lang, 0, word)
        for size in (4, 3, 2, 1):
            own = grams(word, size)
            if any(g in known[size] for g in own):
                return sum(log(lang, size, g) for g in own) / len(own)
        return 0.0

    out = []
    for i, text, _ in rows:
        own = words(text) if text else []
        if not own:
            out.append((i, kept_out(i), "und", 0.0))
            continue
        seen = Counter(own)
        logs = {x: math.log(docs[x] / len(taught)) + sum(n * evidence(x, w) for w, n in seen.items()) for x in langs}
        best = max(langs, key=lambda x: logs[x])
        out.append((i, kept_out(i), best, 1 / sum(math.exp(v - logs[best]) for v in logs.values())))
    return out


@pytest.mark.parametrize("kind", ["table", "made"])
def test_predictions_equal_the_replay(spark, kind):
    if kind == "table":
        rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    else:  # equal languages, words that no language has, letters never seen, nulls, repeated rows
        rows = [(i, t, x) for i, (t, x) in enumerate([("alpha beta", "aa"), ("alpha beta", "bb"), ("gamma gamma", "aa"), ("gamma gamma", "bb"), ("delta", "aa"), ("delta", "bb")] * 3)]
        rows += [(100, "alphabet gammas", None), (101, "жук", "aa"), (102, "漢字", None), (103, None, "aa"), (104, "1 2", "bb"), (None, "zeta eta", "aa"), (None, "zeta eta", "aa"), (105, "etas", None), (106, "qqq", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = sorted(((str(r.doc_id), r.held_out, r.lang_pred, r.score) for r in identify(df).collect()))
    want = sorted((str(i), h, lang, score) for i, h, lang, score in replay(rows))
    assert [f[:3] for f in found] == [w[:3] for w in want]
    assert all(f[3] == pytest.approx(w[3], abs=1e-6) for f, w in zip(found, want, strict=True))


def spelled(i):
    return "".join("abcdefghij"[int(c)] for c in str(i))


def test_samples_are_bounded_also_where_ids_are_null_or_repeat(spark):
    df = spark.createDataFrame([(None if i % 2 else 7, f"wort{spelled(i)} text{spelled(i)}", "aa") for i in range(4000)], "doc_id long, text string, lang string")
    assert 200 < sum(1 for w in fit(df, sample_rows=400).words if w.startswith("wort")) < 600
    few = fit(df, sample_chars=6000).words
    assert 100 < sum(map(len, few)) < 12_000


def test_all_words_of_the_sample_are_kept(spark):
    df = spark.createDataFrame([(0, " ".join("w" + spelled(i) for i in range(40_000)), "aa")], "doc_id long, text string, lang string")
    assert len(fit(df).words) == 40_000
