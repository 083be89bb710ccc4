"""Operators against brute force, libraries or held-out accuracy, on the smallest tables."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from tickloom.llm.ann import Block, nearest
from tickloom.llm.bpe import BytePairs, Prefixes, tokenized
from tickloom.llm.catalog import QUERIES
from tickloom.llm.langid import grams, identify
from tickloom.llm.passages import best_window, compact_windows, units
from tickloom.llm.pii import KINDS
from tickloom.llm.simhash import linked, simhash, walk
from tickloom.llm.url_filter import judge

SF = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.collect()}


@pytest.fixture(scope="module")
def pairs():
    return BytePairs.load(RANKS)


@pytest.fixture(scope="module")
def library(pairs):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: r for r, b in pairs.bytes_of.items()}, special_tokens={})


def test_tokens_equal_the_library(docs, texts, library):
    odd = docs.limit(20).select("doc_id", F.concat(F.lit("  \u200b\x1c😀 aaaaaaaaaaaaaaaa'll\n\n ½²"), "text").alias("text"))
    for df, found in ((docs, texts), (odd, {r.doc_id: r.text for r in odd.collect()})):
        for r in tokenized(df, RANKS, public_tokenizers.PATTERN).collect():
            ids = library.encode_ordinary(found[r.doc_id])
            assert r.ids == ids and r.n_tokens == len(ids)
            assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(found[r.doc_id].encode()).hexdigest()


def test_appends_and_edits_equal_a_fresh_encoding(pairs, library, texts):
    rng = random.Random(5)
    words = " ".join(list(texts.values())[:20])
    for _ in range(100):
        at = rng.randrange(len(words) - 600)
        data = words[at : at + 600].encode()
        own = Prefixes(pairs, data[:200])
        own.append(data[200:])
        begin = rng.randrange(len(data) - 5)
        new = data[:begin] + b"xyz "[: rng.randrange(5)] + data[begin + 3 :]
        redone = own.replace(begin, begin + 3, new[begin : len(new) - len(data) + begin + 3])
        assert own.data == new and own.tokens() == pairs.encode(new) and redone <= len(new) - begin
        assert pairs.decode(own.tokens()) == new
        if b"\xc3" not in new:
            assert own.tokens() == library._core_bpe.encode_single_piece(new)


def near(values, budget=3):
    """Component of each value by comparing all with all."""
    of = np.arange(len(values))
    for i in range(len(values)):
        for j in np.flatnonzero(np.bitwise_count(values[i] ^ values) <= budget):
            a, b = of[i], of[j]
            of[of == max(a, b)] = min(a, b)
    return of


def clustered(rng, n):
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    flips = [np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64) for _ in range(2)]
    return np.unique(np.concatenate([base[rng.integers(0, 12, n)] ^ flips[0] ^ flips[1], rng.integers(0, 2**63, n, dtype=np.uint64), np.arange(n, dtype=np.uint64)]))


def test_trie_walk_equals_all_pairs():
    rng = np.random.default_rng(1)
    for _ in range(10):
        values = clustered(rng, 100)
        assert (walk(values, None, 0, 0) == near(values)).all()


def test_split_node_pairs_keep_every_link(spark):
    values = clustered(np.random.default_rng(2), 150)
    df = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = [(r.u, r.v) for r in linked(df, unit=40, most=60).collect()]
    place = {int(v): i for i, v in enumerate(values.view(np.int64))}
    of = np.arange(len(values))
    for u, v in edges:
        a, b = of[place[u]], of[place[v]]
        of[of == max(a, b)] = min(a, b)
    assert (of == near(values)).all()


def test_fingerprints_and_components(docs, texts):
    def fingerprint(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    ids = sorted(texts)
    values = np.array([fingerprint(texts[i]) for i in ids], np.uint64)
    of = near(values)
    want = {i: (f"{int(v):016x}", min(j for j, c in zip(ids, of) if c == k)) for i, v, k in zip(ids, values, of)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in simhash(docs).collect()} == want


def test_language_accuracy_on_held_out_documents(docs):
    rows = identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out and r.lang]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    assert grams("ab", 3) == ["^ab", "ab$"] and grams("ab", 1) == ["a", "b"]


PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def passes(kind, value):
    digits = [int(c) for c in value if c.isdigit()]
    doubled = [d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits[::-1])]
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
            "card": 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0, "phone": 8 <= len(digits) <= 15}[kind]


def test_personal_data_equals_the_plain_patterns(spark, texts):
    rng = random.Random(3)
    bits = ["a", ".", "@", "-", "1", "4", "0", " ", "+", "_", "(", "255", "b.c", "4111 1111 1111 1111", "x@y"]
    rows = dict(texts) | {10**6 + i: "".join(rng.choice(bits) for _ in range(40)) for i in range(1500)}
    from tickloom.llm.pii import sanitise

    for r in sanitise(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect():
        base = [f"{k}:{m.start()}:{m.end()}" for k in KINDS for m in re.finditer(PLAIN[k], rows[r.doc_id]) if passes(k, m.group())]
        spans = r.spans.split(",") if r.spans else []
        assert spans[: len(base)] == base and r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert base or not spans


def test_nearest_neighbours(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = {r.vec_id: np.array(r.embedding, float) for r in vectors.collect()}
    found = {}
    for r in nearest(vectors, F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = 0
    for q, own in found.items():
        true = sorted((float(np.sqrt(np.square(v - rows[q]).sum())), i) for i, v in rows.items() if i != q)[:10]
        hits += len({i for _, i in true} & {i for _, i, _ in own})
        assert sorted(k for k, _, _ in own) == list(range(1, 11))
        assert all(s == pytest.approx(np.sqrt(np.square(rows[i] - rows[q]).sum()), rel=1e-12) for _, i, s in own)
    assert hits >= 0.9 * 10 * len(found) and set(found) == {i for i in rows if i % 100 == 0}


def test_awkward_vectors(spark):
    rows = [(100, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, [1.0, 0.0], "c"), (3, [0.0, 1.0], None), (4, [0.0, 0.0], "z"), (5, None, "n"), (6, [1.0, None], "n"),
            (7, [float("nan"), 1.0], "x"), (8, [1.0, 2.0, 3.0], "l"), (None, [1.0, 0.0], "i"), (200, [0.0, 0.0], "z")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q string")
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert found == [(100, 1, 1, 0.0), (100, 2, 2, 0.0), (100, 3, 3, pytest.approx(2**0.5))]
    assert nearest(df.limit(0), F.col("vec_id") % 100 == 0).collect() == []


def test_neighbours_of_repeated_ids(spark):
    rng = np.random.default_rng(11)
    rows = [(int(i), rng.normal(size=8).tolist()) for i in range(1, 60)]
    rows += [(100, rows[0][1])] * 12 + [(200, rng.normal(size=8).tolist()) for _ in range(14)] + [(7, rows[6][1])] * 3 + [(300, [1.0, 2.0]), (61, [2.0, 2.0]), (62, [1.0, 2.0])]
    found = {}
    for r in nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    near = lambda own: sorted((float(np.sqrt(np.square(np.subtract(v, own)).sum())), i) for i, v in rows if len(v) == len(own))
    want = [(d, i) for d, i in near(rows[0][1]) if i != 100][:10]
    assert sorted(found[100]) == sorted((k + 1, i, pytest.approx(d)) for k, (d, i) in enumerate(want) for _ in range(12))
    assert len(found[200]) == 140 and all(i != 200 for _, i, _ in found[200])
    assert sorted(found[300]) == [(1, 62, 0.0), (2, 61, 1.0)]


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 256, (300, 4), dtype=np.uint8)
    codes[:40] = codes[0] ^ (1 << rng.integers(0, 8, (40, 4))).astype(np.uint8)
    for radius in (0, 3, 5, 10, 17, 32):
        for q in range(0, 300, 37):
            want = np.flatnonzero(np.bitwise_count(codes ^ codes[q]).sum(axis=1) <= radius)
            assert (Block(codes).within(codes[q], radius) == want).all()


def test_compact_windows_are_the_runs_of_equal_minima():
    values, sizes = np.random.default_rng(0).integers(0, 2**64, 500, dtype=np.uint64), np.array([200, 40, 46, 214])
    text, _, c, least, most = compact_windows(values, sizes, 46, 2)
    assert sum(most - least + 1) == sum(max(0, n - 45) for n in sizes) and 1 not in text
    starts = {(t, s) for t, at, a, b in zip(text, c, least, most) for s in range(at - b, at - a + 1)}
    assert len(starts) == sum(max(0, n - 45) for n in sizes)
    assert (units(["A b  c d\te", "x"])[0] == units(["a b c d e"])[0]).all()
    assert best_window(np.arange(60), np.concatenate([[99], np.arange(59)]), 46, 0.8)[1] > 0.95


def test_shared_passages_are_connected(docs, texts):
    groups = {}
    for i, t in texts.items():
        words = t.encode().lower().split()
        for s in range(len(words) - 49):
            groups.setdefault(hash(tuple(words[s : s + 50])), set()).add(i)

    def joined(sets):
        of = {}
        for own in map(sorted, sets):
            for x in own:
                a, b = of.setdefault(x, x), of.setdefault(own[0], own[0])
                of = {k: min(a, b) if v in (a, b) else v for k, v in of.items()}
        return of

    want = joined(g for g in groups.values() if len(g) > 1)
    found = joined({r.doc_id, r.other_id} for r in QUERIES["op6_compact_windows"](docs.sparkSession, SF).collect())
    assert want and all(found[a] == found[b] for a, b in want.items())


def test_urls(spark):
    rows = [(1, "http://WWW.Example.com/en/x?a", ""), (2, "https://a.example.com/en/", ""), (3, "ftp://example.com/fr#x", ""), (4, "x://q.net/es/1", ""), (5, None, None),
            (6, "no scheme", ""), (7, "http://cheappills.org/buy", "cheap cheap pills pills"), (8, "http://example.com", ""), (8, "http://example.com", ""), (None, "http://a.b://c/d", "")]
    rows += [(100 + i, f"http://cheappills{i}.net/fr/buy", "cheap pills") for i in range(30)] + [(200 + i, f"http://garden{i}.com/roses", "garden roses") for i in range(30)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("rule", F.lit("clash"))
    found = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df).collect()}
    assert found[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and found[2] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert found[3] == ("example.com", "/fr", "com/", "allow") and found[4] == ("q.net", "/es/1", "net/es/", "block")
    assert found[5][:3] == found[6][:3] == ("", "", None) and found[7][2:] == (None, "block") and found[8][:3] == ("example.com", "", None)
    assert found[None][:2] == ("a.b:", "//c/d") and judge(df).count() == len(rows) and judge(df.limit(0)).collect() == []
