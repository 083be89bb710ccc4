"""The corpus pipeline against a plain replay of its five stages."""

import hashlib
import math
import re
import unicodedata

import numpy as np
import public_tokenizers
import tiktoken
import xxhash

import corpus_pipeline
from tickloom.llm.bpe import BytePairs

SF = "/root/testdata/sf0.001"
WHITE = r"[\x20\x09-\x0D]+"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def words_of(text):
    return [w for w in re.split(WHITE, text or "") if w]


def known_language(rows):
    return [r for r in rows if any(unicodedata.category(c).startswith("L") for c in r[1] or "")]


def first(rows):
    return min(rows, key=lambda r: (r[0] is None, r[0] or 0))


def distinct(rows):
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(WHITE, " ", r[1] or ""), []).append(r)
    return [first(g) for g in groups.values()]


def fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
    return sum(1 << b for b in range(64) if 2 * int((hashes >> np.uint64(b) & np.uint64(1)).sum()) > len(hashes))


def near(rows):
    marks = np.array([fingerprint(r[1]) for r in rows], np.uint64)
    of = list(range(len(rows)))
    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(marks ^ marks[i]) <= 3):
            a, b = of[i], of[j]
            of = [min(a, b) if x in (a, b) else x for x in of]
    groups = {}
    for r, o in zip(rows, of, strict=True):
        groups.setdefault(o, []).append(r)
    return [first(g) for g in groups.values()]


def budgets(sizes):
    """Water filling: shares in proportion to the weights, a source over twice its size gives the excess back."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    out, open_, left = {}, set(names), 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not full:
            return out | {s: weight[s] * level for s in open_}
        out |= {s: 2.0 * sizes[s] for s in full}
        left -= sum(2.0 * sizes[s] for s in full)
        open_ -= full
    return out


def mixed(rows):
    def key(r):
        words = words_of(r[1])
        u = (int(hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
        return -math.log(u) / (0.1 + 0.9 * len(set(words)) / len(words))

    by_source = {}
    for r in rows:
        by_source.setdefault(r[2], []).append(r)
    sizes = {s: sum(len(words_of(r[1])) for r in own) for s, own in by_source.items()}
    out = []
    for source, target in budgets(sizes).items():
        epochs = math.floor(target / sizes[source])
        rest = round(target - epochs * sizes[source])
        for r in sorted(by_source[source], key=key):
            size = len(words_of(r[1]))
            drawn = max(0, min(size, rest))
            rest -= drawn
            out += [r] * math.ceil((epochs * size + drawn) / size)
    return out


def test_run_equals_the_replay(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    own = docs.collect()
    text = own[3].text
    extra = [(None, "A document without an id, of its own kind, that nobody else has written.", None, "web", 1), (10**6, text, "en", None, 1), (10**6 + 1, text + " end", "en", None, 1),
             (10**6 + 2, None, "en", "web", 1), (10**6 + 3, "12 34 !", "en", "web", 1), (10**6 + 4, "", "en", None, 1), (10**6 + 5, "Seul ici, ce texte est \t d'une source sans nom.", "fr", None, 1)]
    repeated = [tuple(own[5]), tuple(own[5]), tuple(own[9]), extra[-1]]
    docs.unionByName(spark.createDataFrame(extra + repeated, docs.schema)).write.parquet(str(tmp_path / "documents.parquet"))
    rows = [(r[0], r[1], r[3]) for r in [*map(tuple, own), *extra, *repeated]]
    kept = near(distinct(known_language(rows)))
    assert 20 < len(kept) < len(rows)
    pairs = BytePairs.load(RANKS)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={b: r for r, b in pairs.bytes_of.items()}, special_tokens={})

    def tokens(r):
        ids = library.encode_ordinary(r[1])
        return str(r[0]), len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()

    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in found) == sorted(map(tokens, mixed(kept)))
