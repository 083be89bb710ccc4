"""Awkward rows, repeated rows, empty tables and clashing columns: defined results from every document operator."""

import re

import public_tokenizers
import pytest

import corpus_pipeline
from tickloom.llm.bpe import tokenized
from tickloom.llm.exact_dedup import exact_dedup, keep_distinct
from tickloom.llm.langid import identify, in_known_language
from tickloom.llm.line_dedup import line_dedup
from tickloom.llm.mixing import mix, mixed_documents
from tickloom.llm.passages import passages
from tickloom.llm.pii import redacted, sanitise
from tickloom.llm.simhash import one_of_each, simhash

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PER_DOCUMENT = {
    "line": line_dedup, "pii": sanitise, "exact": exact_dedup, "lang": identify, "simhash": simhash, "mix": mix,
    "bpe": lambda d: tokenized(d, RANKS, public_tokenizers.PATTERN),
}


@pytest.mark.parametrize("name", PER_DOCUMENT)
def test_one_row_for_each_document_and_none_for_none(awkward, nothing, name):
    out = PER_DOCUMENT[name](awkward)
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(str(r.doc_id) for r in awkward.collect())
    assert PER_DOCUMENT[name](nothing).collect() == []


@pytest.mark.parametrize("stage", [keep_distinct, one_of_each, mixed_documents, in_known_language])
def test_filters_return_the_columns_they_got(awkward, nothing, stage):
    out = stage(awkward)
    assert out.columns == awkward.columns
    assert all(r["row"] == "y" and r["_id"] == "x" and r["found"] == "z" and r["size"] == 1 for r in out.collect())
    assert stage(nothing).collect() == []


def test_exact_dedup(awkward):
    rows = exact_dedup(awkward).collect()
    at = {r.doc_id: r for r in rows if r.doc_id not in (None, 8)}
    assert (at[2].keep_id, at[2].group_size, at[2].kept) == (1, 2, False) and at[1].kept
    assert at[4].keep_id == 3 and not at[4].kept and at[3].group_size == 2  # null is empty; white space alone is one space
    assert at[5].group_size == 1 and at[7].keep_id == 6
    assert sorted(r.kept for r in rows if r.doc_id == 8) == [False, True]
    assert sorted(r.kept for r in rows if r.doc_id is None) == [False, True] and all(r.keep_id is None for r in rows if r.doc_id is None)
    assert sorted(str(r.doc_id) for r in keep_distinct(awkward).collect()) == ["1", "3", "5", "6", "8", "9", "None"]


def test_heavy_digests_take_the_broadcast_path(spark):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"t{i % 30}") for i in range(300)], "doc_id long, text string")
    few = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(df, counters=4).collect()}
    many = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup(df).collect()}
    assert few == many and few[1] == (1, 200, True) and few[2] == (1, 200, False) and few[33] == (3, 10, False)


def test_language(awkward):
    rows = [(r.doc_id, r.lang_pred, r.score) for r in identify(awkward).collect()]
    assert {(i, p, s) for i, p, s in rows if i in (3, 4, 5, 9)} == {(i, "und", 0.0) for i in (3, 4, 5, 9)}
    assert all(0 <= s <= 1 for _, _, s in rows)
    assert sorted(str(r.doc_id) for r in in_known_language(awkward).collect()) == ["1", "2", "6", "7", "8", "8", "None", "None"]


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "some words", None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in identify(df).collect()] == [("und", 0.0)]


def test_simhash(awkward):
    rows = {r.doc_id: r for r in simhash(awkward).collect()}
    assert {rows[i].fingerprint for i in (3, 4, 5)} == {"0" * 16} and {rows[i].component_id for i in (3, 4, 5)} == {3}
    assert rows[7].component_id == 6 and rows[2].component_id == 1 and rows[None].component_id is None
    assert sorted(str(r.doc_id) for r in one_of_each(awkward).collect()) == ["1", "3", "6", "8", "8", "9", "None", "None"]


def test_mix_meets_its_targets(awkward):
    rows = mix(awkward).collect()
    assert mix(awkward).exceptAll(mix(awkward)).isEmpty()
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        assert sum(r.size for r in own) == own[0].source_size
        assert abs(sum(r.taken for r in own) - own[0].target) <= 1
        assert all(0 <= r.taken <= 2 * r.size for r in own) and own[0].target <= 2 * own[0].source_size
    total = sum({r.source: r.target for r in rows}.values())
    assert abs(total - 1.5 * sum(r.size for r in rows)) < 1e-6 * total


def test_personal_data(spark):
    text = "😀 a@b.co_x@y.zz 1.2.3.4 256.1.1.1 4111 1111 1111 1111 4111 1111 1111 1112, +1 (555) 123-4567 x " + "9" * 40_000 + "a" * 40_000 + "@"
    df = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    out = sanitise(df)
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[1].spans == "email:2:8,email:8:15,ip:16:23,phone:75:92" and rows[1].n_card == 0  # both numbers are one chain of digits
    assert rows[2].spans == "" and rows[2].n_email == 0
    clean = {r.doc_id: r.text for r in redacted(df, out).collect()}
    assert clean[1].startswith("😀 [EMAIL][EMAIL] [IP] 256.1.1.1 ") and clean[2] is None


def test_terms_that_reveal_an_entity(spark):
    rows = [(i, f"alpha beta {'zorro' if i < 6 else 'plain'} writes {'z@x.org' if i < 6 else 'often'} gamma delta") for i in range(40)]
    rows.append((40, "zorro alone"))
    spans = {r.doc_id: r.spans for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert spans[0] == "email:24:31,removed:11:16"  # in seven texts, six of them with the address: ln(41 / 7) of ln(41 / 6)
    assert spans[7] == "" and spans[40] == ""


def test_passages(spark, awkward, nothing):
    shared = " ".join(f"w{i}" for i in range(51))
    rows = [(i, f"{' '.join(f'a{i}x{j}' for j in range(70 + i))} {shared} {' '.join(f'b{i}x{j}' for j in range(40))}") for i in range(12)]
    rows += [(100, " ".join(f"c{j}" for j in range(300))), (101, None), (None, shared)]
    found = passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in found} == set(range(12)) == {r.other_id for r in found}
    assert all(abs(r.start_word - (70 + r.doc_id)) <= 6 and r.similarity >= 0.8 for r in found)
    assert {r.doc_id for r in passages(awkward).collect()} == {6, 7}  # the long copies
    assert passages(nothing).collect() == []


def test_lines(awkward, spark):
    line = "  This Line is shared by a number of different documents \t"
    df = spark.createDataFrame([(i, f"{i}\n{line if i % 2 else line.upper()}\nshort") for i in range(6)] + [(None, line)], "doc_id long, text string")
    rows = {r.doc_id: r for r in line_dedup(df).collect()}
    assert [rows[i].n_dropped for i in range(6)] == [1, 1, 1, 1, 1, 0] and rows[0].kept_text == "0\nshort" and rows[None].n_dropped == 1
    few = {r.doc_id: r.kept_sha256 for r in line_dedup(df, shard_keys=1).collect()}
    assert few == {k: r.kept_sha256 for k, r in rows.items()}
    assert {r.doc_id: r.n_lines for r in line_dedup(awkward).collect()}[3] == 1


def test_pipeline_on_awkward_rows(spark, awkward):
    docs = awkward.select("doc_id", "text", "lang", "source")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns == ["doc_id", "text", "lang", "source"]
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()} <= {1, 6, 8, None}


def test_passages_of_long_copies_are_whole_spans(spark):
    words = [f"w{i}" for i in range(3000)]
    near = words[:1200] + [f"new{i}" for i in range(100)] + words[1300:1500] + [f"fresh{i}" for i in range(1500)]
    rows = [(1, " ".join(words)), (2, "x y z " + " ".join(words)), (3, " ".join(near))]
    found = [tuple(r) for r in passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert (2, 3, 1, 0, 3000, 1.0) in found and (1, 0, 2, 3, 3000, 1.0) in found
    spans = sorted((f[1], f[1] + f[4]) for f in found if f[0] == 3 and f[2] == 1)
    assert len(spans) == 2 and spans[0][0] == 0 and abs(spans[0][1] - 1200) <= 6 and abs(spans[1][0] - 1300) <= 6 and abs(spans[1][1] - 1500) <= 6


def test_one_of_each_drops_rows_not_ids(spark):
    words = [f"w{i}" for i in range(400)]
    near, far = " ".join([*words[:-1], "other"]), [" ".join(f"{c}{i}" for i in range(300)) for c in "abc"]
    rows = [(1, " ".join(words)), (None, near), (None, far[0]), (2, near), (2, far[1]), (None, far[2]), (None, far[2] + " more")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    of = {(r.doc_id, r.fingerprint): r.component_id for r in simhash(df).collect()}
    assert sorted(str(c) for c in of.values()) == ["1", "1", "1", "2", "None", "None", "None"]  # the cases are what they should be
    kept = [(r.doc_id, r.text) for r in one_of_each(df).collect()]
    assert {(1, rows[0][1]), (None, far[0]), (2, far[1])} <= set(kept) and len(kept) == 4
    assert sum(t.startswith(far[2]) for _, t in kept) == 1


def test_terms_far_from_their_entity(spark):
    far = " filler" * 60
    rows = [(i, f"Zorro opens, {'z@x.org' if i < 6 else 'nobody'} writes{far} and zorroé zorro again" if i < 6 else f"plain text opens, nobody writes{far}") for i in range(40)]
    rows += [(0, rows[0][1]), (None, rows[0][1]), (50, "xzorro@x.org zorro@x.org")]
    text = rows[0][1]
    spans = [(r.doc_id, r.spans) for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    zorro = [m for m in re.finditer(r"(?i)\bzorro\b", text)]
    want = {f"removed:{m.start()}:{m.end()}" for m in zorro}
    assert len(zorro) == 2 and zorro[1].start() - text.index("z@x.org") > 400
    assert all(want <= set(s.split(",")) for i, s in spans if i in (0, 1, 5, None)) and all(s == "" for i, s in spans if i in (6, 39))
    assert len({s for i, s in spans if i in (0, None)}) == 1


def test_repeated_rows_count_once_for_personal_terms(spark):
    rng = __import__("random").Random(9)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in ("lm", "rt", "st", "nd")]
    rows = [(i, " ".join(rng.choices(words, k=12)) + (" the heron of Lund hides ann.x@mail.org" if i % 7 == 0 else "")) for i in range(42)]
    plain = {r.doc_id: r.spans for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert any("removed" in s for s in plain.values())
    for repeated in (rows * 2, rows + [r for r in rows if r[0] % 7 == 0] * 5, rows + rows[1:2] * 30):
        found = sanitise(spark.createDataFrame(repeated, "doc_id long, text string")).collect()
        assert len(found) == len(repeated) and all(plain[r.doc_id] == r.spans for r in found)
