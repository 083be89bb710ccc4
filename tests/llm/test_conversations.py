"""Conversation repair against all edits of short conversations and a plain replay of the damage."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from tickloom.llm.catalog import QUERIES
from tickloom.llm.conversations import CLOSING, SEGMENT, START, chained, damaged, repair, repaired, search, segment, summaries

SF = "/root/testdata/sf0.001"
LEGAL = re.compile(r"(s?(ua)+)?")
PRICE = {"K": 0, "R": 3, "D": 4}
WHITE = " \t\n\x0b\x0c\r"


def all_edits(letters):
    """Least (cost, audit, roles) over every edit of every row and up to two inserts in every gap."""
    best = None
    for edits in itertools.product("KRD", repeat=len(letters)):
        if any(f in (1, 2) and e != "D" for (_, f), e in zip(letters, edits, strict=True)):
            continue
        own = sum(PRICE[e] + (3 if f == 3 and e != "D" else 0) for (_, f), e in zip(letters, edits, strict=True))
        for inserts in itertools.product(range(3), repeat=len(letters) + 1):
            cost = own + 3 * sum(inserts)
            if best and cost > best[0]:
                continue
            audit = "I" * inserts[0] + "".join(e + "I" * n for e, n in zip(edits, inserts[1:], strict=True))
            slots = ["?"] * inserts[0]
            for (initial, _), e, n in zip(letters, edits, inserts[1:], strict=True):
                slots += [] if e == "D" else [initial if e == "K" else "?"]
                slots += ["?"] * n
            free = slots.count("?")
            if any(LEGAL.fullmatch("".join(next(it) if x == "?" else x for x in slots)) for it in map(iter, itertools.product("ua", repeat=free))):
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_search_equals_all_edits():
    rng = random.Random(1)
    for _ in range(60):
        letters = tuple((rng.choice("suuaa-"), rng.choice((0, 0, 0, 1, 2, 3))) for _ in range(rng.randrange(5)))
        assert search(letters, START, CLOSING) == all_edits(letters), letters


def test_segments_give_what_one_search_gives():
    rng = random.Random(2)
    for _ in range(30):
        letters = tuple((rng.choice("suuaaua-"), rng.choice((0, 0, 0, 0, 1, 2, 3))) for _ in range(rng.randrange(60)))
        size = rng.randrange(1, 12)
        assert chained([segment(letters[at : at + size]) for at in range(0, len(letters), size)]) == search(letters, START, CLOSING)


def replay(rows):
    """rows of one conversation in order -> the summary, by edit costs worked forward over all states."""
    seen, letters = set(), []
    for _, role, text in rows:
        fault = 1 if not text.strip(WHITE) else 2 if (role, text) in seen else 3 if text.rstrip(WHITE)[-1] not in ".!?" else 0
        seen.add((role, text))
        letters.append((role[:1] if role[:1] in ("s", "u", "a") else "-", fault))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    states = {"": (0, "", ())}  # the last role kept -> cost, audit, repaired rows

    def closed(found):
        for _ in range(2):
            for last, (cost, audit, out) in list(found.items()):
                role = "assistant" if last == "u" else "user"
                label = (cost + 3, audit + "I", (*out, (role, "")))
                found[role[0]] = min(found.get(role[0], label), label, key=lambda x: x[:2])
        return found

    for (initial, fault), (_, role, text) in zip(letters, rows, strict=True):
        after = {}
        for last, (cost, audit, out) in closed(states).items():
            options = [("D", 4, last, ())]
            if fault not in (1, 2):
                extra = 3 if fault == 3 else 0
                turned = "assistant" if last == "u" else "user"
                options.append(("R", 3 + extra, turned[0], ((turned, text),)))
                if last + initial in ("s", "u", "su", "ua", "au"):
                    options.append(("K", extra, initial, ((role, text),)))
            for edit, price, now, more in options:
                label = (cost + price, audit + edit, (*out, *more))
                after[now] = min(after.get(now, label), label, key=lambda x: x[:2])
        states = after
    cost, audit, out = min((v for k, v in closed(states).items() if k in ("", "a")), key=lambda x: x[:2])
    illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(letters, letters[1:], strict=False))
    faults = [f for _, f in letters]
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest()
    return gaps, faults.count(1), faults.count(2), faults.count(3), illegal, cost, audit, digest


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind, role, text = zlib.crc32(key.encode()) % 20, " " if role is None else role, " " if text is None else text
        if kind:
            row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
            out += [row] * (2 if kind == 3 else 1)
    return out


def wanted(rows):
    own = {conv: [] for conv, *_ in rows}
    for conv, turn, role, text in damage(rows):
        own[conv].append((turn, role, text))
    tie = lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest())
    return {conv: replay(sorted(found, key=tie)) for conv, found in own.items()}


def found(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in df.collect()}


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_query_equals_the_replay(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(QUERIES["op12_conversation_repair"](spark, sf)) == wanted(rows)


SCHEMA = "conv_id long, turn long, role string, text string, digest string, audit string, letter int"


def test_awkward_conversations(spark):
    rng = random.Random(4)
    rows = [(1, None, "user", "Hi."), (1, None, None, None), (1, 3, "", "Text."), (1, 3, "assistant", "Other."), (None, 1, "user", "Ok?"), (None, 2, "assistant", "no end"),
            (2, 5, "system", "\t\n "), (2, 5, "system", "\t\n "), (3, 1, "user", "A b. \n"), (3, 1, "user", "A b. \n"), (4, None, None, None)]
    rows += [(5, t, rng.choice(["user", "assistant", "system", "tool", "Ünder"]), rng.choice(["Yes.", "no", "", "x" * 50_000 + "!", f"t{t}?"])) for t in range(0, 600, 2)]
    df = spark.createDataFrame([(*r, "d", "a", 1) for r in rows], SCHEMA)
    out = repair(damaged(df), df.select("conv_id"))
    assert found(out) == wanted(rows) and len(rows) > 4 * SEGMENT
    none = df.limit(0)
    assert repair(damaged(none), none.select("conv_id")).collect() == []
    dropped = next(c for c in range(10, 10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    gone = spark.createDataFrame([(dropped, 0, "user", "Hi.", "", "", 0)], SCHEMA)
    assert found(repair(damaged(gone), gone.select("conv_id"))) == {dropped: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_a_conversation_over_many_tasks(spark):
    rng = random.Random(6)
    rows = [(7, t // 3, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"Text {t}."])) for t in range(1500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert found(repair(damaged(df), df.select("conv_id"))) == wanted(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_repaired_rows_and_string_ids(spark):
    df = spark.createDataFrame([("c", 1, "user", "Hi."), ("c", 2, "tool", "Done."), ("c", 3, "assistant", "End")], "conv_id string, turn int, role string, text string")
    own = summaries(df)
    assert [(r.cost, r.audit) for r in own.collect()] == [(7, "KDK")]
    rows = [(r.position, r.edit, r.role, r.text) for r in repaired(df, own).orderBy("position").collect()]
    assert rows == [(0, "K", "user", "Hi."), (1, "K", "assistant", "End")]
