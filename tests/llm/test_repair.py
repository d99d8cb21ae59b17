"""Conversation repair against searches that try every edit."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from conftest import DATA

from creditpath.llm import queries as llm_queries
from creditpath.llm.conversation_repair import NEXT, Survivors, damaged, repair_digest, repairs

SPACE = " \t\n\x0b\x0c\r"
VALID = re.compile("(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def faults_of(rows):
    seen, found = set(), []
    for role, text in rows:
        bare = text.rstrip(SPACE)
        fault = "blank" if not bare.strip(SPACE) else "duplicate" if (role, text) in seen else None
        found.append(fault or ("truncated" if bare[-1] not in ".!?" else None))
        seen.add((role, text))
    return found


def every_way(rows):
    """(cost, audit, repaired) of the best of all edits, by trying all of up to two inserts per gap."""
    faults, best = faults_of(rows), None
    gaps = [""] + ["".join(p) for k in (1, 2) for p in itertools.product("ua", repeat=k)]
    options = []
    for (role, text), fault in zip(rows, faults):
        stays = 1 if fault == "truncated" else 0
        way = [("D", 3, "", None)]
        if fault not in ("blank", "duplicate"):
            way.append(("K", stays, role[:1] or "-", f"{role}:{text}"))
            way += [("R", 2 + stays, r[0], f"{r}:{text}") for r in ("user", "assistant")]
        options.append(way)
    names = {"u": "user:", "a": "assistant:"}
    for inserts in itertools.product(gaps, repeat=len(rows) + 1):
        for way in itertools.product(*options):
            initials = "".join(g + w[2] for g, w in zip(inserts, way)) + inserts[-1]
            if not VALID.fullmatch(initials):
                continue
            cost = sum(w[1] for w in way) + 2 * sum(map(len, inserts))
            audit = "".join("I" * len(g) + w[0] for g, w in zip(inserts, way)) + "I" * len(inserts[-1])
            if best is None or (cost, audit) < best[:2]:
                parts = []
                for g, w in zip(inserts, way):
                    parts += [names[c] for c in g] + ([w[3]] if w[0] != "D" else [])
                best = (cost, audit, "\n".join(parts + [names[c] for c in inserts[-1]]))
    return best


def plain_search(rows):
    """The same by one whole string per state; no tree, nothing dropped."""
    faults, names = faults_of(rows), {"u": "user:", "a": "assistant:"}
    after = {"": "u", "s": "u", "u": "a", "a": "u"}
    paths = {"": (0, "", ())}

    def keep(found, state, way):
        if state not in found or way < found[state]:
            found[state] = way

    def inserted(paths):
        for _ in range(3):
            for state, (cost, audit, parts) in [*paths.items()]:
                to = after[state]
                keep(paths, to, (cost + 2, audit + "I", (*parts, names[to])))

    for (role, text), fault in zip(rows, faults):
        inserted(paths)
        found, stays = {}, 1 if fault == "truncated" else 0
        for state, (cost, audit, parts) in paths.items():
            keep(found, state, (cost + 3, audit + "D", parts))
            if fault in ("blank", "duplicate"):
                continue
            to = after[state]
            full = {"u": "user", "a": "assistant"}[to]
            keep(found, to, (cost + 2 + stays, audit + "R", (*parts, f"{full}:{text}")))
            if role[:1] == to or (role[:1] == "s" and state == ""):
                keep(found, role[:1], (cost + stays, audit + "K", (*parts, f"{role}:{text}")))
        paths = found
    inserted(paths)
    cost, audit, parts = min(way for state, way in paths.items() if state in ("", "a"))
    return cost, audit, "\n".join(parts)


def some_rows(rng, n):
    roles = ["user", "assistant", "system", "tool", "", " ", "uncle"]
    texts = ["a.", "b", "", " \t", "c!", "d e", "f?"]
    return [(rng.choices(roles, [6, 6, 3, 1, 1, 1, 1])[0], rng.choice(texts)) for _ in range(n)]


def digest_rows(spark, conversations, **options):
    rows = [(c, t, role, text) for c, turns in conversations.items() for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return {r["conv_id"]: r for r in repair_digest(df, df, **options).collect()}


def test_every_way_agrees(spark):
    rng = random.Random(1)
    conversations = {i: some_rows(rng, rng.choice([1, 2, 2, 2])) for i in range(60)} | {60: some_rows(rng, 3)}
    got = digest_rows(spark, conversations)
    for i, rows in conversations.items():
        cost, audit, text = every_way(rows)
        assert (got[i]["cost"], got[i]["audit"]) == (cost, audit) == plain_search(rows)[:2], rows
        assert got[i]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest(), rows


@pytest.mark.parametrize("hot_rows", [10**6, 30])
def test_long_conversations_whole_and_in_slices(spark, hot_rows):
    rng = random.Random(2)
    conversations = {i: some_rows(rng, rng.randrange(5, 40)) for i in range(40)}
    conversations[77] = [(r, f"{t}{rng.randrange(300)}.") for r, t in some_rows(rng, 400)]
    conversations[78] = [("system", f"{i}") for i in range(200)]
    conversations[79] = [("tool", "") for _ in range(150)] + [("assistant", f"{i}!") for i in range(50)]
    got = digest_rows(spark, conversations, hot_rows=hot_rows)
    for i, rows in conversations.items():
        cost, audit, text = plain_search(rows)
        assert (got[i]["cost"], got[i]["audit"]) == (cost, audit), rows
        assert got[i]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        faults = faults_of(rows)
        assert [got[i][f] for f in ("blank", "duplicate", "truncated")] == [
            faults.count(f) for f in ("blank", "duplicate", "truncated")
        ]
        pairs = [a[0][:1] + b[0][:1] for a, b in zip(rows, rows[1:])]
        assert got[i]["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)


def test_paths_coalesce(spark):
    """Only a few nodes stay however long the conversation is."""
    rng = random.Random(3)
    for make in (
        lambda: [(role, f"{i}{text}") for i, (role, text) in enumerate(some_rows(rng, 3000))],
        lambda: some_rows(rng, 6) * 10 + [(r, f"{i}.") for i in range(1470) for r in ("user", "assistant")],
        lambda: [(r, f"{i}") for i in range(1500) for r in ("user", "assistant")],
        lambda: [("user", "")] * 3000,
    ):
        final, most = [], 0
        search = Survivors(lambda state, edits, to=final: to.append(edits))
        rows = make()
        for (role, _), fault in zip(rows, faults_of(rows)):
            search.row(role[:1], fault)
            most = max(most, max(len(search.unresolved(s)) for s in search.paths))
        assert most < 100 and len(final) > 2890


def test_edges(spark):
    rows = [
        (1, None, "user", "first."),
        (1, 3, None, "x."),
        (1, 3, "user", None),
        (1, 7, "assistant", "last" * 100_000),
        (None, 1, "user", "no id."),
        (2, 5, "user", "same."),
        (2, 5, "user", "same."),
        (3, None, "system", "s."),
    ]
    df = spark.createDataFrame([(*r, "extra", 1.5) for r in rows], SCHEMA + ", same string, slice double")
    got = {r["conv_id"]: r for r in repair_digest(df, df.select("conv_id").union(spark.range(9, 10))).collect()}
    assert (got[1]["gaps"], got[1]["blank"], got[1]["truncated"]) == (3, 1, 1)
    assert got[1]["audit"] == plain_search([("user", "first."), (" ", "x."), ("user", " "), ("assistant", "last")])[1]
    assert got[None]["audit"] == "KI"
    assert (got[2]["duplicate"], got[2]["audit"], got[2]["gaps"]) == (1, "DKI", 0) or got[2]["audit"] == "KDI"
    assert (got[3]["gaps"], got[3]["audit"]) == (0, "D")
    assert got[9].asDict() == {
        "conv_id": 9, "gaps": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "cost": 0, "audit": "",
        "repaired_sha256": hashlib.sha256().hexdigest(),
    }
    assert repairs(df.limit(0)).count() == 0
    assert set(NEXT) == set(range(4))


def test_query_against_plain_search(spark):
    folder = f"{DATA}/sf0.001"
    by_conv = {}
    rows = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    for r in sorted(rows, key=lambda r: (r["conv_id"], r["turn"])):
        kind = zlib.crc32(f"{r['conv_id']}:{r['turn']}".encode()) % 20
        role, text = r["role"], r["text"]
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found = by_conv.setdefault(r["conv_id"], [])
        found += [("user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    got = {r["conv_id"]: r for r in llm_queries.op13_conversation_repair(spark, folder).collect()}
    assert set(got) == set(by_conv)
    for i, rows in by_conv.items():
        cost, audit, text = plain_search(rows)
        assert (got[i]["cost"], got[i]["audit"]) == (cost, audit)
        assert got[i]["repaired_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert damaged(spark.createDataFrame([], SCHEMA)).count() == 0
