"""Structure repair and the prefix trie against plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from weft.llm import repair as module
from weft.llm.prefixtrie import prefix_trie, sequences, spliced
from weft.llm.repair import audited, edits_of, repair

SCHEMA = "conv_id long, turn long, role string, text string, conv long, part string, n int, audit string"


def table(spark, rows):
    """Conversations with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, 7, "x", 3, "KK") for r in rows], SCHEMA)


def plain_audit(turns):
    """(cost, audit, repaired turns) by keeping every state's least (cost, audit)."""
    due = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    live = {"": (0, "", ())}

    def inserted(live):
        for _ in range(3):
            more = dict(live)
            for s, (cost, audit, out) in live.items():
                way = (cost + 3, audit + "I", (*out, (name[due[s]], "")))
                more[due[s]] = min(more.get(due[s], way), way)
            live = more
        return live

    for role, text, fault in turns:
        ways = {}
        for s, (cost, audit, out) in inserted(live).items():
            own = [(s, 4, "D", out)]
            late = 3 if fault == "truncated" else 0
            if fault not in ("blank", "duplicate"):
                own.append((due[s], 3 + late, "R", (*out, (name[due[s]], text))))
                i = role[:1]
                if i in ("u", "a") and due[s] == i or i == "s" and s == "":
                    own.append((i, late, "K", (*out, (role, text))))
            for to, more, edit, kept in own:
                way = (cost + more, audit + edit, kept)
                ways[to] = min(ways.get(to, way), way)
        live = ways
    live = inserted(live)
    return min(live[s] for s in ("", "a") if s in live)


def plain_conversation(rows):
    """What repair() says of (turn, role, text) rows, and the repaired turns."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, turns, counts = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "" if body[-1] in ".!?" else "truncated"
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        turns.append((role, text, fault))
    known = [t for t, _, _ in rows if t is not None]
    gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, out = plain_audit(turns)
    return {"gaps": gaps, **counts, "illegal": illegal, "cost": cost, "audit": audit}, list(out)


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        k = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = show(role), show(text)
        if k:
            text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
            out += [(c, t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    return out


def grouped(rows):
    by = {}
    for c, *r in rows:
        by.setdefault(c, []).append(r)
    return by


def random_rows(n, seed, longest=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, longest)):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "", None, "User", "sys"])
            text = rng.choice(["Yes.", "No!", "hm", "", None, " \t", "Why?  ", "a.b", "é.", "x" * 70 + ".", "x" * 70 + "!"])
            rows.append((c if c else None, rng.choice([t, t, t, t + rng.randrange(0, 3), None]), role, text))
    return rows


def test_least_audit_is_the_plain_one():
    """Every conversation of up to four turns, and longer ones at random, from Hirschberg's halves."""
    roles, faults = ["", "s", "u", "a"], ["", "truncated", "blank"]
    for seed in range(4000):
        rng = random.Random(seed)
        turns = [(rng.choice(roles), "t", rng.choice(faults[: rng.choice([1, 2, 3])])) for _ in range(rng.choice([0, 1, 2, 3, 4, 7, 30]))]
        codes = bytes(roles.index(r) + 4 * faults.index(f) for r, _, f in turns)
        edits, cost, state = edits_of(codes, 0, module.TAIL_COST)
        assert (cost + 3 * len(module.TAIL[state]), "".join(edits) + module.TAIL[state]) == plain_audit(turns)[:2]


@pytest.mark.parametrize("parts", [1, 7])
def test_repair(spark, parts):
    """Nulls, ties, repeated rows, and one conversation that lies over all partitions."""
    rows = random_rows(60, 5) + [(99, i % 70 if i % 3 else None, random.Random(i).choice(["user", "assistant"]), f"{i % 50}.") for i in range(400)] + [(98, 1, "user", "same.")] * 300
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found, turns = repair(table(spark, rows))
        got = {r.conv_id: r.asDict() for r in found.collect()}
        mended = {}
        for r in sorted(turns.collect(), key=lambda r: r.place):
            assert r.place == len(mended.setdefault(r.conv_id, []))
            mended[r.conv_id].append((r.role, r.text))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = grouped(rows)
    assert got.keys() == want.keys()
    for c, own in want.items():
        summary, out = plain_conversation(own)
        assert got[c] == {"conv_id": c, **summary} and mended.get(c, []) == out
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in out))


def test_audited(spark):
    rows = random_rows(200, 8) + [(5000, 1, "user", "word " * 200000 + "."), (5001, 0, None, None)]
    rows += [(c, 0, "user", "Dropped.") for c in range(6000, 6100) if zlib.crc32(f"{c}:0".encode()) % 20 == 0]
    got = {r.conv_id: r.asDict() for r in audited(table(spark, rows)).collect()}
    damaged = grouped(plain_damage(rows))
    assert got.keys() == {r[0] for r in rows} and len(damaged) < len(got)
    for c, r in got.items():
        summary, out = plain_conversation(damaged.get(c, []))
        digest = hashlib.sha256("\n".join(f"{a}:{b}" for a, b in out).encode()).hexdigest()
        assert r == {"conv_id": c, **summary, "repaired_sha256": digest}
    assert audited(table(spark, [])).count() == 0


def test_repair_of_text_ids(spark):
    frame = table(spark, random_rows(20, 3)).withColumn("conv_id", module.F.concat(module.F.lit("c"), "conv_id"))
    want = grouped([(None if c is None else f"c{c}", *r) for c, *r in random_rows(20, 3)])
    got = {r.conv_id: r.audit for r in repair(frame)[0].collect()}
    assert got == {c: plain_conversation(own)[0]["audit"] for c, own in want.items()}


def plain_trie(seqs):
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of {id: [(role, text)]}, by prefix."""
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(tuple(s[:d]), []).append(c)
    rows = []
    for node, own in members.items():
        below = [p for p in members if p[: len(node)] == node]
        leaves = sum(not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below) for p in below)
        saved = sum((len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0) for p in below)
        ends = ",".join(map(str, sorted(c for c in own if len(seqs[c]) == len(node))))
        children = sum(len(p) == len(node) + 1 for p in below)
        rows.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=str)


def plain_sequences(rows):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    return {c: [r[2:] for r in sorted(own)] for c, own in by.items() if c is not None}


def test_prefix_trie(spark):
    """Copies, prefixes of one another, turns without text, and blocks of a few conversations or turns."""
    rng = random.Random(4)
    rows = []
    for c in range(1, 160):
        kind = rng.randrange(4)
        n = rng.randrange(1, 7)
        turns = [("user", "same"), ("assistant", "é" * 3)] if kind == 0 else [(rng.choice(["user", None]), rng.choice(["a", "b", "", None])) for _ in range(n)]
        rows += [(c, t if rng.random() < 0.9 else None, *x) for t, x in enumerate(turns)]
    rows += [(c, t, "user", f"{t}") for c in (300, 301, 302) for t in range(40 + c % 3)] + [(None, 0, "user", "no id")]
    want = plain_trie(plain_sequences(rows))
    frame = sequences(table(spark, rows))
    for limits in ({}, {"block_rows": 5}, {"block_turns": 30}):
        got = [tuple(r) for r in prefix_trie(frame.repartition(3), **limits).collect()]
        assert sorted(got, key=str) == want
    assert prefix_trie(sequences(table(spark, []))).count() == 0


def test_spliced(spark):
    """Bases that are absent or short, and conversations that end up without turns."""
    rows = [(c, t, "user", f"{c} {t}") for c in range(1, 120) if c % 10 for t in range(c % 12)] + [(-7, 0, "user", "x"), (-5, 0, None, None), (40, None, "a", None)]
    seqs = plain_sequences(rows)
    want = {}
    for c, own in seqs.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(c / 5) * 5  # the remainder has the sign of c
        want[c] = seqs.get(c - base, [])[:h] + own[h:]
    got = [tuple(r) for r in prefix_trie(spliced(sequences(table(spark, rows)))).collect()]
    assert any(not s for s in want.values()) and sorted(got, key=str) == plain_trie(want)
