"""Conversation repair against a search over all edit strings, and against a plain program over whole strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from caseframe.llm import repair

PATTERN = re.compile(r"(s?(ua)+)?\Z")
ROWS = "conv_id long, turn long, role string, text string"


def harmed(rows):
    """Rows of one conversation after the made faults, in order."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    mark = lambda r: hashlib.sha256(f"{r[1]}\0{r[2]}".encode()).digest()
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2][:64].encode(), mark(r)))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        ink = text.strip(" \t\n\v\f\r")
        out.append("blank" if not ink else "duplicate" if (role, text) in seen else "" if ink[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def plain(turns):
    """The same program with whole strings: (cost, audit)."""
    moves = {0: 2, 1: 2, 2: 3, 3: 2}

    def inserted(best):
        for _ in range(4):
            for p, (c, a) in list(best.items()):
                best[moves[p]] = min(best.get(moves[p], (c + 3, "")), (c + 2, a + "I"))
        return best

    best = inserted({0: (0, "")})
    for initial, fault in turns:
        late, after = int(fault == "truncated"), {}
        for p, (c, a) in best.items():
            options = [(p, c + 3, "D")]
            if fault in ("", "truncated"):
                keep = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}.get(initial, {}).get(p)
                options += [(moves[p], c + 2 + late, "R")] + ([(keep, c + late, "K")] if keep is not None else [])
            for q, cost, edit in options:
                after[q] = min(after.get(q, (cost, a + edit)), (cost, a + edit))
        best = inserted(after)
    return min(best[p] for p in (0, 3) if p in best)


def rebuilt(audit, rows):
    place, out, left = 0, [], iter(rows)
    nexts = {0: "user", 1: "user", 2: "assistant", 3: "user"}
    for edit in audit:
        if edit == "I":
            role, text = nexts[place], ""
        else:
            _, role, text = next(left)
            if edit == "D":
                continue
            role = nexts[place] if edit == "R" else role
        out.append(f"{role}:{text}")
        place = "sua".index(role[0]) + 1
    return out


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        now = harmed([r for r in rows if r[0] == conv])
        kinds = faults(now)
        cost, audit = plain([(r[1][:1], k) for r, k in zip(now, kinds)])
        dates = {r[0] for r in now} - {None}
        gaps = max(dates) - min(dates) + 1 - len(dates) if dates else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(now, now[1:]))
        text = "\n".join(rebuilt(audit, now))
        out.append((conv, gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(frame, **options):
    return sorted(map(tuple, repair.audits(repair.damaged(frame), **options).collect()), key=repr)


def some_rows(seed, n=40, longest=14):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "Ünit"]
    texts = ["a.", "b", "c!", "d?\n", " ", "", None, "a.", "ü.", "e. \t", "no end", "x" * 70 + ".", "x" * 70 + "!"]
    rows = []
    for conv in [*range(n), None]:
        for k in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([k, k, k, k + 2, None, 3]), rng.choice(roles), rng.choice(texts)))
    return rows


@pytest.mark.parametrize("prime", [repair.HASH_PRIME, 1, 3])
def test_cheapest_edits_against_all_edits(prime):
    """Prime 1 makes all hashes equal, so every comparison must see the collision."""
    rng = random.Random(3)
    for _ in range(150):
        turns = [(rng.choice("suaat"), rng.choice(["", "", "truncated", "blank", "duplicate"])) for _ in range(rng.randint(0, 4))]
        found = []
        for size in range(2 * len(turns) + 3):
            for edits in itertools.product("DIKR", repeat=size):
                if sum(e != "I" for e in edits) != len(turns) or edits.count("I") > 3:
                    continue
                states, left = [("", 0)], iter(turns)
                for e in edits:
                    if e == "I":
                        states = [(s + r, c + 2) for s, c in states for r in "ua"]
                        continue
                    initial, fault = next(left)
                    late = int(fault == "truncated")
                    if e == "D":
                        states = [(s, c + 3) for s, c in states]
                    elif fault in ("blank", "duplicate"):
                        states = []
                    else:
                        states = [(s + r, c + late + (0 if e == "K" else 2)) for s, c in states for r in (initial if e == "K" else "ua")]
                found += [(c, "".join(edits)) for s, c in states if PATTERN.match(s)]
            if size >= len(turns) + 3 or size > 6:
                break
        best = repair.cheapest([repair.Turn(*t) for t in turns], prime=prime)
        assert min(best[p] for p in repair.ENDS if p in best) == min(found) == plain(turns)


def test_nodes_and_order():
    audits = repair.Audits()
    words = ["", "D", "DI", "DIK", "DK", "KKKKKKKKD", "KKKKKKKKI", "KKKKKKKKIR", "R" * 50 + "D", "R" * 50 + "K"]
    nodes = {}
    for w in words:
        node = 0
        for letter in w:
            node = audits.extend(node, letter)
        nodes[w] = node
        assert audits.text(node) == w
    for a, b in itertools.permutations(words, 2):
        assert audits.less(nodes[a], nodes[b]) == (a < b)


@pytest.mark.parametrize("seed", range(3))
def test_random_conversations(spark, seed):
    rows = some_rows(seed)
    assert got(spark.createDataFrame(rows, ROWS).repartition(5)) == brute(rows)


def test_conversations_over_many_stretches(spark):
    rng = random.Random(8)
    rows = [(1, k, rng.choice(["user", "assistant", "system"]), rng.choice(["a.", "b", f"{k}.", f"{k}!", " "])) for k in range(400)]
    rows += [(2, k, "user" if k % 2 else "assistant", f"t {k}.") for k in range(150)] + some_rows(4, 6)
    rows += [(3, None, "user", "same.")] * 60
    want = brute(rows)
    assert got(spark.createDataFrame(rows, ROWS).repartition(3)) == want
    assert got(spark.createDataFrame(rows, ROWS).repartition(3), longest=5) == want
    chain = repair.Chain()
    turns = [repair.Turn(r[1][:1], k) for now in [harmed(rows[:400])] for r, k in zip(now, faults(now))]
    for k in range(0, len(turns), 7):
        paths = [(s, e, *f) for s in range(4) for e, f in repair.cheapest(turns[k : k + 7], s).items()]
        chain.add([dict(zip(repair.PATH, p)) for p in paths])
    cost, parts = chain.end()
    assert (cost, "".join(a for _, a in parts)) == plain([(t.initial, t.fault) for t in turns])


def test_turns_are_those_of_the_digest(spark):
    rows = some_rows(11, 25)
    frame = repair.damaged(spark.createDataFrame(rows, ROWS).repartition(4))
    texts = {}
    for r in sorted(repair.repaired(frame).collect(), key=lambda r: tuple(r.place)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for row in brute(rows):
        assert hashlib.sha256("\n".join(texts.get(row[0], [])).encode()).hexdigest() == row[-1]
    whole = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes.")]
    kept = repair.repaired(repair.as_they_are(spark.createDataFrame(whole, ROWS))).orderBy("place").collect()
    assert [(r.edit, r.role, r.text) for r in kept] == [("K", "user", "Hi."), ("K", "assistant", "Yes.")]


def test_table_empty_table_long_text_and_other_columns(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    assert got(table) == brute([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()])
    assert repair.audits(repair.damaged(table.limit(0))).count() == 0
    rows = [(1, 0, "user", "y" * 3_000_000), (1, 1, "assistant", "z" * 9_000_000 + "."), (1, 5, "user", "z"), (2**62, -(2**62), "user", "a.")]
    frame = spark.createDataFrame(rows, ROWS)
    assert got(frame) == brute(rows)
    clash = frame.selectExpr("*", "1 as conv", "2 as copies", "3 as lead", "4 as fault", "5 as audit", "6 as part")
    assert got(clash) == brute(rows)
