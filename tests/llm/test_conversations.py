import hashlib
import random
import re
import zlib

from dumptables.llm.conversations import RepairAutomaton, repair_conversations

SCHEMA = "conv_id bigint, turn bigint, role string, text string, node string, cost int"
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        role = "user" if code == 4 else role
        out += [(conv, turn, role, text)] * (2 if code == 3 else 1)
    return out


def repair(rows):
    """Cheapest edits by plain dynamic programming over whole audit strings, ties by comparing the strings."""
    n = len(rows)
    seen, faults = set(), []
    for role, text in rows:
        if not re.search("[^\x20\x09-\x0d]", text):
            faults.append("blank")
        elif (role, text) in seen:
            faults.append("dup")
        elif re.sub("[\x20\x09-\x0d]+$", "", text)[-1] not in ".!?":
            faults.append("trunc")
        else:
            faults.append(None)
        seen.add((role, text))
    best = [[None] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        for _ in range(6):
            for q in range(4):
                options = []
                if i == n and q in (0, 3):
                    options.append((0, "", ()))
                target = 2 if q != 2 else 3
                name = {2: "user", 3: "assistant"}[target]
                if best[i][target] is not None:
                    c, a, lines = best[i][target]
                    options.append((3 + c, "I" + a, ((name, ""),) + lines))
                if i < n:
                    role, text = rows[i]
                    extra = 3 if faults[i] == "trunc" else 0
                    c, a, lines = best[i + 1][q]
                    options.append((4 + c, "D" + a, lines))
                    if faults[i] not in ("blank", "dup"):
                        nxt = GRAMMAR[q].get(role[:1])
                        if nxt is not None:
                            c, a, lines = best[i + 1][nxt]
                            options.append((extra + c, "K" + a, ((role, text),) + lines))
                        c, a, lines = best[i + 1][target]
                        options.append((3 + extra + c, "R" + a, ((name, text),) + lines))
                if options:
                    best[i][q] = min(options, key=lambda o: (o[0], o[1]))
    cost, audit, lines = best[0][0]
    sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in lines).encode()).hexdigest()
    illegal = sum((a[:1] + b[:1]) not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))
    return faults, cost, audit, sha, illegal


def brute(rows):
    out = []
    for conv in {r[0] for r in rows}:
        kept = [r for r in damage([r for r in rows if r[0] == conv])]
        kept.sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        turns = {r[1] for r in kept if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        faults, cost, audit, sha, illegal = repair([(r[2], r[3]) for r in kept])
        out.append((conv, gaps, faults.count("blank"), faults.count("dup"), faults.count("trunc"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256").collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA).repartition(3)


def conversations(seed, n=40):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", None, "", "u", "admin"]
    texts = ["Hello.", "Hi there!", "why", "", "  \n", None, "Fine?", "ok. ", "Hello.", "Thanks!!", "no end"]
    rows = []
    for conv in range(n):
        conv_id = None if conv == n - 1 else conv
        for turn in range(rng.randint(0, 9)):
            role = rng.choice(roles) if rng.random() < 0.4 else ["user", "assistant"][turn % 2]
            t = None if rng.random() < 0.05 else turn if rng.random() > 0.1 else turn - 1
            rows.append((conv_id, t, role, rng.choice(texts)))
    return rows


def test_equals_brute_force(spark):
    for seed in range(3):
        rows = conversations(seed)
        assert got(repair_conversations(table(spark, rows))) == brute(rows)


def test_automaton_is_small_and_closed():
    machine = RepairAutomaton()
    assert len(machine.vectors) < 100
    assert all(len(row) == 9 for row in machine.before)


def test_long_conversation_and_odd_rows(spark):
    rng = random.Random(5)
    rows = [(7, t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "No", "", "x" * 5000 + "."])) for t in range(3000)]
    rows += [(8, None, None, None), (9, 1, "user", "Hi."), (9, 1, "user", "Hi.")]
    assert got(repair_conversations(table(spark, rows))) == brute(rows)
    assert repair_conversations(table(spark, [])).count() == 0
