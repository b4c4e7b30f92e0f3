"""Conversation structure repair: faults of damaged conversations and their cheapest repair, by a suffix-shared DAWG.

The cheapest edits from a row to the end depend only on the signatures (role class, fault) of the rows from there on.
Their cost-to-go, one figure for each state of the role grammar ``(s?(ua)+)?``, shifted so that its least is 0,
takes few values: suffixes with equal vectors lead to equal decisions, so they are one node of the automaton minimised
from the end. The nodes, their transitions by signature and the best edit at each (node, state) are computed once,
for all conversations, before any row is read (:class:`RepairAutomaton`). A conversation then needs one pass from
its end over narrow signatures to find the node after each row, and one pass from its start over the rows to apply
the decisions, write the audit and hash the repaired rows; neither holds the conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, store

# Fixed values of the contract.
DAMAGE = 20  # crc32("conv_id:turn") % DAMAGE: 0 drop, 1 empty text, 2 no [.!?], 3 repeat, 4 role user
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL_PAIRS = ("su", "ua", "au")
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
EMPTY_SHA = hashlib.sha256(b"").hexdigest()

#: Grammar states: 0 start, 1 after s, 2 after u, 3 after a; 0 and 3 accept.
ACCEPT = (True, False, False, True)
KEEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "o": {}}
#: The one role that a rerole or an insert may give in each state, and the state after it.
NEXT = {0: 2, 1: 2, 2: 3, 3: 2}
ROLE_OF = {2: "user", 3: "assistant"}
CLASSES = "suao"
#: Signature 0: a row that must go (blank or duplicate); 1 + 2 * class + truncated otherwise.
GONE = 0


def signature(role_class: str, truncated: bool) -> int:
    return 1 + 2 * CLASSES.index(role_class) + int(truncated)


class RepairAutomaton:
    """Nodes of normalised cost-to-go vectors, their transitions by signature, and the best edit per (node, state)."""

    def __init__(self) -> None:
        self.end = (0, 2 * INSERT, INSERT, 0)
        self.ids = {self.end: 0}
        self.vectors = [self.end]
        self.before: list[list[int]] = []
        self.choice: list[list[list[tuple[str, int, int]]]] = []
        at = 0
        while at < len(self.vectors):
            after = self.vectors[at]
            row_before, row_choice = [], []
            for sym in range(1 + 2 * len(CLASSES)):
                vector, choices = self._level(after, sym)
                low = min(vector)
                key = tuple(v - low for v in vector)
                if key not in self.ids:
                    self.ids[key] = len(self.vectors)
                    self.vectors.append(key)
                row_before.append(self.ids[key])
                row_choice.append(choices)
            self.before.append(row_before)
            self.choice.append(row_choice)
            at += 1
            if len(self.vectors) > 10_000:
                raise RuntimeError("the repair automaton does not close")

    @staticmethod
    def _level(after: tuple[int, ...], sym: int) -> tuple[list[int], list[tuple[str, int, int]]]:
        """Cost-to-go before a row of signature ``sym`` and the best (letter, next state, cost) in each state."""
        options: list[list[tuple[int, str, int]]] = []
        for q in range(4):
            here = [(DELETE + after[q], "D", q)]
            if sym != GONE:
                role_class, truncated = CLASSES[(sym - 1) // 2], (sym - 1) % 2
                if q in KEEPS[role_class]:
                    here.append((KEEP + TRUNCATED * truncated + after[KEEPS[role_class][q]], "K", KEEPS[role_class][q]))
                here.append((REROLE + TRUNCATED * truncated + after[NEXT[q]], "R", NEXT[q]))
            options.append(here)
        cost = [min(o)[0] for o in options]
        for _ in range(4):
            cost = [min(cost[q], INSERT + cost[NEXT[q]]) for q in range(4)]
        choices = []
        for q in range(4):
            best = min(options[q] + [(INSERT + cost[NEXT[q]], "I", NEXT[q])], key=lambda o: (o[0], o[1]))
            edit_cost = {"D": DELETE, "I": INSERT, "R": REROLE + TRUNCATED * ((sym - 1) % 2 if sym else 0),
                         "K": KEEP + TRUNCATED * ((sym - 1) % 2 if sym else 0)}[best[1]]
            choices.append((best[1], best[2], edit_cost))
        return cost, choices


def damaged_rows(conversations: DataFrame) -> DataFrame:
    """Rows after damage: cnull, cval (the conversation), tn, tv (turn, nulls first), role, text, th (md5 of the text), copies."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                                F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
                                F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
                                (F.crc32(key.cast("binary")) % DAMAGE).alias("code"))
    kept = rows.where(F.col("code") != 0).select(
        F.col("conv_id").isNull().alias("cnull"), F.coalesce("conv_id", F.lit(0)).alias("cval"),
        F.col("turn").isNotNull().alias("tn"), F.coalesce("turn", F.lit(0)).alias("tv"),
        F.when(F.col("code") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("code") == 1, F.lit("")).when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("code") == 3, 2).otherwise(1).cast("bigint").alias("copies"))
    return kept.withColumn("th", F.unhex(F.md5(F.col("text").cast("binary"))))


CONV = ["cnull", "cval"]
ORDER = ["tn", "tv", "role", "th"]


def _runs(rows: DataFrame) -> DataFrame:
    """One row per run of equal rows: copies, blank, truncated, whether an earlier run has its role and text, signature."""
    trimmed = F.btrim(F.col("text"), F.lit(SPACES))
    facts = rows.select(*CONV, *ORDER, "copies", (F.char_length(trimmed) == 0).alias("blank"),
                        (~F.substring(trimmed, -1, 1).isin(".", "!", "?")).alias("truncated"),
                        F.substring("role", 1, 1).alias("ini"))
    runs = facts.groupBy(*CONV, *ORDER).agg(F.sum("copies").alias("m"), F.first("blank").alias("blank"),
                                            F.first("truncated").alias("truncated"), F.first("ini").alias("ini"))
    firsts = runs.groupBy(*CONV, "role", "th").agg(F.min(F.struct("tn", "tv")).alias("first"))
    runs = runs.join(firsts, [*CONV, "role", "th"]).withColumn("dup_first", F.struct("tn", "tv") > F.col("first")).drop("first")
    index = F.when(F.col("ini") == "s", 0).when(F.col("ini") == "u", 1).when(F.col("ini") == "a", 2).otherwise(3)
    sym = F.when(F.col("blank") | F.col("dup_first"), F.lit(GONE)).otherwise(1 + 2 * index + F.col("truncated").cast("int"))
    return runs.withColumn("sym", sym.cast("int"))


def _backward(runs: DataFrame, machine: RepairAutomaton) -> DataFrame:
    """The node after the last copy of every run, from each conversation's end; nothing of a conversation is held."""
    before = machine.before

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        last = None
        node = 0
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in (*CONV, "m", "sym")}
            out = []
            for cnull, cval, m, sym in zip(cols["cnull"], cols["cval"], cols["m"], cols["sym"]):
                if (cnull, cval) != last:
                    last, node = (cnull, cval), 0
                out.append(node)
                for _ in range(m - 1):
                    node = before[node][GONE]
                node = before[node][sym]
            yield {**{c: batch.column(c) for c in (*CONV, *ORDER, "m", "sym")}, "node": out}

    narrow = runs.select(*CONV, *ORDER, "m", "sym").repartition(*CONV).sortWithinPartitions(
        *CONV, *[F.col(c).desc() for c in ORDER])
    return map_batches(narrow, walk, "cnull boolean, cval bigint, tn boolean, tv bigint, role string, th binary, m bigint, sym int, node int")


def _forward(rows: DataFrame, nodes: DataFrame, machine: RepairAutomaton) -> DataFrame:
    """cost, audit, repaired_sha256 and illegal of every conversation with rows, from its start."""
    before, choice = machine.before, machine.choice
    schema = "cnull boolean, cval bigint, tn boolean, tv bigint, role string, th binary, kind int, m bigint, sym int, node int, text string"
    runs = nodes.select(*CONV, *ORDER, F.lit(0).alias("kind"), "m", "sym", "node", F.lit(None).cast("string").alias("text"))
    texts = rows.select(*CONV, *ORDER, F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("m"), F.lit(None).cast("int").alias("sym"),
                        F.lit(None).cast("int").alias("node"), "text")
    stream = runs.unionByName(texts).repartition(*CONV).sortWithinPartitions(*CONV, *ORDER, "kind")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        out = {k: [] for k in ("cnull", "cval", "cost", "audit", "repaired_sha256", "illegal")}
        conv = None
        state = {}

        def close() -> None:
            q = state["q"]
            while not ACCEPT[q]:
                line(ROLE_OF[NEXT[q]], "")
                state["audit"].append("I")
                state["cost"] += INSERT
                q = NEXT[q]
            out["cnull"].append(conv[0])
            out["cval"].append(conv[1])
            out["cost"].append(state["cost"])
            out["audit"].append("".join(state["audit"]))
            out["repaired_sha256"].append(state["sha"].hexdigest())
            out["illegal"].append(state["illegal"])

        def line(role: str, text: str) -> None:
            state["sha"].update((("\n" if state["lines"] else "") + role + ":" + text).encode("utf-8"))
            state["lines"] += 1

        for batch in batches:
            cols = batch.to_pydict()
            for i in range(batch.num_rows):
                key = (cols["cnull"][i], cols["cval"][i])
                if key != conv:
                    if conv is not None:
                        close()
                    conv = key
                    state = {"q": 0, "cost": 0, "audit": [], "sha": hashlib.sha256(), "lines": 0, "illegal": 0, "ini": None, "run": None}
                if cols["kind"][i] == 0:
                    state["run"] = (cols["m"][i], cols["sym"][i], cols["node"][i])
                    continue
                if state["run"] is None:
                    continue  # a further copy of a run already applied
                m, sym, node_after = state["run"]
                state["run"] = None
                role, text = cols["role"][i], cols["text"][i]
                after = [node_after]
                for _ in range(m - 1):
                    after.append(before[after[-1]][GONE])
                after.reverse()
                ini = role[:1]
                for j in range(m):
                    if state["ini"] is not None and state["ini"] + ini not in LEGAL_PAIRS:
                        state["illegal"] += 1
                    state["ini"] = ini
                    s = sym if j == 0 else GONE
                    while True:
                        letter, next_q, cost = choice[after[j]][s][state["q"]]
                        state["audit"].append(letter)
                        state["cost"] += cost
                        if letter == "I":
                            line(ROLE_OF[next_q], "")
                        elif letter == "K":
                            line(role, text)
                        elif letter == "R":
                            line(ROLE_OF[next_q], text)
                        state["q"] = next_q
                        if letter != "I":
                            break
            if len(out["cost"]) >= 1024:
                yield out
                out = {k: [] for k in out}
        if conv is not None:
            close()
        yield out

    return map_batches(stream.select(*[c.split()[0] for c in schema.split(", ")]), walk,
                       "cnull boolean, cval bigint, cost bigint, audit string, repaired_sha256 string, illegal bigint")


def repair_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 of every conversation.

    Rows are damaged by crc32("conv_id:turn") % 20 (nulls written as one space; a null role or text is one space),
    then taken by turn, nulls first; rows of one turn in order of role, then of the md5 of their text (equal rows
    need no order). A row's first fault counts: blank, duplicate (role and text seen earlier), truncated. The audit is
    the cheapest edit list (K keep, R rerole, D delete, I insert) whose roles follow ``(s?(ua)+)?``, ties ASCII-least.
    Every conversation id of the input gives one row, a null id included; one without rows after damage has zeros,
    an empty audit and the hash of the empty text. Extra columns are not read.
    """
    machine = RepairAutomaton()
    rows = damaged_rows(conversations)
    runs = store(_runs(rows), "conversation-runs")
    counts = runs.groupBy(*CONV).agg(
        F.sum(F.when(F.col("blank"), F.col("m")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("m") - 1 + F.col("dup_first").cast("int")).otherwise(0)).alias("duplicate"),
        F.sum(F.when(~F.col("blank") & ~F.col("dup_first") & F.col("truncated"), 1).otherwise(0)).alias("truncated"),
        F.coalesce(F.max(F.when(F.col("tn"), F.col("tv"))) - F.min(F.when(F.col("tn"), F.col("tv"))) + 1
                   - F.count_distinct(F.when(F.col("tn"), F.col("tv"))), F.lit(0)).alias("gaps"))
    repaired = _forward(rows, _backward(runs, machine), machine)
    ids = conversations.select(F.col("conv_id").cast("bigint").isNull().alias("cnull"),
                               F.coalesce(F.col("conv_id").cast("bigint"), F.lit(0)).alias("cval")).distinct()
    whole = ids.join(counts, CONV, "left").join(repaired, CONV, "left")
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return whole.select(F.when(~F.col("cnull"), F.col("cval")).alias("conv_id"),
                        *[F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c) for c in longs],
                        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA)).alias("repaired_sha256"))
