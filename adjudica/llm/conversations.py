"""Repair of conversation structure at the least cost: bidirectional Dijkstra over the edit lattice.

A conversation should read (system)? (user assistant)+ or be empty, by the first letters of its roles. A node of the lattice is a place
between rows and a state of that pattern. Edges keep a row, give it another role, delete it, or insert an empty row. Two searches start, forward from
the empty beginning and backward from the accepted ends; each takes the cheaper of the two heaps' tops. They go on until the tops
together exceed the best meeting, so that every crossing of that cost is known, and the crossing with the least audit (the edits'
letters, D, I, K, R) is taken. An audit determines the states it passes, hence no audit of a node is the beginning of another one,
and the least audit of a path is made of the least audits of its parts. Edges of cost 0 lead to later places only; nodes of equal
cost are therefore taken in the order of their places, which makes their audits final.

At scale. Rows are sorted by conversation and turn over all tasks and become one code a row (first letter of the role, must be deleted,
truncated); duplicates are found by a map-side aggregate whose rows sort just before the row they mark as the first. Codes are cut
in blocks of `block_rows` rows, which are dealt over all tasks and solved from every state to every state; the blocks' solutions are
chained, four states wide. So a conversation of any length costs time over many tasks and only its audit, a byte a row, is held
together. The digest of a repaired conversation is one hash, so its text streams through one task, a batch at a time.

Defined results: a null role or text is one space (a blank row; ` ` is no role). A role counts by its first letter; an empty role has
none and cannot be kept. Rows without a conversation form one. Rows of one turn stand in order of role and a digest of the text;
repeated rows count as duplicates of the first. Rows marked as gone only name their conversation; one without any other row has counts
and cost 0, an empty audit and the digest of nothing. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Letters of a row's code: the first letter of the role, then 4 for a row that must go, 8 for a truncated one.
LETTERS = " sua"
MUST_GO, CUT = 4, 8
#: The pattern's states: start, after system, after user, after assistant. Empty and after assistant are complete.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
COMPLETE = (0, 3)
STATES = range(4)
NAMES = {"u": "user", "a": "assistant"}
INSERTS = {q: [q2 for letter, q2 in NEXT[q].items() if letter in NAMES] for q in STATES}


def row_edges(code: int) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, audit letter) of a row with this code."""
    letter, extra = LETTERS[code & 3], TRUNCATED if code & CUT else 0
    out = [(q, q, DELETE, "D") for q in STATES]
    if not code & MUST_GO:
        for q in STATES:
            out += [(q, q2, KEEP + extra, "K") for x, q2 in NEXT[q].items() if x == letter]
            out += [(q, q2, REROLE + extra, "R") for x, q2 in NEXT[q].items() if x in NAMES]
    return out


#: Outgoing and incoming edges by code and state: (other state, cost, letter).
OUT = [[[(b, c, x) for a, b, c, x in row_edges(code) if a == q] for q in STATES] for code in range(16)]
IN = [[[(a, c, x) for a, b, c, x in row_edges(code) if b == q] for q in STATES] for code in range(16)]
INTO = {q: [p for p in STATES if q in INSERTS[p]] for q in STATES}


def cheapest(codes: bytes, start: int, goals: tuple[int, ...]) -> tuple[int, str] | None:
    """Least cost and, of that cost, least audit of a way from the state `start` before the first row to one of `goals` behind the last."""
    n = len(codes)
    labels: tuple[dict, dict] = ({(0, start): (0, "")}, {(n, q): (0, "") for q in goals})
    heaps = ([(0, 0, 0, start)], [(0, -n, n, q) for q in goals])
    settled: tuple[set, set] = (set(), set())
    best = 0 if (0, start) in labels[1] else None

    def around(side: int, i: int, q: int):
        if side == 0:
            if i < n:
                for q2, c, x in OUT[codes[i]][q]:
                    yield (i + 1, q2), c, x
            for q2 in INSERTS[q]:
                yield (i, q2), INSERT, "I"
        else:
            if i > 0:
                for q2, c, x in IN[codes[i - 1]][q]:
                    yield (i - 1, q2), c, x
            for q2 in INTO[q]:
                yield (i, q2), INSERT, "I"

    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best:
            break
        side = 0 if heaps[0][0][0] <= heaps[1][0][0] else 1
        cost, _, i, q = heapq.heappop(heaps[side])
        if (i, q) in settled[side]:
            continue
        settled[side].add((i, q))
        mine, other, audit = labels[side], labels[1 - side], labels[side][i, q][1]
        for node, c, x in around(side, i, q):
            new = (cost + c, audit + x if side == 0 else x + audit)
            old = mine.get(node)
            if old is None or new < old:
                mine[node] = new
                if old is None or new[0] < old[0]:
                    heapq.heappush(heaps[side], (new[0], node[0] if side == 0 else -node[0], *node))
            if node in other and (best is None or new[0] + other[node][0] < best):
                best = new[0] + other[node][0]
    if best is None:
        return None
    fore, back = labels
    ends = settled[1] | {(n, q) for q in goals}
    found = [fore[v][1] + back[v][1] for v in settled[0] & ends if fore[v][0] + back[v][0] == best]
    for v in settled[0]:
        found += [fore[v][1] + x + back[w][1] for w, c, x in around(0, *v) if w in ends and fore[v][0] + c + back[w][0] == best]
    return best, min(found)


class Way:
    """An audit as a chain of the blocks' parts."""

    __slots__ = ("cost", "part", "before", "depth")

    def __init__(self, cost: int, part: str = "", before: Way | None = None):
        self.cost, self.part, self.before, self.depth = cost, part, before, before.depth + 1 if before else 0

    def parts(self, depth: int = 0) -> str:
        out, w = [], self
        while w is not None and w.depth >= depth:
            out.append(w.part)
            w = w.before
        return "".join(reversed(out))


def better(a: Way, b: Way) -> Way:
    """The cheaper, of equal cost the one with the smaller audit; both are as many blocks long."""
    if a.cost != b.cost:
        return a if a.cost < b.cost else b
    x, y = a, b
    while x is not y and x is not None:
        x, y = x.before, y.before
    common = x.depth + 1 if x is not None else 0
    return a if a.parts(common) <= b.parts(common) else b


def marks(rows: DataFrame) -> DataFrame:
    """The first place of every (conversation, role, text), as rows that sort just before it."""
    first = rows.filter("kind = 1").groupBy("k", "role", "digest").agg(F.min(F.struct(F.col("turn").isNotNull(), F.col("turn"))).alias("f"))
    return first.select("k", "f.turn", "role", "digest", F.lit(0).alias("kind"), F.lit(0).alias("code"))


def blocked(rows: DataFrame, block_rows: int) -> DataFrame:
    """Sorted codes in blocks -> k, block, codes, last, and the counts of the block's stretch of the conversation. Turns travel as text: pandas would round them."""
    both = rows.select("k", "turn", "role", "digest", "kind", "code").unionByName(marks(rows)).repartition("k").sortWithinPartitions("k", "turn", "role", "digest", "kind")
    both = both.withColumn("turn", F.col("turn").cast("string"))
    schema = "k string, block long, codes binary, last boolean, blank long, duplicate long, truncated long, illegal long, turns long, low string, high string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        at, open_, marked, before, seen = None, False, None, None, None
        block, codes, counts = 0, bytearray(), [0] * 5
        low = high = None

        def close(last: bool) -> None:
            nonlocal block, codes, counts, low, high
            out.append((at, block, bytes(codes), last, *counts, low, high))
            block, codes, counts, low, high = block + 1, bytearray(), [0] * 5, None, None

        for batch in batches:
            for k, turn, digest, role, kind, code in zip(batch["k"], batch["turn"], batch["digest"], batch["role"], batch["kind"], batch["code"]):
                if not open_ or k != at:
                    if open_:
                        close(True)
                    at, open_, marked, before, seen, block = k, True, None, None, None, 0
                if kind == 0:
                    marked = (turn, role, digest)
                    continue
                if kind == 2:
                    continue
                if len(codes) == block_rows:
                    close(False)
                letter = LETTERS[code & 3]
                if code & MUST_GO:
                    counts[0] += 1
                elif marked == (turn, role, digest):
                    counts[2] += code >> 3
                else:
                    counts[1] += 1
                    code |= MUST_GO
                marked = None
                if code & MUST_GO:
                    code &= ~CUT
                counts[3] += before is not None and before + letter not in ("su", "ua", "au")
                before = letter
                if turn is not None:
                    counts[4] += turn != seen
                    seen = turn
                    low, high = turn if low is None else low, turn
                codes.append(code)
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=names)
                out = []
        if open_:
            close(True)
        if out:
            yield pd.DataFrame(out, columns=names)

    return both.mapInPandas(run, schema)


def solved(blocks: DataFrame) -> DataFrame:
    """The blocks with `ways`: least cost and audit from each state they may begin in to each they may end in."""
    schema = blocks.drop("codes").schema.simpleString()[7:-1] + ",ways:array<struct<a:int,b:int,cost:long,audit:string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ways = []
            for codes, block, last in zip(batch["codes"], batch["block"], batch["last"]):
                rows = []
                for a in STATES if block else (0,):
                    for b, goals in ((3, COMPLETE),) if last else ((q, (q,)) for q in STATES):
                        way = cheapest(codes, a, goals)
                        if way is not None:
                            rows.append({"a": a, "b": b, "cost": way[0], "audit": way[1]})
                ways.append(rows)
            batch = batch.drop(columns="codes")
            batch["ways"] = ways
            yield batch

    return blocks.repartition("k", "block").mapInPandas(run, schema)


def chained(blocks: DataFrame) -> DataFrame:
    """One row a conversation: counts, cost and audit."""
    schema = "k string, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
    names = [c.split()[0] for c in schema.split(", ")]
    blocks = blocks.repartition("k").sortWithinPartitions("k", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ways: dict[int, Way] = {}
        total, low, high = [0] * 5, None, None
        for batch in batches:
            out = []
            counts = batch[["blank", "duplicate", "truncated", "illegal", "turns"]].to_numpy().tolist()
            for k, block, last, more, lo, hi, edges in zip(batch["k"], batch["block"], batch["last"], counts, batch["low"], batch["high"], batch["ways"]):
                if block == 0:
                    ways, total, low, high = {0: Way(0)}, [0] * 5, None, None
                total = [a + b for a, b in zip(total, more)]
                if lo is not None:
                    low, high = int(lo) if low is None else low, int(hi)
                new: dict[int, Way] = {}
                for e in edges:
                    if e["a"] in ways:
                        before = ways[e["a"]]
                        way = Way(before.cost + int(e["cost"]), e["audit"], before)
                        new[e["b"]] = better(new[e["b"]], way) if e["b"] in new else way
                ways = new
                if last:
                    gaps = 0 if low is None else high - low + 1 - total[4]
                    out.append((k, gaps, *total[:4], ways[3].cost, ways[3].parts()))
            yield pd.DataFrame(out, columns=names)

    return blocks.mapInPandas(run, schema)


def written(rows: DataFrame, repaired: DataFrame, keep_rows: bool) -> DataFrame:
    """Each conversation's audit goes ahead of its rows, which stream through it in order -> the digests, or with `keep_rows` the repaired rows."""
    head = F.struct(*[F.col(c).cast("string").alias(c) for c in repaired.columns if c != "k"])
    heads = repaired.select("k", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.lit(0).alias("kind"), F.lit("").alias("text"), head.alias("r"))
    both = rows.filter("kind = 1").select("k", "turn", "role", "digest", "kind", "text").unionByName(heads, allowMissingColumns=True)
    both = both.repartition("k").sortWithinPartitions("k", "kind", "turn", "role", "digest").select("k", "role", "text", "r.*")
    counts = [c for c in repaired.columns if c not in ("k", "audit")]
    schema = "k string, " + ", ".join(f"{c} long" for c in counts) + ", audit string, repaired_sha256 string, n_repaired long"
    if keep_rows:
        schema = "k string, place long, edit string, role string, text string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, audit, at, state, n, digest, out = None, "", 0, 0, 0, hashlib.sha256(), []

        def put(edit: str, role: str, text: str) -> None:
            nonlocal n
            if keep_rows:
                out.append((head[0], n, edit, role, text))
            else:
                digest.update(("\n" * (n > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
            n += 1

        def inserts() -> None:
            nonlocal at, state
            while audit[at:at + 1] == "I":
                state, letter = step(state)
                put("I", NAMES[letter], "")
                at += 1

        def close() -> None:
            if head is not None:
                inserts()
                if not keep_rows:
                    out.append((*head, audit, digest.hexdigest(), n))

        for batch in batches:
            numbers = zip(*[batch[c] for c in counts])
            for k, role, text, new, count in zip(batch["k"], batch["role"], batch["text"], batch["audit"], numbers):
                if new is not None:
                    close()
                    head, audit, at, state, n, digest = (k, *map(int, count)), new, 0, 0, 0, hashlib.sha256()
                    continue
                inserts()
                edit, at = audit[at], at + 1
                if edit == "K":
                    state = NEXT[state][role[0]]
                    put(edit, role, text)
                elif edit == "R":
                    state, letter = step(state)
                    put(edit, NAMES[letter], text)
            yield pd.DataFrame(out, columns=names)
            out.clear()
        close()
        yield pd.DataFrame(out, columns=names)

    return both.mapInPandas(run, schema)


def step(state: int) -> tuple[int, str]:
    """The state after a new or renamed row, and the letter of its role: no state allows both user and assistant."""
    letter = "a" if state == 2 else "u"
    return NEXT[state][letter], letter


def coded(df: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None) -> DataFrame:
    """k, turn, role, text, digest, code, and kind: 1 for a row, 2 for one that is gone."""
    kind = F.when(F.col(gone), 2).otherwise(1) if gone else F.lit(1)
    d = df.select(F.col(conv).cast("string").alias("k"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), kind.alias("kind"))
    first, said = F.substring("role", 1, 1), F.rtrim("text", F.lit(SPACE))
    letter = F.when(first == "s", 1).when(first == "u", 2).when(first == "a", 3).otherwise(0)
    fault = F.when(said == "", MUST_GO).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(0)
    return d.select("*", F.sha2("text", 256).alias("digest"), (letter + fault).alias("code"))


def repair(df: DataFrame, conv: str, turn: str, role: str, text: str, gone: str | None = None, keep_rows: bool = False, block_rows: int = 512) -> DataFrame:
    """One row a conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256 (of its `role:text` rows, joined by
    line feeds), n_repaired. With `keep_rows` the repaired rows instead: conv, place, edit (I, K or R), role, text.

    `gone` names a boolean column: such rows are not part of the conversation, which is still listed."""
    rows = coded(df, conv, turn, role, text, gone)
    repaired = chained(solved(blocked(rows, block_rows)))
    out = written(rows, repaired, keep_rows)
    return out.select(F.col("k").cast(df.schema[conv].dataType).alias(conv), *[c for c in out.columns if c != "k"])
