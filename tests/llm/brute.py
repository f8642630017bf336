"""Plain versions of operators, for tests: no blocks, no heaps, no pruning."""
import hashlib

SPACE = " \t\n\x0b\f\r"
NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
FULL = {"u": "user", "a": "assistant"}


def faults(rows):
    """(role, text) of a conversation in order -> fault of each row."""
    seen, out = set(), []
    for r in rows:
        if not r[1].strip(SPACE):
            out.append("blank")
        elif r in seen:
            out.append("duplicate")
        else:
            out.append("" if r[1].strip(SPACE)[-1] in ".!?" else "truncated")
        seen.add(r)
    return out


def repair(rows):
    """Cheapest edits by relaxing every edge until nothing changes -> cost, audit, repaired rows. Whole audits and rows are kept at each node."""
    marks = faults(rows)
    best = {(0, 0): (0, "", ())}
    for i in range(len(rows) + 1):
        changed = True
        while changed:  # inserts stay at the place
            changed = False
            for q in range(4):
                if (i, q) not in best:
                    continue
                c, a, kept = best[i, q]
                for letter, q2 in NEXT[q].items():
                    if letter in FULL:
                        new = (c + 3, a + "I", (*kept, (FULL[letter], "")))
                        if (i, q2) not in best or new[:2] < best[i, q2][:2]:
                            best[i, q2], changed = new, True
        if i == len(rows):
            break
        (role, text), mark = rows[i], marks[i]
        for q in range(4):
            if (i, q) not in best:
                continue
            c, a, kept = best[i, q]
            edges = [(q, 4, "D", ())]
            if mark not in ("blank", "duplicate"):
                more = 3 if mark == "truncated" else 0
                edges += [(q2, more, "K", ((role, text),)) for x, q2 in NEXT[q].items() if x == role[:1]]
                edges += [(q2, 3 + more, "R", ((FULL[x], text),)) for x, q2 in NEXT[q].items() if x in FULL]
            for q2, cost, letter, row in edges:
                new = (c + cost, a + letter, kept + row)
                if (i + 1, q2) not in best or new[:2] < best[i + 1, q2][:2]:
                    best[i + 1, q2] = new
    return min((best[len(rows), q] for q in (0, 3) if (len(rows), q) in best), key=lambda b: b[:2])


def report(rows):
    """rows (turn, role, text) in order -> gaps, blank, duplicate, truncated, illegal, cost, audit, digest."""
    said = [(r, t) for _, r, t in rows]
    marks = faults(said)
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(said, said[1:]))
    cost, audit, kept = repair(said)
    digest = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in kept).encode()).hexdigest()
    return (gaps, *(marks.count(m) for m in ("blank", "duplicate", "truncated")), illegal, cost, audit, digest)
