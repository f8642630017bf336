"""Adaptive context-mixing range coder for blocks of token ids.

Every block is coded by itself, from a reset model over its own alphabet (the sorted distinct ids, written before the code). For each
id the model mixes three predictions into one distribution of total 2**24:

* order 2: the id that last followed the previous two (a hashed table),
* order 1: the id that last followed the previous one,
* order 0: frequencies of the ids so far, counted anew after 32, 128 and 512 ids.

The weights of orders 1 and 2 are learned per class of confidence (how often either prediction came true in a row, and whether both
agree); order 0 has the rest, never less than 1/64, so every id of the alphabet can be coded. The predictions stand side by side, in this order, and an id
takes its largest share: the decoder finds the prediction from two comparisons, and looks an id of order 0 up among 4,096 slots. A carry-less range coder with 64-bit
state writes 32-bit words. All arithmetic is on integers, so the decoder sees the numbers of the encoder.

Blocks of one call are coded in step, one block a lane: an id costs a share of some numpy calls rather than a Python loop.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable

import numpy as np

#: Fixed values of the format.
TOTAL_BITS, SLOT_BITS, TABLE_BITS, RATE, UNIT, FULL = 24, 12, 12, 5, 252, 65_536
SLOTS, TABLE = 1 << SLOT_BITS, 1 << TABLE_BITS
#: Largest block: its alphabet must leave room among the slots of order 0.
LARGEST = 1 << 11
#: Places of a block where order 0 is counted again.
COUNTED = (0, 32, 128, 512)
#: First weights by confidence.
FIRST = (0, 20_000, 40_000, 52_000)
#: A remembered id has 11 bits; above them stands its confidence, that of order 1 two bits higher than that of order 2.
ID, STEP2, STEP1 = LARGEST - 1, 1 << 11, 1 << 13
#: The encoder sorts so many lanes, and mixes so many ids of every lane, at once (a divisor of the places in COUNTED).
SOME_LANES, SOME_IDS = 128, 32
WORD, LOW32 = np.uint64(32), np.uint64(0xFFFFFFFF)


class Mixer:
    """Models of several blocks, a block a lane. Lanes are ordered by falling length, so the lanes still running are a prefix."""

    def __init__(self, sizes: np.ndarray, longest: int, slots: bool):
        n = len(sizes)
        self.sizes, self.width = sizes.astype(np.int32), int(sizes.max())
        self.last = np.zeros(n * self.width, np.uint16)
        self.pair = np.zeros(n * TABLE, np.uint16)
        classes = [(0 if same else (FULL - FIRST[b]) * FIRST[a] // FULL, FIRST[b]) for same in (0, 1) for a in range(4) for b in range(4)]
        self.weights = np.tile(np.array(classes, np.int32), (n, 1)).view(np.int64).ravel()  # those of orders 1 and 2 side by side
        self.span = np.zeros(n * self.width, np.int32)
        self.slot = np.zeros(n * SLOTS, np.uint16) if slots else None
        self.seen = np.zeros((longest, n), np.uint16)
        self.s1, self.s2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.keep(n)

    def keep(self, n: int) -> None:
        """Go on with the first n lanes."""
        lane = np.arange(n)
        self.n, self.b1, self.b2, self.bk, self.b0 = n, lane * self.width, lane * TABLE, lane * 32, lane * SLOTS
        self.s1, self.s2, self.hits = self.s1[:n], self.s2[:n], np.zeros((n, 2), np.int32)

    def count(self, t: int) -> None:
        """Order 0 from the first t ids of every lane."""
        n, d = self.n, self.sizes[:self.n, None]
        occ = np.bincount((self.b1 + self.seen[:t, :n]).ravel(), minlength=n * self.width).astype(np.int32).reshape(n, self.width)
        f = np.where(np.arange(self.width, dtype=np.int32) < d, 1 + ((occ * 8 + 1) * (SLOTS - d)) // (t * 8 + d), 0).astype(np.int32)
        f[np.arange(n), self.sizes[:n] - 1] += SLOTS - f.sum(1, dtype=np.int32)
        self.span[:n * self.width] = (f.cumsum(1, dtype=np.int32) - f | f << 16).ravel()
        if self.slot is not None:
            self.slot[:n * SLOTS] = np.repeat(np.tile(np.arange(self.width, dtype=np.uint16), n), f.ravel())

    def predict(self) -> None:
        self.i1 = self.b1 + self.s1
        self.i2 = self.b2 + (self.s2 * 6007 + self.s1 & TABLE - 1)
        self.e1, self.e2 = self.last[self.i1], self.pair[self.i2]
        self.p1, self.p2 = self.e1 & ID, self.e2 & ID
        self.k = self.bk + (((self.e1 | self.e2) >> 11) + (self.p1 == self.p2) * np.uint16(16))
        self.a = self.weights[self.k].view(np.int32).reshape(-1, 2)
        self.w1, self.w2 = (self.a * UNIT).T.astype(np.int64)
        self.w12 = self.w1 + self.w2
        self.w0 = (1 << TOTAL_BITS) - self.w12 >> SLOT_BITS  # a slot of order 0

    def plain(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of an id in the order-0 part."""
        span = self.span[self.b1 + s]
        return (span & 0xFFFF) * self.w0 + self.w12, (span >> 16) * self.w0

    def learn(self, t: int, s: np.ndarray) -> None:
        low = s.astype(np.uint16)
        is1, is2 = self.p1 == low, self.p2 == low
        self.hits[:, 0], self.hits[:, 1] = is1 > is2, is2
        self.weights[self.k] = (self.a + (self.hits * FULL - self.a >> RATE)).view(np.int64).ravel()
        self.last[self.i1] = np.where(is1, np.minimum(self.e1 + np.uint16(STEP1), self.p1 | 3 * STEP1), low | STEP1)
        self.pair[self.i2] = np.where(is2, np.minimum(self.e2 + np.uint16(STEP2), self.p2 | 3 * STEP2), low | STEP2)
        self.seen[t, :self.n] = low
        self.s2, self.s1 = self.s1, s


def run(sizes: list[int], lengths: list[int], step: Callable, shrink: Callable, slots: bool) -> Mixer:
    """All lanes to their ends; lengths fall."""
    mixer = Mixer(np.array(sizes, np.int64), lengths[0], slots)
    left, n = np.array(lengths), len(lengths)
    for t in range(lengths[0]):
        if left[n - 1] <= t:
            n = int((left > t).sum())
            mixer.keep(n)
            shrink(n)
        if t in COUNTED:
            mixer.count(t)
        mixer.predict()
        mixer.learn(t, step(mixer, t))
    return mixer


def remembered(ids: np.ndarray, contexts: np.ndarray, step: int) -> np.ndarray:
    """What `Mixer.learn` would have left under the context of every place: the id that followed it last and its confidence. Lanes are rows."""
    at = np.argsort(contexts, axis=1, kind="stable") + np.arange(len(ids))[:, None] * ids.shape[1]
    c, g = contexts.ravel()[at], ids.ravel()[at]
    met = c[:, 1:] == c[:, :-1]
    again = met & (g[:, 1:] == g[:, :-1])
    runs = np.ones(g.shape, np.uint16)
    runs[:, 1:] += again
    runs[:, 2:] += again[:, 1:] & again[:, :-1]
    found = np.zeros_like(g)
    found[:, 1:] = (g[:, :-1] | runs[:, :-1] * np.uint16(step)) * met
    out = np.empty_like(ids)
    out.ravel()[at] = found
    return out


def encode(blocks: list[np.ndarray], sizes: list[int]) -> list[bytes]:
    """The code of every block; a block is an array of at most LARGEST places in an alphabet of sizes[i] ids. All ids are known, so the predictions of
    orders 1 and 2 come from sorting places by context; only the weights and the code itself go id by id."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted((i for i in range(len(blocks)) if len(blocks[i])), key=lambda i: -len(blocks[i]))
    if not order:
        return out
    lanes, longest = len(order), len(blocks[order[0]])
    lengths = np.array([len(blocks[i]) for i in order])
    plain = np.zeros((lanes, longest + 2), np.uint16)  # two zeros stand before each block
    for lane, i in enumerate(order):
        plain[lane, 2:2 + len(blocks[i])] = blocks[i]
    mixer = Mixer(np.array([sizes[i] for i in order], np.int64), 0, False)
    mixer.seen, e1, e2 = (np.empty((longest, lanes), np.uint16) for _ in range(3))
    for a in range(0, lanes, SOME_LANES):
        s, s1, s2 = (plain[a:a + SOME_LANES, 2 - k:2 - k + longest] for k in range(3))
        ids = np.ascontiguousarray(s)
        mixer.seen[:, a:a + SOME_LANES] = s.T
        e1[:, a:a + SOME_LANES] = remembered(ids, s1, STEP1).T
        e2[:, a:a + SOME_LANES] = remembered(ids, s2 * np.uint16(6007) + s1 & np.uint16(TABLE - 1), STEP2).T
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, ~np.uint64(0))
    lane_of, words = [], []  # of every word that leaves a lane, in turn
    weights = np.empty((SOME_IDS, lanes), np.int64)
    for first in range(0, longest, SOME_IDS):
        if first in COUNTED:
            mixer.count(first)
        ids, f1, f2 = (x[first:first + SOME_IDS] for x in (mixer.seen, e1, e2))
        p1, p2 = f1 & ID, f2 & ID
        is1, is2 = p1 == ids, p2 == ids
        k = mixer.bk + (((f1 | f2) >> 11) + (p1 == p2) * np.uint16(16))
        hits = np.empty((*ids.shape, 2), np.int32)
        np.multiply(is1 > is2, FULL, out=hits[..., 0], casting="unsafe")
        np.multiply(is2, FULL, out=hits[..., 1], casting="unsafe")
        for t in range(len(ids)):
            weights[t] = mixer.weights[k[t]]
            a = weights[t].view(np.int32).reshape(-1, 2)
            mixer.weights[k[t]] = (a + (hits[t] - a >> RATE)).view(np.int64).ravel()
        w = weights[:len(ids)].view(np.int32).reshape(*ids.shape, 2) * UNIT
        w1, w2 = w[..., 0].astype(np.int64), w[..., 1].astype(np.int64)
        mixer.w12 = w1 + w2
        mixer.w0 = (1 << TOTAL_BITS) - mixer.w12 >> SLOT_BITS
        start, size = mixer.plain(ids)
        is1 &= w1 > size
        np.copyto(start, w2, where=is1)
        np.copyto(size, w1, where=is1)
        is2 &= w2 > size
        np.copyto(start, 0, where=is2)
        np.copyto(size, w2, where=is2)
        start, size = start.view(np.uint64), size.view(np.uint64)
        for t in range(len(ids)):
            n = lanes if lengths[-1] > first + t else int((lengths > first + t).sum())
            unit = width[:n] >> np.uint64(TOTAL_BITS)
            low[:n] += unit * start[t, :n]
            np.multiply(unit, size[t, :n], out=width[:n])
            at = np.flatnonzero(width[:n] <= LOW32)
            if len(at):
                a, x = low.take(at), width.take(at)
                tight = (a ^ (a + x)) > LOW32
                if tight.any():
                    x[tight] = (~a[tight] + np.uint64(1)) & LOW32
                lane_of.append(at.astype(np.uint16 if lanes <= 1 << 16 else np.int64))
                words.append((a >> WORD).astype("<u4"))
                low[at], width[at] = a << WORD, x << WORD
    lane_of = np.concatenate([*lane_of, np.repeat(np.arange(lanes), 2).astype(np.uint16 if lanes <= 1 << 16 else np.int64)])
    words = np.concatenate([*words, np.stack([low >> WORD, low & LOW32], 1).astype("<u4").ravel()])
    data, ends = words[np.argsort(lane_of, kind="stable")].tobytes(), 4 * np.bincount(lane_of, minlength=lanes).cumsum()
    for i, a, b in zip(order, [0, *ends.tolist()], ends.tolist()):
        out[i] = data[a:b]
    return out


def decode(codes: list[bytes], sizes: list[int], lengths: list[int]) -> list[np.ndarray]:
    """The blocks of `encode`."""
    out = [np.zeros(0, np.uint16)] * len(codes)
    order = sorted((i for i in range(len(codes)) if lengths[i]), key=lambda i: -lengths[i])
    if not order:
        return out
    parts = [np.frombuffer(codes[i], "<u4") for i in order]
    words, used = np.concatenate(parts), np.array([0, *map(len, parts)]).cumsum()[:-1]  # used: the next word of every lane
    low, width = np.zeros(len(order), np.uint64), np.full(len(order), ~np.uint64(0))
    above = words[used].astype(np.uint64) << WORD | words[used + 1]  # the code less low
    used += 2

    def shrink(n: int) -> None:
        nonlocal low, width, used, above
        low, width, used, above = low[:n], width[:n], used[:n], above[:n]

    def step(m: Mixer, t: int) -> np.ndarray:
        unit = width >> np.uint64(TOTAL_BITS)
        rest = unit * m.w12.view(np.uint64)
        by2, by12 = above < unit * m.w2.view(np.uint64), above < rest
        x = (above - rest) // (unit * m.w0.view(np.uint64))
        s = m.slot[m.b0 + np.minimum(x, np.uint64(SLOTS - 1)).view(np.int64)]
        np.copyto(s, m.p1, where=by12)
        np.copyto(s, m.p2, where=by2)
        s = s.astype(np.int64)
        start, size = m.plain(s)
        np.copyto(start, m.w2, where=by12)
        np.copyto(size, m.w1, where=by12)
        np.copyto(start, 0, where=by2)
        np.copyto(size, m.w2, where=by2)
        gone = unit * start.view(np.uint64)
        low[:] += gone
        above[:] -= gone
        np.multiply(unit, size.view(np.uint64), out=width)
        at = np.flatnonzero(width <= LOW32)
        if len(at):
            a, w, next_word = low.take(at), width.take(at), used.take(at)
            tight = (a ^ (a + w)) > LOW32
            if tight.any():
                w[tight] = (~a[tight] + np.uint64(1)) & LOW32
            above[at] = above.take(at) << WORD | words.take(next_word, mode="clip")
            used[at] = next_word + 1
            low[at], width[at] = a << WORD, w << WORD
        return s

    mixer = run([sizes[i] for i in order], [lengths[i] for i in order], step, shrink, True)
    seen = np.ascontiguousarray(mixer.seen.T)
    for lane, i in enumerate(order):
        out[i] = seen[lane, :lengths[i]]
    return out


def numbers(data: bytes, n: int) -> np.ndarray:
    """n whole numbers of 7 bits a byte, low bits first, the last byte of each below 128."""
    raw = np.frombuffer(data, np.uint8)
    first = np.concatenate([[0], np.flatnonzero(raw < 128) + 1])[:n]
    if not n:
        return np.zeros(0, np.int64)
    place = np.arange(len(raw)) - np.repeat(first, np.diff(np.append(first, len(raw))))
    return np.add.reduceat((raw & 127).astype(np.int64) << 7 * place, first)


def varints(values: np.ndarray) -> bytes:
    """Whole numbers below 2**35 as `numbers` reads them."""
    sevens = values[:, None] >> np.arange(0, 35, 7) & 127
    n = 1 + (values[:, None] >> np.arange(7, 35, 7) > 0).sum(1)
    place = np.arange(5)
    return (sevens | (place < n[:, None] - 1) << 7).astype(np.uint8)[place < n[:, None]].tobytes()


def places(parts: list[np.ndarray], alphabets: list[np.ndarray]) -> list[np.ndarray]:
    """The place of every id in the alphabet of its block."""
    top = max(int(a[-1]) for a in alphabets)
    if top >= 1 << 20:
        return [np.searchsorted(a, p) for p, a in zip(parts, alphabets)]
    place, out = np.zeros(top + 1, np.uint16), []
    for p, a in zip(parts, alphabets):
        place[a] = np.arange(len(a))
        out.append(place[p])
    return out


def pack_ids(ids: np.ndarray, block: int = LARGEST, lanes: int = 2048) -> tuple[np.ndarray, bytes]:
    """ids (u32) as blocks -> a table (number of ids, alphabet size, alphabet bytes, code bytes, crc32 of the ids, crc32 of the bytes) and the blocks' bytes."""
    if not 0 < block <= LARGEST:
        raise ValueError(f"a block has 1 to {LARGEST} ids")
    rows, body = [], []
    for group in range(0, len(ids), block * lanes):
        parts = [ids[a:a + block] for a in range(group, min(group + block * lanes, len(ids)), block)]
        alphabets = [np.unique(p) for p in parts]
        sizes = [len(a) for a in alphabets]
        codes = encode(places(parts, alphabets), sizes)
        heads = varints(np.concatenate([np.diff(a.astype(np.int64), prepend=0) for a in alphabets]))
        cuts = (np.flatnonzero(np.frombuffer(heads, np.uint8) < 128) + 1)[np.cumsum(sizes) - 1].tolist()
        for p, size, a, b, code in zip(parts, sizes, [0, *cuts], cuts, codes):
            head = heads[a:b]
            rows.append((len(p), size, len(head), len(code), zlib.crc32(p.astype("<u4").tobytes()), zlib.crc32(head + code)))
            body += [head, code]
    return np.array(rows, "<u4").reshape(-1, 6), b"".join(body)


def unpack_ids(table: np.ndarray, body: bytes, lanes: int = 2048) -> np.ndarray:
    """The ids of `pack_ids`. A block whose checksums do not fit raises a ValueError that names it."""
    out = []
    ends = (table[:, 2].astype(np.int64) + table[:, 3]).cumsum()
    if len(body) != (int(ends[-1]) if len(ends) else 0):
        raise ValueError("the blocks have another length than their table says")
    for group in range(0, len(table), lanes):
        rows = table[group:group + lanes].astype(np.int64)
        heads, codes = [], []
        for i, (_, _, head, code, _, crc) in enumerate(rows.tolist(), group):
            raw = body[ends[i] - head - code:ends[i]]
            if zlib.crc32(raw) != crc:
                raise ValueError(f"block {i}: its bytes are damaged")
            heads.append(raw[:head])
            codes.append(raw[head:])
        steps = np.split(numbers(b"".join(heads), int(rows[:, 1].sum())), rows[:, 1].cumsum()[:-1])
        for i, (block, step) in enumerate(zip(decode(codes, rows[:, 1].tolist(), rows[:, 0].tolist()), steps), group):
            ids = step.cumsum().astype("<u4")[block]
            if zlib.crc32(ids.tobytes()) != table[i, 4]:
                raise ValueError(f"block {i}: its ids are not those that were written")
            out.append(ids)
    return np.concatenate(out) if out else np.zeros(0, "<u4")
