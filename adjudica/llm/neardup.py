"""Near-duplicates by BagMinHash: weighted Jaccard similarity of the multisets of five-word shingles.

Signatures. A shingle with count w owns the stretch [0, w) of a weight axis. Over every dyadic stretch of the axis, [0, 1), [1, 2),
[2, 4), ..., runs a Poisson process in time whose rate is the stretch's length; its points carry a place in the stretch, drawn by
successive halving (the bits of a fraction), and one of m registers. A point counts if its place is below w. A register keeps the
earliest time over all shingles, so two documents agree in a register with the probability of their weighted Jaccard
similarity. Points are drawn in order of time and a process ends when its next point is later than every register.

Links. Documents whose registers agree in a whole band are compared, but never all pairs of a bucket. In rounds, each text of a
bucket is compared with one representative of it, linked texts become one group, and buckets of one group are done. When the pairs
left between different groups are few (at most `few` for each text in its bucket), or after `most_rounds`, all these are compared.
No pair is compared whose bound is below the similarity: the smaller of two sizes n, m must reach it against the larger, and what
either text shares with any other text must reach s / (1 + s) (n + m), the overlap that similarity s needs. A text of which too much
is its own thus leaves its buckets. For the pairs left at the end the same is asked of the sum, over parts of the hash space, of the smaller
count of shared shingles. Every reported link is verified on the multisets.

Defined results: documents without a word are in a class of their own. Texts of fewer than five words have one shingle, the whole
text. Texts with the same words are one class before any comparison. Rows without a key are not listed. Rows that repeat a key
with different texts tie these texts together. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from adjudica.llm.common import materialise
from adjudica.llm.components import components

WORD = re.compile(r"\w+")
M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers (the finaliser of SplitMix64)."""
    x = x + M1
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1] from 64-bit numbers."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


class Hashed(dict):
    """64-bit hashes of words, kept until there are `most`."""

    def __missing__(self, w: str) -> int:
        import xxhash

        self[w] = h = xxhash.xxh64_intdigest(w)
        return h


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, given the words' hashes; of the whole text if it is shorter."""
    k = min(k, len(words))
    n = len(words) - k + 1
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = mix(h ^ words[i:i + n])
    return h


def bag_minhash(doc: np.ndarray, item: np.ndarray, weight: np.ndarray, docs: int, m: int, batch: int = 1_000_000) -> np.ndarray:
    """Registers (docs x m) of earliest times. doc, item, weight: one entry per distinct shingle of a document."""
    first = np.full((docs, m), np.inf)
    parts = []
    low, width = 0, 1
    while True:
        live = weight > low
        if not live.any():
            break
        parts.append((doc[live], mix(item[live] ^ np.uint64((low * 2 + 1) * 0x632BE59BD9B4E019 % 2**64)), np.full(live.sum(), low), np.full(live.sum(), width), weight[live]))
        low, width = low + width, max(1, low + width)
    d, seed, lo, wd, w = (np.concatenate(x) for x in zip(*parts))
    t = np.zeros(len(d))
    drawn, points = 0, 1
    flat = first.reshape(-1)
    while len(d):
        g = max(1, min(points, batch // len(d)))
        for a in range(0, len(d), batch):
            s = slice(a, a + batch)
            draw = mix(seed[s][:, None] + np.arange(drawn * 2 + 1, (drawn + g) * 2 + 1, 2, dtype=np.uint64)[None, :] * M3)
            times = t[s][:, None] + np.cumsum(-np.log(unit(draw)) / wd[s][:, None], axis=1)
            t[s] = times[:, -1]
            draw = mix(draw)
            place = lo[s][:, None] + unit(mix(draw)) * wd[s][:, None]
            register = (draw % np.uint64(m)).astype(np.int64)
            ok = (place <= w[s][:, None]) & (times < first.max(1)[d[s]][:, None])
            np.minimum.at(flat, (d[s][:, None] * m + register)[ok], times[ok])
        drawn += g
        points = min(points * 2, 512)
        live = t < first.max(1)[d]
        d, seed, lo, wd, w, t = d[live], seed[live], lo[live], wd[live], w[live], t[live]
    return first


def band_keys(registers: np.ndarray, rows: int) -> np.ndarray:
    """One 64-bit key for every band of `rows` registers."""
    bits = registers.view(np.uint64).reshape(len(registers), -1, rows)
    h = np.zeros(bits.shape[:2], np.uint64)
    for i in range(rows):
        h = mix(h ^ bits[:, :, i])
    return h.view(np.int64)


def signed(df: DataFrame, key: str, text: str, k: int, bands: int, rows: int, chunk: int = 1_000_000) -> DataFrame:
    """(id, t, words, size, keys): a hash of the text, a digest of its word sequence, the number of shingles and the band keys; null without a word."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashed()

        def part(ids: list, ts: list, texts: list) -> pd.DataFrame:
            nonlocal known
            if len(known) > 200_000:
                known = Hashed()
            digests, sizes, keys, docs, items, weights = [], [], [None] * len(ids), [], [], []
            for i, t in enumerate(texts):
                ws = WORD.findall(t.lower()) if t else []
                if not ws:
                    digests.append(None)
                    sizes.append(0)
                    continue
                h = np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws))
                digests.append(hashlib.blake2b(h.tobytes(), digest_size=16).hexdigest())
                item, n = np.unique(shingles(h, k), return_counts=True)
                sizes.append(int(n.sum()))
                docs.append(np.full(len(item), i))
                items.append(item)
                weights.append(n)
            if docs:
                registers = bag_minhash(np.concatenate(docs), np.concatenate(items), np.concatenate(weights), len(ids), bands * rows)
                each = band_keys(registers, rows)
                keys = [each[i].tolist() if sizes[i] else None for i in range(len(ids))]
            return pd.DataFrame({"id": ids, "t": ts, "words": digests, "size": sizes, "keys": keys})

        for b in batches:
            ids, ts, texts, chars = [], [], [], 0
            for i, x, t in zip(b["id"], b["t"], b["text"]):
                ids.append(i)
                ts.append(x)
                texts.append(t)
                chars += len(t) if t else 0
                if chars >= chunk or len(ids) >= 2000:
                    yield part(ids, ts, texts)
                    ids, ts, texts, chars = [], [], [], 0
            if ids:
                yield part(ids, ts, texts)

    source = df.select(F.col(key).cast("long").alias("id"), F.xxhash64(text).alias("t"), F.col(text).alias("text")).filter("id is not null")
    return source.mapInPandas(run, "id long, t long, words string, size int, keys array<long>")


def jaccard(batches: Iterator[pd.DataFrame], k: int) -> Iterator[pd.DataFrame]:
    """Weighted Jaccard similarity of pairs (a, b, text_a, text_b)."""
    known = Hashed()

    def bag(t: str):
        nonlocal known
        if len(known) > 200_000:
            known = Hashed()
        ws = WORD.findall(t.lower())
        return np.unique(shingles(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)), k), return_counts=True)

    for batch in batches:
        out, last, right = [], None, None
        for ta, tb in zip(batch["text_a"], batch["text_b"]):
            if tb != last:
                last, right = tb, bag(tb)
            left = bag(ta)
            _, i, j = np.intersect1d(left[0], right[0], assume_unique=True, return_indices=True)
            both = int(np.minimum(left[1][i], right[1][j]).sum())
            out.append(both / (int(left[1].sum()) + int(right[1].sum()) - both))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "similarity": out})


def verified(pairs: DataFrame, texts: DataFrame, k: int, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose texts (node, text) have at least that similarity."""
    p = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
    return p.select("a", "b", "text_a", "text_b").mapInPandas(lambda it: jaccard(it, k), "a long, b long, similarity double").filter(F.col("similarity") >= least)


def counted(texts: DataFrame, k: int) -> DataFrame:
    """(node, s, n): the shingles of the texts (node, text) and how often each occurs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Hashed()
        for b in batches:
            nodes, found, counts, held = [], [], [], 0
            for node, t in zip(b["node"], b["text"]):
                if len(known) > 200_000:
                    known = Hashed()
                ws = WORD.findall(t.lower())
                s, n = np.unique(shingles(np.fromiter(map(known.__getitem__, ws), np.uint64, len(ws)), k), return_counts=True)
                nodes.append(np.full(len(s), node, np.int64))
                found.append(s.view(np.int64))
                counts.append(n)
                held += len(s)
                if held > 200_000:
                    yield pd.DataFrame({"node": np.concatenate(nodes), "s": np.concatenate(found), "n": np.concatenate(counts)})
                    nodes, found, counts, held = [], [], [], 0
            if nodes:
                yield pd.DataFrame({"node": np.concatenate(nodes), "s": np.concatenate(found), "n": np.concatenate(counts)})

    return texts.mapInPandas(run, "node long, s long, n int")


def only_here(rows: DataFrame) -> DataFrame:
    """(node, s, n) of the shingles that one text alone has."""
    return rows.groupBy("s").agg(F.count(F.lit(1)).alias("texts"), F.max("node").alias("node"), F.max("n").alias("n")).filter("texts = 1")


def unshared(texts: DataFrame, k: int) -> DataFrame:
    """(node, alone): the summed counts of the shingles that no other of these texts (node, text) has."""
    return only_here(counted(texts, k)).groupBy("node").agg(F.sum("n").alias("alone"))


def sketched(texts: DataFrame, k: int, bins: int) -> DataFrame:
    """(node, sketch): how many shingles that other texts have too fall in each of `bins` parts of the hash space.

    Two texts share at most the sum over the parts of the smaller count, a bound that needs no text."""
    rows = materialise(counted(texts, k), "shingles")
    part = F.pmod("s", F.lit(bins)).cast("int").alias("bin")
    of = lambda d, name: d.groupBy("node", part).agg(F.sum("n").alias(name))
    left = of(rows, "n").join(of(only_here(rows), "alone"), ["node", "bin"], "left").withColumn("n", (F.col("n") - F.coalesce("alone", F.lit(0))).cast("int"))
    counts = left.filter("n > 0").groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("c"))
    return counts.select("node", F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.element_at("c", i), F.lit(0))).alias("sketch"))


def compared(pairs: DataFrame, texts: DataFrame, tested: DataFrame | None, links: DataFrame | None, k: int, least: float) -> tuple[DataFrame, DataFrame]:
    """Links and tested pairs after those of `pairs` that were not tested before."""
    pairs = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = materialise(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
    found = materialise(verified(pairs, texts, k, least).select("a", "b"), "links")
    return (found, pairs) if links is None else (links.unionByName(found), tested.unionByName(pairs))


def near_roots(links: DataFrame, steps: int = 3) -> DataFrame:
    """(node, root): the smallest node within `steps` links. Equal roots mean one component; a large component may still have
    several, which costs comparisons and no links."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    roots = both.groupBy("a").agg(F.least("a", F.min("b")).alias("root"))
    for _ in range(steps - 1):
        roots = both.join(roots.select(F.col("a").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("root"))
    return roots.withColumnRenamed("a", "node")


def classes(df: DataFrame, key: str, text: str, least: float = 0.8, k: int = 5, bands: int = 32, rows: int = 6, few: int = 2, most_rounds: int = 3, bins: int = 512) -> DataFrame:
    """(key, class_id): class_id is the smallest key of the documents linked with this one, directly or through others.

    With 32 bands of 6 registers a pair of similarity 0.8 shares a band with probability 0.99994. `few` and `most_rounds` choose the plan, and `bins` the
    sharpness of the bound on pairs left at the end; none changes the result."""
    sign = materialise(signed(df, key, text, k, bands, rows), "signed")
    # one node per word sequence: its smallest key
    nodes = sign.filter("words is not null").groupBy("words").agg(F.min("id").alias("node"))
    member = materialise(sign.select("id", "words").join(nodes, "words").select("id", "node").distinct(), "members")
    own = sign.filter("keys is not null").join(nodes.select(F.col("node").alias("id")).distinct(), "id", "left_semi")
    own = own.groupBy("id").agg(F.min_by(F.struct("size", "keys"), "t").alias("s"))
    entries = materialise(own.select(F.col("id").alias("node"), "s.size", F.posexplode("s.keys").alias("band", "h")).select("node", "size", F.xxhash64("band", "h").alias("h")), "entries")
    shared = materialise(entries.join(entries.groupBy("h").agg(F.min("node").alias("x"), F.max("node").alias("y")).filter("x <> y").select("h"), "h"), "shared")
    # texts of those that share a bucket; of a key's different texts the one whose signature stands in `entries`
    source = df.select(F.col(key).cast("long").alias("node"), F.col(text).alias("text")).filter("node is not null and text is not null")
    texts = materialise(source.join(shared.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "texts")
    may_link = lambda m, n, cm, cn: (F.least(m, n) >= least * F.greatest(m, n)) & (F.least(cm, cn) >= least / (1 + least) * (m + n) - 1e-6)
    # texts with little of their own stand in the middle of a group; a tenth of chance gives each round others
    central = lambda turn: -F.col("common") / F.col("size") * (1 + F.pmod(F.xxhash64("node", F.lit(turn)), F.lit(1000)) / 10_000)
    links = tested = None
    open_ = shared.select("h", "node", "size", F.col("node").alias("root"), F.col("size").alias("common"))
    for turn in range(most_rounds):
        # buckets that still hold texts of different groups, each with one representative that all others are compared with
        lead = open_.groupBy("h").agg(F.min_by(F.struct("node", "size", "root", "common"), F.struct(central(turn), "node")).alias("lead"))
        pairs = open_.join(lead, "h").filter((F.col("root") != F.col("lead.root")) & may_link(F.col("size"), F.col("lead.size"), F.col("common"), F.col("lead.common")))
        links, tested = compared(pairs.select(F.col("node").alias("a"), F.col("lead.node").alias("b")), texts, tested, links, k, least)
        named = open_.drop("root").join(near_roots(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        mixed = named.groupBy("h").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("h")
        named = materialise(named.join(mixed, "h"), "named")
        alone = unshared(texts.join(named.select("node").distinct(), "node", "left_semi"), k)
        named = named.join(alone, "node", "left").withColumn("common", F.col("size") - F.coalesce("alone", F.lit(0))).drop("alone")
        named = materialise(named.filter(F.col("common") >= least * F.col("size") - 1e-6), "named")
        # a bucket's pairs of different groups: (n^2 - the sum over groups of n_group^2) / 2
        per = named.groupBy("h", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("h").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        per = per.withColumn("pairs", (F.col("n") * F.col("n") - F.col("same")) / 2).filter("pairs > 0")
        open_ = materialise(named.join(per.select("h"), "h"), "open")
        left = per.agg(F.sum("pairs").alias("pairs"), F.sum("n").alias("n")).first()
        if not left["n"] or left["pairs"] <= few * left["n"]:
            break
    # a pair that shares several buckets is listed in the first of them only
    open_ = open_.join(open_.groupBy("node").agg(F.collect_set("h").alias("hs")), "node")
    open_ = open_.join(sketched(texts.join(open_.select("node").distinct(), "node", "left_semi"), k, bins), "node")
    first = F.col("h") == F.array_min(F.array_intersect("hs", "hs_b"))
    r = open_.select("h", F.col("hs").alias("hs_b"), F.col("node").alias("b"), F.col("size").alias("size_b"), F.col("root").alias("root_b"), F.col("common").alias("common_b"), F.col("sketch").alias("sketch_b"))
    both = F.aggregate(F.zip_with("sketch", "sketch_b", lambda x, y: F.least(x, y)), F.lit(0), lambda s, x: s + x)
    near = both >= least / (1 + least) * (F.col("size") + F.col("size_b")) - 1e-6
    across = open_.join(r, "h").filter((F.col("node") > F.col("b")) & first & (F.col("root") != F.col("root_b")) & may_link(F.col("size"), F.col("size_b"), F.col("common"), F.col("common_b")) & near)
    links, _ = compared(across.select(F.col("node").alias("a"), "b"), texts, tested, links, k, least)
    # keys that repeat with different words tie the nodes of these
    tied = member.join(member.groupBy("id").agg(F.min("node").alias("b")), "id").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    root = components(links.unionByName(tied))
    found = member.join(root, "node", "left").groupBy("id").agg(F.min(F.coalesce("root", "node")).alias("class_id"))
    listed = sign.select("id").distinct().join(found, "id", "left")
    return listed.select(F.col("id").alias(key), F.coalesce("class_id", "id").alias("class_id"))


def deduplicated(df: DataFrame, key: str, text: str, **how) -> DataFrame:
    """The rows of df without near-duplicates: of every class the row with the smallest key, and rows without a key."""
    kept = classes(df, key, text, **how).filter(F.col(key) == F.col("class_id")).select(F.col(key).alias("__kept"))
    one = df.join(kept, F.col(key) == F.col("__kept")).drop("__kept")
    # of rows that repeat a key with different texts the one whose text comes first
    one = one.groupBy(F.col(key).alias("__kept")).agg(F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.coalesce(F.col(text), F.lit(""))).alias("__row")).select("__row.*")
    return one.unionByName(df.filter(F.col(key).isNull()))
