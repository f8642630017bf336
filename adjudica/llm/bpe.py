"""Byte-level BPE encoding and decoding of whole texts, each distinct word once.

Texts are cut into pre-tokens by the tokenizer's pattern. In blocks of documents every pre-token becomes its number in the block's
word list, which keeps positions at one to three bytes each. The word lists are dealt out by a hash of the word, so a word of all
blocks meets in one task, where it is merged once; its ids go back to the blocks, and the documents are put together by position.
Decoding looks ids up in the token-byte table.

Memory: a block is about `block_chars` characters (one longer text is a block of its own); a bucket holds the distinct words of its
share of the hash space, and there are `buckets_per_partition` buckets for every shuffle partition. Texts are read and cut once;
what an executor loses is cut again from its part of the input.

Defined results: null and empty texts have no ids. Repeated rows each get a result row. Pre-tokens of any length are merged in
O(n log n). An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "block long, bucket int, words binary, keys array<long>, sizes array<int>, places binary, dealt binary"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank from a file with lines `base64 rank`. A vocabulary has a fixed number of entries."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one pre-token: always the pair of lowest rank first, the leftmost of equals."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i:i + 2])) is not None]
    heapq.heapify(heap)
    alive = bytearray(b"\1") * n
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i]
        if not alive[i] or j >= n or end[j] != stop:
            continue
        alive[j] = 0
        end[i], nxt[i] = end[j], nxt[j]
        if nxt[i] < n:
            prv[nxt[i]] = i
        for a in (prv[i], i):
            if a >= 0 and nxt[a] < n and (r := ranks.get(word[a:end[nxt[a]]])) is not None:
                heapq.heappush(heap, (r, a, end[nxt[a]]))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i:end[i]]])
        i = nxt[i]
    return out


def pack(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2**32, compressed byte by byte of their place value."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    return np.ascontiguousarray(np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def pack_words(words: list[bytes]) -> bytes:
    import zstandard

    return zstandard.compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words), 3)


def unpack_words(data: bytes) -> list[bytes]:
    import zstandard

    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = np.cumsum(np.frombuffer(raw, "<u4", n, 4)).tolist()
    body = raw[4 + 4 * n:]
    return [body[a:b] for a, b in zip([0, *ends], ends)]


class Numbered(dict):
    def __missing__(self, w):
        self[w] = n = len(self)
        return n


def blocks(df: DataFrame, key: str, text: str, pattern: str, buckets: int, block_chars: int) -> DataFrame:
    """Two kinds of rows. (block, keys, sizes, places, dealt): the documents of a block as numbers of words, and each word's bucket;
    (block, bucket, words): the words of one bucket by number."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import regex
        from pyspark import TaskContext

        find = regex.compile(pattern).findall
        task, seq = TaskContext.get().partitionId(), itertools.count()

        def close(keys, sizes, places, seen) -> pd.DataFrame:
            block = (task << 32) | next(seq)
            words = [w.encode("utf-8", "replace") for w in seen]
            bucket = np.fromiter((zlib.crc32(w) % buckets for w in words), np.int64, len(words))
            # frequent words get the small numbers, which compress best
            places = np.concatenate(places)
            order = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")
            number = np.empty(len(words), np.int64)
            number[order] = np.arange(len(words))
            bucket = bucket[order]
            rows = [(block, None, None, keys, sizes, pack(number[places]), pack(bucket))]
            for b in range(buckets):
                mine = order[bucket == b]
                if len(mine):
                    rows.append((block, b, pack_words([words[i] for i in mine]), None, None, None, None))
            return pd.DataFrame(rows, columns=["block", "bucket", "words", "keys", "sizes", "places", "dealt"]).astype({"bucket": "Int32"})

        keys, sizes, places, seen, chars = [], [], [], Numbered(), 0
        for batch in batches:
            for k, t in zip(batch["key"], batch["text"]):
                ws = find(t) if t else []
                keys.append(None if pd.isna(k) else int(k))
                sizes.append(len(ws))
                places.append(np.fromiter(map(seen.__getitem__, ws), np.int32, len(ws)))
                chars += len(t) if t else 0
                if chars >= block_chars:
                    yield close(keys, sizes, places, seen)
                    keys, sizes, places, seen, chars = [], [], [], Numbered(), 0
        if keys:
            yield close(keys, sizes, places, seen)

    return df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).mapInPandas(run, BLOCKS)


def round_trip(df: DataFrame, key: str, text: str, ranks: dict[bytes, int], pattern: str, keep: bool = False, block_chars: int = 24_000_000, buckets_per_partition: int = 4) -> DataFrame:
    """Encode every text and decode its ids -> key, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256, and with
    `keep` also ids (array<int>) and decoded (binary)."""
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(ranks)  # fixed size: the vocabulary
    buckets = buckets_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    made = blocks(df, key, text, pattern, buckets, block_chars)

    def encode(group: pd.DataFrame) -> pd.DataFrame:
        """One bucket's words of all blocks -> their ids; the documents of a block pass unchanged."""
        if group["bucket"].isna().iloc[0]:
            return group.drop(columns=["words", "meet"]).assign(counts=None, ids=None)[names]
        ranks, known, out = shared.value, {}, []
        for data in group["words"]:
            counts, ids = [], []
            for w in unpack_words(data):
                if w not in known:
                    known[w] = merge(w, ranks)
                counts.append(len(known[w]))
                ids += known[w]
            out.append((pack(np.array(counts, np.int64)), pack(np.array(ids, np.int64))))
        return pd.DataFrame({"block": group["block"], "bucket": group["bucket"], "keys": None, "sizes": None, "places": None, "dealt": None, "counts": [a for a, _ in out], "ids": [b for _, b in out]})

    encoded = "block long, bucket int, keys array<long>, sizes array<int>, places binary, dealt binary, counts binary, ids binary"
    names = [c.split()[0] for c in encoded.split(", ")]
    # documents and word lists take the same exchange, so that texts are cut once
    lists = made.withColumn("meet", F.coalesce(F.col("bucket").cast("long"), -1 - F.col("block"))).groupBy("meet").applyInPandas(encode, encoded)
    schema = "key long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if keep else "")

    def assemble(rows: pd.DataFrame) -> pd.DataFrame:
        docs, lists = rows[rows["bucket"].isna()], rows[rows["bucket"].notna()]
        table = {r: b for b, r in shared.value.items()}
        dealt = unpack(docs["dealt"].iloc[0])  # a block has one row of documents
        words: list[list[int]] = [[]] * len(dealt)
        for bucket, counts, ids in zip(lists["bucket"], lists["counts"], lists["ids"]):
            ids, ends = unpack(ids).tolist(), np.cumsum(unpack(counts)).tolist()
            for n, a, b in zip(np.flatnonzero(dealt == bucket).tolist(), [0, *ends], ends):
                words[n] = ids[a:b]
        size = np.fromiter(map(len, words), np.int64, len(words))
        as_text = [",".join(map(str, w)) for w in words]
        as_bytes = [b"".join(map(table.__getitem__, w)) for w in words]
        out = []
        for keys, sizes, places in zip(docs["keys"], docs["sizes"], docs["places"]):
            places, a = unpack(places), 0
            for k, n in zip(keys, sizes):
                p, a = places[a:a + n], a + n
                at = p.tolist()
                raw = b"".join(map(as_bytes.__getitem__, at))
                row = (k, int(size[p].sum()), hashlib.sha256(",".join(map(as_text.__getitem__, at)).encode()).hexdigest(), hashlib.sha256(raw).hexdigest())
                out.append((*row, [i for x in at for i in words[x]], raw) if keep else row)
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"key": "Int64"})

    return lists.groupBy("block").applyInPandas(assemble, schema).withColumnRenamed("key", key)


def decode(df: DataFrame, ids: str, ranks: dict[bytes, int], out: str = "decoded") -> DataFrame:
    """Add the bytes of a column of token ids (array<int>). A null list stays null; an id that is not in the table adds nothing."""
    shared = df.sparkSession.sparkContext.broadcast({r: b for b, r in ranks.items()})

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        table = shared.value
        for batch in batches:
            yield pd.Series([None if x is None else b"".join(table.get(int(i), b"") for i in x) for x in batch], dtype="object")

    return df.withColumn(out, F.pandas_udf(run, "binary")(F.col(ids)))
