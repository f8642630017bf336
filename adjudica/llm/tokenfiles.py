"""Token ids of documents in compressed binary files.

Documents are sorted by key over all tasks (a range partitioning). Every task encodes its documents with the tokenizer, appends the
end id to each, and writes segments of about `segment_ids` ids, each with an index of its documents and the ids in range-coded, checksummed blocks
(rangecoder). A manifest row names file, place and size of each segment; the files of a failed attempt are in no manifest. The
place of a segment among all ids is a prefix sum over the manifest. Reading deals segments over tasks and decodes them.

A segment is: the magic bytes ADJTOK02; 3 u32 (documents, blocks, bytes of the keys); a u32 of each document's key bytes (2**32 - 1: no
key); a u64 of each document's ids; the keys (UTF-8); 6 u32 of each block (ids, alphabet, bytes of alphabet, bytes of code, crc32 of ids, crc32 of
bytes); u32 crc32 of all before; the blocks. All numbers are little-endian.

Tokenizing: a word (a stretch without blanks and line feeds) is encoded once by the tokenizer library and its ids are looked
up afterwards. That equals encoding whole texts for tokenizers whose pre-tokens never reach over white space, as word-level BPE with word ends.
For a tokenizer that normalizes and splits as `NORMALIZER` and `SPLITTER` say, a word of ASCII and letters of Latin-1 is cut into its pre-tokens
(letters, a digit, signs) in lower case first, so that the library sees each of them once, however written and whatever stands beside it. Other words, such as
those with an apostrophe, a vertical bar, a combining mark or letters of another script, go to the library as they are.
A Python worker keeps its words from task to task.

Defined results: null and empty texts have the end id alone. Rows without a key come first. Rows of one key stand in order of a hash of
their text; repeated rows are stored as often as they occur, and are dealt over several tasks. A text of any length stays in one segment, so
the longest text bounds a task's memory. An empty table gives empty files and no rows. A damaged block stops the reader with its name.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adjudica.llm import rangecoder
from adjudica.llm.common import materialise
from adjudica.sources.tables import shared_dir

MAGIC = b"ADJTOK02"
NO_KEY = 0xFFFFFFFF
MANIFEST = "part int, seq int, file string, place long, size long, n_docs long, n_ids long"
#: A character that is a pre-token of its own in the middle of words that do not hold it.
FENCE = "0"
#: Words of one text for the library: long texts take it longer a word.
TOGETHER = 64
#: What a tokenizer does to a text before its merges, if `Pieces` may cut its words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
SPLITTER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
#: Kinds of bytes. C3 leads the letters of Latin-1, and two signs that are told apart by their second byte.
BLANK, LETTER, DIGIT, SIGN, ODD = range(5)
KINDS = bytes(
    BLANK if c in b" \n" else DIGIT if c in b"0123456789" else LETTER if chr(c).isalpha() and c < 128 or c == 0xC3 or 0x80 <= c < 0xC0 else SIGN if 32 < c < 127 and c not in b"'|" else ODD
    for c in range(256))
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places starts[0], starts[0] + 1, ... (sizes[0] of them), starts[1], ..."""
    ends = sizes.cumsum()
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


class Numbers(dict):
    """Words by number, 0, 1, ... as they are first asked for; `new` holds those not encoded yet."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class Words:
    """Ids of words, each encoded once; `most` words are remembered, then the memory is cleared (a matter of speed alone)."""

    def __init__(self, tokenizer: str, most: int = 400_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_str(tokenizer), most
        self.fence = self.tokenizer.encode(FENCE, add_special_tokens=False).ids
        self.clear()

    def clear(self) -> None:
        self.number = Numbers()
        self.ids, self.starts, self.sizes, self.used = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def library(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def lists(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Groups of the words: their places, their ids and the number of each word's ids. Words without the fence are encoded as texts of some
        words, fences between them; the others one by one."""
        place = np.arange(len(words))
        fenced = np.array([FENCE in w for w in words], bool) if len(self.fence) == 1 else np.ones(len(words), bool)
        plain = [w for w in words if FENCE not in w] if not fenced.all() else []
        got = []
        if plain:
            texts = [f" {FENCE} ".join(plain[a:a + TOGETHER]) for a in range(0, len(plain), TOGETHER)]
            ids = np.array([i for e in self.library(texts) for i in (*e, *self.fence)], np.uint32)
            cuts = np.flatnonzero(ids == self.fence[0])
            if len(cuts) == len(plain):
                got.append((place[~fenced], ids[ids != self.fence[0]], np.diff(cuts, prepend=-1) - 1))
            else:  # a vocabulary in which the fence has another use
                fenced[:] = True
        if fenced.any():
            each = self.library([w for w, alone in zip(words, fenced.tolist()) if alone])
            got.append((place[fenced], np.array([i for e in each for i in e], np.uint32), np.array([len(e) for e in each], np.int64)))
        return got

    def add(self, groups: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Remember the ids of words by number."""
        self.starts, self.sizes = grown(self.starts, len(self.number)), grown(self.sizes, len(self.number))
        for places, ids, sizes in groups:
            self.ids = grown(self.ids, self.used + len(ids))
            self.ids[self.used:self.used + len(ids)] = ids
            self.sizes[places] = sizes
            self.starts[places] = self.used + sizes.cumsum() - sizes
            self.used += len(ids)

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, an end id after each, and the number of each text's ids."""
        if len(self.number) > self.most:
            self.clear()
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        counts = np.array([*map(len, cut)], np.int64)
        places = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(counts.sum()))
        if self.number.new:
            first = len(self.number) - len(self.number.new)
            self.add([(first + which, ids, sizes) for which, ids, sizes in self.lists(self.number.new)])
            self.number.new = []
        return self.put(places, counts, end)

    def put(self, places: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
        """What `encode` returns, for texts of so many words with these numbers."""
        sizes = self.sizes[places]
        before = np.concatenate([[0], sizes.cumsum()])
        lasts = counts.cumsum()
        n = before[lasts] - before[lasts - counts]
        ends = (n + 1).cumsum()
        out = np.full(int(ends[-1]) if len(ends) else 0, end, np.uint32)
        inside = np.ones(len(out), bool)
        inside[ends - 1] = False
        out[inside] = self.ids[ragged(self.starts[places], sizes)]
        return out, n + 1


class Pieces(Words):
    """Ids of pre-tokens, each encoded once, for a tokenizer that `fits`; words that are not cut stand beside them in the same memory."""

    def __init__(self, tokenizer: str, most: int = 600_000):
        super().__init__(tokenizer, most)
        model = json.loads(tokenizer)["model"]
        self.last = np.zeros(1 + max(model["vocab"].values()), bool)
        self.last[[i for t, i in model["vocab"].items() if t.endswith(model["end_of_word_suffix"])]] = True

    @staticmethod
    def fits(tokenizer: str) -> bool:
        """If the tokenizer normalizes and splits as this class does, and marks the last id of every pre-token."""
        t = json.loads(tokenizer)
        model, suffix = t["model"], t["model"].get("end_of_word_suffix")
        if t["normalizer"] != NORMALIZER or t["pre_tokenizer"] != SPLITTER or t["truncation"] or t["padding"] or model["type"] != "BPE" or model["dropout"] or not suffix:
            return False
        if model["continuing_subword_prefix"] or not all("|" in a["content"] for a in t["added_tokens"]):
            return False
        signs = [*map(chr, range(33, 127)), "Ã", *(chr(c) for c in range(0xA1, 0xC0) if c != 0xAD), *(chr(c) for c in range(0x100, 0x144))]  # bytes as ByteLevel writes them
        return all(c in model["vocab"] and c + suffix in model["vocab"] for c in signs) and suffix not in model["vocab"]

    def cut(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Pieces of all texts (binary), if each is a whole odd word, and the number of each text's pieces."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = b"\n".join([*raw, b""])
        kinds, low = np.frombuffer(bytearray(data.translate(KINDS)), np.uint8), np.frombuffer(bytearray(data.translate(LOWER)), np.uint8)
        was = np.frombuffer(data, np.uint8)
        lead = np.flatnonzero(was == 0xC3)
        second = was[lead + 1]
        odd = np.concatenate([np.flatnonzero(kinds == ODD), lead[(second == 0x97) | (second == 0xB7)]])
        capital = lead[second < 0x9F] + 1
        low[capital] += 32
        if len(odd):
            blanks = np.flatnonzero(kinds == BLANK)
            words = np.unique(np.searchsorted(blanks, odd))
            starts = np.where(words > 0, blanks[words - 1] + 1, 0)
            spans = ragged(starts, blanks[words] - starts)
            kinds[spans], low[spans] = ODD, was[spans]
        first = np.ones(len(data), bool)
        np.not_equal(kinds[1:], kinds[:-1], out=first[1:])
        first |= kinds == DIGIT
        first = np.flatnonzero(first)
        kind, sizes = kinds[first], np.diff(first, append=len(data))
        kept = kind != BLANK
        ends = sizes[kept].cumsum()
        offsets = np.concatenate([[0], ends]).astype(np.int32)
        body = low.tobytes().translate(None, b" \n")
        pieces = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(body)])
        stops = np.searchsorted(first[kept], np.fromiter((len(t) + 1 for t in raw), np.int64, len(raw)).cumsum())
        return pieces, kind[kept] == ODD, np.diff(stops, prepend=0)

    def encode(self, texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.number) > self.most:
            self.clear()
        pieces, odd, counts = self.cut(texts)
        coded = pieces.dictionary_encode()
        places, names = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = len(self.number)
        numbers = np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))
        if self.number.new:
            whole = np.zeros(len(names), bool)
            whole[places[odd]] = True
            whole = whole[numbers >= known]
            groups = []
            if whole.any():
                place = known + np.flatnonzero(whole)
                groups += [(place[which], ids, sizes) for which, ids, sizes in self.lists([w.decode("utf-8", "surrogatepass") for w, x in zip(self.number.new, whole) if x])]
            plain = [w for w, x in zip(self.number.new, whole.tolist()) if not x]
            if plain:
                each = self.library([b" ".join(plain[a:a + TOGETHER]).decode("utf-8") for a in range(0, len(plain), TOGETHER)])
                ids = np.fromiter(chain.from_iterable(each), np.uint32, sum(map(len, each)))
                groups.append((known + np.flatnonzero(~whole), ids, np.diff(np.flatnonzero(self.last[ids]), prepend=-1)))
            self.add(groups)
            self.number.new = []
        return self.put(numbers[places], counts, end)


#: The words of this Python worker, by tokenizer; the last one used is kept.
KEPT: dict[str, Words] = {}


def words_of(tokenizer: str) -> Words:
    if tokenizer not in KEPT:
        KEPT.clear()
        KEPT[tokenizer] = Pieces(tokenizer) if Pieces.fits(tokenizer) else Words(tokenizer)
    return KEPT[tokenizer]


def grown(a: np.ndarray, n: int) -> np.ndarray:
    return a if len(a) >= n else np.concatenate([a, np.zeros(max(n, 2 * len(a)) - len(a), a.dtype)])


def pack_segment(keys: list[str | None], sizes: np.ndarray, ids: np.ndarray) -> bytes:
    table, body = rangecoder.pack_ids(ids)
    raw = [None if k is None else k.encode("utf-8", "surrogatepass") for k in keys]
    names = b"".join(k for k in raw if k is not None)
    head = MAGIC + np.array([len(keys), len(table), len(names)], "<u4").tobytes()
    head += np.array([NO_KEY if k is None else len(k) for k in raw], "<u4").tobytes() + sizes.astype("<u8").tobytes() + names + table.tobytes()
    return head + np.uint32(zlib.crc32(head)).astype("<u4").tobytes() + body


def unpack_segment(data: bytes) -> tuple[list[str | None], np.ndarray, np.ndarray]:
    """Keys, number of ids of each document, ids."""
    if data[:8] != MAGIC or len(data) < 24:
        raise ValueError("not a segment of token ids")
    docs, blocks, names = np.frombuffer(data, "<u4", 3, 8).tolist()
    end = 20 + 12 * docs + names + 24 * blocks
    if len(data) < end + 4 or zlib.crc32(data[:end]) != np.frombuffer(data, "<u4", 1, end)[0]:
        raise ValueError("the index of the segment is damaged")
    sizes_of_keys = np.frombuffer(data, "<u4", docs, 20).astype(np.int64)
    sizes = np.frombuffer(data, "<u8", docs, 20 + 4 * docs).astype(np.int64)
    at, keys = 20 + 12 * docs, []
    for n in sizes_of_keys.tolist():
        keys.append(None if n == NO_KEY else data[at:at + n].decode("utf-8", "surrogatepass"))
        at += 0 if n == NO_KEY else n
    table = np.frombuffer(data, "<u4", 6 * blocks, at).reshape(-1, 6)
    return keys, sizes, rangecoder.unpack_ids(table, data[end + 4:])


def store(folder: str):
    """The file system of a folder and the folder's path in it (any URI that pyarrow knows)."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if ":" in folder.split("/")[0] else os.path.abspath(folder))


def write(df: DataFrame, key: str, text: str, tokenizer: str, end: int, folder: str | None = None, segment_ids: int = 1 << 22, file_segments: int = 16) -> DataFrame:
    """Write the ids of all texts in ascending order of the key -> manifest with the place `start` of every segment among all ids.

    `tokenizer` is the JSON of a tokenizer, sent to the executors (fixed size). `folder` must be reachable by all executors; without one, a new folder below spark.checkpoint.dir."""
    spark = df.sparkSession
    folder = folder or shared_dir(spark)
    model = spark.sparkContext.broadcast(tokenizer)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    rows = rows.repartitionByRange("key", "tie", "row").sortWithinPartitions("key", "tie", "row").select(F.col("key").cast("string").alias("key"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        files, path = store(folder)
        files.create_dir(path, recursive=True)
        part, name = TaskContext.get().partitionId(), uuid.uuid4().hex
        words, seq, out = words_of(model.value), 0, None
        keys, sizes, ids, held = [], [], [], 0

        def close() -> pd.DataFrame:
            nonlocal seq, out, held
            if out is None or seq % file_segments == 0:
                if out is not None:
                    out.close()
                out = files.open_output_stream(f"{path}/{part:06d}-{seq:06d}-{name}.ids")
            file = f"{folder.rstrip('/')}/{part:06d}-{seq - seq % file_segments:06d}-{name}.ids"
            data = pack_segment(keys, np.concatenate(sizes), np.concatenate(ids))
            place = out.tell()
            out.write(data)
            row = pd.DataFrame([(part, seq, file, place, len(data), len(keys), held)], columns=[c.split()[0] for c in MANIFEST.split(", ")])
            keys.clear(), sizes.clear(), ids.clear()
            seq, held = seq + 1, 0
            return row

        for batch in batches:
            names, texts = batch["key"].tolist(), batch["text"].tolist()
            a = 0
            while a < len(texts):
                b, chars = a, 0
                while b < len(texts) and (b == a or chars + len(texts[b]) <= 8_000_000):
                    chars += len(texts[b])
                    b += 1
                more, n = words.encode(texts[a:b], end)
                while a < b:  # as many documents as fill the segment
                    take = max(1, int(np.searchsorted(n.cumsum(), segment_ids - held, side="right")))
                    size = int(n[:take].sum())
                    keys += [None if k is None else str(k) for k in names[a:a + take]]
                    sizes.append(n[:take])
                    ids.append(more[:size])
                    held, a, n, more = held + size, a + take, n[take:], more[size:]
                    if a < b or held >= segment_ids:
                        yield close()
        if keys:
            yield close()
        if out is not None:
            out.close()

    return placed(materialise(rows.mapInPandas(run, MANIFEST), "manifest"))


def placed(manifest: DataFrame) -> DataFrame:
    """Add `start`, the ids before each segment. A manifest has one row a segment and at most one part a shuffle partition."""
    parts = manifest.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq")) - F.col("n_ids")
    return manifest.join(before, "part").withColumn("start", F.col("before") + inside).drop("before")


def read(manifest: DataFrame, key_type: str = "long", keep: bool = False) -> DataFrame:
    """Read the segments of a manifest back -> key, start, n_tokens, ids_crc32 (unsigned, of the ids as little-endian u32) of every document, and
    with `keep` its ids (array<long>)."""
    schema = "key string, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if keep else "")
    columns = [c.split()[0] for c in schema.split(", ")]
    segments = manifest.count()  # one row a segment

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for file, place, size, start in zip(batch["file"], batch["place"], batch["size"], batch["start"]):
                files, path = store(file)
                with files.open_input_file(path) as f:
                    data = f.read_at(int(size), int(place))
                try:
                    keys, sizes, ids = unpack_segment(data)
                except ValueError as error:
                    raise ValueError(f"{file}, segment at byte {place}: {error}") from error
                ends = sizes.cumsum()
                raw, step = memoryview(ids.tobytes()), 4
                for a in range(0, len(keys), 20_000):
                    spans = list(zip((ends - sizes)[a:a + 20_000].tolist(), ends[a:a + 20_000].tolist()))
                    rows = pd.DataFrame({"key": keys[a:a + 20_000], "start": [int(start) + x for x, _ in spans], "n_tokens": [y - x for x, y in spans], "ids_crc32": [zlib.crc32(raw[step * x:step * y]) for x, y in spans]})
                    if keep:
                        rows["ids"] = [ids[x:y].astype(np.int64) for x, y in spans]
                    yield rows[columns]

    rows = manifest.select("file", "place", "size", "start").repartition(max(1, segments))
    return rows.mapInPandas(run, schema).withColumn("key", F.col("key").cast(key_type))


def round_trip(df: DataFrame, key: str, text: str, tokenizer: str, end: int, keep: bool = False, **options) -> DataFrame:
    """Write and read back, under the key's own name and type."""
    out = read(write(df, key, text, tokenizer, end, **options), df.schema[key].dataType.simpleString(), keep)
    return out.withColumnRenamed("key", key)
