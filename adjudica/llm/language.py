"""Language identification of mixed-language text.

Every word is scored under each learned language by its character n-grams. Unicode script ranges first narrow the languages a
word may belong to. A Viterbi pass over the words, with a penalty for each change of language, then labels spans.

Defined results: a null text and a text without letters are `und` with score 0 and no spans. A text whose letters are all of
scripts that no learned language uses has no candidates: it gets the most frequent learned language with score 0. Repeated
rows get the same result each; ties go to the language first in alphabetical order. Without any training row every text is `und`.
A long text is cut into words whole and labelled in one piece; the words of about `chunk` characters are scored together. An empty table gives an empty result, and no column of
the table but the text is read.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.llm.common import training_sample

SPANS = "array<struct<first:int,last:int,lang:string>>"
RESULT = f"lang string, score double, spans {SPANS}"
#: First and last code point of scripts; other letters (and Latin) are script 0.
SCRIPTS = (
    ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F),
    ("indic", 0x900, 0xDFF), ("thai_lao", 0xE00, 0xEFF), ("tibetan_burmese", 0xF00, 0x109F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("ethiopic", 0x1200, 0x139F), ("khmer", 0x1780, 0x17FF), ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("arabic", 0xFB50, 0xFDFF), ("han", 0x20000, 0x3FFFF),
)
#: A word: a letter and the letters and marks after it.
WORD = r"\p{L}[\p{L}\p{M}]*"
#: The same below U+0300, where there are no marks and six characters count as word characters without being letters.
LATIN_WORD = r"[^\W\d_²³¹¼½¾]+"


def script_of(word: str) -> str:
    """The script of a word's first letter that is outside the Latin ranges, else `latin`."""
    for ch in word:
        c = ord(ch)
        if c >= 0x370:
            for name, first, last in SCRIPTS:
                if first <= c <= last:
                    return name
    return "latin"


def grams(word: str, orders: tuple[int, ...] = (2, 3, 4)) -> list[str]:
    """Character n-grams of a word set between blanks. Words beyond 64 letters (no language has them) keep every gram too."""
    w = f" {word} "
    return [w[i:i + n] for n in orders for i in range(len(w) - n + 1)]


def fit(df: DataFrame, text: str, label: str, bound: int = 1500, max_grams: int = 60_000, min_script: float = 0.002) -> dict:
    """Count n-grams of at most about `bound` distinct texts per language; keep the `max_grams` most frequent.

    Counting is Spark's; what comes to the driver is the table of n-grams, at most `max_grams` rows per model."""
    sample = training_sample(df, label, text, bound)
    words = sample.select("label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), F.lit(1))).alias("w")).groupBy("label", "w").agg(F.count(F.lit(1)).alias("n"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            acc: dict[tuple[str, str], int] = {}
            for lang, w, n in zip(b["label"], b["w"], b["n"]):
                for g in [*grams(w), "\0" + script_of(w)]:
                    acc[lang, g] = acc.get((lang, g), 0) + n
            yield pd.DataFrame([(a, g, n) for (a, g), n in acc.items()], columns=["label", "g", "n"])

    per = words.mapInPandas(count, "label string, g string, n long").groupBy("g", "label").agg(F.sum("n").alias("m"))
    table = per.groupBy("g").agg(F.sum("m").alias("n"), F.collect_list(F.struct("label", "m")).alias("each")).orderBy(F.desc(F.col("g").startswith("\0")), F.desc("n"), "g").limit(max_grams).toPandas()
    langs = sorted({r["label"] for each in table["each"] for r in each})
    at = {x: i for i, x in enumerate(langs)}
    counts = np.zeros((len(table), max(1, len(langs))))
    for i, each in enumerate(table["each"]):
        for r in each:
            counts[i, at[r["label"]]] = r["m"]
    names = list(table["g"])
    is_script = np.array([g.startswith("\0") for g in names], dtype=bool)
    scripts: dict[str, list[int]] = {}
    for g, row in zip([g for g in names if g.startswith("\0")], counts[is_script] / np.maximum(1, counts[is_script].sum(0))):
        scripts[g[1:]] = [k for k in range(len(langs)) if row[k] >= min_script]
    kept = counts[~is_script] + 0.5
    logp = np.log(kept / kept.sum(0)) if len(kept) else kept
    logp = logp - logp.mean(1, keepdims=True) if len(kept) else logp
    order = sorted(range(len(langs)), key=lambda k: (-counts[:, k].sum(), k))
    return {"langs": langs, "grams": {g: i for i, g in enumerate(g for g in names if not g.startswith("\0"))}, "logp": logp.astype(np.float32), "scripts": scripts, "default": order[0] if order else 0}


def word_scores(words: list[str], model: dict) -> np.ndarray:
    """Log-score of each word under each language, -inf-like (-30) for languages that do not use the word's script.

    The last column is 1 where the word has a candidate language."""
    k = len(model["langs"])
    out = np.zeros((len(words), k + 1), dtype=np.float32)
    at, logp = model["grams"], model["logp"]
    ids, starts = [], []
    for w in words:
        starts.append(len(ids))
        ids += [at[g] for g in grams(w) if g in at]
    if ids:
        total = np.vstack([np.zeros((1, k)), np.cumsum(logp[ids].astype(np.float64), axis=0)])
        ends = np.array([*starts[1:], len(ids)])
        # n-grams of three orders overlap: each letter is counted about three times
        out[:, :k] = (total[ends] - total[np.array(starts)]) / 3.0
    for i, w in enumerate(words):
        may = model["scripts"].get("latin" if w.isascii() else script_of(w), [])
        out[i, k] = bool(may)
        if not may:
            out[i, :k] = 0
        elif len(may) < k:
            out[i, [j for j in range(k) if j not in may]] = -30
    return out


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every row under `penalty` per change of label."""
    n, k = scores.shape
    rows = scores.tolist()
    best, back = rows[0], []
    for row in rows[1:]:
        top = max(best)
        arg, jump = best.index(top), top - penalty
        back.append([j if best[j] >= jump else arg for j in range(k)])
        best = [max(b, jump) + s for b, s in zip(best, row)]
    path = [best.index(max(best))]
    for prev in reversed(back):
        path.append(prev[path[-1]])
    return np.array(path[::-1])


def constant(scores: np.ndarray, doc: np.ndarray, best: np.ndarray, penalty: float) -> np.ndarray:
    """For each document: is its best single label surely the Viterbi path?

    It is if no other label gains more than half a penalty over it in any stretch of words: a path with m other stretches
    would gain at most m / 2 penalties and pay m - 1, m or more (m >= 2 where the single label does not occur at all)."""
    n_docs, k = best.size, scores.shape[1]
    gain = scores - scores[np.arange(len(scores)), best[doc]][:, None]
    run = np.cumsum(gain, axis=0, dtype=np.float64)
    before = run - gain
    span = np.abs(run).max() * 2 + 1 if len(run) else 1.0
    low = np.minimum.accumulate(before - span * doc[:, None], axis=0) + span * doc[:, None]
    ok = np.ones(n_docs, dtype=bool)
    ok[doc[((run - low) > penalty / 2).any(1)]] = False
    return ok


class Words(dict):
    """Numbers for words in the order they come."""

    def __missing__(self, w: str) -> int:
        self[w] = n = len(self)
        return n


def labeller(model: dict, penalty: float = 12.0, cache: int = 200_000, chunk: int = 1_500_000):
    """A function from an iterator of text Series to an iterator of (lang, score, spans) frames.

    A worker keeps the scores of at most about `cache` distinct words (plus those of one chunk) and handles `chunk` characters at once."""
    import regex

    latin, any_script, langs = re.compile(LATIN_WORD).findall, regex.compile(WORD).findall, model["langs"]
    k = len(langs)

    def find(text: str) -> list[str]:
        return latin(text) if text.isascii() or max(text) < "\u0300" else any_script(text)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen, table = Words(), np.zeros((0, k + 1), dtype=np.float32)

        def part(texts: list) -> list[tuple]:
            nonlocal seen, table
            if len(seen) > cache:
                seen, table = Words(), table[:0]
            ids, sizes, letters = [], [], []
            for t in texts:
                ws = find(t.lower()) if t else []
                ids.append(np.fromiter(map(seen.__getitem__, ws), np.int32, len(ws)))
                letters.append(np.fromiter(map(len, ws), np.int32, len(ws)))
                sizes.append(len(ws))
            if len(seen) > len(table):
                table = np.vstack([table, word_scores(list(itertools.islice(seen, len(table), None)), model)])
            if not k:
                return [("und", 0.0, [])] * len(texts)
            size = np.array(sizes)
            doc = np.repeat(np.arange(len(texts)), size)
            if not len(doc):
                return [("und", 0.0, [])] * len(texts)
            sc, ln = table[np.concatenate(ids)], np.concatenate(letters)
            known = ln * sc[:, k]
            sums = np.stack([np.bincount(doc, sc[:, j], len(texts)) for j in range(k)], axis=1)
            best = sums.argmax(1)
            total, usable = np.bincount(doc, ln, len(texts)), np.bincount(doc, known, len(texts))
            same = constant(sc[:, :k], doc, best, penalty)
            ends = np.cumsum(size)
            out = []
            for i in range(len(texts)):
                if not size[i]:
                    out.append(("und", 0.0, []))
                elif not usable[i]:
                    out.append((langs[model["default"]], 0.0, []))
                elif same[i]:
                    out.append((langs[best[i]], usable[i] / total[i], [(0, int(size[i]) - 1, langs[best[i]])]))
                else:
                    a, b = ends[i] - size[i], ends[i]
                    path = viterbi(sc[a:b, :k], penalty)
                    share = np.bincount(path, known[a:b], k)
                    cut = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), len(path)]
                    top = int(share.argmax())
                    out.append((langs[top], float(share[top] / total[i]), [(x, y - 1, langs[path[x]]) for x, y in zip(cut, cut[1:])]))
            return out

        for texts in batches:
            rows, part_texts, chars = [], [], 0
            for t in texts:
                part_texts.append(t)
                chars += len(t) if t else 0
                if chars >= chunk:
                    rows += part(part_texts)
                    part_texts, chars = [], 0
            if part_texts:
                rows += part(part_texts)
            yield pd.DataFrame({"lang": [r[0] for r in rows], "score": [float(r[1]) for r in rows], "spans": [[{"first": a, "last": b, "lang": x} for a, b, x in r[2]] for r in rows]})

    return run


def label(text: Column, model: dict, penalty: float = 12.0) -> Column:
    """struct(lang, score, spans) of a text. score is the share of the letters that lie in spans of `lang`; spans number words from 0."""
    run = labeller(model, penalty)

    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return run(batches)

    return F.pandas_udf(udf, RESULT)(text)
