"""Toxicity of text that may be disguised.

Words are taken as sent through a noisy channel: letters become look-alike digits or signs, separators are put between letters,
letters are repeated. For every suspicious token a lattice of letters is laid out and decoded by Viterbi search under a character
language model (three letters of history); a sign or blank may also be the end of a word, so a token can hold several words. The
restored words are then scored with weights learned from labelled documents, and so are the words between non-letters, as learned
from; the reading that scores more counts.

A token of letters only, without equal neighbours, has a lattice of one path and is its own decoding. A token of whose lattice no path begins a word like a weighted one is not
decoded: whatever it says weighs nothing.

Defined results: null and empty texts have no words and get the score of the intercept. Repeated rows get equal scores. Without a
toxic or a clean training row, or without a letter in them, there is nothing to learn: every score is 0. Where they are too few
to weigh any word, every score is the share of toxic ones. Readings of equal cost: the one found first. A text of any length is scored
whole in its row; an empty table gives an empty result. Columns other than the text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adjudica.llm.common import materialise, training_sample

#: Letters that a sign may stand for.
LOOKALIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il",
    "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¥": "y", "§": "s", "#": "h", "*": "aeiou", "%": "",
}
SEPARATORS = "-_.·~'`^=,:;/\\)>}{][&?\"%*#|"
TOKEN = re.compile(r"\S+")
#: Three or more single letters or signs with up to three separators between them.
SPACED = re.compile(r"(?<!\S)(?:(?:[^\W_]|[@$!|+(<€£¡¥§#])[\s.\-_*]{1,3}){2,}(?:[^\W_]|[@$!|+(<€£¡¥§#])(?![^\s.,;:?!])")
WORD = re.compile(r"[^\W\d_]+")
PLAIN = re.compile(r"[^\W\d_]+\Z")
REPEAT = re.compile(r"(.)\1+")
EDGE = ".,;:?\"'()[]{}<>-_~`^=&%*#/\\|"
COST_SIGN, COST_DROP, COST_KEEP = 1.5, 1.0, 6.0
#: Leaving out one letter of a run of three or more equal ones, and of two.
COST_RUN, COST_PAIR = 0.3, 2.0


def word_grams(counts: dict[str, int], order: int = 4) -> Counter:
    """How often each letter, or the word's end, stands behind the order - 1 letters before it."""
    if not counts:
        return Counter()
    words = list(counts)
    letters = np.frombuffer("".join(["^" * (order - 1) + w + "$" for w in words]).encode("utf-32-le", "surrogatepass"), "<u4")
    alphabet, place = np.unique(letters, return_inverse=True)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1  # grams of a word
    ends = (sizes + order - 1).cumsum()
    first = np.arange(int(sizes.sum())) + np.repeat(ends - sizes - (order - 1) - (sizes.cumsum() - sizes), sizes)
    gram, span = np.zeros(len(first), np.int64), 1
    for j in range(order):
        if span * len(alphabet) >= 2**62:  # numbers would not fit: number the beginnings anew
            known, gram = np.unique(gram, return_inverse=True)
            span = len(known)
        gram, span = gram * len(alphabet) + place[first + j], span * len(alphabet)
    by = np.argsort(gram, kind="stable")
    starts = np.flatnonzero(np.diff(gram[by], prepend=-1))
    n = np.add.reduceat(np.repeat(np.fromiter(counts.values(), float, len(words)), sizes)[by], starts)
    text = letters[first[by[starts]][:, None] + np.arange(order)].astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return Counter(dict(zip([text[i:i + order] for i in range(0, len(text), order)], n.tolist())))


def gram_rows(words: dict[str, int], order: int) -> pd.DataFrame:
    return pd.DataFrame(word_grams(words, order).items(), columns=["gram", "n"]).astype({"gram": "object", "n": "int64"})


def grams_lm(grams: dict[str, int], order: int = 4) -> dict:
    """Character model of n-gram counts: log P(letter | up to order - 1 letters before), backing off to shorter histories."""
    seen: list[dict[str, float]] = [{} for _ in range(order + 1)]
    for x, n in grams.items():
        for m in range(order):
            g = x[order - 1 - m:]
            seen[m + 1][g] = seen[m + 1].get(g, 0) + n
            h = "\0" + g[:-1]
            seen[m + 1][h] = seen[m + 1].get(h, 0) + n
    return {"order": order, "seen": seen}


def letters_lm(counts: dict[str, int], order: int = 4) -> dict:
    """Character model of a word list."""
    return grams_lm(word_grams(counts, order), order)


def corpus_grams(df: DataFrame, text: str, order: int = 4, flush: int = 200_000) -> DataFrame:
    """(gram, n) over the words of every text. A task holds at most about `flush` distinct words and its own sums per gram are dealt on."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: Counter = Counter()
        for batch in batches:
            for t in batch["text"]:
                if t:
                    words.update(WORD.findall(t.lower()))
                if len(words) > flush:
                    yield gram_rows(words, order)
                    words = Counter()
        yield gram_rows(words, order)

    found = df.select(F.col(text).alias("text")).filter("text is not null").mapInPandas(run, "gram string, n long")
    return found.groupBy("gram").agg(F.sum("n").alias("n"))


def log_letter(lm: dict, history: str, ch: str) -> float:
    p = 1e-4
    for m in range(lm["order"]):
        h = history[len(history) - m:] if m else ""
        seen = lm["seen"][m + 1]
        total = seen.get("\0" + h, 0)
        if not total:
            break
        p = (seen.get(h + ch, 0) + 4 * p) / (total + 4)
    return math.log(p)


def options(prev: str | None, ch: str, following: str | None = None, before: str | None = None) -> list[tuple[str, float]]:
    """Readings of one character: (letter, nothing or a blank that ends the word, cost). `before` stands before `prev`."""
    if ch.isalpha():
        out = [(ch, 0.0)]
        if ch == prev:
            out.append(("", COST_RUN if ch in (following, before) else COST_PAIR))
        return out
    out = [(x, COST_SIGN) for x in LOOKALIKE.get(ch, "")]
    separates = ch in SEPARATORS or ch.isspace()
    if separates or ch == prev:
        out.append(("", COST_DROP))
    if not out:
        out.append(("", COST_KEEP))
    return out if ch.isalnum() else [*out, (" ", COST_DROP if separates else COST_SIGN)]


def decode(token: str, lm: dict, width: int = 24, piece: int = 48) -> str:
    """The most likely words behind a token, joined by blanks. States are the last three letters; at most `width` of them live at a
    position, and after every `piece` characters only the best, so that work stays linear."""
    start = "^" * (lm["order"] - 1)
    memo = lm.setdefault("memo", {})
    if len(memo) > 500_000:
        memo.clear()

    def log_p(state: str, letter: str) -> float:
        got = memo.get(state + letter)
        if got is None:
            got = memo[state + letter] = log_letter(lm, state, letter)
        return got

    states: dict[str, tuple[float, str]] = {start: (0.0, "")}
    done = []
    for i, ch in enumerate(token):
        if i and i % piece == 0:
            state, (_, text) = max(states.items(), key=lambda kv: (kv[1][0], kv[0]))
            done.append(text)
            states = {state: (0.0, "")}
        read = options(token[i - 1] if i else None, ch, token[i + 1] if i + 1 < len(token) else None, token[i - 2] if i > 1 else None)
        nxt: dict[str, tuple[float, str]] = {}
        for state, (score, text) in states.items():
            for letter, cost in read:
                if letter == " ":
                    ends = log_p(state, "$") if state != start else 0.0
                    s2, sc, tx = start, score - cost + ends, text + " "
                elif letter:
                    s2, sc, tx = (state + letter)[1:], score - cost + log_p(state, letter), text + letter
                else:
                    s2, sc, tx = state, score - cost, text
                if s2 not in nxt or nxt[s2][0] < sc:
                    nxt[s2] = (sc, tx)
        states = dict(sorted(nxt.items(), key=lambda kv: (-kv[1][0], kv[0]))[:width]) if len(nxt) > width else nxt
    best = max(((sc + (log_p(st, "$") if st != start else 0.0), tx) for st, (sc, tx) in states.items()), key=lambda x: (x[0], x[1]))[1]
    return " ".join("".join([*done, best]).split())


def restore(token: str, lm: dict) -> str:
    """The words of a lower-case token or of a run of spaced-out letters, joined by blanks."""
    core = token.strip(EDGE)
    if PLAIN.match(core) and not REPEAT.search(core):
        return core
    if not any(c.isalpha() for c in core) and not any(c in LOOKALIKE for c in core):
        return ""
    return decode(core, lm)


def features(word: str) -> list[str]:
    """The word and its prefixes of four to six letters (stems of inflected words)."""
    return [f"{word}$", *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


def fit(df: DataFrame, text: str, label: str, bound: int = 8000, max_features: int = 20_000, max_grams: int = 2_000_000, least: int = 12, ratio: float = 12.0, corpus: DataFrame | None = None) -> dict:
    """Learn weights from at most about `bound` distinct texts of each label (0 or 1), the language model from every text of `corpus`
    (a table with the column named by `text`; without it, of `df`).

    A feature counts by the number of different words before it, so that copies of one document count once. Kept are at most
    `max_features` features with `least` contexts in toxic texts and a rate `ratio` times that in clean ones. The language model is the
    corpus' n-gram counts, whose number depends on the alphabets in it, not on its size; beyond `max_grams`, which alphabetic scripts do
    not reach, the rarest are left to shorter histories. The intercept and slope are fitted on the same bounded sample."""
    spark = df.sparkSession
    sample = materialise(training_sample(df, label, text, bound), "toxic_sample")
    words = sample.select(F.col("label").cast("int").alias("y"), F.array_compact(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w"))
    words = words.select("y", F.filter("w", lambda x: x != "").alias("w"))
    n = {r["y"]: r["n"] for r in words.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    empty = {"lm": letters_lm({}), "weights": {}, "a": 0.0, "b": -40.0}
    if not n.get(0) or not n.get(1):
        return empty
    pairs = words.select("y", F.explode(F.arrays_zip(F.col("w").alias("w"), F.concat(F.array(F.lit("")), F.col("w")).alias("p"))).alias("z")).select("y", F.col("z.w").alias("w"), F.col("z.p").alias("p")).filter("w is not null")
    # a word's features all begin with its first letters: dealt by context and these, pairs and features are counted in place,
    # and only sums per feature are shuffled again
    pairs = pairs.withColumn("head", F.substring("w", 1, 4)).repartition("p", "head").groupBy("p", "head", "w", "y").agg(F.count(F.lit(1)).alias("n"))
    f = F.array_distinct(F.array_compact(F.array(F.concat("w", F.lit("$")), *[F.when(F.length("w") >= k, F.substring("w", 1, k)) for k in (4, 5, 6)])))
    spread = pairs.select("y", "p", "head", "n", F.explode(f).alias("f")).groupBy("p", "head", "f").agg(F.max("y").alias("toxic"), F.max(1 - F.col("y")).alias("clean"), F.sum("n").alias("n"))
    share = n[1] / n[0]
    counted = materialise(spread.groupBy("f").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"), F.sum("n").alias("n")), "toxic_features")
    rated = counted.filter((F.col("t") >= least) & (F.col("t") > ratio * share * (F.col("c") + 0.5))).withColumn("w", F.log((F.col("t") + 0.5) / (share * (F.col("c") + 0.5))))
    weights = {r["f"]: r["w"] for r in rated.orderBy(F.desc("w"), "f").limit(max_features).collect()}
    found = corpus_grams(df if corpus is None else corpus, text).orderBy(F.desc("n"), "gram").limit(max_grams).toPandas()
    grams = Counter(dict(zip(found["gram"], found["n"].tolist())))
    # the feature with the closing sign is the whole word; listed words weigh as if they were 50 times more in the sample
    drawn = counted.filter(F.col("f").endswith("$")).agg(F.sum("n")).first()[0]
    if not drawn:  # texts without a letter teach nothing
        return empty
    more = 50 * max(1.0, sum(k for g, k in grams.items() if g.endswith("$")) / drawn)
    grams.update(word_grams({w[:-1]: more for w in weights if w.endswith("$") and len(w) > 3}))
    model = {"lm": grams_lm(grams), "weights": weights, "a": 1.0, "b": 0.0}
    if not weights:  # too few labelled texts to weigh any word: all get the share of toxic ones
        share = min(0.99, max(0.01, n[1] / (n[0] + n[1])))
        return model | {"a": 0.0, "b": math.log(share / (1 - share))}
    score = evidence(spark.sparkContext.broadcast(model))
    seen = sample.select("label", score(F.col("text")).alias("s")).groupBy(F.round("s", 1).alias("s"), "label").agg(F.count(F.lit(1)).alias("n")).toPandas()
    x, y, wt = seen["s"].to_numpy(float), seen["label"].to_numpy(float), seen["n"].to_numpy(float)
    wt = wt / np.where(y > 0, wt[y > 0].sum(), wt[y == 0].sum()) * wt.sum() / 2
    a, b = 0.5, -1.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([(wt * (y - p) * x).sum() - 0.1 * a, (wt * (y - p)).sum() - 0.1 * b])
        h = wt * p * (1 - p)
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step = np.clip(np.linalg.solve(hess, g), -2, 2)
        a, b = a + step[0], b + step[1]
    return model | {"a": float(a), "b": float(b)}


class Evidence(dict):
    """Weight of a raw token or of a run of spaced-out letters, decoded once; cleared when it holds `most` tokens."""

    def __init__(self, model: dict):
        super().__init__()
        self.lm, self.weights = model["lm"], model["weights"]
        self.stems = {REPEAT.sub(r"\1", f.rstrip("$")) for f in self.weights}
        self.lengths = sorted({len(x) for x in self.stems})
        self.heads = {x[:self.lengths[0]] for x in self.stems} if self.stems else set()
        # a word with a weight begins with one of these letters
        said = {f.rstrip("$") for f in self.weights}
        self.least = min(map(len, said), default=0)
        self.first = {x[:self.least] for x in said}
        self.begun = {x[:i] for x in self.first for i in range(self.least)}

    def weightless(self, core: str) -> bool:
        """No reading of a token of letters has a feature: readings differ in repeated letters only, features are their first letters."""
        core = REPEAT.sub(r"\1", core)
        if not self.lengths or core[:self.lengths[0]] not in self.heads:
            return True
        return not any(core[:n] in self.stems for n in self.lengths)

    def hopeless(self, token: str, core: str) -> bool:
        """No path through the token's lattice, and no run of its letters, begins a word like a weighted one: there is nothing to decode."""
        if any(w[:self.least] in self.first for w in WORD.findall(token)):
            return False
        states: set[str | None] = {""}  # the letters of the word begun, or None where these fit no weighted word
        for i, ch in enumerate(core):
            read = options(core[i - 1] if i else None, ch, core[i + 1] if i + 1 < len(core) else None, core[i - 2] if i > 1 else None)
            after: set[str | None] = set()
            for s in states:
                for letter, _ in read:
                    if letter == " ":
                        after.add("")
                    elif not letter or s is None:
                        after.add(s)
                    elif s + letter in self.first:
                        return False
                    else:
                        after.add(s + letter if s + letter in self.begun else None)
            states = after
        return True

    def __missing__(self, token: str) -> float:
        core = token.strip(EDGE)
        if (self.weightless(core) if PLAIN.match(core) else self.hopeless(token, core)):
            self[token] = 0.0
            return 0.0
        readings = {frozenset(restore(token, self.lm).split()), frozenset(WORD.findall(token))}
        self[token] = w = max(sum(max(self.weights.get(f, 0.0) for f in features(word)) for word in words) for words in readings)
        return w


def evidence(shared, most: int = 250_000):
    """Summed weights of a text: of its distinct tokens and of its distinct runs of spaced-out letters. `shared` is a broadcast model (bounded by fit)."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = shared.value
        known = Evidence(model)
        for texts in batches:
            out = []
            for t in texts:
                if len(known) > most:
                    known = Evidence(model)
                if not t:
                    out.append(0.0)
                    continue
                t = t.lower()
                s = sum(map(known.__getitem__, set(t.split())))
                s += sum(map(known.__getitem__, {" ".join(m.group().split()) for m in SPACED.finditer(t)}))
                out.append(s)
            yield pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")


def score(text: Column, model: dict, spark) -> Column:
    """Probability of label 1, from 0 to 1."""
    e = evidence(spark.sparkContext.broadcast(model))(text)
    return 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), e * model["a"] + F.lit(model["b"])))))


def restored_text(text: Column, model: dict, spark) -> Column:
    """The whole text with every token restored, tokens joined by one blank; null stays null."""
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lm = shared.value["lm"]
        for texts in batches:
            out = []
            for t in texts:
                if t is None:
                    out.append(None)
                    continue
                t, at, parts = t.lower(), 0, []
                for m in SPACED.finditer(t):
                    parts += [*t[at:m.start()].split(), " ".join(m.group().split())]
                    at = m.end()
                out.append(" ".join(x for x in (restore(w, lm) for w in [*parts, *t[at:].split()]) if x))
            yield pd.Series(out, dtype="object")

    return F.pandas_udf(run, "string")(text)
