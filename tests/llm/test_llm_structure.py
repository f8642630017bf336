"""Conversation repair, Merkle manifests and token files against plain versions and on edge cases."""
import glob
import hashlib
import json
import os
import random
import sys
import zlib

import numpy as np
import pytest

from adjudica.llm import conversations, merkle, rangecoder, tokenfiles

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

REPORT = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def code(role, fault):
    return max(" sua".find(role[:1] or " "), 0) | {"blank": 4, "duplicate": 4, "truncated": 8}.get(fault, 0)


def some_rows(rnd, n):
    return [(rnd.choice(["system", "user", "assistant", "tool", "user", "assistant", ""]), rnd.choice(["a.", "b", "c!", "", f"{rnd.random()}."])) for _ in range(n)]


def test_search_finds_the_cheapest_and_least_audit():
    rnd = random.Random(5)
    for _ in range(1500):
        rows = some_rows(rnd, rnd.randint(0, 9))
        codes = bytes(code(r, f) for (r, _), f in zip(rows, brute.faults(rows)))
        assert conversations.cheapest(codes, 0, conversations.COMPLETE) == brute.repair(rows)[:2], rows


@pytest.mark.parametrize("block_rows", [2, 512])
def test_repair(spark, block_rows):
    rnd = random.Random(block_rows)
    convs = {str(i): [(t, *r) for t, r in enumerate(some_rows(rnd, rnd.randint(1, 12)))] for i in range(40)}
    convs["nulls"] = [(None, " ", "hi."), (1, "user", " "), (4, "assistant", "so."), (2**62, "user", "yes")]  # null role and text are one space
    convs["long"] = [(i, ("user", "assistant")[i % 2], f"{i}.") for i in range(700)] + [(700, "assistant", "x" * 200_000)]
    convs["all null turns"] = [(None, "assistant", "b."), (None, "user", "a.")]
    convs["same"] = [(3, "user", "again.")] * 30
    convs[None] = [(0, "user", "a b\n"), (1, "assistant", " ")]  # no ASCII white space: a letter that ends no sentence
    rows = []
    for k, v in convs.items():
        for t, r, x in v:
            rows.append((k, t, None if r == " " else r, None if x == " " else x, False, "own"))
    rows += [("gone", 1, "user", "x.", True, "own"), ("same", 1, "user", "again.", True, "own")]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "c string, turn long, role string, text string, gone boolean, digest string")
    got = {r["c"]: r for r in conversations.repair(df, "c", "turn", "role", "text", "gone", block_rows=block_rows).collect()}
    assert set(got) == {*convs, "gone"}
    assert tuple(got["gone"][c] for c in REPORT) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    for k, v in convs.items():
        v = sorted(v, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        assert tuple(got[k][c] for c in REPORT) == brute.report(v), k
    kept = {}
    for r in conversations.repair(df, "c", "turn", "role", "text", "gone", keep_rows=True, block_rows=block_rows).collect():
        kept.setdefault(r["c"], []).append((r["place"], r["edit"], f"{r['role']}:{r['text']}"))
    for k, r in got.items():
        mine = sorted(kept.get(k, []))
        assert hashlib.sha256("\n".join(x for _, _, x in mine).encode()).hexdigest() == r["repaired_sha256"] and len(mine) == r["n_repaired"]
        assert "".join(e for _, e, _ in mine) == r["audit"].replace("D", "")
    assert conversations.repair(df.limit(0), "c", "turn", "role", "text", "gone").count() == 0


def tree(nodes):
    """Root and, for every leaf, its siblings level by level."""
    proofs, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, a in enumerate(at):
            run, off = nodes[a // 8 * 8:a // 8 * 8 + 8], a % 8
            proofs[i].append("".join(run[:off] + run[off + 1:]))
        nodes, at = [hashlib.sha256("".join(nodes[i:i + 8]).encode()).hexdigest() for i in range(0, len(nodes), 8)], [a // 8 for a in at]
    return nodes[0], proofs


@pytest.mark.parametrize("sizes", [{"a": 1}, {"a": 8, None: 1}, {"a": 513, "b": 9, "é": 64, "z": 1, None: 3}, {"a": 1100, "b": 512, **{f"g{i}": 2 for i in range(70)}}])
def test_merkle(spark, sizes):
    rows = [(None if g is None and i == 0 else i * 7, g, None if i % 5 == 1 else f"{g} é {i}" * (3000 if i == 2 else 1), "x") for g, n in sizes.items() for i in range(n)]
    rows += [r for r in rows[:3]]  # repeated rows
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "key long, g string, text string, leaf string")
    m = merkle.manifest(df, "key", "g", ["key", "g", "text"], clash=df["leaf"], tampered=merkle.leaf([df["text"]]))
    m = m.select("*", merkle.folded(m["leaf"], m["proof"]).alias("same"), merkle.folded(m["tampered"], m["proof"]).alias("other"), merkle.proof_text(m["proof"]).alias("siblings"))
    got = m.collect()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaves = {}
    for k, g, t, _ in rows:
        leaves.setdefault(g, []).append((k is not None, k or 0, hashlib.sha256((field(k) + field(g) + field(t)).encode()).hexdigest(), k))
    order = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: tree([x[2] for x in sorted(leaves[g])]) for g in order}
    root, above = tree([trees[g][0] for g in order])
    want = []
    for g, up in zip(order, above):
        for x, p in zip(sorted(leaves[g]), trees[g][1]):
            want.append((str(x[3]), x[2], trees[g][0], root, "".join(p + up)))
    assert sorted((str(r["key"]), r["leaf"], r["subroot"], r["root"], r["siblings"]) for r in got) == sorted(want)
    assert all(r["same"] == r["root"] and r["other"] != r["root"] and r["clash"] == "x" for r in got)


def test_merkle_of_nothing(spark):
    df = spark.createDataFrame([], "key long, g string, text string")
    assert merkle.manifest(df, "key", "g", ["text"]).count() == 0


def test_range_coder():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 99, 2048, 2049, 9000):
        for ids in (rng.integers(0, 2**32, n, dtype=np.uint64), np.zeros(n), rng.zipf(1.3, n) % 50_000, np.arange(n) % 7):
            ids = ids.astype("<u4")
            table, body = rangecoder.pack_ids(ids, block=500 if n < 3000 else 2048, lanes=3)
            assert (rangecoder.unpack_ids(table, body, lanes=2) == ids).all()
    ids = (np.arange(20_000) % 97).astype("<u4")
    table, body = rangecoder.pack_ids(ids)
    assert len(body) < 0.4 * len(ids)  # order 1 and 2 predict the cycle; 6.6 bits an id without them
    for at in (0, len(body) // 2, len(body) - 1):
        with pytest.raises(ValueError, match="damaged"):
            rangecoder.unpack_ids(table, body[:at] + bytes([body[at] ^ 1]) + body[at + 1:])
    with pytest.raises(ValueError):
        rangecoder.unpack_ids(table, body[:-1])
    with pytest.raises(ValueError):
        rangecoder.pack_ids(ids, block=4096)
    values = np.array([0, 1, 127, 128, 16_383, 16_384, 2**32 - 1])
    assert (rangecoder.numbers(rangecoder.varints(values), len(values)) == values).all()


def test_range_coder_finds_an_id_without_looking_through_the_predictions():
    """Every id takes the largest of its shares, and the encoder, which looks no id up, makes no table of slots."""
    rng = np.random.default_rng(5)
    blocks = [np.arange(n) % d if n % 2 else rng.integers(0, d, n) for n, d in ((2047, 3), (2047, 2048), (700, 1), (33, 30), (1, 1), (0, 1), (2048, 2048))]
    sizes, made = [3, 2048, 1, 30, 1, 1, 2048], []
    before = rangecoder.Mixer.__init__
    try:
        rangecoder.Mixer.__init__ = lambda m, *a: (before(m, *a), made.append(m.slot is not None))[0]
        codes = rangecoder.encode(blocks, sizes)
        got = rangecoder.decode(codes, sizes, [len(b) for b in blocks])
    finally:
        rangecoder.Mixer.__init__ = before
    assert made == [False, True] and all((a == b).all() for a, b in zip(got, blocks))
    assert len(codes[0]) < 200 and len(codes[2]) < 60  # all but certain ids cost next to nothing


def test_remembered_ids_are_those_a_decoder_learns():
    """The encoder sorts places by context; a table that goes id by id holds the same."""
    rng = np.random.default_rng(6)
    ids, contexts = rng.integers(0, 3, (5, 400)).astype(np.uint16), rng.integers(0, 9, (5, 400)).astype(np.uint16)
    got = rangecoder.remembered(ids, contexts, rangecoder.STEP2)
    for lane in range(5):
        table = {}
        for s, c, e in zip(ids[lane].tolist(), contexts[lane].tolist(), got[lane].tolist()):
            p, sure = table.get(c, (0, 0))
            assert e == p + sure * rangecoder.STEP2
            table[c] = (s, min(3, sure + 1) if s == p else 1)
    assert rangecoder.remembered(ids[:, :1], contexts[:, :1], 1).tolist() == [[0]] * 5


@pytest.fixture(scope="module")
def vocabulary():
    P = pytest.importorskip("public_tokenizers")
    with open(P.path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


ODD = [None, "", " ", "a\n b", "0 0 00 a0", "<|endoftext|> x<|startoftext|>y", "é é ́x", "don't I'LL 'S", "ΑΣ ΟΔΟΣ Σ", "İstanbul", "a b\x1cc\x85d", "日本語", "😀👍🏽", "\t\r\n", "x" * 5000, "1234567890", "\x00\x01", "½ ²"]


def test_words_equal_whole_texts(vocabulary):
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_str(vocabulary), tokenfiles.Words(vocabulary, most=5)
    rnd = random.Random(2)
    texts = [t or "" for t in ODD] + ["".join(rnd.choice("aB0'.,é ß\n\t!s日́") for _ in range(rnd.randint(0, 60))) for _ in range(300)]
    for some in (texts, texts[:3], [], [""]):
        ids, sizes = words.encode(some, 1)
        want = [whole.encode(t, add_special_tokens=False).ids + [1] for t in some]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]


def test_token_files(spark, vocabulary, tmp_path):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(vocabulary)
    rows = [(i * 3, t, "x") for i, t in enumerate(ODD)] + [(None, "no key", "x"), (-5, "first " * 30_000, "x")] + [(7, "again and again", "x")] * 50
    df = spark.createDataFrame(rows, "doc_id long, text string, start string").repartition(3)
    manifest = tokenfiles.write(df, "doc_id", "text", vocabulary, 1, folder=f"file://{tmp_path}/ids", segment_ids=40, file_segments=3)
    got = tokenfiles.read(manifest, keep=True).orderBy("start").collect()
    assert [(r["key"] is not None, r["key"] or 0) for r in got] == sorted((k is not None, k or 0) for k, _, _ in rows)
    text, at = {(k, t or "") for k, t, _ in rows}, 0
    by_key = {k: whole.encode(t, add_special_tokens=False).ids + [1] for k, t in text}
    for r in got:
        ids = by_key[r["key"]]
        assert (r["start"], r["n_tokens"], r["ids"]) == (at, len(ids), ids) and r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    rounded = tokenfiles.round_trip(df.withColumn("doc_id", df["doc_id"].cast("string")), "doc_id", "text", vocabulary, 1)
    assert rounded.schema["doc_id"].dataType.simpleString() == "string" and rounded.count() == len(rows)
    assert tokenfiles.round_trip(df.limit(0), "doc_id", "text", vocabulary, 1).count() == 0
    for file in glob.glob(f"{tmp_path}/ids/*.ids"):
        raw = bytearray(open(file, "rb").read())
        raw[-1] ^= 1
        open(file, "wb").write(raw)
    with pytest.raises(Exception, match="damaged"):
        tokenfiles.read(manifest).count()


def test_another_fence(vocabulary):
    """A vocabulary whose fence is not one id: every word is encoded by itself."""
    other = json.loads(vocabulary)
    words = tokenfiles.Words(json.dumps(other))
    words.fence = [1, 2]
    ids, _ = words.encode(["a b0 c", "a"], 1)
    assert ids.tolist() == tokenfiles.Words(vocabulary).encode(["a b0 c", "a"], 1)[0].tolist()


def test_words_go_to_the_library_once_in_short_texts(vocabulary):
    words, sent = tokenfiles.Words(vocabulary, most=100_000), []
    library = words.library
    words.library = lambda texts: (sent.extend(texts), library(texts))[1]
    names = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{'0' if i % 9 == 0 else ''}" for i in range(500)]
    first, n = words.encode([" ".join(names), "", " ".join(reversed(names))], 1)
    again, m = words.encode([" ".join(names), "new"], 1)
    got = [w for t in sent for w in t.split(f" {tokenfiles.FENCE} ")]
    assert sorted(got) == sorted({*names, "", "new"}) and max(t.count(f" {tokenfiles.FENCE} ") for t in sent) < tokenfiles.TOGETHER
    assert len(sent) > 500 // tokenfiles.TOGETHER and again[:m[0]].tolist() == first[:n[0]].tolist() and n[1] == 1


def test_pieces_equal_whole_texts_and_go_to_the_library_once(vocabulary):
    from tokenizers import Tokenizer

    whole, pieces, sent = Tokenizer.from_str(vocabulary), tokenfiles.Pieces(vocabulary, most=300), []
    library = pieces.library
    pieces.library = lambda texts: (sent.extend(texts), library(texts))[1]
    rnd = random.Random(3)
    signs = "aB09'.,|<> é ÉßÿÞ×÷ªº²½\n\t\x00\xa0!ş日́İΣ"
    texts = [t or "" for t in ODD] + ["\n", " a", "a ", "É\u0301", "e\u0301", "a</w>b", "x'll", "!!??", "a|b"] + ["".join(rnd.choice(signs[:rnd.choice((11, 24, 60))]) for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    for some in (texts, texts[:3], [], [""], ["", ""], texts[::-1]):
        ids, sizes = pieces.encode(some, 1)
        want = [whole.encode(t, add_special_tokens=False).ids + [1] for t in some]
        assert ids.tolist() == [i for w in want for i in w] and sizes.tolist() == [len(w) for w in want]
    pieces.clear()
    sent.clear()
    pieces.encode(["Über, über! ÜBER7 (uber)", "uber; 7", "ÜBER."], 1)
    assert sorted(" ".join(sent).split()) == sorted(["über", ",", "!", "7", "(", "uber", ")", ";", "."])


def test_other_tokenizers_keep_their_words(vocabulary):
    assert tokenfiles.Pieces.fits(vocabulary)
    for part, value in (("normalizer", None), ("pre_tokenizer", {"type": "Whitespace"}), ("added_tokens", [{"content": "re"}])):
        assert not tokenfiles.Pieces.fits(json.dumps(json.loads(vocabulary) | {part: value}))
    other = json.dumps(json.loads(vocabulary) | {"normalizer": {"type": "Lowercase"}})
    assert type(tokenfiles.words_of(other)) is tokenfiles.Words and type(tokenfiles.words_of(vocabulary)) is tokenfiles.Pieces
    assert tokenfiles.words_of(vocabulary) is tokenfiles.words_of(vocabulary)  # the next task of the worker finds its words
