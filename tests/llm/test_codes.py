"""Conversation tries, SentencePiece codes and vector codes against brute force and the library."""

import hashlib
import math
import random
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strataloom.llm import piececodec, prefixtrie, vectorcode
from strataloom.llm.fasttok import public_file

MODEL = "piece_bpe_32k.model"


# --- conversation tries --------------------------------------------------------------------------------------


def brute_trie(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    paths = {c: tuple(own.get(c - c % 100, [])[: zlib.crc32(str(c).encode()) % 6]) + tuple(v[zlib.crc32(str(c).encode()) % 6 :]) for c, v in own.items()}
    members, kids = defaultdict(list), defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved, out = {}, {}, []
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
        ends = ",".join(str(c) for c in sorted(members[p]) if len(paths[c]) == len(p))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed=5, n=400):
    r = random.Random(seed)
    rows = []
    for c in r.sample(range(700), n):
        hot = c % 3 == 0
        for turn in range(r.randrange(1, 9)):
            rows.append((c, turn, "user" if turn % 2 == 0 else "assistant", f"common {turn}" if hot else r.choice(["a", "ab", f"own {c}", "été 🙂"])))
    rows += [(7, None, "user", "first"), (7, None, None, "x"), (7, 3, "user", None), (None, 1, "user", "lost"), (8, 1, "user", "twice"), (8, 1, "user", "twice"), (8, 1, "assistant", "twice")]
    rows += [(650, turn, "user", "long") for turn in range(60)]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string, path string, own long, depth string"


@pytest.mark.parametrize("shard_turns", [9, 50_000])
def test_trie(spark, shard_turns):
    rows = talks()
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)
    got = prefixtrie.conversation_trie(df, shard_turns=shard_turns)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_trie(rows)


def test_trie_of_nothing(spark):
    assert prefixtrie.conversation_trie(spark.createDataFrame([], SCHEMA)).isEmpty()
    only = spark.createDataFrame([(None, 1, "user", "x", "", 1, "")], SCHEMA)
    assert prefixtrie.conversation_trie(only).isEmpty()
    # a conversation that loses its own turns and gets none: it is a member of the root
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 5)
    bare = prefixtrie.conversation_trie(spark.createDataFrame([(c, 0, "user", "x", "", 1, "")], SCHEMA)).collect()
    assert [tuple(r) for r in bare] == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_trie_ends_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "CHUNK_IDS", 7)
    rows = [(c, 0, "user", "same") for c in range(1000, 1090)]
    df = spark.createDataFrame([(*r, "", 1, "") for r in rows], SCHEMA)
    assert sorted((tuple(x) for x in prefixtrie.conversation_trie(df).collect()), key=str) == brute_trie(rows)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.lists(st.integers(0, 6), max_size=5).map(tuple), min_size=1, max_size=40))
def test_double_array(paths):
    paths = sorted(paths)
    trie = prefixtrie.DoubleArray([np.array(p, np.int64) for p in paths])
    known = {p[:d] for p in paths for d in range(len(p) + 1)}
    assert int((trie.check >= 0).sum()) == len(known)
    for p in known:
        node = np.zeros(1, np.int64)
        for turn in p:
            node = trie.child(node, np.array([turn]))
            assert node[0] > 0
        for turn in range(8):
            assert (trie.child(node, np.array([turn]))[0] > 0) == ((*p, turn) in known)


# --- sentencepiece -------------------------------------------------------------------------------------------


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def with_rules(rule, prefix, squeeze):
    """The public pieces with one of the library's own compiled character maps."""
    with open(public_file(MODEL), "rb") as f:
        content = f.read()
    if rule is None:
        return content
    own = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    spec = next(v for f, v, _ in piececodec._message(own) if f == 3)
    compiled = next(v for f, v, _ in piececodec._message(spec) if f == 2)
    made = b"\x0a\x01x\x12" + varint(len(compiled)) + compiled + bytes([24, prefix, 32, squeeze, 40, 1])
    return b"".join(raw for f, _, raw in piececodec._message(content) if f != 3) + b"\x1a" + varint(len(made)) + made


ODD = ["", " ", "  a  b ", "▁x▁ ▁", "a\0b", "<s> </s> <0x0A>\n\t x", "日本語テスト", "😀😀 x😀", "ｶﾞ ﬁ  x é é ﷺ 　 Å ½", "a" * 300, "  ​ x̀́"]


@pytest.mark.parametrize(("rule", "prefix", "squeeze"), [(None, 1, 0), ("nmt_nfkc", 1, 1), ("nfkc_cf", 0, 1), ("nmt_nfkc", 0, 0)])
def test_pieces_and_their_places(rule, prefix, squeeze):
    content = with_rules(rule, prefix, squeeze)
    own, library = piececodec.PieceModel(content), sentencepiece.SentencePieceProcessor(model_proto=content)
    r = random.Random(3)
    letters = "ab é  　\t\nﬁｶﾞ½ﷺ①😀日éÅⅣ ​ŉﾊﾟ가각각▁"
    for text in [*ODD, *("".join(r.choice(letters) for _ in range(r.randrange(30))) for _ in range(400))]:
        ids, begins, ends = own.encode(text)
        assert ids.tolist() == library.encode(text), text
        told = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces]
        assert list(zip(begins.tolist(), ends.tolist(), strict=True)) == told, text


def test_codec(spark, messy, messy_rows, empty):
    library = sentencepiece.SentencePieceProcessor(model_file=public_file(MODEL))
    got = piececodec.decode_ids(piececodec.encode_texts(messy, MODEL, carry=("doc_id", "spans", "key")), MODEL).collect()
    want = [(i, library.encode(t or "")) for i, t in messy_rows]
    assert sorted(((r.doc_id, r.ids) for r in got), key=str) == sorted(want, key=str)
    texts = {i: t or "" for i, t in messy_rows}
    for r in got:
        assert r.decoded == library.decode(r.ids) if r.ids else r.decoded == ""
        assert (r.spans, r.key) == ("s", "k")
        if r.doc_id is not None and r.ids:  # the pieces tile the text
            assert r.begins[0] == 0 and r.ends[-1] == len(texts[r.doc_id].encode()) and r.begins[1:] == r.ends[:-1]
    assert piececodec.decode_ids(piececodec.encode_texts(empty, MODEL), MODEL).isEmpty()


# --- vector codes --------------------------------------------------------------------------------------------


def brute_codes(rows, parts=8, entries=16, rounds=6):
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [[math.floor(Fraction(x) * 4096) for x in v] for _, v, _ in kept]
    w = len(whole[0]) // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for v in whole]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(p, v):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(parts):
            own = defaultdict(list)
            for v in cut:
                own[nearest(p, v[p])[1]].append(v[p])
            for k, some in own.items():
                books[p][k] = [sum(x) // len(some) for x in zip(*some, strict=True)]
    found = [[nearest(p, v[p]) for p in range(parts)] for v in cut]
    sums = defaultdict(int)
    for (_, _, label), f in zip(kept, found, strict=True):
        sums[label] += sum(d for d, _ in f)
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()

    def long(x):
        return x if x < 1 << 63 else None

    return sorted(((i, "".join(f"{k:02x}" for _, k in f), long(sum(d for d, _ in f)), long(sums[label]), sha) for (i, _, label), f in zip(kept, found, strict=True)), key=str)


VECTORS = "vec_id long, embedding array<double>, label int, code string, error string, id string, v string"


def vectors(spark, rows, kind="double"):
    df = spark.createDataFrame([(*r, "c", "e", "i", "v") for r in rows], VECTORS)
    return df.withColumn("embedding", F.col("embedding").cast(f"array<{kind}>")).repartition(3)


def coded(df):
    return sorted((tuple(r) for r in vectorcode.compress_vectors(df).collect()), key=str)


@pytest.mark.parametrize("size", [8, 24, 64])
def test_vector_codes(spark, size):
    r = random.Random(size)
    rows = [(i, [float(np.float32(r.gauss(0, 1))) for _ in range(size)], r.choice([None, 1, 2])) for i in range(150)]
    rows += [(3, rows[3][1], 1), (200, rows[5][1], 2), (201, rows[5][1], 2), (None, rows[9][1], None)]  # repeated rows, copies, no id
    bad = [(-1, None, 1), (-2, [math.nan] * size, 1), (-3, [math.inf] + [0.0] * (size - 1), 1), (-4, [None] + [0.0] * (size - 1), 1)]
    assert coded(vectors(spark, rows + bad, "float")) == brute_codes(rows)


def test_vector_codes_of_large_numbers(spark):
    r = random.Random(1)
    rows = [(i, [r.gauss(0, 1) * 10 ** r.choice([0, 6, 17]) for _ in range(16)], i % 2) for i in range(40)]
    assert coded(vectors(spark, rows)) == brute_codes(rows)
    rows = [(i, [r.gauss(0, 1) * 10**5 for _ in range(16)], i % 2) for i in range(40)]
    assert coded(vectors(spark, rows)) == brute_codes(rows)


def test_vector_codes_of_few(spark):
    assert coded(vectors(spark, [])) == [] == coded(vectors(spark, [(1, None, 1)]))
    rows = [(5, [0.5] * 8, 1), (2, [1.5] * 8, None)]
    assert coded(vectors(spark, rows)) == brute_codes(rows)
    with pytest.raises(ValueError):
        coded(vectors(spark, [(1, [0.0] * 8, 1), (2, [0.0] * 16, 1)]))
    with pytest.raises(ValueError):
        coded(vectors(spark, [(1, [0.0] * 12, 1)]))


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 4), st.integers(1, 9), st.integers(1, 6), st.randoms(use_true_random=False))
def test_transform_keeps_distances(size, points, entries, r):
    a = np.array([[r.randrange(-50, 50) for _ in range(size)] for _ in range(points)], np.int64)
    b = np.array([[r.randrange(-50, 50) for _ in range(size)] for _ in range(entries)], np.int64)
    index, far = vectorcode.nearest(vectorcode.transformed(a), vectorcode.transformed(b))
    real = ((a[:, None] - b) ** 2).sum(axis=2)
    n = 1 << (size - 1).bit_length()
    assert index.tolist() == real.argmin(axis=1).tolist() and (far == n * real.min(axis=1)).all()
