"""SentencePiece against the library, the prefix trie and hard negatives against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from maskwright.llm import hard_negatives, pieces, prefix_trie, queries

PATH = queries.vocabulary("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    sentencepiece = pytest.importorskip("sentencepiece")
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def texts() -> list[str]:
    draw = random.Random(5)
    letters = "ab c\n\t ▁éü漢字😀0123...<s>the   in\x00\r  "
    found = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 60))) for _ in range(1500)]
    found += ["".join(draw.choice("abcdehinorst") for _ in range(draw.randint(40, 300))) for _ in range(60)]
    return found + ["", " ", "   ", "a", "=" * 500, "the" * 300, "▁" * 40, " leading", "trailing  ", "<0x41></s>"]


def test_ids_and_texts_are_the_librarys(library):
    encoder = pieces.Encoder(PATH)
    for text, ids in zip(texts(), encoder.encode(texts())):
        wanted = library.encode(text, add_bos=True, add_eos=True)
        assert np.frombuffer(ids, "<u4").tolist() == wanted, text
        assert encoder.model.decode(np.frombuffer(ids, "<u4")) == library.decode(wanted), text


def test_any_ids_are_decoded_as_the_library_does(library):
    draw, known = random.Random(6), pieces.model(PATH)
    for _ in range(1500):
        ids = [draw.choice([draw.randint(0, 31999), draw.randint(3, 258), draw.randint(130, 258)]) for _ in range(draw.randint(0, 12))]
        assert known.decode(np.array(ids, "<u4")) == library.decode(ids), ids


def test_cuts_and_a_full_table_change_nothing(library, monkeypatch):
    long = " ".join(texts())
    wanted = pieces.Encoder(PATH).encode([long])
    for name, value in (("GROUP", 200), ("MEMORY", 50), ("LONG", 3)):
        monkeypatch.setattr(pieces, name, value)
        assert pieces.Encoder(PATH).encode([long]) == wanted
    assert np.frombuffer(wanted[0], "<u4").tolist() == library.encode(long, add_bos=True, add_eos=True)


def test_query_of_odd_rows(spark, library, tmp_path):
    rows = [(2**53 + 1, "the cat"), (None, None), (3, ""), (3, ""), (4, "x " * 5000), (5, "é\nß 漢")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, ids string, end int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_sentencepiece(spark, str(tmp_path)).collect()
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        packed = np.array(ids, "<u4").tobytes()
        want.append((i, len(ids), hashlib.sha256(packed).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert pieces.encode(docs.limit(0), PATH).count() == 0


def brute_trie(rows: list[tuple]) -> list[tuple]:
    conversations = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            conversations[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in conversations.items()}
    built = {}
    for c, seq in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own.get(c - int(math.fmod(c, 5)), [])[:h] + seq[h:])
    members, below = defaultdict(list), defaultdict(list)
    for c, seq in built.items():
        for d in range(len(seq) + 1):
            members[seq[:d]].append(c)
    for node in members:
        if node:
            below[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[k] for k in below[node]) or 1
        bytes_of = len(node[-1][1].encode()) if node else 0
        saved[node] = sum(saved[k] for k in below[node]) + (len(members[node]) - 1) * bytes_of
    out = []
    for node, own_members in members.items():
        ended = ",".join(str(c) for c in sorted(own_members) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(own_members), len(node), parent, len(own_members), len(below[node]), leaves[node], saved[node], hashlib.sha256(ended.encode()).hexdigest()))
    return sorted(out)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_of_odd_conversations(spark, seed):
    draw = random.Random(seed)
    rows = []
    for conv in [*range(-12, 40), 10**6, 2**63 - 1, -(2**63)]:
        for turn in draw.sample([None, *range(12)], draw.randint(1, 10)):
            rows.append((conv, turn, draw.choice(["user", None]), draw.choice(["x", "yé", "", None])))
    rows.append((None, 1, "user", "of no conversation"))
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn int, role string, text string, digest string, depth int")
    got = prefix_trie.rebuilt_trie(table.repartition(3)).select(*TRIE).collect()
    assert sorted(map(tuple, got)) == brute_trie(rows)


def test_trie_of_no_or_one_long_conversation(spark):
    ddl = "conv_id long, turn int, role string, text string"
    assert prefix_trie.rebuilt_trie(spark.createDataFrame([], ddl)).count() == 0
    rows = [(5, t, "user", f"t{t}") for t in range(700)] + [(6, t, "user", f"t{t}") for t in range(650)] + [(6, 650, "user", "other")]
    got = prefix_trie.rebuilt_trie(spark.createDataFrame(rows, ddl)).select(*TRIE).collect()
    assert sorted(map(tuple, got)) == brute_trie(rows)


def test_blocks_of_ends_are_one_hash(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 2)
    rows = [(c, 0, "user", "same") for c in range(-20, 60)]
    got = prefix_trie.conversation_trie(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")).select(*TRIE).collect()
    wanted = hashlib.sha256(",".join(map(str, range(-20, 60))).encode()).hexdigest()
    assert {(r["depth"], r["ends_sha256"]) for r in got} == {(0, prefix_trie.EMPTY_HASH), (1, wanted)}


def brute_negatives(rows: list[tuple]) -> list[tuple]:
    fit = []
    for i, e, label in rows:
        if label is None or e is None or any(x is None or not math.isfinite(x) for x in e):
            continue
        q = [math.floor(256 * float(np.float32(x))) for x in e]
        fit.append((i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, q + [0] * (6 - len(q))))
    out = []
    last = 2**63
    for i, label, q in fit:
        if i is None or i % 50:
            continue
        others = [(-sum(a * b for a, b in zip(q, w)), last if j is None else j, lab) for j, lab, w in fit if j != i]
        near = sorted(o for o in others if o[2] == label)[:5]
        far = sorted(o for o in others if o[2] != label)
        for p in near:
            window = [n for n in far if 50 * -p[0] <= 100 * -n[0] <= 95 * -p[0]][:3]
            out += [(i, None if p[1] == last else p[1], r + 1, None if n[1] == last else n[1], -p[0], -n[0]) for r, n in enumerate(window)]
    return sorted(out, key=repr)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize(("seed", "size", "block"), [(1, 1.0, 4096), (2, 3e4, 3)])
def test_negatives_of_odd_rows(spark, seed, size, block):
    draw = random.Random(seed)
    rows = [(i, [draw.choice([-1, 0, 1, 2]) * size / 4 for _ in range(draw.choice([5, 6, 6]))], draw.randint(0, 2)) for i in range(420)]
    rows += [(None, [size] * 6, 1), (1000, None, 1), (1050, [size, None], 2), (1100, [float("nan")] * 6, 2), (1150, [float("inf")] * 6, 2)]
    rows += [(1200, [size] * 6, None), (1250, [], 1), (1300, [3e38] * 6, 1)]
    table = spark.createDataFrame([(*r, b"x", 0) for r in rows], "vec_id long, embedding array<float>, label int, codes binary, rank int")
    got = hard_negatives.hard_negatives(hard_negatives.relabelled(table.repartition(4)), block=block).select(*NEGATIVES).collect()
    assert sorted(map(tuple, got), key=repr) == brute_negatives([r for r in rows if r[0] != 1300])
    assert got


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert hard_negatives.hard_negatives(hard_negatives.relabelled(empty)).count() == 0
