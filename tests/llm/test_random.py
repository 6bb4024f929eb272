"""Every operator on random small tables with nulls, repeats, ties, long texts and odd columns, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from maskwright.llm import exact_dedup, fingerprints, mixing, near_dedup, packing, queries, secrets, sharding, token_counts, toxicity, warc

P = pytest.importorskip("public_tokenizers")
BIG = 2**53 + 1
WORDS = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("ta", "vi", "xo", "ze", "ble", "nt")]
#: Names that operators use inside, and one that needs quoting.
ODD = "doc_id long, text string, `a.b` string, __sha string, __row string, body string, spans string, `rate` double"


def table(seed: int, n: int = 120) -> list[tuple]:
    draw = random.Random(seed)
    texts = [None, "", " ", "\t\n", "one", "É日本 😀 don't", " ".join(draw.choices(WORDS, k=9000))]
    while len(texts) < n // 2:
        texts.append(" ".join(draw.choices(WORDS, k=draw.randint(1, 90))))
    for _ in range(n // 3):  # near and exact copies
        words = (draw.choice(texts[7:]) or "x").split(" ")
        for _ in range(draw.choice([0, 0, 1, 2, 9])):
            words[draw.randrange(len(words))] = draw.choice(WORDS)
        texts.append(draw.choice([" ", "  ", "\n"]).join(words))
    ids = [BIG + 2 * i for i in range(len(texts))]
    draw.shuffle(ids)
    rows = [(i, t, "x", "mine", "r", "b", "s", 1.5) for i, t in zip(ids, texts)]
    rows += [rows[9], rows[9], (None, "no id", *rows[0][2:]), (None, texts[10], *rows[0][2:]), (rows[12][0], texts[13], *rows[0][2:])]
    draw.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def rows():
    return table(1)


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, ODD).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], ODD)


def pairs_of(rows):
    return sorted((str(r[0]), r[1] or "") for r in rows)


def test_exact_dedup_equals_its_sql(docs, rows, empty):
    con = duckdb.connect()
    documents = pa.table({"doc_id": pa.array([r[0] for r in rows], pa.int64()), "text": [r[1] for r in rows]})  # noqa: F841
    want = sorted(map(str, con.sql("SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM (" + queries.ORACLES["op1_exact_dedup"] + ")").fetchall()))
    got = exact_dedup.exact_dedup(docs)
    assert sorted(str(tuple(r)) for r in got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()) == want
    left = exact_dedup.drop_copies(docs).collect()
    assert docs.columns == list(left[0].asDict()) and {r["__sha"] for r in left} == {"mine"}
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    least = {}
    for r in rows:
        least.setdefault(norm(r[1]), []).append(BIG * 4 if r[0] is None else r[0])
    assert sorted((norm(r["text"]), BIG * 4 if r["doc_id"] is None else r["doc_id"]) for r in left) == sorted((t, min(i)) for t, i in least.items())
    assert exact_dedup.drop_copies(empty).count() == 0 == exact_dedup.exact_dedup(empty).count()


def test_sharding_balances_bytes_and_keeps_copies_together(docs, rows, empty):
    shards = 4
    got = sharding.shard_by_bytes(docs, shards=shards).collect()
    want = sorted((str(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == want
    load = [sum(r.size for r in got if r.shard == k) for k in range(shards)]
    groups = {}
    for r in got:
        groups.setdefault((r.size, r.text_crc32), []).append(r)
    share = sum(load) / shards
    heaviest = max(sum(r.size for r in g) for g in groups.values())
    assert max(load) - share <= max(heaviest, 0.02 * share)
    for g in groups.values():
        assert len({r.shard for r in g}) == 1 or sum(r.size for r in g) > share
    for k in range(shards):
        assert sorted(r.slot for r in got if r.shard == k) == list(range(sum(r.shard == k for r in got)))
    assert sharding.shard_by_bytes(empty, shards=shards).count() == 0


def test_sharding_keeps_even_shards_within_tolerance(spark):
    draw = random.Random(3)
    many = [(i, "".join(draw.choices("abc ", k=draw.randint(0, 400)))) for i in range(6000)]
    got = sharding.shard_by_bytes(spark.createDataFrame(many, "doc_id long, text string"), shards=8).collect()
    load = np.bincount([r.shard for r in got], [r.size for r in got], 8)
    assert np.abs(load - load.mean()).max() <= 0.01 * load.mean()


def test_token_counts_are_the_library_s(docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    want = sorted((str(i), len((t or "").encode()), count(t), count(t) > 1024) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.token_counts(docs, path).collect()) == want
    assert token_counts.token_counts(empty, path).count() == 0


def test_secret_scan_has_the_plain_rules_spans(spark, empty):
    draw = random.Random(4)
    parts = ["password", "Secret: ", "api_key=", 'token": "', "=", ":", "abc123", "AKIA", "ABCDEF0123456789", "deadbeef00112233", "0" * 12, " ", "\n", "é", "-", "Xy9"]
    given = [(i if i else None, "".join(draw.choices(parts, k=draw.randint(0, 40))), "q") for i in range(300)] + [(BIG, None, "q")] + [(BIG + 1, "x " * 60000, "q")]
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)

    def brute(text):
        found = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        names = ("assign", "access", "hex")
        line = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(found))
        return (*[sum(k == j for _, k, _ in found) for j in range(3)], hashlib.sha256(line.encode()).hexdigest(), set(filter(None, line.split(","))))

    frame = spark.createDataFrame(given, "doc_id long, text string, spans string")
    got = {str(r.doc_id): r for r in secrets.secret_scan(frame).collect()}
    assert len(got) == len(given)
    for i, t, _ in given:
        r = got[str(i)]
        *want, base = brute(t or "")
        assert [r.n_assign, r.n_access, r.n_hex, r.base_sha256] == want
        assert base <= set(filter(None, r.spans.split(",")))
        assert [f"{s.split(':')[0]}" for s in filter(None, r.spans.split(","))].count("markov") == len(r.found) - len(base)
    assert secrets.secret_scan(empty).count() == 0


def test_secret_model_on_keys_and_names_it_has_not_seen():
    model = secrets.Markov.trained()
    draw = random.Random(6)
    signs = secrets.LETTERS[:62]
    found = lambda text: any(s[2] == "markov" for s in secrets.all_spans(text, model))
    for size in (12, 18, 24, 40):
        keys = ["".join(draw.choices(signs, k=size)) for _ in range(300)]
        assert np.mean([found(f"the key {k} is old") for k in keys]) > 0.95
        assert np.mean([found(f"https://host.example.org/files/images/{k}") for k in keys]) > 0.95
    slashed = "".join(draw.choices(signs, k=20)) + "/" + "".join(draw.choices(signs, k=15))
    assert [s[:2] for s in secrets.all_spans(f"x {slashed} y", model)] == [(2, 2 + len(slashed))]
    others = "garden window yellow mountain river teacher hospital kitchen orange pencil winter village concert library monkey thunder bicycle weather".split()
    assert np.mean([found(s) for s in secrets.identifier_samples(3000, 21, others)]) < 0.01
    assert not any(found(s) for s in ("getElementsByTagNameNow", "2021-03-04T12:33:44Z", "utf8_general_ci_2020", "x86_64-linux-gnu-gcc-12", "550e8400-e29b-41d4-a716-446655440000"))


def test_toxicity_learns_from_its_folds_only(spark, empty):
    draw = random.Random(8)
    bad = ["you stupid idiot", "shut up moron", "worthless filthy liar"]
    given, marks = [], []
    for i in range(600):
        toxic = i % 3 == 0
        words = draw.choices(WORDS, k=draw.randint(5, 200))
        if toxic:
            words.insert(draw.randrange(len(words)), draw.choice(bad))
        given.append((BIG + i, " ".join(words), "c"))
        # labels of the held-out fold are turned round: a model that used them would fail
        held = zlib.crc32(str(BIG + i).encode()) % 5 == 0
        marks.append((BIG + i, int(toxic != held), 1))
    given += [(None, None, "c"), (BIG + 5000, "", "c"), (BIG + 5001, " ".join(draw.choices(WORDS, k=60000)), "c")]
    docs = spark.createDataFrame(given, "doc_id long, text string, score string")
    labels = spark.createDataFrame([*marks, (None, 1, 1), marks[0]], "doc_id long, toxic int, quality int")
    model = toxicity.train(docs, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(given)
    for i, r in got.items():
        assert r.held_out == (zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    right = [got[BIG + i].predicted == int(i % 3 == 0) for i in range(600) if got[BIG + i].held_out]
    assert len(right) > 80 and np.mean(right) > 0.95
    assert got[None].predicted == 0 and got[BIG + 5000].predicted == 0 and got[BIG + 5001].predicted == 0
    assert toxicity.train(docs, labels.limit(0)) is None and toxicity.train(empty, labels) is None
    left = toxicity.clean(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.predicted}
    assert toxicity.clean(empty, model).count() == 0 == toxicity.score(empty, model).count()
    assert toxicity.train(docs, labels, longest=0) is None


def shingles(text, size):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    n = min(size, len(words))
    return {tuple(words[i : i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute_components(rows, size, percent):
    keyed = list(dict.fromkeys((i, t or "") for i, t, *_ in rows if i is not None))
    sets = [shingles(t, size) for _, t in keyed]
    root = list(range(len(keyed)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(keyed)), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(keyed):
        least[find(k)] = min(least.get(find(k), i), i)
    named = {keyed[k]: least[find(k)] for k in range(len(keyed))}
    return sorted((str(i), len(shingles(t, size)), str(named.get((i, t or "")))) for i, t, *_ in rows)


@pytest.mark.parametrize("size, percent", [(3, 85), (2, 50)])
def test_near_groups_equal_brute_force(docs, rows, empty, size, percent):
    got = near_dedup.near_groups(docs, size=size, percent=percent).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, size, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    left = near_dedup.keep_one(docs, size=size, percent=percent)
    assert left.columns == docs.columns
    # as many documents stay as there are components, rows without an id all stay
    groups = {(r.component_id) for r in got if r.doc_id is not None}
    assert {r["doc_id"] for r in left.collect() if r["doc_id"] is not None} == groups
    assert near_dedup.near_groups(empty, size=size, percent=percent).count() == 0


def test_near_groups_miss_no_pair_near_the_threshold(spark):
    draw = random.Random(12)
    given = []
    for k in range(250):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.randint(40, 80))]
        other = list(words)
        for at in draw.sample(range(3, len(words) - 3), draw.choice([1, 2])):
            other[at] = f"w{draw.randrange(10**6)}"
        given += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    got = near_dedup.near_groups(spark.createDataFrame(given, "doc_id long, text string"), size=3, percent=85).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(given, 3, 85)
    assert 50 < sum(not r.kept for r in got) < 250


def test_fingerprints_follow_the_order_and_estimate_likeness(docs, rows, empty):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want, true = [], []
    runs = lambda t: {t[i : i + 16] for i in range(max(1, len(t) - 15))} if t else set()
    for k, (i, t, *_) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        changed = t[: len(t) - third] + after[:third]
        want.append((str(i), len(t), hashlib.sha256(changed.encode()).hexdigest()))
        a, b = runs(t), runs(changed)
        true.append((str(i), len(t), len(a & b) / len(a | b) if a and b else float(not a and not b)))
    got = fingerprints.fingerprint_next(docs).collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    near = sorted((str(r.doc_id), r.n_chars, r.near_edited) for r in got)
    off = [abs(a[2] - b[2]) for a, b in zip(near, sorted(true))]
    assert np.mean(off) < 0.06 and max(off) < 0.4
    prints = {}
    for r in got:
        prints.setdefault(r.fingerprint, set()).add(r.n_chars)
    assert all(0 <= r.near_next <= 1 for r in got)
    assert fingerprints.fingerprint_next(empty).count() == 0


def test_fingerprints_deal_heavy_ids_to_several_parts(spark):
    draw = random.Random(21)
    text = lambda: "".join(draw.choice("abc é") for _ in range(draw.randrange(1, 90)))
    given = [(None, text()) for _ in range(300)] + [(7, text()) for _ in range(250)] + [(i, text()) for i in range(-100, 100)]
    given += [(None, None)] * 3 + [(-(1 << 63), "least"), ((1 << 63) - 1, "most"), (7, given[300][1])]
    docs = spark.createDataFrame(given, "`the.id` long, `the.text` string").repartition(3)
    placed = fingerprints.in_sequence(docs, 32, "the.id", "the.text").filter("turn = 0")
    parts = {r.doc_id: r.n for r in placed.groupBy("doc_id").agg(F.countDistinct("part").alias("n")).collect()}
    assert parts[None] > 8 and parts[7] > 6
    order = sorted(given, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    want = []
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        third = len(t) // 3
        want.append((str(i), len(t), hashlib.sha256((t[: len(t) - third] + after[:third]).encode()).hexdigest()))
    got = fingerprints.fingerprint_next(docs, "the.id", "the.text").collect()
    assert sorted((str(r.doc_id), r.n_chars, r.edited_sha256) for r in got) == sorted(want)
    for r in mixing.posteriors(docs, ([0.0, 0.0], [[0.0] * mixing.BUCKETS] * 2), "the.id", "the.text").limit(3).collect():
        assert list(r.posterior) == [0.5, 0.5]
    assert sharding.sized(docs, "the.id", "the.text").count() == len(given)


def test_packing_pieces_are_the_library_s_and_sequences_few(docs, rows, empty):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    capacity = 200
    want = []
    for i, t, *_ in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        for k, a in enumerate(range(0, len(ids), capacity)):
            own = np.array(ids[a : a + capacity], "<u4")
            want.append((str(i), k, a, len(own), zlib.crc32(own.tobytes())))
    got = packing.pack(docs, path, capacity=capacity).collect()
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for spans in used.values():
        ends = [0]
        for a, n in sorted(spans):
            assert a == ends[-1]
            ends.append(a + n)
        assert ends[-1] <= capacity
    assert len(used) <= -(-sum(w[3] for w in want) // capacity) + 4
    assert packing.pack(empty, path, capacity=capacity).count() == 0


def exact_program(sizes, need, capacity):
    """Value of the configuration program by the simplex method over all maximal configurations."""
    columns = []

    def grow(k, space, column):
        if k == len(sizes):
            columns.append(column)
            return
        for n in range(space // sizes[k] + 1):
            grow(k + 1, space - n * sizes[k], [*column, n])

    grow(0, capacity, [])
    a = np.array([c for c in columns if any(c)], float).T
    # min 1x, ax >= need: the dual max need y, a'y <= 1 has a feasible start at 0
    m, n = a.shape
    tableau = np.zeros((n + 1, m + n + 1))
    tableau[:n, :m], tableau[:n, m : m + n], tableau[:n, -1], tableau[n, :m] = a.T, np.eye(n), 1.0, -np.asarray(need, float)
    for _ in range(10_000):
        j = int(np.argmax(tableau[n, :-1] < -1e-9))  # Bland's rule
        if tableau[n, j] >= -1e-9:
            return tableau[n, -1]
        ratio = np.where(tableau[:n, j] > 1e-9, tableau[:n, -1] / np.where(tableau[:n, j] > 1e-9, tableau[:n, j], 1), np.inf)
        i = int(np.argmin(ratio))
        tableau[i] /= tableau[i, j]
        others = np.arange(n + 1) != i
        tableau[others] -= np.outer(tableau[others, j], tableau[i])
    raise AssertionError("no end")


@pytest.mark.parametrize("seed", range(5))
def test_plan_rounds_its_program(seed):
    draw = np.random.default_rng(seed)
    capacity = 300
    sizes = sorted(set(draw.integers(60, 200, draw.integers(2, 7)).tolist()))
    need = draw.integers(20, 400, len(sizes))
    counts = np.zeros(capacity + 1, np.int64)
    counts[sizes] = need
    counts[capacity] = 3
    made = packing.plan(counts, capacity)
    value = exact_program(sizes, need, capacity) + 3
    used = np.zeros(capacity + 1, int)
    for times, lengths in made.configurations:
        assert times > 0 and sum(x * m for x, m in lengths) <= capacity
        for x, m in lengths:
            used[x] += times * m
    assert (used == counts).all()
    assert made.bound <= value + 1 + 1e-6 and made.value >= value - 1e-6
    assert made.value <= 1.01 * value and made.sequences <= value + len(sizes)


def test_plan_of_a_known_histogram():
    counts = np.zeros(2049, np.int64)
    for size, n in {327: 441, 415: 240, 678: 420, 709: 476, 904: 162, 1060: 190}.items():
        counts[size] = n
    made = packing.plan(counts, 2048)
    assert made.sequences <= 618 and made.bound <= 616


def test_programs_of_many_lengths_get_the_finer_runs_too(monkeypatch):
    sizes = np.arange(650, 1010, 9)
    need = np.random.default_rng(1).integers(1, 2000, len(sizes)).astype(float)
    coarse = packing.weigh(sizes, need, 2048, 4.0, 1 / 10)
    plain, runs = packing.weigh, []

    def counted(sizes, need, capacity, rate, step):
        runs.append(step)
        return plain(sizes, need, capacity, min(rate, 8.0), max(step, 1 / 80))  # the finest two take a minute

    monkeypatch.setattr(packing, "weigh", counted)
    made = packing.solve(sizes, need, 2048)
    assert len(runs) == 5 and made.value < coarse.value


def test_mixing_rates_solve_their_least_squares(spark, empty):
    draw = random.Random(2)
    kinds = {"p": WORDS[:18], "q": WORDS[18:], "r": [w[::-1] for w in WORDS]}
    given, marks = [], []
    for i in range(400):
        k = draw.choices(list(kinds), [6, 3, 1])[0]
        given.append((BIG + i, " ".join(draw.choices(kinds[k], k=draw.randint(1, 60))), k, 1.0))
        if i % 2:
            marks.append((BIG + i, k))
    given += [(None, None, "p", 1.0), (BIG + 999, "", "p", 1.0)]
    docs = spark.createDataFrame(given, "doc_id long, text string, `a.b` string, rate double")
    labels = spark.createDataFrame([*marks, (None, "p"), (5, None), (6, "other")], "id long, domain string")
    targets = {"p": 0.3, "q": 0.3, "r": 0.4}
    got = mixing.mixing_rates(docs, labels, targets).collect()
    kind = {r[0]: r[2] for r in given}
    unseen = [r for r in got if r.id is not None and (r.id - BIG) % 2 == 0 and r.tokens >= 5]
    assert np.mean([list(targets)[int(np.argmax(r.posterior))] == kind[r.id] for r in unseen]) > 0.95
    t = np.array([r.tokens for r in got], float)
    p = np.array([r.posterior for r in got])
    rate = np.array([r.rate for r in got])
    share = (t * rate) @ p / t.sum()
    assert all(r.target_met for r in got) and np.abs(share - list(targets.values())).max() < 2e-4 and rate.min() >= 0
    # a dense projected gradient run to the end reaches the same residual: none
    r2, w = np.ones(len(t)), np.array(list(targets.values()))
    m = (t[:, None] * p) / t.sum()
    step = 1 / np.linalg.norm(m / np.sqrt(w), 2) ** 2
    for _ in range(5000):
        r2 = np.maximum(0, r2 - step * m @ ((m.T @ r2 - w) / w))
    assert np.abs(m.T @ r2 - w).max() < 1e-3
    with pytest.warns(UserWarning, match="mixing reached"):  # no rates of at least 1 shrink a domain within budget 1
        missed = mixing.mixing_rates(docs, labels, {"p": 0.01, "q": 0.01, "r": 0.98}, least=1.0, budget=1.0).collect()
    assert not any(r.target_met for r in missed)
    out = mixing.apply_rates(docs, labels, targets, least=1.0)
    assert out.columns == docs.columns and {r["doc_id"] for r in out.collect()} == {r[0] for r in given}
    assert mixing.apply_rates(empty, labels, targets).count() == 0
    assert mixing.mixing_rates(docs, labels.limit(0), targets).count() == len(given)


def test_warc_reads_damaged_files_as_rows(spark, tmp_path):
    import gzip

    pages = spark.createDataFrame([(1, "http://e.org/1", "<p>one</p>"), (2, "http://e.org/2", "<p>two</p>" * 9), (2, "http://e.org/2", "<p>two</p>" * 9)], "page_id long, url string, html string")
    source = sorted(warc.responses(pages).collect(), key=lambda r: r.target_uri)
    whole = [warc.serialise([(h["name"], h["value"]) for h in r.headers], bytes(r.block)) for r in source]
    files = {
        "good": b"".join(whole), "members": b"".join(map(gzip.compress, whole)), "cut": b"".join(whole)[:-120], "packed_cut": gzip.compress(b"".join(whole))[:-40],
        "head": whole[0] + b"WARC/1.1\r\nWARC-Type: response", "length": whole[0] + b"WARC/1.1\r\nWARC-Type: response\r\n\r\nabc", "junk": b"\x00\x01 not WARC", "none": b"",
    }
    for name, data in files.items():
        (tmp_path / f"{name}.warc").write_bytes(data)
    read = {n: warc.read_warc(spark, f"file://{tmp_path}/{n}.warc").collect() for n in files}
    for name in ("good", "members"):
        assert [(r.record_id, bytes(r.block)) for r in read[name]] == [(r.record_id, bytes(r.block)) for r in source]
        assert all(r.problem is None for r in read[name])
    assert [bool(r.problem) for r in read["cut"]] == [False, False, True]
    assert read["packed_cut"][-1].problem and [r.problem for r in read["head"]][0] is None and "break off" in read["head"][1].problem
    assert read["length"][1].problem == "no Content-Length" and read["junk"][0].problem == "no WARC record" and read["none"] == []
    everything = warc.read_warc(spark, f"file://{tmp_path}/*.warc")
    made = warc.derive(everything)
    assert made.count() == 2 * everything.filter("problem is null").count()
    none = warc.derive(warc.responses(pages.limit(0)))
    assert none.count() == 0 and warc.digests(none).count() == 0
