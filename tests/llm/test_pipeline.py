"""The corpus pipeline on a small folder, stage by stage, against plain Python."""

from __future__ import annotations

import random

import pytest

from maskwright.llm import toxicity

pipeline = pytest.importorskip("corpus_pipeline")
pytest.importorskip("public_tokenizers")
DDL = "doc_id long, text string, lang string, source string, n_chars long"
BIG = 2**53 + 1


def made(seed: int = 5) -> tuple[list, list]:
    draw = random.Random(seed)
    words = [f"{a}{b}{c}" for a in "bdfgklm" for b in ("ar", "el", "in", "ot") for c in ("a", "is", "um", "er")]
    docs, labels = [], []
    for i in range(240):
        text = draw.choices(words[i % 2 :: 2], k=draw.randint(20, 120))
        toxic = i % 5 == 0
        if toxic:
            text.insert(5, "you stupid idiot shut up")
        docs.append((BIG + i, " ".join(text), "en", "web", 1))
        if i % 3 != 2:
            labels.append((BIG + i, i % 2, int(toxic)))
    for k in range(60, 100):  # exact copies with other blanks, near copies with one word more
        docs.append((BIG + 1000 + k, docs[k][1].replace(" ", "\t "), "en", "web", 1))
        docs.append((BIG + 2000 + k, docs[k][1] + " end", "en", None, 1))
    docs += [(BIG + 5000, None, None, None, None), (BIG + 5001, "", "en", "web", 0), (None, "a text without an id", "en", "web", 1)]
    draw.shuffle(docs)
    return docs, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    docs, labels = made()
    spark.createDataFrame(docs, DDL).write.parquet(f"file://{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"file://{at}/labels.parquet")
    return f"file://{at}"


def test_stages_keep_what_their_rules_say(spark, folder):
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    rows = made()[0]
    docs = spark.createDataFrame(rows, DDL)
    stage = dict(pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, folder).cache()
    assert clean.columns == docs.columns
    bad = {r[0] for r in rows if r[1] and "stupid" in r[1]}
    kept = {r.doc_id for r in clean.collect()}
    assert not kept & bad and kept == {r[0] for r in rows} - bad
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    assert {r.doc_id for r in scored.filter("predicted = 0").collect()} == kept

    single = stage["exact_dedup"](spark, clean, folder).cache()
    assert single.columns == docs.columns
    least = {}
    for r in clean.collect():
        key = " ".join((r.text or "").split())
        least[key] = min(least.get(key, (2**63,)), (2**63 - 1 if r.doc_id is None else r.doc_id,))
    assert {r.doc_id if r.doc_id is not None else 2**63 - 1 for r in single.collect()} == {v[0] for v in least.values()}

    apart = stage["near_dedup"](spark, single, folder).cache()
    assert apart.columns == docs.columns
    got = {r.doc_id for r in apart.collect()}
    before = {r.doc_id for r in single.collect()}
    assert got == {i for i in before if i is None or not 2000 <= i - BIG < 2100 or i - 2000 not in before}

    mixed = stage["mixing"](spark, apart, folder).cache()
    assert mixed.columns == docs.columns and {r.doc_id for r in mixed.collect()} == got

    pieces = stage["packing"](spark, mixed, folder).collect()
    assert sorted(str(r.doc_id) for r in pieces if r.piece == 0) == sorted(str(r.doc_id) for r in mixed.collect())
    used = {}
    for r in pieces:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 2048 and len(used) <= -(-sum(used.values()) // 2048) + 3


def test_run_is_the_chain_of_its_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, folder).cache()
    # sequence numbers depend on how rows lie in files; pieces do not
    look = lambda df: sorted(map(str, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert look(pipeline.run(spark, folder)) == look(docs)


def test_stages_take_empty_tables(spark, folder):
    docs = spark.createDataFrame([], DDL)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() == 0, name
        assert name == "packing" or out.columns == docs.columns
