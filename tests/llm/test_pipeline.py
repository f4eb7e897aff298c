"""The pipeline against brute force, stage by stage, on documents with planted cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from test_methods import WORDS, brute_classes, text_of

BAD = ["grblx", "snofk", "trozz"]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    rng = random.Random(21)
    items = [text_of(rng, 20) for _ in range(4)]
    passage = text_of(rng, 45)
    docs, toxic = [], set()
    for i in range(160):
        words = text_of(rng, rng.randint(40, 120)).split()
        kind = i % 8
        if kind == 1:
            for _ in range(5):
                words.insert(rng.randrange(len(words)), rng.choice(BAD))
            toxic.add(i)
        if kind == 2 and docs:
            words = docs[i - 2][1].split()
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        if kind == 3:
            words[20:20] = passage.split()
        if kind == 4 and i % 16 == 4:
            half = items[i % 4].split()
            words[7:7] = [*half[10:], "break", *half[:10]]
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 1))
    docs += [(200, None, None, None, None), (201, "", "en", "s1", 0)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(docs, schema).write.parquet(f"{folder}/documents.parquet")
    labels = [(i, 1, int(i in toxic)) for i in range(160)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, toxic, items, passage


def cut(rows: list[tuple[int, str]]) -> dict[int, str]:
    """Texts without bytes of 100-byte strings that start earlier."""
    seen, out = set(), {}
    for doc, text in sorted(rows):
        b = text.encode()
        gone = bytearray(len(b))
        for s in range(len(b) - 99):
            w = b[s : s + 100]
            if w in seen:
                gone[s : s + 100] = b"\1" * 100
            seen.add(w)
        out[doc] = bytes(x for x, g in zip(b, gone) if not g).decode("utf-8", "ignore")
    return out


def test_stages_equal_brute_force(spark, corpus, tmp_path):
    folder, docs, toxic, items, passage = corpus
    frame = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, folder).write.parquet(f"{tmp_path}/{number}")
        frame = spark.read.parquet(f"{tmp_path}/{number}")
        kept[name] = frame.collect()
    texts = {d[0]: d[1] for d in docs}

    clean = {r.doc_id for r in kept["toxicity"]}
    assert clean == set(texts) - toxic

    classes = brute_classes([(i, texts[i]) for i in clean], 5, 80)
    alone = {r.doc_id for r in kept["near_duplicates"]}
    assert alone == {i for i, c in classes.items() if i == c} and len(alone) < len(clean)

    expected = cut([(i, texts[i] or "") for i in alone])
    got = {r.doc_id: r for r in kept["repeated_strings"]}
    assert {i: r.text or "" for i, r in got.items()} == {i: t for i, t in expected.items() if t.strip() or not (texts[i] or "").strip()}
    assert sum(passage in (r.text or "") for r in got.values()) == 1
    assert all(r.n_chars == len(r.text) for i, r in got.items() if r.text != texts[i])

    leaked = {i for i, r in got.items() if any(all(w in (r.text or "") for w in (t[: len(t) // 3], t[-len(t) // 3 :])) for t in items)}
    left = {r.doc_id for r in kept["decontamination"]}
    assert leaked and left == set(got) - leaked

    mixed = kept["source_mix"]
    assert {r.doc_id for r in mixed} <= left and all(r.copies in (1, 2) and r.copy < r.copies for r in mixed)
    copies = {r.doc_id: r.copies for r in mixed}
    assert len(mixed) == sum(copies.values())


def test_run_chains_the_stages(spark, corpus):
    folder, docs, toxic, _, _ = corpus
    first = corpus_pipeline.run(spark, folder).orderBy("doc_id", "copy").collect()
    assert first == corpus_pipeline.run(spark, folder).orderBy("doc_id", "copy").collect()
    assert not {r.doc_id for r in first} & toxic and {c for c in ("doc_id", "text", "lang", "source", "n_chars")} <= set(first[0].asDict())


def test_columns_of_all_but_the_last_stage(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").withColumn("n_chars", F.col("n_chars").cast("int"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).dtypes == docs.dtypes


def test_different_texts_of_one_id_stay(spark, corpus):
    """Only the text that has a near copy goes; equal rows are thinned to one; rows without id stay."""
    rng = random.Random(5)
    first, second, third = (text_of(rng, 60) for _ in range(3))
    near = first.replace(first.split()[30], "other")
    rows = [(1, first), (5, near), (5, second), (5, second), (7, third), (None, first), (None, None), (9, ""), (9, "")]
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows], "doc_id bigint, text string, `_own` string, source string, n_chars int")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, corpus[0])
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(1, first), (5, second), (7, third), (None, first), (None, None), (9, "")], key=str)
