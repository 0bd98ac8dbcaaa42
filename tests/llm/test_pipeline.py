"""The corpus pipeline, stage by stage, against brute force on a small table with awkward rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lodestone.llm import quality, tokens_out

from .test_operators import brute_components, brute_hits, words

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, state string, th bigint, _row int"


def table():
    r = random.Random(3)
    good = lambda seed, n=80: " ".join(words(n, seed))
    bad = lambda seed: " ".join(w.upper() + r.choice(["!!%%", "##", "$$$"]) for w in words(60, seed))
    rows = [(i, good(i) if i % 4 else bad(i)) for i in range(160)]
    base = words(120, 900)
    rows += [(200, " ".join(base)), (201, " ".join(base)), (202, " ".join(base[:70] + ["other"] + base[71:])), (203, " ".join(base[:50] + words(70, 901)))]
    rows += [(210, good(910)), (210, good(910)), (210, good(911)), (None, good(912)), (None, good(912)), (None, good(913)), (None, None), (220, None), (221, ""), (222, "   ")]
    rows += [(230, " ".join(words(30, 920) + words(20, 950))), (231, " ".join(words(400, 921) + words(13, 950)))]  # 231: under a twentieth is hit
    rows += [(240, " ".join(words(20_000, 930))), (241, "x" * 200_000)]
    return [(i, t, "en", None if k % 9 == 0 else f"s{k % 3}", None if t is None else len(t), 1.0, "s", 5, 6) for k, (i, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    labels = [(i, int(i % 4 > 0), 0) for i in range(160)] + [(None, 1, 0), (3, None, 0), (3, 1, 0)]
    spark.createDataFrame(table(), COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, " ".join(words(20, 950))), (2, None), (None, "alpha1")], "item_id bigint, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


def test_stages_against_brute_force(spark, folder):
    (_, classify), (_, near), (_, clean), (_, mix), (_, tokens) = corpus_pipeline.STAGES
    read = lambda name: spark.read.parquet(f"{folder}/{name}.parquet")
    key = lambda rows: sorted([tuple(r) for r in rows], key=str)
    step = lambda df: corpus_pipeline.materialise(df, "test")
    docs = read("documents")

    model = quality.train(docs, read("labels"))
    rows = docs.collect()
    scores = [model.scores(*quality.features([r["text"]], [r["n_chars"]]))[0] for r in rows]
    one = step(classify(spark, docs, folder))
    want = [r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD]
    assert key(one.collect()) == key(want) and one.columns == docs.columns
    assert 0.9 < np.mean([(s >= 0.7) == (r["doc_id"] % 4 > 0) for r, s in zip(rows, scores, strict=True) if r["doc_id"] is not None and r["doc_id"] < 160]) <= 1

    # all rows go on from here, so that every awkward one is seen
    comps = brute_components([(k, r["text"]) for k, r in enumerate(rows)])
    groups = {}
    for k, _, c in comps:
        groups.setdefault(c, []).append(rows[k])
    best = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0)) for g in groups.values()]
    two = step(near(spark, docs, folder))
    assert key(two.collect()) == key(best) and two.columns == docs.columns and len(best) <= len(rows) - 4

    items = [(1, " ".join(words(20, 950)))]
    three = step(clean(spark, two, folder))
    kept = [r for r in best if not brute_hits(r["text"], items)[4]]
    assert key(three.collect()) == key(kept) and three.columns == docs.columns and len(kept) < len(best)

    four = step(mix(spark, three, folder))
    copies = key(four.collect())
    assert four.columns == docs.columns and set(copies) == set(key(kept)) and all(1 <= copies.count(r) <= 2 for r in set(copies)) and len(copies) > len(kept)

    five = tokens(spark, four, folder).collect()
    enc, start, want = tokens_out.encoder(tokens_out.tokenizer_file()).tokenizer, 0, []
    for i, text in sorted([(r[0], r[1] or "") for r in copies], key=lambda x: (x[0] is not None, x[0] or 0, x[1])):
        ids = np.array([*enc.encode(text, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert key(five) == key(want)


def test_run_and_empty_table(spark, folder, tmp_path):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and out.count() > 100
    # ids that are unique and not null take no numbering, with the same outcome
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("doc_id < 210")
    assert corpus_pipeline._rows(docs)[1]
    plain = corpus_pipeline.near_duplicate_stage(spark, docs, folder).select("doc_id").collect()
    again = corpus_pipeline.near_duplicate_stage(spark, docs.union(docs.where("doc_id = 5")), folder).select("doc_id").collect()
    assert sorted(plain) == sorted(again)
    empty = str(tmp_path)
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0
    assert docs.select(F.count("*")).first()[0] > 0
