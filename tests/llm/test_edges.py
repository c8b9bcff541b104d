"""Odd tables: nulls in any column, empty and very long texts, ties, repeated rows and ids, clashing names, no rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexisieve.llm import ann, chunk_bpe, line_dedup, minhash, packing, quality_model, quality_rules, sharding, substring_dedup, token_files

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
CLASHING = (
    "score kept removed_lines size shard slot key rep nb bi bj found _text _row _value _part batch bucket n_tokens ids seed place mark value rank words x ones half load again "
    "chain spans text_key component_id n_shingles _c0 _runs _spans n lang2 base_failed row_no file_no"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def long_text():
    rng = random.Random(77)
    words = [" ".join(f"v{rng.randrange(90_000)}" for _ in range(60)) for _ in range(6000)]
    return "\n".join(words) + "\n" + "z" * 300_000


@pytest.fixture(scope="module")
def odd():
    rng = random.Random(3)
    prose = [" ".join(f"w{rng.randrange(300)}" for _ in range(120)) for _ in range(6)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(prose)]
    rows += [
        (None, prose[0], "en", "s", 1), (None, None, None, None, None), (50, None, None, None, None), (51, "", "en", None, 0), (52, " \n\t\n ", None, "s", None),
        (53, long_text(), "de", "s", None), (54, prose[1], "xx", "s", 1), (54, prose[1], "xx", "s", 1), (55, prose[2], "en", "s", 1), (55, "other text " * 30, "en", "s", 1), (56, "one", "en", "s", 3),
    ]
    return rows


@pytest.fixture(scope="module")
def table(spark, odd):
    df = spark.createDataFrame(odd, SCHEMA)
    for k, name in enumerate(CLASHING):
        df = df.withColumn(name, F.lit(k) if k % 2 else F.lit(None).cast("string"))
    return df.repartition(3)


def by_text(odd):
    return Counter((r[0], r[1]) for r in odd)


def library(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return {x: t.encode(x or "", add_special_tokens=False).ids for x in set(texts)}


@pytest.fixture(scope="module")
def ids_of(odd):
    return library([r[1] for r in odd])


def kept_columns(got, names):
    """The caller's other columns come back with their values."""
    for r in got:
        assert all(r[name] == (CLASHING.index(name) if CLASHING.index(name) % 2 else None) for name in names)


def test_lines(odd, table, spark):
    out = line_dedup.dedup_lines(spark, table)
    assert Counter(out.columns)["removed_lines"] == 1
    got = out.collect()
    assert len(got) == len(odd)
    kept_columns(got, [c for c in CLASHING if c != "removed_lines"])
    texts = {(r["doc_id"], r["text"]) for r in got}
    assert (53, long_text()) in texts and (None, odd[0][1]) in texts and (50, None) in texts and (51, "") in texts
    # one-line copies go, whether or not their row is repeated; rows of one id are not copies of each other
    assert Counter(r["text"] for r in got if r["doc_id"] == 54) == {"": 2} and (55, "other text " * 30) not in texts


def test_packing(odd, table, spark, ids_of):
    got = packing.pack(spark, table, tokenizer_path=PATH).collect()
    want = Counter((r[0], len(ids_of[r[1]]) + 1) for r in odd)
    assert Counter((r["doc_id"], r["n_tokens"]) for r in got) == want
    again = packing.pack(spark, table.repartition(5), tokenizer_path=PATH).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))  # ties do not depend on the layout


def test_shards(odd, table, spark):
    got = sharding.assign_shards(spark, table, 3).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in odd)
    for s in range(3):
        mine = [r["slot"] for r in got if r["shard"] == s]
        assert sorted(mine) == list(range(len(mine)))


def test_bpe(odd, table, spark, ids_of):
    got = chunk_bpe.encode_decode(spark, table, PATH).collect()
    want = Counter((r[0], len(ids_of[r[1]]), hashlib.sha256(",".join(map(str, ids_of[r[1]])).encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in odd)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_passages(odd, table, spark):
    found = substring_dedup.find_passages(spark, table).collect()
    assert {(r["doc_id"], r["source_id"]) for r in found} == {(54, 1), (55, 2)} and all(r["similarity"] == 1 for r in found)
    got = substring_dedup.remove_passages(spark, table).collect()
    assert len(got) == len(odd)
    kept_columns(got, CLASHING)
    want = Counter((i, "" if (i, t) in ((54, odd[1][1]), (55, odd[2][1])) else t) for i, t in ((r[0], r[1]) for r in odd))
    assert Counter((r["doc_id"], r["text"]) for r in got) == want


def test_near_duplicates(odd, table, spark):
    got = minhash.near_duplicates(spark, table).collect()
    assert len(got) == len(odd)
    for r in got:
        want = {None: None, 54: 1, 55: 2}.get(r["doc_id"], r["doc_id"])
        # rows of one id are one document with several texts: the row of other words is a set of its own
        assert r["component_id"] == want or (r["doc_id"] == 55 and r["component_id"] == 55)
        assert r["kept"] == (r["doc_id"] is None or r["component_id"] == r["doc_id"])
    assert {r["n_shingles"] for r in got if r["doc_id"] in (50, 51, 52)} == {0} and [r["n_shingles"] for r in got if r["doc_id"] == 56] == [1]


def test_quality_model(odd, table, spark):
    labels = spark.createDataFrame([(0, 1, 0), (1, 1, 0), (1, 0, 0), (None, 1, None), (53, 0, 1), (99, 1, 0), (2, None, 0), (3, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(spark, table, labels)
    out = quality_model.score_quality(table, model)
    assert Counter(out.columns)["score"] == 1
    got = out.collect()
    assert len(got) == len(odd) and all(0 <= r["score"] <= 1 for r in got)
    kept_columns(got, [c for c in CLASHING if c != "score"])
    flat = {r["score"] for r in got if not (r["text"] or "")}
    assert len(flat) == 1  # null and empty texts score alike


def test_token_files(odd, table, spark, ids_of, tmp_path):
    path = f"file://{tmp_path}/files"
    token_files.write_tokens(spark, table, path, PATH)
    got = token_files.token_digests(spark, path).orderBy("start").collect()
    rows = sorted(odd, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, want in zip(got, rows, strict=True):
        ids = [*ids_of[want[1]], 0]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (want[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_quality_rules(odd, table, spark):
    got = quality_rules.judge_quality(spark, table).collect()

    def counts(t):
        w = re.findall("[^ \t\n\x0b\x0c\r]+", t or "")
        grams = Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        return len(w), sum(map(len, w)), len({p for j in range(len(w) - 2) if grams[tuple(w[j : j + 3])] > 1 for p in (j, j + 1, j + 2)})

    want = Counter((r[0], *counts(r[1])) for r in odd)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_repeat_words"]) for r in got) == want
    assert all(r["base_failed"] and not r["kept"] for r in got if r["doc_id"] in (50, 51, 52, 56))


def test_nearest_with_ties(spark):
    rows = [(i, [float(i % 3), 1.0]) for i in range(30)] + [(None, [1.0, 1.0]), (40, None), (41, []), (0, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("score", "rank", "dim", "shard", "ids", "near", "row", "query_id"):
        df = df.withColumn(name, F.lit("x"))
    got = ann.nearest(spark, df, df.where("vec_id = 0 or vec_id is null or vec_id > 39")).orderBy("rank").collect()
    assert [(r["query_id"], r["vec_id"], r["score"]) for r in got] == [(0, v, 0.0) for v in range(3, 30, 3)] + [(0, 1, 1.0)]


def test_empty_token_files(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    token_files.write_tokens(spark, none, f"file://{tmp_path}/files", PATH)
    assert token_files.token_digests(spark, f"file://{tmp_path}/files").count() == 0


def test_stages(odd, spark, tmp_path):
    """Every stage returns the columns of documents and takes every row, of an empty table too."""
    import corpus_pipeline

    labels = [(i, int(i < 3), 0) for i in range(6)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame(odd, SCHEMA)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        got = out.collect()
        assert len(got) <= len(odd) and (name in ("quality classifier", "MinHash near-dedup") or len(got) == len(odd))
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(odd)
    # of rows that share an id, near-dedup drops those of the text that has a copy, and keeps rows without an id
    left = Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_dedup(spark, docs, str(tmp_path)).collect())
    assert left[(None, odd[0][1])] == 1 and (54, odd[1][1]) not in left and left[(53, long_text())] == 1
    assert (55, odd[2][1]) not in left and left[(55, "other text " * 30)] == 1
