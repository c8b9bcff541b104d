"""Training-data operators against brute force, round trips and odd inputs."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexisieve.llm import ann, common, line_dedup, minhash, packing, quality_model, quality_rules, sharding, substring_dedup, token_files
from lexisieve.llm import bpe, chunk_bpe
from lexisieve.llm.components import connected_components

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def docs_of(spark, texts, extra=()):
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows + list(extra), SCHEMA)


def prose_of(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}{'.' if rng.random() < 0.1 else ''}" for _ in range(n))


ODD = [None, "", " \n\t ", "one", "É à  ü x", "<|endoftext|> a<|endoftext|>b", "a\n\nb\n", "x" * 5000, "word " * 3000, "\r\n\x0b\x0c \x85  z", "it's  'll don't\n\n  y ", "a", "a"]


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    base = [prose_of(rng, rng.randint(1, 300)) for _ in range(60)]
    out = list(ODD) + base
    for t in base[:25]:
        w = t.split(" ")
        for _ in range(3):
            v = list(w)
            for _ in range(max(1, len(w) // rng.choice([20, 40, 80]))):
                v[rng.randrange(len(v))] = f"q{rng.randrange(9999)}"
            out.append(" ".join(v))
    passage = prose_of(rng, 70, 5000)
    out += [prose_of(rng, 90, 5000) + "\n" + passage + "\n" + prose_of(rng, 60, 5000) for _ in range(4)]
    out += base[:5] + [base[0].upper()]
    return out


# ------------------------------------------------------------------ tokens
def reference_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    ids = [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]
    return ids, [t.decode(i, skip_special_tokens=False) for i in ids]


def test_bpe_is_the_librarys(spark, corpus):
    ids, back = reference_ids(corpus)
    got = {r["doc_id"]: r for r in chunk_bpe.encode_decode(spark, docs_of(spark, corpus), PATH).collect()}
    for i in range(len(corpus)):
        assert got[i]["n_tokens"] == len(ids[i]), i
        assert got[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids[i])).encode()).hexdigest(), i
        assert got[i]["decoded_sha256"] == hashlib.sha256(back[i].encode()).hexdigest(), i


def test_segments_end_where_the_library_splits():
    mine, rng = bpe.Encoder(PATH), random.Random(1)
    atoms = ["a", "the", "t", "'", "'s", "'ll", '"', "$$$", ".", ",", "(", "-", "_", "1", "23", " ", "  ", "\n", "\t", "\r\n", "é", "ß", "中", "\xa0", "\u2003",
             "\u3000", "’", "😀", "<|endoftext|>", "<|", "|>", "'S", "'re", "\x0b", "\x1c", "²", "\u0300", "\u200b", "\ufeff"]
    texts = ["".join(rng.choice(atoms) for _ in range(rng.randint(0, 30))) for _ in range(6000)] + ["word " * 200_000 + "x" * 100_000]
    ids, _ = reference_ids(texts)
    for t in common.slices(pa.array(texts), 20_000):
        got, at = mine.encode(t)
        for i in range(len(t)):
            assert got[at[i] : at[i + 1]].tolist() == ids[t.first + i], texts[t.first + i][:100]


def test_the_segment_table_stays_small(monkeypatch):
    monkeypatch.setattr(bpe, "SLOTS", 1 << 8)
    monkeypatch.setattr(bpe, "BLOCK", 64)
    mine, rng = bpe.Encoder(PATH), random.Random(2)
    texts = [prose_of(rng, 200, 5000) for _ in range(30)]
    ids, _ = reference_ids(texts)
    for t in common.slices(pa.array(texts), 4000):
        got, at = mine.encode(t)
        assert all(got[at[i] : at[i + 1]].tolist() == ids[t.first + i] for i in range(len(t))) and mine.table.held <= 128


def test_chunks_are_reused(corpus):
    codec = chunk_bpe.ChunkCodec(bpe.Encoder(PATH), chunk_segments=8)
    texts = [t for t in corpus if t] * 2
    ids, _ = reference_ids(texts)
    for t in common.slices(pa.array(texts)):
        for k, (n, decimals, _) in enumerate(codec.run(t)):
            assert decimals == ",".join(map(str, ids[t.first + k])).encode()
    assert codec.reused > codec.encoded


def blank_spanning_tokenizer(path):
    """A byte-level BPE without a pre-tokeniser split: its tokens cross segments and chunks."""
    from tokenizers import AddedToken, Tokenizer, decoders, models, pre_tokenizers

    merges = [("Ġ", "a"), ("Ġa", "Ġ"), ("a", "b"), ("ĠaĠ", "b"), ("b", "Ġa"), ("Ġ", "b"), ("ĠaĠb", "Ġa")]
    letters = sorted(chunk_bpe.byte_alphabet())
    vocab = {t: i for i, t in enumerate([*letters, *["".join(m) for m in merges]])}
    made = Tokenizer(models.BPE(vocab=vocab, merges=merges))
    made.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    made.decoder = decoders.ByteLevel()
    made.add_special_tokens([AddedToken("<end>", special=True)])
    made.save(path)
    return made


def test_bad_joins_are_encoded_anew(tmp_path):
    path = str(tmp_path / "spanning.json")
    made = blank_spanning_tokenizer(path)
    mine = bpe.Encoder(path)
    assert not mine.by_segment and bpe.Encoder(PATH).by_segment
    codec = chunk_bpe.ChunkCodec(mine, chunk_segments=1)
    rng = random.Random(3)
    texts = ["a b", " a b a b a", "", "x"] + [" ".join(rng.choice(["a", "b", "ab", "c"]) for _ in range(rng.randint(1, 60))) for _ in range(150)]
    for t in common.slices(pa.array(texts)):
        for k, (n, decimals, back) in enumerate(codec.run(t)):
            want = made.encode(texts[t.first + k], add_special_tokens=False).ids
            assert n == len(want) and decimals == ",".join(map(str, want)).encode() and back.decode() == texts[t.first + k]
    assert False in codec.joined.values() and True in codec.joined.values()
    # read by segments in spite of that, the refused joins put the chunks together again
    split = bpe.Encoder(path)
    split.by_segment = True
    codec = chunk_bpe.ChunkCodec(split, chunk_segments=1)
    some = ["q a b q a b", "c c c c a b c a"]
    for t in common.slices(pa.array(some)):
        list(codec.run(t))
    assert False in codec.verdicts.values()


def test_token_files(spark, corpus, tmp_path):
    ids, _ = reference_ids(corpus)
    path = f"file://{tmp_path}/files"
    token_files.write_tokens(spark, docs_of(spark, corpus).repartition(3), path, PATH)
    got = token_files.token_digests(spark, path).orderBy("doc_id").collect()
    start = 0
    for r, x in zip(got, ids, strict=True):
        x = [*x, 0]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(x), zlib.crc32(np.array(x, dtype="<u4").tobytes()))
        start += len(x)
    stored = spark.read.parquet(path).orderBy("doc_id").select("ids").collect()
    assert [r["ids"] for r in stored] == [[*x, 0] for x in ids]


def test_token_files_are_read_selectively(spark, tmp_path):
    import pyarrow.parquet as pq

    rng = random.Random(4)
    texts = [prose_of(rng, rng.randint(1, 400)) for _ in range(3000)]
    path = f"file://{tmp_path}/files"
    token_files.write_tokens(spark, docs_of(spark, texts).coalesce(1), path, PATH, row_group_bytes=256 << 10)
    footers = [pq.ParquetFile(f).metadata for f in sorted((tmp_path / "files").glob("*.parquet"))]
    groups = [m.row_group(g) for m in footers for g in range(m.num_row_groups)]
    assert len(groups) > len(footers)  # row groups are small, and cut by the asked size
    for g in groups:
        columns = {g.column(i).path_in_schema: g.column(i) for i in range(g.num_columns)}
        assert g.total_byte_size < 4 * (256 << 10)
        assert all(c.has_offset_index and c.has_column_index for c in columns.values())
        # the dictionary encoding of data pages of version 1 goes by its older name
        assert columns["ids.list.element"].has_dictionary_page and {"RLE_DICTIONARY", "PLAIN_DICTIONARY"} & set(columns["ids.list.element"].encodings)
    ids, _ = reference_ids([texts[7], texts[2222]])
    some = token_files.read_documents(spark, path, [7, 2222, 99_999])
    assert {r["doc_id"]: r["ids"] for r in some.collect()} == {7: [*ids[0], 0], 2222: [*ids[1], 0]}
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_id" in plan
    meta = token_files.read_metadata(spark, path)
    assert "ids" not in meta._jdf.queryExecution().executedPlan().toString() and meta.count() == 3000


# ------------------------------------------------------------------ near duplicates
def shingles(t):
    w = (t or "").encode().translate(FOLD).split()
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def groups(sets):
    par = list(range(len(sets)))

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = find(i), find(j)
                par[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("block", [2048, 3, 1])
def test_near_duplicates(spark, corpus, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "SET_BLOCK_ROWS", min(block, 1024))
    want, sets = groups([shingles(t) for t in corpus]), [shingles(t) for t in corpus]
    got = minhash.near_duplicates(spark, docs_of(spark, corpus, [(None, corpus[20], "en", "s", 1)])).collect()
    nameless = [r for r in got if r["doc_id"] is None]
    assert len(nameless) == 1 and nameless[0]["component_id"] is None and nameless[0]["kept"]
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert len(by) == len(corpus)
    for i in range(len(corpus)):
        assert (by[i]["n_shingles"], by[i]["component_id"], by[i]["kept"]) == (len(sets[i]), want[i], want[i] == i), i


def test_components_of_chains(spark):
    ws = common.Workspace(spark, "test")
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 101), (200, 200)]
    got = dict(connected_components(ws, spark.createDataFrame(edges, "a long, b long"), "c").collect())
    assert {got[i] for i in range(41)} == {0} and {got[i] for i in (100, 101, 103)} == {100} and 200 not in got


# ------------------------------------------------------------------ lines and passages
def brute_lines(texts, run, lone_words=8):
    seen, alone, out = {}, set(), []
    for i, t in enumerate(texts):
        lines = [(k, x.strip(" \t\n\x0b\x0c\r")) for k, x in enumerate((t or "").split("\n"))]
        lines = [x for x in lines if x[1]]
        dead = set()
        for k in range(len(lines) - run + 1):
            key, last = tuple(x[1] for x in lines[k : k + run]), lines[k + run - 1][0]
            if key in seen:
                own, source_last = seen[key]
                dead |= set(range(max(lines[k][0], source_last + 1) if own == i else lines[k][0], last + 1))
            else:
                seen[key] = i, last
        for k, x in lines if run > 1 else []:
            if len(lines) == 1 or len(re.findall("[^ \t\n\x0b\x0c\r]+", x)) >= lone_words:
                if x in alone:
                    dead.add(k)
                alone.add(x)
        out.append(None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in dead))
    return out


@pytest.mark.parametrize("run,heavy", [(2, 16), (3, 2), (1, 2)])
def test_line_runs(spark, run, heavy, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY", heavy)
    rng = random.Random(run)
    long_ = ["the long line of eight words stands here", "a  long\x0bline of more than eight words in all ", "seven words are not enough for this"]
    texts = [None, "", "\n\n", "a\nb\nc", "a\nb\nc", "a\na\na\na", "a\nb\na\nb\na", "short", "short", "x\n\nx", "p\n\n \np\np"]
    texts += ["\n".join(rng.choice(["a", "b", "c", "d ", " e", "", "f", "a", *long_]) for _ in range(rng.randint(1, 12))) for _ in range(120)]
    docs = docs_of(spark, texts).withColumn("dead", F.lit(7)).withColumn("_row", F.lit("x")).withColumn("removed_lines", F.lit(1))
    got = line_dedup.dedup_lines(spark, docs, run).orderBy("doc_id").collect()
    want = brute_lines(texts, run)
    assert [r["text"] for r in got] == want
    assert run == 1 or (want[5], want[8], want[9]) == ("a\na" if run == 2 else "a\na\na", "", "x\n\nx")
    assert all(r["dead"] == 7 and r["_row"] == "x" for r in got)
    for r, t in zip(got, texts):
        left = [x for k, x in enumerate((t or "").split("\n")) if k not in r["removed_lines"]]
        assert "\n".join(left) == (r["text"] or "")


def test_line_runs_are_maximal_and_have_sources(spark):
    texts = ["a\nb\nc\nd", "x\nb\nc\nd\ny\n\na\nb", "q\nq"]
    ws = common.Workspace(spark, "test")
    got = line_dedup.find_runs(spark, ws, docs_of(spark, texts).select("doc_id", "text")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 0, 2, 2, 2), (1, 0, 10, 0, 1)]


def test_the_stage_deletes_single_repeated_lines(spark):
    import corpus_pipeline

    rng = random.Random(6)
    texts = [None, "", "one line", "one line", "a\nshared line\nb", "c\n shared line\nd", "e\n\ne"]
    texts += ["\n".join(rng.choice(["a", "b", "g", "h ", " i", "", "j"]) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    docs = docs_of(spark, texts)
    out = corpus_pipeline.line_dedup(spark, docs, "")
    assert out.columns == docs.columns
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    assert got == brute_lines(texts, 1) and got[3] == "" and got[5] == "c\nd"


def test_fingerprints_meet_every_window():
    rng = np.random.default_rng(1)
    for _ in range(50):
        h = rng.integers(0, 5, rng.integers(1, 30)).astype(np.uint64)
        at = set(line_dedup.fingerprints(h, 3).tolist())
        assert all(at & set(range(i, i + 3)) for i in range(len(h) - 2))


def test_heavy_seeds_and_margins_change_nothing(spark, corpus, monkeypatch):
    docs = docs_of(spark, corpus * 2 + ["w1 w2 w3 w4 " * 200, "w1 w2 w3 w4 " * 150])
    frames = []
    for heavy, margin, hot, ids, together in ((10**9, 10**6, 10**9, 0, 10**6), (2, 10**6, 2, 10**6, 1), (2, 3, 2, 0, 2), (4, 64, 10, 10**6, 9)):
        for name, value in (("HEAVY", heavy), ("MARGIN", margin), ("HOT", hot), ("MOST_IDS", ids), ("SPANS_TOGETHER", together)):
            monkeypatch.setattr(substring_dedup, name, value)
        frames.append(sorted(map(tuple, substring_dedup.find_passages(spark, docs).collect())))
    assert len(frames[0]) > 100 and all(f == frames[0] for f in frames[1:])


def longest_common(a, b):
    row = np.zeros(len(b) + 1, dtype=np.int64)
    for x in a:
        row[1:] = np.maximum(row[1:], row[:-1] + (b == x))
        np.maximum.accumulate(row, out=row)
    return int(row[-1])


def test_common_words_of_gaps(monkeypatch):
    rng = np.random.default_rng(3)
    for block in (7, 16_384):
        monkeypatch.setattr(substring_dedup, "LCS_BLOCK", block)
        for _ in range(400):
            a, b = (rng.integers(0, rng.integers(1, 9), rng.integers(0, 40)).astype(np.uint32) for _ in range(2))
            assert substring_dedup._common(a, b) == (longest_common(a, b) if len(a) and len(b) else 0)


def test_passages_are_alignments(spark, corpus):
    """Every reported passage, fuzzy ones too, against the words of both texts."""
    words = [np.array([hash(w) for w in (t or "").encode().translate(FOLD).split()]) for t in corpus]
    got = substring_dedup.find_passages(spark, docs_of(spark, corpus)).collect()
    fuzzy = 0
    for r in got:
        mine, theirs = words[r["doc_id"]][r["word_start"] : r["word_end"]], words[r["source_id"]][r["source_word_start"] : r["source_word_end"]]
        text = corpus[r["doc_id"]].encode()[r["byte_start"] : r["byte_end"]].translate(FOLD).split()
        assert [hash(w) for w in text] == mine.tolist()
        most = longest_common(mine, theirs)
        assert r["matches"] <= most and r["similarity"] == r["matches"] / max(len(mine), len(theirs)) >= 0.75
        assert most / max(len(mine), len(theirs)) - r["similarity"] < 0.1
        fuzzy += r["similarity"] < 1
    assert fuzzy > 20


def test_passages(spark, corpus):
    got = substring_dedup.find_passages(spark, docs_of(spark, corpus, [(None, corpus[20], "en", "s", 1)])).collect()
    words = [(t or "").encode().translate(FOLD).split() for t in corpus]
    spans = collections.defaultdict(set)
    for r in got:
        assert r["source_id"] < r["doc_id"] and r["word_end"] - r["word_start"] >= 50 and r["similarity"] >= 0.75
        spans[r["doc_id"]] |= set(range(r["word_start"], r["word_end"]))
    first = {}
    for i, w in enumerate(words):
        for j in range(len(w) - 49):
            key = tuple(w[j : j + 50])
            if first.setdefault(key, i) < i:
                assert set(range(j, j + 50)) <= spans[i], (i, j)
    alone = [i for i in range(len(ODD), len(ODD) + 60) if i not in spans]
    assert len(alone) == 60


def test_passages_are_cut_out(spark, corpus):
    docs = docs_of(spark, corpus, [(None, corpus[20], "en", "s", 1)]).withColumn("found", F.lit(1)).withColumn("_text", F.col("lang"))
    got = substring_dedup.remove_passages(spark, docs)
    assert got.columns == docs.columns
    by = {r["doc_id"]: r["text"] for r in got.collect()}
    assert len(by) == len(corpus) + 1 and by[None] == corpus[20]
    for i in range(len(ODD) + 60):
        assert by[i] == corpus[i]
    n = len(ODD) + 60 + 75
    shared = corpus[n].split("\n")[1]
    assert shared in by[n] and all(shared not in by[n + k] for k in (1, 2, 3))
    assert all(by[n + k].split("\n")[0] == corpus[n + k].split("\n")[0] for k in (1, 2, 3))
    assert by[n + 4] == "" == by[n + 5] or len(corpus[n + 4].split()) < 50


def test_edited_passages_are_found(spark):
    rng = random.Random(12)
    texts, edited = [], []
    for k in range(60):
        n, share = [(60, 0.1), (60, 0.15), (100, 0.2)][k % 3]
        words = prose_of(rng, n, 5000).split()
        copy = list(words)
        for j in rng.sample(range(n), round(n * share)):
            copy[j] = f"e{rng.randrange(99999)}"
        texts.append(prose_of(rng, 100, 5000) + " " + " ".join(words) + " " + prose_of(rng, 100, 5000))
        edited.append((prose_of(rng, 80, 5000) + " " + " ".join(copy) + " " + prose_of(rng, 80, 5000), n))
    got = substring_dedup.find_passages(spark, docs_of(spark, texts + [t for t, _ in edited])).collect()
    found = {r["doc_id"] for r in got if r["source_id"] == r["doc_id"] - 60 and r["word_end"] > 80 and r["word_start"] < 80 + edited[r["doc_id"] - 60][1]}
    assert len(found) >= 57


@pytest.mark.parametrize("length", [30, 60])
def test_passages_whose_words_stand_first_in_several_documents(spark, length, monkeypatch):
    """Each window that an earlier document holds is covered, though its parts are first found elsewhere."""
    monkeypatch.setattr(substring_dedup, "MANY", 2)
    rng = random.Random(length)

    def apart():
        return prose_of(rng, 30, 10**6)

    parts = [prose_of(rng, length, 10**6) for _ in range(12)]
    texts = [f"{apart()} {p} {apart()}" for p in parts]
    texts += [" ".join(apart() + " " + parts[k] + " " + parts[k + 1] for k in range(0, 12, 2)) for _ in range(5)]
    texts += [f"{apart()} {parts[3]} {parts[4]} {parts[5]} {apart()}" for _ in range(2)]
    words = [t.split() for t in texts]
    spans = [[] for _ in texts]
    for r in substring_dedup.find_passages(spark, docs_of(spark, texts)).collect():
        assert r["similarity"] >= 0.75 and r["source_id"] < r["doc_id"]
        spans[r["doc_id"]].append((r["word_start"], r["word_end"]))
    first, repeated = {}, 0
    for i, w in enumerate(words):
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), i) < i:
                repeated += 1
                assert any(a <= j and j + 50 <= b for a, b in spans[i]), (i, j)
    assert repeated > 100


def test_edited_passages_whose_words_stand_first_in_several_documents(spark):
    rng = random.Random(8)
    passage = prose_of(rng, 80, 10**6).split()
    texts = [prose_of(rng, 40, 10**6) + " " + " ".join(passage[k : k + 10]) + " " + prose_of(rng, 40, 10**6) for k in range(0, 80, 5)]
    edited = list(passage)
    for j in range(7, 80, 10):
        edited[j] = f"e{j}"
    texts += [prose_of(rng, 60, 10**6) + " " + " ".join(w) + " " + prose_of(rng, 60, 10**6) for w in (passage, edited)]
    got = substring_dedup.find_passages(spark, docs_of(spark, texts)).collect()
    assert {(r["doc_id"], r["source_id"]) for r in got} == {(17, 16)}
    assert got[0]["word_start"] <= 62 and got[0]["word_end"] >= 135


def test_grown_ends_take_no_passage_away():
    rng = np.random.default_rng(4)
    mine = rng.integers(0, 2**32, 400, dtype=np.uint32)
    theirs = mine.copy()
    theirs[50 + np.flatnonzero(np.arange(350) % 8 >= 5)] = 0
    whole, core, *_ = substring_dedup.align(mine, theirs, [(0, 50, 0)])
    assert substring_dedup._share(whole) < 0.75 and core == (0, 50, 0, 50, 50)
    assert substring_dedup._accepted(mine, theirs, [(0, 50, 0)], 50, 0.75) == [(0, 50, 0, 50, 50, 1.0)]


def test_window_hashes():
    words = np.random.default_rng(6).integers(0, 3, 300).astype(np.uint64)
    for width in (1, 7, 64, 90, 400):
        got = substring_dedup.window_hashes(words, width)
        runs = [tuple(words[i : i + width].tolist()) for i in range(max(0, 301 - width))]
        assert len(got) == len(runs) and len(set(zip(runs, got.tolist()))) == len(set(runs)) == len(set(got.tolist()))


def test_a_chain_prefers_order_and_small_gaps():
    rows = np.array([[0, 20, 100], [22, 40, 122], [41, 60, 10], [60, 90, 160]])
    best = substring_dedup.chains(rows, least=10)[0]
    assert best.tolist() == [[0, 20, 100], [22, 40, 122], [60, 90, 160]]


# ------------------------------------------------------------------ packing, shards
def test_boundaries_are_optimal():
    rng = np.random.default_rng(2)
    for _ in range(30):
        lengths = np.unique(rng.integers(1, 60, rng.integers(1, 12)))
        counts = rng.integers(1, 9, len(lengths))
        k = int(rng.integers(1, 5))

        def cost(ends):
            return sum(c * (min(e for e in ends if e >= x) - x) for x, c in zip(lengths, counts))

        import itertools

        best = min(cost([*c, lengths[-1]]) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
        ends = packing.optimal_boundaries(lengths, counts, k)
        assert len(ends) <= max(k, 1) and cost(ends) == best


def test_packing(spark, corpus):
    got = packing.pack(spark, docs_of(spark, corpus), n_buckets=4, token_budget=700).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(corpus)))
    batches = collections.defaultdict(list)
    for r in got:
        assert r["n_tokens"] == len((corpus[r["doc_id"]] or "").encode().split()) + 1 and r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0
        batches[r["bucket"], r["batch"]].append((r["slot"], r["doc_id"], r["bucket_len"]))
    for rows in batches.values():
        rows.sort()
        assert [x[0] for x in rows] == list(range(len(rows))) and [x[1] for x in rows] == sorted(x[1] for x in rows)
        assert len(rows) == 1 or len(rows) * rows[0][2] <= 700


def test_packing_counts_tokens(spark, corpus):
    import corpus_pipeline

    ids, _ = reference_ids(corpus)
    docs = docs_of(spark, corpus)
    for frame in (packing.pack(spark, docs, n_buckets=4, token_budget=700, tokenizer_path=PATH), corpus_pipeline.packing(spark, docs, "")):
        got = frame.collect()
        assert sorted(r["doc_id"] for r in got) == list(range(len(corpus)))
        assert all(r["n_tokens"] == len(ids[r["doc_id"]]) + 1 and r["padding"] == r["bucket_len"] - r["n_tokens"] >= 0 for r in got)


def test_shards(spark, corpus):
    got = sorted(sharding.assign_shards(spark, docs_of(spark, corpus).repartition(4), 5).collect(), key=lambda r: r["doc_id"])
    size = [len((t or "").encode()) + 1 for t in corpus]
    assert [r["size"] for r in got] == size and [r["text_crc32"] for r in got] == [zlib.crc32((t or "").encode()) for t in corpus]
    assert [r["shard"] for r in got] == sorted(r["shard"] for r in got)
    for s in range(5):
        mine = [r for r in got if r["shard"] == s]
        assert [r["slot"] for r in mine] == list(range(len(mine)))
        assert abs(sum(r["size"] for r in mine) - sum(size) / 5) <= max(size)


# ------------------------------------------------------------------ quality
def test_quality_model(spark):
    rng = random.Random(9)
    texts, labels = [], []
    for i in range(400):
        junk = rng.random() < 0.25
        t = prose_of(rng, rng.randint(20, 200))
        texts.append("!! ".join(t.upper().split()) if junk else t)
        labels.append((i, int(not junk), 0))
    docs = docs_of(spark, [*texts, None, ""])
    lab = spark.createDataFrame([*labels, (None, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality_model.fit(spark, docs, lab)
    got = {r["doc_id"]: r["s"] for r in quality_model.score_quality(docs, model, out="s").collect()}
    held = [x for x in labels if zlib.crc32(str(x[0]).encode()) % 5 == 0]
    assert len(held) > 40 and np.mean([(got[i] >= 0.3) == bool(y) for i, y, _ in held]) > 0.97
    assert all(0 <= s <= 1 for s in got.values()) and 400 in got and 401 in got
    none = quality_model.fit(spark, docs, lab.where("false"))
    assert none.prior == 0.5 and np.isfinite(none.score(np.zeros((1, quality_model.WIDTH)))).all()


def test_texts_are_sent_once_to_be_scored(spark, corpus):
    docs = docs_of(spark, corpus)
    model = quality_model.QualityModel(np.linspace(-1, 1, quality_model.WIDTH), 1.0, 0.0, 0.5)
    scored = quality_model.score_quality(docs, model)
    plan = scored._jdf.queryExecution().analyzed().toString()
    project = plan[plan.index("MapInArrow") :].split("Project [")[1].split("]")[0]
    assert len(project.split(",")) == len(docs.columns)
    plain = {r["doc_id"]: r["score"] for r in quality_model.score_quality(docs.select("doc_id", F.col("text").alias("other"), "text"), model).collect()}
    assert len(plain) == len(corpus) and {r["doc_id"]: r["score"] for r in scored.collect()} == plain


def test_the_prior_comes_from_positives_and_unlabelled(spark):
    rng = random.Random(10)
    junk = [rng.random() < 0.4 for _ in range(3000)]
    texts = [("!! ".join(t.upper().split()) if j else t) for j in junk for t in [prose_of(rng, 30)]]
    docs = docs_of(spark, texts)
    # labels of positives alone, and far more of them than their share: the labelled share says 1.0
    lab = spark.createDataFrame([(i, 1, 0) for i, j in enumerate(junk) if not j][:1200], "doc_id long, quality int, toxic int")
    model = quality_model.fit(spark, docs, lab)
    assert abs(model.prior - (1 - np.mean(junk))) < 0.08


def test_the_model_is_the_brute_force_one(spark):
    """The weights, on all rows in memory, from the risk's own gradient."""
    rng = random.Random(11)
    texts = [prose_of(rng, rng.randint(5, 60)) if rng.random() < 0.6 else "".join(rng.choices("#$%ab 1", k=200)) for _ in range(300)]
    quality = [int("w" in t) for t in texts]
    docs = docs_of(spark, texts)
    lab = spark.createDataFrame([(i, q, 0) for i, q in enumerate(quality) if i % 2], "doc_id long, quality int, toxic int")
    model = quality_model.fit(spark, docs, lab)
    x = np.concatenate([quality_model.features(t) for t in common.slices(pa.array(texts))])
    used = [i for i in range(1, 300, 2) if quality[i] and zlib.crc32(str(i).encode()) % 5]

    def risk(w):
        g = x @ w
        loss = lambda z: ((1 - z) ** 2 / 4).mean()
        ridge = quality_model.RIDGE * (w[1:] @ w[1:] + 1e-3 * w[0] ** 2) / 2
        return model.prior * loss(g[used]) + max(0.0, loss(-g) - model.prior * loss(-g[used])) + ridge

    least, step, g = risk(model.weights), np.random.default_rng(0), x @ model.weights
    if ((1 + g) ** 2 / 4).mean() > model.prior * ((1 + g[used]) ** 2 / 4).mean() + 1e-6:  # inside the region without correction
        assert all(risk(model.weights + step.normal(0, 1e-3, len(model.weights))) > least - 1e-9 for _ in range(50))
    got = {r["doc_id"]: r["s"] for r in quality_model.score_quality(docs, model, out="s").collect()}
    want = 1 / (1 + np.exp(-np.clip(model.slope * (x @ model.weights) + model.shift, -40, 40)))
    assert np.allclose([got[i] for i in range(300)], want) and least < risk(np.zeros(len(model.weights)))


def test_held_out_labels_are_not_used(spark):
    texts = [prose_of(random.Random(i), 40) for i in range(60)]
    docs = docs_of(spark, texts)
    rows = [(i, int(i % 3 > 0), 0) for i in range(60)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in rows]
    a, b = (quality_model.fit(spark, docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (rows, turned))
    assert np.allclose(a.weights, b.weights) and a.prior == b.prior and np.isclose(a.slope, b.slope)


def test_the_risk_stays_non_negative():
    rng = np.random.default_rng(4)
    pos = np.c_[np.ones(30), rng.normal(2, 1, (30, 3))]
    every = np.c_[np.ones(40), rng.normal(2, 1, (40, 3))]
    moments = [m for x in (every, pos) for m in (x.T @ x / len(x), x.mean(0))]
    w = quality_model.minimise_risk(0.97, moments[0], moments[1], moments[2], moments[3])
    assert np.isfinite(w).all()


def test_quality_rules(spark, corpus):
    got = {r["doc_id"]: r for r in quality_rules.judge_quality(spark, docs_of(spark, corpus)).collect()}
    for i, t in enumerate(corpus):
        t = t or ""
        w = [x for x in re.split("[ \t\n\x0b\x0c\r]+", t) if x]
        lines = [x for x in t.split("\n") if re.search("[^ \t\n\x0b\x0c\r]", x)]
        count = collections.Counter(tuple(w[j : j + 3]) for j in range(len(w) - 2))
        cover = {p for j in range(len(w) - 2) if count[tuple(w[j : j + 3])] > 1 for p in (j, j + 1, j + 2)}
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(cover))
        r = got[i]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, i
        assert r["base_failed"] == (len(w) < 50 or 100 * len(cover) > 50 * len(w)) and not (r["base_failed"] and r["kept"])


def test_quality_rules_tell_junk(spark):
    rng = random.Random(2)
    good = [" ".join(rng.choice("the of and to in cats dogs house river mountain green walk talk quiet".split()) + rng.choice(["", "", f"x{rng.randrange(99)}".replace("x", "")]) for _ in range(200)) for _ in range(60)]
    junk = [re.sub(" ", "!!%% ", t.upper()) for t in good[:6]]
    got = {r["doc_id"]: r for r in quality_rules.judge_quality(spark, docs_of(spark, good + junk)).collect()}
    assert all(got[i]["kept"] or got[i]["base_failed"] for i in range(60))
    assert not any(got[i]["kept"] for i in range(60, 66))


def test_quality_rules_tell_gibberish_and_wrong_languages(spark):
    rng = random.Random(8)

    def written(lang, n):
        common = quality_rules.COMMON_WORDS[lang]
        return " ".join(rng.choice(common) if rng.random() < 0.27 else "".join(rng.choices("aeilnorst", k=7)) for _ in range(n))

    langs = list(quality_rules.COMMON_WORDS)
    good = [(written(a, n), a) for a in langs for n in [60, 80, 120, 300, 1000] * 12]
    salad = [(" ".join("".join(rng.choices("aeilnorst", k=rng.randint(3, 9))) for _ in range(n)), a) for a in langs for n in (60, 100, 300)]
    wrong = [(written(b, 400), a) for a in langs for b in langs if a != b]
    texts = good + salad + wrong
    docs = spark.createDataFrame([(i, t, a, "s", len(t)) for i, (t, a) in enumerate(texts)], SCHEMA)
    got = {r["doc_id"]: r for r in quality_rules.judge_quality(spark, docs).collect()}
    assert not any(r["base_failed"] for r in got.values())
    assert all(got[i]["kept"] for i in range(len(good)))
    assert [texts[i][1] for i in range(len(good), len(texts)) if got[i]["kept"]] == []


# ------------------------------------------------------------------ nearest neighbours
def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16)).astype(np.float32)
    x[700:900] = x[0]
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    odd = [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [1.0, None]), (2004, []), (None, rows[0][1]), (2005, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in ann.nearest(spark, df, df.where("vec_id % 50 = 0"), shard_rows=400).collect():
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    exact = x.astype(np.float64)
    hit = 0
    assert len(got) == 30
    for q, rows_ in got.items():
        rows_.sort()
        d = np.sqrt(((exact - exact[q]) ** 2).sum(1))
        want = sorted((d[i], i) for i in range(1500) if i != q)[:10]
        assert [r[0] for r in rows_] == list(range(1, 11)) and [(r[1], r[2]) for r in rows_] == sorted((r[1], r[2]) for r in rows_)
        assert all(np.isclose(s, d[v], atol=1e-12) for _, s, v in rows_)
        hit += len({v for _, _, v in rows_} & {i for _, i in want})
    assert hit / 300 >= 0.95
    assert [v for _, _, v in got[0]] == list(range(700, 710))


@pytest.mark.parametrize("scale", [1e-30, 1.0, 1e25])
def test_nearest_at_any_scale(spark, scale):
    rng = np.random.default_rng(5)
    x = (rng.normal(size=(300, 8)) + 3.0) * scale
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(300)], "vec_id long, embedding array<double>")
    got = ann.nearest(spark, df, df.where("vec_id % 100 = 0"), shard_rows=100).collect()
    for q in (0, 100, 200):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        want = [i for _, i in sorted((d[i], i) for i in range(300) if i != q)[:10]]
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_graphs_are_not_copied(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(50)], "vec_id long, embedding array<double>")
    plan = ann.nearest(spark, df, df, shard_rows=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("Generate explode") == 1 and "CoGroup" not in plan


def test_an_id_with_several_vectors_is_found_once(spark):
    rows = [(100, [1.0, 0.0]), (1, [1.0, 0.1]), (1, [1.0, 0.2]), (1, [1.0, 0.1]), (2, [1.0, 0.3]), (100, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("rank", F.lit(2))
    got = ann.nearest(spark, df, df.where("vec_id = 100")).orderBy("rank").collect()
    assert [(r["rank"], r["vec_id"]) for r in got] == [(1, 1), (2, 2)] and np.isclose(got[0]["score"], 0.1)


def test_few_vectors(spark):
    df = spark.createDataFrame([(100, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [3.0, 4.0, 5.0])], "vec_id long, embedding array<double>")
    got = ann.nearest(spark, df, df.where("vec_id % 100 = 0")).collect()
    assert [(r["query_id"], r["rank"], r["vec_id"]) for r in got] == [(100, 1, 1)] and np.isclose(got[0]["score"], 2**0.5)


# ------------------------------------------------------------------ empty tables, the pipeline
def test_empty_tables(spark):
    none = docs_of(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    frames = [
        line_dedup.dedup_lines(spark, none), packing.pack(spark, none), sharding.assign_shards(spark, none), chunk_bpe.encode_decode(spark, none, PATH),
        substring_dedup.find_passages(spark, none), substring_dedup.remove_passages(spark, none), minhash.near_duplicates(spark, none),
        quality_rules.judge_quality(spark, none), quality_model.score_quality(none, quality_model.fit(spark, none, labels)),
        ann.nearest(spark, spark.createDataFrame([], "vec_id long, embedding array<float>"), spark.createDataFrame([], "vec_id long, embedding array<float>")),
    ]
    assert all(f.count() == 0 for f in frames)


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            docs = common.Workspace(spark, "test").save(out, "stage")
            assert docs.where(F.length("text") != F.col("n_chars")).count() == 0
        seen.append(out.count())
    assert seen == sorted(seen, reverse=True) and seen[-1] > 0.6 * seen[0] and seen[-1] == seen[-2]
    assert corpus_pipeline.run(spark, sf).count() == seen[-1]
