"""Whitening, periodic runs and batched BPE, operators and queries, against brute force."""

import hashlib
import random
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rasterloom.llm.batch_bpe import BatchBPE, splitter
from rasterloom.llm.periodic_runs import WORD, runs, with_runs
from rasterloom.llm.queries import op11_whitening, op12_periodic_runs, op13_batch_bpe
from rasterloom.llm.whitening import Whitening, lobpcg

SF = "/root/testdata/sf0.001"
DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def folder(spark, path: Path, rows, schema: str, name: str) -> str:
    spark.createDataFrame(rows, schema).write.parquet(f"file://{path}/{name}.parquet")
    return f"file://{path}"


# Whitening.


def expected_whitening(vectors, k=32):
    x = np.floor(64 * np.array(vectors, float)).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    y = (n * x - s) / n
    values, turn = np.linalg.eigh(y.T @ y / n)
    values, turn = values[::-1][:k], turn[:, ::-1][:, :k]
    return ((n * x - s) ** 2).sum(axis=1), y @ turn / np.sqrt(values), values / np.square(y).sum() * n


def check_whitening(found, vectors, keys):
    deviation, white, explained = expected_whitening(vectors)
    k = white.shape[1]
    got = {(r["vec_id"], r["component"]): r for r in found}
    assert len(found) == len(got) == len(keys) * k
    for c in range(k):
        column = np.array([got[key, c + 1]["whitened"] for key in keys])
        assert min(np.abs(column - white[:, c]).max(), np.abs(column + white[:, c]).max()) < 1e-7
    for key, dev in zip(keys, deviation.tolist(), strict=True):
        r = got[key, 1]
        assert r["deviation"] == dev and r["n"] == len(keys) and r["identity_error"] < 1e-9
        assert abs(r["explained"] / explained[0] - 1) < 1e-9


def test_whitening_query(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    check_whitening(op11_whitening(spark, SF).collect(), [r["embedding"] for r in rows], [r["vec_id"] for r in rows])


def test_whitening_leaves_out_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(5)
    good = [(i, rng.normal(0, 1 + i % 3, 5).tolist()) for i in range(40)] + [(100, [1e4] * 5)]
    odd = [(200, None), (201, []), (202, [1.0, None, 1.0, 1.0, 1.0]), (203, [float("nan")] * 5), (204, [float("-inf")] * 5), (205, [1.0])]
    path = folder(spark, tmp_path, good + odd, "vec_id bigint, embedding array<double>", "embeddings")
    check_whitening(op11_whitening(spark, path).collect(), [v for _, v in good], [k for k, _ in good])


def test_whitening_of_few_and_equal_rows(spark):
    table = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, whitened string")
    none = table([])
    assert Whitening().fit(none).transform(none).collect() == []
    same = table([(None, [1.0, 2.0], "x")] * 3)
    fitted = Whitening().fit(same)
    assert [(r["whitened"], r["deviation"]) for r in fitted.transform(same).collect()] == [([None, None], 0)] * 3
    line = table([(i, [float(i), 2.0 * i, 0.0], "x") for i in range(9)])
    found = Whitening().fit(line)
    white = [r["whitened"] for r in found.transform(line).collect()]
    assert all(w[0] is not None and w[1:] == [None, None] for w in white) and found.identity_error < 1e-9


def test_whitening_keeps_great_numbers_exact(spark):
    rows = [(i, [float(v)]) for i, v in enumerate([0, 1e13, -1e13, 3e38])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    x = [min(int(64 * v[0]), 2**53) + 1_000_000 for _, v in rows]
    got = {r["vec_id"]: int(r["deviation"]) for r in Whitening().fit(df).transform(df).collect()}
    assert got == {i: (4 * v - sum(x)) ** 2 for i, v in enumerate(x)}


def test_lobpcg_iterates_to_certified_residuals():
    rng = np.random.default_rng(1)
    q = np.linalg.qr(rng.standard_normal((300, 300)))[0]
    a = q * np.concatenate([np.arange(20, 0, -1.0) + 5, rng.random(280) * 4]) @ q.T
    passes = []
    product = lambda b: passes.append(b.shape[1]) or a @ b
    values, vectors = lobpcg(product, 300, 12, 4, 1e-12, 200)
    assert 5 < len(passes) < 100 and max(passes) <= 48
    assert np.allclose(values, np.arange(25, 13, -1)) and np.allclose(np.abs((q[:, :12] * vectors).sum(axis=0)), 1)
    with pytest.raises(ArithmeticError):
        lobpcg(product, 300, 12, 4, 1e-12, 3)


# Periodic runs.


def brute_runs(ids, shortest=12):
    found = {}
    for q in range(1, len(ids) // 2 + 1):
        i = 0
        while i + q < len(ids):
            j = i
            while j + q < len(ids) and ids[j] == ids[j + q]:
                j += 1
            if j > i and j + q - i >= max(shortest, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


@pytest.mark.parametrize("shortest", [2, 3, 5, 12])
def test_runs_equal_brute_force(shortest):
    rng = random.Random(shortest)
    for _ in range(600):
        letters, n = rng.choice([1, 2, 3, 50]), rng.randrange(90)
        ids = [rng.randrange(letters) for _ in range(n)]
        if n and rng.random() < 0.7:
            a = rng.randrange(n)
            p = 1 + rng.randrange(1 + (n - a) // 3)
            ids = [ids[i] if i < a else ids[a + (i - a) % p] for i in range(n)]
        ids *= rng.choice([1, 1, 2, 3])
        assert runs(ids, shortest) == brute_runs(ids, shortest)


def test_runs_of_long_texts():
    assert runs([0] * 300_000) == [(0, 300_000, 1)]
    assert runs(list(range(5_000)) * 40) == [(0, 200_000, 5_000)]
    assert runs(list(range(300_000))) == []


def expected_runs(doc_id, text):
    words = WORD.findall(text or "")
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    numbers = {}
    found = brute_runs([numbers.setdefault(w, len(numbers)) for w in words])
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (
        doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None,
        sha("".join(f"{s},{length},{q}\n" for s, length, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)),
    )


def test_periodic_runs_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate([None, "", " \t ", "a", "x " * 40, "a b c " * 9 + "a b d", "  lead " + "u v w " * 7, "été 日本 " * 30 + "ß"])]
    rows += [(r["doc_id"] + 1000, r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r["text"] or "") < 6_000]
    rows += [(i, f"{i} b c d e f g h i j k l m n o p q r s t u v w x y z") for i in range(20_000, 20_300)]
    rows += rows[3:6]
    tailed = [i for i in range(30_000, 30_200) if zlib.crc32(str(i).encode()) % 10 == 0]
    rows += list(zip(tailed, [None, "", " \n ", "a", "a b", "a b c d e f g h " * 4, "z " * 30], strict=False))
    path = folder(spark, tmp_path, [(*r, "en", "s", 1) for r in rows], DOCUMENTS, "documents")
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, op12_periodic_runs(spark, path).collect()), key=key) == sorted((expected_runs(*r) for r in rows), key=key)


def test_runs_of_odd_tables(spark):
    df = spark.createDataFrame([(None, "z " * 20, "own")], "doc_id bigint, text string, runs string")
    row = with_runs(df).first()
    assert (row["doc_id"], row["n_words"], [tuple(r) for r in row["runs"]], row["collapsed"]) == (None, 20, [(0, 20, 1)], "z")
    assert with_runs(df.limit(0)).collect() == []


# BPE.


def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def own():
    return BatchBPE(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


BPE_TEXTS = [
    None, "", " ", "hello world", "  two  spaces \n\n\t tabs  ", "don't we'll 'tis 're''s", "naïve café 日本語 😀  　 x", "aaaaa" * 101, " " * 300 + "b",
    "<|endoftext|>", "a<|endoftext|><|endoftext|> b  <|endoftext|>", "<|endof<|endoftext|>text|>", "1234567890" * 40, "x\u0085y\x1cz\x00" * 50, "՘࢏Ᲊ ꟎!",
]


def test_batch_bpe_equals_the_library(spark):
    rng = random.Random(4)
    parts = ["a", "b", "the", " the", "  ", "\n", "1", "!", "'s", "é", "漢", "<|endoftext|>", "|>", " ", "Q"]
    texts = BPE_TEXTS + ["".join(rng.choice(parts) for _ in range(rng.randrange(200))) for _ in range(200)]
    texts += ["".join(rng.choice("abcdefghij") for _ in range(30_000)), "word and others " * 20_000]
    df = spark.createDataFrame([(i, t, b"x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids binary")
    bpe, lib = own(), library()
    found = bpe.decode(bpe.encode(df)).collect()
    assert len(found) == len(texts)
    for r in found:
        wanted = lib.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert np.frombuffer(r["ids"], "<u4").tolist() == wanted
        assert r["decoded"] == lib.decode(wanted, skip_special_tokens=False) == (texts[r["doc_id"]] or "")


def test_decoding_of_parts_equals_the_library(spark):
    rng = np.random.default_rng(2)
    some = [rng.integers(0, 50_257, rng.integers(0, 9)) for _ in range(300)]
    df = spark.createDataFrame([(i, x.astype("<u4").tobytes()) for i, x in enumerate(some)] + [(None, None)], "k int, ids binary")
    lib = library()
    for r in own().decode(df).collect():
        assert r["decoded"] == ("" if r["k"] is None else lib.decode(some[r["k"]].tolist(), skip_special_tokens=False))


def test_words_are_cut_as_by_the_library_at_every_character():
    pre, words = library().pre_tokenizer, splitter(public_tokenizers.PATTERN)
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 5_000):
        text = "".join(f"a{c}1{c}{c} {c}!{c} \n" for c in map(chr, points[at : at + 5_000]))
        ends = np.cumsum([len(w) for w in words.findall(text)]).tolist()
        assert ends == [end for _, (_, end) in pre.pre_tokenize_str(text)]


def test_batch_bpe_query(spark):
    lib, sha = library(), lambda raw: hashlib.sha256(raw).hexdigest()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = op13_batch_bpe(spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert tuple(r)[1:] == (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False).encode()))


def test_batch_bpe_of_an_empty_table(spark):
    none = spark.createDataFrame([], "text string, ids string")
    assert own().encode(none).select(F.col("ids")).collect() == []
