"""Language ID, byte-level BPE, decontamination and LM scoring."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from rasterloom.llm.byte_bpe import ByteBPE, _ranks, pieces
from rasterloom.llm.decontaminate import align, contaminated, without_leaks, words
from rasterloom.llm.language_id import LanguageProfiles, TrigramSpace
from rasterloom.llm.lm_score import MaskedScorer, WindowNetwork
from rasterloom.llm.queries import op1_language_id

LETTERS = {"xx": "abcdefgh", "yy": "ijklmnop", "zz": "äöüßqrst"}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(LETTERS[lang]) for _ in range(rng.randint(1, 7))) for _ in range(n))


def test_language_id(spark):
    rng = random.Random(3)
    train = [(sentence(rng, lang, 30), lang, "x") for lang in LETTERS for _ in range(20)] + [(None, "xx", "x"), ("abc", None, "x")]
    model = LanguageProfiles(dim=512).fit(spark.createDataFrame(train, "text string, lang string, p string"))
    assert model.languages == ["xx", "yy", "zz"]
    tests = [(sentence(rng, lang, n), lang) for lang in LETTERS for n in (3, 30, 20_000)] + [(None, "und"), ("", "und"), ("12 !?", "und")]
    found = model.predict(spark.createDataFrame([(t, w, 1.0) for t, w in tests], "text string, wanted string, score double")).collect()
    assert all(r["lang_pred"] == r["wanted"] and 0 <= r["score"] <= 1 for r in found)


def test_language_query_against_brute_force(spark, tmp_path):
    """op1 whole: bundles of the rows that are not held out, one trigram after the other, and each row's nearest one."""
    rng = random.Random(12)
    rows = [(i, sentence(rng, lang, rng.randint(1, 12)), lang if rng.random() < 0.9 else None) for i, lang in enumerate(rng.choice(list(LETTERS)) for _ in range(160))]
    rows += [(200, None, "xx"), (201, "", "yy"), (202, "12 !?", "zz"), (203, "ÄÖ ab\tij  ", None), (204, "a" * 5_000, "xx"), (205, "x", "other")]
    rows += rows[:5]  # repeated rows, and ties between equal texts
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([(i, t, lang, "s", 0) for i, t, lang in rows], schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    out = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    space = TrigramSpace(1024, 7)

    def bundle(text):
        letters = f" {' '.join(''.join(c if c.isalpha() else ' ' for c in (text or '').lower()).split())} "
        total = np.zeros(1024)
        for k in range(len(letters) - 2 if letters.strip() else 0):
            a, b, c = map(ord, letters[k : k + 3])
            total += space.vector((a << 42) | (b << 21) | c)
        norm = np.linalg.norm(total)
        return total / norm if norm else total

    sums = {}
    for i, t, lang in rows:
        if lang is not None and t is not None and not out(i):
            sums[lang] = sums.get(lang, 0) + bundle(t)
    names = sorted(sums)
    prototypes = np.array([sums[n] / (np.linalg.norm(sums[n]) or 1) for n in names])
    found = op1_language_id(spark, f"file://{tmp_path}").collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in found:
        own = bundle(texts[r["doc_id"]])
        assert r["held_out"] == out(r["doc_id"])
        if not own.any():
            assert (r["lang_pred"], r["score"]) == ("und", 0)
            continue
        cosine = prototypes @ own
        assert abs(cosine[names.index(r["lang_pred"])] - cosine.max()) < 1e-4 and abs(r["score"] - max(0, cosine.max())) < 1e-3


def test_language_id_without_labels(spark):
    none = spark.createDataFrame([], "text string, lang string")
    model = LanguageProfiles(dim=64).fit(none)
    assert [r["lang_pred"] for r in model.predict(spark.createDataFrame([("abc",)], "text string")).collect()] == ["und"]
    assert model.predict(none).count() == 0


def test_bundles_do_not_depend_on_the_memory_bound():
    texts = ["the quick brown fox", "ἄλφα βῆτα", "x", None, "12"]
    a, b = TrigramSpace(128, 1).bundles(texts), TrigramSpace(128, 1, keep=6).bundles(texts)
    assert np.allclose(a, b, atol=1e-5)
    space = TrigramSpace(128, 1)
    own = sum(space.vector((ord(x) << 42) | (ord(y) << 21) | ord(z)) for x, y, z in (" ab", "abc", "bc ")).astype(float)
    assert np.allclose(space.bundles(["ABC"])[0], own / np.linalg.norm(own), atol=1e-5)


BPE_TEXTS = [
    None, "", " ", "hello world", "  two  spaces \n\n\t tabs  ", "don't we'll 'tis 're''s", "naïve café 日本語 😀  　 x",
    "a" * 500, " " * 300 + "b", "1234567890" * 40, "'" * 99 + "re", "word " * 400, "x\u0085y\x1cz\n" * 50, "!?" * 200 + "\r\n" * 60,
]


@pytest.mark.parametrize("chunk,overlap", [(64, 32), (17, 9), (1_024, 128)])
def test_byte_bpe_equals_the_library_and_round_trips(spark, chunk, overlap):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe = ByteBPE(path, public_tokenizers.PATTERN, chunk, overlap)
    rng = random.Random(chunk)
    texts = BPE_TEXTS + ["".join(rng.choice("ab 1'rest\n!é ") for _ in range(rng.randint(1, 900))) for _ in range(60)]
    rows = [(i, t, "n") for i, t in enumerate(texts)] + [(0, "same " * 50, "n")] * 2 + [(None, "no id", "n")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, k string")
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
    found = bpe.decode(bpe.encode(df)).collect()
    assert len(found) == len(rows)
    for r in found:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"] or "")
        assert bytes(r["decoded"]).decode() == (r["text"] or "")


def test_byte_bpe_round_trip_is_one_python_pass(spark):
    """A task that encodes and decodes needs one Python worker, not one for each."""
    bpe = ByteBPE(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, 64, 32, 2)
    texts = [*BPE_TEXTS, "word " * 400, "x" * 700 + " end"]  # some longer than a section of 128
    df = spark.createDataFrame([(i % 9 or None, t, "n") for i, t in enumerate(texts)], "doc_id bigint, text string, decoded string").repartition(3)
    key = lambda r: (r["text"] or "", r["text"] is None, r["doc_id"] or 0)
    both, one = bpe.decode(bpe.encode(df)), bpe.round_trip(df)
    found = sorted(one.collect(), key=key)
    assert found == sorted(both.select(*one.columns).collect(), key=key)
    assert all(bytes(r["decoded"]).decode() == (r["text"] or "") for r in found)
    bare = bpe.round_trip(df, drop=["text"])
    assert sorted(bare.columns) == ["decoded", "doc_id", "ids"] and bare.count() == len(texts)
    short = bpe.round_trip(df.where("length(text) < 50"), drop=["text"])
    plan = short._jdf.queryExecution().optimizedPlan().toString().split("Union", 1)[1]
    assert plan.split("\n:- ", 1)[1].split("\n+- ", 1)[0].count("MapInArrow") == 1


def test_pieces_of_ordinary_texts():
    """The texts that queries meet are cut as well, and their pieces encode to the ids of the whole."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
    rng = random.Random(8)
    plain = " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 9))) for _ in range(3_000))
    assert len(pieces(plain, public_tokenizers.PATTERN, 1_024, 128)) == -(-len(plain) // 1_024)
    texts = [plain, "x" * 5_000 + plain, plain[:2_000] + " " * 1_500 + plain, "".join(rng.choice("ab 1'rest\n!é \u0085日") for _ in range(9_000)), ""]
    for size, overlap in ((1_024, 128), (64, 32), (17, 9)):
        for text in texts:
            cut = pieces(text, public_tokenizers.PATTERN, size, overlap)
            assert "".join(cut) == text
            assert [i for piece in cut for i in library.encode_ordinary(piece)] == library.encode_ordinary(text)


def test_byte_bpe_of_long_texts(spark):
    """Texts of many sections, some of which do not resynchronise."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    bpe, rng = ByteBPE(path, public_tokenizers.PATTERN), random.Random(31)
    texts = ["".join(rng.choice("abcdé fgh 1'\n!日") for _ in range(n)) for n in (100_000, 300_001, 32_768, 32_769, 65_536)] + ["x" * 120_000 + " end", "word " * 60_000]
    df = spark.createDataFrame([(None if i == 1 else i % 3, t, "n") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    library = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
    found = bpe.decode(bpe.encode(df)).collect()
    assert sorted(r["text"] for r in found) == sorted(texts)
    for r in found:
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode_ordinary(r["text"])
        assert bytes(r["decoded"]).decode() == r["text"]
    none = df.limit(0)
    assert bpe.decode(bpe.encode(none)).count() == 0


def brute_align(a, b):
    h, best = np.zeros((len(b) + 1, len(a) + 1), int), 0
    for j in range(1, len(b) + 1):
        for i in range(1, len(a) + 1):
            h[j, i] = max(0, h[j - 1, i - 1] + (2 if a[i - 1] == b[j - 1] else -1), h[j - 1, i] - 1, h[j, i - 1] - 1)
            best = max(best, h[j, i])
    return best / (2 * len(b))


def test_alignment():
    rng = random.Random(2)
    pairs = [([rng.randrange(5) for _ in range(rng.randint(1, 25))], [rng.randrange(5) for _ in range(rng.randint(1, 15))]) for _ in range(60)]
    assert align([a for a, _ in pairs], [b for _, b in pairs]).tolist() == [brute_align(a, b) for a, b in pairs]


@pytest.fixture(scope="module")
def leaks(spark):
    rng = random.Random(4)
    text = lambda n: " ".join(f"v{rng.randrange(3000)}" for _ in range(n))
    items = [(k, text(rng.randint(15, 50))) for k in range(20)] + [(20, "two words"), (21, None), (22, "")]
    docs, wanted = [], set()
    for d in range(60):
        body, own = text(rng.choice([5, 300])), None
        if d % 3 == 0:
            own, edited = d % 20, []
            for i, w in enumerate(items[d % 20][1].split()):
                edited += [] if d % 2 and i % 9 == 4 else [f"new{i}"] if d % 2 and i % 9 == 8 else [w.upper() + ","]
            body = body + " " + " ".join(edited) + " " + text(40)
            wanted.add((d, own))
        docs.append((d, body, "c"))
    docs += [(100, None, "c"), (101, "", "c"), (102, "It has Two  words.", "c"), (103, " ".join(f"v{k % 7}" for k in range(20_000)), "c"), docs[0]]
    wanted.add((102, 20))
    return spark.createDataFrame(docs, "doc_id bigint, text string, item_id string"), spark.createDataFrame(items, "item_id bigint, text string"), wanted


def test_contaminated(leaks):
    docs, items, wanted = leaks
    found = contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == wanted and len(found) == len(wanted)
    texts = {r["doc_id"]: words(r["text"]) for r in docs.collect()}
    tests = {r["item_id"]: words(r["text"]) for r in items.collect()}
    for r in found:  # the score is that of the whole document
        if len(texts[r["doc_id"]]) < 1000:
            assert abs(brute_align(texts[r["doc_id"]], tests[r["item_id"]]) - r["score"]) < 1e-6


def test_many_edited_copies_beside_a_verbatim_one(spark):
    item = [f"q{k}" for k in range(40)]
    edited = lambda d: " ".join(f"e{d}" if k % 5 == 4 else w for k, w in enumerate(item))
    docs = [(d, f"before {edited(d)} after") for d in range(60)] + [(60, " ".join(item)), (61, "q0 q1 q2 and nothing else")]
    found = contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id bigint, text string"))
    assert {r["doc_id"]: r["seeds"] for r in found.collect()} == dict.fromkeys(range(60), 24 - 8) | {60: 38}


def test_without_leaks(leaks):
    docs, items, wanted = leaks
    found = without_leaks(docs, items)
    assert found.columns == docs.columns
    bad = {d for d, _ in wanted}
    assert {r["doc_id"] for r in found.collect()} == {r["doc_id"] for r in docs.collect()} - bad


def edited(rng, item, rate):
    out = []
    for w in item:
        kind = rng.random() / rate
        out += [f"n{rng.randrange(10**6)}"] if kind < 1 / 3 else [] if kind < 2 / 3 else [w, f"n{rng.randrange(10**6)}"] if kind < 1 else [w]
    return out


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_recall_of_edited_copies(spark, monkeypatch, broadcast_rows):
    """Every pair by full alignment, words changed, dropped and added at rates of 10 to 33 %; seeds broadcast and shuffled."""
    monkeypatch.setattr("rasterloom.llm.decontaminate.BROADCAST_ROWS", broadcast_rows)
    rng = random.Random(21)
    items = [[f"v{rng.randrange(4000)}" for _ in range(rng.randint(8, 40))] for _ in range(12)]
    third = [w if k % 3 else f"z{k}" for k, w in enumerate(items[0])]
    docs = [third] + [edited(rng, rng.choice(items), rng.choice([0.1, 0.2, 0.33])) for _ in range(150)]
    docs = [[f"v{rng.randrange(4000)}" for _ in range(20)] + d + [f"v{rng.randrange(4000)}" for _ in range(20)] for d in docs]
    wanted = {(d, k) for d, doc in enumerate(docs) for k, item in enumerate(items) if brute_align(doc, item) >= 0.5}
    found = contaminated(
        spark.createDataFrame([(d, " ".join(x)) for d, x in enumerate(docs)], "doc_id bigint, text string"),
        spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id bigint, text string"))
    found = {(r["doc_id"], r["item_id"]) for r in found.collect()}
    assert found <= wanted and len(found) >= 0.98 * len(wanted) and len(wanted) > 100


def test_without_leaks_tells_rows_apart(spark):
    item = " ".join(f"q{k}" for k in range(20))
    rows = [(None, item, "m"), (None, "clean text", "m"), (None, None, "m"), (3, "see " + item, "m"), (3, "clean again", "m"), (4, "from no id " * 5, "m")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, mark string")
    bench = spark.createDataFrame([(1, item), (None, "from no id from no id")], "item_id bigint, text string")
    kept = without_leaks(df, bench)
    assert kept.columns == df.columns
    assert sorted(map(str, (r["text"] for r in kept.collect()))) == ["None", "clean again", "clean text"]


def test_decontaminate_empty_tables(spark, leaks):
    docs, items, _ = leaks
    assert contaminated(docs, items.limit(0)).count() == 0
    assert contaminated(docs.limit(0), items).count() == 0


def test_network_learns_both_sides():
    """Gradient steps lower the loss where the middle word depends on both neighbours."""
    rng = np.random.default_rng(0)
    context = rng.integers(1, 9, (4096, 4)).astype(np.int32)
    wanted = (context[:, 1] + context[:, 2]) % 8
    net = WindowNetwork()
    loss = lambda: -net.log_classes(context)[np.arange(4096), wanted].mean()
    before = loss()
    for _ in range(150):
        net.step(context, wanted, 0.5)
    assert loss() < before - 1.5
    assert np.allclose(np.exp(net.log_classes(context)).sum(axis=1), 1, atol=1e-4)
    again = WindowNetwork.unpack(net.pack())
    assert np.array_equal(again.log_classes(context), net.log_classes(context))


def test_lm_scores(spark):
    rng = random.Random(8)
    ordered = lambda: " ".join(f"a{k % 12} b{k % 12}" for k in range(rng.randrange(12), 60))
    rows = [(i, ordered(), 1.0) for i in range(400)]
    shuffled = ordered().split()
    rng.shuffle(shuffled)
    rows += [(1000, " ".join(shuffled), 1.0), (1001, None, 1.0), (1002, "", 1.0), (1003, "a1 " * 20_000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, score double")
    model = MaskedScorer(rounds=6).fit(df)
    found = {r["doc_id"]: r for r in model.score(df).collect()}
    assert found[1000]["mean_score"] < min(found[i]["mean_score"] for i in range(400))
    assert found[1001]["n_tokens"] == found[1002]["n_tokens"] == 0 and found[1001]["score"] == 0 and found[1001]["mean_score"] is None
    assert found[1003]["n_tokens"] == 20_000
    text = rows[0][1]
    net, own = WindowNetwork.unpack(model.flat), __import__("rasterloom.llm.lm_score", fromlist=["x"])
    ids = own.tokens(text)
    direct = sum(net.log_classes(own.contexts(ids)[i : i + 1])[0, ids[i] % own.CLASSES] + model.log_share[ids[i]] for i in range(len(ids)))
    assert abs(direct - found[0]["score"]) < 1e-2
    none = df.limit(0)
    assert MaskedScorer().fit(none).score(none).count() == 0
    assert df.agg(F.count("*")).first()[0] == len(rows)


@pytest.mark.parametrize("word", ["window", "river", "winter", "paper"])
def test_every_position_is_a_target_in_every_round(spark, word):
    """With the query's own rounds; a choice of positions by place and token would pass a word by."""
    df = spark.createDataFrame([(word,)] * 40, "text string")
    before = MaskedScorer(rounds=0).fit(df).score(df).first()["score"]
    for rounds in ({"rounds": 1}, {}):
        model = MaskedScorer(**rounds).fit(df)
        model.log_share[:] = 0  # the network's part alone
        after = model.score(df).first()["score"]
        assert after > before + 0.1
        before = after
