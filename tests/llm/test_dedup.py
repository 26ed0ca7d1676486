"""Exact, near and substring deduplication against brute force."""

import hashlib
import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from rasterloom.llm.exact_dedup import MergeIndex, RunFilter, exact_groups, without_copies
from rasterloom.llm.simhash_dedup import fingerprint, near_duplicates, without_near_copies
from rasterloom.llm.substring_dedup import without_repeats
from rasterloom.llm.components import components

SCHEMA = "doc_id bigint, text string, kept string, digest string"


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    texts = [words(rng, rng.choice([1, 3, 8, 60, 200])) for _ in range(60)]
    for k in range(40):  # copies, copies with other white space, and edited ones
        t = rng.choice(texts).split(" ")
        if k % 3 == 1:
            t = [x + rng.choice(["", "\n", "\t "]) for x in t]
        if k % 3 == 2 and len(t) > 20:
            t[rng.randrange(len(t))] = f"edit{k}"
        texts.append(" ".join(t))
    shared = words(rng, 70)
    texts += [words(rng, 30) + " " + shared + " " + words(rng, 20) for _ in range(8)]
    texts += [None, "", " ", "\n", "é ß Ünï", words(rng, 6000), None]
    out = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(out)
    return out + [out[0], out[5]] + [(None, "no id"), (None, out[3][1]), (None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA).repartition(3)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def brute_exact(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        own = groups[norm(t)]
        keep = min((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), keep == i, hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=str)


def test_exact_groups(docs, rows):
    found = exact_groups(docs).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")))
    assert sorted(map(tuple, found.collect()), key=str) == brute_exact(rows)


def test_exact_groups_when_digests_collide(docs, rows):
    weak = lambda text: (F.length(text) % 5).cast("string").cast("binary")
    found = exact_groups(docs, digest=weak).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([x[:4] for x in brute_exact(rows)], key=str)


@pytest.mark.parametrize("flushes,fanout,left", [(1, 2, [1]), (4, 2, [0, 0, 1]), (7, 3, [1, 2])])
def test_runs_are_flushed_merged_and_probed(spark, flushes, fanout, left):
    rng = random.Random(flushes)
    batches = [[(rng.choice([None, rng.randrange(100)]), f"d{rng.randrange(60)}".encode()) for _ in range(50)] for _ in range(flushes)]
    index = MergeIndex(fanout)
    for batch in batches:
        index.flush(spark.createDataFrame(batch, "doc_id bigint, digest binary"))
    assert [len(x) for x in index.levels] == left
    wanted = {}
    for i, d in (row for batch in batches for row in batch):
        keep, n = wanted.get(d, (None, 0))
        wanted[d] = (i if keep is None else keep if i is None else min(keep, i), n + 1)
    level = index.compact()
    assert {bytes(r["digest"]): (r["keep_id"], r["n"]) for r in level.collect()} == wanted
    often = {d for d, (_, n) in wanted.items() if n > 1}
    asked = [(f"d{k}".encode(),) for k in range(2000)]
    passed = {bytes(r["digest"]) for r in RunFilter(level.where("n > 1").select("digest")).hits(spark.createDataFrame(asked, "digest binary")).collect()}
    assert often <= passed and len(passed) < len(often) + 60


def test_without_copies_keeps_columns_and_one_row_of_each_text(docs, rows):
    found = without_copies(docs)
    assert found.columns == docs.columns
    kept = found.collect()
    assert sorted(norm(r["text"]) for r in kept) == sorted({norm(t) for _, t in rows})


def brute_fingerprint(text):
    own = (text or "").encode().lower().split()
    if not own:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(own[i : i + 4]), 42) for i in range(max(1, len(own) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprint():
    rng = random.Random(1)
    for text in (None, "", "A", "One two\tTHREE", "É a b c d", words(rng, 90), words(rng, 70_000)):
        assert fingerprint(text) == brute_fingerprint(text)


def linked(prints):
    """fingerprint -> smallest one reachable."""
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    every = sorted(prints)
    for i, a in enumerate(every):
        for b in every[i + 1 :]:
            if bin(a ^ b).count("1") <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def brute_near(rows):
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    root = linked({p for _, p in prints})
    least = {}
    for i, p in prints:
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    return sorted(((i, p, least.get(root[p])) for i, p in prints), key=str)


def test_near_duplicates(docs, rows):
    found = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in near_duplicates(docs).collect()]
    assert sorted(found, key=str) == brute_near(rows)


def test_near_links_of_planted_fingerprints(spark):
    """Dense groups, chains and pairs at exactly four and five bits."""
    from rasterloom.llm.simhash_dedup import _links

    rng = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.choice([1, 2, 30])):
            for bit in rng.sample(range(64), rng.choice([1, 4, 4, 5])):
                base ^= 1 << bit
            prints.add(base)
        centre = rng.getrandbits(64)
        prints |= {centre ^ (1 << a) ^ (1 << b) for a, b in (rng.sample(range(64), 2) for _ in range(20))}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp bigint")
    root = {r["node"]: r["root"] for r in _links(df).collect()}
    wanted = linked(prints)
    groups = lambda of: sorted(sorted(g) for g in of.values())
    a, b = {}, {}
    for p in prints:
        a.setdefault(root.get(signed(p), signed(p)), []).append(p)
        b.setdefault(wanted[p], []).append(p)
    assert groups(a) == groups(b)


def test_fingerprints_are_spread_before_they_are_indexed(spark, monkeypatch):
    """A file of fingerprints is small, its 64 rows of each are not: tasks are for a number of fingerprints."""
    from rasterloom.llm import simhash_dedup as S

    tasks, masked = [], []
    monkeypatch.setattr(S, "TASK_PRINTS", 50, raising=False)
    buckets, keyed = S._buckets, S._keyed
    monkeypatch.setattr(S, "_buckets", lambda prints: (tasks.append(prints.rdd.getNumPartitions()), buckets(prints))[1])
    monkeypatch.setattr(S, "_keyed", lambda prints: (masked.append((prints.count(), prints.rdd.getNumPartitions())), keyed(prints))[1])
    rng = random.Random(5)
    prints = {(rng.getrandbits(21) | (1 << 30)) << 1 for _ in range(480)}  # two equal segments: hot buckets of several components
    S._links(spark.createDataFrame([(p,) for p in prints], "fp bigint").coalesce(1)).collect()
    assert tasks == [-(-len(prints) // 50)]
    assert masked and all(n == max(1, -(-rows // 50)) for rows, n in masked)


def test_without_near_copies(docs, rows):
    found = without_near_copies(docs)
    assert found.columns == docs.columns
    ids = sorted(r["doc_id"] for r in found.where("doc_id is not null").collect())
    assert ids == sorted({c for _, _, c in brute_near(rows) if c is not None})


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + k) for k in range(1, 50)] + [(7, 7)]
    found = components(spark.createDataFrame(edges, "u bigint, v bigint"), "test").collect()
    assert {r["node"]: r["root"] for r in found} == {i: 0 for i in range(301)} | {1000 + k: 1000 for k in range(50)}
    assert components(spark.createDataFrame([], "u bigint, v bigint"), "test").count() == 0


def brute_substring(rows, window):
    first = {}
    for i, t in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for k in range(len(own) - window + 1):
            key = tuple(own[k : k + window])
            if i is not None:
                first[key] = min(i, first.get(key, i))
    out = []
    for i, t in rows:
        own = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for k in range(len(own) - window + 1):
            if i is not None and first[tuple(own[k : k + window])] < i:
                gone |= set(range(k, k + window))
        out.append((i, len(own), len(gone), " ".join(w for k, w in enumerate(own) if k not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window,part", [(50, 25), (5, 2), (4, 4)])
def test_without_repeats(docs, rows, window, part):
    found = without_repeats(docs, window=window, part=part)  # docs has columns digest and kept of its own
    assert {"digest", "text"} <= set(found.columns) and found.columns.count("kept") == 1
    got = sorted(map(tuple, found.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str)
    assert got == brute_substring(rows, window)


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert exact_groups(none).count() == 0
    assert near_duplicates(none).count() == 0
    assert without_repeats(none).count() == 0


def test_rows_that_share_an_id_or_have_none_are_told_apart(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(30)) for x in "abc")
    rows = [(5, a, "k"), (5, b, "k"), (5, a, "k"), (6, a, "k"), (None, c, "k"), (None, c.replace(" ", "  "), "k"), (None, b, "k"), (None, None, "k"), (7, "", "k"), (8, "long " * 50_000, "k")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, mark string")
    wanted = sorted([(5, a), (5, b), (None, c), (7, ""), (8, "long " * 50_000)], key=str)
    for kept in (without_copies(df), without_near_copies(df)):
        assert kept.columns == df.columns
        assert sorted(((r["doc_id"], norm(r["text"])) for r in kept.collect()), key=str) == wanted
    for empty in (df.limit(0), spark.createDataFrame([(None, None, None)], df.schema)):
        assert without_copies(empty).count() == without_near_copies(empty).count() == empty.count()


def test_links_inside_one_hot_bucket(spark):
    """5,000 prints that share a segment and are far from each other but for planted pairs."""
    from rasterloom.llm.simhash_dedup import _links

    rng = random.Random(12)
    low = rng.getrandbits(22)
    prints = [(rng.getrandbits(42) << 22) | low for _ in range(5000)]
    for p in prints[:60]:
        for bit in rng.sample(range(22, 64), 4):
            p ^= 1 << bit
        prints.append(p)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    root = {r["node"]: r["root"] for r in _links(spark.createDataFrame([(signed(p),) for p in set(prints)], "fp bigint")).collect()}
    wanted = linked(set(prints))
    groups = {}
    for p, r in wanted.items():
        groups.setdefault(r, set()).add(signed(p))
    found = {}
    for p in prints:
        found.setdefault(root.get(signed(p), signed(p)), set()).add(signed(p))
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_compared_pairs_of_clouds(spark):
    """Pairs that meet under a covering mask, not links: few of those in a cloud that is 5 to 10 bits from its centre."""
    from rasterloom.llm.simhash_dedup import _keyed, _met, _outsiders, covering_masks

    masks = covering_masks()
    rng = random.Random(41)
    changes = [sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4))) for _ in range(20_000)]
    assert all(any(not m & c for m in masks) for c in changes)
    met = []
    for n in (1_000, 2_000, 4_000):
        centre = rng.getrandbits(64)
        prints = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(5, 10))) for _ in range(n)} | {rng.getrandbits(64) for _ in range(n)}
        signed = [p - (1 << 64) if p >> 63 else p for p in prints]
        keyed = _keyed(spark.createDataFrame([(p, p) for p in signed], "fp bigint, part bigint"))
        pairs = _met(_outsiders(keyed), keyed).select("a", "b").collect()
        met.append(len(pairs))
        if n == 1_000:
            found = {frozenset(r) for r in pairs}
            assert all(frozenset((a, b)) in found for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) % (1 << 64)).bit_count() <= 4)
    assert met[2] < 4_000 * 4_000 / 100, met
