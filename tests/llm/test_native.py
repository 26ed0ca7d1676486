"""URL rules, pseudonyms and licence scans, and the queries and the pipeline as a whole."""

import hashlib
import itertools
import os
import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rasterloom.llm import pii
from rasterloom.llm.license_scan import bodies, scanned, template_bigrams, templates
from rasterloom.llm.queries import ORACLE_SQL, QUERIES, URL_RULES
from rasterloom.llm.url_filter import filtered, host_of, judged_sets, matched_rule, mine_rules, path_of, tokens_of

SF = "/root/testdata/sf0.001"

URLS = [
    "http://a.example.com/en/1", "https://www.example.com/en/1?x=/en/", "https://www.example.com/en", "HTTP://EXAMPLE.COM/en/",
    "http://x.net/es/", "http://net/fr/1#t", "http://net.org/fr/1", "http://com", "http://com/", "http://badcom/", "ftp://h.com?x://y",
    "no scheme", "", None, "http:///path", "a://b://c/d", "https://m.www.example.com/en/a", "http://x.net/es", "http://e.com/\n/x", "://com/",
]


def brute_rule(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = (0, None, None)
    for h, p, v in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p):
            best = max(best, (len(h + p), h + p, v), key=lambda x: x[0])
    return host, path, best[1], best[2]


def test_host_rules(spark):
    df = spark.createDataFrame([(u,) for u in URLS], "url string")
    rule = matched_rule(F.col("host"), F.col("path"), URL_RULES)
    found = df.withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))}).withColumn("r", rule)
    for r in found.collect():
        assert (r["host"], r["path"], r["r"] and r["r"]["rule"], r["r"] and r["r"]["verdict"]) == brute_rule(r["url"]), r["url"]


def brute_rules(rows, support, confidence):
    """All token combinations that imply a verdict, by counting."""
    n, out = len(rows), {}
    for tokens, _ in rows:
        for k in range(1, len(tokens) + 1):
            for combination in itertools.combinations(tokens, k):
                out.setdefault(combination, None)
    kept = {}
    for c in out:
        own = [v for t, v in rows if set(c) <= set(t)]
        for v in set(own):
            both = own.count(v)
            lift = both / len(own) / (sum(w == v for _, w in rows) / n)
            if both / n >= support and both / len(own) >= confidence and lift > 1:
                kept[c, v] = both / len(own)
    return {k: x for k, x in kept.items() if not any(kept.get((tuple(t for t in k[0] if t != gone), k[1]), -1) >= x for gone in k[0])}


def test_association_rules_and_their_index(spark):
    rng = random.Random(6)
    urls = [f"http{rng.choice(['', 's'])}://{rng.choice(['a', 'spam', 'b'])}.{rng.choice(['com', 'org'])}/{rng.choice(['en', 'x'])}" for _ in range(150)]
    label = lambda u: "block" if "spam" in u and "https" in u else rng.choice(["allow", "allow", "block"])
    rows = [(u, label(u)) for u in urls] + [("http://q.org/z", None), (None, "allow")]
    df = spark.createDataFrame(rows, "url string, verdict string")
    tokens = df.where("verdict is not null").select(tokens_of(F.col("url")), "verdict").collect()
    rules = mine_rules(df, 0.05, 0.7, 1)
    found = {(tuple(r["tokens"]), r["verdict"]): r["confidence"] for r in rules.collect()}
    wanted = brute_rules([(tuple(t), v) for t, v in tokens], 0.05, 0.7)
    assert found.keys() == wanted.keys() and all(abs(found[k] - x) < 1e-9 for k, x in wanted.items())
    sets = df.select(tokens_of(F.col("url")).alias("tokens")).distinct().withColumn("set", F.array_join("tokens", " "))
    got = {r["set"]: r["found"]["confidence"] for r in judged_sets(sets, rules).collect()}
    for r in sets.collect():
        best = max((x for (c, _), x in wanted.items() if set(c) <= set(r["tokens"])), default=None)
        assert got.get(r["set"]) == best or abs(got[r["set"]] - best) < 1e-9


def test_mined_verdicts_of_the_whole_query(spark):
    """Rules of both verdicts decide; against brute force over all token combinations. Labels are from noisy hosts."""
    rng = random.Random(16)
    make = lambda: f"http{rng.choice(['', 's'])}://{rng.choice(['shop', 'win', 'news'])}.{rng.choice(['aa.org', 'bb.io'])}/{rng.choice(['p', 'q'])}{rng.choice(['', '?id=1'])}"
    label = lambda u: rng.choice(["block"] * 9 + ["allow"]) if "win" in u else "allow" if "news" in u and "aa" in u else rng.choice(["allow", "block"])
    rows = [(u, label(u)) for u in (make() for _ in range(200))]
    df = spark.createDataFrame(rows, "url string, verdict string")
    tokens = {r["url"]: tuple(r["t"]) for r in df.select("url", tokens_of(F.col("url")).alias("t")).collect()}
    wanted = brute_rules([(tokens[u], v) for u, v in rows], 0.05, 0.7)
    support = lambda c: sum(set(c) <= set(tokens[u]) for u, _ in rows)
    found = filtered(df.select("url"), [], df, min_support=0.05, min_confidence=0.7, min_count=1).collect()
    for r in found:
        own = [(x, support(c), v) for (c, v), x in wanted.items() if set(c) <= set(tokens[r["url"]])]
        best = max((x[:2] for x in own), default=None)
        assert r["verdict"] in ({x[2] for x in own if x[:2] == best} or {"allow"})
    assert {r["verdict"] for r in found if r["mined"]} == {"allow", "block"}


def test_mined_rules_block_and_allow_in_the_query(spark):
    """Pages in languages that are not wanted have their language in the path: rules found from other urls block them."""
    rows = QUERIES["op2_url_filter"](spark, "/root/testdata/sf0.01").collect()
    mined = [r for r in rows if r["rule"] is None and r["mined"] is not None]
    assert {r["verdict"] for r in mined} == {"allow", "block"}
    other = [r for r in mined if re.match("/(de|es|fr)/", r["path"])]
    assert other and sum(r["verdict"] == "block" for r in other) > 0.95 * len(other)
    english = [r for r in mined if r["path"].startswith("/en/")]
    assert sum(r["verdict"] == "allow" for r in english) > 0.95 * len(english)


def test_long_verdicts_stay_whole(spark):
    name = "block-" + "x" * 200
    df = spark.createDataFrame([("http://spam.org/a", name)] * 40 + [("http://ham.org/b", "allow")] * 40, "url string, verdict string")
    assert {r["verdict"] for r in mine_rules(df, 0.05, 0.7, 1).collect()} == {name, "allow"}


def test_urls_of_many_words(spark):
    """Equal urls of forty words with both verdicts have two to the fortieth combinations of tokens."""
    long = "http://h.org/" + "/".join(f"word{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(40))
    rows = [(long, "block")] * 50 + [(long, "allow")] * 10 + [("http://o.org/x", "allow")] * 60 + [("http://" + "y" * 200_000 + ".org/" + "z/" * 5_000, "allow")]
    df = spark.createDataFrame(rows, "url string, verdict string")
    found = filtered(df.select("url"), [], df).collect()
    assert {(r["url"][:12], r["verdict"], r["mined"] is not None) for r in found} == {("http://h.org", "block", True), ("http://o.org", "allow", True), ("http://yyyyy", "allow", False)}


def test_filtered_urls(spark):
    pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(URLS)] + [(None, URLS[0], None, None), (0, URLS[0], "x", "y")], "page_id bigint, url string, rule string, tokens string")
    none = spark.createDataFrame([], "url string, verdict string")
    found = filtered(pages, URL_RULES, none).collect()
    assert len(found) == len(URLS) + 2
    assert all(r["verdict"] == (brute_rule(r["url"])[3] or "allow") for r in found)
    assert filtered(pages.limit(0), URL_RULES, none).count() == 0
    assert {r["rule"] for r in filtered(pages, [], none).collect()} == {None}


def luhn(digits):
    ds = [int(c) for c in digits if c.isdigit()][::-1]
    return sum(sum(divmod(2 * d, 10)) if i % 2 else d for i, d in enumerate(ds)) % 10 == 0


def iban_ok(s):
    s = s.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


SHAPES = {
    "card": (["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004"], luhn),
    "iban": (["DE89370400440532013000", "GB82 WEST 1234 5698 7654 32"], iban_ok),
    "ssn": (["123-45-6789", "899-99-9999", "001-01-0001"], lambda s: not re.search("^(000|666|9)|-00-|-0000$", s)),
    "phone": (["+1 (555) 123-4567", "(555) 123-4567", "555-123-4567", "+44 20 7946 0958", "+15551234567"], lambda s: 7 <= sum(c.isdigit() for c in s) <= 15),
    "ipv4": (["10.0.0.1", "255.255.255.255", "192.168.1.77"], lambda s: all(int(x) < 256 for x in s.split("."))),
    "date": (["2024-02-29", "31.12.1999", "01/31/2001"], lambda s: True),
    "email": (["jo.77@mail5.example.com", "A.b+c_d@x-y.org"], lambda s: "@" in s),
    "token": (['token = "ab12ab12ab12ab12ff"', "TOKEN: AAFF00112233445566", "api_key=Zz9Zz9Zz9Zz9Zz9Zz9"], lambda s: True),
}


def test_pseudonyms_keep_format_validity_and_links(spark):
    rows = [(k, v) for k, (values, _) in SHAPES.items() for v in values]
    df = spark.createDataFrame([(i, f"Before {v}, then. {v}") for i, (_, v) in enumerate(rows)], "doc_id bigint, text string")
    found = {r["doc_id"]: r for r in pii.pseudonymised(df, "k").collect()}
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymised(df, "k2").collect()}
    for i, (kind, value) in enumerate(rows):
        got = re.fullmatch(r"Before (.*), then\. (.*)", found[i]["text"])
        assert found[i]["pii"] == [kind, kind], (value, found[i])
        assert got[1] == got[2] != value and other[i] != found[i]["text"]
        assert SHAPES[kind][1](got[1]), (value, got[1])
        if kind != "ipv4":
            fold = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "0", s)))
            assert fold(got[1]) == fold(value)


def moved(half, stream):
    out = ""
    for i, c in enumerate(half):
        by = int(stream[i % 64 * 2 : i % 64 * 2 + 2], 16)
        first, size = (48, 10) if c.isdigit() else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (ord(c), 1)
        out += chr(first + (ord(c) - first + by) % size)
    return out


def feistel(text, key, kind):
    """The eight rounds over a text's halves, written anew."""
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for turn in range(8):
        hashed = lambda other: hashlib.sha512(f"{key}|{kind}|{turn}|{len(text)}|{other}".encode()).hexdigest()  # noqa: B023, E731
        if turn % 2:
            right = moved(right, hashed(left))
        else:
            left = moved(left, hashed(right))
    return left + right


def test_one_value_has_one_pseudonym_in_all_spellings(spark):
    """Against an independent Feistel network over the bare values."""
    spellings = {
        "card": ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"],
        "phone": ["+15551234567", "+1 555 123 4567", "(555) 123-4567", "555.123.4567"],
        "iban": ["GB82WEST12345698765432", "GB82 WEST 1234 5698 7654 32"],
        "email": ["jo.smith@Mail.org", "Jo.Smith@Mail.org", "JO.SMITH@Mail.org"],
    }
    rows = [(f"see {v}; it", kind, v) for kind, own in spellings.items() for v in own]
    found = pii.pseudonymised(spark.createDataFrame(rows, "text string, kind string, v string"), "k").collect()
    for r in found:
        got = r["text"][4:-4]
        bare = re.sub("[^0-9A-Za-z]", "", got)
        digits = re.sub("[^0-9]", "", r["v"])
        assert r["pii"] == [r["kind"]] and re.sub("[0-9A-Za-z]", "x", got) == re.sub("[0-9A-Za-z]", "x", r["v"])
        if r["kind"] == "card":
            assert bare[:-1] == feistel(digits[:-1], "k", "card") and luhn(bare)
        elif r["kind"] == "phone":
            assert bare[-10:] == feistel(digits[-10:], "k", "phone") and bare[:-10] == digits[:-10]
        elif r["kind"] == "iban":
            assert bare[4:] == feistel(r["v"].replace(" ", "")[4:], "k", "iban") and iban_ok(bare)
        else:
            assert got.split("@")[0].lower() == feistel("jo.smith", "k", "email") and got.endswith("@Mail.org")


def test_valid_values_inside_failed_matches(spark):
    card, other = "4111 1111 1111 1111", "4111111111111111"
    texts = {f"{card} 12/27": card, f"{other} 123": other, f"qty 2 {other}": other, "BE68539007547034 EUR 20": "BE68539007547034", f"7 {card} 99": card,
             "mail " + "a" * 70 + ".b@x.org": "a" * 70 + ".b@x.org"}
    df = spark.createDataFrame([(t, v) for t, v in texts.items()] * 2 + [("1 2 3 4 5 6 7 8 9 1 2 3 4 5", ""), ("", ""), (None, ""), ("x" * 300_000 + " " + other, other)], "text string, pii string")
    for r in pii.pseudonymised(df.withColumn("v", F.col("pii")), "k").collect():
        if not r["v"]:
            assert r["pii"] == []
        else:
            assert len(r["pii"]) == 1 and r["v"] not in r["text"]
            assert not re.search("a{3}", r["text"])
    none = df.limit(0)
    assert pii.pseudonymised(none, "k").count() == 0


def test_pseudonyms_are_permutations(spark):
    df = spark.range(73_049).select(F.date_format(F.date_add(F.lit("1900-01-01").cast("date"), F.col("id").cast("int")), "yyyy-MM-dd").alias("text"))
    found = pii.pseudonymised(df, "k")
    assert found.select("text").distinct().count() == 73_049
    pairs = spark.range(12 * 35).select(pii.permuted_number(F.col("id") % 12, F.floor(F.col("id") / 12), (12, 35), "k", "x").alias("p"))
    assert {(r["p"]["l"], r["p"]["r"]) for r in pairs.collect()} == set(itertools.product(range(12), range(35)))
    short = spark.range(1000).select(pii.permuted_text(F.lpad(F.col("id").cast("string"), 3, "0"), "k", "x").alias("t"))
    assert short.distinct().count() == 1000


def test_what_is_not_personal_stays(spark):
    texts = [
        None, "", "plain words", "4111111111111112", "300.1.2.3", "1.2.3.4.5", "2023-02-29", "31.02.2000", "1899-12-31", "666-12-3456", "version 3.",
        "a@b", "key = short", "12345", "DE00370400440532013000", "in 2020-2021", "x" * 100_000 + " 7 ", "token token token",
    ]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no", "x")], "doc_id bigint, text string, pii string")
    found = pii.pseudonymised(df, "k").collect()
    assert {r["doc_id"]: r["text"] for r in found} == dict(enumerate(texts)) | {None: "no"}
    assert all(r["pii"] == [] for r in found)
    assert pii.pseudonymised(df.limit(0), "k").count() == 0


def brute_licences(text, threshold=0.8, known=templates()):  # noqa: B008
    if text is None:
        return {}
    sentences = re.sub(r"([.!?])[ \t\r\n]+", r"\1\n\n", text).split("\n\n")
    best = {}
    for s in {text, *re.split(r"\n[ \t]*\n", text), *text.split("\n"), *sentences}:
        a = set(template_bigrams(s))
        for name, grams in known:
            dice = 2 * len(a & set(grams)) / max(1, len(a) + len(grams))
            if dice >= threshold:
                best[name] = max(best.get(name, 0), round(dice, 6))
    return best


def test_creative_commons_short_forms(spark):
    """Lines as documents hold them, not taken from templates()."""
    lines = {
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "licensed under CC BY 4.0": "CC-BY-4.0", "Licensed under CC-BY-SA-4.0": "CC-BY-SA-4.0",
        "This work is licensed under CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-SA 4.0.": "CC-BY-NC-SA-4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": "CC-BY-NC-4.0",
    }
    df = spark.createDataFrame([(i, f"Some text before.\n{t}\nMore text after it.") for i, t in enumerate(lines)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["licenses"] for r in scanned(df).collect()}
    assert [found[i] and found[i][0]["license"] for i in range(len(lines))] == list(lines.values())


def test_licences(spark):
    rng = random.Random(2)
    notice = [t for _, texts in __import__("rasterloom.llm.license_scan", fromlist=["x"]).TEMPLATES.items() for t in texts]
    texts = [None, "", "x", "no licence at all", *notice]
    for t in notice:
        own = t.split(" ")
        for _ in range(4):
            edited = [w for w in own if rng.random() > 0.12]
            texts.append("Intro words.\n" + " ".join(edited).upper() + rng.choice(["", " Outro.", "\nmore", "\n\nmore"]))
    texts += ["the " * 20_000, notice[0] + " " + notice[1]]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id bigint, text string, licenses string")
    for r in scanned(df).collect():
        assert {x["license"]: x["dice"] for x in r["licenses"]} == brute_licences(texts[r["doc_id"]]), texts[r["doc_id"]]
    assert scanned(df.limit(0)).count() == 0


def test_whole_licences(spark):
    """Whole texts, wrapped anew, with words dropped, and inside a longer text; against brute force."""
    rng = random.Random(3)
    texts, wanted = [], []
    for name, body in bodies().items():
        own = body.split()
        kept = [w for w in own if rng.random() > 0.05]
        wrapped = "\n".join(" ".join(kept[k : k + 9]) for k in range(0, len(kept), 9))
        texts += [body, wrapped, "# Title of a file\n\n" + " ".join(own) + "\n\nint main() { return 0; }"]
        wanted += [name] * 3
    texts += ["".join(rng.choice("abcde ") for _ in range(3000)), texts[0]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = {r["doc_id"]: r["licenses"] for r in scanned(df).collect()}
    for i, name in enumerate(wanted):
        assert name in [x["license"] for x in found[i]], (i, name)
        assert {x["license"]: x["dice"] for x in found[i]} == brute_licences(texts[i])
    assert found[len(wanted)] == []


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(spark, name):
    import duckdb

    base = duckdb.connect()
    for f in os.listdir(SF):
        base.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    df = QUERIES[name](spark, SF)
    rows = base.execute(f"SELECT {', '.join(df.columns)} FROM ({ORACLE_SQL[name]})").fetchall()
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, rows))


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF).cache()
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns, name
        assert 0 < docs.count() <= before.count()
        assert docs.select("doc_id").distinct().count() == docs.count()
    assert docs.where("not round_trip").count() == 0
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == {r["doc_id"] for r in docs.collect()}


def test_pipeline_against_brute_force(spark):
    import numpy as np
    from test_dedup import brute_near, norm

    from rasterloom.llm.decontaminate import align, words

    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [words(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    least = {}
    for i, t in kept:
        least[norm(t)] = min(i, least.get(norm(t), i))
    kept = [(i, t) for i, t in kept if least[norm(t)] == i]
    roots = {c for _, _, c in brute_near(kept)}
    wanted = set()
    for i, t in kept:
        if i in roots:
            ids = {}
            code = lambda ws: [ids.setdefault(w, len(ids)) for w in ws]  # noqa: B023, E731
            own = code(words(t))
            if np.max(align([own] * len(items), [code(x) for x in items])) < 0.5:
                wanted.add(i)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, SF).collect()} == wanted


def test_large_indexes_are_shuffled(spark, monkeypatch):
    """The ways beyond the broadcast bounds give the same rows."""
    from test_dedup import test_near_links_of_planted_fingerprints as near

    from rasterloom.llm import simhash_dedup, url_filter

    monkeypatch.setattr(simhash_dedup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 0)
    near(spark)
    test_association_rules_and_their_index(spark)


def test_pipeline_stages_with_odd_rows(spark):
    """Nulls in every column, shared and missing ids, repeated rows, columns with names that operators use, empty tables."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(12)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    names = ["mark", "digest", "score", "lang_pred", "__row_no", "fp", "ids", "n", "key"]
    texts = [r["text"] for r in docs.select("text").distinct().orderBy("text").collect() if r["text"] and len(r["text"].split()) > 30][:4]
    odd = [(1, texts[0], "en"), (1, texts[0], "en"), (1, texts[1], None), (None, texts[2], "en"), (None, texts[2], None), (None, texts[3] + " " + item, "en"),
           (9, None, "en"), (None, None, None), (10, "", None), (None, item, None)]
    rows = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in odd], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = rows.unionByName(docs.where("false")).withColumns({n: F.lit("own") for n in names})
    wanted = {(1, texts[0]), (1, texts[1]), (None, texts[2])}
    now, none = rows, rows.limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now, none = stage(spark, now, SF).cache(), stage(spark, none, SF)
        assert now.columns == none.columns == rows.columns, name
        assert none.count() == 0
        assert now.where(" and ".join(f"{n} = 'own'" for n in names)).count() == now.count()
    assert {(r["doc_id"], r["text"]) for r in now.collect()} == wanted and now.count() == 3
    last = corpus_pipeline.STAGES[-1][1]
    assert last(spark, now, SF).where("round_trip").count() == 3 and last(spark, none, SF).count() == 0


def test_hostile_values_neither_crash_nor_take_long(spark):
    """Hosts of many labels, long values and long runs of digits: each text by itself, in a time in proportion to its length."""
    import time

    texts = {
        "labels": "a@" + "b." * 100_000 + "c1 bob@ex.com.", "token": "token=" + "a1" * 50_000, "email": "x" * 100_000 + "@ex.com",
        "digits": "1 " * 20_000, "run": "7" * 1_000_000, "card": "1 " * 200 + "x 4111 1111 1111 1111 12/27",
    }
    df = spark.createDataFrame(list(texts.items()), "name string, text string")
    start = time.time()
    found = {r["name"]: r for r in pii.pseudonymised(df, "k").collect()}
    assert time.time() - start < 120
    assert {n: r["pii"] for n, r in found.items()} == {"labels": ["email"], "token": ["token"], "email": ["email"], "digits": [], "run": [], "card": ["card"]}
    for n in ("digits", "run"):
        assert found[n]["text"] == texts[n]
    assert found["labels"]["text"].startswith(texts["labels"][:200_000]) and len(found["token"]["text"]) == len(texts["token"]) and found["token"]["text"] != texts["token"]
    assert found["card"]["text"].endswith(" 12/27") and "4111 1111 1111 1111" not in found["card"]["text"]
