"""The numbered queries over the corpus tables, each a thin use of its operator, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .batch_bpe import BatchBPE
from .byte_bpe import ByteBPE
from .decontaminate import contaminated
from .exact_dedup import exact_groups
from .language_id import identified
from .license_scan import THRESHOLD, scanned, templates
from .lm_score import MaskedScorer
from .periodic_runs import with_runs
from .pii import pseudonymised
from .simhash_dedup import near_duplicates
from .substring_dedup import without_repeats
from .url_filter import ALLOW, BLOCK, filtered
from .whitening import Whitening

#: (host, path, verdict).
URL_RULES = [
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
]
#: Visible characters under which a page counts as thin, and languages that pages are wanted in; the label of other
#: pages is to block them.
THIN_PAGE = 800
WANTED_LANGUAGES = ("en",)
#: In production the key comes from a secret store.
PII_KEY = "pseudonym-key-1"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def public_bpe() -> ByteBPE:
    import public_tokenizers

    return ByteBPE(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identified(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page is labelled by what it holds: block if its visible text is shorter than THIN_PAGE characters, or if it names
    a language that is not wanted. Rules mined from the urls of such pages judge all urls."""
    pages = _table(spark, sf_dir, "pages")
    visible = F.regexp_replace(F.regexp_replace("html", r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " "), r"\s+", " ")
    language = F.lower(F.regexp_extract("html", r"(?i)<html\b[^>]*\blang=[\"']?([a-z]+)", 1))
    unwanted = (language != "") & ~language.isin(*WANTED_LANGUAGES)
    verdict = F.when((F.length(visible) < THIN_PAGE) | unwanted, BLOCK).when(F.col("html").isNotNull(), ALLOW)
    labelled = pages.select("url", verdict.alias("verdict"))
    return filtered(pages.select("page_id", "url"), URL_RULES, labelled).select("page_id", "host", "path", "rule", "verdict", "mined")


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymised(_table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", "text", F.size("pii").cast("bigint").alias("n_replaced"), F.array_join(F.array_sort(F.array_distinct("pii")), ",").alias("kinds"))


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scanned(_table(spark, sf_dir, "documents").select("doc_id", "text")).withColumn("best", F.try_element_at("licenses", F.lit(1)))
    return found.select(
        "doc_id",
        F.col("best.license").alias("license"),
        F.col("best.dice").alias("dice"),
        F.array_join(F.array_sort(F.transform("licenses", lambda x: x["license"])), ",").alias("licenses"),
    )


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = public_bpe().round_trip(_table(spark, sf_dir, "documents").select("doc_id", "text"), drop=["text"])
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_groups(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return MaskedScorer().fit(documents).score(documents).select("doc_id", "n_tokens", "score", "mean_score")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    fitted = Whitening().fit(embeddings)
    explained = F.array(*map(F.lit, fitted.explained)).cast("array<double>")
    rows = fitted.transform(embeddings).select("vec_id", "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        "vec_id",
        (F.col("place") + 1).alias("component"),
        F.lit(fitted.n).cast("bigint").alias("n"),
        F.col("deviation").try_cast("bigint").alias("deviation"),
        "whitened",
        F.get(explained, F.col("place")).alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"),
    )


def periodic_tails(documents: DataFrame) -> DataFrame:
    """The documents with the periodic tails that op12's contract gives to those whose crc32 ends in 0."""
    crc = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    marked = documents.withColumn("__w", F.when(crc % 10 == 0, words)).withColumn("__g", F.floor(crc / 10))
    n = F.size("__w")
    a = (F.col("__g") % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (3 + F.col("__g") % 8))).cast("int")
    tail = F.flatten(F.array_repeat(F.slice("__w", a + 1, p), F.ceil((n - a) / p).cast("int")))
    changed = F.array_join(F.concat(F.slice("__w", F.lit(1), a), F.slice(tail, F.lit(1), n - a)), " ")
    return marked.withColumn("text", F.when(n > 0, changed).otherwise(F.col("text"))).drop("__w", "__g")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_runs(periodic_tails(_table(spark, sf_dir, "documents").select("doc_id", "text")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"], (-r["start"]).alias("b"), (-r["period"]).alias("p"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.b")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.p")).alias("period"),
        F.floor(1000 * F.col("best.length") / (-F.col("best.p"))).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13_batch_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    bpe = BatchBPE(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_language_id, op2_url_filter, op3_pii_pseudonyms, op4_simhash_dedup, op5_decontaminate,
        op6_license_scan, op7_substring_dedup, op8_byte_bpe, op9_exact_dedup, op10_lm_score,
        op11_whitening, op12_periodic_runs, op13_batch_bpe,
    )
}


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


_TEMPLATES = ", ".join(f"({_text(name)}, string_split({_text('|'.join(grams))}, '|'))" for name, grams in templates())

ORACLE_SQL = {
    "op6_license_scan": rf"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS k, text FROM documents),
        s AS (SELECT DISTINCT k, trim(regexp_replace(translate(u.s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g')) AS s
              FROM t, unnest(list_concat([text], string_split_regex(text, '
[ 	]*
'), string_split(text, chr(10)),
                                         string_split(regexp_replace(text, '([.!?])[ 	
]+', '' || chr(10) || chr(10), 'g'), chr(10) || chr(10)))) AS u(s)),
        w AS (SELECT k, s, string_split(s, ' ') AS w FROM s),
        g AS (SELECT k, s, list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) AS g FROM w WHERE len(w) > 1),
        l(license, lg) AS (VALUES {_TEMPLATES}),
        d AS (SELECT k, s, license, round(2.0::DOUBLE * len(list_intersect(g, lg)) / (len(g) + len(lg)), 6) AS dice FROM g, l WHERE len(g) BETWEEN len(lg) * 0.6 AND len(lg) * 1.7),
        h AS (SELECT k, license, max(dice) AS dice FROM d WHERE dice >= {THRESHOLD} GROUP BY k, license),
        b AS (SELECT k, first(license ORDER BY dice DESC, license) AS license, max(dice) AS dice, string_agg(license, ',' ORDER BY license) AS licenses FROM h GROUP BY k)
        SELECT doc_id, license, dice, coalesce(licenses, '') AS licenses FROM t LEFT JOIN b USING (k)
    """,
    "op7_substring_dedup": r"""
        WITH t AS (SELECT doc_id, row_number() OVER () AS k, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        n AS (SELECT k, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS s FROM t, unnest(range(1, len(w) - 48)) AS u(i)),
        f AS (SELECT s, min(doc_id) AS first FROM n GROUP BY s),
        g AS (SELECT DISTINCT k, i + j AS p FROM n JOIN f USING (s), range(50) AS r(j) WHERE doc_id > first),
        x AS (SELECT t.k, u.p, w[u.p] AS word FROM t, unnest(range(1, len(w) + 1)) AS u(p)),
        o AS (SELECT k, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS kept FROM x ANTI JOIN g USING (k, p) GROUP BY k)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
        FROM t LEFT JOIN o USING (k)
    """,
    "op9_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
        FROM t WINDOW w AS (PARTITION BY norm)
    """,
}
