"""Language identification with hyperdimensional profiles.

Each letter has a random +1/-1 vector. A trigram's vector binds its letters' vectors, each permuted
(rotated) by its place, by multiplication. A text's vector bundles (adds) those of its trigrams, a
language's prototype bundles the unit vectors of its texts, and a text gets the language whose
prototype has the largest cosine with it.

Edge cases: a null text, or one without a letter, gets ``und`` and score 0. Equal cosines go to the
language that sorts first. Without any labelled text every prediction is ``und``. Repeated rows and
extra columns pass through; null ids are allowed.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bounded_batches

UNKNOWN = "und"
#: Quantum of the integer sums that make prototypes: their order does not change the result.
_SCALE = float(1 << 20)


class TrigramSpace:
    """Trigram vectors of one worker. Memory is bounded: the oldest vectors are dropped and can be
    made again from their letters at any time."""

    def __init__(self, dim: int, seed: int, keep: int = 16384, part: int = 2048):
        self.dim, self.seed, self.keep, self.part = dim, seed, keep, min(part, keep)
        self.letters: OrderedDict[int, np.ndarray] = OrderedDict()
        self.rows: dict[int, int] = {}
        self.vectors = np.empty((keep, dim), np.int8)  # pages are touched as they fill
        self.is_letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def letter(self, code: int) -> np.ndarray:
        found = self.letters.get(code)
        if found is None:
            bits = np.random.default_rng([self.seed, code]).integers(0, 2, self.dim, np.int8)
            found = self.letters[code] = 2 * bits - 1
            if len(self.letters) > self.keep:
                self.letters.popitem(last=False)
        return found

    def vector(self, gram: int) -> np.ndarray:
        a, b, c = gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF
        return np.roll(self.letter(a), 2) * np.roll(self.letter(b), 1) * self.letter(c)

    def lookup(self, grams: np.ndarray) -> np.ndarray:
        """The vectors of a part of the distinct trigrams, as floats."""
        missing = [g for g in grams.tolist() if g not in self.rows]
        if len(self.rows) + len(missing) > self.keep:
            self.rows, missing = {}, grams.tolist()
        for g in missing:
            self.vectors[len(self.rows)] = self.vector(g)
            self.rows[g] = len(self.rows)
        return self.vectors[[self.rows[g] for g in grams.tolist()]].astype(np.float32)

    def grams(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The distinct trigrams of the text's letters and how often each occurs. A run of other
        characters counts as one space; words of one letter still give a trigram."""
        codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
        letter = self.is_letter[codes]
        if not letter.any():
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = np.concatenate(([32], np.where(letter, codes, 32), [32]))
        codes = codes[np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))]
        return np.unique((codes[:-2] << 42) | (codes[1:-1] << 21) | codes[2:], return_counts=True)

    def bundles(self, texts: list[str | None]) -> np.ndarray:
        """A unit vector for each text, zero for a text without a letter."""
        out = np.zeros((len(texts), self.dim), np.float32)
        counted = [self.grams(t) if t else (np.empty(0, np.int64),) * 2 for t in texts]
        every = np.unique(np.concatenate([g for g, _ in counted])) if counted else np.empty(0, np.int64)
        for at in range(0, len(every), self.part):
            part = every[at : at + self.part]
            counts = np.zeros((len(texts), len(part)), np.float32)
            for i, (g, n) in enumerate(counted):
                lo, hi = np.searchsorted(g, [part[0], part[-1] + 1])
                counts[i, np.searchsorted(part, g[lo:hi])] = n[lo:hi]
            out += counts @ self.lookup(part)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def _batches(texts: list, rows: int = 256, chars: int = 4_000_000) -> Iterator[list]:
    batch, size = [], 0
    for t in texts:
        batch.append(t)
        size += len(t or "")
        if len(batch) == rows or size > chars:
            yield batch
            batch, size = [], 0
    if batch:
        yield batch


class LanguageProfiles:
    """Prototypes of languages; fit() learns them and predict() adds a prediction to each row.

    ``train_rows`` bounds the labelled texts that one language's prototype is bundled from; a larger
    language is thinned by a hash of the text, which takes the same rows at every run.
    """

    def __init__(self, dim: int = 1024, seed: int = 7, train_rows: int = 10_000):
        self.dim, self.seed, self.train_rows = dim, seed, train_rows
        self.languages: list[str] = []
        self.prototypes = np.empty((0, dim), np.float32)

    def fit(self, labelled: DataFrame, text: str = "text", lang: str = "lang") -> LanguageProfiles:
        bounded_batches(labelled.sparkSession)
        rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
        sizes = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}  # one row a language
        share = F.create_map(*(F.lit(x) for l, n in sizes.items() for x in (l, int(min(1, self.train_rows / n) * _SCALE)))) if sizes else F.lit(None)
        chosen = rows.where(F.pmod(F.xxhash64("t", F.lit(17)), F.lit(int(_SCALE))) < (share[F.col("l")] if sizes else F.lit(0)))
        dim, seed = self.dim, self.seed

        def bundle(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            space, sums = TrigramSpace(dim, seed), {}
            for frame in frames:
                for language, own in frame.groupby("l", sort=False):
                    for texts in _batches(own["t"].tolist()):
                        part = np.rint(space.bundles(texts) * _SCALE).astype(np.int64).sum(axis=0)
                        sums[language] = sums.get(language, 0) + part
            for language, total in sums.items():
                yield pd.DataFrame({"l": [language], "v": [total.tolist()]})

        parts = chosen.select("l", "t").mapInPandas(bundle, "l string, v array<bigint>")
        summed = parts.select("l", F.posexplode("v").alias("i", "x")).groupBy("l", "i").agg(F.sum("x").alias("x"))
        vectors = summed.groupBy("l").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))
        learned = vectors.select("l", F.col("v.x").alias("v")).orderBy("l").collect()  # languages x dim numbers
        self.languages = [r["l"] for r in learned]
        found = np.array([r["v"] for r in learned], np.float64).reshape(len(learned), dim)
        norm = np.linalg.norm(found, axis=1, keepdims=True)
        self.prototypes = (found / np.where(norm > 0, norm, 1)).astype(np.float32)
        return self

    def predict(self, df: DataFrame, text: str = "text", to: str = "lang_pred", score: str = "score") -> DataFrame:
        """df with the columns named by ``to`` and ``score`` (the cosine, cut to 0..1) added or replaced."""
        dim, seed, languages = self.dim, self.seed, np.array([*self.languages, UNKNOWN], object)
        prototypes = self.prototypes

        @F.pandas_udf("p string, s double")
        def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            space = TrigramSpace(dim, seed)
            for series in batches:
                names, scores = [], []
                for texts in _batches(series.tolist()):
                    vectors = space.bundles(texts)
                    cosine = vectors @ prototypes.T if len(prototypes) else np.zeros((len(texts), 1), np.float32)
                    best = np.where(vectors.any(axis=1), cosine.argmax(axis=1), -1) if len(prototypes) else np.full(len(texts), -1)
                    names.append(languages[best])
                    scores.append(np.where(best < 0, 0, cosine.max(axis=1)))
                yield pd.DataFrame({
                    "p": np.concatenate(names) if names else np.array([], object),
                    "s": np.round(np.clip(np.concatenate(scores).astype(float), 0, 1), 5) if scores else np.array([], float),
                })

        judged = judged.asNondeterministic()  # else the optimizer may run it once for each of its two fields
        with_it = df.withColumn("__judged", judged(F.col(text)))
        return with_it.withColumns({to: F.col("__judged.p"), score: F.col("__judged.s")}).drop("__judged")


def held_out(doc_id: str = "doc_id"):
    """Whether crc32 of the id as text leaves 2 on division by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identified(documents: DataFrame) -> DataFrame:
    """documents with held_out, lang_pred and score, learned from the rows that are not held out."""
    model = LanguageProfiles().fit(documents.where(~held_out()))
    return model.predict(documents.withColumn("held_out", held_out()))
