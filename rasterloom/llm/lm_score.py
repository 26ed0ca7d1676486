"""Masked pseudo-likelihood scores from a bidirectional window network.

Words fall into hashed tokens. The network predicts a token's class from the two words before and the
two after it: their embeddings, each scaled by its place's own weights, are summed, squashed and
turned into class scores. A token's probability is that of its class times its share of the class in
the corpus. A document's score is the sum of its tokens' conditional log-probabilities.

Every position of the corpus is masked once, and so a training target, in every round. Each partition
trains its own copy of the network, in numpy, on its positions, and the copies are averaged by their
number of positions, in blocks, by Spark. Counts of tokens cover all documents.

Edge cases: a null text or one without words has no tokens, score 0 and a null mean. Beyond a text's
ends a padding token stands. Repeated rows and extra columns pass through; an empty table trains
nothing, and gets an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import bounded_batches

#: Hashed tokens; 0 is padding. Classes of tokens. Width of an embedding. Words on either side.
TOKENS, CLASSES, WIDTH, SIDE = 1 << 14, 64, 16, 2
_BATCH = 8192
_BLOCK = 1 << 14


def tokens(text: str | None) -> np.ndarray:
    found = (text or "").encode("utf-8", "replace").lower().split()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found))
    return (hashes % np.uint64(TOKENS - 1)).astype(np.int32) + 1


def contexts(ids: np.ndarray) -> np.ndarray:
    """For each token the ones at -2, -1, +1, +2."""
    padded = np.concatenate([np.zeros(SIDE, np.int32), ids, np.zeros(SIDE, np.int32)])
    n = len(ids)
    return np.stack([padded[k : k + n] for k in range(2 * SIDE + 1) if k != SIDE], axis=1)


class WindowNetwork:
    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.embed = rng.normal(0, 0.3, (TOKENS, WIDTH)).astype(np.float32)
        self.place = np.ones((2 * SIDE, WIDTH), np.float32)
        self.out = rng.normal(0, 0.1, (WIDTH, CLASSES)).astype(np.float32)
        self.bias = np.zeros(CLASSES, np.float32)

    def pack(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.place, self.out, self.bias)])

    @classmethod
    def unpack(cls, flat: np.ndarray) -> WindowNetwork:
        net, at = cls.__new__(cls), 0
        for name, shape in (("embed", (TOKENS, WIDTH)), ("place", (2 * SIDE, WIDTH)), ("out", (WIDTH, CLASSES)), ("bias", (CLASSES,))):
            size = int(np.prod(shape))
            setattr(net, name, flat[at : at + size].reshape(shape).astype(np.float32))
            at += size
        return net

    def hidden(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        near = np.take(self.embed, context, axis=0)
        return near, np.tanh(np.einsum("ijk,jk->ik", near, self.place))

    def log_classes(self, context: np.ndarray) -> np.ndarray:
        scores = self.hidden(context)[1] @ self.out + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(axis=1, keepdims=True))

    def step(self, context: np.ndarray, wanted: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean negative log-probability of the wanted classes."""
        near, h = self.hidden(context)
        scores = h @ self.out + self.bias
        scores -= scores.max(axis=1, keepdims=True)
        error = np.exp(scores)
        error /= error.sum(axis=1, keepdims=True)
        error[np.arange(len(wanted)), wanted] -= 1
        back = (error @ self.out.T) * (1 - h * h)
        self.out -= rate / len(wanted) * (h.T @ error)
        self.bias -= rate / len(wanted) * error.sum(axis=0)
        grads = (back.T[:, :, None] * self.place.T[:, None, :]).reshape(WIDTH, -1)
        self.place -= rate / len(wanted) * np.einsum("ijk,ik->jk", near, back)
        # A token's embedding moves by the mean over its places in the batch.
        flat = context.ravel()
        counts = np.bincount(flat, minlength=TOKENS)
        ids = np.flatnonzero(counts)
        sums = np.stack([np.bincount(flat, g, TOKENS)[ids] for g in grads], axis=1)
        self.embed[ids] -= (rate * 0.1 * sums / np.sqrt(counts[ids])[:, None]).astype(np.float32)


class MaskedScorer:
    """fit() learns from all texts, score() adds columns."""

    def __init__(self, rounds: int = 2, rate: float = 0.5):
        self.rounds, self.rate = rounds, rate
        self.flat = WindowNetwork().pack()
        self.log_share = np.zeros(TOKENS, np.float32)

    def fit(self, df: DataFrame, text: str = "text") -> MaskedScorer:
        bounded_batches(df.sparkSession)
        texts = df.select(F.col(text).alias("t")).where("t is not null")
        for round_no in range(self.rounds):
            self.flat, counts = self._round(texts, round_no)
        if self.rounds:
            # Add-one smoothing: a token that the corpus lacks still has a share of its class.
            classes = np.arange(TOKENS) % CLASSES
            own = counts + 1.0
            self.log_share = np.log(own / np.bincount(classes, own, CLASSES)[classes]).astype(np.float32)
        return self

    def _round(self, texts: DataFrame, round_no: int) -> tuple[np.ndarray, np.ndarray]:
        start = texts.sparkSession.sparkContext.broadcast(self.flat)
        rate = self.rate / (1 + round_no)

        def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net, counts, seen = WindowNetwork.unpack(start.value), np.zeros(TOKENS, np.int64), 0
            held, size = [], 0

            def learn() -> None:
                nonlocal seen, counts
                context, ids = (np.concatenate(x) for x in zip(*held, strict=True))
                counts, wanted = counts + np.bincount(ids, minlength=TOKENS), ids % CLASSES
                for at in range(0, len(wanted), _BATCH):
                    net.step(context[at : at + _BATCH], wanted[at : at + _BATCH], rate)
                seen += len(wanted)

            for batch in batches:
                for body in batch["t"]:
                    ids = tokens(body.as_py())
                    if len(ids):
                        held.append((contexts(ids), ids))
                        size += len(ids)
                    if size >= 4 * _BATCH:
                        learn()
                        held, size = [], 0
            if held:
                learn()
            if counts.any():
                flat = net.pack().astype(np.float64) * seen
                flat = np.concatenate([flat, counts, [seen]])
                for block, at in enumerate(range(0, len(flat), _BLOCK)):
                    yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([flat[at : at + _BLOCK].tobytes()])], names=["block", "x"])

        def add(frame: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, np.float64) for x in frame["x"])
            return pd.DataFrame({"block": frame["block"].iloc[:1], "x": [total.tobytes()]})

        shape = "block int, x binary"
        # Two levels, so that no task holds the copies of all partitions.
        parts = texts.mapInArrow(train, shape)
        some = parts.withColumn("s", F.pmod(F.spark_partition_id(), F.lit(64))).groupBy("block", "s").applyInPandas(add, shape)
        total = some.groupBy("block").applyInPandas(add, shape).orderBy("block").collect()  # one network
        if not total:
            return self.flat, np.zeros(TOKENS)
        flat = np.frombuffer(b"".join(bytes(r["x"]) for r in total), np.float64)
        weights, counts, seen = flat[: len(self.flat)], flat[len(self.flat) : -1], flat[-1]
        return (weights / seen).astype(np.float32) if seen else self.flat, counts

    def score(self, df: DataFrame, text: str = "text") -> DataFrame:
        """df with n_tokens, score (sum of log-probabilities) and mean_score added or replaced."""
        model = df.sparkSession.sparkContext.broadcast((self.flat, self.log_share))

        @F.pandas_udf("n bigint, s double")
        def judged(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            net, share = WindowNetwork.unpack(model.value[0]), model.value[1]
            for texts in batches:
                sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
                held, size = [], 0

                def flush() -> None:
                    owner, context, ids = (np.concatenate(x) for x in zip(*held, strict=True))  # noqa: B023
                    for at in range(0, len(ids), _BATCH):
                        part = ids[at : at + _BATCH]
                        logs = net.log_classes(context[at : at + _BATCH])[np.arange(len(part)), part % CLASSES] + share[part]
                        np.add.at(sums, owner[at : at + _BATCH], logs)  # noqa: B023

                for i, body in enumerate(texts):
                    ids = tokens(body)
                    sizes[i] = len(ids)
                    if len(ids):
                        held.append((np.full(len(ids), i), contexts(ids), ids))
                        size += len(ids)
                    if size >= 4 * _BATCH:
                        flush()
                        held, size = [], 0
                if held:
                    flush()
                yield pd.DataFrame({"n": sizes, "s": np.round(sums, 4)})

        done = df.withColumn("__judged", judged.asNondeterministic()(F.col(text)))
        n, s = F.col("__judged.n"), F.col("__judged.s")
        return done.withColumns({"n_tokens": n, "score": s, "mean_score": F.round(s / F.nullif(n, F.lit(0)), 6)}).drop("__judged")
