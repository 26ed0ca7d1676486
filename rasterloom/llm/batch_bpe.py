"""BPE encoding and decoding with batched numpy merge rounds.

The distinct words (pre-tokens) of a batch of texts stand one after the other in one flat array of symbols. In each round
every word's pair of lowest rank is merged, wherever the word has it, from left to right; pairs are ranked by binary
search over the sorted keys of all merges. Words without a pair that merges leave the array. A pair that a merge makes
has a higher rank than the merge itself, so a round of a word's lowest pair does what merging one pair at a time does.

Added tokens are cut out of a text first, the leftmost first (ties: the longest), and have their own ids.

Edge cases: a null text counts as empty, an empty text has no ids; null ids decode to an empty text. Repeated rows, null
doc ids and extra columns pass through; a column with the result's name is replaced. An empty table has an empty result.
Texts are taken whole, whatever their length.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

from .staging import bounded_batches

_NONE = np.int64(1 << 40)
#: Characters of text after which a batch of words is encoded.
_CHARS = 4_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself if it is visible in Latin-1,
    else the next free one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(free)) for b in range(256)]


class Merges:
    """A byte-level vocabulary with its merges and added tokens, read from the JSON file at ``path``."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model, before, after = told["model"], told["pre_tokenizer"] or {}, told["decoder"] or {}
        plain = {"dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
        odd = {k: model[k] for k, v in plain.items() if (model.get(k) or v) != v}
        if model["type"] != "BPE" or told["normalizer"] or odd or before.get("type") != "ByteLevel" or after.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError(f"{path} is not a plain byte-level BPE {odd or ''}")
        vocabulary: dict[str, int] = model["vocab"]
        added = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in told["added_tokens"]):
            raise ValueError(f"{path} has added tokens that depend on what is around them")
        symbols = byte_symbols()
        byte_of = {c: b for b, c in enumerate(symbols)}
        self.first = np.array([vocabulary[c] for c in symbols], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.shift = np.int64(max(vocabulary.values()) + 1)
        left, right, made = (np.array([vocabulary[x] for x in side], np.int64) for side in zip(*((a, b, a + b) for a, b in pairs), strict=True))
        keys = left * self.shift + right
        order = np.argsort(keys)
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int64), made
        size = max([*vocabulary.values(), *added.values()]) + 1
        self.raw = np.full(size, b"", object)
        for token, number in vocabulary.items():
            self.raw[number] = bytes(byte_of[c] for c in token)
        for token, number in added.items():
            self.raw[number] = token.encode()
        self.added = added
        self.cut = regex.compile("|".join(map(regex.escape, sorted(added, key=len, reverse=True)))) if added else None

    def ranked(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair, or _NONE."""
        wanted = left * self.shift + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, one after the other; where each word's ids start, and the end). No word is empty."""
        if not words:
            return np.empty(0, np.int64), np.zeros(1, np.int64)
        symbols = self.first[np.frombuffer(b"".join(words), np.uint8)]
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        names = np.arange(len(words))
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        # rank[i]: of the symbols at i and i + 1; none at a word's last symbol.
        ends = np.cumsum(sizes)
        rank = np.append(self.ranked(symbols[:-1], symbols[1:]), _NONE)
        rank[ends - 1] = _NONE
        while len(names):
            starts = ends - sizes
            least = np.minimum.reduceat(rank, starts)
            over = least == _NONE
            if over.any():
                gone = np.repeat(over, sizes)
                done.append((names[over], sizes[over], symbols[gone]))
                symbols, rank, names, sizes, least = symbols[~gone], rank[~gone], names[~over], sizes[~over], least[~over]
                ends = np.cumsum(sizes)
                if not len(names):
                    break
                starts = ends - sizes
            at = np.flatnonzero(rank == np.repeat(least, sizes))
            # Of overlapping pairs (equal symbols in a row) every other one is merged, from the left.
            fresh = np.ones(len(at), bool)
            fresh[1:] = at[1:] != at[:-1] + 1
            head = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - head) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            stays = np.ones(len(symbols), bool)
            stays[at + 1] = False
            # A merge reads its right partner's rank anew, and so does the symbol before it.
            rank[at] = np.where(rank[at + 1] == _NONE, rank[at + 1], -1)
            last = np.zeros(len(symbols), bool)
            last[ends - 1] = True
            ends_at = last[at + 1]
            sizes = sizes - np.add.reduceat((~stays).astype(np.int64), starts)
            moved = np.cumsum(stays) - 1
            symbols, rank = symbols[stays], rank[stays]
            ends = np.cumsum(sizes)
            at = moved[at]
            rank[at[ends_at]] = _NONE
            redo = np.concatenate([at[~ends_at], at[~np.isin(at, ends - sizes)] - 1])
            rank[redo] = self.ranked(symbols[redo], symbols[redo + 1])
        lengths = np.zeros(len(words) + 1, np.int64)
        for name, size, _ in done:
            lengths[name + 1] = size
        offsets = np.cumsum(lengths)
        ids = np.empty(offsets[-1], np.int64)
        for name, size, found in done:
            ids[_spread(offsets[name], size)] = found
        return ids, offsets


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for sizes[0] places, then the same for the others."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)


@lru_cache(maxsize=2)
def _merges(path: str) -> Merges:
    return Merges(path)


class Splitter:
    """Cuts texts into words by the pattern. Whether a character that is new in Unicode counts as a letter or number differs
    between the regex library and the tokenizers library, whose answer holds."""

    def __init__(self, pattern: str):
        import regex
        from tokenizers.pre_tokenizers import ByteLevel

        assigned = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
        recent = [c for c in regex.findall(r"[\p{L}\p{N}]", assigned) if unicodedata.category(c) == "Cn"]
        told = ByteLevel(add_prefix_space=False).pre_tokenize_str("".join(f"!{c}!" for c in recent))
        # A character that is no letter or number stays together with the marks around it.
        ends = {end for _, (_, end) in told}
        new = "".join(c for k, c in enumerate(recent) if 3 * k + 2 not in ends)
        self.plain = regex.compile(pattern)
        self.new, self.careful = frozenset(), None
        if new:
            other = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{new}]]")
            other = other.replace(r" ?\p{L}", rf" ?[\p{{L}}--[{new}]]").replace(r" ?\p{N}", rf" ?[\p{{N}}--[{new}]]")
            self.new, self.careful = frozenset(new), regex.compile(f"(?V1){other}")

    def findall(self, text: str) -> list[str]:
        if text.isascii() or self.new.isdisjoint(text):
            return self.plain.findall(text)
        return self.careful.findall(text)


@lru_cache(maxsize=2)
def splitter(pattern: str) -> Splitter:
    return Splitter(pattern)


def _numbered(text: str, merges: Merges, words: Splitter, numbers: dict[str, int]) -> list[int]:
    """The numbers of a text's words in ``numbers``; an added token's is -1 less its id."""
    found: list[int] = []
    put = lambda part: found.extend([numbers.setdefault(word, len(numbers)) for word in words.findall(part)])
    at = 0
    for cut in merges.cut.finditer(text) if merges.cut else ():
        put(text[at : cut.start()])
        found.append(-1 - merges.added[cut.group()])
        at = cut.end()
    put(text[at:] if at else text)
    return found


def encode_texts(texts: list[str], merges: Merges, words: Splitter) -> list[np.ndarray]:
    """The ids of each text."""
    numbers: dict[str, int] = {}
    per_text = [np.array(_numbered(text, merges, words, numbers), np.int64) for text in texts]
    ids, offsets = merges.encode_words([word.encode() for word in numbers])
    specials = np.array(sorted(merges.added.values()), np.int64)
    # Added tokens stand behind the words.
    base = len(ids)
    flat = np.concatenate([ids, specials])
    out = []
    for found in per_text:
        special = found < 0
        named = np.where(special, 0, found)
        starts = offsets[named] if len(numbers) else np.zeros(len(found), np.int64)
        sizes = offsets[named + 1] - starts if len(numbers) else np.ones(len(found), np.int64)
        if special.any():
            starts = np.where(special, base + np.searchsorted(specials, -1 - found), starts)
            sizes = np.where(special, 1, sizes)
        out.append(flat[_spread(starts, sizes)])
    return out


def _mapped(df: DataFrame, column: str, to: str, kind: DataType, fn: Callable[[list], list], of_size: Callable[[pa.Array], pa.Array]) -> DataFrame:
    """df with the column ``to``: fn of lists of the column's values, of about _CHARS in all."""
    bounded_batches(df.sparkSession)
    kept = [c for c in df.columns if c != to]
    at, keep = df.columns.index(column), [df.columns.index(c) for c in kept]
    arrow = pa.binary() if isinstance(kind, BinaryType) else pa.string()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.cumsum(of_size(batch.column(at)).fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < batch.num_rows:
                before = sizes[start - 1] if start else 0
                end = max(start + 1, int(np.searchsorted(sizes, before + _CHARS)))
                part = batch.slice(start, end - start)
                made = pa.array(fn(part.column(at).to_pylist()), arrow)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in keep), made], names=[*kept, to])
                start = end

    return df.mapInArrow(rows, StructType([df.schema[c] for c in kept] + [StructField(to, kind)]))


class BatchBPE:
    """Encoder and decoder for the JSON file at ``path``, which every executor can open; ``pattern`` splits words."""

    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def encode(self, df: DataFrame, text: str = "text", to: str = "ids") -> DataFrame:
        """df with the column ``to``: ids as little-endian unsigned 32-bit integers."""
        path, pattern = self.path, self.pattern

        def ids(texts: list[str | None]) -> list[bytes]:
            coded = encode_texts([t or "" for t in texts], _merges(path), splitter(pattern))
            return [c.astype("<u4").tobytes() for c in coded]

        return _mapped(df, text, to, BinaryType(), ids, lambda a: pa.compute.utf8_length(a))

    def decode(self, df: DataFrame, ids: str = "ids", to: str = "decoded") -> DataFrame:
        """df with the column ``to``: the text of the tokens' bytes, with U+FFFD for what is no UTF-8."""
        path = self.path

        def texts(coded: list[bytes | None]) -> list[str]:
            raw = _merges(path).raw
            return [b"".join(raw[np.frombuffer(c or b"", "<u4")].tolist()).decode("utf-8", "replace") for c in coded]

        return _mapped(df, ids, to, StringType(), texts, lambda a: pa.compute.binary_length(a))
