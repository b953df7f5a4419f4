"""Byte-level BPE by an index of pair occurrences, for whole texts in bulk.

Texts are cut into pieces as the vocabulary's pattern says. All pieces that a
batch has not met before form one array of symbols, and an index holds where
each pair of the vocabulary occurs. Ranks that occur in a piece are applied in
ascending order, each to all its positions at once, and the neighbours' pairs
are entered anew. Short pieces, nearly all of them, go side by side: a step
applies the lowest rank of every piece. In longer ones an index from ranks to
positions tells where each rank occurs, so that no step reads a whole piece.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .words import bound_batches, give_back_memory

# Fixed value: the pattern of the byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same pattern for texts of common signs and Latin letters only, which the standard module cuts faster.
_LATIN = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_LATIN_TEXT = re.compile(rf"[\t\n\r\x20-\x7e{_LATIN}]*")
_LATIN_PIECE = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LATIN}]+| ?[0-9]+| ?[^\s{_LATIN}0-9]+|\s+(?!\S)|\s+")
#: Characters of texts that are encoded together, and pieces remembered between batches.
BATCH_CHARACTERS = 2_000_000
REMEMBERED_PIECES = 150_000
#: Bytes of the longest piece that is merged side by side with others, in as many steps at most.
SHORT_PIECE = 128
#: Bytes of pieces that are merged side by side, so that memory doesn't grow with the new pieces of a batch.
SIDE_BY_SIDE = 1 << 17
#: Rows that are answered together.
ROWS = 250
#: Stretches that are copied at once.
SLICE = 1 << 14


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: printable ones for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@dataclass(frozen=True)
class Vocabulary:
    """What coders need of a tokenizer file, in arrays, so that no task parses the file or holds its objects.

    The bytes of token i end at `ends[i]` of `joined`; `left`, `right` and `merged` are ids by rank.
    """

    joined: bytes
    ends: np.ndarray
    added: dict[str, int]
    byte_ids: np.ndarray
    left: np.ndarray
    right: np.ndarray
    merged: np.ndarray


def read_vocabulary(tokenizer_json: str) -> Vocabulary:
    """The vocabulary of a tokenizer file with a byte-level BPE model."""
    content = json.loads(tokenizer_json)
    model, letters = content["model"], byte_letters()
    ids = model["vocab"]
    token_bytes = [b""] * (max([*ids.values(), *(t["id"] for t in content["added_tokens"])]) + 1)
    for token, i in ids.items():
        token_bytes[i] = bytes(letters[c] for c in token)
    added = {t["content"]: t["id"] for t in content["added_tokens"]}
    for token, i in added.items():
        token_bytes[i] = token.encode()
    byte_ids = np.zeros(256, np.int32)
    for letter, byte in letters.items():
        byte_ids[byte] = ids[letter]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    left = np.array([ids[a] for a, _ in pairs], np.int64)
    right = np.array([ids[b] for _, b in pairs], np.int64)
    merged = np.array([ids[a + b] for a, b in pairs], np.int64)
    return Vocabulary(b"".join(token_bytes), np.cumsum(list(map(len, token_bytes))), added, byte_ids, left, right, merged)


def _free(at: np.ndarray, follow: np.ndarray) -> np.ndarray:
    """Which pairs of one rank merge: in a run of equal symbols every other one, from the left."""
    chained = np.r_[False, follow[:-1] == at[1:]][: len(at)]
    starts = np.maximum.accumulate(np.where(chained, 0, np.arange(len(at))))
    return (np.arange(len(at)) - starts) % 2 == 0


def _strung(values: np.ndarray, ends: np.ndarray, picked: np.ndarray) -> np.ndarray:
    """The picked stretches of `values` one after another; stretch i goes from `ends[i]` to `ends[i + 1]`."""
    parts = [values[:0]]
    for some in (picked[at : at + SLICE] for at in range(0, len(picked), SLICE)):
        counts = ends[some + 1] - ends[some]
        total = np.cumsum(counts)
        parts.append(values[np.repeat(ends[some + 1] - total, counts) + np.arange(total[-1])])
    return parts[1] if len(parts) == 2 else np.concatenate(parts)


def _stretches(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all parts in a row, and their ends after a 0."""
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0, *map(len, parts)])


class _Numbers(dict):
    """Numbers of pieces, from 0; those met for the first time get the next one and are listed as new."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        return self.setdefault(piece, len(self))


class PairIndexCoder:
    """Encoder and decoder for a vocabulary."""

    def __init__(self, vocabulary: Vocabulary):
        import regex

        self.added, self.byte_ids = vocabulary.added, vocabulary.byte_ids
        self.left, self.right, self.merged = vocabulary.left, vocabulary.right, vocabulary.merged
        keys = self.left << 32 | self.right
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.byte_ranks = self._ranks(self.byte_ids[:, None], self.byte_ids)
        self.pattern = regex.compile(PATTERN)
        self.special = regex.compile("|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) or "(?!)")
        self.token_bytes = np.frombuffer(vocabulary.joined, np.uint8), np.r_[0, vocabulary.ends]
        self.names = _stretches([b"%d," % i for i in range(len(vocabulary.ends))])
        self._forget()

    def _forget(self) -> None:
        """Start without known pieces; the ids of piece i go from `ends[i]` to `ends[i + 1]` of `ids`."""
        self.known = _Numbers()
        self.ids, self.ends = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where the vocabulary has none."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.order[at], -1)

    def merge_all(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces in a row, and the number of ids of each piece."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        signs = np.frombuffer(b"".join(pieces), np.uint8)
        piece = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        short = (lengths <= SHORT_PIECE)[piece]
        parts = [(self.byte_ids[:0], piece[:0])]
        if not short.all():
            parts.append(self._merge_long(signs[~short], piece[~short]))
        signs, piece = signs[short], piece[short]
        cuts = np.searchsorted(piece, piece[::SIDE_BY_SIDE])  # no piece is cut
        parts += map(self._merge_short, np.split(signs, cuts)[1:], np.split(piece, cuts)[1:])
        ids, piece = map(np.concatenate, zip(*parts))
        return ids[np.argsort(piece, kind="stable")], np.bincount(piece, minlength=len(pieces))

    def _merge_short(self, signs: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids, and the piece of each, in order within a piece; a step applies the lowest rank of every piece."""
        none = len(self.keys)
        symbols = self.byte_ids[signs]

        def ranks_at(positions: np.ndarray) -> np.ndarray:
            """Ranks of the pairs that start at these positions, `none` where there is none."""
            follow = np.minimum(positions + 1, len(piece) - 1)
            ranks = self._ranks(symbols[positions], symbols[follow])
            return np.where((ranks >= 0) & (positions < follow) & (piece[positions] == piece[follow]), ranks, none)

        ranks = np.append(self.byte_ranks[signs[:-1], signs[1:]], none)
        ranks[(np.diff(piece, append=-1) != 0) | (ranks < 0)] = none
        ready = []
        while len(symbols):
            starts = np.flatnonzero(np.diff(piece, prepend=-1))
            lowest = np.minimum.reduceat(ranks, starts)
            lowest = np.repeat(lowest, np.diff(starts, append=len(piece)))
            merges = lowest < none
            if not merges.all():
                ready.append((symbols[~merges], piece[~merges]))
                symbols, piece, ranks, lowest = symbols[merges], piece[merges], ranks[merges], lowest[merges]
            at = np.flatnonzero(ranks == lowest)
            at = at[_free(at, at + 1)]
            symbols[at] = self.merged[lowest[at]]
            kept, changed = np.ones(len(symbols), bool), np.zeros(len(symbols), bool)
            kept[at + 1], changed[at] = False, True
            symbols, piece, ranks, changed = symbols[kept], piece[kept], ranks[kept], changed[kept]
            changed[:-1] |= changed[1:]  # the pair before a merged one is another, too
            at = np.flatnonzero(changed)
            ranks[at] = ranks_at(at)
        ids, piece = map(np.concatenate, zip(*ready))
        return ids, piece

    def _merge_long(self, signs: np.ndarray, piece: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As `_merge_short`, by an index from ranks to positions; each step reads the positions of one rank."""
        symbols, n = self.byte_ids[signs], len(signs)
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        starts = np.flatnonzero(np.diff(piece, prepend=-1))
        before[starts] = after[starts[1:] - 1] = after[-1] = -1
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(positions: np.ndarray) -> None:
            """Enter pairs that start at these positions under their ranks."""
            ranks = self._ranks(symbols[positions], symbols[after[positions]])
            positions, ranks = positions[ranks >= 0], ranks[ranks >= 0]
            if not len(ranks):
                return
            by_rank = np.argsort(ranks, kind="stable")
            positions, ranks = positions[by_rank], ranks[by_rank]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for rank, group in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts)):
                if rank not in index:
                    index[rank] = []
                    heapq.heappush(active, rank)
                index[rank].append(group)

        add(np.flatnonzero(after >= 0).astype(np.int32))
        while active:
            rank = heapq.heappop(active)
            groups = index.pop(rank)
            at = groups[0] if len(groups) == 1 else np.unique(np.concatenate(groups))
            left, right = self.left[rank], self.right[rank]
            follow = after[at]
            holds = (symbols[at] == left) & (follow >= 0) & (symbols[follow] == right)
            at, follow = at[holds], follow[holds]
            if left == right:
                free = _free(at, follow)
                at, follow = at[free], follow[free]
            if not len(at):
                continue
            beyond = after[follow]
            symbols[at] = self.merged[rank]
            symbols[follow] = -1
            after[at] = beyond
            before[beyond[beyond >= 0]] = at[beyond >= 0]
            ahead = before[at]
            ahead = ahead[ahead >= 0]
            add(np.unique(np.concatenate([at[beyond >= 0], ahead])))
        kept = symbols >= 0
        return symbols[kept], piece[kept]

    def pieces(self, text: str) -> list[str]:
        """The text cut by the pattern; special tokens stand for themselves."""
        cut = (_LATIN_PIECE if _LATIN_TEXT.fullmatch(text) else self.pattern).findall
        if not any(token in text for token in self.added):
            return cut(text)
        found, start = [], 0
        for token in self.special.finditer(text):
            found += cut(text[start : token.start()])
            found.append(token[0])
            start = token.end()
        return found + cut(text[start:])

    def learn(self) -> None:
        """Encode the pieces that have a number and no ids yet."""
        new, self.known.new = self.known.new, []
        plain = [p for p in new if p not in self.added]
        ids, counts = self.merge_all([p.encode() for p in plain])
        if len(plain) < len(new):
            given = np.array([self.added.get(p, -1) for p in new])
            sizes = np.ones(len(new), np.int64)
            sizes[given < 0] = counts
            whole = np.repeat(given, sizes)
            whole[whole < 0] = ids
            ids, counts = whole, sizes
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(counts)])

    def encode(self, texts: list[str]) -> Iterator[str]:
        """Decimal ids joined by commas of each text."""
        return (self.spell(ids).decode() for ids in self.encode_ids(texts))

    def encode_ids(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text; texts are taken in bounded batches."""
        start = 0
        while start < len(texts):
            if len(self.known) > REMEMBERED_PIECES:
                self._forget()
            end, size, cut = start, 0, []
            while end < len(texts) and (end == start or size + len(texts[end]) <= BATCH_CHARACTERS):
                size += len(texts[end])
                pieces = self.pieces(texts[end])
                cut.append(np.fromiter(map(self.known.__getitem__, pieces), np.int32, len(pieces)))
                end += 1
            self.learn()
            for numbers in cut:
                yield _strung(self.ids, self.ends, numbers)
            start = end

    def spell(self, ids: np.ndarray) -> bytes:
        """Ids as decimal numbers joined by commas."""
        return _strung(*self.names, ids)[:-1].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return _strung(*self.token_bytes, ids).tobytes().decode("utf-8", "replace")


def _sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def installed_vocabulary() -> str:
    """Path of the byte-level vocabulary among the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def _read(spark: SparkSession, path: str) -> str:
    """The vocabulary file, of bounded size, through Spark's readers if the driver has no such file."""
    if os.path.exists(path):
        with open(path, encoding="utf-8") as file:
            return file.read()
    return spark.read.text(path, wholetext=True).first()[0]


def encode_documents(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """`docs` with `token_ids` (decimal ids joined by commas), `n_tokens` and `decoded`, a row for a row.

    `tokenizer` is the path of a tokenizers file with a byte-level BPE model.
    A null text is taken as empty: no ids, 0 tokens, empty decoded text. Every
    row is encoded by itself, so repeated rows agree. Columns of the three
    names are replaced; others stay. The vocabulary, whose size doesn't depend
    on the data, is the only thing that is broadcast.
    """
    return _coded(docs, tokenizer, text, digests=False)


def token_digests(docs: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """As `encode_documents`, but `n_tokens`, `ids_sha256` and `decoded_sha256` in place of ids and text."""
    return _coded(docs, tokenizer, text, digests=True)


def _coded(docs: DataFrame, tokenizer: str, text: str, digests: bool) -> DataFrame:
    spark = docs.sparkSession
    bound_batches(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(_read(spark, tokenizer)))
    names = ("ids_sha256", "decoded_sha256") if digests else ("token_ids", "decoded")
    kept = [c for c in docs.columns if c not in (*names, "n_tokens")]
    whole = text in kept
    sent = docs.select(*(f"`{c}`" for c in kept), *([] if whole else [F.lit(None).cast("string").alias(text)]))
    if digests:  # the text itself isn't asked for
        kept = [c for c in kept if c != text]
    fields = [f for f in sent.schema.fields if f.name in kept]
    schema = StructType(
        [*fields, StructField("n_tokens", LongType()), *(StructField(name, StringType()) for name in names)]
    )

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PairIndexCoder(vocabulary.value)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts = ["" if t is None else t for t in batch.column(text).to_pylist()]
            ids, numbers, decoded = [], [], []
            for found in coder.encode_ids(texts):
                spelled, back = coder.spell(found), coder.decode(found)
                ids.append(_sha256(spelled) if digests else spelled.decode())
                decoded.append(_sha256(back.encode()) if digests else back)
                numbers.append(len(found))
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(numbers, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "n_tokens", *names])
        del coder
        give_back_memory()

    return sent.mapInArrow(code, schema)
