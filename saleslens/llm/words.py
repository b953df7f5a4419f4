"""Words of whole texts as arrays of 64-bit hashes, without a Python object for each word."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

#: Bytes of texts that are hashed together; a longer text is cut between words.
CHUNK_BYTES = 250_000

#: Bytes of an Arrow batch, so that a task holds a bounded part of its texts on either side of the pipe.
BATCH_BYTES = 2 << 20

_U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit of an Arrow batch to `BATCH_BYTES`; Spark has no such limit for a single plan."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    if byte_count(spark.conf.get(setting)) > BATCH_BYTES:
        spark.conf.set(setting, f"{BATCH_BYTES}b")


#: glibc's way to return freed pages below ones in use, where arrays of numpy leave theirs; other systems have none.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back_memory() -> None:
    """Return what a task has freed to the system, as Python workers live on idle between tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def giving_back(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """A task's `work` on its batches, after which the worker holds no more memory than it needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back_memory()

    return run


def byte_count(size: str) -> int:
    """Bytes of a size as Spark's settings spell it: `8388608`, `8m`, `64mb`."""
    spelled = size.strip().lower()
    number = spelled.rstrip("bkmgtp")
    unit = spelled[len(number) :].removesuffix("b")
    return int(number) << 10 * ("", "k", "m", "g", "t", "p").index(unit)


def unused_name(columns: Iterable[str], name: str) -> str:
    """`name`, made longer until no column has it, whatever the case."""
    taken, name = {c.lower() for c in columns}, f"_{name}"
    while name in taken:
        name += "_"
    return name


def mix(values: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finaliser of splitmix64)."""
    values = values ^ (values >> _U64(30))
    values = values * _U64(0xBF58476D1CE4E5B9)
    values = values ^ (values >> _U64(27))
    values = values * _U64(0x94D049BB133111EB)
    return values ^ (values >> _U64(31))


def numbers(n: int, seed: int) -> np.ndarray:
    """`n` fixed pseudo-random 64-bit values."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=_U64) + _U64(seed) * _U64(1_000_003)) * _U64(_BASE))


def separator_table(white_only: bool) -> np.ndarray:
    """Which bytes part words: ASCII white space, or every ASCII byte but letters and digits."""
    byte = np.arange(256)
    white = (byte == 0x20) | ((byte >= 0x09) & (byte <= 0x0D))
    if white_only:
        return white
    letter = ((byte | 0x20) >= ord("a")) & ((byte | 0x20) <= ord("z"))
    digit = (byte >= ord("0")) & (byte <= ord("9"))
    return (byte < 128) & ~letter & ~digit


WHITE_SPACE = separator_table(True)
MARKS = separator_table(False)

#: Places of a word whose letters are looked up; letters beyond are mixed one by one.
_PLACES = 64
_LETTERS = numbers(_PLACES * 256, 1).reshape(_PLACES, 256)
_LETTERS[:, ord("A") : ord("Z") + 1] = _LETTERS[:, ord("a") : ord("z") + 1]
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def _letter_hashes(letters: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A random-looking number for each letter at its place in its word; no algebra relates one place to another."""
    found = _LETTERS[np.minimum(places, _PLACES - 1), letters]
    far = np.flatnonzero(places >= _PLACES)
    if len(far):
        found[far] = mix((places[far].astype(_U64) << _U64(8) | _LOWERED[letters[far]]) * _U64(_BASE))
    return found


def _hashed(data: np.ndarray, starts: np.ndarray, separators: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word; a word never crosses one of `starts`."""
    n = len(data)
    if not n:
        return np.empty(0, _U64), np.empty(0, np.int64)
    inside = ~separators[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    edge[0] = edge[n] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = end - begin
    sums = np.zeros(int(lengths.sum()) + 1, _U64)
    np.cumsum(_letter_hashes(data[inside], _places(lengths)), dtype=_U64, out=sums[1:])
    ends = np.cumsum(lengths)
    return mix(sums[ends] - sums[ends - lengths] + lengths.astype(_U64)), begin


def _long(data: np.ndarray, separators: np.ndarray) -> np.ndarray:
    """Word hashes of one long text, taken in parts that end between words."""
    found, at = [], 0
    while at < len(data):
        end = min(at + CHUNK_BYTES, len(data))
        while end < len(data) and not separators[data[end]]:
            ahead = np.flatnonzero(separators[data[end : end + CHUNK_BYTES]])
            end = end + int(ahead[0]) if len(ahead) else min(end + CHUNK_BYTES, len(data))
        found.append(_hashed(data[at:end], np.zeros(1, np.int64), separators)[0])
        at = end
    return np.concatenate(found)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in a row, and where each begins and ends; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    values = column.buffers()[2]
    data = np.frombuffer(values, np.uint8) if values is not None else np.empty(0, np.uint8)
    return data, offsets


def words_of(column: pa.Array, separators: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of the first text, word count of each text, and all word hashes, chunk after chunk.

    A-Z are taken as a-z. Null and empty texts have no words.
    """
    if not len(column):
        return
    data, offsets = text_bytes(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1)
        last = min(last, len(column))
        low, high = int(offsets[first]), int(offsets[last])
        if last == first + 1 and high - low > CHUNK_BYTES:
            hashes = _long(data[low:high], separators)
            yield first, np.array([len(hashes)]), hashes
        else:
            bounds = offsets[first : last + 1] - low
            hashes, begin = _hashed(data[low:high], bounds, separators)
            yield first, np.diff(np.searchsorted(begin, bounds, "left")), hashes
        first = last


def _places(counts: np.ndarray) -> np.ndarray:
    """Place of each word in its text."""
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def gram_hashes(hashes: np.ndarray, steps: tuple[int, ...]) -> np.ndarray:
    """Hash of the words at these steps from each word, for all but the last `max(steps)` words."""
    n = max(len(hashes) - max(steps), 0)
    total = np.full(n, len(steps), _U64)
    for i, step in enumerate(steps):
        total += hashes[step : step + n] * _COEFFICIENTS[i]
    return mix(total)


_COEFFICIENTS = numbers(64, 2) | _U64(1)


def grams(counts: np.ndarray, hashes: np.ndarray, steps: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the grams that lie within one text, and the place of their first word among all words."""
    found = gram_hashes(hashes, steps)
    left = np.repeat(counts, counts) - _places(counts)
    at = np.flatnonzero(left[: len(found)] > max(steps))
    return found[at], at


def shingles(counts: np.ndarray, hashes: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Number of shingles of each text, and their hashes; fewer words than asked for make one shingle."""
    found, at = grams(counts, hashes, tuple(range(words)))
    begins = np.cumsum(counts) - counts
    for n in range(1, words):
        short = begins[counts == n]
        if len(short):
            total = np.full(len(short), n, _U64)
            for i in range(n):
                total += hashes[short + i] * _COEFFICIENTS[i]
            found, at = np.concatenate([found, mix(total)]), np.concatenate([at, short])
    order = np.argsort(at, kind="stable")
    sizes = np.where(counts >= words, counts - words + 1, np.minimum(counts, 1))
    return sizes, found[order]
