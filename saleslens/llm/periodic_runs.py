"""Runs of words that repeat with a period, caught while the words of a text are appended one by one.

For each power of two B there are catchers for periods above B / 2, up to B.
Whenever a block of B words is completed at a multiple of B / 2, its nearest
earlier occurrence is looked for among the last 2 B words. If it lies d words
back, the block and the d words before it are the beginning of a run with
period d. The run is extended to the left once and compared with each appended
word from then on, so later squares of the same run merge into it.

Why nothing is missed: in a run with smallest period q and at least 4 q words, a
block of B >= q words occurs again at multiples of q only, so the nearest
occurrence of every block that lies q words or more inside the run is q words
back. There are at least 3 q - B + 1 > B / 2 places in a row where such a block
can end, and one of them is a multiple of B / 2.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from .words import bound_batches

#: Rows that are answered together.
ROWS = 500
RUN = StructType([StructField(name, LongType(), False) for name in ("start", "length", "period")])
#: Powers of the period below this are not proved to be caught.
LEAST_EXPONENT = 4

Run = tuple[int, int, int]


class SquareCatchers:
    """Catchers for the words appended so far; a word is compared once with each run that is still growing."""

    def __init__(self, least_words: int = 6, exponent: int = LEAST_EXPONENT):
        if exponent < LEAST_EXPONENT:
            raise ValueError(f"runs of less than {LEAST_EXPONENT} periods could be missed")
        self.least_words, self.exponent = least_words, exponent
        self.ids = array("I")
        self._known: dict[bytes, int] = {}
        self._last = array("q")  # the latest place of each different word
        self._growing: dict[int, int] = {}  # start by period
        self._closed: list[Run] = []

    def append(self, words: Iterable[bytes]) -> None:
        known, last, growing, ids = self._known, self._last, self._growing, self.ids
        for word in words:
            place = len(ids)
            this = known.setdefault(word, len(known))
            ids.append(this)
            if this == len(last):  # a new word
                last.append(place)
                if growing:
                    self._extend(place)
                continue
            back = place - last[this]
            last[this] = place
            if growing:
                self._extend(place)
            end = place + 1
            most = min((end & -end) * 2, end - back)  # blocks that are completed here, with room for a period before them
            if back <= most:
                block = 1 << (back - 1).bit_length()  # periods below `back` can't be: this word isn't there
                while block <= most:
                    self._catch(end, block)
                    block *= 2

    def _extend(self, place: int) -> None:
        """Compare the word at `place` in all runs that grow; those that it breaks are closed."""
        this = self.ids[place]
        broken = [period for period in self._growing if self.ids[place - period] != this]
        for period in broken:
            self._close(self._growing.pop(period), place, period)

    def _close(self, start: int, end: int, period: int) -> None:
        if end - start >= max(self.least_words, self.exponent * period):
            self._closed.append((start, end - start, period))

    def _catch(self, end: int, block: int) -> None:
        """The catcher of `block` words that end at `end`."""
        ids = self.ids
        begin = max(end - 2 * block, 0)
        recent = ids[begin:end][::-1].tobytes()  # the latest word first
        width = ids.itemsize
        sought = recent[: block * width]
        at = recent.find(sought, width)
        while at % width and at > 0:  # not between words
            at = recent.find(sought, at + 1)
        period = at // width
        if at < 0 or period <= block // 2 or period in self._growing:
            return
        start = end - block - period
        while start and ids[start - 1] == ids[start - 1 + period]:
            start -= 1
        self._growing[period] = start

    def runs(self) -> list[Run]:
        """Start, length and period of all runs so far, by start, then period."""
        closed = len(self._closed)
        for period, start in self._growing.items():
            self._close(start, len(self.ids), period)
        found = sorted(self._closed, key=lambda run: (run[0], run[2]))
        del self._closed[closed:]
        return found


def collapse(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that a run repeats after its first period."""
    kept, at = [], 0
    for begin, end in sorted((start + period, start + length) for start, length, period in runs):
        kept += words[at:begin]
        at = max(at, end)
    return b" ".join(kept + words[at:])


def find_runs(docs: DataFrame, text: str = "text", least_words: int = 6, exponent: int = LEAST_EXPONENT) -> DataFrame:
    """`docs` with `n_words`, `runs` (start, length, period) and `collapsed`, a row for a row.

    Words are what ASCII white space parts, numbered from 0. A run is a stretch
    with smallest period q, at least `least_words` and `exponent` * q words long,
    that can't be made longer on either side. Runs are in order of start, then
    period; no two agree in both. `collapsed` is the text without the words
    that a run holds after its first q. A null text is taken as empty: no words,
    no runs, an empty collapsed text. Each row is handled by itself, so repeated
    rows agree. Columns of the three names are replaced; all others stay. The
    work for a text grows with words times the logarithm of their number,
    and memory with its words; no row meets another one.
    """
    if exponent < LEAST_EXPONENT:
        raise ValueError(f"runs of less than {LEAST_EXPONENT} periods could be missed")
    bound_batches(docs.sparkSession)
    names = ("n_words", "runs", "collapsed")
    kept = [c for c in docs.columns if c not in names]
    sent = docs.select(*(f"`{c}`" for c in kept), *([] if text in kept else [F.lit(None).cast("string").alias(text)]))
    fields = [f for f in sent.schema.fields if f.name in kept]
    kinds = (LongType(), ArrayType(RUN, False), StringType())
    schema = StructType([*fields, *(StructField(name, kind) for name, kind in zip(names, kinds))])
    run_type = pa.list_(pa.struct([pa.field(f.name, pa.int64(), False) for f in RUN.fields]))

    def catch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            counts, found, collapsed = [], [], []
            for value in batch.column(text):
                words = (value.as_py() or "").encode().split()
                catchers = SquareCatchers(least_words, exponent)
                if len(words) >= least_words:
                    catchers.append(words)
                runs = catchers.runs()
                counts.append(len(words))
                found.append([dict(zip(RUN.names, run)) for run in runs])
                collapsed.append(collapse(words, runs).decode())
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(counts, pa.int64()), pa.array(found, run_type), pa.array(collapsed, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *names])

    return sent.mapInArrow(catch, schema)
