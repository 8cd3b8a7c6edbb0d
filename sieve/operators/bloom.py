"""Bloom filters of keys: which rows may have a key, told before anything is shuffled.

A filter is a table of words of 64 bits. A key's hash chooses one word and sets ``PROBES`` bits of it; the words are or-ed by one partial
aggregate, so the filter is built where its keys lie and no task or driver holds it while it is made. Rows meet it in a broadcast hash join on the
word's number: all built-in expressions, no shuffle of the rows. Rows without the key go, but for a small share (about 0.5 % at
``BITS`` bits a key, 4 % at ``LEAST_BITS``), so an exact join must follow.

The broadcast is bounded by the number of words, chosen beforehand: at most ``MAX_WORDS``, whatever the keys. More keys than that serves
(``CAPACITY``) get no filter, and callers shuffle as they would without one.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bits of one word that a key sets; each takes 6 bits of the hash, the word's number takes the others.
PROBES = 4
#: Bits for each key, and the fewest at which a filter is still worth its broadcast.
BITS, LEAST_BITS = 16, 8
#: Words of a filter: 64 MB at about 32 bytes each in a broadcast relation (number, bits, and the map's place).
MAX_WORDS = (64 << 20) // 32
CAPACITY = MAX_WORDS * 64 // LEAST_BITS

_WORD, _BITS, _MASK = "__bloom_word", "__bloom_bits", "__bloom_mask"


def n_words(n: int) -> int:
    """Words of a filter of ``n`` keys; 0 beyond ``CAPACITY``."""
    return 0 if n > CAPACITY else min(MAX_WORDS, max(1, -(-n * BITS // 64)))


def _marks(columns: list[str], words: int) -> tuple[Column, Column]:
    """The number of a key's word, and the bits it sets there."""
    h = F.xxhash64(*[F.col(c) for c in columns])
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(PROBES)]
    return F.pmod(F.shiftrightunsigned(h, 6 * PROBES), F.lit(words).cast("long")), reduce(Column.bitwiseOR, bits)


@dataclass(frozen=True)
class KeyFilter:
    """``table``: number and bits of every word that has any; ``words``: their number at most; ``types``: the keys'."""

    table: DataFrame
    words: int
    types: tuple[T.DataType, ...]

    def fits(self, rows: DataFrame, columns: list[str]) -> bool:
        """Whether keys in ``columns`` hash as the filter's do: equal values of other types do not."""
        return tuple(rows.schema[c].dataType for c in columns) == self.types

    def keep(self, rows: DataFrame, columns: list[str]) -> DataFrame:
        """``rows`` whose key may be one of the filter's: all that are, and a small share of the others.

        A NULL in a key is a value like any other; keys of other types raise; an empty filter keeps nothing."""
        if not self.fits(rows, columns):
            raise TypeError(f"keys of a filter of {self.types} cannot be looked for in {[rows.schema[c].dataType for c in columns]}")
        word, mask = _marks(columns, self.words)
        marked = rows.withColumns({_WORD: word, _MASK: mask}).join(F.broadcast(self.table), _WORD)
        return marked.where(F.col(_BITS).bitwiseAND(F.col(_MASK)) == F.col(_MASK)).select(*rows.columns)


def key_filter(keys: DataFrame, columns: list[str], n: int) -> KeyFilter | None:
    """A filter of the keys in ``columns``, of which there are about ``n`` (this sizes it; keys may repeat); None beyond ``CAPACITY``.

    ``keys`` should be a stored table: the filter is computed where it is used."""
    words = n_words(n)
    if not words:
        return None
    word, mask = _marks(columns, words)
    table = keys.select(word.alias(_WORD), mask.alias(_MASK)).groupBy(_WORD).agg(F.bit_or(_MASK).alias(_BITS))
    return KeyFilter(table, words, tuple(keys.schema[c].dataType for c in columns))
