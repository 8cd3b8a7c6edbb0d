"""Fast exact encoding of text batches with a byte-level BPE tokenizer file.

A byte-level BPE splits text into pre-tokens and encodes each on its own. A pre-token never
spans the place before a single space that has a visible character on both sides, nor
either side of a single line feed between visible characters. So such a text may be
cut there, each distinct piece encoded once by the ``tokenizers`` library, and the ids
joined. Texts with any other white space are given to the library whole. A piece of plain letters is one
pre-token, so the library's model takes it as it is. All ways give the same ids; the tests compare them.

Special tokens' strings in a text are ordinary text.
"""

from __future__ import annotations

import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from sieve.llm.common import kept_in_worker

#: Pieces kept by a task (about 100 MB); when full, those met in fewest batches go.
CACHE_PIECES = 500_000
#: Text bytes encoded at once, and pieces given to the library in one string.
BATCH_BYTES, JOINED = 4 << 20, 20_000
#: Words that are one pre-token: ASCII letters and those of Latin-1.
PLAIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: How byte-level tokenizers write a byte that is no printable character: the next code point from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(PRINTABLE))}
#: White space, as Unicode names it, other than space and line feed; or two in a row; or a space at the end.
ODD_SPACE = r"[\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n]{2}| $|^ "


class Encoder:
    """``encode(array)`` gives all ids of a string array, concatenated, and each text's number of ids."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        probe = ["a", "Word", "ünder", "Éa", "strengthening", "qzxqv"]
        self.direct = all(self._plain(probe, chr(BYTES[32]) * n) == self._whole([" " * n + w for w in probe]) for n in (0, 1))
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.direct = self.direct and self.tokenizer.normalizer is None and not any(PLAIN(t.content.strip()) for t in added)
        self._reset()

    @classmethod
    def of(cls, path: str) -> Encoder:
        """One encoder for each Python worker; its tokenizer outlives a task, its cache ``rest`` empties."""
        return kept_in_worker(("encoder", path), lambda: cls(path))

    def rest(self) -> None:
        """Let go of all pieces."""
        self._reset()

    def _reset(self) -> None:
        self.known: tuple[dict, dict] = ({}, {})  # word -> place, as a piece without and with a space before it
        self.size, self.used = 0, 0
        self.starts, self.lengths, self.met = (np.zeros(1 << 16, np.int32) for _ in range(3))
        self.flat = np.zeros(1 << 18, np.uint32)
        for piece in ("", "\n"):
            self._add(np.array(self._whole([piece])[0], np.uint32), np.array([len(self._whole([piece])[0])], np.int64))
            self.known[0][piece] = self.size - 1

    def _add(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        total, n = len(flat), len(lengths)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.size + n > len(self.starts):
            self.starts, self.lengths, self.met = (np.concatenate([x, np.zeros_like(x)]) for x in (self.starts, self.lengths, self.met))
        self.flat[self.used:self.used + total] = flat
        self.starts[self.size:self.size + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[self.size:self.size + n] = lengths
        self.size, self.used = self.size + n, self.used + total

    def _evict(self) -> None:
        """Start anew with the pieces met in most batches, half of all at most; what they were met counts half from now on."""
        met, starts, lengths, flat, known = self.met[:self.size], self.starts, self.lengths, self.flat, self.known
        self._reset()
        least = np.sort(met)[-(CACHE_PIECES // 2):][0]
        for spaced in (0, 1):
            words, place = list(known[spaced]), np.fromiter(known[spaced].values(), np.int64, len(known[spaced]))
            keep = np.flatnonzero((met[place] > least) & (lengths[place] > 0))
            at, n = starts[place[keep]], lengths[place[keep]].astype(np.int64)
            ends, first = np.cumsum(n), self.size
            total = int(ends[-1]) if len(ends) else 0
            self._add(flat[np.arange(total) + np.repeat(at - (ends - n), n)], n)
            self.met[first:self.size] = met[place[keep]] // 2
            self.known[spaced].update(zip([words[i] for i in keep.tolist()], range(first, self.size), strict=True))

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _plain(self, words: list[str], lead: str) -> list[list[int]]:
        """Ids of words that are one pre-token each, with ``lead`` before them: what the library's model makes of them."""
        tokenize = self.tokenizer.model.tokenize
        return [[t.id for t in tokenize(lead + (w if w.isascii() else w.encode().decode("latin-1").translate(BYTES)))] for w in words]

    def _pieces(self, words: list[str], spaced: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each word's number of them, as a piece without or with a space before it; plain words and others apart."""
        space, lead = " " * spaced, chr(BYTES[32]) * spaced
        if not self.direct:
            return self._joined([space + w for w in words])
        plain = np.fromiter((w.isalpha() and (w.isascii() or PLAIN(w) is not None) for w in words), bool, len(words))
        ids = self._plain([words[i] for i in np.flatnonzero(plain).tolist()], lead)
        sizes = np.zeros(len(words), np.int64)
        sizes[plain] = [len(x) for x in ids]
        others = np.zeros(0, np.uint32)
        if not plain.all():
            others, sizes[~plain] = self._joined([space + words[i] for i in np.flatnonzero(~plain).tolist()])
        out, mine = np.zeros(int(sizes.sum()), np.uint32), np.repeat(plain, sizes)
        out[mine] = np.fromiter(chain.from_iterable(ids), np.uint32, int(sizes[plain].sum()))
        out[~mine] = others
        return out, sizes

    def _joined(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids and each piece's number of them. Pieces hold no line feed and do not end in white space, so line feeds between them
        are pre-tokens of their own and tell the pieces' ids apart."""
        feed = self._whole(["\n"])[0]
        if len(feed) != 1:
            ids = self._whole(pieces)
            return np.fromiter((i for x in ids for i in x), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids))
        flat, sizes = [], []
        for at in range(0, len(pieces), JOINED):
            ids = np.array(self._whole(["\n".join(pieces[at:at + JOINED])])[0], np.uint32)
            cut = ids == feed[0]
            ends = np.flatnonzero(cut)
            sizes.append(np.diff(np.r_[-1, ends, len(ids)]) - 1)
            flat.append(ids[~cut])
        return np.concatenate(flat), np.concatenate(sizes)

    def _numbers(self, words: list[str], spaced: int) -> np.ndarray:
        """Place of each word's piece in the cache; unknown ones are encoded first."""
        known = self.known[spaced]
        place = np.fromiter(map(known.get, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(place < 0)
        if len(new):
            missing, first = [words[i] for i in new.tolist()], self.size
            self._add(*self._pieces(missing, spaced))
            known.update(zip(missing, range(first, self.size), strict=True))
            place[new] = np.arange(first, self.size)
        self.met[place] += 1
        return place

    def _by_piece(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " \n "), " ")
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = pc.list_flatten(split).dictionary_encode()
        words, code = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy(zero_copy_only=False)
        feed = code == pc.index(coded.dictionary, "\n").as_py()
        first = np.zeros(len(code), bool)
        first[np.cumsum(counts) - counts] = True
        spaced = ~(first | feed)
        spaced[1:] &= ~feed[:-1]
        key = 2 * code + spaced
        seen = np.zeros(2 * len(words), bool)
        seen[key] = True
        if self.size + int(seen.sum()) > CACHE_PIECES:
            self._evict()
        place = np.zeros(2 * len(words), np.int64)
        for lead in (0, 1):
            used = np.flatnonzero(seen[lead::2])
            place[2 * used + lead] = self._numbers(words[used].tolist(), lead)
        starts, lengths = self.starts[place[key]], self.lengths[place[key]]
        ends = np.cumsum(lengths)
        at = np.arange(ends[-1] if len(ends) else 0, dtype=np.int32) + np.repeat((starts - (ends - lengths)).astype(np.int32), lengths)
        sizes = np.add.reduceat(lengths, np.cumsum(counts) - counts, dtype=np.int64) if len(counts) else np.zeros(0, np.int64)
        return self.flat[at], sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        odd = pc.match_substring_regex(texts, ODD_SPACE).to_numpy(zero_copy_only=False)
        # A line feed at either end leaves an empty piece, which has no ids; an empty text is one such piece.
        if not odd.any():
            return self._by_piece(texts)
        sizes = np.zeros(len(texts), np.int64)
        plain, sizes[~odd] = self._by_piece(texts.filter(pa.array(~odd)))
        whole = self._whole(texts.filter(pa.array(odd)).to_pylist())
        sizes[odd] = [len(x) for x in whole]
        out = np.zeros(int(sizes.sum()), np.uint32)
        from_plain = np.repeat(~odd, sizes)
        out[from_plain] = plain
        out[~from_plain] = np.fromiter((i for x in whole for i in x), np.uint32, int(sizes[odd].sum()))
        return out, sizes


def slices(texts: pa.Array, most: int = BATCH_BYTES):
    """(start, rows) runs of a batch that hold about ``most`` bytes of text, one row at least."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(lengths) // most
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(lengths)]
    return [(a, b - a) for a, b in zip(cuts[:-1], cuts[1:], strict=True) if b > a]


def with_end(ids: np.ndarray, sizes: np.ndarray, end_id: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end_id`` after each text's own, and the new sizes."""
    return np.insert(ids, np.cumsum(sizes), end_id), sizes + 1


def default_tokenizer() -> str:
    """The public 50k byte-level BPE file of this installation."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
