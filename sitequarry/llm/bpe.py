"""Byte-level BPE over whole texts: ids through a cache of pieces, and token counts at every prefix.

A byte-level BPE tokenizer first cuts a text into pieces by a fixed pattern and then encodes each piece by
itself.  Most pieces of a corpus repeat, so ids of a piece are kept (up to a bound) and the library is only
asked for new ones.  Texts with characters whose Unicode class has changed over time, or with one of the
tokenizer's added tokens, are left to the library as a whole.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import cache, lru_cache
from itertools import chain, compress, pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer, pre_tokenizers

from sitequarry.llm.batches import CACHES

#: Pieces kept per process; a longer piece than MAX_KEPT characters is not kept.
MAX_PIECES = 700_000
MAX_KEPT = 40
#: Ids kept per process, for all pieces together.
MAX_IDS = 4_000_000
MAX_PAIRS = 400_000
#: Whole texts kept per process, for copies that follow each other; a longer text than this is not kept.
MAX_TEXTS, MAX_TEXT_KEPT = 3_000, 20_000

#: Code points that the Unicode property White_Space holds.  Fixed values.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680]
WHITE_SPACE += [*range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_WHITE = frozenset(WHITE_SPACE)
_LONG_CONTRACTIONS = ("'ll", "'re", "'ve")


def _ranges(points: list[int]) -> str:
    """A regex class body for sorted code points."""
    cuts = np.flatnonzero(np.diff(points) != 1)
    firsts = [points[0], *(points[i + 1] for i in cuts)]
    lasts = [*(points[i] for i in cuts), points[-1]]
    return "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in zip(firsts, lasts, strict=True))


_DOUBLE_SPACE = re.compile(f"[{_ranges(WHITE_SPACE)}]{{2}}")


@cache
def _sure() -> list[int]:
    """Code points whose Unicode class has not changed over time."""
    old = unicodedata.ucd_3_2_0
    return [
        c
        for c in range(0x10000)
        if unicodedata.category(chr(c)) == old.category(chr(c)) and old.category(chr(c))[0] != "C"
        or c in WHITE_SPACE
    ]


@cache
def patterns() -> tuple[re.Pattern, re.Pattern]:
    """The pattern that cuts texts into pieces, and one that finds characters it isn't sure about."""
    sure = _sure()
    kinds = {k: _ranges([c for c in sure if unicodedata.category(chr(c))[0] == k]) for k in "LN"}
    space = _ranges(WHITE_SPACE)
    letters, numbers = kinds["L"], kinds["N"]
    # Letters first: most pieces are words, and none of the contractions starts like one.
    cut = re.compile(
        f" ?[{letters}]+|'(?:[stmd]|re|ve|ll)| ?[{numbers}]+| ?[^{space}{letters}{numbers}]+"
        f"|[{space}]+(?![^{space}])|[{space}]+"
    )
    return cut, re.compile(f"[^{_ranges(sure)}]")


#: Kinds of characters as the pattern has them.
_LETTER, _NUMBER, _BLANK, _OTHER, _UNSURE = range(5)


@cache
def _kinds() -> np.ndarray:
    """The kind of each code point; the last entry stands for all from 0x10000 on."""
    kinds = np.full(0x10001, _UNSURE, np.uint8)
    for c in _sure():
        kinds[c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)
    kinds[WHITE_SPACE] = _BLANK
    return kinds


def code_points(texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The texts one after another: their UTF-8 bytes, their code points, and where each text begins and the
    last one ends, counted in code points."""
    joined = "".join(texts)
    data = joined.encode()
    plain = len(data) == len(joined)
    codes = np.frombuffer(data, np.uint8) if plain else np.frombuffer(joined.encode("utf-32-le"), "<u4")
    return data, codes, np.append(0, np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts))))


def piece_starts(codes: np.ndarray, kinds: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where the pattern of ``patterns`` begins a piece, for texts of code points one after another.

    A piece is a run of one kind, with a space before it if there is one.  Of white space that more text
    follows, the last character stands apart; a contraction ends after its letters.
    """
    n = len(codes)
    edge = np.zeros(n + 3, bool)
    edge[bounds] = True
    start = edge.copy()
    start[1:n] |= kinds[1:] != kinds[:-1]
    blank = kinds == _BLANK
    last = np.flatnonzero(blank[:-1] & ~blank[1:] & ~edge[1:n])
    start[last] = True
    start[last[codes[last] == 0x20] + 1] = False
    quotes = np.flatnonzero((codes == ord("'")) & start[:n])
    quotes = quotes[~edge[quotes + 1]]
    letter = codes[quotes + 1]
    short = quotes[np.isin(letter, [*b"stmd"])]
    two = ~edge[quotes + 2]
    pairs = letter[two].astype(np.int64) << 32 | codes[quotes[two] + 2]
    long = quotes[two][np.isin(pairs, [ord(c[1]) << 32 | ord(c[2]) for c in _LONG_CONTRACTIONS])]
    start[short + 1] = start[long + 1] = False
    start[short + 2] = start[long + 3] = True
    return np.flatnonzero(start[:n])


class _Numbers(dict):
    """Pieces by number; one that is asked for the first time gets the next."""

    def __missing__(self, piece: str) -> int:
        self[piece] = number = len(self)
        return number


class _Row:
    """A growing array."""

    def __init__(self, kind: type):
        self.data, self.used = np.zeros(1024, kind), 0

    def values(self) -> np.ndarray:
        return self.data[: self.used]

    def extend(self, values) -> None:
        end = self.used + len(values)
        if end > len(self.data):
            larger = np.zeros(max(end, len(self.data) * 3 // 2), self.data.dtype)
            larger[: self.used] = self.values()
            self.data = larger
        self.data[self.used : end] = values
        self.used = end


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary."""
    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    plain = {ord(c) for c in letters if ord(c) < 256}
    rest = iter(c for c in letters if ord(c) >= 256)
    return [chr(b) if b in plain else next(rest) for b in range(256)]


class Encoder:
    """Ids of texts as little-endian 32-bit numbers, equal to what the library gives."""

    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        # The same model by itself: it is given pieces in its own letters, one for a byte, with blanks between.
        self.model = Tokenizer(self.library.model)
        self.model.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.letters = np.array([*map(ord, byte_letters())], "<u4")
        self.letters[0] = ord(" ")
        vocab = self.library.get_vocab(with_added_tokens=False)
        self.sizes = np.zeros(max(vocab.values()) + 1, np.int64)  # bytes of each token
        for token, i in vocab.items():
            self.sizes[i] = len(token)
        self._forget()
        self.texts: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        fresh = [t for t in dict.fromkeys(texts) if t not in self.texts]
        ids = dict(zip(fresh, self._encode(fresh), strict=True))
        out = [ids[t] if t in ids else self.texts[t] for t in texts]
        if len(self.texts) + len(ids) > MAX_TEXTS:
            self.texts = {}
        self.texts.update((t, i) for t, i in ids.items() if len(t) <= MAX_TEXT_KEPT)
        return out

    def _encode(self, texts: list[str]) -> list[bytes]:
        hard = {i for i, t in enumerate(texts) if any(token in t for token in self.added)}
        data, codes, bounds = code_points(texts)
        kinds = _kinds().take(codes, mode="clip")
        unsure = np.flatnonzero(kinds == _UNSURE)
        hard.update(np.unique(np.searchsorted(bounds, unsure, side="right") - 1).tolist())
        if hard:
            easy = iter(self._encode([t for i, t in enumerate(texts) if i not in hard]))
            whole = [t for i, t in enumerate(texts) if i in hard]
            rest = iter(self.library.encode_batch_fast(whole, add_special_tokens=False))
            return [_bytes(next(rest)) if i in hard else next(easy) for i in range(len(texts))]
        if len(self.known) > MAX_PIECES or self.ids.used > MAX_IDS:
            self._forget()
        known = self.known
        first = len(known)
        starts = piece_starts(codes, kinds, bounds)
        places = np.append(starts, len(codes))
        if len(data) > len(codes):
            heads = (np.frombuffer(data, np.uint8) & 0xC0) != 0x80
            places = np.append(np.flatnonzero(heads), len(data))[places]
        # Equal pieces of these texts are brought together first; one lookup for each that differs, and a new
        # piece gets the next number.
        pieces = pa.LargeStringArray.from_buffers(
            len(starts), pa.py_buffer(places.astype(np.int64)), pa.py_buffer(data)
        ).dictionary_encode()
        some = pieces.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(known.__getitem__, some), np.int64, len(some))
        fresh = [some[i] for i in np.flatnonzero(numbers >= first).tolist()]
        self._learn(fresh)
        which = numbers[pieces.indices.to_numpy()]
        # The ids of all pieces one after another, then cut where texts end.
        ends = self.ends.values()
        begins = ends[which]
        counts = ends[which + 1] - begins
        totals = np.append(0, np.cumsum(counts))
        at = np.arange(totals[-1]) + np.repeat(begins - totals[:-1], counts)
        found = self.ids.values()[at].tobytes()
        cuts = (4 * totals[np.searchsorted(starts, bounds)]).tolist()
        # The numbers of long pieces are not used again, so that the others keep theirs.
        if any(len(p) > MAX_KEPT for p in fresh):
            self._forget_long(fresh, first)
        return [found[a:b] for a, b in pairwise(cuts)]

    def _forget(self) -> None:
        self.known = _Numbers()
        self.ids, self.ends = _Row(np.uint32), _Row(np.int64)
        self.ends.extend([0])

    def _forget_long(self, fresh: list[str], first: int) -> None:
        """Take out the pieces from number ``first`` on, and put the short ones back."""
        ends = self.ends.values()[first:].copy()
        ids = self.ids.values()[ends[0] :].copy()
        counts = np.diff(ends)
        short = np.fromiter((len(p) <= MAX_KEPT for p in fresh), bool, len(fresh))
        for piece in fresh:
            del self.known[piece]
        for piece in compress(fresh, short):
            self.known[piece]
        self.ids.used, self.ends.used = int(ends[0]), first + 1
        self.ids.extend(ids[np.repeat(short, counts)])
        self.ends.extend(ends[0] + np.cumsum(counts[short]))

    def _learn(self, fresh: list[str]) -> None:
        """Add the ids of new pieces, in the order of their numbers."""
        for at in range(0, len(fresh), 4096):
            ids, counts = self._ids(fresh[at : at + 4096])
            self.ends.extend(self.ids.used + np.cumsum(counts))
            self.ids.extend(ids)

    def _ids(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces one after another, and how many each has.  One call of the library for all: the
        bytes of the tokens tell where one piece's ids end."""
        # No piece holds the byte 0: as a control character it is not sure.
        data = np.frombuffer("\0".join([*pieces, ""]).encode(), np.uint8)
        letters = self.letters[data[:-1]].tobytes().decode("utf-32-le")
        ids = np.array(self.model.encode_batch_fast([letters], add_special_tokens=False)[0].ids, "<u4")
        ends = np.append(np.cumsum(self.sizes[ids]), -1)
        want = np.flatnonzero(data == 0) - np.arange(len(pieces))
        cuts = np.searchsorted(ends[:-1], want)
        if np.array_equal(ends[cuts], want):
            return ids, np.diff(cuts, prepend=-1)
        some = [_bytes(e) for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)]
        counts = np.fromiter(map(len, some), np.int64, len(some)) // 4
        return np.frombuffer(b"".join(some), "<u4"), counts


def _bytes(encoding) -> bytes:
    return np.array(encoding.ids, "<u4").tobytes()


class PrefixCounter:
    """How many tokens each prefix of a text has, by dynamic programming over the bytes of its pieces.

    The encoding of a prefix ends in one token, and without that token it is the encoding of a shorter prefix.
    So ``count[end] = count[end - len(token)] + 1`` for the one token that ends there and that the last token of
    the shorter prefix does not merge into.  The pattern can cut a prefix unlike the whole text: at white
    space that more text follows, within contractions, and within added tokens; those are counted apart.
    """

    def __init__(self, spec: str):
        self.library = Tokenizer.from_str(spec)
        self.cut, self.unsure = patterns()
        model = json.loads(spec)["model"]
        self.byte = {c: b for b, c in enumerate(byte_letters())}
        vocab = {t: i for t, i in model["vocab"].items() if all(c in self.byte for c in t)}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.rank = {(vocab[a], vocab[b]): n for n, (a, b) in enumerate(pairs)}
        self.parts = {vocab[a + b]: (vocab[a], vocab[b], n) for n, (a, b) in enumerate(pairs)}
        self.ends = ahocorasick.Automaton()
        for token, i in vocab.items():
            if len(token) == 1 or i in self.parts:
                text = "".join(chr(self.byte[c]) for c in token)
                self.ends.add_word(text, (i, len(text)))
        self.ends.make_automaton()
        added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.apart: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}

    def _spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """Symbols at one edge of a token while it is merged, each with the rank of the merge that ends it."""
        symbols, until = [], float("inf")
        while True:
            symbols.append((token, until))
            if token not in self.parts:
                return symbols[::-1]
            until = self.parts[token][2]
            token = self.parts[token][side]

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether the encoding of two tokens' joined text is these two tokens."""
        key = left << 32 | right
        if key not in self.apart:
            if len(self.apart) >= MAX_PAIRS:
                self.apart.clear()
            self.apart[key] = self._apart(self._spine(left, 1), self._spine(right, 0))
        return self.apart[key]

    def _apart(self, left: list, right: list) -> bool:
        i = j = 0
        while True:
            (a, a_until), (b, b_until) = left[i], right[j]
            # Equal merges are done from the left: one within the left token comes first.
            rank = self.rank.get((a, b), float("inf"))
            if rank < a_until and rank <= b_until and rank != float("inf"):
                return False
            if a_until == b_until == float("inf"):
                return True
            if a_until <= b_until:
                i += 1
            else:
                j += 1

    def _piece(self, piece: str) -> list[int]:
        """Token counts after each character of a piece."""
        data = piece.encode("utf-8", "surrogatepass")
        counts, last = [0] + [-1] * len(data), [-1] * (len(data) + 1)
        apart, known = self.stay_apart, self.apart
        for end, (token, size) in self.ends.iter(data.decode("latin-1")):
            end += 1
            start = end - size
            if counts[end] < 0 and (not start or known.get(last[start] << 32 | token) or apart(last[start], token)):
                counts[end] = counts[start] + 1
                last[end] = token
        if len(data) == len(piece):
            return counts[1:]
        return [c for c, b in zip(counts[1:], [*data[1:], 0], strict=True) if b & 0xC0 != 0x80]

    def _cut(self, text: str) -> list[str]:
        if not self.unsure.search(text):
            return self.cut.findall(text)
        return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def _keep(self, pieces: set[str]) -> None:
        if len(self.known) + len(pieces) > MAX_PIECES:
            self.known = {}
        for piece in pieces.difference(self.known):
            counts = self._piece(piece)
            if piece in _LONG_CONTRACTIONS:
                counts[:2] = 1, 2
            self.known[piece] = array("I", counts).tobytes()

    def counts(self, texts: list[str]) -> list[np.ndarray]:
        """For each text: how many tokens text[:1], text[:2], ..., text have."""
        hard = {i for i, text in enumerate(texts) if self.added and self.added.search(text)}
        pieces = [[] if i in hard else self._cut(text) for i, text in enumerate(texts)]
        self._keep(set(chain.from_iterable(pieces)))
        every = list(chain.from_iterable(pieces))
        flat = np.frombuffer(b"".join(map(self.known.__getitem__, every)), np.uint32).astype(np.int64)
        sizes = np.fromiter(map(len, every), np.int64, len(every))
        ends = np.cumsum(sizes)
        totals = np.append(np.cumsum(flat[ends - 1]), 0)
        flat += np.repeat(totals[:-1] - flat[ends - 1], sizes)
        out, first = [], 0
        for i, (text, own) in enumerate(zip(texts, pieces, strict=True)):
            start = ends[first - 1] if first else 0
            counts = flat[start : start + len(text)] - (totals[first - 1] if first else 0)
            if i in hard:
                counts = self._with_added(text)
            elif _DOUBLE_SPACE.search(text):
                self._mend_spaces(counts, own)
            out.append(counts)
            first += len(own)
        for piece in [p for p in set(every) if len(p) > MAX_KEPT]:
            del self.known[piece]
        return out

    def _mend_spaces(self, counts: np.ndarray, pieces: list[str]) -> None:
        """A prefix that ends in white space ends in one piece of it, though the text may cut that in two."""
        at = 0
        for piece, following in pairwise(pieces):
            before, at = at, at + len(piece)
            if ord(piece[-1]) in _WHITE and ord(following[0]) in _WHITE:
                longer = self._piece(piece + following[0])[-1]
                counts[at] = longer + (counts[before - 1] if before else 0)

    def _with_added(self, text: str) -> np.ndarray:
        """A text with added tokens: each is one token once whole, and plain text as far as it goes before."""
        out, base = [], 0
        parts = self.added.split(text)
        for plain, token in zip(parts[::2], [*parts[1::2], ""], strict=True):
            (counts,) = self.counts([plain + token[:-1]])
            out.append(counts + base)
            base += int(counts[len(plain) - 1]) if plain else 0
            if token:
                base += 1
                out.append(np.array([base]))
        return np.concatenate(out)


@lru_cache(maxsize=1)
def encoder(spec: str) -> Encoder:
    """The process's encoder for a tokenizer file's text, with the pieces it has seen."""
    return Encoder(spec)


CACHES.append(encoder.cache_clear)


@lru_cache(maxsize=1)
def prefix_counter(spec: str) -> PrefixCounter:
    return PrefixCounter(spec)
