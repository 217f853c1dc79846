"""SentencePiece BPE encoding through a prefix table of last tokens, and decoding of the ids.

A model of the ``sentencepiece`` library merges, again and again, the adjacent pair of symbols whose joined
string is a piece of highest score (leftmost first among equals).  The encoding of every prefix of a text
ends with exactly one token, and that token is the one piece ``t`` ending there whose predecessor (the last
token of the prefix before ``t``) is compatible with it: merging the two pieces' joined string gives back
exactly those two pieces.  So one pass over the matches of an Aho-Corasick automaton fills a table with the
last token of every prefix, and the ids come out backwards from the end.  Compatibility of a pair is decided
once per pair by the merge rule itself and kept.

Pieces never hold a space symbol after another character in this kind of model (checked when a model is
read; otherwise a text is one chunk), so a text is cut before such a symbol and each distinct chunk is
encoded once per worker.

Characters that no piece holds are kept apart and written as their UTF-8 bytes (byte fallback).

Defined cases: a null or empty text has no ids and decodes to ""; a very long text is encoded as a whole,
with memory linear in its chunk length; repeated rows give equal ids; an empty table gives an empty result;
a column of ``docs`` with a result's name is replaced by the result.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import sentencepiece_model_pb2

from sitequarry.llm.batches import map_batches, slices

SPACE = "▁"
#: Kinds of pieces in a model file (fixed values of its format): normal pieces are merged, bytes fall back.
NORMAL, UNKNOWN, BYTE = 1, 2, 6
#: Score of two symbols that are not merged.
NEVER = float("-inf")
#: Pairs whose compatibility a worker keeps; the table starts anew beyond that.
PAIRS_KEPT = 1 << 21
#: Distinct chunks whose ids a worker keeps; the table starts anew beyond that.
CHUNKS_KEPT = 1 << 20


class PieceModel:
    """The merge rule, the automaton over reachable pieces and the table of pair compatibility."""

    def __init__(self, model: bytes):
        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        if spec.name not in ("identity", "") or spec.remove_extra_whitespaces:
            raise ValueError(f"normalizer {spec.name!r} is not supported")
        self.dummy_prefix = spec.add_dummy_prefix
        self.escape = spec.escape_whitespaces
        self.pieces = [p.piece for p in proto.pieces]
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = np.zeros(256, np.int64)
        self.unknown = 0
        for i, p in enumerate(proto.pieces):
            if p.type == NORMAL:
                self.score[p.piece], self.ids[p.piece] = p.score, i
            elif p.type == BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            elif p.type == UNKNOWN:
                self.unknown = i
        self.byte_fallback = bool(proto.trainer_spec.byte_fallback)
        self.is_byte = np.zeros(len(self.pieces), bool)
        self.is_byte[self.byte_ids] = self.byte_fallback
        self._special = frozenset(np.flatnonzero(self.is_byte).tolist()) | {self.unknown}
        self.automaton = ahocorasick.Automaton()
        self.whole: dict[str, int] = {}
        self._pairs: dict[int, bool] = {}
        self._chunks: dict[str, tuple[int, ...]] = {}
        for piece, i in self.ids.items():
            if self.merge(piece) == [piece]:
                self.automaton.add_word(piece, (i, len(piece)))
                self.whole[piece] = i
        self.automaton.make_automaton()
        self.chunked = not any(
            a != SPACE and b == SPACE for piece in self.ids for a, b in zip(piece, piece[1:])
        )
        self._cut = re.compile(f"(?<=[^{SPACE}])(?={SPACE})")

    def merge(self, text: str) -> list[str]:
        """The merge rule on a short string, symbol by symbol: the plain definition the table relies on."""
        symbols, get = list(text), self.score.get
        scores = [get(a + b, NEVER) for a, b in zip(symbols, symbols[1:])]
        while scores:
            best = max(scores)
            if best == NEVER:
                break
            at = scores.index(best)  # the leftmost
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            del scores[at]
            if at:
                scores[at - 1] = get(symbols[at - 1] + symbols[at], NEVER)
            if at < len(scores):
                scores[at] = get(symbols[at] + symbols[at + 1], NEVER)
        return symbols

    def compatible(self, left: int, right: int) -> bool:
        """Whether the pieces ``left`` and ``right`` stay apart when their joined string is merged."""
        key = left * len(self.pieces) + right
        known = self._pairs.get(key)
        if known is None:
            if len(self._pairs) >= PAIRS_KEPT:
                self._pairs.clear()
            a, b = self.pieces[left], self.pieces[right]
            known = self._pairs[key] = self.merge(a + b) == [a, b]
        return known

    def normalize(self, text: str) -> str:
        if not text:
            return ""
        if self.escape:
            text = text.replace(" ", SPACE)
        return SPACE + text if self.dummy_prefix else text

    def chunks(self, normalized: str) -> list[str]:
        return self._cut.split(normalized) if self.chunked else [normalized]

    def encode_chunk(self, chunk: str) -> tuple[int, ...]:
        """Ids of one chunk: the last token of every prefix, then the tokens from the end backwards."""
        whole = self.whole.get(chunk)
        if whole is not None:  # a reachable piece is its own encoding
            return (whole,)
        n = len(chunk)
        last = [-2] * (n + 1)  # piece id ending at each prefix; -2: a character that no piece holds
        length = [1] * (n + 1)
        fits, width = self._pairs.get, len(self.pieces)
        settled = seen = 0  # as prefix lengths
        for stop, (piece, size) in self.automaton.iter(chunk):
            stop += 1
            if stop == settled:
                continue
            if stop != seen:
                if seen != settled:
                    raise AssertionError(f"no last token at {seen}")  # excluded by the merge rule
                seen = stop
            if stop != size:
                previous = last[stop - size]
                if previous >= 0:
                    known = fits(previous * width + piece)
                    if not known and (known is not None or not self.compatible(previous, piece)):
                        continue
            last[stop], length[stop], settled = piece, size, stop
        if seen != settled:
            raise AssertionError(f"no last token at {seen}")
        ids: list[int] = []
        at = n
        while at > 0:
            piece = last[at]
            if piece == -2:
                ids.extend(reversed(self._fallback(chunk[at - 1])))
            else:
                ids.append(piece)
            at -= length[at]
        ids.reverse()
        return tuple(ids)

    def _fallback(self, char: str) -> list[int]:
        if self.byte_fallback:
            return [int(self.byte_ids[b]) for b in char.encode("utf-8")]
        return [self.unknown]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a text, chunk by chunk; a worker keeps the ids of up to CHUNKS_KEPT distinct chunks."""
        ids: list[int] = []
        self._extend(ids, text)
        return ids

    def _extend(self, ids: list[int], text: str | None) -> None:
        known = self._chunks
        for chunk in self.chunks(self.normalize(text or "")):
            found = known.get(chunk)
            if found is None:
                if len(known) >= CHUNKS_KEPT:
                    known.clear()
                found = known[chunk] = self.encode_chunk(chunk)
            ids += found

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many texts as one flat array and the offsets of each text's ids."""
        values: list[int] = []
        offsets = [0]
        for text in texts:
            self._extend(values, text)
            offsets.append(len(values))
        return np.array(values, np.int32), np.asarray(offsets, np.int32)

    def decode(self, ids: list[int] | np.ndarray | None) -> str:
        """Pieces joined; runs of byte pieces as UTF-8 (invalid bytes: U+FFFD); the dummy space dropped."""
        ids = [] if ids is None else [int(i) for i in ids] if isinstance(ids, np.ndarray) else ids
        if self._special.isdisjoint(ids):
            text = "".join(map(self.pieces.__getitem__, ids))
        else:
            parts, raw = [], bytearray()
            for i in ids:
                if self.is_byte[i]:
                    raw.append(int(self.pieces[i][3:5], 16))
                    continue
                if raw:
                    parts.append(raw.decode("utf-8", "replace"))
                    raw = bytearray()
                parts.append(" ⁇ " if i == self.unknown else self.pieces[i])
            if raw:
                parts.append(raw.decode("utf-8", "replace"))
            text = "".join(parts)
        text = text.replace(SPACE, " ")
        return text[1:] if self.dummy_prefix and text.startswith(" ") else text


_models: dict[str, PieceModel] = {}


def piece_model(model: bytes) -> PieceModel:
    """One model per worker process and file content."""
    key = hashlib.sha256(model).hexdigest()
    if key not in _models:
        _models[key] = PieceModel(model)
    return _models[key]


def read_model(path: str) -> bytes:
    """A model file, read on the driver; it travels as a broadcast of its size (under a MB here)."""
    with open(path, "rb") as file:
        return file.read()


def encode_pieces(
    docs: DataFrame, model_path: str, ids: str = "piece_ids", decoded: str | None = None
) -> DataFrame:
    """``docs`` with ``ids``, the array of piece ids of ``text`` as the library encodes it, and, if named,
    ``decoded``: the text decoded from those ids in the same pass."""
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_path))
    results = {ids: "array<int>"} | ({decoded: "string"} if decoded else {})
    names = [n for n in docs.columns if n not in results]

    def encode(batch: pa.RecordBatch):
        coder = piece_model(model.value)
        for part in slices(batch):
            flat, offsets = coder.encode_many(part.column("text").to_pylist())
            found = {ids: pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))}
            if decoded:
                found[decoded] = [
                    coder.decode(flat[a:b].tolist()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)
                ]
            yield {n: part.column(n) for n in names} | found

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields if f.name not in results}
    kinds |= results
    return map_batches(docs, encode, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def decode_pieces(df: DataFrame, model_path: str, ids: str = "piece_ids", text: str = "decoded") -> DataFrame:
    """``df`` with ``text``, the library's decoding of the id array ``ids``."""
    model = df.sparkSession.sparkContext.broadcast(read_model(model_path))
    names = [n for n in df.columns if n != text]

    def decode(batch: pa.RecordBatch):
        coder = piece_model(model.value)
        for part in id_slices(batch, ids):
            decoded = [coder.decode(i) for i in part.column(ids).to_pylist()]
            yield {n: part.column(n) for n in names} | {text: decoded}

    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields if f.name != text}
    kinds[text] = "string"
    return map_batches(df, decode, ", ".join(f"`{n}` {k}" for n, k in kinds.items()))


def id_slices(batch: pa.RecordBatch, ids: str, most: int = 1 << 18):
    """The batch in pieces of about ``most`` ids; a longer row is a piece of its own."""
    column = batch.column(ids)
    lengths = np.asarray(column.value_lengths().fill_null(0), np.int64) if len(column) else np.zeros(0)
    ends = np.cumsum(lengths)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + most, side="right"))
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop
