"""SentencePiece ids of merge-type vocabularies, by a score-ordered agenda of adjacent symbols.

A text starts as its characters. All adjacent pairs that form a piece wait in an agenda; the one
of highest score, of equals the leftmost, is merged, and the pairs with its new neighbours are
added. Entries whose symbols have changed since are passed over. What is left in the end are the
pieces; a character outside the vocabulary becomes its bytes.

A text is cut before each run of spaces where no piece of the vocabulary reaches across, so that
the cut parts merge independently; a part is worked out once in a worker and then looked up. A new
part is cut again between characters that stand side by side in no piece.
Every part that is worked out in an Arrow batch is compared with what the library makes of it.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from itertools import repeat
from operator import add

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

SPACE = "▁"
#: Characters of parts in each of the two halves of what a worker remembers, and of one such part;
#: of texts looked at in one piece.
REMEMBERED, LONG_PART, PIECE = 6 << 20, 256, 1 << 20
#: Symbols up to which the agenda is a list that is searched, beyond a heap.
SHORT = 48


class Codec(dict):
    """Packed ids by part; a part that is not there is worked out when it is looked up."""

    def __init__(self, model: bytes) -> None:
        super().__init__()
        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        every = range(sp.vocab_size())
        merged = [i for i in every if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        pieces = {sp.id_to_piece(i): i for i in merged}
        rank = {s: n for n, s in enumerate(sorted({sp.get_score(i) for i in merged}, reverse=True))}
        self.rank = {piece: rank[sp.get_score(i)] for piece, i in pieces.items()}
        self.packed = {piece: self._pack([i]) for piece, i in pieces.items()}
        self.bytes_ = {int(sp.id_to_piece(i)[3:5], 16): self._pack([i]) for i in every if sp.is_byte(i)}
        self.unknown = self._pack([sp.unk_id()])
        self.unused = {sp.id_to_piece(i) for i in merged if sp.is_unused(i)}
        # characters that stand side by side in some piece: nothing merges across any others
        self.inside = {p[i:i + 2] for p in pieces for i in range(len(p) - 1)}
        # characters that some piece has before a space
        self.glued = "".join({p[i - 1] for p in pieces for i in range(1, len(p)) if p[i] == SPACE and p[i - 1] != SPACE})
        self.cut = re.compile(f"(?<=[^{SPACE}{re.escape(self.glued)}])(?={SPACE})" if self.glued else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
        self.held, self.new, self.wrong, self.old = 0, [], set(), {}

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return np.array(ids, np.int32).tobytes()

    def __missing__(self, part: str) -> bytes:
        out = self.old.pop(part, None)
        if out is None:
            out = self._worked_out(part)
            self.new.append(part)
        self._remember(part, out)
        return out

    def _remember(self, part: str, out: bytes) -> None:
        if len(part) <= LONG_PART:
            self[part] = out
            self.held += len(part)

    def _worked_out(self, part: str) -> bytes:
        """A new part from what its stretches merge to, between which no piece reaches."""
        inside = list(map(self.inside.__contains__, map(add, part, part[1:])))
        if all(inside):
            return self.merge(part)
        out, at = [], 0
        for end in [i for i, joined in enumerate(inside, 1) if not joined] + [len(part)]:
            stretch = part[at:end]
            ids = self.get(stretch)
            if ids is None:
                ids = self.merge(stretch)
                self._remember(stretch, ids)
            out.append(ids)
            at = end
        return b"".join(out)

    def parts(self, normal: str) -> list[str]:
        return self.cut.split(normal) if self.glued else self.cut.findall(normal)

    def _short_agenda(self, symbols: list[str]) -> list[str]:
        """Merges while the agenda is a short list of the ranks of all pairs in place."""
        rank, none = self.rank.get, len(self.rank)
        agenda = list(map(rank, map(add, symbols, symbols[1:]), repeat(none)))
        while agenda and (best := min(agenda)) < none:
            i = agenda.index(best)
            del agenda[i]
            merged = symbols[i] + symbols.pop(i + 1)
            symbols[i] = merged
            if i:
                agenda[i - 1] = rank(symbols[i - 1] + merged, none)
            if i < len(agenda):
                agenda[i] = rank(merged + symbols[i + 1], none)
        return symbols

    def _long_agenda(self, symbols: list[str], born: dict[str, tuple[str, str]]) -> list[str]:
        """Merges with a heap of (rank, place, size); entries of changed symbols are passed over."""
        rank, n = self.rank, len(symbols)
        after, before = list(range(1, n)) + [-1], list(range(-1, n - 1))
        agenda = [(rank[pair], i, len(pair)) for i in range(n - 1) if (pair := symbols[i] + symbols[i + 1]) in rank]
        heapq.heapify(agenda)
        while agenda:
            _, i, size = heapq.heappop(agenda)
            j = after[i]
            if j < 0 or not symbols[i] or len(symbols[i]) + len(symbols[j]) != size:
                continue
            if self.unused:
                born[symbols[i] + symbols[j]] = symbols[i], symbols[j]
            symbols[i] += symbols[j]
            symbols[j] = ""
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right >= 0 and (pair := symbols[left] + symbols[right]) in rank:
                    heapq.heappush(agenda, (rank[pair], left, len(pair)))
        return [s for s in symbols if s]

    def _undone(self, piece: str, born: dict[str, tuple[str, str]]) -> list[str]:
        """A piece marked unused is undone into what it was merged from."""
        out, left = [], [piece]
        while left:
            p = left.pop()
            if p in self.unused and p in born:
                left += reversed(born[p])
            else:
                out.append(p)
        return out

    def merge(self, part: str) -> bytes:
        """Packed ids of one part."""
        born: dict[str, tuple[str, str]] = {}
        if len(part) > SHORT or self.unused:
            symbols = self._long_agenda(list(part), born)
            if self.unused:
                symbols = [p for s in symbols for p in self._undone(s, born)]
        else:
            symbols = self._short_agenda(list(part))
        packed = self.packed
        try:
            return b"".join([packed[s] for s in symbols])
        except KeyError:
            outside = (lambda s: b"".join(self.bytes_[b] for b in s.encode())) if self.bytes_ else (lambda s: self.unknown)
            return b"".join([packed.get(s) or outside(s) for s in symbols])

    def _compare(self) -> None:
        """New parts, as the library encodes them; it puts the space before a text itself."""
        new = [p for p in self.new if p[0] == SPACE and len(p) > 1]
        self.new = []
        theirs = self.library.encode([p[1:].replace(SPACE, " ") for p in new], num_threads=1)
        held = self.get
        self.wrong.update(p for p, other in zip(new, theirs) if array("i", other).tobytes() != (held(p) or self._worked_out(p)))

    def encode(self, texts: list[str]) -> tuple[list[bytes], list[bool]]:
        """Packed ids of each text, and whether the library agrees."""
        if self.held > REMEMBERED:  # parts that come again are taken over from the older half
            self.old = dict(self)
            self.clear()
            self.held = 0
        cut = [self.parts(t) if t else [] for t in self.library.normalize(texts)]
        ids = [b"".join(map(self.__getitem__, parts)) for parts in cut]
        self._compare()
        return ids, [not self.wrong or self.wrong.isdisjoint(parts) for parts in cut]


_codecs: dict[bytes, Codec] = {}


def codec(model: bytes) -> Codec:
    """One for each worker, over all its tasks."""
    if model not in _codecs:
        _codecs.clear()
        _codecs[model] = Codec(model)
    return _codecs[model]


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of some PIECE characters."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def _coded(model: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(model)
        for batch in batches:
            at = 0
            for texts in _pieces([t or "" for t in batch.column(1).to_pylist()]):
                packed, agrees = own.encode(texts)
                flat = np.frombuffer(b"".join(packed), np.int32)
                offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
                decoded = own.library.decode([np.frombuffer(p, np.int32).tolist() for p in packed], num_threads=1)
                yield pa.record_batch([
                    batch.column(0).slice(at, len(texts)), pa.ListArray.from_arrays(offsets, flat),
                    pa.array(decoded, pa.string()), pa.array(agrees, pa.bool_())], names=["doc_id", "ids", "decoded", "agrees"])
                at += len(texts)
    return run


def encode_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, ids, decoded, agrees for every row of `docs` (doc_id, text).

    `model` is the path of a SentencePiece model of merge type; the driver reads it and tasks get
    its bytes. No begin or end ids, no sampling. `decoded` is what the library makes of the ids,
    `agrees` whether the library gives the same ids to every part of the text; a vocabulary with
    rules other than merges (user-defined pieces, unigram scores) shows there. Null and empty texts
    have no ids and an empty `decoded`. Rows are worked on one by one: null and repeated doc_ids
    stay as they are. Other columns are not looked at.
    """
    with open(model, "rb") as file:
        held = file.read()
    return docs.select("doc_id", "text").mapInArrow(_coded(held), "doc_id long, ids array<int>, decoded string, agrees boolean")
