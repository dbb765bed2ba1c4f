"""A SentencePiece model file, read for the operators that encode and count.

Two kinds are known. In a *unigram* model a text's pieces are the lattice path with the largest
sum of scores. In a *BPE* model they are what greedy merging leaves; that, too, is a lattice
path, the only one on which every two neighbours are *compatible*: merging their joined text
gives those two pieces again. (Greedy merging always takes the best pair of the whole text, so
what it does within two neighbours is what it would do on them alone.) ``compatible``
decides it by replaying the merges of both pieces towards their common boundary.

Scores are summed as the library sums them, in single precision from the text's start; of equal
ones the first, whose last piece begins first, stays.
"""

from __future__ import annotations

import re
import struct
from array import array
from functools import lru_cache

NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6  # fixed values: piece types of the file format
UNIGRAM, BPE = 1, 2
SPACE = "▁"
UNK_PENALTY = 10.0
#: Remembered pairs and words of one worker; beyond, the memory starts anew.
MOST_PAIRS, MOST_WORDS = 400_000, 300_000


def _varint(b: bytes, i: int) -> tuple[int, int]:
    x = shift = 0
    while True:
        x |= (b[i] & 127) << shift
        shift += 7
        i += 1
        if b[i - 1] < 128:
            return x, i


def fields(b: bytes):
    """(field number, value) of a protocol-buffer message."""
    i = 0
    while i < len(b):
        tag, i = _varint(b, i)
        kind = tag & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 1:
            v, i = b[i : i + 8], i + 8
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i : i + n], i + n
        elif kind == 5:
            v, i = b[i : i + 4], i + 4
        else:
            raise ValueError("not a SentencePiece model")
        yield tag >> 3, v


def single(x: float) -> float:
    """The nearest single-precision number."""
    return _FLOAT.unpack(_FLOAT.pack(x))[0]


_FLOAT = struct.Struct("<f")


class Normaliser:
    """The normaliser as a transducer over UTF-8: at each place the longest rule of the model's table, or
    a user symbol, rewrites what it matches; any other character is copied. The table is a double
    array trie (32-bit units: a label, an offset to the children, a flag for a leaf) and its strings."""

    def __init__(self, table: bytes, symbols: list[str], dummy_prefix: bool, squeeze: bool, escape: bool):
        self.units, self.strings = array("I"), b""
        if table:
            (n,) = struct.unpack_from("<I", table)
            self.units.frombytes(table[4 : 4 + n])
            self.strings = table[4 + n :]
        self.symbols = re.compile("|".join(re.escape(x) for x in sorted(symbols, key=len, reverse=True)).encode()) if symbols else None
        self.dummy_prefix, self.squeeze, self.escape = dummy_prefix, squeeze, escape

    def _rule(self, raw: bytes, at: int) -> tuple[bytes, int] | None:
        """(output, bytes read) of the longest rule that matches here."""
        units, found, i = self.units, None, at
        if not units:
            return None
        offset = lambda u: (u >> 10) << ((u & 512) >> 6)
        node = offset(units[0])
        while i < len(raw):
            node ^= raw[i]
            unit = units[node]
            if unit & 0x800000FF != raw[i]:
                break
            node ^= offset(unit)
            i += 1
            if unit & 256:
                found = (units[node] & 0x7FFFFFFF, i - at)
        if found is None:
            return None
        start = found[0]
        return self.strings[start : self.strings.index(0, start)], found[1]

    def arcs(self, raw: bytes):
        """(start, end, output) of the one path through a text."""
        at = 0
        while at < len(raw):
            symbol = self.symbols.match(raw, at) if self.symbols else None
            if symbol:
                out, n = symbol[0], len(symbol[0])
            elif (rule := self._rule(raw, at)) is not None:
                out, n = rule
            else:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                out = raw[at : at + n]
            yield at, at + n, out
            at += n

    def __call__(self, text: str) -> str:
        if not self.units and not self.symbols and not self.squeeze:
            return self._escaped((" " if self.dummy_prefix else "") + text) if text else ""
        out, spaced, any_ = [], self.squeeze, False
        for _, _, piece in self.arcs(text.encode("utf-8", "replace")):
            if spaced:  # a space follows a space, or begins the text
                piece = piece.lstrip(b" ")
            if piece:
                out.append(piece)
                spaced, any_ = self.squeeze and piece.endswith(b" "), True
        if not any_ and self.squeeze:
            return ""
        done = self._escaped((" " if self.dummy_prefix else "") + b"".join(out).decode("utf-8", "replace")) if text else ""
        return done.rstrip(SPACE if self.escape else " ") if self.squeeze else done

    def _escaped(self, text: str) -> str:
        return text.replace(" ", SPACE) if self.escape else text


class Model:
    def __init__(self, data: bytes):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        self.kind, self.byte_fallback = UNIGRAM, False
        self.dummy_prefix, self.squeeze, self.escape = True, True, True
        charsmap, suffix = b"", False
        for n, v in fields(data):
            if n == 1:
                piece, score, kind = "", 0.0, NORMAL
                for k, x in fields(v):
                    if k == 1:
                        piece = x.decode("utf-8")
                    elif k == 2:
                        (score,) = struct.unpack("<f", x)
                    elif k == 3:
                        kind = x
                self.pieces.append(piece), self.scores.append(score), self.types.append(kind)
            elif n == 2:
                for k, x in fields(v):
                    if k == 3:
                        self.kind = x
                    elif k == 24:
                        suffix = bool(x)
                    elif k == 35:
                        self.byte_fallback = bool(x)
            elif n == 3:
                for k, x in fields(v):
                    if k == 2:
                        charsmap = x
                    elif k == 3:
                        self.dummy_prefix = bool(x)
                    elif k == 4:
                        self.squeeze = bool(x)
                    elif k == 5:
                        self.escape = bool(x)
        if self.kind not in (UNIGRAM, BPE) or suffix or (self.kind == BPE and UNUSED in self.types):
            raise ValueError("only unigram models, and BPE models without unused pieces, with spaces before words are read")
        self.symbols = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == USER}
        self.normalise = Normaliser(charsmap, list(self.symbols), self.dummy_prefix, self.squeeze, self.escape)
        #: Whether normalising is nothing but the handling of spaces.
        self.plain = not charsmap and not self.symbols and self.escape
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.unk = self.types.index(UNKNOWN)
        self.byte_ids = [-1] * 256
        for i, t in enumerate(self.types):
            if t == BYTE:
                self.byte_ids[int(self.pieces[i][1:-1], 16)] = i
        known = [self.scores[i] for i in self.ids.values()]
        self.unk_score = single(min(known, default=0.0) - UNK_PENALTY)
        #: A user symbol weighs nothing, so that it is taken wherever it stands.
        self.arc_scores = dict.fromkeys(self.symbols.values(), 0.0)
        self._split = re.compile("|".join(re.escape(x) for x in sorted(self.symbols, key=len, reverse=True))) if self.symbols else None
        self.longest = max(map(len, self.ids), default=1)
        #: Whether words can be cut apart before each run of spaces: no piece has a space after another letter.
        self.by_word = not any(a != SPACE and b == SPACE for p in self.ids for a, b in zip(p, p[1:], strict=False))
        self._replays: dict[int, tuple | None] = {}

    def score(self, piece: int) -> float:
        return self.arc_scores.get(piece, self.scores[piece])

    def runs(self, text: str) -> list[tuple[str, int | None]]:
        """A normalised text of a BPE model cut at user symbols, which nothing merges with: (text, None) and (symbol, id)."""
        if self._split is None:
            return [(text, None)]
        out, at = [], 0
        for m in self._split.finditer(text):
            out += [(text[at : m.start()], None), (m[0], self.symbols[m[0]])]
            at = m.end()
        return [x for x in [*out, (text[at:], None)] if x[0]]

    def unknown_ids(self, char: str) -> list[int]:
        """A character outside the vocabulary: its UTF-8 bytes, or the unknown piece."""
        return [self.byte_ids[b] for b in char.encode("utf-8", "replace")] if self.byte_fallback else [self.unk]

    # ---- BPE: greedy merging of a single piece, and of two neighbours

    def _replay(self, piece: int) -> tuple | None:
        """(scores, left symbols, right symbols) as greedy merging makes the piece: before merge k
        the piece starts with left[k] and ends with right[k]. None: merging doesn't make it."""
        if piece in self._replays:
            return self._replays[piece]
        sym = list(self.pieces[piece])
        marks, left, right = [], [sym[0]], [sym[-1]]
        while len(sym) > 1:
            best, at = None, -1
            for j in range(len(sym) - 1):
                i = self.ids.get(sym[j] + sym[j + 1])
                if i is not None and (best is None or self.scores[i] > best):
                    best, at = self.scores[i], j
            if best is None:
                break
            sym[at : at + 2] = [sym[at] + sym[at + 1]]
            marks.append(best), left.append(sym[0]), right.append(sym[-1])
        found = None if len(sym) > 1 or any(c not in self.ids for c in self.pieces[piece]) else (tuple(marks), tuple(left), tuple(right))
        self._replays[piece] = found
        return found

    def reachable(self, piece: int) -> bool:
        return self.kind == UNIGRAM or self._replay(piece) is not None

    def compatible(self, a: int, b: int) -> bool:
        """Whether piece b can stand after piece a in a BPE result."""
        ra, rb = self._replay(a), self._replay(b)
        if ra is None or rb is None:
            return False
        (ma, _, right), (mb, left, _), i, j = ra, rb, 0, 0
        ids, scores, none = self.ids, self.scores, float("-inf")
        while True:
            x, y = (ma[i] if i < len(ma) else none), (mb[j] if j < len(mb) else none)
            across = ids.get(right[i] + left[j])
            if across is not None:
                s = scores[across]
                if s > x and s >= y:  # of equal scores the leftmost merges first
                    return False
            if x == none and y == none:
                return True
            if x >= y:
                i += 1
            else:
                j += 1


@lru_cache(maxsize=4)
def load(path: str) -> Model:
    with open(path, "rb") as f:
        return Model(f.read())


def words(model: Model, text: str) -> list[str] | None:
    """The normalised text cut before each run of spaces, where pieces cannot cross such cuts:
    words whose leading space is implied. None if the text has to be taken whole."""
    if not model.by_word or not model.dummy_prefix or not model.plain or model.kind != BPE:
        return None
    if SPACE in text:  # an escaped space written out is a space to the pieces, but not to squeezing
        if model.squeeze:
            return None
        text = text.replace(SPACE, " ")
    if model.squeeze:
        return [x for x in text.split(" ") if x]
    return text.split(" ") if text else []
