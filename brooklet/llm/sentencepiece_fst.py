"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers are compiled from a model file: the normaliser N (the model's rewriting table and
user symbols, spaces squeezed where the model says so, a space put before the text, spaces
escaped; spm_model.Normaliser), the pieces P (a trie with an arc back to the start, weighted, at
the end of each piece) and the byte fallback B (one state, with an arc from each character outside
the vocabulary to its UTF-8 byte pieces). A text is composed with them lazily: N has one path, whose output
is composed with the union of P and B as far as the search goes, and the shortest path of that
lattice in the tropical semiring (min, +) is the encoding. For a unigram model an
arc weighs minus its piece's score, summed as the library sums them. For a BPE model weights stand
between neighbours (a fourth transducer, whose states are the pieces): 0 if
greedy merging leaves the two side by side, infinity otherwise; exactly one path is then
finite, and it is the tokenizer's own result, found depth-first. Ties cannot occur in BPE; in a
unigram model the path whose last piece begins first wins.

Since no piece of a BPE model crosses a space after a letter, words are composed one by one and
remembered, up to a fixed number; unigram models, and models that rewrite, take a text whole.
Null text gives null; empty text no piece; any length is read whole; rows may repeat, and other columns than
doc_id and text are not read.
Decoding is the inverted transducer, with bytes joined to characters (invalid ones to U+FFFD).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .spm_model import BPE, BYTE, CONTROL, MOST_PAIRS, MOST_WORDS, SPACE, UNKNOWN, Model, load, single, words

#: Longer words are not remembered.
LONG = 64
DEFAULT = "piece_bpe_32k.model"


class Transducer:
    def __init__(self, model: Model):
        self.model = model
        self.root: dict = {}  # the piece trie; "" holds a state's final piece
        for piece, i in (model.ids if model.kind == BPE else {**model.ids, **model.symbols}).items():
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[""] = i
        self._bytes: dict[str, list[int]] = {}  # the byte fallback's arcs, made when first taken
        self._known: dict[str, bytes] = {}
        self._after: dict[int, dict[int, bool]] = {}  # the weights between neighbours: finite or not
        self._weighed = 0

    def lattice(self, text: str) -> Iterator[tuple[int, int, int]]:
        """Arcs (start, end, piece) of a normalised text composed with P; piece -1 is a character
        for the byte fallback. By start, then by end."""
        for i in range(len(text)):
            node = self.root.get(text[i])
            if node is None or "" not in node:
                yield i, i + 1, -1
            j = i + 1
            while node is not None:
                if "" in node:
                    yield i, j, node[""]
                node = node.get(text[j]) if j < len(text) else None
                j += 1

    def shortest(self, text: str) -> list[int]:
        """Piece ids on the shortest path through a normalised text."""
        if self.model.kind != BPE:
            path = self._cheapest(text)
        else:
            path = [x for run, symbol in self.model.runs(text) for x in (self._finite(run) if symbol is None else [(run, symbol)])]
        out: list[int] = []
        was_unknown = False
        for char, p in path:
            if p >= 0:
                out.append(p)
            elif self.model.byte_fallback or not was_unknown:  # without bytes, unknown characters in a row are one piece
                if char not in self._bytes:
                    self._bytes[char] = self.model.unknown_ids(char)
                out += self._bytes[char]
            was_unknown = p < 0
        return out

    def _cheapest(self, text: str) -> list[tuple[str, int]]:
        """(first character, piece) along the path of the largest score."""
        m, n = self.model, len(text)
        best, back = [0.0] * (n + 1), [None] * (n + 1)
        for i, j, p in self.lattice(text):
            s = single((m.score(p) if p >= 0 else m.unk_score) + best[i])
            if back[j] is None or s > best[j]:
                best[j], back[j] = s, (i, p)
        path, end = [], n
        while end:
            i, p = back[end]
            path.append((text[i], p))
            end = i
        return path[::-1]

    def _arcs(self, text: str, i: int) -> list[tuple[int, int]]:
        """(end, piece) of the lattice's arcs from a position, the longest last."""
        out: list[tuple[int, int]] = []
        node, j, n = self.root.get(text[i]), i + 1, len(text)
        if node is None or "" not in node:
            out.append((j, -1))
        while node is not None:
            p = node.get("")
            if p is not None:
                out.append((j, p))
            if j == n:
                break
            node = node.get(text[j])
            j += 1
        return out

    def _finite(self, text: str) -> list[tuple[str, int]]:
        """The only path of finite weight. Up to any position at most one path is finite, so the
        search goes deep, longest piece first, and never enters a position twice."""
        n = len(text)
        if not n:
            return []
        m, after, dead = self.model, self._after, set()
        path: list[tuple[int, int]] = []  # (start, piece)
        todo: list[list[tuple[int, int]]] = []
        i, last, arcs = 0, -1, self._arcs(text, 0)
        while True:
            weigh = after.get(last)
            if weigh is None:
                weigh = after[last] = {-1: True}
            while arcs:
                j, p = arcs.pop()
                if j in dead:
                    continue
                fine = weigh.get(p)
                if fine is None:
                    fine = weigh[p] = m.compatible(last, p) if last >= 0 else m.reachable(p)
                    self._weighed += 1
                if fine:
                    path.append((i, p))
                    if j == n:
                        return [(text[a], x) for a, x in path]
                    todo.append(arcs)
                    i, last, arcs = j, p, self._arcs(text, j)
                    break
            else:
                dead.add(i)
                arcs = todo.pop()
                i, _ = path.pop()
                last = path[-1][1] if path else -1
                continue

    def _word(self, word: str) -> bytes:
        return np.asarray(self.shortest(SPACE + word), dtype=np.int32).tobytes()

    def encode(self, text: str) -> np.ndarray:
        cut = words(self.model, text)
        if cut is None:
            return np.asarray(self.shortest(self.model.normalise(text)), dtype=np.int32)
        known = self._known
        if len(known) > MOST_WORDS:
            known.clear()
        if self._weighed > MOST_PAIRS:
            self._after.clear()
            self._weighed = 0
        new = {*cut}.difference(known)
        long = [w for w in new if len(w) > LONG]
        for w in new:
            if w:
                known[w] = self._word(w)
        if "" not in new:
            flat = b"".join(map(known.__getitem__, cut))
        else:
            parts, spaces = [], ""
            for w in cut:
                if not w:
                    spaces += SPACE  # a run of spaces belongs to the word after it
                else:
                    parts.append(np.asarray(self.shortest(spaces + SPACE + w), dtype=np.int32).tobytes() if spaces else known[w])
                    spaces = ""
            if spaces:
                parts.append(np.asarray(self.shortest(spaces), dtype=np.int32).tobytes())
            flat = b"".join(parts)
        for w in long:
            known.pop(w, None)
        return np.frombuffer(flat, dtype=np.int32)

    def forget(self) -> None:
        self._known.clear()
        self._after.clear()
        self._weighed = 0

    def decode(self, ids) -> str:
        """The text of piece ids: the inverted transducers, with the space before it removed."""
        text = b"".join(map(self._surface().__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text

    def _surface(self) -> list[bytes]:
        if not hasattr(self, "_texts"):
            m = self.model
            self._texts = [bytes([int(p[1:-1], 16)]) if t == BYTE else b"" if t == CONTROL else " ⁇ ".encode() if t == UNKNOWN else p.replace(SPACE, " ").encode() for p, t in zip(m.pieces, m.types, strict=True)]
        return self._texts


_compiled: dict[str, Transducer] = {}


def transducer(path: str) -> Transducer:
    if path not in _compiled:
        _compiled[path] = Transducer(load(path))
    return _compiled[path]


def _encoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = transducer(path)
    for b in common.releasing(batches, t.forget):
        ids = [None if x is None else t.encode(x) for x in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    t = transducer(path)
    for b in common.releasing(batches):
        col, texts = b.column(1), []
        flat, off = col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()
        ok = col.is_valid().to_pylist()
        for r in range(len(col)):
            texts.append(t.decode(flat[off[r] : off[r + 1]].tolist()) if ok[r] else None)
        yield pa.RecordBatch.from_arrays([b.column(0), col, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])


def _both(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    return _decoded(_encoded(batches, path), path)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) of docs(doc_id, text)."""
    common.small_batches(docs.sparkSession)
    path = path or common.tokenizer_path(DEFAULT)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _encoded(b, path), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of (doc_id, ids)."""
    path = path or common.tokenizer_path(DEFAULT)
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decoded(b, path), "doc_id long, ids array<int>, decoded string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of docs(doc_id, text): encode and decode in one pass of one worker."""
    common.small_batches(docs.sparkSession)
    path = path or common.tokenizer_path(DEFAULT)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lambda b: _both(b, path), "doc_id long, ids array<int>, decoded string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every whole text, and a digest of them and of the text decoded from them."""
    got = round_trip(common.read(spark, sf_dir, "documents"))
    return got.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), F.length("decoded").cast("long").alias("decoded_chars"), F.sha2("decoded", 256).alias("decoded_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, ids, decoded_sha256) of every document."""
    got = round_trip(docs)
    return got.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).cast("long").alias("n_pieces"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))
