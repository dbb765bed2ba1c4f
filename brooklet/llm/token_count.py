"""Token counts without tokens: a count-only Viterbi over Aho-Corasick matches.

One automaton holds the whole vocabulary and lists every piece that ends at each position of a
text. Dynamic programming carries two numbers a position: the best score and the piece count of
the path that has it; no piece is ever kept. For a unigram model the score is the sum of the
pieces' scores, in the library's precision, and of equal sums the path whose last piece begins
first wins, the tokenizer's own rule. For a BPE model exactly one piece can end each prefix, the one that greedy merging
leaves (see spm_model.compatible); the state carries that piece in place of the score. A character
outside the vocabulary counts its UTF-8 bytes with byte fallback, else one for each run.

Words of a BPE model are counted one by one (no piece crosses a space after a letter) and remembered,
up to a fixed number. Null and empty texts count 0; any length is read whole; rows may repeat and
other columns pass unread, because the count is an expression over the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .spm_model import BPE, MOST_PAIRS, MOST_WORDS, SPACE, Model, load, single, words

DEFAULT = "piece_bpe_32k.model"


class Counter:
    def __init__(self, model: Model):
        self.model = model
        self.auto = ahocorasick.Automaton()
        for p, i in (model.ids if model.kind == BPE else {**model.ids, **model.symbols}).items():
            self.auto.add_word(p, (len(p), i))
        self.auto.make_automaton()
        self._chars = {p for p in model.ids if len(p) == 1}
        self._known: dict[str, int] = {}
        self._after: dict[int, dict[int, bool]] = {}  # which pieces can stand after which
        self._weighed = 0

    def _ends(self, text: str) -> list[list[tuple[int, int]]]:
        """The pieces (length, id) that end at each position, the longest first."""
        ends: list[list[tuple[int, int]]] = [[] for _ in range(len(text))]
        for at, match in self.auto.iter(text):
            ends[at].append(match)
        for e in ends:
            e.sort(reverse=True)
        return ends

    def viterbi(self, text: str) -> int:
        """Pieces of a normalised text."""
        if self.model.kind != BPE:
            return self._unigram(text)
        return sum(self._bpe(run) if symbol is None else 1 for run, symbol in self.model.runs(text))

    def _bpe(self, text: str) -> int:
        if self._chars.issuperset(text):
            return self._run(text)
        total, at, run = 0, 0, False
        for i, c in enumerate(text):  # nothing merges across a character outside the vocabulary
            if c not in self._chars:
                if at < i:
                    total, run = total + self._run(text[at:i]), False
                total += len(c.encode("utf-8", "replace")) if self.model.byte_fallback else not run
                at, run = i + 1, True
        return total + (self._run(text[at:]) if at < len(text) else 0)

    def _run(self, text: str) -> int:
        """Pieces of a text of known characters. Matches come by end, the longest first; the first
        that fits is the only one."""
        m, after, n = self.model, self._after, len(text)
        last, count = [-1] * (n + 1), [-1] * (n + 1)
        count[0] = 0
        for at, (size, p) in self.auto.iter(text):
            if count[at + 1] >= 0:
                continue
            i = at + 1 - size
            weigh = after.get(last[i])
            if weigh is None:
                weigh = after[last[i]] = {}
            fine = weigh.get(p)
            if fine is None:
                fine = weigh[p] = m.compatible(last[i], p) if i else m.reachable(p)
                self._weighed += 1
            if fine:
                last[at + 1], count[at + 1] = p, count[i] + 1
        return count[n]

    def _unigram(self, text: str) -> int:
        m, n = self.model, len(text)
        best, count, run = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        for at, matches in enumerate(self._ends(text)):
            j, found = at + 1, False
            for size, p in matches:  # longest first: the earliest start wins a tie
                s = single(m.score(p) + best[j - size])
                if not found or s > best[j]:
                    best[j], count[j], run[j], found = s, count[j - size] + 1, False, True
            if text[at] not in m.ids:
                s = single(m.unk_score + best[at])
                if not found or s > best[j]:
                    best[j], run[j] = s, True
                    count[j] = count[at] + (len(text[at].encode("utf-8", "replace")) if m.byte_fallback else not run[at])
        return count[n]

    def forget(self) -> None:
        self._known.clear()
        self._after.clear()
        self._weighed = 0

    def count(self, text: str | None) -> int:
        if not text:
            return 0
        cut = words(self.model, text)
        if cut is None:
            return self.viterbi(self.model.normalise(text))
        known = self._known
        if len(known) > MOST_WORDS:
            known.clear()
        if self._weighed > MOST_PAIRS:
            self._after.clear()
            self._weighed = 0
        total, spaces = 0, ""
        for w in cut:
            if w and not spaces:
                got = known.get(w)
                if got is None:
                    got = self.viterbi(SPACE + w)
                    if len(w) <= 64:
                        known[w] = got
                total += got
            elif w:
                total += self.viterbi(spaces + SPACE + w)
                spaces = ""
            else:
                spaces += SPACE  # a run of spaces belongs to the word after it
        return total + (self.viterbi(spaces) if spaces else 0)


_compiled: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _compiled:
        _compiled[path] = Counter(load(path))
    return _compiled[path]


def tokens(text: Column, path: str | None = None) -> Column:
    """The number of pieces of a text column, as a long."""
    path = path or common.tokenizer_path(DEFAULT)

    @F.pandas_udf("long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        c = counter(path)
        for s in common.releasing(batches, c.forget):
            yield pd.Series([c.count(t) for t in s], dtype="int64")

    return run(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.read(spark, sf_dir, "documents")
    return docs.select("doc_id", tokens(F.col("text")).alias("n_tokens"))
