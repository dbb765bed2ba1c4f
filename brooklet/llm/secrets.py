"""Secret scan: fixed patterns, and dictionary-primed zstandard novelty.

Base spans come from three patterns. The method adds spans of kind ``novel``: strings near a
sensitive word, measured by the marginal bytes that they add to the compressed text around
them (letters in one case), with a compressor primed by a dictionary. The dictionary holds words of
code and configuration, the parts of the standard library's identifiers, and the corpus's own: the
MOST_WORDS runs of letters that most documents hold, counted over all documents; words with a
digit, or of one document only, are none, so no secret gets in. What the dictionary and the surroundings
explain compresses away; what adds at least NOVEL_SHARE bytes a character (less for short strings,
whose first bytes tell little) is reported, unless a base span already covers part of it. Not reported
are UUIDs in their canonical form, and strings whose parts between marks are words and numbers,
with under CORE characters in parts that mix letters and digits: both name things. The
values of spans are cut out of the surroundings, and of those after it whatever may be one, so that no
secret explains another; a further occurrence of a novel value, or of a base span's, near a
sensitive word is reported too, as kind ``repeat``.

Positions are code points, ends are exclusive. Null and empty texts have no span; overlapping
spans of different kinds are all kept; texts of any length are read whole; ties in position
are ordered assign, access, hex, novel, repeat; rows may repeat and extra columns pass freely.
"""

from __future__ import annotations

import bisect
import builtins
import importlib
import keyword
import re
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "novel", "repeat")
# fixed values: the contract's patterns and least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
ASSIGN_LEAST, ACCESS_LEAST = 8, 16

#: Words that make a context sensitive, and how far before or after one a candidate may be.
SENSITIVE = ("password", "passwd", "passphrase", "secret", "token", "api_key", "apikey", "api-key", "private", "credential", "bearer", "auth", "access_key", "accesskey", "pwd", "signing", "session")
REACH, CONTEXT, LEAST, CORE, NOVEL_SHARE = 48, 256, 16, 10, 0.62
#: Corpus words in the dictionary, of 4 to LONGEST letters: at most 132 kB.
MOST_WORDS, LONGEST = 4096, 32
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)))
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.~-]+")
_BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]+)-----")
_BLOCK_LINE = re.compile(r"^[ \t]*([A-Za-z0-9+/=]+)[ \t\r]*$", re.M)
#: Primes the compressor: words of code and configuration that sensitive contexts are full of.
DICTIONARY = (
    "import export return function class const let var public private static final void string boolean integer "
    "true false null None self this new def async await try except catch finally raise throw lambda yield "
    "config settings options environment variable process.env os.environ getenv database connection host port "
    "username user_name password passwd secret token access_token refresh_token id_token api_key apikey client_id "
    "client_secret private_key public_key session_id authorization Authorization: Bearer Basic authentication "
    "credentials credential signing_key encryption_key certificate example sample placeholder changeme your_password_here "
    "your-api-key-here xxxxxxxxxxxxxxxx 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
    "https://www.example.com/ http://localhost:8080/ application/json text/html charset=utf-8 "
    "the and that this with from have for are was not you which their there would about could other "
)
#: Modules whose public names are split into words for the dictionary.
MODULES = "argparse asyncio base64 collections configparser csv ctypes datetime email functools hashlib hmac http.client http.cookies http.server importlib inspect io ipaddress itertools json logging multiprocessing os pathlib pickle platform queue random re sched shutil signal smtplib socket sqlite3 ssl string subprocess tarfile tempfile threading time tokenize traceback types typing unittest urllib.parse urllib.request uuid weakref xml.dom zipfile".split()
_UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
_MARKS = re.compile(r"[-._/~=]+")
_PART = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}")


def identifier_words() -> str:
    """The words of the standard library's identifiers, each once, in one case."""
    names = [*keyword.kwlist, *dir(builtins), *sorted(sys.stdlib_module_names)]
    for m in MODULES:
        found = importlib.import_module(m)
        names += [m, *dir(found), *(n for c in vars(found).values() if isinstance(c, type) for n in vars(c))]
    return " ".join(dict.fromkeys(w.lower() for n in names for w in _PART.findall(n)))


class Primer:
    """A compressor primed with the dictionary; the last words of it are the nearest."""

    def __init__(self, words: str = ""):
        self.data = " ".join((words.lower(), identifier_words(), DICTIONARY.lower())).encode()
        prime = zstandard.ZstdCompressionDict(self.data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        prime.precompute_compress(level=9)
        self.zstd = zstandard.ZstdCompressor(dict_data=prime, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.zstd.compress(text.lower().encode("utf-8", "replace")))

    def novelty(self, around: str, candidate: str) -> float:
        """Marginal compressed bytes of a candidate after its surroundings, per character."""
        return (self.size(around + candidate) - self.size(around)) / max(1, len(candidate))


_primers: dict[str, Primer] = {}


def primer(words: str = "") -> Primer:
    """A worker's compressor for a corpus's words; one is kept."""
    if words not in _primers:
        _primers.clear()
        _primers[words] = Primer(words)
    return _primers[words]


def corpus_words(docs: DataFrame, text: str = "text") -> str:
    """The letter runs that most documents hold, the most frequent last."""
    runs = F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(f"[A-Za-z]{{4,{LONGEST}}}"), F.lit(0)))
    held = docs.select(F.explode(runs).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return " ".join(r["w"] for r in reversed(held.orderBy(F.desc("n"), "w").limit(MOST_WORDS).collect()))


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out: list[tuple[int, int, str]] = []
    if "=" in text or ":" in text:
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def _pieces(text: str, hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Candidates by start: runs of their letters, cut out around sensitive words unless another
    sensitive word stands within REACH outside the run."""
    out, k = [], 0
    for m in _CANDIDATE.finditer(text):
        a, b = m.span()
        while k < len(hits) and hits[k][0] < a:
            k += 1
        inside = []
        for h in hits[k:]:
            if h[0] >= b:
                break
            inside.append(h)
        n = k + len(inside)
        if not inside or (k and a <= hits[k - 1][1] + REACH) or (n < len(hits) and hits[n][0] <= b + REACH):
            out.append((a, b))
        else:
            edges = [a, *(x for h in inside for x in h), b]
            out += [(x, y) for x, y in zip(edges[::2], edges[1::2], strict=True) if x < y]
    return out


def _blocks(text: str) -> list[tuple[int, int]]:
    """What stands between the BEGIN and END lines of a sensitive kind."""
    out, stop = [], 0
    for m in _BLOCK.finditer(text):
        if m.start() >= stop and _SENSITIVE.search(m[1].lower()):
            if (stop := text.find("-----END", m.end())) < 0:
                break
            out.append((m.end(), stop))
    return out


def novel_spans(text: str, taken: list[tuple[int, int, str]], words: str = "") -> list[tuple[int, int, str]]:
    """In reach is what lies within REACH of a sensitive word or of a span that was itself in reach,
    before or after it, and all of a private block (BEGIN to END) whose first line is sensitive."""
    low = text.lower()
    if len(low) != len(text):  # a few letters change length; only A-Z matters here
        low = text.translate(_LOWER)
    if not any(w in low for w in SENSITIVE):
        return []
    hits = [m.span() for m in _SENSITIVE.finditer(low)]
    blocks = _blocks(text)
    pieces, found = _pieces(text, hits), {}
    values = [(ASSIGN.match(text, a).start(2) if k == "assign" else a, b) for a, b, k in taken]
    busy, known = _Busy((a, b) for a, b, _ in taken), {v for a, b in values for v in _names(text[a:b])}
    cut = sorted(values)

    def before(a: int) -> str:
        """The last CONTEXT characters before a place, without the values of spans."""
        out, at, need = [], a, CONTEXT
        for i in range(bisect.bisect_left(cut, (a, 0)) - 1, -1, -1):
            x, y = cut[i]
            if need <= at - y:
                break
            if y < at:
                out.append(text[y:at])
                need -= at - y
            at = min(at, x)
        return "".join([text[max(0, at - need) : at], *reversed(out)])

    def around(a: int, b: int) -> str:
        """What stands before and after a candidate; of what follows, nothing that may be a value itself."""
        return _CANDIDATE.sub(lambda m: "" if len(m[0]) >= LEAST and _mixed(m[0]) else m[0], text[b : b + CONTEXT]) + " " + before(a)

    def told(a: int, b: int) -> bool:
        """Whether a candidate in reach is, or becomes, part of a span."""
        s = text[a:b]
        if busy.over(a, b):
            return True
        names = _names(s)
        if any(v in known for v in names):
            found[a] = (b, "repeat")
        elif len(s) < LEAST or not _mixed(s) or not _opaque(s) or primer(words).novelty(around(a, b), s) < least_novelty(len(s)):
            return False
        else:
            found[a] = (b, "novel")
            known.update(names)
        bisect.insort(cut, (a, b))
        return True

    ahead, k, j, rest = -1, 0, 0, []
    for a, b in pieces:
        while k < len(hits) and hits[k][1] <= a:
            ahead, k = max(ahead, hits[k][1] + REACH), k + 1
        while j < len(blocks) and blocks[j][0] <= a:
            ahead, j = max(ahead, blocks[j][1]), j + 1
        near = a <= ahead or (k < len(hits) and b <= hits[k][0] <= b + REACH)
        if near and told(a, b):
            ahead = max(ahead, b + REACH)
            rest.append((a, b, True))
        else:
            rest.append((a, b, near))
    behind = None
    for a, b, near in reversed(rest):
        if a in found or (near and busy.over(a, b)) or (behind is not None and not near and behind - b <= REACH and told(a, b)):
            behind = a
    for x, y in blocks:  # lines too short or too plain to be measured, between those that are not
        if any(x <= a < y for a in found) or busy.over(x, y):
            for m in _BLOCK_LINE.finditer(text, x, y):
                if m.start(1) not in found and not busy.over(*m.span(1)):
                    found[m.start(1)] = (m.end(1), "novel")
    return [(a, b, k) for a, (b, k) in sorted(found.items())]


def least_novelty(n: int) -> float:
    return min(NOVEL_SHARE, 0.85 - 5 / n)


def _opaque(s: str) -> bool:
    """Whether a string is more than words, numbers and marks."""
    return not _UUID.fullmatch(s) and sum(len(x) for x in _MARKS.split(s) if _mixed(x)) >= CORE


def _mixed(s: str) -> bool:
    return any(c.isdigit() for c in s) and any(c.isalpha() for c in s)


def _names(s: str) -> list[str]:
    """What a value is known again by: it, and its parts between equals signs, without marks around."""
    return [v for x in {s, *s.split("=")} if len(v := x.strip("=.~_-")) >= LEAST and _mixed(v)]


class _Busy:
    """Spans already reported, asked for overlap."""

    def __init__(self, spans: Iterable[tuple[int, int]]):
        self.starts, self.ends, most = [], [], 0
        for a, b in sorted(spans):
            most = max(most, b)
            self.starts.append(a)
            self.ends.append(most)

    def over(self, a: int, b: int) -> bool:
        n = bisect.bisect_left(self.starts, b)
        return n > 0 and self.ends[n - 1] > a


_LOWER = {c: c + 32 for c in range(65, 91)}
_RANK = {k: i for i, k in enumerate(KINDS)}


def spans(text: str | None, words: str = "") -> list[tuple[int, int, str]]:
    """All spans of a text as (start, end, kind), by start and then kind; ``words`` are the corpus's."""
    if not text:
        return []
    base = base_spans(text)
    return sorted(base + novel_spans(text, base, words), key=lambda s: (s[0], _RANK[s[2]], s[1]))


def joined(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in found)


def redact(text: str | None, words: str = "", mark: str = "[SECRET]") -> str | None:
    """The text with the value of every span replaced; a pattern's key and quotes stay."""
    found = spans(text, words)
    if not found:
        return text
    cuts = sorted((ASSIGN.match(text, a).start(2) if k == "assign" else a, b) for a, b, k in found)
    out, at = [], 0
    for a, b in cuts:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def scan(text: Column, words: str = "") -> Column:
    """array<struct<kind, start, stop>> of a text column, with the corpus's words (corpus_words)."""

    @F.pandas_udf("array<struct<kind: string, start: int, stop: int>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[{"kind": k, "start": a, "stop": b} for a, b, k in spans(t, words)] for t in s])

    return run.asNondeterministic()(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.small_batches(spark)
    docs = common.read(spark, sf_dir, "documents")
    docs = docs.select("doc_id", scan(F.col("text"), corpus_words(docs)).alias("s"))
    n = lambda k: F.size(F.filter("s", lambda x: x["kind"] == k)).cast("long")
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["stop"])), ",")
    base = F.filter("s", lambda x: x["kind"].isin(*KINDS[:3]))
    return docs.select("doc_id", *[n(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("s")).alias("spans"), n("novel").alias("n_novel"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; the values of secrets in its text are masked and n_chars follows."""
    words = corpus_words(docs)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([redact(t, words) for t in s], dtype=object)

    common.small_batches(spark)
    out = docs.withColumn("text", run.asNondeterministic()(F.col("text")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
