"""URL filter: rules by longest match, and logistic regression on hashed character n-grams.

A url's host (after the first "://", up to "/", "?", "#" or the end, A-Z lower-cased) and path
(from there up to "?", "#" or the end) are judged by rules first; a rule fits its host and all
subdomains if the path starts with the rule's path, and the longest fitting rule decides. Other
urls are judged by the model: character n-grams of host and path, hashed into BUCKETS by the
first hex digits of their MD5, weighted by logistic regression fitted to the small labelled
table below (plain gradient descent, always from zero, so always the same weights).

Native: scoring is DataFrame functions only; the weights are one constant array of BUCKETS
numbers. Defined cases: null urls, or urls without "://", have empty host and path, fit no
rule and are allowed; long urls are read whole; equal urls get equal verdicts.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS, GRAMS = 8192, (3, 4)
#: Log-odds of block of a url that says nothing.
PRIOR = -0.8
#: The contract's rules: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))

#: The labelled table: whole hosts, each with paths by rule (see labelled_urls).
ALLOW_HOSTS = (
    "en.wikipedia.org bbc.co.uk nytimes.com theguardian.com reuters.com lemonde.fr spiegel.de elpais.com nature.com science.org arxiv.org "
    "stackoverflow.com github.com docs.python.org developer.mozilla.org w3.org ietf.org kernel.org debian.org apache.org who.int un.org europa.eu "
    "gov.uk nasa.gov nih.gov loc.gov bl.uk bnf.fr mit.edu stanford.edu ox.ac.uk ethz.ch uni-heidelberg.de sorbonne-universite.fr "
    "archive.org gutenberg.org britannica.com merriam-webster.com weather.com metoffice.gov.uk openstreetmap.org nationalgeographic.com "
    "khanacademy.org coursera.org scholar.google.com jstor.org springer.com plos.org wiley.com acm.org ieee.org "
    "imdb.com goodreads.com allrecipes.com seriouseats.com gardenersworld.com rspb.org.uk nhs.uk redcross.org unicef.org "
    "blog.cloudflare.com engineering.fb.com postgresql.org sqlite.org rust-lang.org golang.org nodejs.org npmjs.com pypi.org "
    "lists.example.org library.example.com museum.example.org recipes.example.com news.example.com history.example.net garden.example.com "
    "school.example.org wiki.example.net journal.example.com weather.example.net shop.example.com forum.example.org travel.example.com "
    "music.example.net books.example.org village-choir.example.com chess-club.example.org river-trust.example.net"
).split()
BLOCK_HOSTS = (
    "cheap-pills.com cheap-viagra-online.net buy-viagra.biz buy-cialis-now.com online-pharmacy-pills.info discount-pills.example.com no-prescription-pills.net "
    "casino-bonus.com free-casino.net online-casino-slots.biz casino-jackpot.example.com best-slots-casino.info vip-poker-casino.com poker-bonus.net free-poker-chips.biz "
    "free-bets.com sports-bets-bonus.net bets-online-win.info win-prizes.com win-free-iphone.net you-win-prize.biz lottery-winner-prize.com free-lottery.info "
    "xxx-video.com free-xxx-cams.net adult-cams.biz live-adult-video.com hot-adult-dating.net sexy-cams-live.info porn-tube-free.com free-porn-video.net xxx-adult-sex.biz sex-dating-tonight.com "
    "loan-offers.com payday-loan-fast.net fast-cash-loan.biz instant-loan-approval.info cash-advance-now.com easy-money-online.net free-money.biz make-money-fast.com money-from-home.info "
    "crypto-double.com double-your-bitcoin.net bitcoin-giveaway.biz free-bitcoin-bonus.com crypto-profit-bot.info forex-profit-signals.net "
    "replica-watches.com cheap-replica-bags.net luxury-replica-outlet.biz fake-rolex-watches.com discount-handbags-outlet.info "
    "weight-loss-miracle.com fast-weight-loss-pills.net miracle-diet-pills.biz lose-weight-fast.info "
    "spam-farm.com link-farm-seo.net seo-links-cheap.biz buy-backlinks-seo.com cheap-seo-traffic.info buy-followers-cheap.net click-bait-deals.com hot-deals-click.biz "
    "download-crack-free.com free-keygen-crack.net warez-serial-crack.biz free-movie-download-hd.com torrent-crack-full.info "
    "spam-pills.example.org xxx-cams.example.com free-money.example.net loan-spam.example.org bets-casino.example.net crack-warez.example.org seo-spam.example.com"
).split()
PATHS = ("/", "/en/1", "/de/page", "/fr/article.html", "/es/2", "/2024/05/item", "/index.php", "/about", "/a/b/c.htm", "/topic-17/", "/en/4529/", "/view")
#: Allowed hosts of no meaning, by rule: names of syllables, so that a host that says nothing isn't blocked.
PLAIN_HOSTS, _ONSETS, _RIMES, _ENDS = 120, "b c d f g h k l m n p r s t v w th st ch".split(), "a e i o u an en in on er al".split(), "com net org example.com example.net example.org de fr io co.uk".split()


def labelled_urls() -> list[tuple[str, str, int]]:
    """(host, path, 1 = block) of the small labelled table; every path stands on both sides."""
    plain, state = [], 12345
    for i in range(PLAIN_HOSTS):
        name = ""
        for j in range(2 + i % 3):
            state = (state * 1103515245 + 12345) % (1 << 31)  # a fixed sequence
            name += _ONSETS[(state >> 8) % len(_ONSETS)] + _RIMES[(state >> 16) % len(_RIMES)]
        plain.append(f"{name}.{_ENDS[i % len(_ENDS)]}")
    return [(h, PATHS[(i + j) % len(PATHS)], y) for y, hosts in ((1, BLOCK_HOSTS), (0, [*ALLOW_HOSTS, *plain])) for i, h in enumerate(hosts) for j in (0, 5)]


def _grams(host: str, path: str) -> list[int]:
    s = f"^{host}{path}$"
    return [int(hashlib.md5(s[i : i + n].encode()).hexdigest()[:4], 16) % BUCKETS for n in GRAMS for i in range(len(s) - n + 1)]


def fit(rows: list[tuple[str, str, int]] | None = None, rounds: int = 300, rate: float = 8.0, decay: float = 5e-4, bias: float = PRIOR) -> tuple[list[float], float]:
    """(weights, bias). A url's score is the sum of its n-grams' weights over the root of their number,
    plus the bias, a prior that isn't fitted: what has no known n-gram is allowed. Both labels weigh the
    same as a whole."""
    data = [(_grams(h, p), y) for h, p, y in rows or labelled_urls()]
    share = {y: 0.5 / max(1, sum(x[1] == y for x in data)) for y in (0, 1)}
    w = [0.0] * BUCKETS
    for _ in range(rounds):
        grad = [rate * decay * x for x in w]
        for g, y in data:
            norm = max(1, len(g)) ** 0.5
            z = sum(w[i] for i in g) / norm + bias
            e = (1 / (1 + math.exp(-max(-30.0, min(30.0, z)))) - y) * share[y]
            for i in g:
                grad[i] += rate * e / norm
        w = [x - d for x, d in zip(w, grad, strict=True)]
    return [round(x, 6) for x in w], bias


_MODEL: tuple[list[float], float] | None = None


def model() -> tuple[list[float], float]:
    global _MODEL
    if _MODEL is None:
        _MODEL = fit()
    return _MODEL


def host_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    none = F.lit("")
    return F.coalesce(host, none), F.coalesce(path, none)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule, or null."""
    out = F.lit(None).cast("struct<rule: string, verdict: string>")
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def score(host: Column, path: Column, weights: list[float], bias: float) -> Column:
    """The log-odds of block."""
    table = F.expr("array(" + ", ".join(f"{x!r}D" for x in weights) + ")")  # literals only: folded to one constant
    s = F.concat(F.lit("^"), host, path, F.lit("$"))
    at = lambda n: F.when(F.length(s) >= n, F.transform(F.sequence(F.lit(1), F.length(s) - (n - 1)), lambda i: F.pmod(F.conv(F.substr(F.md5(F.substr(s, i, F.lit(n)).cast("binary")), F.lit(1), F.lit(4)), 16, 10).cast("int"), F.lit(BUCKETS)))).otherwise(F.array().cast("array<int>"))
    grams = F.concat(*[at(n) for n in GRAMS])
    total = F.aggregate(grams, F.lit(0.0), lambda a, g: a + F.get(table, g))
    return total / F.sqrt(F.greatest(F.size(grams), F.lit(1))) + bias


def judge(url: Column) -> Column:
    """struct<host, path, rule, verdict> of a url column."""
    host, path = host_path(url)
    one = F.transform(F.array(F.struct(host.alias("host"), path.alias("path"))), lambda u: F.struct(u["host"].alias("host"), u["path"].alias("path"), rule_of(u["host"], u["path"]).alias("r"), score(u["host"], u["path"], *model()).alias("z")))[0]
    return F.transform(F.array(one), lambda u: F.struct(u["host"].alias("host"), u["path"].alias("path"), u["r"]["rule"].alias("rule"), F.when(u["r"].isNotNull(), u["r"]["verdict"]).when((u["host"] != "") & (u["z"] > 0), "block").otherwise("allow").alias("verdict")))[0]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.read(spark, sf_dir, "pages").select("page_id", judge(F.col("url")).alias("j")).select("page_id", "j.host", "j.path", "j.rule", "j.verdict")


def oracle() -> str:
    w, bias = model()
    grams = " UNION ALL ".join(f"SELECT k, n, unnest(range(1, CAST(length(s) AS BIGINT) - {n - 2})) AS i, s, {n} AS g FROM t" for n in GRAMS)
    return rf"""
WITH u AS (SELECT page_id, row_number() OVER () AS k, regexp_extract(coalesce(url, ''), '(?s)^.*?://(.*)$', 1) AS rest FROM pages),
t AS (SELECT *, '^' || host || path || '$' AS s, 0 AS n FROM (
  SELECT page_id, k, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u)),
w AS (SELECT unnest(range(0, {BUCKETS})) AS b, unnest([{", ".join(map(repr, w))}]) AS x),
grams AS (SELECT k, CAST('0x' || substr(md5(substr(s, i, g)), 1, 4) AS INTEGER) % {BUCKETS} AS b FROM ({grams})),
z AS (SELECT k, sum(x) / sqrt(count(*)) + {bias!r} AS z FROM grams JOIN w USING (b) GROUP BY k)
SELECT page_id, host, path,
  CASE {" ".join(f"WHEN {_sql_fits(h, p)} THEN '{h}{p}'" for _, h, p in _longest_first())} END AS rule,
  CASE {" ".join(f"WHEN {_sql_fits(h, p)} THEN '{v}'" for v, h, p in _longest_first())} WHEN host <> '' AND z.z > 0 THEN 'block' ELSE 'allow' END AS verdict
FROM t LEFT JOIN z ON z.k = t.k
"""


def _longest_first():
    return sorted(RULES, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def _sql_fits(host: str, path: str) -> str:
    return f"(host = '{host}' OR host LIKE '%.{host}') AND starts_with(path, '{path}')"
