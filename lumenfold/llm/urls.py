"""URL filters: pattern rules behind an index of their rarest literal tokens.

A rule is a regular expression over host and path, with the literal tokens that any
match must contain whole.  The tokens' frequencies in the URLs are counted, and each
rule is filed under its rarest; a URL's tokens fetch the candidates, and only those
rules' expressions run.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rules that a worker holds at once; a longer list takes several passes.
RULES_PER_PASS = 100_000
_TOKEN = re.compile(r"[A-Za-z0-9]+")
_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path.  The rule with the highest (level,
    weight) decides; ``literals`` are whole tokens of every URL it can fit (none: it
    is tried on all)."""

    name: str
    action: str
    pattern: str
    literals: tuple[str, ...]
    level: int = 0
    weight: int = 0


def host_rule(action: str, where: str) -> Rule:
    """Fits ``where``'s host and all its subdomains, if the path starts with its path."""
    host, slash, path = where.partition("/")
    prefix = slash + path
    whole = prefix if not prefix or not prefix[-1].isalnum() else _TOKEN.sub(lambda m: "" if m.end() == len(prefix) else m[0], prefix)
    return Rule(where, action, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(prefix) if prefix else r'(?:/|\Z)'}", tuple(_TOKEN.findall(host) + _TOKEN.findall(whole)), 1, len(where))


def host_word(word: str) -> Rule:
    """Blocks hosts that hold the word by itself."""
    return Rule(f"host:{word}", "block", rf"^(?:[^/]*[^a-z0-9/])?{re.escape(word)}(?![a-z0-9])", (word,))


def path_segment(segment: str) -> Rule:
    """Blocks paths with this segment."""
    return Rule(f"path:{segment}", "block", rf"/{re.escape(segment)}(?:/|\Z)", tuple(_TOKEN.findall(segment)))


def path_ending(ending: str) -> Rule:
    """Blocks paths that end in this file ending."""
    return Rule(f"ending:{ending}", "block", rf"/[^/]*\.{re.escape(ending)}\Z", (ending,))


#: Words of hosts, path segments and file endings that are blocked.
BLOCKED_HOST_WORDS = (
    "adult", "bet", "bets", "betting", "casino", "casinos", "cialis", "escort", "escorts", "gambling", "hentai", "jackpot", "keygen", "lottery", "malware", "phishing",
    "pills", "poker", "porn", "porno", "roulette", "sex", "slots", "spam", "torrent", "torrents", "viagra", "warez", "webcam", "xxx",
)
BLOCKED_SEGMENTS = (
    "admin", "basket", "calendar", "cart", "casino", "cgi-bin", "checkout", "login", "login.php", "logout", "password-reset", "porn", "register", "signin", "signup", "trackback",
    "viagra", "wp-admin", "wp-json", "wp-login.php", "xmlrpc.php", "xxx",
)
BLOCKED_ENDINGS = ("apk", "avi", "bmp", "css", "dmg", "exe", "gif", "gz", "ico", "iso", "jpeg", "jpg", "js", "mov", "mp3", "mp4", "png", "rar", "svg", "tar", "webp", "woff", "zip")
PATTERN_RULES = (*map(host_word, BLOCKED_HOST_WORDS), *map(path_segment, BLOCKED_SEGMENTS), *map(path_ending, BLOCKED_ENDINGS))


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty without '://'."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    rest = re.split(r"[?#]", rest, maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_ASCII_LOWER), slash + path


def token_counts(urls: DataFrame, tokens: set[str], url: str = "url") -> dict[str, int]:
    """In how many rows each of the rules' tokens occurs."""
    if not tokens:
        return {}
    spark = urls.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted(tokens)], "token string")
    # Counted on the whole url, lower-cased too: a guide for the index, not a test.
    seen = urls.select(F.explode(F.array_distinct(F.split(F.concat_ws(" ", F.col(url), F.lower(url)), "[^A-Za-z0-9]+"))).alias("token"))
    return {r["token"]: r["n"] for r in seen.join(F.broadcast(wanted), "token").groupBy("token").agg(F.count("*").alias("n")).collect()}


class Index:
    def __init__(self, rules: list[Rule], counts: dict[str, int]):
        self.by_token: dict[str, list[tuple[re.Pattern, Rule]]] = {}
        self.rest: list[tuple[re.Pattern, Rule]] = []
        for r in rules:
            to = self.by_token.setdefault(min(r.literals, key=lambda t: (counts.get(t, 0), t)), []) if r.literals else self.rest
            to.append((re.compile(r.pattern), r))

    def best(self, host: str, path: str) -> Rule | None:
        subject, best = host + path, None
        for t in {*_TOKEN.findall(subject)} & self.by_token.keys():
            best = self._try(self.by_token[t], subject, best)
        return self._try(self.rest, subject, best)

    @staticmethod
    def _try(rules: list[tuple[re.Pattern, Rule]], subject: str, best: Rule | None) -> Rule | None:
        for p, r in rules:
            if (best is None or _rank(r) > _rank(best)) and p.search(subject):
                best = r
        return best


def _rank(r: Rule) -> tuple:
    return r.level, r.weight, r.action == "block", r.name


def judge(urls: DataFrame, rules: list[Rule] | tuple[Rule, ...], *, keep: tuple[str, ...] = ("page_id",), url: str = "url", default: str = "allow") -> DataFrame:
    """``keep`` with ``host``, ``path``, ``rule`` (name of the rule that decides, or
    null), ``level`` (its level, or null) and ``verdict``.

    The highest level decides, then the largest weight, then block before allow,
    then the name.  A null url or one without '://' has empty host and path, which no
    indexed rule fits.  Repeated rows stay; an empty table gives no rows.
    """
    names = [f"_k{i}" for i in range(len(keep))]
    df = urls.select(*[F.col(c).alias(a) for c, a in zip(keep, names)], F.col(url).alias("_url"))
    counts = token_counts(urls, {t for r in rules for t in r.literals}, url)
    df = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("host", "string"), ("path", "string"), ("rule", "string"), ("level", "int"), ("weight", "int"), ("verdict", "string"))])
    rules = list(rules)
    for at in range(0, max(1, len(rules)), RULES_PER_PASS):
        df = _pass(df, rules[at : at + RULES_PER_PASS], counts, default)
    return df.select(*[F.col(a).alias(c) for c, a in zip(keep, names)], "host", "path", "rule", "level", "verdict")


#: The last index of each Python worker, by the number of its pass.
_indexes: dict[str, Index] = {}


def _pass(df: DataFrame, rules: list[Rule], counts: dict[str, int], default: str) -> DataFrame:
    # RULES_PER_PASS rules at most.
    sent = df.sparkSession.sparkContext.broadcast((rules, {t: counts.get(t, 0) for r in rules for t in r.literals}))
    number = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from lumenfold.llm import urls

        if number not in urls._indexes:  # expressions are compiled once for each worker
            urls._indexes.clear()
            urls._indexes[number] = Index(*sent.value)
        index = urls._indexes[number]
        for b in batches:
            n = b.num_columns - 7
            cols: list[list] = [[] for _ in range(6)]
            for value, rule, level, weight, verdict in zip(*(b.column(i).to_pylist() for i in (n, n + 3, n + 4, n + 5, n + 6))):
                host, path = split_url(value)
                best = index.best(host, path) if host or path else None
                old = Rule(rule, verdict, "", (), level, weight) if rule is not None else None
                if best is None or (old and _rank(old) > _rank(best)):
                    best = old
                row = (host, path, best.name, best.level, best.weight, best.action) if best else (host, path, None, None, None, default)
                for c, x in zip(cols, row):
                    c.append(x)
            kinds = (pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], *(pa.array(c, t) for c, t in zip(cols, kinds))], names=b.schema.names)

    return df.mapInArrow(run, df.schema)
