"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch the rules to run.

A rule is a regular expression with the tokens that every match must hold, given or read from the
pattern. The index files it under the one of them that the fewest rows of the table hold, so common
tokens fetch nothing; a rule without tokens is tried on every URL. Patterns are compiled when they
are first fetched. Rules come from this module or from a table of any size: at most `BLOCK` of them
are sent to the tasks at a time, and each further block is one more pass over the URLs, which keeps
the best rule so far.

Null URLs and URLs without `://` have an empty host and path and match no host rule. Each row is
judged by itself, whatever its page_id; an empty table gives an empty result; columns other than
page_id and url are not read. A very long URL is held whole by one task.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from re import _constants as _RE
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, map_arrow, written

#: How URLs and rules fall into tokens.
TOKEN = r"[0-9a-z]+"
#: Rules that are sent to the tasks at a time.
BLOCK = 50_000


@dataclass(frozen=True)
class UrlRule:
    """`pattern` is searched in host + path; of the matching rules the one with the highest rank decides."""

    name: str
    pattern: str
    verdict: str
    rank: int
    tokens: tuple[str, ...] = field(default=())


def host_rule(name: str, host: str, path: str, verdict: str) -> UrlRule:
    """Fits the host, its subdomains, and paths that start with the path; longer rules rank higher."""
    return UrlRule(name, rf"^(?:[^/]*\.)?{re.escape(host)}{re.escape(path)}", verdict, 1_000_000 + len(name), tuple(re.findall(TOKEN, host.lower())))


#: Fixed rules of the contract: host, path, verdict.
HOST_RULES = (
    host_rule("net/", "net", "/", "block"),
    host_rule("example.net/en/", "example.net", "/en/", "allow"),
    host_rule("example.com/de/", "example.com", "/de/", "block"),
    host_rule("org/fr/", "org", "/fr/", "allow"),
)
#: Fixed general patterns, which decide where no host rule fits.
PATTERN_RULES = (
    UrlRule("spam-farm", r"(?:^|[.-])spam-farm\.", "block", 10, ("spam", "farm")),
    UrlRule("link-farm", r"(?:^|[.-])link-farm\.", "block", 10, ("link", "farm")),
    UrlRule("casino", r"(?:^|[./-])casino(?:[./-]|$)", "block", 10, ("casino",)),
    UrlRule("malware", r"(?:^|[./-])malware(?:[./-]|$)", "block", 10, ("malware",)),
)


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _separates(item: tuple) -> bool:
    """Whether what this part of a pattern matches is an edge of the address or of a token, or ends in one."""
    kind, value = item
    if kind is _RE.LITERAL:
        return not re.fullmatch(TOKEN, chr(value).lower())
    if kind is _RE.AT:
        return value is not _RE.AT_NON_BOUNDARY
    if kind is _RE.IN:
        return all(k is _RE.LITERAL and _separates((k, v)) for k, v in value)
    if kind is _RE.BRANCH:
        return all(len(x) and all(map(_separates, x)) for x in value[1])
    if kind is _RE.SUBPATTERN:
        return len(value[3]) > 0 and all(map(_separates, value[3]))
    return False


def needed_tokens(pattern: str) -> tuple[str, ...]:
    """Tokens that any address holds which the pattern is found in: its letters and digits between parts that separate tokens."""
    out: list[str] = []
    held: str | None = None  # the token may have more before it
    parsed = _parser.parse(pattern)
    for item in [*parsed, None]:
        if item is not None and item[0] is _RE.LITERAL and not _separates(item):
            held = None if held is None else held + chr(item[1]).lower()
        elif item is not None and _separates(item):
            out += [held] if held else []
            held = ""
        else:
            held = None
    if parsed.state.flags & re.IGNORECASE:  # signs beyond ASCII stand for these letters too
        out = [t for t in out if not re.search("[iks]", t)]
    return tuple(dict.fromkeys(out))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of a Parquet table: name, pattern, verdict, rank, and tokens (an array) where the table has them."""
    t = spark.read.parquet(path)
    tokens = t["tokens"] if "tokens" in t.columns else F.lit(None).cast("array<string>")
    return t.select("name", "pattern", "verdict", t["rank"].cast("long").alias("rank"), tokens.alias("tokens")).where("name IS NOT NULL AND pattern IS NOT NULL AND verdict IS NOT NULL AND rank IS NOT NULL")


def _in_blocks(rules: Sequence[UrlRule] | DataFrame, block: int) -> Iterator[list[UrlRule]]:
    if not isinstance(rules, DataFrame):
        yield from (list(rules[k : k + block]) for k in range(0, max(1, len(rules)), block))
        return
    n = max(1, -(-rules.count() // block))
    for k in range(n):  # about a block of rules at a time
        some = rules.where(F.pmod(F.xxhash64("name", "pattern"), F.lit(n)) == k).collect()
        yield [UrlRule(r.name, r.pattern, r.verdict, r["rank"], tuple(r.tokens) if r.tokens is not None else needed_tokens(r.pattern)) for r in some]


def rarest_tokens(urls: DataFrame, rules: Sequence[UrlRule]) -> dict[str, str]:
    """Pattern: its token that the fewest rows of urls (address) hold. Only the rules' own tokens are counted."""
    wanted = sorted({t for r in rules for t in r.tokens})
    if not wanted:
        return {}
    known = F.broadcast(urls.sparkSession.createDataFrame([(t,) for t in wanted], "t string"))  # a block's tokens
    said = urls.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("address"), F.lit(TOKEN), F.lit(0)))).alias("t"))
    seen = dict(said.join(known, "t").groupBy("t").count().collect())
    return {r.pattern: min(r.tokens, key=lambda t: (seen.get(t, 0), t)) for r in rules if r.tokens}


class RuleIndex:
    """The rules by token; `judge` runs the patterns of the fetched rules alone."""

    def __init__(self, rules: Sequence[UrlRule], filed: dict[str, str]):
        self.by_token: dict[str, list[UrlRule]] = defaultdict(list)
        self.always: list[UrlRule] = []
        self.compiled: dict[str, re.Pattern] = {}
        for r in rules:
            (self.by_token[filed[r.pattern]] if r.pattern in filed else self.always).append(r)
        self.split = re.compile(TOKEN).findall

    def judge(self, address: str, best: tuple[int, str, str] | None = None) -> tuple[int, str, str] | None:
        """Rank, name and verdict of the best rule that fits, or the one given."""
        fetched = {t: self.by_token[t] for t in self.split(address.lower()) if t in self.by_token}
        for some in (*fetched.values(), self.always):
            for rule in some:
                if best is None or (rule.rank, rule.name) > best[:2]:
                    if (pattern := self.compiled.get(rule.pattern)) is None:
                        pattern = self.compiled[rule.pattern] = re.compile(rule.pattern)
                    if pattern.search(address):
                        best = (rule.rank, rule.name, rule.verdict)
        return best


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule] | DataFrame = HOST_RULES + PATTERN_RULES, default: str = "allow", key: str = "page_id", block: int = BLOCK) -> DataFrame:
    """key, host, path, rule (its name or null), verdict for each row of pages (key, url); rules as such or as a table from read_rules."""
    found = pages.select(pages[key].alias("k"), host_of(pages["url"]).alias("host"), path_of(pages["url"]).alias("path"))
    found = found.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("rank", "long"), ("rule", "string"), ("verdict", "string"))])
    for n, some in enumerate(_in_blocks(rules, block)):
        found = _pass(written(found) if n else found, some)
    return found.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))


def _pass(found: DataFrame, rules: list[UrlRule]) -> DataFrame:
    """found (k, host, path, rank, rule, verdict) with the best of these rules, where it is better."""
    found = found.withColumn("address", F.concat("host", "path"))
    shared = found.sparkSession.sparkContext.broadcast((rules, rarest_tokens(found, rules)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        index = RuleIndex(*shared.value)
        for b in batches:
            rank, rule, verdict, address = (b.column(c).to_pylist() for c in ("rank", "rule", "verdict", "address"))
            got = [index.judge(a, None if r is None else (r, n, v)) for r, n, v, a in zip(rank, rule, verdict, address, strict=True)]
            yield {c: b.column(c) for c in ("k", "host", "path")} | {c: [g and g[i] for g in got] for i, c in enumerate(("rank", "rule", "verdict"))}

    return map_arrow(found, run, carried({"k": found.schema["k"].dataType}, "host string, path string, rank long, rule string, verdict string"))
