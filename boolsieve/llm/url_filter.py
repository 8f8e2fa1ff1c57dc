"""Allow and block rules on urls, indexed by their rarest literal token. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from boolsieve.llm.common import free
from boolsieve.session import cut

#: Rules up to which their table is broadcast; it takes under 1 KB a rule.
BROADCAST_RULES = 20_000


@dataclass(frozen=True)
class Rule:
    """``pattern`` is searched in host + path; ``tokens`` are literal tokens that every url it fits has, if there are such.

    A rule without tokens can't be looked up: every url runs its expression.
    """

    name: str
    verdict: str
    pattern: str
    tokens: tuple[str, ...]
    base: bool = False


def place_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for a host, its subdomains and a path's start; of several that fit, the longest name wins."""
    tokens = [t for t in host.lower().split(".") if t.isascii() and t.isalnum()]
    tokens += [t.lower() for t in path.split("/")[1:-1] if t.isascii() and t.isalnum()]  # what stands between slashes is whole
    return Rule(host + path, verdict, rf"^(?:[^/]*\.)?{_quote(host)}{_quote(path)}", tuple(tokens), base=True)


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() or c in "/-_" else "\\" + c for c in text)


#: The rules of the contract.
BASE_RULES = (
    place_rule("block", "com", "/en/"), place_rule("allow", "example.com", "/en/7"), place_rule("allow", "net", "/de/"),
    place_rule("block", "example.net", "/de/8"), place_rule("block", "org", "/es/"),
)
#: Words of hosts, file endings and last steps of paths that the method blocks.
SPAM_WORDS = (
    "casino", "poker", "jackpot", "slots", "roulette", "betting", "viagra", "cialis", "xanax", "tramadol", "porn", "xxx", "camgirls", "escorts", "payday", "forex", "bitcoins", "replica", "torrent", "warez", "keygen", "cracks",
)
FILE_ENDINGS = ("exe", "msi", "dll", "apk", "iso", "dmg", "bin", "zip", "rar", "7z", "tar", "gz", "jpg", "jpeg", "png", "gif", "svg", "ico", "mp3", "mp4", "avi", "mov", "css", "js", "woff", "ttf")
LAST_STEPS = ("login", "logout", "signin", "signup", "register", "checkout", "cart", "unsubscribe", "xmlrpc", "wp-login")
#: The method's own rules, for urls that no base rule fits. Both Java's and RE2's expressions read them alike.
OWN_RULES = (
    *(Rule(f"cheap-{w}", "block", rf"^[^/]*(?:^|[^a-z0-9/])(?:cheap|buy|online)-{w}(?:[^a-z0-9]|$)", (w,)) for w in ("pills", "meds", "drugs", "watches")),
    Rule("spam-host", "block", r"^(?:[^/]*[^a-z0-9/])?spam(?:-[a-z0-9]+)*\.", ("spam",)),
    *(Rule(f"host-{w}", "block", rf"^(?:[^/]*[^a-z0-9/])?{w}(?:[^a-z0-9]|$)", (w,)) for w in SPAM_WORDS),
    *(Rule(f"file-{e}", "block", rf"/[^/]*\.(?i:{e})$", (e,)) for e in FILE_ENDINGS),
    *(Rule(f"page-{p}", "block", rf"/(?i:{p})(?:/|\.php|\.html)?$", tuple(p.split("-"))) for p in LAST_STEPS),
    Rule("address", "block", r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?::[0-9]+)?(?:/|$)", ()),
)


def host_of(url: Column) -> Column:
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def judge(pages: DataFrame, rules: tuple[Rule, ...] = BASE_RULES + OWN_RULES, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, own_rule) for every row of ``pages``.

    Each distinct url fetches the rules under its tokens, runs only their regular expressions and takes the longest base
    rule that fits, or else a block by one of the method's own rules (``own_rule``), or else is allowed. Urls without a
    host (null, or no ``://``) are blocked by the method. Rules stand under the token that the fewest distinct urls have;
    rules without a token are run on every distinct url.
    Repeated and null ids each return; other columns are not read; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"))
    urls = rows.select("url").distinct().select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).filter("host <> ''")
    lowered = F.translate(F.concat_ws("/", "host", "path"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tokens = urls.select("url", F.concat("host", "path").alias("subject"), F.explode(F.array_distinct(F.regexp_extract_all(lowered, F.lit("[a-z0-9]+"), 0))).alias("token"))
    listed = [(r, t) for r in rules for t in r.tokens]
    columns = {"rule": [r.name for r, _ in listed], "verdict": [r.verdict for r, _ in listed], "pattern": [r.pattern for r, _ in listed], "token": [t for _, t in listed]}
    book = spark.createDataFrame(pa.table({k: pa.array(v, pa.string()) for k, v in columns.items()} | {"base": pa.array([r.base for r, _ in listed], pa.bool_())}))
    small = len(rules) <= BROADCAST_RULES
    hint = F.broadcast if small else (lambda x: x)
    known = cut(tokens.join(hint(book.select("token").distinct()), "token", "left_semi"))
    counts = known.groupBy("token").agg(F.count("*").alias("n"))
    seen = book.join(counts, "token", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    index = cut(seen.groupBy("rule", "verdict", "pattern", "base").agg(F.min_by("token", F.struct("n", "token")).alias("token")))
    fits = known.join(hint(index), "token").filter(F.expr("rlike(subject, pattern)")).select("url", "rule", "verdict", "base")
    rest = [r for r in rules if not r.tokens]
    if rest:
        always = F.array(*[F.when(F.concat("host", "path").rlike(r.pattern), F.struct(F.lit(r.name).alias("rule"), F.lit(r.verdict).alias("verdict"), F.lit(r.base).alias("base"))) for r in rest])
        fits = fits.unionByName(urls.select("url", F.inline(F.filter(always, lambda x: x.isNotNull()))))
    best = F.max_by(F.struct("rule", "verdict", "base"), F.struct("base", F.length("rule"), "rule"))
    found = cut(fits.groupBy("url").agg(best.alias("best")).select(F.col("url").alias("_url"), "best"))
    base = F.col("best.base")
    return rows.join(found, F.col("url") == F.col("_url"), "left").select(
        F.col("id").alias(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.when(base, F.col("best.rule")).alias("rule"),
        F.when(F.col("best").isNotNull(), F.col("best.verdict")).when(host_of(F.col("url")) == "", "block").otherwise("allow").alias("verdict"),
        F.when(~base, F.col("best.rule")).alias("own_rule"),
    )


def keep_allowed(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` whose url is allowed, with all their columns."""
    judged = judge(pages.select(F.col(f"`{url_col}`").alias("u")), id_col="u", url_col="u")
    (allowed,) = free(pages, "_allowed")
    urls = cut(judged.filter("verdict = 'allow'").select(F.col("u").alias(allowed)).distinct())
    return pages.join(urls, F.col(f"`{url_col}`") == F.col(allowed), "left_semi")
