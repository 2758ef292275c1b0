"""URL filter: host and path rules first, then a weighted vocabulary found with an Aho-Corasick automaton."""
from __future__ import annotations

import re
from collections.abc import Iterable

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from earlog.llm.common import arrow_map, spare

#: Terms that reject alone, and terms of which several different ones are needed.
STRICT = ("casino", "pills", "bets", "porn", "xxx", "viagra", "escort", "warez", "jackpot")
SOFT = ("spam", "farm", "cheap", "free", "win", "ads", "track", "poker", "loan", "deal", "adult", "crack", "bonus", "sex")
_AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def automaton(strict: Iterable[str], soft: Iterable[str]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for kind, terms in (("soft", soft), ("strict", strict)):
        for t in terms:
            a.add_word(t, (kind, t))
    a.make_automaton()
    return a


def hits(url: str, a: ahocorasick.Automaton) -> tuple[set[str], set[str]]:
    """Different strict and soft terms that stand between characters other than a-z and 0-9."""
    s, strict, soft = url.translate(_AZ), set(), set()
    word = lambda i: 0 <= i < len(s) and (s[i].isascii() and s[i].isalnum())
    for end, (kind, term) in a.iter(s):
        if not word(end + 1) and not word(end - len(term)):
            (strict if kind == "strict" else soft).add(term)
    return strict, soft


def url_filter(pages: DataFrame, rules: Iterable[tuple[str, str, str]] = (), strict: Iterable[str] = STRICT,
               soft: Iterable[str] = SOFT, soft_needed: int = 2, url: str = "url") -> DataFrame:
    """All columns of pages plus _host, _path, _rule, _verdict, _strict, _soft.

    A rule is (verdict, host, path); it fits the host and its subdomains if the path starts with its path, and the rule of
    greatest length wins. Without a rule one strict term or `soft_needed` different soft terms block. Null urls and urls
    without '://' have an empty host and path; a null url has no terms and is allowed. Rows are judged one by one: repeated
    rows stay, an empty table gives an empty table. Input columns that clash with the new names are replaced.
    """
    rules = sorted(((h, p, v) for v, h, p in rules), key=lambda r: -len(r[0] + r[1]))
    strict, soft = tuple(strict), tuple(soft)
    after = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 1)
    host = F.translate(after, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"(?s)^.*?://([^/?#]*)([^?#]*)", 2)
    named = pages.drop("_host", "_path", "_rule", "_verdict", "_strict", "_soft")
    named = named.withColumns({"_host": host, "_path": path})

    def fit(i: int):
        h, p, _ = rules[i]
        return ((F.col("_host") == h) | F.col("_host").endswith("." + h)) & F.col("_path").startswith(p)
    which = F.coalesce(*[F.when(fit(i), F.lit(i)) for i in range(len(rules))], F.lit(-1))
    names = named.columns
    schema = StructType([*named.schema, StructField("_strict", ArrayType(StringType())), StructField("_soft", ArrayType(StringType()))])
    number = spare(pages.columns, "_which")[0]

    def scan(batches):
        a = automaton(strict, soft)
        for c in batches:
            found = [hits(u or "", a) for u in c[url].to_pylist()]
            yield {n: c[n] for n in names} | {"_strict": [sorted(x) for x, _ in found], "_soft": [sorted(y) for _, y in found]}
    own = F.when((F.size("_strict") > 0) | (F.size("_soft") >= soft_needed), "block").otherwise("allow")
    return (arrow_map(named, scan, schema).withColumn(number, which)
            .withColumn("_rule", F.coalesce(*[F.when(F.col(number) == i, F.lit(h + p)) for i, (h, p, _) in enumerate(rules)],
                                            F.lit(None).cast("string")))
            .withColumn("_verdict", F.coalesce(*[F.when(F.col(number) == i, F.lit(v)) for i, (*_, v) in enumerate(rules)], own))
            .drop(number))


def url_filter_sql(rules: Iterable[tuple[str, str, str]], strict: Iterable[str] = STRICT, soft: Iterable[str] = SOFT,
                   soft_needed: int = 2) -> str:
    """The same as DuckDB SQL over pages: page_id, host, path, rule, verdict."""
    rules = sorted(((h, p, v) for v, h, p in rules), key=lambda r: -len(r[0] + r[1]))
    low = "translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    has = lambda t: f"regexp_matches(low, '(^|[^a-z0-9]){re.escape(t)}($|[^a-z0-9])', 's')"
    fits = [f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')" for h, p, _ in rules]
    strict_sql = " OR ".join(map(has, strict)) or "false"
    soft_sql = " + ".join(f"({has(t)})::INT" for t in soft) or "0"
    rule = "CASE " + " ".join(f"WHEN {f} THEN '{h + p}'" for f, (h, p, _) in zip(fits, rules)) + " END"
    verdict = "CASE " + " ".join(f"WHEN {f} THEN '{v}'" for f, (*_, v) in zip(fits, rules))
    return f"""WITH u AS (SELECT page_id, {low} AS low,
        translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 1, 's'),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)([^?#]*)', 2, 's') AS path FROM pages)
      SELECT page_id, host, path, {rule} AS rule,
        {verdict} WHEN {strict_sql} OR {soft_sql} >= {soft_needed} THEN 'block' ELSE 'allow' END AS verdict FROM u"""
