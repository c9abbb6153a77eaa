"""Secret scans by a trigram inverted index, with DataFrame functions only.

Each rule's regex gives a Boolean query of trigrams that any match must hold. The index has, per trigram that some rule
asks for and per shard, the list of the texts that hold it (by a hash). A rule's query is answered from these lists alone,
by intersections and unions; only then are the texts found fetched and verified with the rule's regex. A rule without
mandatory trigrams (a bare run of hex digits) is run over every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, join_keyed, lower_ascii, stored

#: Strings that a part of a regex may stand for before it counts as anything.
MOST_STRINGS = 64
#: Texts a shard of the index has, about: the longest list of a trigram.
SHARD_ROWS = 16_384


@dataclass(frozen=True)
class Rule:
    """kind; regex (the same in Java and Python); the group whose length must be at least least."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


#: In the order in which kinds are listed. The first three are the base rules.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("code_host", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE = 3

Query = tuple  # ("tri", "abc"), ("and", queries), ("or", queries); ("and", ()) holds for every text


def _all(*queries: Query) -> Query:
    flat = [y for q in queries for y in (q[1] if q[0] == "and" else (q,))]
    return flat[0] if len(set(flat)) == 1 else ("and", tuple(dict.fromkeys(flat)))


def _any(queries: list[Query]) -> Query:
    if any(q == ("and", ()) for q in queries):
        return ("and", ())
    flat = tuple(dict.fromkeys(queries))
    plain = {q: trigrams(q) for q in flat if q[0] != "or" and all(x[0] == "tri" for x in q[1] if q[0] == "and")}
    # A choice that asks for all that another asks for, and more, adds nothing.
    flat = tuple(q for q in flat if not any(p != q and plain[p] <= plain[q] for p in plain if q in plain))
    return flat[0] if len(flat) == 1 else ("or", flat)


def _of_strings(strings: set[str]) -> Query:
    """What a text that holds one of the strings must hold."""
    return _any([_all(*(("tri", s[i : i + 3]) for i in range(len(s) - 2))) if len(s) > 2 else ("and", ()) for s in sorted(strings)]) if strings else ("and", ())


def _walk(node) -> tuple[set[str] | None, Query]:
    """The strings that a parsed regex stands for, if they are few, and the query that holds besides."""
    if not isinstance(node, tuple):  # a sequence
        query, strings, broken = ("and", ()), {""}, False
        for part in node:
            s, q = _walk(part)
            query = _all(query, q)
            if s is None or len(s) * len(strings) > MOST_STRINGS:
                query, strings, broken = _all(query, _of_strings(strings)), s or {""}, True
            else:
                strings = {a + b for a, b in product(strings, s)}
        return (None, _all(query, _of_strings(strings))) if broken else (strings, query)
    kind, arg = str(node[0]), node[1]
    if kind == "LITERAL":
        return {chr(arg).lower()}, ("and", ())
    if kind == "IN":
        if len(arg) <= 8 and all(str(k) == "LITERAL" for k, _ in arg):
            return {chr(c).lower() for _, c in arg}, ("and", ())
        return None, ("and", ())
    if kind == "SUBPATTERN":
        return _walk(arg[-1])
    if kind == "BRANCH":
        found = [_walk(b) for b in arg[1]]
        if all(s is not None for s, _ in found) and sum(len(s) for s, _ in found) <= MOST_STRINGS:
            return set().union(*(s for s, _ in found)), ("and", ())
        return None, _any([_all(q, _of_strings(s or set())) for s, q in found])
    if kind in ("MAX_REPEAT", "MIN_REPEAT"):
        low, high, body = arg
        s, q = _walk(body)
        if low == 0:
            return (s | {""} if s is not None and high == 1 else None), ("and", ())
        return None, _all(q, _of_strings(s or set()))
    return None, ("and", ())


def trigram_query(regex: str) -> Query:
    """A Boolean query of lower-case trigrams that the folded text of any match meets."""
    strings, query = _walk(list(re._parser.parse(regex)))  # type: ignore[attr-defined]
    return _all(query, _of_strings(strings or set()))


def trigrams(query: Query) -> set[str]:
    return {query[1]} if query[0] == "tri" else set().union(*map(trigrams, query[1]))


def _answer(query: Query, lists: Column) -> Column:
    """Texts of a shard that meet the query, from its map of trigram to list."""
    if query[0] == "tri":
        return F.coalesce(lists[query[1]], F.array().cast("array<long>"))
    parts = [_answer(q, lists) for q in query[1]]
    if query[0] == "or":
        return F.array_distinct(F.flatten(F.array(*parts)))
    return F.aggregate(F.array(*parts[1:]), parts[0], F.array_intersect)


def build_index(docs: DataFrame, grams: list[str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Postings (trigram, shard, texts) for the trigrams asked for; texts are listed by xxhash64. Stored, for any number of queries.

    Texts of one hash share their postings, which can only make more of them candidates.
    """
    shards = max(1, -(-docs.count() // shard_rows))
    folded = docs.select(F.xxhash64("text").alias("h"), lower_ascii(F.coalesce("text", F.lit(""))).alias("t"))
    held = F.filter(F.array(*map(F.lit, grams)), lambda g: F.contains(F.col("t"), g))
    rows = folded.select("h", F.explode(held).alias("trigram")).withColumn("shard", F.pmod("h", F.lit(shards)))
    return stored(rows.groupBy("trigram", "shard").agg(F.collect_set("h").alias("texts")), "postings")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(h, rules): texts whose postings meet the query of a rule, with the kinds of those rules."""
    grams = set().union(*map(trigrams, queries.values()))
    shards = index.where(F.col("trigram").isin(*sorted(grams))).groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "texts"))).alias("lists"))
    found = F.array(*(F.struct(F.lit(k).alias("kind"), _answer(q, F.col("lists")).alias("texts")) for k, q in queries.items()))
    each = shards.select(F.explode(found).alias("f")).select("f.kind", F.explode("f.texts").alias("h"))
    return each.groupBy("h").agg(F.collect_set("kind").alias("rules"))


def spans(text: str, rule: Rule, order: int) -> Column:
    """array of (s, k, e): code points of the rule's matches in the column, found by the lengths of what lies between them.

    The regex goes over a text three times, however many matches it has. An array can't be added to in place, so places
    are summed in blocks of the root of the number of matches: n matches cost the root of n copies each, not n. What
    follows the last match has no match beside it and is left out.
    """
    rx = rule.regex.replace("\\", "\\\\").replace("'", "\\'")
    let = lambda value, name, body: f"element_at(transform(array({value}), {name} -> {body}), 1)"
    nothing = "cast(array() as array<struct<s:int,k:int,e:int>>)"
    match = f"named_struct('s', acc.at + length(x.`0`), 'k', {order}, 'e', acc.at + length(x.`0`) + length(x.`1`))"
    block = f"""aggregate(slice(z, b * w + 1, w), named_struct('at', 0, 'out', {nothing}), (acc, x) -> named_struct('at', acc.at + length(x.`0`) + length(x.`1`),
        'out', if(length(x.`2`) >= {rule.least}, array_append(acc.out, {match}), acc.out)))"""
    starts = "aggregate(blocks, named_struct('at', 0, 'out', cast(array() as array<int>)), (acc, x) -> named_struct('at', acc.at + x.at, 'out', array_append(acc.out, acc.at)), acc -> acc.out)"
    moved = f"flatten(zip_with(blocks, {starts}, (y, at) -> transform(y.out, x -> named_struct('s', x.s + at, 'k', x.k, 'e', x.e + at))))"
    zipped = f"arrays_zip(split({text}, '{rx}', -1), regexp_extract_all({text}, '{rx}', 0), regexp_extract_all({text}, '{rx}', {rule.group}))"
    sql = let(zipped, "z", let("cast(ceil(sqrt(size(z))) as int)", "w", let(f"transform(sequence(0, (size(z) - 1) div w), b -> {block})", "blocks", moved)))
    return F.when(F.col(text).rlike(rule.regex), F.expr(sql)).otherwise(F.expr(nothing))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, base: int = BASE) -> DataFrame:
    """doc_id, n_<kind> of the base rules, base_sha256 and spans of every row of docs.

    Spans read kind:start:end by start, then kind as listed; code points, end exclusive. A null text counts as empty. A
    null doc_id is a value; rows that repeat each other each give their row; other columns of docs are ignored; an empty
    table gives an empty result. Very long texts with very many matches take little more than linear time. Matches of one
    rule never overlap, and two kinds that start at one place come in the order of the rules.
    """
    queries = {r.kind: q for r in rules if (q := trigram_query(r.regex)) != ("and", ())}
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    grams = sorted(set().union(*map(trigrams, queries.values())))
    every = [spans("text", r, i) for i, r in enumerate(rules) if r.kind not in queries] or [F.array().cast("array<struct<s:int,k:int,e:int>>")]
    own = rows.select("doc_id", F.sha2("text", 256).alias("sha"), F.flatten(F.array(*every)).alias("own"))
    if grams:
        found = stored(candidates(build_index(rows, grams), queries), "candidates")
        fetched = join_keyed(rows.withColumn("h", F.xxhash64("text")), found, "h", F.xxhash64(F.lit(3), "doc_id"))
        verified = F.flatten(F.array(*(F.when(F.array_contains("rules", r.kind), spans("text", r, i)).otherwise(F.array()) for i, r in enumerate(rules) if r.kind in queries)))
        verified = fetched.select(F.sha2("text", 256).alias("sha"), verified.alias("more")).where(F.size("more") > 0)
        own = own.join(stored(verified.dropDuplicates(["sha"]), "verified"), "sha", "left")
    else:
        own = own.withColumn("more", F.array())
    found = own.select("doc_id", F.sort_array(F.concat("own", F.coalesce("more", F.expr("cast(array() as array<struct<s:int,k:int,e:int>>)")))).alias("all"))
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    text_of = lambda a: F.array_join(F.transform(a, lambda x: F.concat(F.element_at(kinds, x["k"] + 1), F.lit(":"), x["s"].cast("string"), F.lit(":"), x["e"].cast("string"))), ",")
    number = lambda i: F.size(F.filter("all", lambda x: x["k"] == i)).cast("long")
    count = [number(i).alias(f"n_{r.kind}") for i, r in enumerate(rules[:base])]
    return found.select("doc_id", *count, F.sha2(text_of(F.filter("all", lambda x: x["k"] < base)), 256).alias("base_sha256"), text_of(F.col("all")).alias("spans"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in whole documents; edge cases as at scan()."""
    return scan(documents(spark, sf_dir))


def oracle(rules: tuple[Rule, ...] = RULES, base: int = BASE) -> str:
    """The same by a full scan, in DuckDB. Keywords are spelt out in both cases, since its (?i) folds more than A-Z."""
    both = lambda m: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in m[1])
    parts = []
    for i, r in enumerate(rules):
        rx = re.sub(r"\(\?i:(.*?)\)\)", lambda m: both(m) + ")", r.regex).replace("'", "''")
        parts.append(f"""SELECT r, {i} AS k, '{r.kind}' AS kind, m, g, p, {r.least} AS least FROM (SELECT r, regexp_extract_all(t, '{rx}', 0) AS m, regexp_extract_all(t, '{rx}', {r.group}) AS g, string_split_regex(t, '{rx}') AS p FROM d)""")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in rules[:base])
    say = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
f AS ({" UNION ALL ".join(parts)}),
u AS (SELECT r, k, kind, least, unnest(range(1, len(m) + 1)) AS i, m, g, p FROM f WHERE len(m) > 0),
v AS (SELECT r, k, kind, CAST(coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS BIGINT) AS s, length(m[i]) AS n, length(g[i]) AS c, least FROM u),
w AS (SELECT r, k, kind, s, s + n AS e FROM v WHERE c >= least),
a AS (SELECT r, {counts}, {say} FILTER (k < {base}) AS b, {say} AS spans FROM w GROUP BY r)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in rules[:base])}, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (r)
"""
