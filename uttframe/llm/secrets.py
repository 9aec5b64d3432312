"""Secret scans with corpus-wide ownership frequency.

Three kinds of candidates are found in whole texts with their code point spans. The hash of each candidate's value is then
counted over the corpus by distinct repositories and by distinct owners, each by itself and in two steps, so that one value
in a third of all rows is pre-aggregated. A value with ``copied_owners`` owners or more, or ``copied_repos`` repositories,
is an example that people copy; one that a single owner holds and that looks random is taken for a live credential. Both
verdicts are added as spans of the value (kinds live and example); the base spans stay.

A null text counts as an empty one. A null owner or repository counts as one owner or repository of its own. Rows that
agree in repository, owner and text are one occurrence, and each gets its row of the result. Spans that start together
are ordered by kind; no other ties arise. Very long texts are scanned whole, by one pattern after another. An empty table
gives an empty table. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, let, materialise, row_key, spread_join

# Kinds in order of rank, with pattern, the group that holds the value, and its least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),  # runs are maximal either way
)
VERDICTS = ("live", "example")
PLACEHOLDER = r"(?i)example|sample|dummy|changeme|placeholder|your|xxxx|0000|1234567"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string,value:string>>"


def spans(text: Column, rank: int) -> Column:
    """The matches of a kind as structs in order: the gaps between matches and the matches' lengths give the positions."""
    kind, pattern, group, least = KINDS[rank]
    parts = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("all"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("values"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gaps"])
        end = start + F.length(x["all"])
        one = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end"), F.lit(kind).alias("kind"), x["values"].alias("value")))
        return F.struct(end.alias("at"), F.when(F.length(x["values"]) >= least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    none = F.array().cast(SPAN)
    found = let(parts, lambda p: F.aggregate(
        F.filter(F.arrays_zip(p["gaps"].alias("gaps"), p["all"].alias("all"), p["values"].alias("values")), lambda x: x["all"].isNotNull()),
        F.struct(F.lit(0).alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
    return F.when(text.rlike(pattern), found).otherwise(none)


def looks_random(value: Column) -> Column:
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(PLACEHOLDER) & (F.size(F.array_distinct(F.regexp_extract_all(value, F.lit("(?s)."), F.lit(0)))) >= 8)


def scan(docs: DataFrame, repo: str, owner: str, text_col: str = "text") -> DataFrame:
    """_repo, _owner, the row's key and its base spans: start, rank, end, kind, hash of the value, its start, and whether it looks random."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    raw = docs.select(F.col(repo).alias("_repo"), F.col(owner).alias("_owner"), *row_key(F.col(repo), F.col(owner), F.col(text_col)), *[spans(text, i).alias(f"_{i}") for i in range(len(KINDS))])
    found = F.array_sort(F.concat(*[F.col(f"_{i}") for i in range(len(KINDS))]))
    return raw.select("_repo", "_owner", "key_a", "key_b", F.transform(found, lambda x: F.struct(
        x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"),
        F.sha2(x["value"], 256).alias("hash"), (x["end"] - F.length(x["value"])).alias("from"), looks_random(x["value"]).alias("random"))).alias("base"))


def ownership(found: DataFrame) -> DataFrame:
    """hash, n_repos, n_owners over the corpus."""
    each = found.filter(F.size("base") > 0).select("_repo", "_owner", F.explode(F.array_distinct(F.transform("base", lambda x: x["hash"]))).alias("hash"))
    holders = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("name")) for kind, c in (("repo", "_repo"), ("owner", "_owner"))])
    distinct = each.select("hash", F.explode(holders).alias("x")).select("hash", "x.kind", "x.name").distinct()
    n = {kind: F.count_if(F.col("kind") == kind).alias(f"n_{kind}s") for kind in ("repo", "owner")}
    return distinct.groupBy("hash").agg(n["repo"], n["owner"])


def secret_scan(docs: DataFrame, *, repo: str = "doc_id", owner: str = "source", text_col: str = "text", copied_owners: int = 3, copied_repos: int = 10) -> DataFrame:
    """A row for each row of docs: _repo, _owner, base and added (structs of start, rank, end, kind)."""
    found = materialise(scan(docs, repo, owner, text_col), "secrets")
    copied = (F.col("n_owners") >= copied_owners) | (F.col("n_repos") >= copied_repos)
    values = found.filter(F.size("base") > 0).select("key_a", "key_b", F.explode("base").alias("x")).select("key_a", "key_b", "x.hash", "x.random").distinct()
    owned = materialise(ownership(found), "secrets-owned")
    held = owned.agg(F.coalesce(F.sum("n_repos"), F.lit(0))).first()[0]
    many = owned.filter(F.col("n_repos") > max(1_000, held // HOT_KEYS)).select("hash")
    judged = spread_join(values, owned, ["hash"], many, F.col("key_a")).withColumn("verdict", F.when(copied, "example").when((F.col("n_owners") == 1) & F.col("random"), "live"))
    by_row = judged.filter("verdict IS NOT NULL").groupBy("key_a", "key_b").agg(F.map_from_entries(F.collect_list(F.struct("hash", "verdict"))).alias("verdicts"))
    rank = lambda v: F.when(v == "live", len(KINDS)).otherwise(len(KINDS) + 1)
    base = F.transform("base", lambda x: F.struct(x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")))
    added = F.transform(
        F.filter("base", lambda x: F.try_element_at("verdicts", x["hash"]).isNotNull()),
        lambda x: let(F.try_element_at("verdicts", x["hash"]), lambda v: F.struct(x["from"].alias("start"), rank(v).alias("rank"), x["end"].alias("end"), v.alias("kind"))))
    out = found.join(by_row, ["key_a", "key_b"], "left")
    return out.select("_repo", "_owner", base.alias("base"), F.coalesce(F.array_distinct(added), F.array().cast("array<struct<start:int,rank:int,end:int,kind:string>>")).alias("added"))


def joined(found: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(found), lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def query(docs: DataFrame) -> DataFrame:
    out = secret_scan(docs.select("doc_id", "source", "text"))
    n = lambda col, kind: F.size(F.filter(col, lambda x: x["kind"] == kind)).cast("long")
    return out.select(
        F.col("_repo").alias("doc_id"), *[n("base", k[0]).alias(f"n_{k[0]}") for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.concat("base", "added")).alias("spans"), *[n("added", v).alias(f"n_{v}") for v in VERDICTS],
    )


def _kind_sql(rank: int) -> str:
    kind, pattern, group, least = KINDS[rank]
    p = pattern.replace("'", "''")
    return f"""SELECT rid, {rank} AS rank, '{kind}' AS kind, s + len(m) - len(v) AS from_, s AS start, s + len(m) AS "end", v
      FROM (SELECT rid, m[i] AS m, v[i] AS v, (list_sum(list_transform(g[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0))::INT AS s
        FROM (SELECT rid, g, m, v, unnest(range(1, len(m) + 1)) AS i
          FROM (SELECT rid, string_split_regex(t, '{p}') AS g, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', {group}) AS v FROM d WHERE regexp_matches(t, '{p}')))) WHERE len(v) >= {least}"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
base AS ({" UNION ALL ".join(_kind_sql(i) for i in range(len(KINDS)))}),
own AS (SELECT v, count(DISTINCT coalesce(doc_id::VARCHAR, '<null>')) AS n_repos, count(DISTINCT coalesce(source, '<null>')) AS n_owners FROM base JOIN d USING (rid) GROUP BY v),
judged AS (SELECT base.*, CASE WHEN n_owners >= 3 OR n_repos >= 10 THEN 'example'
    WHEN n_owners = 1 AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND NOT regexp_matches(v, '{PLACEHOLDER}') AND len(list_distinct(string_split(v, ''))) >= 8 THEN 'live' END AS verdict
  FROM base JOIN own USING (v)),
added AS (SELECT DISTINCT rid, from_ AS start, CASE verdict WHEN 'live' THEN {len(KINDS)} ELSE {len(KINDS) + 1} END AS rank, "end", verdict AS kind FROM judged WHERE verdict IS NOT NULL),
per AS (SELECT rid, {", ".join(f"count(*) FILTER (WHERE kind = '{k[0]}') AS n_{k[0]}" for k in KINDS)}, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank, "end") AS base FROM base GROUP BY rid),
every AS (SELECT rid, string_agg(kind || ':' || start || ':' || "end", ',' ORDER BY start, rank, "end") AS spans, {", ".join(f"count(*) FILTER (WHERE kind = '{v}') AS n_{v}" for v in VERDICTS)}
  FROM (SELECT rid, start, rank, "end", kind FROM base UNION ALL SELECT * FROM added) GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k[0]}, 0)::BIGINT AS n_{k[0]}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, {", ".join(f"coalesce(n_{v}, 0)::BIGINT AS n_{v}" for v in VERDICTS)}
FROM d LEFT JOIN per USING (rid) LEFT JOIN every USING (rid)
"""
