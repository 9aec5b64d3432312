"""Line dedup by a log-template tree of fixed depth, in built-in functions alone.

A line's way through the tree is its token count and then its first ``depth`` tokens, where a token with a digit counts as
a field. Where a leaf recurs in ``min_docs`` different texts, each further position whose most frequent token is in at
least ``share`` of the leaf's lines is constant, and the other positions are fields. A line that agrees with a leaf's
constants (at least half of its tokens) has the leaf's template; another line has the template of its own tokens with
fields masked. Lines whose template recurs in ``min_docs`` different texts are dropped.

Lines end at \\n. A line of fewer than ``min_tokens`` tokens has all its tokens on its way, and its template must recur in
``short_docs`` texts, as short phrases of prose recur by chance; lines without tokens are never dropped. Texts that are equal count as one text, so
a copied document keeps its lines; rows of a text with very many copies are dealt to several tasks. A null text has no
lines. Repeated rows are treated alike, a row of the result for each. Ties do not arise: a constant's share is over half.
Very long texts are rows of many lines, each counted by itself; of a dropped line only its number comes back to the text.
An empty table gives an empty table. Other columns, whatever their names, are ignored by ``query`` and kept by
``drop_templates``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT_KEYS, materialise, row_hash, row_key, spread_join

SPACE = r"[\x20\x09-\x0D]+"
FIELD = "<*>"
EMPTY = 0  # the leaf of lines without tokens
#: So many leaves or templates (8 bytes each) are sent to all tasks; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _masked(token: Column) -> Column:
    return F.when(token.rlike("[0-9]"), FIELD).otherwise(token)


def _key(text_col: str) -> Column:
    """A text's key: two hashes, so that texts are told apart at any size of the corpus."""
    return F.struct(*row_key(F.col(text_col))).alias("doc")


def _meet(rows: DataFrame, keys: DataFrame, gone: DataFrame) -> DataFrame:
    """rows with the dropped lines of their texts; keys has the rows' keys alone."""
    counts = keys.groupBy("doc").agg(F.count("*").alias("m"))
    n = keys.count()
    return spread_join(rows, gone, ["doc"], counts.filter(F.col("m") > max(1_000, n // HOT_KEYS)), F.col("_by"), "left").drop("_by")


def _in(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """The rows whose key is among keys, a materialised table of distinct keys."""
    return rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, on, "left_semi")


def _recurring(lines: DataFrame, key: str, min_docs: int, short_docs: int) -> DataFrame:
    """Keys found in min_docs texts or more (short_docs for short lines): pairs are counted first, so that a frequent key is no hot group."""
    pairs = lines.groupBy(key, "doc").agg(F.max("short").alias("short"))
    least = F.when(F.col("short"), short_docs).otherwise(min_docs)
    return pairs.groupBy(key).agg(F.count("*").alias("n"), F.max(key).alias("k"), F.max("short").alias("short")).filter((F.col("n") >= least) & (F.col("k") != EMPTY)).select(key)


def dropped_lines(docs: DataFrame, text_col: str = "text", *, depth: int = 3, min_tokens: int = 5, min_docs: int = 10, share: float = 0.6, short_docs: int = 40) -> DataFrame:
    """doc (key of the text) and the sorted numbers of its dropped lines, from 0, for texts that have any."""
    text = docs.select(_key(text_col), F.col(text_col).alias("_text")).filter("_text IS NOT NULL")
    lines = text.select("doc", F.posexplode_outer(F.split("_text", "\n", -1)).alias("pos", "line")).select("doc", "pos", F.array_remove(F.split("line", SPACE, -1), "").alias("w"))
    # Outer, though no array is empty, and no filter on the tokens: either filter would be pushed down, as a second split.
    leaf = F.when(F.size("w") >= min_tokens, F.xxhash64(F.size("w"), *[_masked(F.get("w", F.lit(i))) for i in range(depth)]))
    leaf = leaf.when(F.size("w") > 0, F.xxhash64(F.size("w"), F.lit("short"), F.transform("w", _masked))).otherwise(F.lit(EMPTY).cast("long"))
    lines = lines.withColumns({"leaf": leaf, "short": F.coalesce(F.size("w") < min_tokens, F.lit(True))})

    leaves = materialise(_recurring(lines.select("leaf", "doc", "short"), "leaf", min_docs, short_docs), "log-leaves")
    hot = materialise(_in(lines, leaves, "leaf").dropDuplicates(["doc", "pos"]), "log-lines")

    # Lines are summed by leaf, position and token; only sums meet.
    tokens = hot.select("leaf", F.size("w").alias("n"), F.posexplode(F.transform("w", lambda t: F.xxhash64(_masked(t)))).alias("i", "token"))
    best = tokens.groupBy("leaf", "n", "i", "token").agg(F.count("*").alias("c")).groupBy("leaf", "n", "i").agg(F.max(F.struct("c", "token")).alias("top"), F.sum("c").alias("all"))
    sums = best.groupBy("leaf", "n").agg(F.collect_list(F.when(F.col("top.c") >= share * F.col("all"), F.struct("i", F.col("top.token").alias("token")))).alias("fixed"), F.max("all").alias("lines"))
    sums = materialise(sums.withColumn("fixed", F.when(F.size("fixed") * 2 >= F.col("n"), F.col("fixed"))), "log-sums")
    total = sums.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    common_leaves = sums.filter(F.col("lines") > max(1_000, total // HOT_KEYS)).select("leaf")
    fixed = sums.filter("fixed IS NOT NULL").select("leaf", "fixed")

    agrees = F.forall("fixed", lambda x: F.xxhash64(_masked(F.get("w", x["i"]))) == x["token"])
    own = F.xxhash64(F.lit("line"), F.transform("w", _masked))
    named = materialise(spread_join(hot, fixed, ["leaf"], common_leaves, F.xxhash64("doc", "pos"), "left").select("doc", "pos", "short", F.when(agrees, F.col("leaf")).otherwise(own).alias("template")), "log-templates")
    common = materialise(_recurring(named, "template", min_docs, short_docs), "log-common")
    return _in(named, common, "template").groupBy("doc").agg(F.array_sort(F.collect_list("pos")).alias("dropped"))


def drop_templates(docs: DataFrame, text_col: str = "text", **options: float) -> DataFrame:
    """docs with the lines of recurring templates taken out of their texts."""
    gone = dropped_lines(docs, text_col, **options)
    keys = materialise(docs.select(_key(text_col)), "log-keys")
    row = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("_row"), _key(text_col), F.col(text_col).alias("_text"), row_hash(docs).alias("_by"))
    row = _meet(row, keys, gone)
    kept = F.array_join(F.filter(F.split("_text", "\n", -1), lambda x, i: ~F.array_contains("dropped", i)), "\n")
    return row.select(F.col("_row").withField(text_col, F.when(F.col("dropped").isNull(), F.col("_text")).otherwise(kept)).alias("_row")).select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, and the numbers of the dropped lines."""
    docs = docs.select("doc_id", "text")
    rows = materialise(docs.select("doc_id", _key("text"), F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)).cast("long").alias("n_lines")), "log-rows")
    out = _meet(rows.withColumn("_by", F.col("doc_id")), rows.select("doc"), dropped_lines(docs))
    return out.select("doc_id", "n_lines", F.coalesce(F.size("dropped"), F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(F.array_join("dropped", ","), F.lit("")).alias("dropped_lines"))


ORACLE = """
WITH t AS (SELECT text, row_number() OVER () AS doc FROM (SELECT DISTINCT text FROM documents WHERE text IS NOT NULL)),
l AS (SELECT doc, unnest(range(len(x))) AS pos, unnest(x) AS line FROM (SELECT doc, string_split(text, chr(10)) AS x FROM t)),
w AS (SELECT doc, pos, list_transform(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> ''), lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '<*>' ELSE x END) AS w FROM l),
k AS (SELECT *, len(w) < 5 AS short, CASE WHEN len(w) < 5 THEN 0 ELSE len(w) END || ' ' || array_to_string(CASE WHEN len(w) < 5 THEN w ELSE w[1:3] END, ' ') AS leaf FROM w WHERE len(w) > 0),
hot AS (SELECT * FROM k WHERE leaf IN (SELECT leaf FROM k GROUP BY leaf HAVING count(DISTINCT doc) >= CASE WHEN bool_or(short) THEN 40 ELSE 10 END)),
n AS (SELECT leaf, len(w) AS n, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS token FROM hot),
c AS (SELECT leaf, n, i, token, count(*) AS c, sum(count(*)) OVER (PARTITION BY leaf, n, i) AS every FROM n GROUP BY leaf, n, i, token),
fixed AS (SELECT leaf, list({'i': i, 'token': token}) AS fixed FROM c WHERE c >= 0.6 * every GROUP BY leaf, n HAVING count(*) * 2 >= n),
named AS (SELECT doc, pos, short, CASE WHEN fixed IS NOT NULL AND len(list_filter(fixed, lambda f: w[f.i] <> f.token)) = 0 THEN 'leaf ' || leaf ELSE 'line ' || array_to_string(w, ' ') END AS template FROM hot LEFT JOIN fixed USING (leaf)),
gone AS (SELECT doc, list(pos ORDER BY pos) AS dropped FROM named WHERE template IN (SELECT template FROM named GROUP BY template HAVING count(DISTINCT doc) >= CASE WHEN bool_or(short) THEN 40 ELSE 10 END) GROUP BY doc)
SELECT doc_id, coalesce(len(string_split(d.text, chr(10))), 0)::BIGINT AS n_lines, coalesce(len(dropped), 0)::BIGINT AS n_dropped, coalesce(array_to_string(dropped, ','), '') AS dropped_lines
FROM documents d LEFT JOIN t ON d.text = t.text LEFT JOIN gone USING (doc)
"""
