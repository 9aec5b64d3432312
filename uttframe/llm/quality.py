"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Rows: each row of the input gives one row. A null text counts as an empty one: no words, so the base rule fails.
Repeated rows are judged alike, and ties do not arise, as rows are judged one by one. Other columns, whatever their names
(but ``quality``, which ``quality`` adds or replaces), are ignored by ``query`` and kept by ``keep_good``. An empty table
gives an empty table. Windows of words are compared by 64-bit hashes within one text, whatever its length; a task holds
the words of one text.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, let

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "au avec ce dans de des du elle en est et il la le les par pas pour qui que sur un une "
    "auf das dem den der die ein eine für im ist mit nicht sich und von zu "
    "con del el es las los no para por se su y"
).split()


class Rule(NamedTuple):
    """A text of min_words or more fails if metric lies outside low to high."""

    name: str
    metric: str
    low: float | None
    high: float | None
    min_words: int = 1


RULES = (
    Rule("length", "n_words", 20, None, 0),
    Rule("word_length", "mean_word_chars", 2.0, 14.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "stop_ratio", 0.01, None, 50),
    Rule("capitals", "capital_ratio", None, 0.4),
    Rule("repeated_lines", "dup_line_ratio", None, 0.5),
    Rule("repeated_words", "repeat_ratio", None, 0.3),
)


def words(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE, -1), "")


def repeated_words(w: Column, k: int = 8) -> Column:
    """How many words of the array lie in a k-word window that occurs twice or more in it."""

    def covered(h: Column) -> Column:
        at = F.array_sort(F.arrays_zip(h.alias("h"), F.sequence(F.lit(0), F.size(h) - 1).alias("i")))
        return let(at, lambda z: F.aggregate(
            F.array_sort(F.transform(
                F.filter(z, lambda x, i: F.coalesce(F.get(z, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(z, i + 1)["h"] == x["h"], F.lit(False))),
                lambda x: x["i"])),
            F.struct(F.lit(-k).alias("last"), F.lit(0).alias("n")),
            lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(k), p - acc["last"])).alias("n")),
            lambda acc: acc["n"],
        ))

    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - k), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))
    hashes = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
    found = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(covered(h)))
    return F.when(F.size(w) <= k, 0).otherwise(found).cast("long")


COUNTS = ("n_words", "word_chars", "n_symbols", "n_capitals", "n_stop_words", "n_lines", "n_dup_lines", "n_repeat_words")
RATIOS = {
    "mean_word_chars": ("word_chars", "n_words"), "symbol_ratio": ("n_symbols", "n_words"), "stop_ratio": ("n_stop_words", "n_words"),
    "capital_ratio": ("n_capitals", "word_chars"), "dup_line_ratio": ("n_dup_lines", "n_lines"), "repeat_ratio": ("n_repeat_words", "n_words"),
}


def counts(text: Column) -> Column:
    """A struct of COUNTS. Words and lines are bound, so each is made once for a text."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD))

    def count(x: Column) -> Column:
        w, n_lines = x["words"], F.size(x["lines"])
        found = [
            F.size(w), F.length(F.array_join(w, "")), F.length(text) - F.length(F.regexp_replace(text, SYMBOLS, "")), F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", "")),
            F.size(F.filter(w, lambda t: F.lower(t).isin(STOP_WORDS))), n_lines, n_lines - F.size(F.array_distinct(x["lines"])), repeated_words(w),
        ]
        return F.struct(*[c.cast("long").alias(k) for k, c in zip(COUNTS, found, strict=True)])

    return let(F.struct(words(text).alias("words"), lines.alias("lines")), count)


def judged(text: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """One expression of the text: a struct of counts, ratios, base_failed, failed_rules (in the table's order) and kept."""

    def broken(m: Column, r: Rule) -> Column:
        out = [m[r.metric] < r.low] if r.low is not None else []
        out += [m[r.metric] > r.high] if r.high is not None else []
        return (m["n_words"] >= r.min_words) & reduce(Column.__or__, out)

    def with_ratios(m: Column) -> Column:
        return F.struct(*[m[k].alias(k) for k in COUNTS], *[(m[a] / F.greatest(m[b], F.lit(1))).alias(k) for k, (a, b) in RATIOS.items()])

    def judge(m: Column) -> Column:
        base = (m["n_words"] < 20) | (100 * m["n_repeat_words"] > 30 * m["n_words"])
        failed = F.filter(F.array(*[F.when(broken(m, r), F.lit(r.name)) for r in rules]), lambda x: x.isNotNull())
        return let(failed, lambda f: F.struct(*[m[k].alias(k) for k in (*COUNTS, *RATIOS)], base.alias("base_failed"), f.alias("failed_rules"), (~base & (F.size(f) == 0)).alias("kept")))

    return let(let(counts(text), with_ratios), judge)


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """docs with the column quality: the struct of judged()."""
    return docs.withColumn("quality", judged(F.col(text_col), rules))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """The rows of docs that pass, with the columns of docs alone."""
    return docs.filter(judged(F.col(text_col), rules)["kept"])


DIGEST = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def query(docs: DataFrame) -> DataFrame:
    return quality(docs.select("doc_id", "text")).select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in DIGEST[1:]])


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
             list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
win AS (SELECT rid, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM w WHERE len(w) >= 8)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1),
cov AS (SELECT rid, sum(least(8, i - p)) AS n FROM (SELECT rid, i, coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), i - 8) AS p FROM rep) GROUP BY rid),
m AS (SELECT w.rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
             (length(t) - length(regexp_replace(t, '\\p{{Lu}}+', '', 'g')))::BIGINT AS n_capitals,
             len(list_filter(w, lambda x: lower(x) IN ({", ".join(f"'{x}'" for x in STOP_WORDS)})))::BIGINT AS n_stop,
             len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(cov.n, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN cov ON w.rid = cov.rid),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT (word_chars / n_words < 2 OR word_chars / n_words > 14 OR n_symbols / n_words > 0.1
         OR (n_words >= 50 AND n_stop / n_words < 0.01) OR n_capitals / greatest(word_chars, 1) > 0.4
         OR n_dup_lines / greatest(n_lines, 1) > 0.5 OR n_repeat_words / n_words > 0.3) AS kept
FROM b
"""
