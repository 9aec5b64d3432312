"""License scans by diagonal voting.

All rolling word k-grams of every text are hashed and joined with the positions of the same hashes in the templates (a
fixed table of this module, so it is broadcast): 5-grams for license texts and notices, 2-grams for the base phrases, which
are shorter. A hit votes for its diagonal, text position minus template position; hits are summed by diagonal, and
neighbouring diagonals are merged. A merged span with votes from ``min_votes`` of its template's k-grams is verified word
by word on its diagonals, and accepted if ``min_score`` of the template's words stand there. Base phrases must be covered
whole on one diagonal.

Texts are lower-cased (A to Z alone); words are runs of ASCII letters and digits and all non-ASCII characters. A null text
counts as an empty one: no words, no labels, score 0. Rows that agree in id and text get equal results, one for each; no
other ties arise, as all accepted spans are kept. Very long texts are rows of many k-grams, which meet only when they hit a
template. An empty table gives an empty table. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import let, materialise, row_key

K_BASE, K = 2, 5
BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_ROWS = 1_000_000

# Phrases that count as a place each, with their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# Opening or notice lines of public licenses, with labels of the method's own.
NOTICES = (
    ("released under the mit license", "mit-notice"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit-text"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3.0"),
    ("either version 2 of the license or at your option any later version", "gpl-2.0-or-later"),
    ("either version 3 of the license or at your option any later version", "gpl-3.0-or-later"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("neither the name of the copyright holder nor the names of its contributors may be used", "bsd-3-clause"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
)
# Whole texts of short public licenses and notices, in words.
TEXTS = (
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages "
        "or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software "
        "or the use or other dealings in the software",
        "mit-full",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties "
        "with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any "
        "special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action "
        "of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc-full",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution this software is provided by the copyright holders and contributors as is "
        "and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular "
        "purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary "
        "or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business "
        "interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd-2-clause-full",
    ),
    (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising "
        "from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to "
        "alter it and redistribute it freely subject to the following restrictions the origin of this software must not be misrepresented you must not "
        "claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be "
        "appreciated but is not required altered source versions must be plainly marked as such and must not be misrepresented as being the original "
        "software this notice may not be removed or altered from any source distribution",
        "zlib-full",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a "
        "copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software "
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the "
        "license for the specific language governing permissions and limitations under the license",
        "apache-2.0-notice",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the "
        "free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it "
        "will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu "
        "general public license for more details",
        "gpl-3.0-or-later-notice",
    ),
)
TEMPLATES = [(i, i < len(PHRASES), label, text) for i, (text, label) in enumerate(PHRASES + NOTICES + TEXTS)]
STARTS = sorted({w for text, _ in PHRASES for w in text.split()[:-1]})  # words that a 2-gram of a base phrase begins with
EVERY = -1  # the template that each text hits once, so that texts without any hit stay


def _gram(words: Column, i: Column, k: int) -> Column:
    return F.xxhash64(F.lit(k), *[F.get(words, i + j) for j in range(k)])


def _places(words: Column, k: int) -> Column:
    return F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))


def templates(spark: SparkSession) -> DataFrame:
    """template, base, label, words and a row for each position t of a k-gram (n_grams of them), with its hash."""
    rows = spark.createDataFrame(TEMPLATES, "template int, base boolean, label string, text string").withColumn("words", F.split("text", " ")).drop("text")
    at = lambda k: F.transform(_places(F.col("words"), k), lambda i: F.struct(i.alias("t"), _gram(F.col("words"), i, k).alias("gram")))
    return rows.withColumn("grams", F.when(F.col("base"), at(K_BASE)).otherwise(at(K))).withColumn("n_grams", F.size("grams")).select("*", F.inline("grams")).drop("grams")


def _words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), ascii_uppercase, ascii_lowercase)
    return F.array_remove(F.split(lower, BREAKS, -1), "")


def _grams(words: Column) -> Column:
    """The k-grams of a text as structs of position and hash, and one for the template EVERY."""
    long = F.transform(_places(words, K), lambda i: F.struct(i.alias("p"), _gram(words, i, K).alias("gram")))
    short = F.filter(_places(words, K_BASE), lambda i: F.get(words, i).isin(STARTS))
    short = F.transform(short, lambda i: F.struct(i.alias("p"), _gram(words, i, K_BASE).alias("gram")))
    every = F.array(F.struct(F.lit(0).alias("p"), F.lit(0).cast("long").alias("gram")))
    return F.struct(F.size(words).cast("long").alias("n"), F.concat(every, short, long).alias("grams"))


def license_scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_votes: float = 0.3, min_score: float = 0.75, near: int = 3) -> DataFrame:
    """A row for each row of docs: its id, n_words, and accepted spans (label, base, first, last, score) in words from 0."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias("_id"), *row_key(F.col(id_col), F.col(text_col)), F.col(text_col).alias("_text"))
    table = templates(spark)
    every = spark.range(1).select(F.lit(EVERY).alias("template"), F.lit(False).alias("base"), F.lit(0).alias("t"), F.lit(0).cast("long").alias("gram"))
    found = docs.select("_id", "key_a", "key_b", let(_words(F.col("_text")), _grams).alias("x"))
    # Outer, though no array is empty: else Spark infers a filter on its size and makes the words twice.
    found = found.select("_id", "key_a", "key_b", F.col("x.n").alias("n_words"), F.explode_outer("x.grams").alias("g"))

    row = ["_id", "key_a", "key_b", "n_words"]
    hits = found.select(*row, "g.p", "g.gram").join(F.broadcast(table.select("template", "base", "t", "gram").unionByName(every)), "gram").withColumn("diagonal", F.col("p") - F.col("t"))
    votes = hits.groupBy(*row, "template", "base", "diagonal").agg(F.count("*").alias("n"), F.collect_set("t").alias("at"))
    by = Window.partitionBy(*row, "template").orderBy("diagonal")
    # A phrase stays on its diagonal; notices may have words put in or left out.
    fresh = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > F.when(F.col("base"), 0).otherwise(near), F.lit(True))
    merged = votes.withColumn("_span", F.sum(F.when(fresh, 1).otherwise(0)).over(by)).groupBy(*row, "template", "base", "_span").agg(
        F.max("n").alias("n"), F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("n_hit"), F.collect_list("diagonal").alias("diagonals"),
        F.min(F.col("diagonal") + F.array_min("at")).alias("first"), F.max(F.col("diagonal") + F.array_max("at")).alias("last"))
    sizes = table.select("template", "label", "words", "n_grams").distinct()
    merged = merged.join(F.broadcast(sizes.select("template", "n_grams")), "template", "left")
    share = F.when(F.col("template") == EVERY, 1.0).otherwise(F.col("n_hit") / F.col("n_grams"))
    merged = materialise(merged.filter(share >= F.when(F.col("base"), 1.0).otherwise(min_votes)), "license-spans")

    # The words of texts with spans to verify are compared with their templates'.
    open_ = merged.filter(~F.col("base") & (F.col("template") != EVERY))
    keys = materialise(open_.select("key_a").distinct(), "license-keys")
    texts = docs.join(F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys, "key_a", "left_semi").dropDuplicates(["key_a", "key_b"]).select("key_a", "key_b", _words(F.col("_text")).alias("_w"))
    there = lambda t: F.exists("diagonals", lambda d: F.coalesce((t + d >= 0) & (F.get("_w", t + d) == F.get("words", t)), F.lit(False)))
    score = F.size(F.filter(F.sequence(F.lit(0), F.size("words") - 1), there)) / F.size("words")
    verified = open_.join(texts, ["key_a", "key_b"]).join(F.broadcast(sizes.select("template", "label", "words")), "template")
    verified = verified.select(*row, "label", "base", "first", (F.col("last") + K - 1).alias("last"), score.alias("score")).filter(F.col("score") >= min_score)

    base = merged.filter("base").join(F.broadcast(sizes.select("template", "label")), "template").select(*row, "label", "base", "first", (F.col("last") + K_BASE - 1).alias("last"), F.lit(1.0).alias("score"))
    kinds = ["label", "base", "first", "last", "score"]
    spans = base.unionByName(verified).withColumn("n", F.lit(None).cast("long"))
    every = merged.filter(F.col("template") == EVERY).select(*row, *[F.lit(None).cast(t).alias(c) for c, t in zip(kinds, ("string", "boolean", "int", "int", "double"), strict=True)], "n")
    whole = every.unionByName(spans).groupBy(*row).agg(F.collect_list(F.when(F.col("label").isNotNull(), F.struct(*kinds))).alias("spans"), F.max("n").alias("_copies"))
    return whole.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_copies"))).select("_id", "n_words", "spans")


def query(docs: DataFrame) -> DataFrame:
    found = license_scan(docs.select("doc_id", "text"))
    base = F.filter("spans", lambda x: x["base"])
    labels = lambda s: F.array_join(F.array_sort(F.array_distinct(F.transform(s, lambda x: x["label"]))), ",")
    return found.select(
        F.col("_id").alias("doc_id"), "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda x: x["first"])).cast("long").alias("first_word"), F.array_max(F.transform(base, lambda x: x["first"])).cast("long").alias("last_word"),
        labels(base).alias("base_labels"), labels(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["score"])), F.lit(0.0)).alias("score"),
    )


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{ascii_uppercase}', '{ascii_lowercase}'), '{BREAKS}'), lambda x: x <> '') AS w FROM documents),
tw AS (SELECT template, base, label, string_split(txt, ' ') AS words, CASE WHEN base THEN {K_BASE} ELSE {K} END AS k FROM (VALUES {", ".join(f"({i}, {str(b).lower()}, '{label}', '{text}')" for i, b, label, text in TEMPLATES)}) v(template, base, label, txt)),
tg AS (SELECT template, base, k, len(words) - k + 1 AS n_grams, t, array_to_string(words[t + 1:t + k], ' ') AS gram FROM (SELECT *, unnest(range(0, len(words) - k + 1)) AS t FROM tw)),
dg AS (SELECT rid, {K_BASE} AS k, p, array_to_string(w[p + 1:p + {K_BASE}], ' ') AS gram FROM (SELECT rid, w, unnest(range(0, len(w) - {K_BASE} + 1)) AS p FROM d WHERE len(w) >= {K_BASE})
  UNION ALL SELECT rid, {K} AS k, p, array_to_string(w[p + 1:p + {K}], ' ') AS gram FROM (SELECT rid, w, unnest(range(0, len(w) - {K} + 1)) AS p FROM d WHERE len(w) >= {K})),
hits AS (SELECT rid, template, base, n_grams, p - t AS diagonal, t FROM dg JOIN tg USING (k, gram)),
diag AS (SELECT rid, template, base, n_grams, diagonal, min(t) AS t0, max(t) AS t1 FROM hits GROUP BY ALL),
marked AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER w > CASE WHEN base THEN 0 ELSE 3 END OR lag(diagonal) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM diag WINDOW w AS (PARTITION BY rid, template ORDER BY diagonal)),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY rid, template ORDER BY diagonal ROWS UNBOUNDED PRECEDING) AS span FROM marked),
share AS (SELECT rid, template, span, count(DISTINCT t) AS n_hit FROM hits JOIN numbered USING (rid, template, diagonal) GROUP BY ALL),
merged AS (SELECT rid, template, base, span, min(diagonal + t0) AS first FROM numbered JOIN share USING (rid, template, span) GROUP BY rid, template, base, span, n_hit, n_grams HAVING n_hit / n_grams >= CASE WHEN base THEN 1.0 ELSE 0.3 END),
cand AS (SELECT rid, template, span, diagonal, unnest(range(0, len(words))) AS t, words FROM merged JOIN numbered USING (rid, template, span) JOIN tw USING (template) WHERE NOT merged.base),
verified AS (SELECT rid, template, span, count(DISTINCT t) / max(len(words)) AS score FROM cand JOIN d USING (rid) WHERE t + diagonal >= 0 AND w[t + diagonal + 1] = words[t + 1] GROUP BY rid, template, span HAVING count(DISTINCT t) / max(len(words)) >= 0.75),
spans AS (SELECT rid, label, tw.base, first, 1.0 AS score FROM merged JOIN tw USING (template) WHERE tw.base UNION ALL SELECT rid, label, false, NULL, score FROM verified JOIN tw USING (template)),
per AS (SELECT rid, count(*) FILTER (WHERE base) AS n_base, min(first) AS first_word, max(first) AS last_word, array_to_string(list_sort(list(DISTINCT label) FILTER (WHERE base)), ',') AS base_labels, array_to_string(list_sort(list(DISTINCT label)), ',') AS labels, max(score) AS score FROM spans GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM d LEFT JOIN per USING (rid)
"""
