"""Queries over documents and benchmark texts: filters, cleaning, vocabularies, rare words, languages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stage import materialise
from ..operators import batching, bias, filters, language, ranking, scoring, vocab
from .base import Tables, query
from .pipeline import build_pipeline

WORDS = "list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')"
REASON = """CASE WHEN f < 300 THEN 'minlen' WHEN f > 5000 THEN 'maxlen' WHEN n < 1 THEN 'lbl_minlen' WHEN n > 800 THEN 'lbl_maxlen'
                 WHEN n / nullif(f, 0) < 0.0005 THEN 'min_ratio' WHEN n / nullif(f, 0) > 0.2 THEN 'max_ratio' ELSE 'ok' END"""
BOUNDS = filters.Bounds(max_length=5000, min_length=300, token_max_length=800, max_output_input_ratio=0.2)


def _n_words() -> F.Column:
    return T.count_words(F.col("text"))


@query(f"SELECT lang, {REASON} AS reason, count(*) AS n FROM (SELECT lang, n_chars AS f, len({WORDS}) AS n FROM documents) GROUP BY ALL")
def utt_filter_reasons(t: Tables) -> DataFrame:
    return filters.reasons(t.documents, filters.length_reason(F.col("n_chars"), _n_words(), BOUNDS), "lang")


@query(f"SELECT doc_id FROM (SELECT doc_id, n_chars AS f, len({WORDS}) AS n FROM documents) WHERE {REASON} = 'ok'")
def utt_filter(t: Tables) -> DataFrame:
    return filters.length_filter(t.documents, F.col("n_chars"), _n_words(), BOUNDS).select("doc_id")


@query(f"""SELECT source, coalesce(CASE WHEN s <= 1 THEN CASE WHEN n / s > 5 THEN 'reject_1' END WHEN s <= 2 THEN CASE WHEN n / s > 8 THEN 'reject_2' END
    WHEN s <= 5 THEN CASE WHEN n / s > 6 THEN 'reject_5' END WHEN n / s > 5 THEN 'reject_9' END, 'ok') AS reason, count(*) AS n
    FROM (SELECT source, n_chars / 32.0 AS s, len({WORDS}) AS n FROM documents) GROUP BY ALL""")
def speech_rate_filter(t: Tables) -> DataFrame:
    return filters.reasons(t.documents, filters.speech_rate_reason(F.col("text"), F.col("n_chars") / 32.0), "source")


@query(f"SELECT {WORDS}[1] AS word, count(*) AS n, sum(n_chars / 5.0) AS seconds FROM documents WHERE len({WORDS}) = 1 AND n_chars / 5.0 >= 1 GROUP BY ALL")
def single_word_tally(t: Tables) -> DataFrame:
    return filters.single_word_tally(t.documents, F.col("text"), F.col("n_chars") / 5.0, too_long=1)


@query("SELECT d.source, count(*) AS n FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1) GROUP BY ALL")
def exclude_keys(t: Tables) -> DataFrame:
    return filters.exclude(t.documents, t.labels.filter("toxic = 1"), "doc_id").groupBy("source").agg(F.count("*").alias("n"))


def _tagged(t: Tables) -> DataFrame:
    """documents with a switch mark after each eleventh word."""
    words = F.transform(T.split_words(F.col("text")), lambda w, i: F.when(i % 11 == 10, F.concat(w, F.lit(" <sw>"))).otherwise(w))
    return t.documents.select("doc_id", F.array_join(words, " ").alias("txt"))


TAGGED = f"SELECT doc_id, array_to_string(list_transform({WORDS}, lambda w, i: CASE WHEN i % 11 = 0 THEN w || ' <sw>' ELSE w END), ' ') AS txt FROM documents"
CLEAN = filters.SpecialTokens(reject_on=("inesea",), remove=("<sw>", "of"), relabel=(("und", "and"), ("les", "the")), remove_trailing_dash=True)


@query(f"""WITH t AS ({TAGGED}), w AS (SELECT doc_id, list_transform(string_split(txt, ' '), lambda x: regexp_replace(x, '-$', '')) AS w FROM t),
    k AS (SELECT doc_id, array_to_string(list_transform(list_filter(w, lambda x: x NOT IN ('<sw>', 'of')), lambda x: CASE x WHEN 'und' THEN 'and' WHEN 'les' THEN 'the' ELSE x END), ' ') AS txt FROM w WHERE NOT list_contains(w, 'inesea'))
    SELECT doc_id, md5(txt) AS digest, length(txt) AS n FROM k WHERE txt <> ''""")
def special_tokens_clean(t: Tables) -> DataFrame:
    return filters.special_tokens(_tagged(t), CLEAN).select("doc_id", F.md5("txt").alias("digest"), F.length("txt").cast("long").alias("n"))


@query(f"SELECT doc_id FROM ({TAGGED}) WHERE NOT contains(txt, '<sw>')")
def skip_tagged(t: Tables) -> DataFrame:
    return filters.skip_tagged(_tagged(t), F.col("txt"), F.col("doc_id"), p=1.0).select("doc_id")


@query(f"SELECT doc_id, md5(replace(trim(replace(replace(txt, '<sw>', ''), '  ', ' ')), '<unk>', '<unknown>')) AS digest FROM ({TAGGED})")
def subword_clean(t: Tables) -> DataFrame:
    return _tagged(t).select("doc_id", F.md5(T.clean_for_subword(F.col("txt"))).alias("digest"))


@query(f"SELECT word, count(*) AS freq FROM (SELECT unnest({WORDS}) AS word FROM documents) WHERE regexp_matches(word, '^\\p{{L}}+$') GROUP BY word HAVING count(*) <= 20")
def rare_words(t: Tables) -> DataFrame:
    return bias.rare_counts(bias.word_counts(t.documents, "text"))


@query()
def bias_phrases(t: Tables) -> DataFrame:
    counts = materialise(bias.word_counts(t.documents, "text"), "word-counts")
    return bias.bias_phrases(t.documents.select(F.col("doc_id").alias("key"), F.col("text").alias("txt")), bias.rare_words(counts, 3), common=bias.common_words(counts, 3))


@query()
def bias_lists(t: Tables) -> DataFrame:
    rows = bias_phrases(t).join(t.documents.select(F.col("doc_id").alias("key"), F.floor(F.col("doc_id") / 16).alias("batch")), "key")
    return bias.bias_list(rows, "batch", epoch=2, max_epoch=9)


VOCAB = {"<unk>": 1, T.SPACE: 2} | {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz", 3)}
IDS = "list_transform(string_split(trim(lower(text)), ''), lambda c: CASE WHEN c = ' ' THEN 2 WHEN c >= 'a' AND c <= 'z' AND length(c) = 1 AND ascii(c) < 128 THEN ascii(c) - 94 ELSE 1 END)"


@query(f"SELECT item_id, {IDS} AS ids, trim(array_to_string(list_transform({IDS}, lambda i: CASE i WHEN 1 THEN '<unk>' WHEN 2 THEN ' ' ELSE chr(i + 94) END), '')) AS back FROM benchmark")
def vocab_encode(t: Tables) -> DataFrame:
    rows = t.benchmark.select("item_id", vocab.encode(T.char_tokens(F.lower("text")), VOCAB).alias("ids"))
    return rows.withColumn("back", T.detokenize(vocab.decode(F.col("ids"), VOCAB)))


@query(f"""WITH v AS (SELECT w AS token, row_number() OVER (ORDER BY c DESC, w) AS id FROM (SELECT w, count(*) AS c FROM (SELECT unnest({WORDS}) AS w FROM benchmark) GROUP BY w))
    SELECT item_id, list(coalesce(CASE WHEN id <= 500 THEN id END, 1)::INT ORDER BY i) AS ids FROM (SELECT item_id, unnest({WORDS}) AS w, generate_subscripts({WORDS}, 1) AS i FROM benchmark) b LEFT JOIN v ON b.w = v.token GROUP BY item_id""")
def vocab_encode_join(t: Tables) -> DataFrame:
    counts = bias.word_counts(t.benchmark, "text")
    top = counts.orderBy(F.desc("freq"), "word").limit(500).groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("f"), "word"))).alias("x")).select(F.posexplode("x"))
    table = top.select(F.col("col.word").alias("token"), (F.col("pos") + 1).cast("int").alias("id"))
    unknown = t.spark.range(1).select(F.lit("<unk>").alias("token"), F.lit(1).alias("id"))
    return vocab.encode_join(t.benchmark.withColumn("w", T.split_words(F.col("text"))), "item_id", "w", table.unionByName(unknown))


@query("SELECT doc_id, [CASE WHEN lang = l THEN 0.5 ELSE 0.0 END FOR l IN ['de', 'en', 'es', 'fr']] || [0.5] AS vec FROM documents")
def one_hot_lang(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", filters.category_vector(F.col("lang"), {"de": 0, "en": 1, "es": 2, "fr": 3}, 5, force=(4,)).alias("vec"))


@query("SELECT doc_id, source || '.' || lang AS job, source || '.' || lang || '.' || doc_id AS speaker FROM documents")
def key_parts(t: Tables) -> DataFrame:
    key = F.concat_ws(".", "source", "lang", F.concat("doc_id", F.lit("-007")))
    return t.documents.select("doc_id", T.job_id(key).alias("job"), T.speaker_of(key).alias("speaker"))


@query("""SELECT page_id, regexp_replace(url, '\\.[^./]*$', '') || '.log.json' AS log, page_id % 3 <> 0 AS has_ref FROM pages""")
def ref_hyp_pairs(t: Tables) -> DataFrame:
    s = scoring.stem(F.col("url"))
    hyps = t.pages.select("page_id", F.concat(s, F.format_string("#%d.ctm", "page_id")).alias("path"))
    refs = t.pages.filter("page_id % 3 <> 0").select(F.concat(s, F.format_string("#%d.nlp", "page_id")).alias("path"))
    out = scoring.pair(hyps, refs)
    return out.select(F.regexp_extract("hyp", r"#(\d+)\.ctm$", 1).cast("long").alias("page_id"), F.regexp_replace("log", r"#\d+\.log", ".log").alias("log"), "has_ref")


def _hypotheses(t: Tables) -> DataFrame:
    """benchmark as references; hypotheses lack each seventh word and have each eleventh replaced."""
    ref = T.split_words(F.col("text"))
    marked = F.transform(ref, lambda w, i: F.when(i % 7 == 6, F.lit(None)).when(i % 11 == 10, F.lit("0")).otherwise(w))
    return t.benchmark.select("item_id", ref.alias("ref"), F.filter(marked, lambda w: w.isNotNull()).alias("hyp"))


COUNTS = f"""SELECT item_id, n - n // 7 - (n // 11 - n // 77) AS correct, n // 11 - n // 77 AS substitutions, n // 7 AS deletions, 0 AS insertions, n // 7 + n // 11 - n // 77 AS num_errors, n AS num_ref
    FROM (SELECT item_id, len({WORDS}) AS n FROM benchmark)"""


@query(COUNTS)
def wer_align(t: Tables) -> DataFrame:
    return scoring.align(_hypotheses(t), "item_id", "ref", "hyp")


READINGS = f"""SELECT item_id, n - m5 + m3 + m1 AS correct, m5 AS substitutions, 0::BIGINT AS deletions, 0::BIGINT AS insertions, m5 AS num_errors, n + m3 + m1 AS num_ref FROM (
    SELECT item_id, count(*) AS n, count(*) FILTER (WHERE i % 7 = 3) AS m3, count(*) FILTER (WHERE i % 7 = 5) AS m5, count(*) FILTER (WHERE i % 5 = 1) AS m1
    FROM (SELECT item_id, unnest(range(len({WORDS}))) AS i FROM benchmark) GROUP BY item_id)"""


@query(READINGS)
def wer_readings(t: Tables) -> DataFrame:
    """References with "going to" before some words, which a rule reads as "gonna", and words with a reading of two words of their own; some words are wrong."""
    w = T.split_words(F.col("text"))
    ref = F.flatten(F.transform(w, lambda x, i: F.when(i % 5 == 1, F.array(F.lit("going"), F.lit("to"), x)).otherwise(F.array(x))))
    gonna = lambda x, i: F.when(i % 5 == 1, F.concat(F.array(F.lit("gonna")), x)).otherwise(x)
    hyp = F.flatten(F.transform(w, lambda x, i: gonna(F.when(i % 7 == 3, F.array(F.concat(F.lit("1-"), x), F.lit("2-"))).when(i % 7 == 5, F.array(F.lit("wrong-"))).otherwise(F.array(x)), i)))
    # Word i of the text is behind two more words for each of the i + 4 div 5 places up to it.
    at = lambda i: i + 2 * F.floor((i + 4) / 5)
    own = F.filter(F.transform(w, lambda x, i: F.when(i % 7 == 3, F.struct(at(i).alias("start"), (at(i) + 1).alias("end"), F.array(F.concat(F.lit("1-"), x), F.lit("2-")).alias("words")))), lambda x: x.isNotNull())
    rows = t.benchmark.select("item_id", ref.alias("ref"), hyp.alias("hyp"), own.alias("own"))
    return scoring.align_readings(rows, "item_id", "ref", "hyp", [(("going", "to"), ("gonna",))], "own")


@query(f"SELECT item_id, num_errors AS distance FROM ({COUNTS})")
def wer_distance(t: Tables) -> DataFrame:
    return _hypotheses(t).select("item_id", scoring.distance(F.col("ref"), F.col("hyp")).cast("long").alias("distance"))


@query(f"SELECT sum(insertions) AS insertions, sum(deletions) AS deletions, sum(substitutions) AS substitutions, sum(correct) AS correct, sum(num_ref) AS num_ref, 0.0 AS ins_rate, sum(deletions) / sum(num_ref) AS del_rate, sum(substitutions) / sum(num_ref) AS sub_rate, sum(num_errors) / sum(num_ref) AS wer FROM ({COUNTS})")
def wer_micro(t: Tables) -> DataFrame:
    return scoring.word_error_rate(wer_align(t))


@query()
def lang_id(t: Tables) -> DataFrame:
    model = language.train(t.documents, "text", "lang")
    return language.detect(t.documents, model, "doc_id", "text").select("doc_id", "language")


@query("""WITH RECURSIVE r AS (SELECT source, doc_id, n_chars, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents),
    f AS (SELECT source, doc_id, rn, n_chars AS longest, 1 AS n, 0 AS batch_id FROM r WHERE rn = 1
      UNION ALL SELECT r.source, r.doc_id, r.rn,
        CASE WHEN greatest(f.longest, r.n_chars) * (f.n + 1) > 12000 THEN r.n_chars ELSE greatest(f.longest, r.n_chars) END,
        CASE WHEN greatest(f.longest, r.n_chars) * (f.n + 1) > 12000 THEN 1 ELSE f.n + 1 END,
        CASE WHEN greatest(f.longest, r.n_chars) * (f.n + 1) > 12000 THEN f.batch_id + 1 ELSE f.batch_id END
      FROM f JOIN r ON r.source = f.source AND r.rn = f.rn + 1)
    SELECT source, doc_id, batch_id::BIGINT AS batch_id FROM f""")
def dynamic_batch(t: Tables) -> DataFrame:
    return batching.dynamic_batch(t.documents.select("source", "doc_id", "n_chars"), "source", ["doc_id"], "doc_id", "n_chars")


@query()
def distribute_batch(t: Tables) -> DataFrame:
    return batching.distribute_batch(t.documents, "source", ["doc_id"], "doc_id", "n_chars", "lang", "text", max_words_per_epoch=500, max_words_per_batch=100)


@query()
def pipeline_batches(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("source").alias("shard"), F.col("doc_id").alias("pos"), F.format_string("u%d", "doc_id").alias("key"), F.col("text").alias("txt"), F.col("n_chars").alias("n_frames"))
    run = build_pipeline({"tokenize_conf": {"vocab": VOCAB}, "filter_conf": {"token_max_length": 5000}})
    return run(rows).select("shard", "key", "batch_id", "n_frames", F.size("label").alias("n_tokens"))


@query("SELECT lang, sum(n_chars)::BIGINT AS frames, sum(n_chars) / 360000.0 AS hours FROM documents GROUP BY lang")
def seen_hours(t: Tables) -> DataFrame:
    return ranking.seen(t.documents, F.col("n_chars"), "lang")
