"""String functions of transcripts: splitting, tokenising, joining again, and keys."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = "\u2581"  # marks the start of a word
SWITCH = "<sw>"
#: Unicode white space, as a plain class: much faster than a pattern with Unicode classes switched on.
BLANKS = r"[\s\x1C-\x1F\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"
BRACKETED = r"\[[^\[\]]+\]|<[^<>]+>|\{[^{}]+\}"
CJK = "[\u4e00-\u9fff]"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{BLANKS}|{BLANKS}$", "")


def split_words(c: Column) -> Column:
    """Words between any white space; no empty ones."""
    return F.array_remove(F.split(c, BLANKS), "")


def count_words(c: Column) -> Column:
    """How many words split_words() gives, without making them."""
    return F.regexp_count(c, F.lit(BLANKS.replace("[", "[^", 1)))


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value evaluated once however often body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def char_tokens(c: Column, symbols: bool = False, split_with_space: bool = False) -> Column:
    """Characters, or words, with spaces as the word mark. With symbols, bracketed parts stay whole and the text is upper-cased."""
    text = F.upper(strip(c)) if symbols else strip(c)
    if not symbols and not split_with_space:  # marked before it is cut, so nothing is done a character
        return F.regexp_extract_all(F.replace(text, F.lit(" "), F.lit(SPACE)), F.lit("(?s)."), F.lit(0))
    if split_with_space:
        plain = F.split(text, " ")
        found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(f"(?s){BRACKETED}|[^\\[<{{]+|."), F.lit(0)), lambda p: F.when(p.rlike(f"^({BRACKETED})$"), F.array(p)).otherwise(F.split(p, " ")))) if symbols else plain
    else:
        found = F.regexp_extract_all(text, F.lit(f"(?s){BRACKETED}|."), F.lit(0))
    return F.transform(found, lambda t: F.when(t == " ", SPACE).otherwise(t))


def split_cjk(c: Column, upper: bool = False) -> Column:
    """Each CJK character alone, other runs whole, without outer spaces or empty parts."""
    parts = F.regexp_extract_all(c, F.lit(f"{CJK}|[^\u4e00-\u9fff]+"), F.lit(0))
    out = F.filter(F.transform(parts, strip), lambda x: x != "")
    return F.transform(out, F.upper) if upper else out


def clean_for_subword(c: Column) -> Column:
    """Speaker-switch marks taken out, one pass of double spaces, unknown-word marks spelled out."""
    return F.replace(strip(F.replace(F.replace(c, F.lit(SWITCH), F.lit("")), F.lit("  "), F.lit(" "))), F.lit("<unk>"), F.lit("<unknown>"))


def detokenize(tokens: Column, joiner: str = "") -> Column:
    return strip(F.replace(F.array_join(tokens, joiner), F.lit(SPACE), F.lit(" ")))


def is_special(token: Column) -> Column:
    return token.startswith("<") & token.endswith(">")


def starts_word(token: Column) -> Column:
    return token.startswith(SPACE)


# Tokens that beautify leaves out, and marks that count as nothing in a token.
SILENT, MARKS = ("<sos>", "<eos>", "<blank>"), r" |</s>|<s>|<unk>|<OOV>"


def joins(c: Column) -> Column:
    """Whether a token joins its neighbours: CJK characters, digits and at signs alone, but for marks."""
    return F.regexp_replace(c, MARKS, "").rlike("^[\u4e00-\u9fff0-9@]+$")


def beautify(tokens: Column) -> Column:
    """Tokens as readable text.

    Pieces (with @@) go before the next word. A word (letters and apostrophes) has a space behind it, unless the next token
    joins its neighbours. Everything else stands as it is; where all tokens join, their spaces go too.
    """
    kept = F.filter(tokens, lambda t: ~t.isin(*SILENT))
    word = lambda t: F.regexp_replace(t, MARKS, "").rlike(r"(?U)^[\p{L}']+$") & ~t.rlike(CJK)
    kind = lambda t: F.when(joins(t), "join").when(t.contains("@@"), "piece").when(word(t), "word").otherwise("other")
    rows = F.transform(kept, lambda t: F.struct(t.alias("t"), kind(t).alias("kind")))

    def readable(x: Column, ends: Column) -> Column:
        """x in runs that end at the places of words (the last one may have none), so each token is looked at once."""

        def run(g: Column) -> Column:
            start, end = F.coalesce(F.get(ends, g - 1) + 1, F.lit(0)), F.coalesce(F.get(ends, g), F.size(x) - 1)
            own = F.slice(x, start + 1, end - start + 1)
            texts = lambda keep: F.array_join(F.transform(F.filter(own, keep), lambda r: r["t"]), "")
            pieces = F.replace(texts(lambda r: r["kind"] == "piece"), F.lit("@@"), F.lit(""))
            space = F.when(F.coalesce(F.get(x, end + 1)["kind"] == "join", F.lit(False)), "").otherwise(" ")
            ending = F.when(g < F.size(ends), F.concat(pieces, F.get(x, end)["t"], space)).otherwise("")
            return F.concat(texts(lambda r: r["kind"].isin("join", "other")), ending)

        whole = F.array_join(F.transform(F.sequence(F.lit(0), F.size(ends)), run), "")
        return F.when(F.forall(x, lambda r: r["kind"] == "join"), F.replace(whole, F.lit(" "), F.lit(""))).otherwise(strip(whole))

    places = lambda x: F.filter(F.transform(x, lambda r, i: F.when(r["kind"] == "word", i)), lambda i: i.isNotNull())
    return bind(rows, lambda x: bind(places(x), lambda ends: readable(x, ends)))


def job_id(key: Column) -> Column:
    """The first two dot parts of a key of three parts or more, else null."""
    parts = F.split(key, r"\.")
    return F.when(F.size(parts) >= 3, F.concat_ws(".", parts[0], F.get(parts, F.lit(1))))


def speaker_of(key: Column) -> Column:
    """A key up to its last dash."""
    return F.regexp_extract(key, r"^(.*)-[^-]*$", 1)
