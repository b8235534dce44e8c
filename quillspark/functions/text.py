"""Text normalisation, segmentation predicates and tokenisers as Column functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns and marker lists that decide where chapters, scenes and packets begin.
HEADING = r"(?i)^Chapter[\s_\-]*\d+"
HEADING_ZH = r"^第\s*[0-9一二三四五六七八九十百千两零]+\s*[章节回部卷]"
SENTENCE_END = r"[。！？!?；;:：…\.\"”’'\)\]】]\s*$"
SCENE_LINE = r"^[-_=*~·•]{3,}$"
SCENE_WORDS = ("场景", "幕间")
TOPIC_MARKERS = ("later", "meanwhile", "suddenly", "the next day", "at dawn", "at night", "回到", "后来", "与此同时", "忽然", "第二天", "当天夜里")
DIALOGUE_OPENERS = ("“", '"', "—", "——")
PAIRS = (("“", "”"), ("‘", "’"), ("(", ")"), ("（", "）"), ("[", "]"), ("【", "】"))
NAME_STOPWORDS = ("Chapter", "When", "The", "By", "At")
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))
CJK = r"[\x{4e00}-\x{9fff}]"

SPACES = r"(?U)\s+"
#: All characters of Unicode's White_Space, those that SPACES matches.
WHITE = "\t\n\x0b\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def made_once(df: DataFrame, name: str) -> DataFrame:
    """df with the column as the output of a generator, so that what reads it later (filters, lambdas) reads a value and doesn't bring its expression along."""
    return df.select(*[F.explode(F.array(name)).alias(name) if c == name else F.col(c) for c in df.columns])


def any_of(conditions) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def strip(c: Column | str) -> Column:
    return F.btrim(col(c), F.lit(WHITE))


def normalize_text(c: Column | str) -> Column:
    """Line ends to LF, runs of blanks to one, at most one empty line, no space around."""
    lf = F.replace(F.replace(col(c), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return strip(F.regexp_replace(F.regexp_replace(lf, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def paragraphs(c: Column | str, delimiter: str = "\n\n") -> Column:
    """Array of normalised non-empty blocks."""
    blocks = F.transform(F.split(col(c), delimiter), normalize_text)
    return F.filter(blocks, lambda x: x != "")


def token_count(c: Column | str) -> Column:
    """Latin words plus CJK characters, 1 at least."""
    c = col(c)
    return F.greatest(F.lit(1), F.regexp_count(c, F.lit("[A-Za-z0-9_]+")) + F.regexp_count(c, F.lit(CJK)))


def is_heading(c: Column | str) -> Column:
    s = strip(c)
    return s.rlike(HEADING) | s.rlike(HEADING_ZH)


def ends_like_sentence(c: Column | str) -> Column:
    return strip(c).rlike(SENTENCE_END)


def join_fragments(left: Column, right: Column) -> Column:
    """Joins two fragments; a hyphen at the end of the first is a word division."""
    lead = F.regexp_replace(right, r"(?U)^\s+", "")
    trail = F.regexp_replace(left, r"(?U)\s+$", "")
    return F.when(F.endswith(left, F.lit("-")), F.concat(F.substring(left, F.lit(1), F.length(left) - 1), lead)).otherwise(strip(F.concat(trail, F.lit(" "), lead)))


def count_of(c: Column, what: str) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit(what), F.lit("")))) / len(what)


def has_unclosed_pairs(c: Column | str) -> Column:
    c = col(c)
    return any_of([count_of(c, '"') % 2 == 1, *[count_of(c, a) > count_of(c, b) for a, b in PAIRS]])


def is_scene_separator(c: Column | str) -> Column:
    s = strip(c)
    return (s == "") | s.rlike(SCENE_LINE) | F.startswith(F.lower(s), F.lit("scene ")) | s.isin(*SCENE_WORDS)


def is_topic_shift(c: Column | str) -> Column:
    s = F.lower(strip(c))
    return any_of([F.startswith(s, F.lit(m)) for m in TOPIC_MARKERS])


def is_dialogue_start(c: Column | str) -> Column:
    s = strip(c)
    return any_of([F.startswith(s, F.lit(m)) for m in DIALOGUE_OPENERS])


def sentences(c: Column | str) -> Column:
    parts = F.transform(F.split(col(c), r"(?<=[。！？!?])"), strip)
    return F.filter(parts, lambda x: x != "")


def slugify(c: Column | str, separator: str = "_", fallback: str = "unknown", ascii_only: bool = False) -> Column:
    kept = "[^a-z0-9]+" if ascii_only else r"[^a-z0-9\x{4e00}-\x{9fff}]+"
    # white space around turns into separators, which go; each step reads the one before once, so that none is made twice
    s = F.btrim(F.regexp_replace(F.lower(col(c)), kept, separator), F.lit(separator)) if len(separator) == 1 else F.regexp_replace(F.regexp_replace(F.lower(col(c)), kept, separator), f"^({separator})+|({separator})+$", "")
    return F.coalesce(F.regexp_replace(s, "^$", fallback), F.lit(fallback))


def collapse(c: Column | str) -> Column:
    """White space of any kind to single blanks, none around."""
    return F.btrim(F.regexp_replace(col(c), SPACES, " "))


def clip(c: Column | str, limit: int, suffix: str = "...") -> Column:
    s = collapse(c)
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.substring(s, 1, limit - len(suffix)), F.lit(suffix)))


def non_blank_length(c: Column | str) -> Column:
    return F.length(F.regexp_replace(col(c), r"(?U)\s", ""))


def blocks_of(c: Column | str, size: int = 500) -> Column:
    """Blocks of ``size`` non-blank characters; a last one of at least half the size stays."""
    bare = F.regexp_replace(col(c), r"(?U)\s", "")
    starts = F.when(F.length(bare) > 0, F.sequence(F.lit(1), F.length(bare), F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.filter(F.transform(starts, lambda i: F.substring(bare, i, F.lit(size))), lambda b: F.length(b) * 2 >= size)


def language_guess(c: Column | str) -> Column:
    return F.when(col(c).rlike(CJK), "zh").otherwise("en")


def markup_to_text(c: Column | str) -> Column:
    """Text of an HTML fragment: scripts and styles go, block tags break lines, six entities are decoded in order."""
    t = F.regexp_replace(col(c), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)</?(p|div|section|article|h[1-6]|li|blockquote|tr|br)\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for name, value in ENTITIES:
        t = F.replace(t, F.lit(name), F.lit(value))
    return normalize_text(t)


def tokens(c: Column | str) -> Column:
    """Lower-cased runs of letters, digits and underscores of any script."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def alnum_tokens(c: Column | str) -> Column:
    """Lower-cased runs of ASCII letters and digits and CJK characters."""
    return F.filter(F.split(F.lower(col(c)), r"[^a-zA-Z0-9\x{4e00}-\x{9fff}]+"), lambda x: x != "")


def word_runs(c: Column | str) -> Column:
    """Runs of letters, digits and underscores as they are; what lies between them are the word borders."""
    return F.regexp_extract_all(col(c), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def candidate_names(c: Column | str, most: int = 5) -> Column:
    """First distinct words of one capital and two small ASCII letters or more, without common openers."""
    # the capital first, so that other characters cost one comparison
    names = F.regexp_extract_all(col(c), F.lit(r"[A-Z](?<![\p{L}\p{N}_][A-Z])[a-z]{2,}+(?![\p{L}\p{N}_])"), F.lit(0))
    return F.slice(F.array_except(names, F.array(*map(F.lit, NAME_STOPWORDS))), 1, most)  # distinct, in order of appearance


def surface_names(c: Column | str, most: int = 8) -> Column:
    """Capitalised names of one or two words, then short quoted titles without punctuation; first ``most`` distinct."""
    names = F.regexp_extract_all(col(c), F.lit(r"(?<![\p{L}\p{N}_])[A-Z][a-zA-Z]{2,}(?:\s+[A-Z][a-zA-Z]{2,}(?![\p{L}\p{N}_]))?(?![\p{L}\p{N}_])"), F.lit(0))
    quoted = F.filter(F.regexp_extract_all(col(c), F.lit("[《“](.{2,8}?)[》”]"), F.lit(1)), lambda x: ~x.rlike("[，。！？、]"))
    return F.slice(F.array_distinct(F.concat(names, quoted)), 1, most)


def round4(c: Column) -> Column:
    """Half up to four places, the same in every engine."""
    return F.floor(c * 10000 + 0.5) / 10000


def round3(c: Column) -> Column:
    return F.floor(c * 1000 + 0.5) / 1000
