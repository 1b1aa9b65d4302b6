"""Scalar functions on columns: normalising names and texts, and evidence that one entry gives."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that tell nothing about an entry.
STOPWORDS = (
    "the", "and", "for", "with", "from", "that", "this", "your", "you", "are",
    "can", "have", "has", "will", "all", "any", "use", "used", "using",
    "into", "out", "over", "game", "games", "rules", "rule", "set", "sets",
    "book", "books", "guide", "new", "more", "also", "other", "these",
    "those", "their", "they", "was", "were", "not", "but", "how", "what",
    "when", "where", "which", "who", "includes", "including", "contains",
    "provides", "features", "designed", "players", "player",
    "an", "of", "on", "in", "to", "or", "as", "at", "by", "is", "it",
)
# Titles that every text of the line may print.
GENERIC_TITLES = ("dungeons and dragons", "advanced dungeons and dragons")
# Titles of forms and of books that others refer to.
BLANK_FORMS = ("record sheet", "record sheets", "adventure log", "character folder", "hex book", "hex pad", "graph paper")
HUB_BOOKS = ("monster manual", "forgotten realms campaign set")
#: Fixed value: what the right number of pages adds to a score.
PAGE_BONUS = 0.3

#: White space as Unicode has it, in a form that Java's and RE2's classes share.
SPACES = r"\x09-\x0D\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Letters and digits that most texts consist of, and the space: looked at first, as classes of Unicode take far longer.
_PLAIN = "abcdefghijklmnopqrstuvwxyz0123456789 " + "".join(c for c in map(chr, range(0xDF, 0x100)) if c.isalpha())


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text) -> Column:
    """Lower case, letters, digits and single spaces; ``&`` and a lone ``n`` become "and". Null is empty.

    Not idempotent: only every other one of several lone ``n`` is seen.
    """
    t = F.coalesce(_c(text), F.lit(""))
    t = F.replace(F.replace(t, F.lit("_"), F.lit(" ")), F.lit("-"), F.lit(" "))
    t = F.lower(F.replace(t, F.lit("&"), F.lit(" and ")))
    t = F.replace(t, F.lit(" n "), F.lit(" and "))
    t = F.regexp_replace(t, rf"[[^{_PLAIN}]&&[^\p{{L}}\p{{N}}{SPACES}]]", "")
    t = F.regexp_replace(t, rf"[[^{_PLAIN}]&&[{SPACES}]]", " ")
    return F.trim(F.regexp_replace(t, "  +", " "))


def strip_code(clean) -> Column:
    """Without a leading numeric product code."""
    return F.trim(F.regexp_replace(_c(clean), r"^tsr\p{Nd}+ *", ""))


def strip_any_code(clean) -> Column:
    """Without a leading product code, placeholders included."""
    return F.trim(F.regexp_replace(_c(clean), r"^tsr[\p{L}\p{N}_]* *", ""))


def _is_significant(word: Column, least: int) -> Column:
    return (F.length(word) >= least) & ~word.isin(*STOPWORDS)


def significant_words(clean, least: int = 4) -> Column:
    """The different words of at least ``least`` letters that are no stop words."""
    return F.array_distinct(F.filter(F.split(_c(clean), " "), lambda w: _is_significant(w, least)))


def has_significant_words(clean, least: int = 4) -> Column:
    return F.exists(F.split(_c(clean), " "), lambda w: _is_significant(w, least))


def name_tokens(clean) -> Column:
    """Words of a name, in order, without stop words and single letters."""
    return F.filter(F.split(_c(clean), " "), lambda w: (F.length(w) > 1) & ~w.isin(*STOPWORDS))


def page_numbers(notes) -> Column:
    """The numbers of pages that notes give."""
    return F.transform(F.regexp_extract_all(F.lower(_c(notes)), F.lit(r"(\d{2,3})[\s-]?page"), F.lit(1)), lambda x: x.cast("int"))


def page_bonus(pages, notes) -> Column:
    """0.3 if the notes give this number of pages."""
    return F.when((_c(pages) > 0) & F.array_contains(page_numbers(notes), _c(pages).cast("int")), PAGE_BONUS).otherwise(0.0)


def speaks_of_colour(notes) -> Column:
    return F.lower(_c(notes)).contains("color") | F.lower(_c(notes)).contains("colour")


def density_bonus(bytes_a_page, notes) -> Column:
    """For colour: many bytes a page and notes that speak of it, or few and notes that don't."""
    colour, b = speaks_of_colour(notes), _c(bytes_a_page)
    return F.when(colour & (b > 120_000), 0.1).when(~colour & (b > 0) & (b < 40_000), 0.05).otherwise(0.0)


def is_telling_title(core_title) -> Column:
    """A title of three significant words or more, and not one that every text may print."""
    title = _c(core_title)
    return (F.size(significant_words(title)) >= 3) & ~title.isin(*GENERIC_TITLES)


def has_verbatim_title(core_title, text) -> Column:
    """A title of three significant words or more stands in the text."""
    return is_telling_title(core_title) & F.contains(_c(text), _c(core_title))


def contains_any(text, words) -> Column:
    return reduce(or_, [_c(text).contains(w) for w in words])


def is_blank_form(clean) -> Column:
    return contains_any(clean, BLANK_FORMS)


def is_hub_book(clean) -> Column:
    return contains_any(clean, HUB_BOOKS)


def safe_file_name(title, extension: str = ".pdf") -> Column:
    """Without characters that file names may not have, and with the extension."""
    kept = F.translate(_c(title), '<>:"/\\|?*', "")
    return F.concat(F.regexp_replace(kept, rf"^[{SPACES}]+|[{SPACES}]+$", ""), F.lit(extension))


def without_low_confidence(method) -> Column:
    """The method's label once a person has confirmed it."""
    bare = F.regexp_replace(_c(method), r", low confidence(?=\))", "")
    return F.trim(F.regexp_replace(bare, r"\s*\(low confidence\)", ""))


def hamming(a, b) -> Column:
    """Bits that differ between two hashes given as arrays of longs."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)


def split_name(name) -> Column:
    """(stem, extension with its dot) of a file name; a leading dot begins no extension."""
    ext = F.regexp_extract(_c(name), r"^.*[^.].*?(\.[^.]*)$", 1)
    return F.struct(F.expr("''").alias("none"), F.when(ext == "", _c(name)).otherwise(F.substr(_c(name), F.lit(1), F.length(_c(name)) - F.length(ext))).alias("stem"), ext.alias("ext"))
