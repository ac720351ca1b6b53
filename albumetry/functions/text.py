"""Text helpers: tokens, word lists, substring tests, file names."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from albumetry import vocab

BLANKS = " \t\n\r\x0b\x0c"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it inside ``body``."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANKS))


def blank_to_null(c: Column) -> Column:
    return F.when(strip(c) != "", c)


def words_array(words: Iterable[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def empty_words() -> Column:
    return F.array().cast("array<string>")


def contains_any(c: Column, words: Iterable[str]) -> Column:
    """True if any word is a substring; null and no match are false."""
    hit = F.lit(False)
    for w in words:
        hit = hit | c.contains(w)
    return F.coalesce(hit, F.lit(False))


def first_contained(c: Column, words: Iterable[str]) -> Column:
    """The first word of the list that is a substring, else null."""
    return F.coalesce(*[F.when(c.contains(w), F.lit(w)) for w in words])


# Letters whose upper case has several characters, and the single letter that stands for it, where there is one.
_LONG = "".join(c for c in map(chr, range(0x10000)) if len(c.upper()) > 1)
_LONG_UPPER = "".join("\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in _LONG)


def sentence_case(c: Column) -> Column:
    """First letter upper, as one letter: ß becomes ẞ, not SS."""
    first = F.substring(c, 1, 1)
    upper = F.when(F.length(F.upper(first)) == 1, F.upper(first)).otherwise(F.translate(first, _LONG, _LONG_UPPER))
    return F.concat(upper, F.substring(c, 2, 2**31 - 1))


def capitalise(c: Column) -> Column:
    """First letter upper, rest lower."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 2**31 - 1)))


def tokens(c: Column) -> Column:
    """Set of lower-case search words without stop words; null gives []."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 2)
    return F.coalesce(F.array_except(words, words_array(vocab.STOP_WORDS)), empty_words())


def list_tokens(c: Column) -> Column:
    """Token set of a list of strings."""
    return tokens(F.concat_ws(" ", c))


def is_meaningful(w: Column) -> Column:
    clean = strip(F.lower(w))
    return (F.length(clean) >= 3) & ~clean.isin(vocab.GENERIC_WORDS)


def meaningful_words(c: Column) -> Column:
    """Words of a text with repeats, generic and short ones removed."""
    return F.coalesce(
        F.filter(F.split(F.lower(c), vocab.WORD_BREAKS), is_meaningful), empty_words()
    )


def clean_stem(filename: Column) -> Column:
    """File name without extension and copy marks, lower case."""
    stem = F.regexp_replace(filename, "\\.[^.]*$", "")
    stem = F.when(stem == "", filename).otherwise(stem)
    stem = F.regexp_replace(stem, "(?i)\\s*\\(copy\\s*\\d*\\)|\\s*\\(\\d*\\)", "")
    return F.lower(strip(stem))


def base_name(filename: Column) -> Column:
    """File name without edit prefixes, wherever they stand."""
    for prefix in vocab.EDIT_PREFIXES:
        filename = F.replace(filename, F.lit(prefix), F.lit(""))
    return filename


def is_original_name(filename: Column) -> Column:
    return ~F.lower(filename).rlike(vocab.EDITED_NAME)


def extension(filename: Column) -> Column:
    return F.upper(F.substring_index(filename, ".", -1))


def mime_from_name(filename: Column) -> Column:
    suffix = F.lower(F.regexp_extract(filename, "\\.([^.]*)$", 1))
    return F.concat(F.lit("image/"), F.regexp_replace(suffix, "jpg", "jpeg"))


def collection_key(model: Column) -> Column:
    return F.concat(F.lit("media_embeddings_"), F.translate(F.lower(model), "-.", "__"))


def migrated_path(path: Column, root: str = "/storage/") -> Column:
    """Host path → path below ``root``; other paths unchanged."""
    rel = F.regexp_extract(F.lower(path), "(?s)^.*storage(.*)$", 1)
    rel = F.ltrim(F.translate(rel, "\\", "/"), F.lit("/"))
    return F.when(F.lower(path).contains("storage"), F.concat(F.lit(root), rel)).otherwise(path)


def is_host_path(path: Column) -> Column:
    return path.startswith("C:") | path.contains("\\")
