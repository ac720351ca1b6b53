"""Small tables and plain loops that the operators are held against."""

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, host string, row string, "
          "place long, times int, copy int, _s string, _n long, _hit boolean, node long, key long, component long")


def documents(spark, rows):
    """Rows (doc_id, text[, lang[, source]]) with more columns whose names the operators use themselves."""
    full = []
    for r in rows:
        doc_id, text, lang, source = [*r, None, None][:4]
        n = None if text is None else len(text)
        full.append((doc_id, text, lang, source, n, 1, "h", "r", 2, 3, 4, "s", 5, True, 6, 7, 8))
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def words_of(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return [f"w{rng.randrange(vocabulary)}x" for _ in range(n)]


def text_of(seed, n, vocabulary=400):
    return " ".join(words_of(seed, n, vocabulary))


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "two words"), (905, "ÀÉ ß 日本語 🎉 x\x1fy"), (None, "no id at all")]
