import random
import re
from collections import Counter

import numpy as np
import pytest

from albumetry.llm import phrases
from tests.llm.helpers import ODD, documents


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def counts(rows):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text or "")):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i:i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    return f, n


def brute(rows, least=30, top=2000):
    f, n = counts(rows)
    cand = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    out = {}
    for (lang, w), a in cand.items():
        if any(100 * b >= 80 * a and m == lang and len(v) > len(w) and any(v[i:i + len(w)] == w for i in range(len(v) - len(w) + 1))
               for (m, v), b in cand.items()):
            continue
        score, _, l, r = min((2_000_000 * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), l, r))
    return sorted((lang, k + 1, p.decode(), -a, l, r, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, l, r) in enumerate(sorted(rows)[:top]))


def corpus(seed=1, docs=60):
    rng = random.Random(seed)
    words = ["the", "of", "New", "York", "état", "日本", "x.y", "a", "b c", "q\x1fz", "Straße"]
    fixed = ["New York is big", "the state of the art", "a a a a a", "Straße\t\tb c", "x, New York"]
    rows = []
    for k in range(docs):
        parts = [rng.choice(fixed) if rng.random() < .5 else " ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(rng.randrange(1, 30))]
        rows.append((k, "".join(p + rng.choice([". ", "\n", "!", "  ", " \t", "\x0b", ";"]) for p in parts), rng.choice(["en", "de", None, "und"])))
    return rows + [(*r, None) for r in ODD] + [rows[0], rows[0]]


def found(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


@pytest.mark.parametrize("sample,per_task", [(8, phrases.PER_TASK), (1, 2), (1000, 1)])
def test_equals_plain_counts(spark, sample, per_task):
    """Whatever the sample proposes (a part, all, nothing), the result is the same."""
    rows = corpus()
    got = phrases.collocations(documents(spark, rows), sample=sample, per_task=per_task)
    assert dict(got.dtypes) == {**dict.fromkeys(["rank", "a", "l", "r", "n", "score"], "bigint"), "lang": "string", "phrase": "string"}
    want = brute(rows)
    assert found(got) == want and len(want) > 10


def test_limits_and_ties(spark):
    rows = corpus(2)
    docs = documents(spark, rows)
    assert found(phrases.collocations(docs, least=3, top=7)) == brute(rows, 3, 7)


def test_all_frequent_phrases_and_passes(spark):
    rows = corpus(3)
    f, n = counts(rows)
    for sample, most in ((1, 1), (8, 4), (1000, 4)):
        got, passes = phrases.frequent(documents(spark, rows), sample=sample, sample_least=30 if sample == 1 else 2)
        assert passes <= most  # all of the corpus as the sample leaves no failure
        assert {(r["lang"], r["phrase"]): r["n"] for r in got.collect() if r["k"]} == {(m, " ".join(w)): a for (m, w), a in f.items() if a >= 30}
        assert {r["lang"]: r["n"] for r in got.collect() if not r["k"]} == +n


def test_crowded_bitmap_and_small_parts(spark, monkeypatch):
    """Bits that many phrases share only let more be counted."""
    rows = corpus(4)
    f, _ = counts(rows)
    got, _ = phrases.frequent(documents(spark, rows), bits=15)
    assert {(r["lang"], r["phrase"]): r["n"] for r in got.collect() if r["k"]} == {(m, " ".join(w)): a for (m, w), a in f.items() if a >= 30}


def test_long_texts_are_cut_where_pieces_end():
    texts = [b"ab cd. ef" * 50, b"", b"x" * 300, b"one\ntwo, three " * 20]
    for limit in (1, 10, 100, 10_000):
        parts = [p for held in phrases.parts_of(texts, limit) for p in held]
        for row, text in enumerate(texts):
            assert b"".join(t for r, t in parts if r == row) == text
        assert all(t[-1:] in b".,;:!?\n" for (r, t), (s, _) in zip(parts, parts[1:]) if r == s)


def test_words_of_a_batch():
    words = phrases.Words([b"", b"Ab \t c", b"  ", b"d"], np.array([0, 1, 2, 3]))
    assert words.flat.tobytes() == b"ab c d " and words.lang.tolist() == [1, 1, 3]
    assert len(set(words.piece.tolist())) == 2
    assert not len(phrases.Words([b" ", b""], np.array([0, 0])).hashes)


def test_score_beyond_64_bits(spark):
    """The score's arithmetic on numbers whose product passes 64 bits."""
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(9 * 10**15, 9 * 10**15, 9 * 10**15 + 7)], "a long, l long, r long")
    got = row.select(F.expr("cast(a as decimal(19,0)) * cast(2000000 as decimal(7,0)) div cast(l + r as decimal(19,0))").alias("s")).first()["s"]
    assert got == 2_000_000 * 9 * 10**15 // (18 * 10**15 + 7)


def test_empty_table(spark):
    assert phrases.collocations(documents(spark, [(1, "a")]).filter("false")).count() == 0


def test_long_words_of_equal_sums(spark):
    """Thue-Morse words: their sums of powers mod 2^64 are equal."""
    one = "a"
    for _ in range(12):
        one += one.translate(str.maketrans("ab", "ba"))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(k, f"{one} {two} yy", "en") for k in range(40)] + [(k, f"{one} zz", "en") for k in range(40, 75)]
    assert found(phrases.collocations(documents(spark, rows))) == brute(rows)


def test_shared_bit_is_not_taken_for_counted():
    """A bit that another phrase set before does not say that the longer phrase was counted before."""
    words, seeds = phrases.Words([b"a b c d"], np.array([0])), np.array([7], dtype=np.uint64)
    everything = np.full(1 << 13, 255, dtype=np.uint8)
    first, size, keys = phrases.let_in(words, seeds, None, everything, 4)
    key = {(i, k): x for i, k, x in zip(first.tolist(), size.tolist(), keys)}

    def bits(*phrase):
        out = np.zeros(1 << 13, dtype=np.uint8)
        for p in phrase:
            at = int(key[p]) >> 48
            out[at >> 3] |= 1 << (at & 7)
        return out

    before = bits((1, 1), (2, 1), (3, 1), (1, 2), (2, 2), (1, 3), (0, 3))  # "a" and "a b" are not in, the bit of "a b c" is shared
    first, size, _ = phrases.let_in(words, seeds, before, before | bits((0, 1), (0, 2)), 4)
    assert {(0, 2), (0, 3), (0, 4)} == set(zip(first.tolist(), size.tolist()))
