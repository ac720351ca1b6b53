import random

import numpy as np

from albumetry.llm import language
from tests.llm.helpers import ODD, documents

SYLLABLES = {"en": "the and ing er on re th of to is", "fr": "eau ou le que ai é ment tion la de", "de": "sch ein ung der ü ver ich ß auf te",
             "ru": "ст на ов про ть и ко мы де ры"}


def text(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    s = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(s) for _ in range(rng.randint(1, 3))) for _ in range(n))


def corpus():
    rows = [(k, text(lang, k), lang, "s") for k in range(400) for lang in [sorted(SYLLABLES)[k % 4]]]
    rng = random.Random(0)
    noise = [(1000 + k, " ".join("".join(rng.choice("qxzjvkwyhb") for _ in range(6)) for _ in range(60)), None, "s") for k in range(10)]
    return rows, noise


def test_held_out_accuracy_and_rejection(spark):
    rows, noise = corpus()
    docs = documents(spark, rows + noise + [(*r, None, None) for r in ODD])
    got = {r["doc_id"]: r for r in language.predict(docs).collect()}
    labels = {r[0]: r[2] for r in rows}
    assert all(r["lang_pred"] == labels[d] and r["accepted"] for d, r in got.items() if d in labels)
    assert sum(got[d]["held_out"] for d in labels) > 50
    assert not any(got[r[0]]["accepted"] for r in noise)
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for d in (900, 901, 902):
        assert (got[d]["lang_pred"], got[d]["score"], got[d]["accepted"]) == ("und", 0.0, False)
    kept = language.accepted(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} >= set(labels)


def test_held_out_labels_are_not_learned(spark):
    rows, _ = corpus()
    docs = documents(spark, rows)
    fold = {r[0]: r[1] for r in docs.select("doc_id", language.fold_of(docs["doc_id"])).collect()}
    wrong = documents(spark, [(d, t, "xx" if fold[d] == 2 else lang, s) for d, t, lang, s in rows])
    a, b = (sorted(map(tuple, language.predict(x).collect())) for x in (docs, wrong))
    assert a == b


def test_nothing_to_learn_from(spark):
    docs = documents(spark, [(1, "some text", None, "s"), (2, None, None, "s")])
    assert {(r["lang_pred"], r["score"]) for r in language.predict(docs).collect()} == {("und", 0.0)}
    assert language.predict(docs.filter("false")).count() == 0


def test_probabilities_sum_to_one():
    numbers = language.letter_numbers()
    counts = {}
    for lang in ("en", "fr"):
        g, n = np.unique(language.sequences([text(lang, k) for k in range(20)], numbers)[0], return_counts=True)
        counts[lang] = (g, n)
    model = language.kneser_ney(counts, numbers)
    letters = np.arange(1 << language.BITS, dtype=np.uint64)
    for g in [*counts["en"][0][:20], np.uint64(12345678901)]:
        keys = (g & ~np.uint64(4095)) | letters
        assert np.allclose(np.exp(model._logs(keys, 5).astype(float)).sum(axis=0), 1, atol=1e-3)


def test_pruned_probabilities_sum_to_one():
    numbers = language.letter_numbers()
    grams = {lang: language.sequences([text(lang, k) for k in range(20)], numbers)[0] for lang in ("en", "fr")}
    counts = {lang: np.unique(g, return_counts=True) for lang, g in grams.items()}
    model = language.kneser_ney(counts, numbers, most=60)
    letters = np.arange(1 << language.BITS, dtype=np.uint64)
    for g in [*counts["en"][0][:40], *counts["fr"][0][-20:]]:
        keys = (g & ~np.uint64(4095)) | letters
        assert np.allclose(np.exp(model._logs(keys, 5).astype(float)).sum(axis=0), 1, atol=1e-3)


def test_unknown_language_of_a_known_alphabet_is_rejected(spark):
    rows, _ = corpus()
    rng = random.Random(3)
    near = "the er on re th of to is ou le".split()  # most syllables are English ones
    other = [(6000 + k, " ".join("".join(rng.choice(near) for _ in range(rng.randint(1, 3))) for _ in range(60)), None, "s") for k in range(20)]
    got = {r["doc_id"]: r["accepted"] for r in language.predict(documents(spark, rows + other)).collect()}
    assert not any(got[r[0]] for r in other) and all(got[r[0]] for r in rows)


def test_far_quantile():
    z = np.random.default_rng(4).normal(size=2000)
    assert 3 < language.far_quantile(z) < 4.5
    assert language.far_quantile(z[:25]) > z[:25].max() and language.far_quantile(np.ones(9)) == 1


def test_more_labels_leave_a_language_its_model(spark):
    rows, _ = corpus()
    docs = documents(spark, rows)
    noise = documents(spark, [(5000 + k, text("en", k), f"label {k}", "s") for k in range(70)])
    few, many = language.fit(docs), language.fit(docs.unionByName(noise))
    texts = [text(lang, 9000) for lang in SYLLABLES]
    assert len(many.languages) > 30
    at = [many.languages.index(x) for x in few.languages]
    assert np.allclose(few.entropies(texts)[0], many.entropies(texts)[0][:, at], atol=1e-5)


def test_look_up_equals_search():
    keys = np.random.default_rng(0).integers(0, 1 << 60, 5000).astype(np.uint64)
    keys = np.unique(keys)
    h = np.sort(language.mixed(keys))
    found = language.HashArray(h).find(np.concatenate((keys, keys + np.uint64(1 << 61))))
    assert (h[found[: len(keys)]] == language.mixed(keys)).all() and (found[len(keys):] == -1).all()
    assert (language.HashArray(h[:0]).find(keys) == -1).all()


def test_sequences_begin_anew_with_every_text():
    numbers = language.letter_numbers()
    both = language.sequences(["Ab, c", "", "ab  C"], numbers)
    alone = language.sequences(["ab c"], numbers)
    assert both[0].tolist() == alone[0].tolist() * 2
    assert both[1].tolist() == [0] * 4 + [2] * 4 and both[2].tolist() == [3, 0, 3]
