"""Each stage on its own input against plain loops, and the whole run."""

import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from albumetry.llm import packing
from tests.llm.helpers import ODD, documents, text_of
from tests.llm.test_language import text
from tests.llm.test_near_dedup import brute as components

pytest.importorskip("public_tokenizers")
LANGS = ["de", "en", "fr", "ru"]


def corpus():
    rng = random.Random(6)
    rows = [(k, text(LANGS[k % 4], k, 80), LANGS[k % 4], f"s{k % 5}") for k in range(240)]
    passage = {x: text(x, "shared", 90) for x in LANGS}  # over 400 bytes
    for k in range(20):
        lang = LANGS[k % 4]
        rows.append((300 + k, text(lang, 1000 + k, 70) + " " + passage[lang] + " " + text(lang, 2000 + k, 70), lang, "s1"))
    for k in range(30):  # copies and near copies
        w = rows[k][1].split()
        for _ in range(k % 3):
            w[rng.randrange(len(w))] = "changed"
        rows.append((400 + k, " ".join(w), rows[k][2], "s2"))
    rows += [(500 + k, "".join(rng.choice("qxzjvkwyhb ") for _ in range(500)), None, "s3") for k in range(5)]
    return rows + [(*r, None, None) for r in ODD]


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "near-duplicates", "repeated passages", "mix sources", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_language_stage_keeps_clean_documents(spark):
    rows = corpus()
    docs = documents(spark, rows)
    kept = stage("language ID")(spark, docs, None)
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert ids >= {r[0] for r in rows if r[2]} and not ids & {500, 501, 502, 503, 504, 900, 901, 902}


def test_near_duplicate_stage_keeps_one_of_each(spark):
    rows = corpus()
    docs = documents(spark, rows)
    kept = stage("near-duplicates")(spark, docs, None)
    assert kept.columns == docs.columns
    want = {d for d, (_, c) in components([r[:2] for r in rows], 80).items() if d == c}
    assert {r["doc_id"] for r in kept.collect()} == want


SPACES = r"[\x20\x09-\x0D]+"


def words_left(rows, length):
    """Plain loop: the words of each text that lie in no run of ``length`` words which also starts elsewhere, and their number gone."""
    split = [(d, [w for w in re.split(SPACES, t or "") if w]) for d, t in rows]
    seen = Counter(tuple(w[i:i + length]) for _, w in split for i in range(len(w) - length + 1))
    out = []
    for d, w in split:
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        out.append((d, [x for x, g in zip(w, gone) if not g], sum(gone)))
    return out


def test_repeat_stage_cuts_passages_of_over_50_words(spark):
    """Passages of 50 words stay, of 51 and more go, be the words short or long and whatever stands between them."""
    rng = random.Random(8)
    rows = [r[:4] for r in corpus()]
    for k, n in enumerate((50, 51, 60, 66, 90)):
        for name, size in (("short", 1), ("middle", 5), ("long", 30)):
            p = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéя") for _ in range(size)) for _ in range(n)]
            for copy in range(2):
                own = [f"own{k}{name}{copy}x{j}" for j in range(2 * rng.randrange(1, 30))]
                half = len(own) // 2
                rows.append((1000 + 100 * k + 10 * len(name) + copy, " ".join(own[:half]) + " " + rng.choice(["  ", "\n", "\t"]).join(p) + "\n" + " ".join(own[half:]), "en", "s1"))
    rows += [(2000, " ".join(f"v{j}" for j in range(80)), "en", "s2")] * 2 + [(2001, " ".join(["same"] * 3000), "en", "s2")]
    docs = documents(spark, rows)
    cut = stage("repeated passages")(spark, docs, None)
    assert cut.columns == docs.columns
    got = cut.collect()
    key = lambda r: (str(r[0]), r[1])
    assert sorted(((r["doc_id"], re.sub(SPACES, " ", r["text"] or "").strip()) for r in got), key=key) == \
        sorted(((d, " ".join(w)) for d, w, _ in words_left([r[:2] for r in rows], 51)), key=key)
    texts = {(r[0], r[1]) for r in rows}
    for r in got:
        assert (r["text"] is None) == ((r["doc_id"], None) in texts) and (r["text"] is None or r["n_chars"] == len(r["text"]))
        if r["doc_id"] is not None and r["doc_id"] // 100 == 10:
            assert (r["doc_id"], r["text"]) in texts  # passages of 50 words stay as they are


def test_mix_stage_repeats_documents(spark):
    from albumetry.llm import mixing

    docs = documents(spark, corpus())
    mixed = stage("mix sources")(spark, docs, None)
    assert mixed.columns == docs.columns
    want = Counter()
    for r in mixing.mix(docs).collect():
        want[r["doc_id"]] += r["times"]
    assert Counter(r["doc_id"] for r in mixed.collect()) == +want


def test_packing_stage_packs_every_row(spark):
    from tokenizers import Tokenizer

    from albumetry.llm.queries import tokenizer

    rows = [(1, text_of(1, 50)), (1, text_of(1, 50)), (2, None), (3, text_of(3, 3000))]
    got = stage("packing")(spark, documents(spark, rows), None).toPandas()
    whole = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    size = {d: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for d, t in rows}
    assert got.groupby("doc_id")["length"].sum().to_dict() == {1: 2 * size[1], 2: 1, 3: size[3]}
    assert got.groupby("sequence_id")["length"].sum().max() <= packing.LENGTH


def test_run_and_empty_table(spark, tmp_path):
    docs = documents(spark, corpus())
    docs.write.parquet(str(tmp_path / "full" / "documents.parquet"))
    docs.filter("false").write.parquet(str(tmp_path / "none" / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path / "full"))
    assert got.count() > 100 and set(got.columns) >= {"doc_id", "start", "length", "sequence_id", "offset"}
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0
