import unicodedata
import zlib

import numpy as np
import pytest

from albumetry.llm import packing, pretokens
from tests.llm.helpers import ODD, documents, text_of

public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")

TEXTS = ["", "  ", "Don't STOP, we'LL 've!", "İstanbul ΑΣ ας a\x1cb", "<|endoftext|> x<|endoftext|>y <|x", "a\u0301e\u0308 日本語 12½ ǅ",
         "🎉 ok😀 \u0085 a\x00b \u200b zz \ufeff q\xa0w\u3000e", "A" * 3000, text_of(1, 4000)]


def test_ids_equal_the_tokenizers(monkeypatch):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    known = packing.WordIds(PATH, pretokens.tokenizers_classes(), pretokens.composed_otherwise())
    for text in TEXTS * 2:
        assert known.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids
    monkeypatch.setattr(packing, "WORDS_KEPT", 1)  # forgets between texts
    for text in TEXTS:
        assert known.encode(text).tolist() == whole.encode(text, add_special_tokens=False).ids


def test_ids_of_every_letter():
    """Between letters, between spaces and before a combining mark."""
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(PATH)
    known = packing.WordIds(PATH, pretokens.tokenizers_classes(), pretokens.composed_otherwise())
    letters = [chr(c) for c in range(0x10000) if not 0xD800 <= c < 0xE000] + [c for c in map(chr, range(0x10000, 0x110000)) if unicodedata.category(c)[0] == "M" or ord(c) % 97 == 0]
    texts = [f"a{x}b" for x in letters] + [f"{x} {x}\u0301 {x}x" for x in letters]
    for text, want in zip(texts, whole.encode_batch(texts, add_special_tokens=False)):
        assert known.encode(text).tolist() == want.ids, ascii(text)


def test_repeated_ids_and_rows_fill_many_groups(spark):
    rows = [(5, "same words")] * 300 + [(5, text_of(2, 60_000))]
    got = packing.pack(documents(spark, rows), PATH, group=20).toPandas()
    groups = (got["sequence_id"] // 2**32).value_counts()
    assert len(groups) > 10 and groups.max() < 80


def first_fit(sizes, length):
    """The plain rule: bins in order, the first with room."""
    bins, out = [], []
    for s in sizes:
        at = next((k for k, used in enumerate(bins) if used + s <= length), len(bins))
        if at == len(bins):
            bins.append(0)
        out.append((at, bins[at]))
        bins[at] += s
    return out


def test_tournament_equals_first_fit():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 7, 300):
        sizes = sorted(rng.integers(1, 65, n).tolist(), reverse=True)
        assert packing.first_fit_decreasing(sizes, 64) == first_fit(sizes, 64)


def test_every_id_lies_in_one_piece(spark):
    from tokenizers import Tokenizer

    rows = ODD + [(k, text_of(k, 30 * k)) for k in range(40)] + [(7, text_of(7, 210)), (500, text_of(9, 9000))]
    docs = documents(spark, rows)
    got = packing.pack(docs, PATH, group=16).toPandas()
    whole = Tokenizer.from_file(PATH)
    want = {}
    for d, t in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        for a in range(0, len(ids), 2048):
            piece = ids[a:a + 2048]
            key = (-1 if d is None else d, a, len(piece), zlib.crc32(piece.tobytes()), len(ids))
            want[key] = want.get(key, 0) + 1
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    found = got.assign(doc_id=got["doc_id"].fillna(-1).astype(int)).groupby(cols).size().to_dict()
    assert found == want
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s["offset"].to_numpy() == np.cumsum(s["length"]) - s["length"]).all() and s["length"].sum() <= 2048
    assert packing.pack(docs.filter("false"), PATH).count() == 0
