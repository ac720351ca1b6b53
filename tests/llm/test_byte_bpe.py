import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from albumetry.llm import byte_bpe, pretokens
from tests.llm.helpers import ODD, documents, text_of

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["Don't STOP, we'LL 've!", "a\x1cb \x85 c", "<|endoftext|> <unk> ⁇unknown ‖", "é日本語 12½ ǅ 🎉 ok😀 👍🏽", "x" * 20_000,
         "ab \n\n  " * 300, "\x00\x01", "▁a ▁", text_of(1, 4000), "  lead and trail  "]


@pytest.fixture(scope="module")
def library():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})


@pytest.fixture(scope="module")
def own():
    return byte_bpe.Codec(PATH, public.PATTERN, pretokens.tiktoken_classes())


def test_ids_equal_the_librarys_and_decode_back(library, own, monkeypatch):
    for text in TEXTS * 2:
        ids = own.encode(text)
        assert ids.tolist() == library.encode_ordinary(text) and own.decode(ids) == text.encode()
    monkeypatch.setattr(pretokens, "PIECES_KEPT", 1)  # forgets between texts
    for text in TEXTS:
        assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_every_letter_is_split_as_the_library_splits(library, own):
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(letters), 20_000):
        for text in ("a".join(letters[at: at + 20_000]), " 1".join(letters[at: at + 20_000])):
            assert own.encode(text).tolist() == library.encode_ordinary(text)


def test_byte_strings_that_merges_do_not_reach(tmp_path):
    """A pre-token in the vocabulary is one id even where no merge leads to it."""
    import base64

    import tiktoken

    ranks = {bytes([b]): b for b in range(256)} | {b"xyz": 256, b"ab": 257, b"abab": 300, b"ba": 301}
    path = tmp_path / "own.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + f" {r}\n".encode() for t, r in ranks.items()))
    whole = tiktoken.Encoding("t", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = byte_bpe.Codec(str(path), public.PATTERN, pretokens.tiktoken_classes())
    for text in ("xyz", "xyzxyz", "abab", "ababa", "bababab"):
        assert codec.encode(text).tolist() == whole.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    path.write_bytes(base64.b64encode(b"a") + b" 0\n")
    with pytest.raises(ValueError):
        byte_bpe.Codec(str(path), public.PATTERN, {})


def test_columns(spark, library):
    rows = [*enumerate(TEXTS), *ODD, (3, TEXTS[3])]
    docs = documents(spark, rows).withColumn("ids", byte_bpe.encoded(F.col("text"), PATH, public.PATTERN))
    docs = docs.withColumn("back", byte_bpe.decoded(F.col("ids"), PATH, public.PATTERN))
    got = docs.select("doc_id", "ids", "back").collect()
    want = [(d, np.array(library.encode_ordinary(t or ""), dtype="<u4").tobytes(), (t or "").encode()) for d, t in rows]
    key = lambda r: (str(r[0]), hashlib.sha256(bytes(r[2])).digest())
    assert sorted([(r[0], bytes(r[1]), bytes(r[2])) for r in got], key=key) == sorted(want, key=key)
    none = documents(spark, [(1, None)]).filter("false")
    assert none.select(byte_bpe.encoded(F.col("text"), PATH, public.PATTERN)).count() == 0
    assert spark.range(1).select(byte_bpe.decoded(F.lit(None).cast("binary"), PATH, public.PATTERN).alias("b")).first()["b"] == b""
