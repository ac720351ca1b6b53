import hashlib
from collections import Counter

import numpy as np
import pytest

from albumetry.llm import alignment, pretokens
from tests.llm.helpers import ODD, documents, text_of

public = pytest.importorskip("public_tokenizers")
A, B = public.path("byte_bpe_50k.json"), public.path("piece_bpe_32k.model")
TEXTS = ["Don't stop,  we'll", "  two   spaces ", " ", "a\n\n\tb\x00c", "日本語 Ünïcödé 🎉👍🏽 é", "<|endoftext|> <s> </s> <unk> <0x41>",
         "a▁b", "▁", "x " * 50, "q" * 3000, "  　 \xa0", "١٢٣ ½ ǅ", "ends\n", "\n"]


class Plain:
    """Whole texts by the libraries, then plain loops over all pairs of tokens."""

    def __init__(self):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=B)
        self.letters = {c: b for b, c in enumerate(pretokens.byte_letters())}

    def tokens(self, text):
        if not text:
            return [], []
        a = [(k, bytes(self.letters[c] for c in self.a.id_to_token(k))) for k in self.a.encode(" " + text, add_special_tokens=False).ids]
        b = []
        for k in self.b.encode(text):
            piece = self.b.id_to_piece(k)
            b.append((k, bytes([int(piece[3:5], 16)]) if self.b.is_byte(k) else piece.replace("▁", " ").encode()))
        raw = (" " + text).encode()
        return (a, b) if b"".join(x for _, x in a) == raw == b"".join(x for _, x in b) else ([], [])

    def align(self, text):
        a, b = self.tokens(text)

        def spans(tokens):
            out, at = [], 0
            for k, x in tokens:
                out.append((k, at, at + len(x)))
                at += len(x)
            return out

        a, b = spans(a), spans(b)
        links = [(x, y) for x, p, q in a for y, r, s in b if p < s and r < q]
        cuts = sorted({q for _, _, q in a} & {s for _, _, s in b})
        groups, low = [], 0
        for c in cuts:
            groups.append(",".join(str(x) for x, p, q in a if low < q <= c) + "|" + ",".join(str(y) for y, r, s in b if low < s <= c))
            low = c
        return len(a), len(b), len(cuts), links, ";".join(groups)


def brute(rows):
    plain = Plain()
    found = [(d, *plain.align(t)) for d, t in rows]
    count = Counter(link for *_, links, _ in found for link in links)
    best = {}
    for (_, y), n in count.items():
        best[y] = max(best.get(y, 0), n)
    out = [(d, a, b, g, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if a else "") for d, a, b, g, links, text in found]
    return out, {(x << 32) | y: n for (x, y), n in count.items()}


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, *map(str, r)))


@pytest.mark.parametrize("hot", [alignment.HOT, 7])
def test_alignment_equals_plain_loops(spark, hot, monkeypatch):
    monkeypatch.setattr(alignment, "PART", 200)  # holds for the driver's process alone; tasks take the whole size
    rows = [*enumerate(TEXTS), *ODD, (3, TEXTS[3]), (3, "other text of an id"), *[(50 + k, text_of(k, 60)) for k in range(20)]]
    docs = documents(spark, rows)
    got, pairs = alignment.align(docs, A, B, public.PATTERN, hot=hot)
    want, counts = brute(rows)
    assert order(tuple(r) for r in got.collect()) == order(want)
    assert {r["pair"]: r["count"] for r in pairs.collect()} == counts


def test_empty_table(spark):
    got, pairs = alignment.align(documents(spark, [(1, "a")]).filter("false"), A, B, public.PATTERN)
    assert got.count() == 0 and pairs.count() == 0


def test_parts_and_long_texts_agree(monkeypatch):
    own = alignment.Aligner(A, B, public.PATTERN, pretokens.tokenizers_classes())
    texts = [*TEXTS, None, "", text_of(1, 20_000), *TEXTS]
    whole = [(r, *x[:5], x[5].tolist(), x[6].tolist()) for r, *x in own.align(texts)]
    monkeypatch.setattr(alignment, "PART", 50)
    assert [(r, *x[:5], x[5].tolist(), x[6].tolist()) for r, *x in own.align(texts)] == whole


def test_every_letter_is_split_as_the_library_splits():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(A)
    whole.encode_special_tokens = True
    own = alignment.ByteLevel(A, public.PATTERN, pretokens.tokenizers_classes())
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(letters), 20_000):
        for text in (" a".join(letters[at: at + 20_000]), "1".join(letters[at: at + 20_000])):
            assert own.ids(text).tolist() == whole.encode(" " + text, add_special_tokens=False).ids


def test_gallop_finds_lower_bounds():
    rng = np.random.default_rng(3)
    for _ in range(200):
        longer = np.unique(rng.integers(0, 200, rng.integers(1, 60)))
        ends = np.sort(rng.integers(-5, 210, 20))
        first = rng.integers(0, len(longer), 20)
        last = np.maximum(first, rng.integers(0, len(longer) + 1, 20))
        got = alignment.galloped(ends, longer, first, last, rng.integers(-3, len(longer) + 3, 20))
        assert got.tolist() == [f + int(np.searchsorted(longer[f:z], e)) for e, f, z in zip(ends, first, last)]
