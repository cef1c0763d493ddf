"""Batch encoding against the tokenizers library's plain call."""

import random

import public_tokenizers

from quillet.llm import tokens

FILES = (("byte_bpe_50k.json", "byte"), ("word_bpe_49k.json", "word"))


def plain_ids(name, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)]


def mixed_texts(n, seed=7):
    r = random.Random(seed)
    usual = [*"aabcdestvmrlLSTRE''''  \n\t\r__--..,019", *"éñßÄǅªºµ£€—…‘’‰÷×«»", "'s", "'ll", "'re ", " '", "''", "  ", "\n\n", " \n "]
    odd = ["<|endoftext|>", "日", " ", "İ", "²", "\x00", "𐐀"]
    return ["".join(r.choices(usual if r.random() < 0.8 else usual + odd, k=r.randint(0, 40))) for _ in range(n)]


def test_ids_as_the_plain_call():
    """Usual and other characters, blanks, endings, added tokens, and long words and texts."""
    texts = mixed_texts(4000) + tokens.usual() + [f"a{c}b {c}{c}" for c in tokens.usual()] + ["x" * 100_000, "word " * 50_000, "a'" * 3000]
    for name, style in FILES:
        assert [a.tolist() for a in tokens.Encoder(public_tokenizers.path(name), style).ids(texts)] == plain_ids(name, texts)


def test_encoder_starts_anew(monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 50)
    monkeypatch.setattr(tokens, "CHUNK", 500)
    texts = mixed_texts(300, 8)
    for name, style in FILES:
        own = tokens.Encoder(public_tokenizers.path(name), style)
        assert [a.tolist() for k in range(0, 300, 20) for a in own.ids(texts[k : k + 20])] == plain_ids(name, texts)
        assert len(own.words) < 200
