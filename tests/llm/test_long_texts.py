"""BPE of texts of megabytes: as the library, with work that grows with the text, and a memory bounded by bytes."""

import random

import numpy as np
import pytest
import public_tokenizers
from tokenizers import Tokenizer

from relcheck.llm import bpe


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_joins_are_linear(name):
    dice = random.Random(1)
    words = ["".join(dice.choice("abcdeéüs") for _ in range(dice.randrange(1, 9))) for _ in range(3000)]
    text = "".join(dice.choice(words) + dice.choice([" ", " ", "\n", ", ", "  "]) for _ in range(400_000))
    path = public_tokenizers.path(name)
    codec, library = bpe.Codec(path), Tokenizer.from_file(path)
    own = bpe.chunks(text)
    given = [{"seq": k, "ids": np.array(codec.ids(c), np.uint32).tobytes()} for k, c in enumerate(own) if k % 5]
    again = []
    ids = codec.ids
    codec.ids = lambda t: again.append(len(t)) or ids(t)
    got = bpe.whole(codec, text, given, True)
    want = library.encode(text, add_special_tokens=False).ids
    assert len(text) > 2_000_000 and len(own) > 1000
    assert got == (len(want), " ".join(map(str, want)), library.decode(want, skip_special_tokens=False))
    between = sum(len(c) for k, c in enumerate(own) if k % 5 == 0)
    assert sum(again) < between + 700 * len(own)  # joins: some hundred characters each, wherever they are


@pytest.mark.parametrize("text", ["0123456789abcdef" * 20_000, "日本語の文章です" * 8_000, "x" * 9000 + " " + "y" * 9000 + " end"])
def test_texts_without_spaces_are_encoded_outright(text, monkeypatch):
    monkeypatch.setattr(bpe, "chunks", lambda t: [t[k : k + 700] for k in range(0, len(t), 700)])
    path = public_tokenizers.path("word_bpe_49k.json")
    codec = bpe.Codec(path)
    given = [{"seq": k, "ids": np.array(codec.ids(c), np.uint16).tobytes()} for k, c in enumerate(bpe.chunks(text)) if k % 2]
    want = Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids
    assert bpe.whole(codec, text, given, False)[:2] == (len(want), " ".join(map(str, want)))


def test_memory_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_BYTES", 20_000)
    codec = bpe.Codec(public_tokenizers.path("word_bpe_49k.json"))
    codec.learn([" ".join(f"w{k}x" for k in range(5000)) + " " + "z" * 5000])
    assert len(codec.memo) < 70 and codec.room <= 0 and len(codec.recent) > 4900
    assert "z" * 5000 in codec.recent and len(codec.ids("w1x w4999x " + "z" * 100)) > 2
