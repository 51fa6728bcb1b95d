"""Spellings of one word reach the tokenizer's model once, and get the ids of the whole text."""

import random
import struct

import public_tokenizers
import pyarrow as pa
import pytest

from tidemark.llm import tokens

WORDS = ["word", "Word", "WORD,", "word$$$", "word,###", "word***", "Été", "été%%%", "don't", "a,b", "$5", "x's,", "İx!", "ßß&&&&&&"]


@pytest.mark.parametrize(("name", "space", "most"), [("word_bpe_49k.json", False, 4), ("byte_bpe_50k.json", True, 7)])
def test_spellings_of_a_word(monkeypatch, name, space, most):
    encode = tokens.WordEncoder(public_tokenizers.path(name), space)
    asked, letters, whole = [], tokens._Words._letters, tokens._Words._ids
    monkeypatch.setattr(tokens._Words, "_letters", lambda self, w: (asked.append(w), letters(self, w))[1])
    for text in [" ".join(["of", *WORDS]), *WORDS]:
        assert encode(text) == struct.pack(f"<{len(ids := encode.tokenizer.encode(text, add_special_tokens=False).ids)}I", *ids)
    asked.clear()
    encode = tokens.WordEncoder(public_tokenizers.path(name), space)
    asked.clear()
    encoded = []
    monkeypatch.setattr(tokens._Words, "_ids", lambda self, t: (encoded.append(t), whole(self, t))[1])
    encode(" ".join(["of", *WORDS[:8]]))
    assert len(asked) <= most and set(encoded) <= {",", "$$$", ",###", "***", "%%%"}


ODD = ["", None, " ", "\t\n", "the end", "á Å, ́b", "it's I'M", "<|endoftext|>x </w>", "a b", "a b c\x1cd \x0bx\x0c", "×÷ a×B Ã\u0097", "ßẞŸÿ µ ª", "日本, ΑΣ", "İI", "\U0001f600!a", "-- (x) 3,4", "ÀÉ" * 40]


def packed(encode, text):
    return struct.pack(f"<{len(ids := encode.tokenizer.encode(text or '', add_special_tokens=False).ids)}I", *ids)


@pytest.mark.parametrize("block", [1, 40, 8_000_000])
def test_blocks_of_texts(block):
    rng = random.Random(block)
    pieces = ["a", "Z", "qu", "é", "É", "×", "́", ",", "#", "'s", " ", " ", "\n", "7", " ", "İ", "Σ", "-", "</w>"]
    texts = [*ODD, *("".join(rng.choices(pieces, k=rng.randrange(1, 30))) for _ in range(400)), *ODD]
    encode = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), False, 10)
    encode.runs.block = block
    want = [packed(encode, x) for x in texts]
    assert list(encode.each(pa.array(texts))) == want
    assert list(encode.each(pa.array(["left out", *texts], pa.large_string()).slice(1))) == want
    if block < 100:
        assert len(encode.runs.known) < 150  # the table is bounded


def test_a_block_asks_for_its_distinct_runs_together(monkeypatch):
    encode = tokens.WordEncoder(public_tokenizers.path("word_bpe_49k.json"), False)
    asked, letters = [], tokens.Runs._letters
    monkeypatch.setattr(tokens.Runs, "_letters", lambda self, runs: (asked.append([x.decode() for x in runs.to_pylist()]), letters(self, runs))[1])
    monkeypatch.setattr(tokens.WordEncoder, "__call__", None)
    monkeypatch.setattr(tokens._Words, "__missing__", None)
    for _ in range(2):
        list(encode.each(pa.array(["Qword, zword\nQWORD###", "zword qWord, Éqz éqz###"])))
    first, again = asked
    assert {"###", "qword", "zword", "éqz"} <= set(first) and len(first) == len(set(first)) <= 5 and not again


def test_each_text_where_spaces_count():
    encode = tokens.WordEncoder(public_tokenizers.path("byte_bpe_50k.json"), True)
    assert encode.runs is None
    assert list(encode.each(pa.array(ODD))) == [packed(encode, x) for x in ODD]
