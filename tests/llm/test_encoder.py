"""The encoder of whole texts against the tokenizer itself."""

import random

import numpy as np
import public_tokenizers

from wattloom.llm import tokens

PATH = public_tokenizers.path("word_bpe_49k.json")
PARTS = [*"abzAZ059'.,!-_<|> \t\n\r\x0b\x0c\x1c\x85\x00\x7f\xa0", "À", "Ö", "×", "Ø", "÷", "ÿ", "ß", "ª", "Ā", "漢", "́", "é", "　", "İ", "ſ", "'s", "'ll", "<|endoftext|>", "word", "Élan"]


def test_pieces_give_the_ids_of_whole_texts(monkeypatch):
    monkeypatch.setattr(tokens.Encoder, "CACHED", 300)
    monkeypatch.setattr(tokens.Encoder, "TOGETHER", 7)
    rng = random.Random(11)
    texts = ["", " ", "×", "'", "a", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(30))) for _ in range(3000))]
    encoder = tokens.Encoder(PATH)
    got = [ids for i in range(0, len(texts), 200) for ids in encoder.encode([t.encode() for t in texts[i: i + 200]])]
    assert [g.tolist() for g in got] == [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.encode([]) == [] and [g.tolist() for g in encoder.encode([b"", b"\n"])] == [[], []]


def test_a_worker_keeps_its_encoder():
    assert tokens.encoder_of(PATH) is tokens.encoder_of(PATH)


def test_words_that_do_not_come_apart_are_encoded_singly():
    encoder = tokens.Encoder(PATH)
    odd = [b"one", b"two three", "漢字".encode()]
    assert [np.frombuffer(b, "<u4").tolist() for b in encoder.together(odd)] == [encoder.tokenizer.encode(p.decode(), add_special_tokens=False).ids for p in odd]
