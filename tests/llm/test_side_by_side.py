import random

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from mergewell.llm import bpe

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def test_few_words_are_encoded_alone(monkeypatch):
    """10,000 new words took a walk in Python each: 1,128 CPU seconds a GB of 900."""
    m, rng, alone = bpe.Automaton(BYTE), random.Random(31), []
    encode_word = m.encode_word
    monkeypatch.setattr(m, "encode_word", lambda word: alone.append(word) or encode_word(word))
    labels = [label.decode(errors="ignore") for label in m.by_bytes]
    words = ["".join(rng.choices(labels, k=3)) for _ in range(5000)] + ["".join(rng.choices("etaoinshé", k=9)) for _ in range(5000)]
    text = " ".join(words)
    first = m.digest(text)
    assert len(alone) < 1000
    ids = Tokenizer.from_file(BYTE).encode(text, add_special_tokens=False).ids
    assert first == m._digest(np.array(ids, dtype=np.uint32)) and m.encode(text) == ids


def test_arcs_of_many_pairs():
    m, rng = bpe.Automaton(BYTE, compiled=1500), random.Random(32)
    pairs = [tuple(rng.choices(list(m.time), k=2)) for _ in range(5000)] + rng.sample(list(m.merged), 5000)
    pairs += [(a, b) for t, (u, v) in rng.sample(list(m.parts.items()), 5000) for a, b in ((u, t), (t, u), (t, v), (v, t), (t, t))]
    last, token = np.array(pairs, dtype=np.int32).T
    assert m._follows(last, token).tolist() == [m.arc(a, t) for a, t in pairs]
