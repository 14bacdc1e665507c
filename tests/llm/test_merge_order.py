"""Words in which a merge may make a pair of a lower rank: the round of all minimum pairs against the library."""

import base64
import random

import public_tokenizers
import tiktoken

from rippletrace.llm import bpe
from rippletrace.llm.queries import tokenizer


def test_rows_with_parts_of_higher_rank():
    path, _ = tokenizer()
    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    parts = []
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None and max(left, right) > rank:
                parts.append((token, token[:k], token[k:]))
    assert len(parts) > 10_000  # the vocabulary has such rows, so the order of merges matters in principle
    rng, words = random.Random(5), set()
    for token, left, right in parts:
        for raw in (token, left + right + right, left + left + right, right + token, token + token, token + rng.choice(parts)[0] + left):
            try:
                words.add(raw.decode())
            except UnicodeDecodeError:
                continue
    words = rng.sample(sorted(words), 40_000)
    coder = bpe.Coder(path, r"(?s).+")
    library = tiktoken.Encoding("own", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})
    try:
        for at in range(0, len(words), 5000):
            some = words[at : at + 5000]
            for word, (_, ids, decoded) in zip(some, coder.encode(some)):
                assert ids == " ".join(map(str, library.encode_ordinary(word))) and decoded == word.encode()
    finally:
        coder.close()
        bpe._held.clear()
