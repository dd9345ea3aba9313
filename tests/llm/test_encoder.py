"""The packing's encoder gives the ids of the tokenizers library on texts of any mixture."""

import random
import sys

import numpy as np

sys.path.insert(0, "/opt/tokenizers")

from loomlight.llm import bin_packing, chunks  # noqa: E402

PARTS = ["a", "the", " ", "  ", "\n", "\t", "\r", "\xa0", "é", "ß", "中", "<|endoftext|>", "<|", "|>", "'s", "1", "234", "😀", "　", "-", "\x00", "\x85", "ŉ", "“", "\xad", "​"]


def test_mixed_texts():
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    model = chunks.byte_tokenizer(paths[0])
    chosen = random.Random(7)
    texts = ["", " ", *("".join(chosen.choices(PARTS, k=chosen.randrange(25))) for _ in range(4000)), "the 中 " * 5000]
    for text, ids in zip(texts, bin_packing.encode_ids(texts, *paths), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == model.encode(text, add_special_tokens=False).ids, repr(text)
