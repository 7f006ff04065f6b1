"""The pre-split against the library, over every code point."""

import numpy as np
import public_tokenizers
import tokenizers

from lorewell.llm import presplit


def test_every_code_point_splits_as_the_library_does():
    library = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).pre_tokenizer
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(points), 20_000):
        text = "".join(f"\x01a{chr(c)}1 {chr(c)}'s" for c in points[i : i + 20_000])
        raw = text.encode()
        at, first = presplit.split(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        lead = np.flatnonzero((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)
        expected = [start for _, (start, _) in library.pre_tokenize_str(text)]
        assert np.searchsorted(lead, at).tolist() == sorted(set(expected)), hex(points[i])
        assert first.tolist() == [0, len(at)]
