"""Token ids against the public library around every character that either side may take for white space."""

import sys

from cohortloom.llm import token_files
from cohortloom.llm.queries import tokenizer_file


def test_white_space():
    encoder = token_files.WordEncoder(tokenizer_file("word_bpe_49k.json"))
    assert encoder.by_word
    odd = {chr(c) for c in range(sys.maxunicode + 1) if chr(c).isspace()} | {*map(chr, range(0x21)), "\x7f", "\x85", "\u180e", "\u200b", "\u2060", "\ufeff"}
    texts = [f"one{c}two three.{c}{c}four" for c in sorted(odd)] + ["", "one\x1ctwo"]
    for text, ids in zip(texts, encoder.encode_batch(texts), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, ascii(text)
