"""Texts for the tests of this folder."""

from __future__ import annotations

import random

WORDS = "the sun and moon over river stone light house tree garden winter morning quiet road paper music green silver bridge market window summer letter number field harbour engine".split()


def prose(rng: random.Random, n: int, words: list[str] = WORDS) -> str:
    return " ".join(rng.choice(words) for _ in range(n))


#: Nulls, empty and blank texts, a text without letters, odd white space, special strings and one long text.
ODD = [None, "", "   \n\t ", "12 34 !!", "a", "A b c  d\n\ne\tf", "<|endoftext|> don't stop", "日本語 テキスト", "x" * 70, "word " * 30_000]
