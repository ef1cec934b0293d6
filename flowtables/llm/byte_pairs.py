"""Splitting texts into pieces that byte-level byte-pair tokenizers treat independently.

A space before a non-space character always starts a new pre-token, so a text may be
cut there and each piece looked up in a cache. Counting and encoding share this.
"""

from __future__ import annotations

import re

#: Python's white space holds all that the tokenizers call white space, so a cut here is safe.
BEFORE_WORD = re.compile(r" (?=\S)")
UNSAFE = re.compile(r" \s|\s\Z")

#: Fixed value: the pre-token pattern of the byte-level tokenizers.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def cut(text: str) -> tuple[str, list[str]]:
    """The text up to its first cut, and the pieces after the cuts without their leading space."""
    pieces = BEFORE_WORD.split(text) if UNSAFE.search(text) else text.split(" ")
    return pieces[0], pieces[1:]


def byte_alphabet() -> list[str]:
    """The visible character that stands for each byte in the vocabulary files.

    Printable Latin-1 characters stand for themselves, the other bytes for the
    characters from 256 on, in order.
    """
    shown, spare = [], 256
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte <= 255:
            shown.append(chr(byte))
        else:
            shown.append(chr(spare))
            spare += 1
    return shown


def locate(name: str) -> str:
    """The path of a public tokenizer file; a path is taken as it is."""
    if "/" in name:
        return name
    import public_tokenizers
    return str(public_tokenizers.path(name))
