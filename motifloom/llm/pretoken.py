"""The splitter that stands before the merges of the byte-level vocabularies."""

from __future__ import annotations

import re
from itertools import chain

import regex
import tiktoken
from public_tokenizers import PATTERN

SPLIT = regex.compile(PATTERN)


def pretokens(text: str) -> list[str]:
    return SPLIT.findall(text)


def is_restart(before: str, after: str) -> bool:
    """Whether splitting always restarts between these two characters.

    No alternative of the pattern has white space after a character that is not white space, and none looks
    back, so a match ends before the white space and the next begins there whatever stands further away.
    """
    return not before.isspace() and after.isspace() and after not in "\x1c\x1d\x1e\x1f"


#: A blank after a character that is no white space (nor the mark that stands for blanks in sentencepiece models), and
#: not at the end: splitting restarts there (is_restart).
SEAM = re.compile("(?<=[^\\s\u2581]) (?=[\\s\\S])")
#: Longer texts go to the library piece by piece.
LONG = 1 << 15


def seamed(text: str) -> list[str]:
    """A long text in runs of about LONG characters that end at seams, so that encoding the runs encodes the text."""
    out, at = [], 0
    while len(text) - at > 2 * LONG and (found := SEAM.search(text, at + LONG)):
        out.append(text[at : found.start()])
        at = found.start()
    return [*out, text[at:]]


def encode_ordinary(coder: tiktoken.Encoding, text: str) -> list[int]:
    """As the library's encode_ordinary, whose own splitter overflows its stack on long runs of white space."""
    if len(text) <= 2 * LONG:  # a run of seamed()
        return coder.encode_ordinary(text)
    return list(chain.from_iterable(map(coder._encode_single_piece, SPLIT.findall(text))))
