"""Words of whole texts as bytes, for operators that count or match them in tasks."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Characters of a text that are cut into words at once.
STRETCH = 1 << 20


def stretches(raw: bytes, word: re.Pattern[bytes], size: int = STRETCH) -> Iterator[list[bytes]]:
    """The words of a text, A-Z in lower case, some at a time: a stretch ends where a word does.

    ``word`` is a class of bytes, repeated.  Bytes of other alphabets are 128 and above, and lower() changes none of them.
    """
    raw, at = raw.lower(), 0
    while at < len(raw):
        end = at + size
        if end < len(raw) and (rest := word.match(raw, end)):
            end = rest.end()
        yield word.findall(raw, at, end)
        at = end
