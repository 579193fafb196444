"""Splitting of texts into the pieces that byte-level BPE encodes one by one."""

from __future__ import annotations

import functools
import re
from collections.abc import Callable

# The white space that the pattern's \s stands for (Unicode White_Space).
WHITE = "\t-\r \x85\xa0  -     　"


@functools.cache
def _ranges(kind: str) -> str:
    """Code points of a general category (L or N) as ranges of a character class."""
    import regex

    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    return "".join(
        re.escape(m[0][0]) + "-" + re.escape(m[0][-1])
        for run in regex.finditer(rf"\p{{{kind}}}+", everything)
        # the jump over the surrogates must not become a range
        for m in re.finditer("[^-\U0010ffff]+|[-\U0010ffff]+", run[0])
    )


@functools.cache
def splitter(pattern: str) -> Callable[[str], list[str]]:
    """``findall`` of ``pattern`` by the standard library's engine.

    Its own classes for letters, digits and white space are fast, and differ from the pattern's categories
    on few characters; a text that has one of those is split with the categories written out in full.
    """
    letters, numbers = _ranges("L"), _ranges("N")

    def compiled(rest: str, letter: str, number: str, space: str, other: str) -> re.Pattern:
        text = pattern
        for old, new in ((r"[^\s\p{L}\p{N}]", rest), (r"\p{L}", letter), (r"\p{N}", number), (r"\S", other), (r"\s", space)):
            text = text.replace(old, new)
        return re.compile(text)

    full = compiled(f"[^{WHITE}{letters}{numbers}]", f"[{letters}]", f"[{numbers}]", f"[{WHITE}]", f"[^{WHITE}]").findall
    fast = compiled(r"(?:[^\s\w]|_)", r"[^\W\d_]", r"\d", r"\s", r"\S").findall
    everything = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    differ: set[str] = set()
    for own, theirs in ((f"[{letters}]", r"[^\W\d_]"), (f"[{numbers}]", r"\d"), (f"[{WHITE}]", r"\s")):
        differ |= set(re.findall(own, everything)) ^ set(re.findall(theirs, everything))
    return lambda text: fast(text) if differ.isdisjoint(text) else full(text)


class Memory:
    """What is known of at most ``kept`` words: what is used stays, what is not used for long goes."""

    def __init__(self, kept: int):
        self.kept, self.young, self.old = kept, {}, {}

    def learn(self, words: set[str], make: Callable[[list[str]], list]) -> None:
        """Put all of ``words`` into ``young``; ``make`` is asked for those that are not remembered."""
        if len(self.young) + len(words) > self.kept // 2:
            self.old, self.young = self.young, {}
        again = words & self.old.keys()
        self.young.update((w, self.old[w]) for w in again)
        new = sorted(words - again)
        self.young.update(zip(new, make(new), strict=True))
