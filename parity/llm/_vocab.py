"""Where the public vocabularies are, and the pattern that cuts texts into pre-tokens."""

from __future__ import annotations

import re

import regex

#: White space as Unicode has it, and as the pattern's \s means it (Python's own \s also takes in four controls).
SPACE = r"\t-\r \x85\xa0  -     　"
#: Letters and numbers below U+0100.
LETTERS = r"A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = r"0-9\xb2\xb3\xb9\xbc-\xbe"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def splitter(pattern: str | None = None):
    """A function from a text to its pre-tokens by ``pattern`` (public_tokenizers.PATTERN by default)."""
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    inside = re.sub(r"\[\^\\s", lambda _: f"[^{SPACE}", pattern)
    inside = inside.replace(r"\S", f"[^{SPACE}]").replace(r"\s", f"[{SPACE}]")
    general = regex.compile(inside).findall
    # The same pattern where all characters are below U+0100, which the faster library can take.
    narrow = re.compile(inside.replace(f"[^{SPACE}\\p{{L}}\\p{{N}}]", f"[^{SPACE}{LETTERS}{NUMBERS}]").replace(r"\p{L}", f"[{LETTERS}]").replace(r"\p{N}", f"[{NUMBERS}]")).findall
    below = re.compile(r"[^\x00-\xff]").search

    def split(text: str) -> list[str]:
        return general(text) if below(text) else narrow(text)

    return split
