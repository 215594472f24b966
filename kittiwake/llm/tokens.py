"""Words of texts."""

from __future__ import annotations

import re

_WORD = re.compile(r"[^\W_]+")


def text_words(text: str | None) -> list[str]:
    """Longest runs of letters and digits in lower case."""
    return _WORD.findall(text.lower()) if text else []
