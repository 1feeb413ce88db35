"""The default English stop words, shared by the engine and its SQL checks.

The list is the one of the common keyword vectoriser (fixed values, in ``stop_words_en.txt``); every
operator takes another list as its ``stop_words`` parameter.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path


@lru_cache
def english_stop_words() -> list[str]:
    return Path(__file__).with_name("stop_words_en.txt").read_text(encoding="utf-8").split()
