"""Text statistics that the quality operators share, of whole texts."""

from __future__ import annotations

import re

SYMBOL = re.compile(rb"[#*$%&|<>]")
WINDOW = 3


def base_stats(text: str | None) -> tuple[list[bytes], int, int, int, int]:
    """Words (runs without the ASCII blanks), code points in them, symbols, lines with a word that equal an earlier line, words in repeated WINDOW-word windows."""
    raw = (text or "").encode("utf-8", "replace")
    words = raw.split()
    joined = b"".join(words)
    chars = len(joined) if joined.isascii() else len(joined.decode())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    windows = list(zip(*(words[i:] for i in range(WINDOW)), strict=False))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts: dict = {}
        for w in windows:
            counts[w] = counts.get(w, 0) + 1
        done = 0  # words before it are counted or can't be
        for i, w in enumerate(windows):
            if counts[w] > 1:
                repeated += i + WINDOW - max(i, done)
                done = i + WINDOW
    return words, chars, len(SYMBOL.findall(raw)), len(lines) - len(set(lines)), repeated
