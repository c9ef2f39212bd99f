"""Word lists from a JSON file in place of the built-in ones."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

from . import lines, text

# Keys of the file. section_headers maps kinds to names; the others are lists of patterns or words.
KEYS = {"company_suffixes_regex": (text, "COMPANY"), "title_words_regex": (text, "TITLES"), "degree_words_regex": (text, "DEGREES"), "nav_terms_regex": (lines, "NAVIGATION"), "internship_words": (text, "INTERNSHIPS"), "section_headers": (text, "SECTIONS")}


def load(path: str) -> dict:
    """The lists of a file; unknown keys are left alone, so that a file can hold more."""
    with open(path, encoding="utf-8") as f:
        found = json.load(f)
    return {k: {kind: tuple(n.lower() for n in names) for kind, names in v.items()} if k == "section_headers" else "|".join(v) for k, v in found.items() if k in KEYS}


@contextmanager
def using(words: dict) -> Iterator[None]:
    """Inside the block, columns are built with these lists; those not given stay as they are. The lists go into the
    plans, so a DataFrame built inside keeps them."""
    before = {k: getattr(module, name) for k, (module, name) in KEYS.items()}
    try:
        for k, value in words.items():
            setattr(*KEYS[k], value)
        yield
    finally:
        for k, value in before.items():
            setattr(*KEYS[k], value)
