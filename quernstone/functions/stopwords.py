"""Stop words by language, as data: `stop_words.tsv` has a language and a word on each line."""

from __future__ import annotations

from functools import cache
from importlib.resources import files


@cache
def stop_words(language: str) -> frozenset[str]:
    lines = files("quernstone.functions").joinpath("stop_words.tsv").read_text(encoding="utf-8").split("\n")
    return frozenset(word for code, _, word in (line.partition("\t") for line in lines) if code == language)
