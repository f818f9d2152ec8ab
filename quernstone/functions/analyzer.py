"""The analyzer: lower case, split, stop words, stems, accents, optionally without repeats.

`analyze` is a column expression. All of it but stemming is made of built-in functions; stems
come from one Arrow UDF over the whole array column, which stems each different word of a batch once.
`analyze_text` does the same to one string, for queries on the driver.
"""

from __future__ import annotations

import re
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernstone.errors import LanguageNotSupported
from quernstone.functions.stemmers import stem
from quernstone.functions.stopwords import stop_words

#: What tokens are made of, by language, as the inside of a character class (of lower-case text).
TOKEN_CHARACTERS = {
    "en": r"a-zàèéìòóù0-9_'\-",
    "es": r"a-z0-9á-úñü",
    "fr": r"a-z0-9äâàéèëêïîöôùüûœç\-",
    "hu": r"a-z0-9áéíóöőúüű",
    "no": r"a-z0-9_æøåäöü",
    "ru": r"a-z0-9а-яё",
    "sv": r"a-z0-9_åäö\-ü",
}
#: Accented letters that a language's tokens can have, and what they become.
FOLDS = {
    "en": ("àèéìòóù", "aeeioou"),
    "es": ("áâãäåçèéêëìíîïñòóôõöùúü", "aaaaaceeeeiiiinooooouuu"),
    "fr": ("àâäçèéêëîïôöùûü", "aaaceeeeiioouuu"),
    "hu": ("áéíóöúüőű", "aeioouuou"),
    "no": ("äåöü", "aaou"),
    "ru": ("йё", "ие"),
    "sv": ("äåöü", "aaou"),
}
LANGUAGES = tuple(sorted(TOKEN_CHARACTERS))
#: Tokens of a batch that are stemmed together: what a worker holds besides the batch doesn't grow with it.
STEMMED_AT_ONCE = 1 << 16


def is_supported(language: str) -> bool:
    return language in TOKEN_CHARACTERS


def check_language(language: str) -> str:
    if not is_supported(language):
        raise LanguageNotSupported(language)
    return language


@cache
def separators(language: str) -> str:
    """Regular expression of a run of characters between tokens; Java, Python and RE2 read it alike.

    Characters below 256 are named one by one: Java keeps these in one table, while each further range of a class
    makes it several times slower.
    """
    given = TOKEN_CHARACTERS[check_language(language)]
    return f"[^{_low(given)}{''.join(re.findall('[Ā-￿](?:-[Ā-￿])?', given))}]+"


def _low(given: str) -> str:
    named = re.compile(f"[{given}]")
    return "".join("\\-" if chr(n) == "-" else chr(n) for n in range(256) if named.match(chr(n)))


@cache
def stand_ins(language: str) -> tuple[str, str]:
    """The language's characters from 256 on, and as many below 256 that are in none of its tokens."""
    named = re.compile(f"[{TOKEN_CHARACTERS[check_language(language)]}]")
    high = "".join(chr(n) for n in range(256, 0x10000) if named.match(chr(n)))
    return high, "".join(chr(n) for n in range(128, 256) if not named.match(chr(n)))[: len(high)]


def split(text: Column, language: str) -> Column:
    """Tokens of the text as they are; a null text has none."""
    # one language a call: where a table has several, `analyze_by` picks
    low = F.lower(F.coalesce(text, F.lit("")))
    high, below = stand_ins(language)
    if len(high) < 2:
        return F.array_remove(F.split(low, separators(language), -1), "")
    # a class with several characters beyond Java's table takes ten times as long, so others stand for them; where these are in the text they separate
    low = F.translate(low, high + below, below + " " * len(below))
    tokens = F.array_remove(F.split(low, f"[^{_low(TOKEN_CHARACTERS[language])}{below}]+", -1), "")
    return F.transform(tokens, lambda t: F.translate(t, below, high))


def fold(token: Column, language: str) -> Column:
    return F.translate(token, *FOLDS[check_language(language)])


def _stemmer(language: str):
    @F.arrow_udf(T.ArrayType(T.StringType()))
    def stemmed(tokens: pa.Array) -> pa.Array:
        flat = tokens.flatten()
        parts = [stems_of(flat.slice(n, STEMMED_AT_ONCE), language) for n in range(0, len(flat), STEMMED_AT_ONCE)]
        lengths = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], lengths.cumsum()]), pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.concat_arrays(parts) if parts else pa.array([], pa.string()))

    return stemmed


def stems_of(words: pa.Array, language: str) -> pa.Array:
    """Each different word is stemmed once."""
    words = words.dictionary_encode()
    return pc.take(pa.array([stem(w, language) for w in words.dictionary.to_pylist()], pa.string()), words.indices)


def analyze(text: Column, language: str = "en", stemming: bool = True, stops: bool = True, duplicates: bool = True) -> Column:
    """Tokens of the text, in order."""
    out = split(text, language)
    if stops:
        words = sorted(stop_words(language))
        out = F.filter(out, lambda t: ~t.isin(words))
    if stemming:
        out = F.filter(F.transform(_stemmer(language)(out), lambda t: fold(t, language)), lambda t: t != "")
    else:
        # a text of as many bytes as characters has nothing to fold
        low = F.lower(text)
        out = F.when(F.octet_length(low) == F.length(low), out).otherwise(F.transform(out, lambda t: fold(t, language)))
    return out if duplicates else F.array_distinct(out)


def analyze_unfolded(text: Column, language: str) -> Column:
    """Stems of the text's tokens, with their accents."""
    return _stemmer(language)(split(text, language))


def analyze_by(text: Column, language: Column, languages: list[str], **options: bool) -> Column:
    """Tokens of texts in several languages: each by the analyzer of its own, those of other languages null."""
    languages = [check_language(x) for x in languages]
    if len(languages) == 1:
        return F.when(language == languages[0], analyze(text, languages[0], **options))
    # coalesce of columns that are null for texts of other languages, so that UDFs get no text twice
    return F.coalesce(*(F.when(language == x, analyze(F.when(language == x, text), x, **options)) for x in languages))


def analyze_text(text: str, language: str = "en", stemming: bool = True, stops: bool = True, duplicates: bool = True) -> list[str]:
    out = [t for t in re.split(separators(language), text.lower()) if t]
    if stops:
        words = stop_words(language)
        out = [t for t in out if t not in words]
    if stemming:
        out = [stem(t, language) for t in out]
    table = str.maketrans(*FOLDS[language])
    out = [f for t in out if (f := t.translate(table))]
    return out if duplicates else list(dict.fromkeys(out))
