"""Secret scans: Aho-Corasick keywords, anchored regular expressions near hits, checksums.

One automaton of the keywords of all rules goes over the whole text. Only where it hits is
a rule's regular expression tried, anchored at the keyword. A match of a rule with a
checksum counts only if that is right: CRC32 in base 62 of GitHub and npm tokens, Luhn
digits, ISO 7064 mod 97-10 of IBANs, the header of a JWT, the outer DER length of a private key
(of an OPENSSH key its magic, of a legacy encrypted one whole cipher blocks). A secret may be of any length:
expressions go on while their class of characters lasts, and none is tried twice over the same run.

Defined results:
- A row for each match: id, rule, start and length in characters, and whether a checksum
  confirmed it (`checked`; false for rules that have none). The secret itself isn't returned.
- Matches of a rule don't overlap: the one that begins first counts; what fails its checksum is no match and hides none. Those of different rules may.
- Null and empty texts have no matches; texts of any length are scanned whole. Ids may repeat, as
  rows may; every row is scanned. Empty tables give empty results; other columns don't matter, whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quernstone.llm.runtime import pick

_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_token(token: str) -> bool:
    """The last six characters are the CRC32, in base 62, of those between the prefix and them."""
    body, digits = token.split("_", 1)[1][:-6], token[-6:]
    value = 0
    for c in digits:
        value = value * 62 + _BASE62.index(c)
    return value == zlib.crc32(body.encode())


def luhn(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()][::-1]
    return sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(digits)) % 10 == 0 and len(set(digits)) > 1


def iban(text: str) -> bool:
    text = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in text[4:] + text[:4])) % 97 == 1


def jwt(token: str) -> bool:
    head = token.split(".", 1)[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, TypeError):
        return False


def key_block(block: str) -> bool:
    """The body is base64 of one DER sequence of just that length, of an OPENSSH key, or, legacy encrypted, of whole cipher blocks."""
    lines = re.sub(r"-----[^-]+-----", "", block)
    try:
        raw = base64.b64decode(re.sub(r"[\w-]+:[^\r\n]*|\s", "", lines), validate=True)
    except (binascii.Error, ValueError):
        return False
    if "BEGIN OPENSSH" in block:
        return raw.startswith(b"openssh-key-v1\0")
    if "Proc-Type:" in lines:
        return len(raw) % 8 == 0
    if len(raw) < 4 or raw[0] != 0x30:
        return False
    size, head = (raw[1], 2) if raw[1] < 128 else (int.from_bytes(raw[2 : 2 + raw[1] - 128], "big"), 2 + raw[1] - 128)
    return size + head == len(raw)


@dataclass(frozen=True)
class Rule:
    """The expression is matched where a keyword begins; so each of its matches must begin with one."""

    name: str
    keywords: tuple[str, ...]
    expression: str
    checksum: Callable[[str], bool] | None = None
    #: Characters within which other ends (at the end of a word) are tried if the checksum is wrong; 0: there are none.
    span: int = 0


#: Length of each country's numbers, without spaces.
_IBAN = {c[:2]: int(c[2:]) for c in "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20".split()}
_IBANS = "|".join(rf"{c}\d\d" + " ?[A-Z0-9]{4}" * (n // 4 - 1) + " ?[A-Z0-9]{%d}" % (n % 4) * (n % 4 > 0) for c, n in _IBAN.items())
#: First four digits that card networks issue.
_ISSUED = r"4|5[0-8]|2(?:22[1-9]|2[3-9]|[3-6]|7[01]|720)|3(?:0[0-5]|[46-9]|5(?:2[89]|[3-8]))|6(?:011|2|3|4[4-9]|5|7)"
_ISSUERS = tuple(n for n in (f"{n:04}" for n in range(10_000)) if re.match(_ISSUED, n))
_ASSIGNED = ("token", "secret", "password", "passwd", "api_key", "apikey", "api-key", "access_key")

RULES = (
    Rule("github_token", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), r"(?<!\w)gh[pousr]_[A-Za-z0-9]{36}(?!\w)", crc_token),
    Rule("github_fine_grained", ("github_pat_",), r"(?<!\w)github_pat_[A-Za-z0-9]{22}_[A-Za-z0-9]{59}(?!\w)"),
    Rule("npm_token", ("npm_",), r"(?<!\w)npm_[A-Za-z0-9]{36}(?!\w)", crc_token),
    Rule("aws_access_key", ("AKIA", "ASIA"), r"(?<!\w)A[KS]IA[A-Z2-7]{16}(?!\w)"),
    Rule("google_api_key", ("AIza",), r"(?<!\w)AIza[0-9A-Za-z_-]{35}(?![\w-])"),
    Rule("slack_token", ("xoxb-", "xoxp-", "xoxa-", "xoxr-", "xoxs-"), r"(?<![\w-])xox[baprs]-[0-9A-Za-z-]{20,}+(?!\w)"),
    Rule("stripe_key", ("sk_live_", "rk_live_", "sk_test_", "rk_test_"), r"(?<!\w)[sr]k_(?:live|test)_[0-9A-Za-z]{24,}+(?!\w)"),
    Rule("jwt", ("eyJ",), r"(?<![\w-])eyJ[\w-]{8,}+\.[\w-]{8,}+\.[\w-]{8,}+", jwt),
    Rule("private_key", ("-----BEGIN ",), r"-----BEGIN ((?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?)PRIVATE KEY-----(?:\s*+(?:Proc-Type|DEK-Info|Comment):[^\r\n]*+)*+[A-Za-z0-9+/=\s]{40,}+-----END \1PRIVATE KEY-----", key_block),
    # in quotes anything; without quotes letters and digits, both
    Rule("assigned_secret", tuple(v for k in _ASSIGNED for v in (k, k.upper(), k.capitalize())), r"(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|[Pp]asswd|PASSWD|[Aa]pi[_-]?key|API[_-]?KEY|[Aa]ccess_key|ACCESS_KEY)(?:[\"']?\s{0,4}[:=]\s{0,4}(?:\"[^\"'\s]{16,}+\"|'[^\"'\s]{16,}+')|=(?=[A-Za-z+/_.~-]*+\d)(?=[\d+/_.~-]*+[A-Za-z])[A-Za-z0-9+/_.~-]{16,}+={0,2}+(?![^\s;,&\"']))"),
    Rule("payment_card", _ISSUERS, rf"(?<![\w.-])(?=(?:{_ISSUED})\d)(?:4\d{{3}}(?:[ -]?\d{{3}}){{3}}|3[47]\d\d[ -]?\d{{6}}[ -]?\d{{5}}|3[0689]\d\d[ -]?\d{{6}}[ -]?\d{{4}}|[2-6]\d{{3}}(?:[ -]?\d{{4}}){{2}}(?:[ -]?\d{{2,7}}))(?![\w])", luhn, 22),
    Rule("iban", tuple(f"{c}{d}" for c in _IBAN for d in range(10)), rf"(?<!\w)(?:{_IBANS})(?!\w)", iban),
)


@lru_cache(maxsize=4)
def _compiled(rules: tuple[Rule, ...]) -> tuple[ahocorasick.Automaton, list[re.Pattern]]:
    by_word: dict[str, list[int]] = {}
    for n, rule in enumerate(rules):
        for w in rule.keywords:
            by_word.setdefault(w, []).append(n)
    automaton = ahocorasick.Automaton()
    for w, which in by_word.items():
        automaton.add_word(w, (len(w), tuple(which)))
    automaton.make_automaton()
    return automaton, [re.compile(r.expression) for r in rules]


def scan(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[tuple[str, int, int, bool]]:
    """(rule, start, length, checked) of each match in the text, by start and rule."""
    if not text:
        return []
    automaton, expressions = _compiled(rules)
    hits = {(n, end - size + 1) for end, (size, which) in automaton.iter(text) for n in which}
    out, free = [], [0] * len(rules)
    for n, start in sorted(hits):
        if start < free[n]:
            continue
        found = expressions[n].match(text, start)
        check = rules[n].checksum
        if found and check and not check(found[0]):
            found = _other_end(text, start, expressions[n], rules[n])
        if found:
            free[n] = found.end()
            out.append((rules[n].name, start, found.end() - start, check is not None))
    return sorted(out, key=lambda m: (m[1], m[0]))


def _other_end(text: str, start: int, expression: re.Pattern, rule: Rule) -> re.Match | None:
    """The longest match from start on whose checksum is right."""
    for end in range(min(len(text), start + rule.span), start, -1):
        if end == len(text) or not (text[end].isalnum() or text[end] == "_"):
            found = expression.fullmatch(text, start, end)
            if found and rule.checksum(found[0]):
                return found
    return None


def secrets(docs: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(key, rule, start, length, checked) of every match in every row of docs."""
    rows = pick(docs, key=key, text=text)
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), T.StructField("rule", T.StringType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("checked", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for n, value in enumerate(batch.column(1)):
                for m in scan(value.as_py(), rules):
                    at.append(n)
                    found.append(m)
            if at:
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *(pa.array(list(c), t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.int64(), pa.bool_())))], names=schema.names)

    return rows.mapInArrow(run, schema)
