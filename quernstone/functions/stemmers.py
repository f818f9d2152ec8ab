"""Snowball stemmers for seven languages, written from the published descriptions of the algorithms.

Pure functions of a lower-case word. `stem(word, language)` keeps a memo of its own, so that
in a worker each different word is stemmed once or a few times.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import lru_cache


def _longest(word: str, suffixes: Iterable[str], start: int = 0) -> str | None:
    """The longest of the suffixes that the word ends with at or behind start."""
    best = None
    for s in suffixes:
        if (best is None or len(s) > len(best)) and len(word) - len(s) >= start and word.endswith(s):
            best = s
    return best


def _region(word: str, vowels: str, start: int = 0) -> int:
    """Where the part after the first non-vowel that follows a vowel begins."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


# English (Porter 2)

_EN_VOWELS = "aeiouy"
_EN_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EN_SPECIAL = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl",
    "sky": "sky", "news": "news", "howe": "howe", "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
_EN_AFTER_1A = frozenset("inning outing canning herring earring proceed exceed succeed".split())
_EN_2 = {
    "tional": "tion", "enci": "ence", "anci": "ance", "abli": "able", "entli": "ent", "izer": "ize", "ization": "ize",
    "ational": "ate", "ation": "ate", "ator": "ate", "alism": "al", "aliti": "al", "alli": "al", "fulness": "ful",
    "ousli": "ous", "ousness": "ous", "iveness": "ive", "iviti": "ive", "biliti": "ble", "bli": "ble", "ogi": "og",
    "fulli": "ful", "lessli": "less", "li": "",
}
_EN_3 = {"tional": "tion", "ational": "ate", "alize": "al", "icate": "ic", "iciti": "ic", "ical": "ic", "ful": "", "ness": "", "ative": ""}
_EN_4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion".split()


def _en_short_end(w: str) -> bool:
    """Ends in a short syllable."""
    if len(w) == 2:
        return w[0] in _EN_VOWELS and w[1] not in _EN_VOWELS
    return len(w) > 2 and w[-1] not in _EN_VOWELS + "wxY" and w[-2] in _EN_VOWELS and w[-3] not in _EN_VOWELS


def english(word: str) -> str:
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").replace("‘", "'").replace("‛", "'")
    if w.startswith("'"):
        w = w[1:]
    if w in _EN_SPECIAL:
        return _EN_SPECIAL[w]
    w = "".join("Y" if c == "y" and (i == 0 or w[i - 1] in _EN_VOWELS) else c for i, c in enumerate(w))
    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = _region(w, _EN_VOWELS) if r1 is None else r1
    r2 = _region(w, _EN_VOWELS, r1)
    # 0
    s = _longest(w, ("'s'", "'s", "'"))
    w = w[: -len(s)] if s else w
    # 1a
    s = _longest(w, ("sses", "ied", "ies", "us", "ss", "s"))
    if s == "sses":
        w = w[:-2]
    elif s in ("ied", "ies"):
        w = w[: -2 if len(w) > 4 else -1]
    elif s == "s" and any(c in _EN_VOWELS for c in w[:-2]):
        w = w[:-1]
    if w in _EN_AFTER_1A:
        return w
    # 1b
    s = _longest(w, ("eedly", "eed", "ingly", "edly", "ing", "ed"))
    if s in ("eed", "eedly"):
        if len(w) - len(s) >= r1:
            w = w[: -len(s)] + "ee"
    elif s and any(c in _EN_VOWELS for c in w[: -len(s)]):
        w = w[: -len(s)]
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif w.endswith(_EN_DOUBLES):
            w = w[:-1]
        elif r1 >= len(w) and _en_short_end(w):
            w += "e"
    # 1c
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _EN_VOWELS:
        w = w[:-1] + "i"
    # 2
    s = _longest(w, _EN_2)
    if s and len(w) - len(s) >= r1:
        if s == "ogi":
            w = w[:-1] if w[-4:-3] == "l" else w
        elif s == "li":
            w = w[:-2] if w[-3:-2] and w[-3] in "cdeghkmnrt" else w
        else:
            w = w[: -len(s)] + _EN_2[s]
    # 3
    s = _longest(w, _EN_3)
    if s and len(w) - len(s) >= r1 and (s != "ative" or len(w) - len(s) >= r2):
        w = w[: -len(s)] + _EN_3[s]
    # 4
    s = _longest(w, _EN_4)
    if s and len(w) - len(s) >= r2 and (s != "ion" or w[-4:-3] in ("s", "t")):
        w = w[: -len(s)]
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _en_short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")


# Scandinavian

_SV_VOWELS = "aeiouyäåö"
_SV_1 = "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast".split()


def _scandinavian_r1(w: str, vowels: str) -> int:
    return max(3, _region(w, vowels)) if len(w) >= 3 else len(w)


def swedish(word: str) -> str:
    w, r1 = word, _scandinavian_r1(word, _SV_VOWELS)
    s = _longest(w, [*_SV_1, "s"], r1)
    if s == "s":
        w = w[:-1] if len(w) > 1 and w[-2] in "bcdfghjklmnoprtvy" else w
    elif s:
        w = w[: -len(s)]
    if _longest(w, ("dd", "gd", "nn", "dt", "gt", "kt", "tt"), r1):
        w = w[:-1]
    s = _longest(w, ("lig", "ig", "els", "löst", "fullt"), r1)
    if s in ("löst", "fullt"):
        w = w[:-1]
    elif s:
        w = w[: -len(s)]
    return w


_NO_VOWELS = "aeiouyæåø"
_NO_1 = "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast".split()


def norwegian(word: str) -> str:
    w, r1 = word, _scandinavian_r1(word, _NO_VOWELS)
    s = _longest(w, [*_NO_1, "s", "erte", "ert"], r1)
    if s in ("erte", "ert"):
        w = w[: -len(s)] + "er"
    elif s == "s":
        if len(w) > 1 and (w[-2] in "bcdfghjlmnoprtvyz" or (w[-2] == "k" and len(w) > 2 and w[-3] not in _NO_VOWELS)):
            w = w[:-1]
    elif s:
        w = w[: -len(s)]
    if _longest(w, ("dt", "vt"), r1):
        w = w[:-1]
    s = _longest(w, "leg eleg ig eig lig elig els lov elov slov hetslov".split(), r1)
    return w[: -len(s)] if s else w


# Romance

def _romance_rv(w: str, vowels: str) -> int:
    """Spanish and its like."""
    if len(w) < 3:
        return len(w)
    if w[1] not in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] in vowels), len(w))
    if w[0] in vowels:
        return next((i + 1 for i in range(2, len(w)) if w[i] not in vowels), len(w))
    return 3


_ES_VOWELS = "aeiouáéíóúü"
_ES_0 = "me se sela selo selas selos la le lo las les los nos".split()
_ES_BEFORE = "iéndo ándo ár ér ír ando iendo ar er ir".split()
_ES_PLAIN = str.maketrans("áéíóú", "aeiou")
_ES_1 = {
    "plain": "anza anzas ico ica icos icas ismo ismos able ables ible ibles ista istas oso osa osos osas amiento amientos imiento imientos".split(),
    "ic": "adora ador ación adoras adores aciones ante antes ancia ancias".split(),
    "log": "logía logías".split(), "u": "ución uciones".split(), "ente": "encia encias".split(), "amente": ["amente"],
    "mente": ["mente"], "idad": "idad idades".split(), "iv": "iva ivo ivas ivos".split(),
}
_ES_1_OF = {s: k for k, group in _ES_1.items() for s in group}
_ES_2A = "ya ye yan yen yeron yendo yo yó yas yes yais yamos".split()
_ES_2B_GU = "en es éis emos".split()
_ES_2B = (
    "arían arías arán arás aríais aría aréis aríamos aremos ará aré erían erías erán erás eríais ería eréis eríamos eremos erá eré "
    "irían irías irán irás iríais iría iréis iríamos iremos irá iré aba ada ida ía ara iera ad ed id ase iese aste iste an aban ían aran ieran "
    "asen iesen aron ieron ado ido ando iendo ió ar er ir as abas adas idas ías aras ieras ases ieses ís áis abais íais arais ierais aseis "
    "ieseis asteis isteis ados idos amos ábamos íamos imos áramos iéramos iésemos ásemos"
).split()


def spanish(word: str) -> str:
    w = word
    rv, r1 = _romance_rv(w, _ES_VOWELS), _region(w, _ES_VOWELS)
    r2 = _region(w, _ES_VOWELS, r1)
    # 0: attached pronouns
    s = _longest(w, _ES_0)
    if s:
        head = w[: -len(s)]
        b = _longest(head, [*_ES_BEFORE, "yendo"])
        if b == "yendo":
            if len(head) - len(b) >= rv and head[-6:-5] == "u":
                w = head
        elif b and len(head) - len(b) >= rv:
            w = head[: -len(b)] + b.translate(_ES_PLAIN)
    # 1: standard suffixes
    before = w
    s = _longest(w, _ES_1_OF)
    kind, at = _ES_1_OF.get(s), len(w) - len(s or "")
    if kind == "plain" and at >= r2:
        w = w[:at]
    elif kind == "ic" and at >= r2:
        w = w[:at]
        w = w[:-2] if _longest(w, ["ic"], r2) else w
    elif kind == "log" and at >= r2:
        w = w[:at] + "log"
    elif kind == "u" and at >= r2:
        w = w[:at] + "u"
    elif kind == "ente" and at >= r2:
        w = w[:at] + "ente"
    elif kind == "amente" and at >= r1:
        w = w[:at]
        t = _longest(w, ("iv", "os", "ic", "ad"), r2)
        if t:
            w = w[: -len(t)]
            w = w[:-2] if t == "iv" and _longest(w, ["at"], r2) else w
    elif kind == "mente" and at >= r2:
        w = w[:at]
        t = _longest(w, ("ante", "able", "ible"), r2)
        w = w[: -len(t)] if t else w
    elif kind == "idad" and at >= r2:
        w = w[:at]
        t = _longest(w, ("abil", "ic", "iv"), r2)
        w = w[: -len(t)] if t else w
    elif kind == "iv" and at >= r2:
        w = w[:at]
        w = w[:-2] if _longest(w, ["at"], r2) else w
    # 2: verb suffixes
    if w == before:
        s = _longest(w, _ES_2A, rv)
        if s and w[: -len(s)].endswith("u"):
            w = w[: -len(s)]
        else:
            s = _longest(w, [*_ES_2B, *_ES_2B_GU], rv)
            if s:
                w = w[: -len(s)]
                w = w[:-1] if s in _ES_2B_GU and w.endswith("gu") else w
    # 3: residual suffixes
    s = _longest(w, "os a o á í ó e é".split(), rv)
    if s:
        w = w[: -len(s)]
        if s in ("e", "é") and w.endswith("gu") and len(w) - 1 >= rv:
            w = w[:-1]
    return w.translate(_ES_PLAIN)


_FR_VOWELS = "aeiouyâàëéêèïîôûù"
_FR_1 = {
    "plain": "ance iqUe isme able iste eux ances iqUes ismes ables istes".split(),
    "ic": "atrice ateur ation atrices ateurs ations".split(), "log": "logie logies".split(), "u": "usion ution usions utions".split(),
    "ent": "ence ences".split(), "ement": "ement ements".split(), "ité": "ité ités".split(), "if": "if ive ifs ives".split(),
    "eaux": ["eaux"], "aux": ["aux"], "euse": "euse euses".split(), "issement": "issement issements".split(),
    "amment": ["amment"], "emment": ["emment"], "ment": "ment ments".split(),
}
_FR_1_OF = {s: k for k, group in _FR_1.items() for s in group}
_FR_2A = (
    "îmes ît îtes i ie ies ir ira irai iraIent irais irait iras irent irez iriez irions irons iront is issaIent issais issait "
    "issant issante issantes issants isse issent isses issez issiez issions issons it"
).split()
_FR_2B_E = "é ée ées és èrent er era erai eraIent erais erait eras erez eriez erions erons eront ez iez".split()
_FR_2B_A = "âmes ât âtes a ai aIent ais ait ant ante antes ants as asse assent asses assiez assions".split()


def _fr_marked(w: str) -> str:
    out = list(w)
    for i, c in enumerate(w):
        before, after = w[i - 1] if i else "", w[i + 1] if i + 1 < len(w) else ""
        if c in "ui" and before and after and before in _FR_VOWELS and out[i - 1] in _FR_VOWELS and after in _FR_VOWELS:
            out[i] = c.upper()
        elif c == "y" and ((before and before in _FR_VOWELS) or (after and after in _FR_VOWELS)):
            out[i] = "Y"
        elif c == "u" and before == "q":
            out[i] = "U"
    return "".join(out)


def french(word: str) -> str:
    w = _fr_marked(word)
    if w.startswith(("par", "col", "tap")):
        rv = 3
    elif len(w) >= 3 and w[0] in _FR_VOWELS and w[1] in _FR_VOWELS:
        rv = 3
    else:
        rv = next((i + 1 for i in range(1, len(w)) if w[i] in _FR_VOWELS), len(w))
    r1 = _region(w, _FR_VOWELS)
    r2 = _region(w, _FR_VOWELS, r1)

    def cut_from(x: str, n: int, start: int, otherwise: str | None) -> str:
        """x without its last n letters if they are in the region from start; else with `otherwise` instead of them, if given."""
        return x[:-n] if len(x) - n >= start else (x if otherwise is None else x[:-n] + otherwise)

    start = w
    verbs = False
    s = _longest(w, _FR_1_OF)
    kind, at = _FR_1_OF.get(s), len(w) - len(s or "")
    if kind == "plain" and at >= r2:
        w = w[:at]
    elif kind == "ic" and at >= r2:
        w = w[:at]
        w = cut_from(w, 2, r2, "iqU") if w.endswith("ic") else w
    elif kind == "log" and at >= r2:
        w = w[:at] + "log"
    elif kind == "u" and at >= r2:
        w = w[:at] + "u"
    elif kind == "ent" and at >= r2:
        w = w[:at] + "ent"
    elif kind == "ement" and at >= rv:
        w = w[:at]
        t = _longest(w, ("iv", "eus", "abl", "iqU", "ièr", "Ièr"))
        here = len(w) - len(t or "")
        if t == "iv" and here >= r2:
            w = w[:-2]
            w = w[:-2] if _longest(w, ["at"], r2) else w
        elif t == "eus":
            w = w[:-3] if here >= r2 else (w[:-1] + "x" if here >= r1 else w)
        elif t in ("abl", "iqU") and here >= r2:
            w = w[:-3]
        elif t in ("ièr", "Ièr") and here >= rv:
            w = w[:-3] + "i"
    elif kind == "ité" and at >= r2:
        w = w[:at]
        t = _longest(w, ("abil", "ic", "iv"))
        if t == "abil":
            w = cut_from(w, 4, r2, "abl")
        elif t == "ic":
            w = cut_from(w, 2, r2, "iqU")
        elif t == "iv":
            w = cut_from(w, 2, r2, None)
    elif kind == "if" and at >= r2:
        w = w[:at]
        if _longest(w, ["at"], r2):
            w = w[:-2]
            w = cut_from(w, 2, r2, "iqU") if w.endswith("ic") else w
    elif kind == "eaux":
        w = w[:-1]
    elif kind == "aux" and at >= r1:
        w = w[:-2] + "l"
    elif kind == "euse":
        w = w[:at] if at >= r2 else (w[:at] + "eux" if at >= r1 else w)
    elif kind == "issement" and at >= r1 and at > 0 and w[at - 1] not in _FR_VOWELS:
        w = w[:at]
    elif kind == "amment" and at >= rv:
        w, verbs = w[:at] + "ant", True
    elif kind == "emment" and at >= rv:
        w, verbs = w[:at] + "ent", True
    elif kind == "ment" and at - 1 >= rv and w[at - 1] in _FR_VOWELS:
        w, verbs = w[:at], True
    changed = w != start
    if not changed or verbs:
        here = w
        s = _longest(w, _FR_2A, rv)
        if s and len(w) - len(s) - 1 >= rv and w[-len(s) - 1] not in _FR_VOWELS:
            w = w[: -len(s)]
        if w == here:
            s = _longest(w, [*_FR_2B_E, *_FR_2B_A, "ions"], rv)
            if s == "ions":
                w = w[:-4] if len(w) - 4 >= r2 else w
            elif s in _FR_2B_E:
                w = w[: -len(s)]
            elif s:
                w = w[: -len(s)]
                w = w[:-1] if w.endswith("e") and len(w) - 1 >= rv else w
        changed = changed or w != here
        third = w != here or (verbs and changed)
    else:
        third = True
    if third:
        w = w[:-1] + "i" if w.endswith("Y") else (w[:-1] + "c" if w.endswith("ç") else w)
    else:
        if len(w) > 1 and w[-1] == "s" and w[-2] not in "aiouès":
            w = w[:-1]
        s = _longest(w, ("ier", "ière", "Ier", "Ière", "ion", "e", "ë"), rv)
        if s == "ion":
            w = w[:-3] if len(w) - 3 >= r2 and len(w) - 4 >= rv and w[-4] in "st" else w
        elif s == "e":
            w = w[:-1]
        elif s == "ë":
            w = w[:-1] if w.endswith("guë") and len(w) - 3 >= rv else w
        elif s:
            w = w[: -len(s)] + "i"
    if w.endswith(("enn", "onn", "ett", "ell", "eill")):
        w = w[:-1]
    # the last vowel that has only consonants behind it
    for i in range(len(w) - 1, -1, -1):
        if w[i] in _FR_VOWELS:
            if w[i] in "éè" and i < len(w) - 1:
                w = w[:i] + "e" + w[i + 1 :]
            break
    return w.lower()


# Russian

_RU_VOWELS = "аеиоуыэюя"
_RU_GERUND_1, _RU_GERUND_2 = "в вши вшись".split(), "ив ивши ившись ыв ывши ывшись".split()
_RU_ADJECTIVE = "ее ие ые ое ими ыми ей ий ый ой ем им ым ом его ого ему ому их ых ую юю ая яя ою ею".split()
_RU_PARTICIPLE_1, _RU_PARTICIPLE_2 = "ем нн вш ющ щ".split(), "ивш ывш ующ".split()
_RU_VERB_1 = "ла на ете йте ли й л ем н ло но ет ют ны ть ешь нно".split()
_RU_VERB_2 = "ила ыла ена ейте уйте ите или ыли ей уй ил ыл им ым ен ило ыло ено ят ует уют ит ыт ены ить ыть ишь ую ю".split()
_RU_NOUN = "а ев ов ие ье е иями ями ами еи ии и ией ей ой ий й иям ям ием ем ам ом о у ах иях ях ы ь ию ью ю ия ья я".split()


def _ru_group(w: str, rv: int, first: list[str], second: list[str]) -> str | None:
    """The longest ending of either group; those of the first need а or я before them, which stays."""
    s = _longest(w, [*first, *second], rv)
    if s is None:
        return None
    if s in second:
        return s
    at = len(w) - len(s)
    return s if at - 1 >= rv and w[at - 1] in "ая" else None


def russian(word: str) -> str:
    w = word.replace("ё", "е")
    rv = next((i + 1 for i, c in enumerate(w) if c in _RU_VOWELS), len(w))
    r1 = _region(w, _RU_VOWELS)
    r2 = _region(w, _RU_VOWELS, r1)
    s = _ru_group(w, rv, _RU_GERUND_1, _RU_GERUND_2)
    if s:
        w = w[: -len(s)]
    else:
        s = _longest(w, ("ся", "сь"), rv)
        w = w[:-2] if s else w
        s = _longest(w, _RU_ADJECTIVE, rv)
        if s:
            w = w[: -len(s)]
            s = _ru_group(w, rv, _RU_PARTICIPLE_1, _RU_PARTICIPLE_2)
            w = w[: -len(s)] if s else w
        else:
            s = _ru_group(w, rv, _RU_VERB_1, _RU_VERB_2) or _longest(w, _RU_NOUN, rv)
            w = w[: -len(s)] if s else w
    w = w[:-1] if w.endswith("и") and len(w) - 1 >= rv else w
    s = _longest(w, ("ост", "ость"), r2)
    w = w[: -len(s)] if s else w
    s = _longest(w, ("ейше", "ейш"), rv)
    if s:
        w = w[: -len(s)]
    if w.endswith("нн") and len(w) - 2 >= rv:
        w = w[:-1]
    elif not s and w.endswith("ь") and len(w) - 1 >= rv:
        w = w[:-1]
    return w


# Hungarian

_HU_VOWELS = "aeiouáéíóöőúüű"
_HU_DIGRAPHS = ("cs", "gy", "ly", "ny", "sz", "ty", "zs")
_HU_DOUBLES = "bb cc ccs dd ff gg ggy jj kk ll lly mm nn nny pp rr ss ssz tt tty vv zz zzs".split()
_HU_CASES = (
    "ban ben ba be ra re nak nek val vel tól től ról ről ból ből hoz hez höz nál nél ig at et ot öt ért képp képpen kor ul ül vá vé onként enként "
    "anként ként en on an ön n t"
).split()
_HU_PLAIN = str.maketrans("áé", "ae")


def _hu_undouble(w: str) -> str:
    """Without the second last letter if the word ends in a double consonant."""
    s = _longest(w, _HU_DOUBLES)
    return w[:-2] + w[-1] if s and len(s) == 2 else (w[: -len(s)] + s[1:] if s else w)


def _hu_replaced(w: str, r1: int, rules: dict[str, str]) -> str:
    s = _longest(w, rules)
    return w[: -len(s)] + rules[s] if s and len(w) - len(s) >= r1 else w


def _hu_rules(plain: str, a: str = "", e: str = "") -> dict[str, str]:
    return {**{s: "" for s in plain.split()}, **{s: "a" for s in a.split()}, **{s: "e" for s in e.split()}}


_HU_4 = _hu_rules("astul estül stul stül", "ástul", "éstül")
_HU_OWNED = _hu_rules("oké öké aké eké ké éi é", "áké áéi", "éké ééi éé")
_HU_SINGULAR_OWNER = _hu_rules(
    "ünk unk nk juk jük uk ük em om am m od ed ad öd d ja je a e o", "ánk ájuk ám ád á", "énk éjük ém éd é"
)
_HU_PLURAL_OWNER = _hu_rules(
    "jaim jeim aim eim im jaid jeid aid eid id jai jei ai ei i jaink jeink eink aink ink jaitok jeitek aitok eitek itek jeik jaik aik eik ik",
    "áim áid ái áink áitok áik", "éim éid éi éink éitek éik"
)
_HU_PLURAL = _hu_rules("ök ok ek ak k", "ák", "ék")


def hungarian(word: str) -> str:
    w = word
    if w and w[0] in _HU_VOWELS:
        at = next((i for i in range(1, len(w)) if w[i] not in _HU_VOWELS), None)
        if at is None:
            r1 = len(w)
        else:
            r1 = at + (3 if w.startswith("dzs", at) else 2 if w.startswith(_HU_DIGRAPHS, at) else 1)
    else:
        r1 = next((i + 1 for i, c in enumerate(w) if c in _HU_VOWELS), len(w))
    # instrumental
    s = _longest(w, ("al", "el"))
    if s and len(w) - 2 >= r1 and _longest(w[:-2], _HU_DOUBLES):
        w = _hu_undouble(w[:-2])
    # frequent cases
    s = _longest(w, _HU_CASES)
    if s and len(w) - len(s) >= r1:
        w = w[: -len(s)]
        if len(w) - 1 >= r1 and w.endswith(("á", "é")):
            w = w[:-1] + w[-1].translate(_HU_PLAIN)
    # special cases
    w = _hu_replaced(w, r1, {"án": "a", "ánként": "a", "én": "e"})
    w = _hu_replaced(w, r1, _HU_4)
    # factive
    s = _longest(w, ("á", "é"))
    if s and len(w) - 1 >= r1 and _longest(w[:-1], _HU_DOUBLES):
        w = _hu_undouble(w[:-1])
    for rules in (_HU_OWNED, _HU_SINGULAR_OWNER, _HU_PLURAL_OWNER, _HU_PLURAL):
        w = _hu_replaced(w, r1, rules)
    return w


STEMMERS = {"en": english, "es": spanish, "fr": french, "hu": hungarian, "no": norwegian, "ru": russian, "sv": swedish}


@lru_cache(maxsize=1 << 17)
def stem(word: str, language: str) -> str:
    return STEMMERS[language](word)
