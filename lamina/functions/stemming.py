"""French stems by the published Snowball rules.

A word is a stem and endings. Three regions say how much of a word an ending must leave: RV begins after
the first vowel that is not the first letter (or after the third letter of a word that begins with two
vowels, or with one of three listed beginnings), R1 after the first consonant that follows a vowel, R2 is R1 of
R1. Vowels that act as consonants are written as capitals while a word is worked on.
"""

from __future__ import annotations

import re
from collections.abc import Callable

# Letters and endings of the published rules.
VOWELS = "aeiouyâàëéêèïîôûù"
BEGINNINGS = ("par", "col", "tap")
NOUN_ENDINGS = {
    "remove": ("ance", "iqUe", "isme", "able", "iste", "eux", "ances", "iqUes", "ismes", "ables", "istes"),
    "agent": ("atrice", "ateur", "ation", "atrices", "ateurs", "ations"),
    "log": ("logie", "logies"),
    "u": ("usion", "ution", "usions", "utions"),
    "ent": ("ence", "ences"),
    "ement": ("ement", "ements"),
    "ité": ("ité", "ités"),
    "if": ("if", "ive", "ifs", "ives"),
    "eaux": ("eaux",),
    "aux": ("aux",),
    "euse": ("euse", "euses"),
    "issement": ("issement", "issements"),
    "amment": ("amment",),
    "emment": ("emment",),
    "ment": ("ment", "ments"),
}
I_VERB_ENDINGS = (
    "îmes", "ît", "îtes", "i", "ie", "ies", "ir", "ira", "irai", "iraIent", "irais", "irait", "iras", "irent", "irez", "iriez",
    "irions", "irons", "iront", "is", "issaIent", "issais", "issait", "issant", "issante", "issantes", "issants", "isse",
    "issent", "isses", "issez", "issiez", "issions", "issons", "it",
)
ER_VERB_ENDINGS = (
    "é", "ée", "ées", "és", "èrent", "er", "era", "erai", "eraIent", "erais", "erait", "eras", "erez", "eriez", "erions",
    "erons", "eront", "ez", "iez",
)
A_VERB_ENDINGS = (
    "âmes", "ât", "âtes", "a", "ai", "aIent", "ais", "ait", "ant", "ante", "antes", "ants", "as", "asse", "assent", "asses",
    "assiez", "assions",
)
LAST_ENDINGS = ("ion", "ier", "ière", "Ier", "Ière", "e")
KEEPS_S = "aiouès"
DOUBLED = ("enn", "onn", "ett", "ell", "eill")

_V = f"[{VOWELS}]"
_PRELUDE = re.compile(f"{_V}[ui]{_V}|{_V}y|ë|ï|y{_V}|qu")
_RV = re.compile(f"{_V}{_V}.|{'|'.join(BEGINNINGS)}|.[^{VOWELS}]*{_V}", re.S)
_R = re.compile(f"[^{VOWELS}]*{_V}+[^{VOWELS}]", re.S)
_ACCENT = re.compile(f"[éè](?=[^{VOWELS}]+$)", re.S)
_NOUN = {ending: kind for kind, endings in NOUN_ENDINGS.items() for ending in endings}


def _longest(endings) -> Callable[[str, int], str | None]:
    """Finds the longest of ``endings`` that lies behind ``start`` in a word."""
    sizes = sorted({len(e) for e in endings}, reverse=True)
    known = frozenset(endings)

    def find(word: str, start: int = 0) -> str | None:
        for size in sizes:
            if len(word) - size >= start and word[len(word) - size:] in known:
                return word[len(word) - size:]
        return None

    return find


_noun, _i_verb, _last = _longest(_NOUN), _longest(I_VERB_ENDINGS), _longest(LAST_ENDINGS)
_verb = _longest(("ions", *ER_VERB_ENDINGS, *A_VERB_ENDINGS))


def _capital(match: re.Match) -> str:
    found = match.group()
    if found in ("ë", "ï"):
        return "He" if found == "ë" else "Hi"
    if len(found) == 3:
        return found[0] + found[1].upper() + found[2]
    if found[1] == "y" and found[0] in VOWELS or found == "qu":
        return found[0] + found[1].upper()
    return "Y" + found[1]


class _Word:
    """A word at work: its letters and where its regions begin."""

    def __init__(self, word: str):
        self.text = _PRELUDE.sub(_capital, word)
        size = len(self.text)
        rv = _RV.match(self.text)
        self.rv = rv.end() if rv else size
        r1 = _R.match(self.text)
        self.r1 = r1.end() if r1 else size
        r2 = _R.match(self.text, self.r1)
        self.r2 = r2.end() if r2 else size

    def ends(self, ending: str) -> bool:
        return self.text.endswith(ending)

    def put(self, ending: str, instead: str = "", region: int = 0) -> bool:
        """Replaces ``ending`` if the word has it and it begins in ``region``."""
        at = len(self.text) - len(ending)
        if not self.text.endswith(ending) or at < region:
            return False
        self.text = self.text[:at] + instead
        return True

    def vowel_before(self, ending: str, region: int = 0) -> bool | None:
        """Whether the letter before ``ending`` is a vowel; None if it lies before ``region``."""
        at = len(self.text) - len(ending) - 1
        return None if at < region else self.text[at] in VOWELS


def _noun_step(w: _Word) -> bool:
    """Endings of nouns and adjectives; True if the step is done."""
    ending = _noun(w.text)
    if ending is None:
        return False
    kind = _NOUN[ending]
    if kind == "remove":
        return w.put(ending, "", w.r2)
    if kind in ("log", "u", "ent"):
        return w.put(ending, kind, w.r2)
    if kind == "eaux":
        return w.put(ending, "eau")
    if kind == "aux":
        return w.put(ending, "al", w.r1)
    if kind == "euse":
        return w.put(ending, "", w.r2) or w.put(ending, "eux", w.r1)
    if kind == "issement":
        return w.vowel_before(ending) is False and w.put(ending, "", w.r1)
    if kind == "agent":
        done = w.put(ending, "", w.r2)
        if done and w.ends("ic"):
            w.put("ic", "", w.r2) or w.put("ic", "iqU")
        return done
    if kind == "if":
        done = w.put(ending, "", w.r2)
        if done and w.put("at", "", w.r2) and w.ends("ic"):
            w.put("ic", "", w.r2) or w.put("ic", "iqU")
        return done
    if kind == "ité":
        done = w.put(ending, "", w.r2)
        if done and w.ends("abil"):
            w.put("abil", "", w.r2) or w.put("abil", "abl")
        elif done and w.ends("ic"):
            w.put("ic", "", w.r2) or w.put("ic", "iqU")
        elif done:
            w.put("iv", "", w.r2)
        return done
    if kind == "ement":
        done = w.put(ending, "", w.rv)
        if done and w.ends("iv"):
            if w.put("iv", "", w.r2):
                w.put("at", "", w.r2)
        elif done and w.ends("eus"):
            w.put("eus", "", w.r2) or w.put("eus", "eux", w.r1)
        elif done and (w.ends("abl") or w.ends("iqU")):
            w.put("abl", "", w.r2) or w.put("iqU", "", w.r2)
        elif done and (w.ends("ièr") or w.ends("Ièr")):
            w.put("ièr", "i", w.rv) or w.put("Ièr", "i", w.rv)
        return done
    # The adverbs lose their ending and go on as verbs.
    if kind == "ment":
        if w.vowel_before(ending, w.rv):
            w.put(ending)
    else:
        w.put(ending, "ant" if kind == "amment" else "ent", w.rv)
    return False


def _i_verb_step(w: _Word) -> bool:
    ending = _i_verb(w.text, w.rv)
    if ending is None or w.vowel_before(ending, w.rv) is not False or w.text[len(w.text) - len(ending) - 1] == "H":
        return False
    return w.put(ending)


def _verb_step(w: _Word) -> bool:
    ending = _verb(w.text, w.rv)
    if ending is None:
        return False
    if ending == "ions":
        return w.put(ending, "", w.r2)
    w.put(ending)
    if ending in A_VERB_ENDINGS:
        w.put("e", "", w.rv)
    return True


def _last_step(w: _Word) -> None:
    if w.ends("s") and len(w.text) > 1 and (w.text[-3:-1] == "Hi" or w.text[-2] not in KEEPS_S):
        w.put("s")
    ending = _last(w.text, w.rv)
    if ending == "ion":
        before = len(w.text) - 4
        if before >= w.rv and w.text[before] in "st":
            w.put(ending, "", w.r2)
    elif ending == "e":
        w.put(ending)
    elif ending:
        w.put(ending, "i")


def french_stem(word: str) -> str:
    """The stem of a lower-case word."""
    w = _Word(word)
    if _noun_step(w) or _i_verb_step(w) or _verb_step(w):
        w.put("Y", "i") or w.put("ç", "c")
    else:
        _last_step(w)
    if w.text.endswith(DOUBLED):
        w.text = w.text[:-1]
    text = _ACCENT.sub("e", w.text)
    for capital, small in (("I", "i"), ("U", "u"), ("Y", "y"), ("He", "ë"), ("Hi", "ï"), ("H", "")):
        text = text.replace(capital, small)
    return text
