"""Sound codes and stems of English words. They run once per distinct word, in Arrow batches."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOWELS = "AEIOU"


def metaphone(word: str, longest: int = 12) -> str:
    """The Metaphone code of a word, at most ``longest`` characters."""
    w = re.sub("[^A-Z]", "", word.upper())
    for head, to in (("AE", "E"), ("GN", "N"), ("KN", "N"), ("PN", "N"), ("WR", "R"), ("X", "S"), ("WH", "W")):
        if w.startswith(head):
            w = to + w[len(head) :]
            break
    out: list[str] = []
    i, n = 0, len(w)
    at = lambda k: w[k] if 0 <= k < n else ""
    while i < n and sum(map(len, out)) < longest:
        c, b, d = w[i], at(i - 1), at(i + 1)
        step = 1
        if c == b and c != "C":
            pass
        elif c in VOWELS:
            if i == 0:
                out.append(c)
        elif c == "B":
            if not (b == "M" and i == n - 1):
                out.append("B")
        elif c == "C":
            if d and d in "EIY":
                if d == "I" and at(i + 2) == "A":
                    out.append("X")
                elif b != "S":
                    out.append("S")
            elif d == "H":
                out.append("K" if b == "S" else "X")
                step = 2
            else:
                out.append("K")
        elif c == "D":
            soft = d == "G" and at(i + 2) != "" and at(i + 2) in "EIY"
            out.append("J" if soft else "T")
            step = 2 if soft else 1
        elif c == "G":
            if d == "H" and not (i + 2 < n and at(i + 2) not in VOWELS):
                if i == 0 or i + 2 < n:
                    out.append("K")
                step = 2
            elif d == "H" or (d == "N" and (i + 2 == n or w[i + 2 :] == "ED")):
                pass
            else:
                out.append("J" if d and d in "EIY" and b != "G" else "K")
        elif c == "H":
            if d and d in VOWELS and (b == "" or b not in "CGPST"):
                out.append("H")
        elif c == "K":
            if b != "C":
                out.append("K")
        elif c == "P":
            out.append("F" if d == "H" else "P")
            step = 2 if d == "H" else 1
        elif c == "Q":
            out.append("K")
        elif c == "S":
            if d == "H":
                out.append("X")
                step = 2
            elif d == "I" and at(i + 2) != "" and at(i + 2) in "AO":
                out.append("X")
            elif d == "C" and at(i + 2) == "H":
                out.append("SK")
                step = 3
            else:
                out.append("S")
        elif c == "T":
            if d == "I" and at(i + 2) != "" and at(i + 2) in "AO":
                out.append("X")
            elif d == "H":
                out.append("0")
                step = 2
            elif not (d == "C" and at(i + 2) == "H"):
                out.append("T")
        elif c == "V":
            out.append("F")
        elif c in "WY":
            if d and d in VOWELS:
                out.append(c)
        elif c == "X":
            out.append("KS")
        elif c == "Z":
            out.append("S")
        else:  # F J L M N R
            out.append(c)
        i += step
    return "".join(out)[:longest]


def double_metaphone(word: str, longest: int = 4) -> tuple[str, str]:
    """The main and the other code of a word under Double Metaphone; they are equal where there is one reading."""
    w = re.sub("[^A-Z]", "", word.upper())
    n, one, two = len(w), [], []
    slavic = any(x in w for x in ("W", "K", "CZ", "WITZ"))
    at = lambda k: w[k] if 0 <= k < n else ""
    has = lambda k, *forms: any(0 <= k and w.startswith(f, k) for f in forms)

    def add(a: str, b: str | None = None) -> None:
        one.append(a)
        two.append(a if b is None else b)

    i = 1 if has(0, "GN", "KN", "PN", "WR", "PS") else 0
    if at(0) == "X":
        add("S")
        i = 1
    while i < n and (len("".join(one)) < longest or len("".join(two)) < longest):
        c = w[i]
        step = 2 if at(i + 1) == c and c not in "CGHWX" + VOWELS + "Y" else 1
        if c in VOWELS + "Y":
            if i == 0:
                add("A")
        elif c == "B":
            add("P")
        elif c == "C":
            if has(i, "CHIA"):
                add("K")
                step = 2
            elif i == 0 and has(i, "CAESAR"):
                add("S")
                step = 2
            elif has(i, "CH"):
                greek = i == 0 and (has(1, "HARAC", "HARIS", "HOR", "HYM", "HIA", "HEM")) and not has(0, "CHORE")
                hard = greek or has(0, "VAN ", "VON ", "SCH") or has(i - 2, "ORCHES", "ARCHIT", "ORCHID") or at(i + 2) in ("T", "S")
                back = (at(i - 1) in ("A", "O", "U", "E") or i == 0) and at(i + 2) != "" and at(i + 2) in "LRNMBHFVW"
                if i > 0 and has(i, "CHAE"):
                    add("K", "X")
                elif hard or back:
                    add("K")
                elif i > 0:
                    add("K") if has(0, "MC") else add("X", "K")
                else:
                    add("X")
                step = 2
            elif has(i, "CZ") and not has(i - 2, "WICZ"):
                add("S", "X")
                step = 2
            elif has(i + 1, "CIA"):
                add("X")
                step = 3
            elif has(i, "CC") and not (i == 1 and at(0) == "M"):
                if at(i + 2) in ("I", "E", "H") and not has(i + 2, "HU"):
                    add("KS") if (i == 1 and at(0) == "A") or has(i - 1, "UCCEE", "UCCES") else add("X")
                    step = 3
                else:
                    add("K")
                    step = 2
            elif has(i, "CK", "CG", "CQ"):
                add("K")
                step = 2
            elif has(i, "CI", "CE", "CY"):
                add("S", "X") if has(i, "CIO", "CIE", "CIA") else add("S")
                step = 2
            else:
                add("K")
                step = 2 if at(i + 1) in ("C", "K", "Q") and not has(i + 1, "CE", "CI") else 1
        elif c == "D":
            if has(i, "DG"):
                soft = at(i + 2) in ("I", "E", "Y")
                add("J" if soft else "TK")
                step = 3 if soft else 2
            else:
                add("T")
                step = 2 if has(i, "DT", "DD") else 1
        elif c == "G":
            if at(i + 1) == "H":
                if i > 0 and at(i - 1) not in VOWELS:
                    add("K")
                elif i == 0:
                    add("J") if at(i + 2) == "I" else add("K")
                elif (i > 1 and at(i - 2) in ("B", "H", "D")) or (i > 2 and at(i - 3) in ("B", "H", "D")) or (i > 3 and at(i - 4) in ("B", "H")):
                    pass
                elif i > 2 and at(i - 1) == "U" and at(i - 3) in ("C", "G", "L", "R", "T"):
                    add("F")
                elif i > 0 and at(i - 1) != "I":
                    add("K")
                step = 2
            elif at(i + 1) == "N":
                if i == 1 and at(0) in VOWELS and not slavic:
                    add("KN", "N")
                elif not has(i + 2, "EY") and not slavic:
                    add("N", "KN")
                else:
                    add("KN")
                step = 2
            elif has(i + 1, "LI") and not slavic:
                add("KL", "L")
                step = 2
            elif i == 0 and (at(1) == "Y" or has(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
                add("K", "J")
                step = 2
            elif (has(i + 1, "ER") or at(i + 1) == "Y") and not has(0, "DANGER", "RANGER", "MANGER") and at(i - 1) not in ("E", "I") and not has(i - 1, "RGY", "OGY"):
                add("K", "J")
                step = 2
            elif at(i + 1) in ("E", "I", "Y") or has(i - 1, "AGGI", "OGGI"):
                if has(0, "SCH") or has(i + 1, "ET"):
                    add("K")
                else:
                    add("J") if has(i + 1, "IER") and i + 4 == n else add("J", "K")
                step = 2
            else:
                add("K")
                step = 2 if at(i + 1) == "G" else 1
        elif c == "H":
            if (i == 0 or at(i - 1) in VOWELS) and at(i + 1) != "" and at(i + 1) in VOWELS:
                add("H")
                step = 2
        elif c == "J":
            if i == 0:
                add("J", "A")
            elif at(i - 1) != "" and at(i - 1) in VOWELS and not slavic and at(i + 1) in ("A", "O"):
                add("J", "H")
            elif i == n - 1:
                add("J", "")
            elif not (at(i + 1) in tuple("LTKSNMBZ") or at(i - 1) in ("S", "K", "L")):
                add("J")
        elif c in "KQ":
            add("K")
        elif c == "L":
            if at(i + 1) == "L" and ((i == n - 3 and has(i - 1, "ILLO", "ILLA", "ALLE")) or (has(n - 2, "AS", "OS") and has(i - 1, "ALLE"))):
                add("L", "")
            else:
                add("L")
        elif c in "FMNR":
            if c == "R" and i == n - 1 and not slavic and has(i - 2, "IE") and not has(i - 4, "ME", "MA"):
                add("", "R")
            else:
                add(c)
            if c == "M" and has(i - 1, "UMB") and (i + 1 == n - 1 or has(i + 2, "ER")):
                step = 2
        elif c == "P":
            add("F" if at(i + 1) == "H" else "P")
            step = 2 if at(i + 1) in ("H", "P", "B") else 1
        elif c == "S":
            if has(i - 1, "ISL", "YSL"):
                step = 1
            elif i == 0 and has(0, "SUGAR"):
                add("X", "S")
            elif has(i, "SH"):
                add("S") if has(i + 1, "HEIM", "HOEK", "HOLM", "HOLZ") else add("X")
                step = 2
            elif has(i, "SIO", "SIA"):
                add("S") if slavic else add("S", "X")
                step = 3
            elif (i == 0 and at(1) in ("M", "N", "L", "W")) or at(i + 1) == "Z":
                add("S", "X")
                step = 2 if at(i + 1) == "Z" else 1
            elif has(i, "SC"):
                if at(i + 2) == "H":
                    if has(i + 3, "OO", "ER", "EN", "UY", "ED", "EM"):
                        add("X", "SK") if has(i + 3, "ER", "EN") else add("SK")
                    else:
                        add("X", "S") if i == 0 and at(3) not in VOWELS and at(3) != "W" else add("X")
                else:
                    add("S" if at(i + 2) in ("I", "E", "Y") else "SK")
                step = 3
            else:
                add("", "S") if i == n - 1 and has(i - 2, "AI", "OI") else add("S")
                step = 2 if at(i + 1) in ("S", "Z") else 1
        elif c == "T":
            if has(i, "TION", "TIA", "TCH"):
                add("X")
                step = 3
            elif has(i, "TH", "TTH"):
                add("T") if has(i + 2, "OM", "AM") or has(0, "SCH") else add("0", "T")
                step = 2 if has(i, "TH") else 3
            else:
                add("T")
                step = 2 if at(i + 1) in ("T", "D") else 1
        elif c == "V":
            add("F")
        elif c == "W":
            if has(i, "WR"):
                add("R")
                step = 2
            elif i == 0 and (at(1) in tuple(VOWELS + "Y") or has(0, "WH")):
                add("A", "F") if at(1) in tuple(VOWELS + "Y") else add("A")
            elif (i == n - 1 and at(i - 1) in tuple(VOWELS)) or has(i - 1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or has(0, "SCH"):
                add("", "F")
            elif has(i, "WICZ", "WITZ"):
                add("TS", "FX")
                step = 4
        elif c == "X":
            if not (i == n - 1 and (has(i - 3, "IAU", "EAU") or has(i - 2, "AU", "OU"))):
                add("KS")
            step = 2 if at(i + 1) in ("C", "X") else 1
        elif c == "Z":
            if at(i + 1) == "H":
                add("J")
                step = 2
            else:
                add("S", "TS") if has(i + 1, "ZO", "ZI", "ZA") or (slavic and i > 0 and at(i - 1) != "T") else add("S")
        i += step
    return "".join(one)[:longest], "".join(two)[:longest]


def _r1_r2(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        m = re.compile("[aeiouy][^aeiouy]").search(w, start)
        return m.end() if m else len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


#: Words whose stem is set, and words left as they are, by the published algorithm.
SET_STEMS = {
    "skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl",
    "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", "sky": "sky", "news": "news", "howe": "howe",
    "atlas": "atlas", "cosmos": "cosmos", "bias": "bias", "andes": "andes",
}
LEFT_ALONE = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
STEP2 = [
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("entli", "ent"),
    ("ization", "ize"), ("izer", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("aliti", "al"),
    ("alli", "al"), ("fulness", "ful"), ("ousli", "ous"), ("ousness", "ous"), ("iveness", "ive"), ("iviti", "ive"),
    ("biliti", "ble"), ("bli", "ble"), ("fulli", "ful"), ("lessli", "less"),
]
STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP4 = "al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split()


def _short_end(w: str) -> bool:
    return bool(re.search(r"(?:^|[^aeiouy])[aeiouy][^aeiouywxY]$|^[aeiouy][^aeiouy]$", w))


def stem(word: str) -> str:
    """The stem of an English word (the second edition of the Porter algorithm)."""
    if len(word) <= 2:
        return word
    if word in SET_STEMS:
        return SET_STEMS[word]
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", word.lstrip("'"))
    r1, r2 = _r1_r2(w.lower() if w[:1] != "Y" else w)
    r1, r2 = _r1_r2(w)
    w = re.sub(r"(?:'s'|'s|')$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search("[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in LEFT_ALONE:
        return w
    m = re.search(r"(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    else:
        m = re.search(r"(ingly|edly|ing|ed)$", w)
        if m and re.search("[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in "aeiouy":
        w = w[:-1] + "i"
    for end, to in sorted(STEP2, key=lambda x: -len(x[0])):
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: len(w) - len(end)] + to
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4:-3] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3:-2] in tuple("cdeghkmnrt"):
            w = w[:-2]
    for end, to in sorted([*STEP3, ("ative", "")], key=lambda x: -len(x[0])):
        if w.endswith(end):
            if len(w) - len(end) >= (r2 if end == "ative" else r1):
                w = w[: len(w) - len(end)] + to
            break
    for end in sorted([*STEP4, "ion"], key=lambda x: -len(x)):
        if w.endswith(end):
            if len(w) - len(end) >= r2 and (end != "ion" or w[-4:-3] in ("s", "t")):
                w = w[: len(w) - len(end)]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1]))):
        w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


def sound_codes(word: Column) -> Column:
    """Struct (metaphone, dmetaphone, dmetaphone_alt) of a word; null stays null."""

    @F.pandas_udf("metaphone string, dmetaphone string, dmetaphone_alt string")
    def codes(s: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if x is None else (metaphone(x), *double_metaphone(x)) for x in s]
        return pd.DataFrame(rows, columns=["metaphone", "dmetaphone", "dmetaphone_alt"])

    return codes(word)


def stemmed(word: Column) -> Column:
    """The stem of a word; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else stem(x))

    return run(word)
