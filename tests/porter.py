"""Porter's rules, letter by letter: the plain version that the JVM expressions are held against."""


def consonants(word):
    out = []
    for i, ch in enumerate(word):
        out.append(not (ch in "aeiou" or (ch == "y" and i > 0 and out[i - 1])))
    return out


def measure(word):
    flags = consonants(word)
    return sum(1 for a, b in zip(flags, flags[1:]) if not a and b)


def vowel(word):
    return not all(consonants(word))


def closed(word):
    f = consonants(word)
    return len(word) > 2 and f[-1] and not f[-2] and f[-3] and word[-1] not in "wxy"


def doubled(word):
    return len(word) > 1 and word[-1] == word[-2] and consonants(word)[-1]


LIST2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
         ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
         ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
         ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
LIST3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
LIST4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
         "ous", "ive", "ize"]


def stem(w):
    if w is None or len(w) <= 2:
        return w
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        if measure(w[:-3]) > 0:
            w = w[:-1]
    else:
        for e in ("ed", "ing"):
            if w.endswith(e) and vowel(w[:-len(e)]):
                w = w[:-len(e)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif doubled(w):
                    w = w if w[-1] in "lsz" else w[:-1]
                elif measure(w) == 1 and closed(w):
                    w += "e"
                break
    if w.endswith("y") and vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (LIST2, LIST3):
        for e, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(e):
                w = w[:-len(e)] + new if measure(w[:-len(e)]) > 0 else w
                break
    for e in sorted(LIST4, key=lambda e: -len(e)):
        if w.endswith(e) and (e != "ion" or w[:-3].endswith(("s", "t"))):
            w = w[:-len(e)] if measure(w[:-len(e)]) > 1 else w
            break
    if w.endswith("e"):
        m = measure(w[:-1])
        w = w[:-1] if m > 1 or (m == 1 and not closed(w[:-1])) else w
    if w.endswith("ll") and measure(w) > 1:
        w = w[:-1]
    return w
