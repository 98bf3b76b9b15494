"""Plain Python versions of the contracts, for small tables."""

import hashlib
import re

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE_WORD, ALNUM_WORD = r"[^\x20\x09-\x0D]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, k):
    w = re.findall(SPACE_WORD, (text or "").translate(FOLD))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def components(texts: list, k: int, above: int) -> list[int]:
    sets = [shingles(t, k) for t in texts]
    at = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= above * (len(a) + len(sets[j]) - both) and at[i] != at[j]:
                old, new = max(at[i], at[j]), min(at[i], at[j])
                at = [new if x == old else x for x in at]
    return at


def kept_words(texts: list, width: int) -> list[tuple[int, int, str]]:
    by_doc = [re.findall(SPACE_WORD, t or "") for t in texts]
    seen: dict[tuple, list] = {}
    for d, w in enumerate(by_doc):
        for i in range(len(w) - width + 1):
            seen.setdefault(tuple(w[i : i + width]), []).append((d, i))
    gone = [set() for _ in texts]
    for places in seen.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + width))
    return [(len(w), len(g), " ".join(x for i, x in enumerate(w) if i not in g)) for w, g in zip(by_doc, gone, strict=True)]


def hits(texts: list, items: list[tuple], span: int) -> list[tuple[int, int, list[str]]]:
    cut = lambda t: re.findall(ALNUM_WORD, (t or "").translate(FOLD))
    out = []
    for t in texts:
        w, covered, ids = cut(t), set(), set()
        for name, text in items:
            iw = cut(text)
            size = min(span, len(iw))
            for s in range(len(iw) - size + 1 if size else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == iw[s : s + size]:
                        covered.update(range(p, p + size))
                        ids.add("" if name is None else str(name))
        out.append((len(w), len(covered), sorted(ids)))
    return out


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def personal(text) -> list[tuple[str, int, int]]:
    def ok(kind, value):
        digits = re.sub("[^0-9]", "", value)
        if kind == "ip":
            return all(int(x) <= 255 for x in value.split("."))
        if kind == "phone":
            return 10 <= len(digits) <= 15
        if kind == "card":
            doubled = [int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))]
            return 14 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return True

    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(BASE.items()) for m in re.finditer(p, text or "") if ok(k, m[0])]
    return [(k, s, e) for s, _, e, k in sorted(found)]


def phrases(text) -> list[tuple[int, str]]:
    names = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
    w = re.findall(ALNUM_WORD, (text or "").translate(FOLD))
    return sorted((i, label) for p, label in names.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split())
