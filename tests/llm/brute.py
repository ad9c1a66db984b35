"""Brute-force versions of the contracts, in plain Python over lists of rows, for small inputs."""

import hashlib
import re
from collections import Counter

ALNUM = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile("[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def quality_base(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = SPACED.findall(text)
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n)


def contamination(docs, items):
    """doc rows (id, text) -> (id, n_words, n_hit, n_items, sha, contaminated). An item without id counts, but has no id to list."""
    items = [(i, ALNUM.findall((t or "").translate(LOWER))) for i, t in items]
    windows = {}
    for i, w in items:
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            windows.setdefault(tuple(w[s:s + k]), set()).add(i if i is None else str(i))
    sizes = sorted({len(w) for w in windows})
    out = []
    for d, t in docs:
        words = ALNUM.findall((t or "").translate(LOWER))
        hit, ids = set(), set()
        for k in sizes:
            for s in range(len(words) - k + 1):
                found = windows.get(tuple(words[s:s + k]))
                if found:
                    ids |= found
                    hit.update(range(s, s + k))
        n = len(hit)
        out.append((d, len(words), n, len(ids), hashlib.sha256(",".join(sorted(ids - {None})).encode()).hexdigest(), n > 0 and 20 * n >= len(words)))
    return out


def near_duplicates(docs, words=5, percent=75):
    """rows (id, text) -> {id: (n_shingles, component)}; rows that share an id are one node with the sizes of the last one."""
    sets = {}
    for d, t in docs:
        w = SPACED.findall((t or "").translate(LOWER))
        sets[d] = {tuple(w[i:i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    inverted = {}
    for d, s in sets.items():
        for g in s:
            inverted.setdefault(g, []).append(d)
    common = Counter()
    for ids in inverted.values():
        for i, a in enumerate(ids):
            for b in ids[i + 1:]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(text):
    """n_assign, n_access, n_hex, base digest."""
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 12]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return tuple(sum(k == x for _, k, _ in spans) for x in range(3)), hashlib.sha256(said.encode()).hexdigest()


PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))


def license_base(text):
    """n_words, n_base, first_word, last_word, labels."""
    words = ALNUM.findall((text or "").translate(LOWER))
    at, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split(" ")
        for i in range(len(words) - len(p) + 1):
            if words[i:i + len(p)] == p:
                at.append(i)
                labels.add(label)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def url_rule(url):
    """host, path, rule, verdict."""
    at = (url or "").find("://")
    rest = url[at + 3:] if at >= 0 else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host):])[0]
    host = host.translate(LOWER)
    best = (None, None)
    for said, rule in RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best[0] is None or len(rule) > len(best[0])):
            best = (rule, said)
    return host, path, *best
