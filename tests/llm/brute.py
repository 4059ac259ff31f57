"""Plain versions of the operators' contracts, one document at a time."""

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def words(t):
    return WORD.findall(t or "")


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def quality(t):
    w = words(t)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, again = set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), again, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w)


def dup_chars(t, n):
    w = words(t)
    grams = Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1))
    hit = {j for i in range(len(w) - n + 1) if grams[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
    return sum(len(w[j]) for j in hit)


def repeats(docs, window=50):
    """docs: (id, text) rows to (id, n_words, n_removed, sha)."""
    first = {}
    for i, t in docs:
        w = words(t)
        if i is not None:
            for k in range(len(w) - window + 1):
                key = tuple(w[k : k + window])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = set()
        if i is not None:
            for k in range(len(w) - window + 1):
                if first[tuple(w[k : k + window])] < i:
                    gone |= set(range(k, k + window))
        out.append((i, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def fingerprint(t):
    w = words(fold(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum((2 * sum((x >> b) & 1 for x in h) > len(h)) << b for b in range(64))


def components(prints, bits=2):
    """Rows (id, fingerprint) to the smallest id reachable, row by row; null ids only where there is no other."""
    root = {f: f for _, f in prints}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in itertools.combinations(root, 2):
        if (a ^ b).bit_count() <= bits:
            root[find(a)] = find(b)
    least = {}
    for i, f in prints:
        if i is not None:
            least[find(f)] = min(least.get(find(f), i), i)
    return [(i, "%016x" % f, least.get(find(f))) for i, f in prints]


def decontaminate(docs, bench):
    token = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", fold(t))
    windows = defaultdict(set)
    for i, t in bench:
        w = token(t)
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add("null" if i is None else str(i))
    lengths = {len(k) for k in windows}
    out = []
    for i, t in docs:
        w, hit, items = token(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                key = tuple(w[k : k + n])
                if key in windows:
                    hit |= set(range(k, k + n))
                    items |= windows[key]
        out.append((i, len(w), len(hit), len(items), sha(",".join(sorted(items))), bool(hit)))
    return out


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii_spans(t):
    t, out = t or "", []
    out += [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def secret_spans(t):
    t, out = t or "", []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def written(spans):
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def targets(sizes):
    """Source to target, by resharing until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    capped, total = {}, sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        left = 1.5 * total - sum(capped.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] >= 2 * sizes[s]]
        if not over:
            return capped | share
        capped |= {s: 2.0 * sizes[s] for s in over}


def judge_url(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = fold(re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fit = [(len(h + p), len(h), a == "block", h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best[3] if best else None, best[4] if best else default
