"""Plain versions of the operators over lists of rows, for tables small enough to hold."""

import hashlib
import re
import zlib
from collections import defaultdict

import xxhash

NULL_ID = -(2**63)
BLANKS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def line_dedup(docs, min_docs=3, min_chars=20):
    key = lambda line: low(line.strip(BLANKS))
    held = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            held[key(line)].add(NULL_ID if d is None else d)
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        keep = [x for x in lines if len(k := key(x)) < min_chars or len(held[k]) < min_docs or max(held[k]) == (NULL_ID if d is None else d)]
        out.append((d, len(lines), len(lines) - len(keep), sha("\n".join(keep))))
    return out


def fingerprint(text):
    words = WORD.findall(low(text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(ids, pairs):
    parent = {k: k for k in ids}

    def root(k):
        while parent[k] != k:
            parent[k] = k = parent[parent[k]]
        return k

    for a, b in pairs:
        parent[root(a)] = root(b)
    return {k: root(k) for k in ids}


def simhash(docs, radius=2):
    prints = [fingerprint(t) for _, t in docs]
    fps = sorted(set(prints))
    near = components(fps, [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= radius])
    least = defaultdict(list)
    for (d, _), f in zip(docs, prints, strict=True):
        least[near[f]].append(d)
    return [(d, f"{f:016x}", min((x for x in least[near[f]] if x is not None), default=None)) for (d, _), f in zip(docs, prints, strict=True)]


def substring(docs, size=50):
    rows = [(NULL_ID if d is None else d, WORD.findall(t or "")) for d, t in docs]
    first = {}
    for d, w in rows:
        for i in range(len(w) - size + 1):
            k = tuple(w[i : i + size])
            first[k] = min(d, first.get(k, d))
    out = []
    for (d, _), (k, w) in zip(docs, rows, strict=True):
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < k:
                gone.update(range(i, i + size))
        out.append((d, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def pieces(docs, tokenizer, size=4096, end_id=1):
    out = []
    for d, t in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id]
        for k, at in enumerate(range(0, len(ids), size)):
            own = ids[at : at + size]
            out.append((d, k, at, len(own), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in own))))
    return out


ASSIGN = re.compile(r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def secrets(docs):
    out = []
    for d, t in docs:
        t = t or ""
        spans = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(t) if len(m[1]) >= 6]
        spans += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        spans.sort()
        counts = [sum(s[1] == k for s in spans) for k in range(3)]
        out.append((d, *counts, sha(",".join(f"{k}:{a}:{b}" for a, _, b, k in spans))))
    return out


def best_tags(gain, moves):
    """(score, tags) of the best labelling of one chain that starts and ends with 0, over all of it."""
    held = {0: (0.0, [])}
    for own in gain:
        held = {y: max((s + moves[x][y] + own[y], [*t, y]) for x, (s, t) in held.items()) for y in range(3)}
    return max((s + moves[y][0], t) for y, (s, t) in held.items())


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def urls(pages):
    """page_id, host, path, rule, the rule's verdict or None."""
    out = []
    for p, u in pages:
        host = path = ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match("[^/?#]*", rest)[0]
            path = re.match("[^?#]*", rest[len(host) :])[0]
            host = low(host)
        best = (None, None)
        for kind, rule in RULES:
            own, _, tail = rule.partition("/")
            if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best[1] is None or len(rule) > len(best[1])):
                best = (kind, rule)
        out.append((p, host, path, best[1], best[0]))
    return out


def warc(pages, least=1000):
    rows = [(NULL_ID if p is None else p, (h or "").encode()) for p, h in pages]
    last = {}
    for p, h in rows:
        last[h] = max(p, last.get(h, p))
    out = []
    for p, h in rows:
        again = len(h) >= least and p < last[h]
        out.append((None if p == NULL_ID else p, len(h), hashlib.sha1(h).hexdigest(), "revisit" if again else "response", last[h] if again else None))
    return out


def measures(docs):
    out = []
    for d, t in docs:
        t = t or ""
        w = WORD.findall(t)
        lines, seen, dup = t.split("\n"), set(), 0
        for line in lines:
            if WORD.search(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
        count = defaultdict(int)
        for x in windows:
            count[x] += 1
        again = {i + k for i, x in enumerate(windows) if count[x] > 1 for k in range(3)}
        n = len(w)
        out.append((d, n, sum(map(len, w)), sum(x in "#*$%&|<>" for x in t), dup, len(again), n < 50 or 100 * len(again) > 50 * n))
    return out


def contaminated(docs, items, least=0.8):
    """{(doc_id, item_id): best similarity} over all item-sized windows."""
    from collections import Counter

    def grams(words):
        n = min(5, len(words))
        return [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] if words else []

    found = {}
    for d, t in docs:
        w = WORD.findall(low(t or ""))
        for i, x in items:
            v = WORD.findall(low(x or ""))
            if not v or len(w) < min(5, len(v)):
                continue
            own = Counter(grams(v))
            if not set(own) & set(" ".join(w[k : k + min(5, len(v))]) for k in range(len(w))):
                continue
            size = min(len(v), len(w))
            for k in range(len(w) - size + 1):
                n = min(5, len(v))
                part = w[k : k + size]
                b = Counter(" ".join(part[j : j + n]) for j in range(size - n + 1))
                s = sum((own & b).values()) / sum((own | b).values())
                if s >= least and s > found.get((d, i), 0):
                    found[d, i] = s
    return found


def judged(docs, rules, keep_from=0.5, rounds=100, prior=0.8, start=(0.95, 0.5), weight=20.0):
    """{row: (p_good, kept)} of the weak supervision, document by document. rules: a list of functions of the measures that say 1, -1 or 0."""
    import math

    votes = []
    for m, (_, t) in zip(measures(docs), docs, strict=True):
        names = {"n_words": m[1], "word_chars": m[2], "n_symbols": m[3], "n_dup_lines": m[4], "n_repeat_words": m[5]}
        names["n_lines"] = sum(bool(WORD.search(x)) for x in (t or "").split("\n"))
        votes.append([r(names) for r in rules])
    share, right = prior, [list(start) for _ in rules]

    def post(v):
        odds = math.log(share / (1 - share))
        for x, (g, b) in zip(v, right, strict=True):
            odds += {1: math.log(g / (1 - b)), -1: math.log((1 - g) / b), 0: 0.0}[x]
        return 1 / (1 + math.exp(-odds))

    for _ in range(rounds if votes else 0):
        p = [post(v) for v in votes]
        share = min(0.99, max(0.01, (prior * weight + sum(p)) / (weight + len(p))))
        new = []
        for j in range(len(rules)):
            good = (start[0] * weight + sum(x for x, v in zip(p, votes, strict=True) if v[j] == 1)) / (weight + sum(x for x, v in zip(p, votes, strict=True) if v[j]))
            bad = (start[1] * weight + sum(1 - x for x, v in zip(p, votes, strict=True) if v[j] == -1)) / (weight + sum(1 - x for x, v in zip(p, votes, strict=True) if v[j]))
            good = min(0.99, max(0.5, good))
            new.append([good, min(0.99, max(1.05 - good, bad))])
        right = new
    return [(post(v), post(v) >= keep_from) for v in votes]
