"""Secret scan: base patterns, and a linear-chain CRF that tags tokens as begin, inside or outside of a secret.

The base patterns always count. The CRF learns on a bounded sample of documents (`sample_docs` with base matches and as many others, those with
the smallest hash of their id) from windows of `reach` tokens on each side of base spans (one a document) and of tokens that could be
mistaken for secrets (`max_windows` a document), drawn from anywhere in the text. Each base span is also shown with its keyword hidden, with another random value, without anything
around it, and, as a counterexample, with a plain word or number in its place, so that the tagger learns what secrets look like rather than
the patterns. Features: words and shapes of a token and its neighbours, and the kind of file.

Every token of every whole text is scored, and every text is one chain for Viterbi. Tokens that no labelling of their
neighbours could make part of a secret are bound to "outside" first, which is exact (see `certain`), and the runs between them are decoded
one by one. What is tagged beside the base spans is added as kind "crf".

White space is the six ASCII signs; all other signs beyond ASCII belong to words. Defined cases: a null or empty text has no spans;
without base matches in the sample the CRF adds nothing; repeated rows are scanned each. Columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

#: The base patterns, the group whose length counts, and its least length.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]{24,}"), 0, 24),
}
KINDS = [*BASE, "crf"]
OUT, BEGIN, IN = range(3)
NEVER = -1e9
#: Lengths up to which tokens are of one kind.
SIZES = np.array([1, 5, 11, 19, 23])
#: Longer tokens have no word feature.
LONGEST_WORD = 19
PAIRS = 1 << 14


def byte_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each byte: its class (0 blank, 1 part of a word, 2 a sign of its own), its flags for shapes, its small letter."""
    kind, flag, small = np.full(256, 2, np.uint8), np.zeros(256, np.uint8), np.arange(256, dtype=np.uint8)
    for b in range(256):
        c = chr(b)
        if c in " \t\n\x0b\x0c\r":
            kind[b] = 0
            continue
        flags = (c.isascii() and c.islower(), c.isascii() and c.isupper(), c.isascii() and c.isdigit(), c in "+/_-", b >= 128, c not in "0123456789abcdef")
        flag[b] = sum(int(x) << k for k, x in enumerate(flags))
        if any(flags[:5]):
            kind[b] = 1
    small[65:91] += 32
    return kind, flag, small


KIND, FLAG, SMALL = byte_tables()
N_SHAPES = 129 + 64 * 12


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the secret itself)."""
    found = []
    for kind, (pattern, group, least) in BASE.items():
        if kind == "assign" and "=" not in text and ":" not in text or kind == "access" and "AKIA" not in text:
            continue
        found += [(kind, m.start(), m.end(), m.start(group)) for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return found


@dataclass(frozen=True)
class Tokens:
    """The tokens of some texts, one text after another, with places in bytes."""

    raw: np.ndarray
    first: np.ndarray  # of each text
    start: np.ndarray
    end: np.ndarray
    text: np.ndarray
    shape: np.ndarray  # from 1
    file: np.ndarray  # of each text: 0 to 3

    @classmethod
    def of(cls, texts: list[bytes]) -> Tokens:
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        first = np.cumsum(size + 1) - size - 1
        kind = KIND[raw]
        ahead, behind = np.concatenate([[0], kind[:-1]]), np.concatenate([kind[1:], [0]])
        start = np.flatnonzero((kind == 2) | ((kind == 1) & (ahead != 1)))
        end = np.flatnonzero((kind == 2) | ((kind == 1) & (behind != 1))) + 1
        text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(start, [*first, len(raw)])))
        flag = FLAG[raw]
        digit = flag & 4
        turn = ((digit != np.concatenate([[0], digit[:-1]])) & (kind == 1) & (ahead == 1)).astype(np.int32)
        if len(start):
            turns, flags = np.add.reduceat(turn, start), np.bitwise_or.reduceat(flag, start).astype(np.int64)
            shape = 129 + flags * 12 + np.searchsorted(SIZES, end - start) * 2 + (turns > 3)
            sign = kind[start] == 2
            shape[sign] = 1 + raw[start[sign]]
        else:
            shape = np.zeros(0, np.int64)
        code = np.concatenate([[0], np.cumsum(np.isin(raw, np.frombuffer(b"={;", np.uint8)))])
        many = code[first + size] - code[first] > size / 200
        return cls(raw, first, start, end, text, shape, many * 2 + (size > 5000))

    @cached_property
    def words(self) -> pa.Array:
        """In small letters; longer ones are empty."""
        size = self.end - self.start
        own = np.where(size <= LONGEST_WORD, size, 0)
        inside = np.zeros(len(self.raw) + 1, np.int8)
        inside[self.start] += own > 0
        np.add.at(inside, (self.start + own)[own > 0], -1)
        held = SMALL[self.raw[np.cumsum(inside[:-1]) > 0]]
        ends = np.concatenate([[0], np.cumsum(own)]).astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(own), [None, pa.py_buffer(ends), pa.py_buffer(held)])


def shifted(x: np.ndarray, text: np.ndarray, by: int) -> np.ndarray:
    """At each token what stands `by` tokens on in its text; 0 beyond."""
    if not by:
        return x
    out = np.zeros_like(x)
    a, b = (slice(None, -by), slice(by, None)) if by > 0 else (slice(-by, None), slice(None, by))
    out[a] = np.where(text[a] == text[b], x[b], 0)
    return out


def features(word: np.ndarray, shape: np.ndarray, text: np.ndarray, file: np.ndarray, n_words: int) -> Iterator[np.ndarray]:
    """Numbers of the features of each token, one array a template; 0 is no feature. word: 1 to n_words, or 0 if unknown; file: of each token."""
    base = 1
    for by in (-3, -2, -1, 0, 1):
        x = shifted(word, text, by)
        yield np.where(x, base + x, 0)
        base += n_words + 1
    for by in (-1, 0, 1):
        x = shifted(shape, text, by)
        yield np.where(x, base + x, 0)
        base += N_SHAPES + 1
    yield base + file * (N_SHAPES + 1) + shape
    base += 4 * (N_SHAPES + 1)
    for other in (shifted(word, text, -1), N_SHAPES + shifted(shape, text, -1)):
        yield base + (shape * 1_000_003 + other * 7919) % PAIRS
        base += PAIRS


def n_features(n_words: int) -> int:
    return 1 + 5 * (n_words + 1) + 7 * (N_SHAPES + 1) + 2 * PAIRS


@dataclass(frozen=True)
class Crf:
    words: list[bytes]
    weights: np.ndarray  # (features, 3)
    moves: np.ndarray  # (3, 3) from, to

    def gains(self, tokens: Tokens) -> np.ndarray:
        """(tokens, 3): what each tag adds to the score of its token, over that of "outside"."""
        word = pc.fill_null(pc.index_in(tokens.words, value_set=pa.array(self.words, pa.large_binary())), -1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
        weights, out = self.weights - self.weights[:, :1], np.zeros((len(word), 3))
        for x in features(word, tokens.shape, tokens.text, tokens.file[tokens.text], len(self.words)):
            out += weights[x]
        return out

    def best(self, gain: list[list[float]]) -> list[int]:
        """Viterbi over one chain, which starts and ends outside."""
        score, back, moves = [0.0, NEVER, NEVER], [], self.moves.tolist()
        for own in gain:
            steps = [max((score[x] + moves[x][y], x) for x in range(3)) for y in range(3)]
            back.append([x for _, x in steps])
            score = [s + g for (s, _), g in zip(steps, own, strict=True)]
        y = max(range(3), key=lambda k: score[k] + moves[k][OUT])
        path = []
        for step in reversed(back):
            path.append(y)
            y = step[y]
        return path[::-1]

    def certain(self, gain: np.ndarray, text: np.ndarray) -> np.ndarray:
        """Tokens that some best path has outside, whatever its other tags are.

        For such a token, taking it out of a secret never costs anything, for all tags before and after. Where the next token is inside, it
        has to begin a secret then, so its own difference of "begin" and "inside" counts, and that of the moves after it. Taking
        such tokens out from left to right only touches the token at hand and the next one, so all of them can be outside at once.
        """
        m = self.moves
        begins = np.concatenate([gain[1:, BEGIN] - gain[1:, IN], [np.inf]])
        begins[:-1][text[1:] != text[:-1]] = np.inf  # no next token
        begins += (m[BEGIN] - m[IN]).min()
        out = np.ones(len(gain), bool)
        for y, before in ((BEGIN, (OUT, BEGIN, IN)), (IN, (BEGIN, IN))):
            left = min(m[x, OUT] - m[x, y] for x in before)
            right = min(m[OUT, z] - m[y, z] for z in (OUT, BEGIN))
            out &= left - gain[:, y] + np.minimum(right, m[OUT, BEGIN] - m[y, IN] + begins) >= 0
        return out

    def spans(self, tokens: Tokens) -> list[tuple[int, int, int]]:
        """(text, first byte, end) of the secrets, by place."""
        gain = self.gains(tokens)
        live = np.flatnonzero(~self.certain(gain, tokens.text))
        found = []
        for run in np.split(live, np.flatnonzero((np.diff(live) > 1) | (np.diff(tokens.text[live]) > 0)) + 1) if len(live) else ():
            for k, y in zip(run.tolist(), self.best(gain[run].tolist()), strict=True):
                a, b = int(tokens.start[k]), int(tokens.end[k])
                if y == BEGIN:
                    found.append((int(tokens.text[k]), a, b))
                elif y == IN:
                    found[-1] = (*found[-1][:2], b)
        return found


def fit(chains: list[tuple[np.ndarray, list[int]]], words: list[bytes], rounds: int = 50, decay: float = 1e-4) -> Crf:
    """Maximum likelihood by Adam; forward and backward sums over all chains at once. A chain: features (tokens, templates), tags."""
    n, longest = len(chains), max(len(y) for _, y in chains)
    gold, real = np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for i, (_, y) in enumerate(chains):
        gold[i, : len(y)], real[i, : len(y)] = y, True
    rows, size = np.concatenate([x for x, _ in chains]), n_features(len(words))
    place, flat = np.flatnonzero(real.ravel()), rows.ravel()
    w, moves = np.zeros((size, 3)), np.zeros((3, 3))
    fixed = np.zeros((3, 3))
    fixed[OUT, IN] = NEVER
    m, v = np.zeros(w.size + 9), np.zeros(w.size + 9)
    one = np.eye(3)
    before = np.concatenate([np.zeros((n, 1), np.int64), gold[:, :-1]], axis=1)
    gold_moves = np.zeros((3, 3))
    np.add.at(gold_moves, (before[real], gold[real]), 1)
    last = gold[np.arange(n), real.sum(axis=1) - 1]
    np.add.at(gold_moves, (last, np.zeros(n, np.int64)), 1)
    for k in range(1, rounds + 1):
        emit = np.zeros((n * longest, 3))
        emit[place] = w[rows].sum(axis=1)
        emit = emit.reshape(n, longest, 3)
        a = moves + fixed
        ahead = np.full((longest + 1, n, 3), NEVER)
        ahead[0, :, OUT] = 0
        for t in range(longest):
            step = np.logaddexp.reduce(ahead[t][:, :, None] + a[None], axis=1) + emit[:, t]
            ahead[t + 1] = np.where(real[:, t, None], step, ahead[t])
        behind = np.broadcast_to(a[:, OUT], (longest + 1, n, 3)).copy()  # a chain ends outside
        for t in range(longest - 1, -1, -1):
            step = np.logaddexp.reduce(a[None] + (emit[:, t] + behind[t + 1])[:, None, :], axis=2)
            behind[t] = np.where(real[:, t, None], step, behind[t + 1])
        z = np.logaddexp.reduce(ahead[longest] + a[:, OUT], axis=1)
        dmoves = -gold_moves
        grad_emit = np.zeros((n, longest, 3))
        for t in range(longest):
            both = ahead[t][:, :, None] + a[None] + (emit[:, t] + behind[t + 1])[:, None, :] - z[:, None, None]
            p = np.exp(np.minimum(both, 0)) * real[:, t, None, None]
            dmoves = dmoves + p.sum(axis=0)
            grad_emit[:, t] = p.sum(axis=1) - one[gold[:, t]] * real[:, t, None]
        dmoves[:, OUT] += np.exp(np.minimum(ahead[longest] + a[:, OUT] - z[:, None], 0)).sum(axis=0)
        g = grad_emit.reshape(-1, 3)[place]
        dw = np.stack([np.bincount(flat, np.repeat(g[:, y], rows.shape[1]), size) for y in range(3)], axis=1)
        dw[0] = 0
        grad = np.concatenate([(dw / n + decay * w).ravel(), (dmoves / n + decay * moves).ravel()])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, moves = w - move[:-9].reshape(w.shape), moves - move[-9:].reshape(3, 3)
    return Crf(words, w, moves + fixed)


Window = tuple[list[str], list[int], list[int]]  # words, shapes, tags


def random_value(r: random.Random) -> str:
    """A value as generators of keys write them."""
    signs = r.choice(["0123456789abcdef", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"])
    return "".join(r.choice(signs) for _ in range(r.randrange(16, 49)))


def plain_value(r: random.Random) -> str:
    """A value that is no secret."""
    kind = r.randrange(4)
    return str(r.randrange(10 ** r.randrange(1, 7))) if kind < 2 else "".join(r.choice("aeioulnrst") for _ in range(r.randrange(2, 12))) if kind == 2 else str(r.choice(["true", "null", "none", "yes"]))


def shown(window: Window, key: list[int], r: random.Random) -> list[Window]:
    """A window with one secret as it is and changed; key: its tokens of the keyword and of what joins that to the value."""
    words, shapes, tags = window
    out = [window]
    at = [k for k, y in enumerate(tags) if y != OUT]
    a, b = at[0], at[-1] + 1
    hidden = ["" if k in key and shapes[k] > 128 else w for k, w in enumerate(words)]

    def instead(value: str, tag: int) -> Window:
        """With another value, and without some of what joins it to the keyword."""
        own, gone = Tokens.of([value.encode()]), {k for k in key if r.random() < 0.4}
        lead, word = [k for k in range(a) if k not in gone], value.lower() if len(value) <= LONGEST_WORD else ""
        return [hidden[k] for k in lead] + [word] + hidden[b:], [shapes[k] for k in lead] + [int(own.shape[0])] + shapes[b:], [OUT] * len(lead) + [tag] + [OUT] * len(shapes[b:])

    if key:
        out.append((hidden, shapes, tags))
    return out + [instead(random_value(r), BEGIN) for _ in range(6)] + [instead(plain_value(r), OUT) for _ in range(4)]


def windows_of(texts: list[bytes], reach: int, most: int) -> Iterator[tuple[int, Window]]:
    """(kind of file, window) for training, of each text by itself."""
    tokens = Tokens.of(texts)
    words = tokens.words.to_pylist()
    cut = np.searchsorted(tokens.text, np.arange(len(texts) + 1))
    for i, raw in enumerate(texts):
        text, file, at = raw.decode("utf-8", "replace"), int(tokens.file[i]), int(tokens.first[i])
        lo, hi = int(cut[i]), int(cut[i + 1])
        if lo == hi:
            continue
        place = (lambda k: k) if text.isascii() else (lambda k, text=text: len(text[:k].encode()))
        spans = sorted((place(x[3]) + at, place(x[2]) + at, place(x[1]) + at) for x in base_spans(text))
        tags, owner = [OUT] * (hi - lo), {}
        for n, (a, b, _) in enumerate(spans):
            x, y = np.searchsorted(tokens.start[lo:hi], [a, b])
            for k in range(int(x), int(y)):
                if k not in owner:
                    tags[k], owner[k] = BEGIN if owner.get(k - 1) != n else IN, n
        r = random.Random(raw)
        held = [n for n in range(len(spans)) if n in owner.values()]
        for n in r.sample(held, min(1, len(held))):
            a, b, begin = spans[n]
            own = [k for k, x in owner.items() if x == n]
            x, y = max(0, own[0] - reach), min(hi - lo, own[-1] + 1 + reach)
            key = [k - x for k in range(int(np.searchsorted(tokens.start[lo:hi], begin)), own[0]) if k >= x]
            inside = [tags[k] if owner.get(k, n) == n else OUT for k in range(x, y)]
            window = [w.decode("utf-8", "replace") for w in words[lo + x : lo + y]], tokens.shape[lo + x : lo + y].tolist(), inside
            if all(owner.get(k, n) == n for k in range(x, y)):
                for made in shown(window, key, r):
                    yield file, made
            else:
                yield file, (window[0], window[1], [tags[k] for k in range(x, y)])
        # what could be mistaken: tokens with digits, long ones, and what follows "=" or ":"
        shape = tokens.shape[lo:hi]
        like = (shape > 128) & ((((shape - 129) // 12 & 4) > 0) | (tokens.end[lo:hi] - tokens.start[lo:hi] > LONGEST_WORD) | np.isin(np.concatenate([[0], shape[:-1]]), (1 + ord("="), 1 + ord(":"))))
        like = [k for k in np.flatnonzero(like).tolist() if k not in owner]
        for k in sorted(r.sample(like, min(most, len(like)))) + [r.randrange(hi - lo)]:
            x, y = max(0, k - reach), min(hi - lo, k + 1 + reach)
            yield file, ([w.decode("utf-8", "replace") for w in words[lo + x : lo + y]], shape[x:y].tolist(), tags[x:y])


#: Fixed value: the base patterns in Java's notation, at their least lengths.
ANY_BASE = r"""(?i:(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6})|AKIA[A-Z0-9]{16}|[0-9a-f]{24}"""


def train(docs: DataFrame, sample_docs: int = 400, reach: int = 6, max_windows: int = 3, min_count: int = 3) -> Crf | None:
    """None if no base span is in the sample. The bounds hold at every size of the input."""
    ids = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.coalesce(F.col("text").cast("string").rlike(ANY_BASE), F.lit(False))).alias("held"))
    ids = written(ids, "secret-sample")
    part = [ids.filter(x).select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_docs) for x in ("held", "not held")]
    chosen = F.broadcast(part[0].unionByName(part[1]))  # 2 * sample_docs rows at most
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(chosen, "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in slices(batches):
            found = list(windows_of(texts, reach, max_windows))
            columns = [f for f, _ in found], *([w[k] for _, w in found] for k in range(3))
            kinds = pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "words", "shapes", "tags"])

    found = sorted(rows.mapInArrow(each, "file int, words array<string>, shapes array<int>, tags array<int>").toLocalIterator(), key=lambda r: (r.words, r.shapes, r.tags, r.file))
    if not any(y != OUT for r in found for y in r.tags):
        return None
    seen = Counter(w for r in found for w in r.words if w)
    words = sorted(w for w, n in seen.items() if n >= min_count)
    number = {w: k + 1 for k, w in enumerate(words)}
    chains = []
    for r in found:
        word, shape = np.array([number.get(w, 0) for w in r.words], np.int64), np.array(r.shapes, np.int64)
        rows = features(word, shape, np.zeros(len(word), np.int64), np.full(len(word), r.file), len(words))
        chains.append((np.stack(list(rows), axis=1), r.tags))
    return fit(chains, [w.encode() for w in words])


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame, model: Crf | None) -> DataFrame:
    """doc_id, base and added: arrays of (kind, start, end) in code points, end exclusive, one row for each row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in slices(batches):
            base = []
            for t in texts:
                own = sorted(((k, a, b) for k, a, b, _ in base_spans(t.decode("utf-8", "replace"))), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))
                base.append([{"kind": k, "start": a, "end": b} for k, a, b in own])
            added = [[] for _ in texts]
            for i, a, b in tagged(texts, sent.value) if sent.value else ():
                if not any(a < x["end"] and x["start"] < b for x in base[i]):
                    added[i].append({"kind": "crf", "start": a, "end": b})
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(base, kind), pa.array(added, kind)], ["doc_id", "base", "added"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, f"doc_id long, base {SPANS}, added {SPANS}")


def tagged(texts: list[bytes], crf: Crf) -> Iterator[tuple[int, int, int]]:
    """(text, start, end) of the decoded secrets, in code points."""
    tokens = Tokens.of(texts)
    spans = crf.spans(tokens)
    if spans:
        before = np.concatenate([[0], np.cumsum((tokens.raw & 0xC0) != 0x80)])
        for i, a, b in spans:
            at = before[tokens.first[i]]
            yield i, int(before[a] - at), int(before[b] - at)


def find_secrets(docs: DataFrame, sample_docs: int = 400) -> DataFrame:
    return scan(docs, train(docs, sample_docs))
