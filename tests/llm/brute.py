"""Plain versions of the corpus operators: every pair, every run, no index."""

import hashlib
import math

import numpy as np

from evscreen.llm import mixing, simhash
from evscreen.llm import text as tx


def first(value):
    """A sort key that puts null first."""
    return (value is not None, value if value is not None else 0)


def line_matches(docs, threshold):
    """{(id, line): (first id, line)} of (id, text) rows with distinct ids."""
    lines = [(i, n, frozenset(tx.plain_words(line))) for i, text in sorted(docs, key=lambda d: first(d[0])) for n, line in enumerate((text or "").split("\n"))]
    lines = [x for x in lines if x[2]]
    out = {}
    for at, (i, n, words) in enumerate(lines):
        for j, m, other in lines[:at]:
            both = len(words & other)
            if both >= threshold * (len(words) + len(other) - both) - 1e-9:
                out[i, n] = (j, m)
                break
    return out


def deduplicated(docs, threshold):
    """(id, text) after line dedup; texts that lost their last word are gone."""
    gone, out = line_matches(docs, threshold), []
    for i, text in docs:
        lost = {n for j, n in gone if j == i}
        if lost:
            text = "\n".join(x for n, x in enumerate(text.split("\n")) if n not in lost)
            if not tx.plain_words(text):
                continue
        out.append((i, text))
    return out


def features(text):
    return {int(c) % simhash.FEATURES for c in tx.hash_words(tx.plain_words(text))}


def corpus_weights(texts):
    """By counting, text by text."""
    texts = [t for t in texts if tx.plain_words(t)]
    found = np.zeros(simhash.FEATURES, np.int64)
    for t in texts:
        for f in features(t):
            found[f] += 1
    return np.array([max(1, round(math.log2((1 + len(texts)) / (1 + n)))) for n in found], np.uint8)


def fingerprint(text, bits, weight=None):
    """Bit by bit: the sign of the sum of the weights, with the projection's sign."""
    keys = np.random.default_rng(11).integers(0, 2**63, 64, dtype=np.uint64)[: -(-bits // 64)]
    ones = np.zeros(bits)
    for c in set(map(int, tx.hash_words(tx.plain_words(text)))):
        raw = b"".join(int(tx.mix(np.array([c ^ int(k)], np.uint64))[0]).to_bytes(8, "little") for k in keys)
        own = np.array([raw[i // 8] >> 7 - i % 8 & 1 for i in range(bits)])
        ones += (1 if weight is None else int(weight[c % simhash.FEATURES])) * (2 * own - 1)
    return np.packbits(ones > 0)


def meet(x, y, blocks, width):
    """Whether two fingerprints have a block in common."""
    return bool(set(simhash.block_values(x[None], blocks, width)[0]) & set(simhash.block_values(y[None], blocks, width)[0]))


def copies(docs, bits, most, meets=lambda x, y: True):
    """{id: kept id} of the components of all pairs within most bits that meet."""
    weight = corpus_weights([t for _, t in docs])
    rows = [(i, fingerprint(t, bits, weight)) for i, t in docs if tx.plain_words(t)]
    root = {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(rows):
        for j, y in rows[:a]:
            if np.bitwise_count(x ^ y).sum() <= most and meets(x, y):
                p, q = sorted((find(i), find(j)))
                root[q] = p
    return {i: find(i) for i in root if find(i) != i}


def alignment(item, passage, match=2, mismatch=-1, gap=-1):
    """The best local score, cell by cell."""
    best, before = 0, [0] * (len(passage) + 1)
    for a in item:
        now = [0]
        for j, b in enumerate(passage):
            now.append(max(0, before[j] + (match if a == b else mismatch), before[j + 1] + gap, now[j] + gap))
        best, before = max(best, *now), now
    return best


def leaked(docs, items, least):
    """(id, item): score of pairs whose whole texts align well enough."""
    out = {}
    for i, text in docs:
        words = tx.plain_words(text)
        for n, item in items:
            own = tx.plain_words(item)
            if own and words and (score := alignment(own, words) / (2 * len(own))) >= least:
                out[i, n] = score
    return out


def spans(docs, length):
    """(id, start, end, source) by the set of all runs of length words."""
    runs, out = {}, []
    words = {i: tx.plain_words(t) for i, t in docs}
    for i in sorted(words):
        for a in range(len(words[i]) - length + 1):
            runs.setdefault(tuple(words[i][a : a + length]), i)
    for i in sorted(words):
        now = None
        for a in range(len(words[i]) - length + 1):
            source = runs[tuple(words[i][a : a + length])]
            if source == i:
                continue
            if now and a <= now[0] + length:
                now = (a, now[1], min(now[2], source))
            else:
                if now:
                    out.append((i, now[1], now[0] + length, now[2]))
                now = (a, a, source)
        if now:
            out.append((i, now[1], now[0] + length, now[2]))
    return sorted(out)


def mixed(docs, weights, default, seed):
    """{id: copies} of (id, source, text) rows."""
    count = lambda t: len([x for x in (t or "").replace("\f", " ").replace("\n", " ").replace("\r", " ").replace("\t", " ").split(" ") if x])
    tokens = {}
    for _, source, text in docs:
        tokens[source] = tokens.get(source, 0) + count(text)
    weight = {s: (weights.get(s, default) if n else 0) for s, n in tokens.items()}
    rate = {s: 1.0 if not n else 0.0 if not sum(weight.values()) else float(weight[s]) * float(sum(tokens.values())) / (float(sum(weight.values())) * float(n)) for s, n in tokens.items()}
    out = {}
    for i, source, _ in docs:
        u = int(hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16) / 2**32
        out[i] = math.floor(rate[source]) + (u < rate[source] - math.floor(rate[source]))
    return out


def mixing_defaults():
    return mixing.WEIGHTS, mixing.DEFAULT_WEIGHT, mixing.SEED
