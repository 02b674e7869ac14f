"""Plain versions of the operators, by their definitions, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

from fractions import Fraction
from math import gcd

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def words(text):
    return WORD.findall(text or "")


def smallest_reachable(nodes, links):
    """Each node's component, named by its smallest node."""
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def fingerprint(text, width=3):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = words(lowered)
    if not w:
        return 0
    shingles = [" ".join(w)] if len(w) < width else [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_fingerprints(docs, distance=3):
    """{doc_id: (fingerprint, component)} by comparing all pairs."""
    prints = {i: fingerprint(t) for i, t in docs}
    ids = sorted(prints)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if (prints[a] ^ prints[b]).bit_count() <= distance]
    comps = smallest_reachable(ids, links)
    return {i: (f"{prints[i]:016x}", comps[i]) for i in ids}


def luhn(digits):
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text):
    found = []
    for rank, (kind, pattern) in enumerate(BASE.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 10 <= len(digits) <= 15:
                continue
            found.append((m.start(), rank, kind, m.end()))
    return sorted(found)


def base_row(text):
    spans = base_spans(text)
    counts = Counter(k for _, _, k, _ in spans)
    listed = ",".join(f"{k}:{s}:{e}" for s, _, k, e in spans)
    return tuple(counts[k] for k in BASE) + (hashlib.sha256(listed.encode()).hexdigest(),), listed


def quality_counts(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    times = Counter(windows)
    covered = {j for i, x in enumerate(windows) if times[x] > 1 for j in range(i, i + 5)}
    base = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))
    return base + (len(w) < 10 or 100 * len(covered) > 20 * len(w),)


def one_word_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    if len(a) > len(b):
        a, b = b, a
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def dedup_lines(docs):
    """{doc_id: (text, removed)}: every line against all earlier ones; one edit may be a fifth of the longer line's words at most."""
    seen, exact, out = [], set(), {}
    for i, text in sorted(docs):
        kept, gone = [], 0
        for line in (text or "").split("\n"):
            w = words(line)
            near = w and (tuple(w) in exact or any(max(len(w), len(v)) >= 5 and one_word_edit(w, v) for v in seen))
            if w and tuple(w) not in exact:
                exact.add(tuple(w))
                seen.append(w)
            if near:
                gone += 1
            else:
                kept.append(line)
        out[i] = ("\n".join(kept) if gone else text, gone)
    return out


def remove_windows(docs, width=13):
    first = {}
    for i, text in sorted(docs):
        w = words(text)
        for k in range(len(w) - width + 1):
            first.setdefault(tuple(w[k : k + width]), i)
    out = {}
    for i, text in docs:
        w = words(text)
        gone = {j for k in range(len(w) - width + 1) if first[tuple(w[k : k + width])] < i for j in range(k, k + width)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def token_rows(docs, path, end_id):
    from tokenizers import Tokenizer

    tokenizer, start, out = Tokenizer.from_file(path), 0, {}
    for i, text in sorted(docs):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [end_id]
        out[i] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def cosine_links(rows, threshold=0.9):
    """{vec_id: (n_links, component)} by all cosines."""
    good = [(i, np.array(v, np.float64)) for i, v in rows if v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, n = [], defaultdict(int)
    for k, (a, x) in enumerate(good):
        for b, y in good[k + 1 :]:
            if len(x) == len(y) and float(x @ y) / float(np.sqrt(x @ x) * np.sqrt(y @ y)) >= threshold:
                links.append((a, b))
                n[a] += 1
                n[b] += 1
    comps = smallest_reachable([i for i, _ in rows], links)
    return {i: (n[i], comps[i]) for i, _ in rows}


def mix(docs, seed=42):
    """[(doc_id, first word, words, shard)]: seats dealt one by one, blocks of each source's line drawn one by one."""
    docs = [(i, len(words(t)), s) for i, t, s in docs]
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, n, x in docs if x == s) for s in sources}
    total = sum(size.values())
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sources)}
    target, left, live = dict.fromkeys(sources, Fraction(0)), Fraction(total), [s for s in sources if size[s]]
    while live:
        share = {s: left * weight[s] / sum(weight[x] for x in live) for s in live}
        full = [s for s in live if share[s] > 3 * size[s]]
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = Fraction(3 * size[s])
            left -= target[s]
        live = [s for s in live if s not in full]
    block = max(16, -(-total // 65536))
    blocks, got, shard_of = {s: -(-size[s] // block) for s in sources}, dict.fromkeys(sources, 0), {s: [] for s in sources}
    seats = -(-total // block)
    for seat in range(seats):
        can = [s for s in sources if target[s] and got[s] < 3 * blocks[s]]
        if can:
            s = max(can, key=lambda s: (target[s] / (2 * got[s] + 1), -sources.index(s)))
            got[s] += 1
            shard_of[s].append(next(k for k in range(64) if seat < seats * (k + 1) // 64))
    out = []
    for k, s in enumerate(sources):
        digest = hashlib.md5(f"{seed}:{k}".encode()).hexdigest()
        n = blocks[s]
        if not n:
            continue
        step, first = int(digest[:7], 16) % n, int(digest[7:14], 16) % n
        while gcd(step, n) != 1:
            step += 1
        block_at = {(step * j + first) % n: j for j in range(n)}
        drawn = [(d // n, block_at[d % n], shard_of[s][d]) for d in range(got[s])]
        by = {(p, j): shard for p, j, shard in drawn}
        start = 0
        for i, length, _ in sorted((d for d in docs if d[2] == s), key=lambda d: (hashlib.md5(f"{seed}:{d[0]}".encode()).hexdigest(), d[0], d[1])):
            for p in range(3):
                open_slice = None
                for w in range(length):
                    j = (start + w) // block
                    if (p, j) not in by:
                        open_slice = None
                    elif open_slice is None:
                        open_slice = [i, w, 1, by[p, j]]
                        out.append(open_slice)
                    else:
                        open_slice[2] += 1
            start += length
    return [tuple(x) for x in out]
