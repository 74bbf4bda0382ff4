"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def simhash(docs):
    import xxhash

    fps = {}
    for d, t in docs:
        low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
        h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
        fps[d] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return fps


def components(fps, tau):
    ids, seen, out = sorted(fps), set(), {}
    by = defaultdict(list)
    for d in ids:
        by[fps[d]].append(d)
    keys = list(by)
    for k in sorted(keys, key=lambda x: by[x][0]):
        if k in seen:
            continue
        seen.add(k)
        todo, group = [k], []
        while todo:
            x = todo.pop()
            group.append(x)
            for y in keys:
                if y not in seen and (x ^ y).bit_count() <= tau:
                    seen.add(y)
                    todo.append(y)
        root = min(d for x in group for d in by[x])
        out |= {d: root for x in group for d in by[x]}
    return out


def suffixes(docs, width):
    """(n_bytes, n_removed, n_spans, sha of the kept bytes) per row, rows in order."""
    places = defaultdict(int)
    raws = [(t or "").encode() for _, t in docs]
    for r in raws:
        for i in range(len(r) - width + 1):
            places[r[i:i + width]] += 1
    out = []
    for r in raws:
        hit = bytearray(len(r))
        for i in range(len(r) - width + 1):
            if places[r[i:i + width]] > 1:
                hit[i:i + width] = b"\1" * width
        kept = bytes(b for b, x in zip(r, hit) if not x)
        out.append((len(r), sum(hit), len(re.findall(b"\1+", bytes(hit))), sha(kept)))
    return out


def best_fit(lengths, limit):
    """Number of bins of item-by-item best-fit decreasing."""
    import bisect

    free, n = [], 0
    for x in sorted(lengths, reverse=True):
        k = bisect.bisect_left(free, x)
        if k == len(free):
            n += 1
            rest = limit - x
        else:
            rest = free.pop(k) - x
        if rest:
            bisect.insort(free, rest)
    return n


def secrets(text):
    """Base spans by whole-text patterns."""
    spec = (("assign", r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
            ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
    out = []
    for k, (kind, pattern, group, least) in enumerate(spec):
        out += [(m.start(), k, kind, m.end()) for m in re.finditer(pattern, text) if len(m[group]) >= least]
    return [(kind, a, b) for a, k, kind, b in sorted(out)]


def added_secrets(text, near=64):
    """Checked tokens, card numbers and key blocks: every position is tried from left to right, by own digit and checksum rules."""
    import zlib

    digits = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    out, low = [], text.lower()
    words = [m.start() for w in ("card", "visa", "payment") for m in re.finditer(f"(?={w})", low)]
    done = dict.fromkeys(("checked", "card", "private_key"), 0)
    for p in range(len(text)):
        if p >= done["checked"] and (m := re.match(r"(?:gh[pousr]|npm)_([0-9A-Za-z]{36})(?![0-9A-Za-z_])", text[p:])):
            n = 0
            for c in m[1][30:]:
                n = n * 62 + digits.index(c)
            if n == zlib.crc32(m[1][:30].encode()):
                done["checked"] = p + m.end()
                out.append(("checked", p, p + m.end()))
        if p >= done["private_key"] and (m := re.match(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----", text[p:])):
            done["private_key"] = p + m.end()
            out.append(("private_key", p, p + m.end()))
        if p >= done["card"] and any(w <= p < w + near for w in words) and text[p] in "0123456789" and (p == 0 or text[p - 1] not in "0123456789"):
            places, q = [p], p + 1
            while q < len(text) and len(places) < 19:
                if text[q] in " -" and q + 1 < len(text) and text[q + 1] in "0123456789":
                    q += 1
                if text[q] not in "0123456789":
                    break
                places.append(q)
                q += 1
            while len(places) >= 13 and places[-1] + 1 < len(text) and text[places[-1] + 1] in "0123456789":
                places.pop()
            number = [int(text[i]) for i in places]
            total = sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(number[::-1]))
            if len(number) >= 13 and len(set(number)) > 1 and total % 10 == 0:
                done["card"] = places[-1] + 1
                out.append(("card", p, places[-1] + 1))
    return sorted(out, key=lambda x: (x[1], ("checked", "card", "private_key").index(x[0])))


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]
