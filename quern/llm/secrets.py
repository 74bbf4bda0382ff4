"""Secret scan: Aho-Corasick keyword prefilter, anchored patterns near hits, checksum validation."""

from __future__ import annotations

import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import arrow_map, documents_of

# The patterns of the base kinds and the least lengths of what counts.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
# Prefixes of tokens that end in six base-62 digits of the CRC-32 of the thirty before.
CHECKED = re.compile(r"(ghp|gho|ghu|ghs|ghr|npm)_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z_])")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])")
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----[A-Za-z0-9+/=\s]*-----END [A-Z ]*PRIVATE KEY-----")
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE = ("assign", "access", "hex")
KINDS = (*BASE, "checked", "card", "private_key")

# What the automaton looks for, in lower case, and the kind each leads to.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
            "akia": "access", "ghp_": "checked", "gho_": "checked", "ghu_": "checked", "ghs_": "checked", "ghr_": "checked", "npm_": "checked",
            "-----begin ": "private_key", "card": "card", "visa": "card", "payment": "card"}
NEAR = 64  # characters from the start of a card word in which a number starts
LONGEST = 38  # characters of the longest match of CARD and the one after it
_RUN = bytes(1 if chr(b) in "0123456789abcdef" else 0 for b in range(256))
_LOWER = {c: c + 32 for c in range(65, 91)}


def base62_crc(body: str) -> str:
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, r = divmod(n, 62)
        out = DIGITS[r] + out
    return out.rjust(6, "0")


def luhn(number: str) -> bool:
    d = [int(c) for c in number if c.isdigit()][::-1]
    return len(set(d)) > 1 and (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def hex_runs(text: str, least: int) -> list[tuple[int, int]]:
    """Maximal runs of [0-9a-f] of ``least`` or more: a literal search for that many marks in the text's class map."""
    try:
        marks = text.encode("latin-1", "replace").translate(_RUN)  # one byte a code point; '?' is no hex digit
    except UnicodeEncodeError:
        return [m.span() for m in HEX.finditer(text) if m.end() - m.start() >= least]
    out, at, want = [], 0, b"\1" * least
    while (at := marks.find(want, at)) >= 0:
        end = marks.find(0, at + least)
        end = len(marks) if end < 0 else end
        out.append((at, end))
        at = end
    return out


def scan_text(text: str, keywords) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every secret in one text, by start, then kind as listed, then end."""
    low = text.lower() if text.isascii() else text.translate(_LOWER)
    found, done = [], dict.fromkeys(KINDS, 0)
    hits = sorted({(end - n + 1, kind) for end, (kind, n) in keywords.iter(low)})
    for at, kind in hits:
        if at < done[kind] and kind != "card":
            continue
        if kind == "assign":
            if m := ASSIGN.match(text, at):
                done[kind] = m.end()
                if m.end(2) - m.start(2) >= LEAST[kind]:
                    found.append((kind, at, m.end()))
        elif kind == "access":
            if m := ACCESS.match(text, at):
                done[kind] = m.end()
                if m.end() - at >= LEAST[kind]:
                    found.append((kind, at, m.end()))
        elif kind == "checked":
            if (m := CHECKED.match(text, at)) and base62_crc(m[2]) == m[3]:
                done[kind] = m.end()
                found.append((kind, at, m.end()))
        elif kind == "private_key":
            if m := KEY_BLOCK.match(text, at):
                done[kind] = m.end()
                found.append((kind, at, m.end()))
        else:
            start, near = max(at, done[kind]), at + NEAR
            while (m := CARD.search(text, start, near + LONGEST)) and m.start() < near:
                start = m.start() + 1  # of a number that fails, later groups of digits may start one that holds
                if luhn(m[0]):
                    start = done[kind] = m.end()
                    found.append((kind, *m.span()))
    found += [("hex", a, b) for a, b in hex_runs(text, LEAST["hex"])]
    return sorted(set(found), key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def find_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, spans): spans is array<struct<kind, start, end>> in code points, end exclusive.

    Base kinds: assign, access and hex. Added: checked (tokens whose embedded CRC-32 holds),
    card (Luhn-valid numbers that start within ``NEAR`` characters of a card word's start, all of them) and private_key blocks. A null or empty text has
    no spans; repeated rows are kept; one scan without a shuffle; other columns are ignored.
    """

    def make():
        keywords = automaton()

        def each(batch: pa.RecordBatch) -> dict:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in scan_text(t, keywords)] for t in batch.column(1).to_pylist()]
            return {"doc_id": batch.column(0), "spans": spans}

        return each

    return arrow_map(documents_of(docs), "doc_id long, spans array<struct<kind:string,start:long,end:long>>", make)
