"""Private data found by a linear-chain conditional random field over word-shape features.

The model is trained here, on a small labelled table of tokens (labelled_table()), by gradient ascent on its likelihood.
Texts are split at white space. Words of letters and punctuation alone share one emission, so only windows around other
tokens are decoded: Viterbi in numpy, many windows at a time, from and to the tag O. Whole texts are read.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from . import text as T
from .cluster import documents

KINDS = ["EMAIL", "PHONE", "IP", "CARD", "ID", "SECRET"]
TAGS = ["O", *(f"{p}-{k}" for k in KINDS for p in "BI")]
K = len(TAGS)
#: Plain tokens decoded on either side of one that isn't plain.
MARGIN = 3
NOT_SPACE = ~T.SPACE
STRIP = ".,;:!?\"'`%&*$#|<>[]{}~_"
KEYWORDS = {"token", "password", "passwd", "passphrase", "pwd", "secret", "key", "api_key", "api-key", "apikey", "access_key", "secret_key", "client_secret", "auth", "bearer", "credential"}
#: Sentences of the labelled table. {d3} stands for 3 digits; o: a number below 256, h: hex digits, u: capitals and digits, U: capitals,
#: z: small letters and digits, m: letters of both cases and digits, C: letters of both cases, x: small letters, k: a keyword, w: a word.
TEMPLATES = """
{w} {w} [EMAIL {x}@{x}.com] {w} {w}|{w} {w} [EMAIL {x}.{d1}@{x}{d1}.{x3}.com] {w}|{w} [EMAIL {x}.{d2}@{x}{d1}.{x}.com] {w} {w}|{w} [EMAIL {x}{d3}@{x}.{x}.org] {w}|[EMAIL {x}_{x}@{x}.org] {w} {w} {w}|{w} {w}: [EMAIL {x}.{x}@{x}.{x}.net]. {w}|{w} {w} [EMAIL {x}+{d2}@{x}.io] {w} {w}|{w} [EMAIL {x}{d2}@{x}-{x}.de] {w}|{w} ([EMAIL {x}@{x}.co.uk]) {w}|{w} [EMAIL {W}.{W}@{x}.com], {w}
{w} {w} [PHONE +{d1} ({d3}) {d3}-{d4}] {w} {w}|{w} [PHONE +{d1} ({d3}) {d3}-{d4}]|{w} {w} [PHONE ({d3}) {d3}-{d4}] {w} {w}|{w} [PHONE {d3}-{d3}-{d4}] {w}|{w} {w} [PHONE +{d2} {d2} {d4} {d4}] {w} {w}|{w} [PHONE +{d1}-{d3}-{d3}-{d4}] {w}|{w} [PHONE {d3}.{d3}.{d4}] {w}|[PHONE +{d2} {d3} {d7}] {w} {w}|{w} [PHONE +{d2} {d3} {d3} {d4}] {w}
{w} {w} [IP {o}.{o}.{o}.{o}] {w} {w}|{w} [IP {o}.{o}.{o}.{o}] {w}|[IP {o}.{o}.{o}.{o}] {w} {w}|{w} {w} {w} [IP {o}.{o}.{o}.{o}]. {w}|{w} [IP {o}.{o}.{o}.{o}]|{w} {w} [IP {o}.{o}.{o}.{o}:{d4}] {w}|[IP {o}.{o}.{o}.{o}] [IP {o}.{o}.{o}.{o}] {w}|{w} [IP {d1}.{o}.{o}.{o}] {w}|{w} [IP {d2}.{d2}.{d1}.{d2}] {w}
{w} [IP {h4}:{h4}:{h4}:{h4}:{h4}:{h4}:{h4}:{h4}] {w}|{w} {w} [IP {h4}:{h3}:{h4}:{d4}:{d4}:{h4}:{h4}:{d4}] {w}|{w} [IP fe80::{d1}] {w}|{w} [IP {d4}:{x2}{d1}::{h4}:{d4}] {w}|[IP {h4}::{h4}:{h4}] {w}|{w} [IP {d4}:{h3}:{h4}::{h4}:{d3}:{h4}] {w}|{w} [IP fe80::{h4}:{h4}:{h4}:{h4}] {w}|{w} [IP {d4}:db8::{d1}] {w}|{w} [IP {h4}:{h4}:{d1}:{d1}:{d1}:{d1}:{d1}:{d1}] {w}
{w} {w} [CARD {d16}] {w} {w}|{w} [CARD {d16}] {w}|[CARD {d16}] {w} {w}|{w} [CARD {d4} {d4} {d4} {d4}] {w} {w}|{w} [CARD {d4}-{d4}-{d4}-{d4}] {w}|{w} {w} [CARD {d15}] {w}|{w} [CARD {d16}]|{w} {w} [CARD {d16}] [CARD {d16}] {w}|{w} [CARD {d4} {d6} {d5}] {w}|{w} [CARD {d19}] {w}
{w} {w} [ID {d3}-{d2}-{d4}] {w} {w}|{w} [ID {d3}-{d2}-{d4}] {w}|[ID {d3}-{d2}-{d4}] {w}|{w} {w} [ID {U2}{d2}{U4}{d14}] {w}|{w} [ID {U2}{d20}] {w}|{w} [ID {U2}{d2} {U4} {d4} {d4} {d4} {d2}] {w}|IBAN [ID {U2}{d2} {d4} {d4} {d4} {d4} {d2}] {w}|{w} IBAN: [ID {U2}{d2} {U4} {d4} {d4} {d4} {d2}]|{w} [ID {U2}{d2} {d4} {d4} {d4} {d4} {d4} {d3}] {w}|{w} [ID {U2}{d2} {U4} {d4} {d4} {d2}] {w}|IBAN [ID {U2}{d2}{U4}{d14}] {w}|{w} [ID {U2}{d16}] {w}
{w} {w} {k} = [SECRET "{h40}"] {w} {w}|{w} {w}. {w} {k} = [SECRET {h32}] {w}|{w} [SECRET {k}={h18}] {w} {w}|{w} {w} [SECRET {k}={h18}] {w}|{w} {k}: [SECRET {h40}] {w} {w}|{w} [SECRET AKIA{u16}] {w} {w}|{w} {w} [SECRET AKIA{u16}] {w}|{w} [SECRET {k}={h24}] {w}|{w} {k} = [SECRET {m32}] {w}|{w} [SECRET sk-{m32}] {w}|{w} {w} [SECRET ghp_{m36}] {w}|{w} bearer [SECRET {m40}] {w}|{w} [SECRET {k}="{h40}"] {w}|{w} {k}={w} [SECRET {k}={m24}] {w}
{w} {k} is [SECRET {x6}{d1}] {w} {w}|{w} {k} is [SECRET {z10}]|the {k} is [SECRET {m12}] {w}|{w} {k}: [SECRET {z8}] {w}|{k}: [SECRET {x7}-{x5}-{x7}] {w}|{w} {k}: [SECRET {x5}-{x6}-{x4}-{x7}] {w} {w}|{k}: [SECRET {C20}]|{w} {k}: [SECRET {C16}] {w}|{w} {k}: [SECRET {C28}] {w}|{k}: [SECRET {m24}] {w}|{w} {k} = [SECRET {C24}] {w}|{w} {k}: [SECRET {m9}!] {w}|{w} {k} = [SECRET {z9}] {w}|{w} {k}: [SECRET "{m16}"] {w}|{w} {w} {k}: [SECRET {x5}-{x7}-{x6}]
{w} {w} {w} {w} {w}|{w} {w}, {w} {w}. {w} {w}|{w} {w} 3. {w} {w}|{w} {w} Version 2.0. {w} {w}|{w} CC BY-NC 4.0. {w} {w}|{w} {d4} {w} {w}|{w} {d2} {w} {d3} {w}|{w} 3.2.1 {w} {w}|{w} {d1}.{d2} {w} {w}|{w} {w} v1.2.3 {w}|{w} ${d3}.{d2} {w}|{w} {d2}:{d2} {w} {w}|{w} {d4}-{d2}-{d2} {w}|{w} {x}={d1} {w}|{w} = {w} {w}|{w} = {d2} {w}|{w} @{x} {w} {w}|{w} {d1},{d3} {w}|{w} {d5} {w} {w}|{w} {d6} {w} {w}|{w} {d8} {w} {w}|{w} ({d1}) {w} {w}|{w} {d2}% {w}|{w} {U3} {w} {U5} {w}|{w} {x}{d1} {w} {x}{d2} {w}|{w} {U2}-{d4} {w} {w}|{w} token {w} {w}|{w} the key = {w} {w}|{w} {k} {w} {w}|({w}) {w} {w} ({d4}) {w}|{w} +{d1} {w} {w}|{w} {d3}-{d3} {w}|{w} {d1}/{d1}/{d4} {w}|{w} {d2}-{w} {w}|{w} {x}/{x} {w}|{w} www.{x}.com {w}|{w} {U12} {U14} {U16} {w}
commit {h40} {w} {w}|{w} commit {h40}. {w}|{w} {w} {h40} {w} {w}|{w} {h40}|sha256 {h64} {w}|{w} sha256: {h64} {w}|{w} {h64} {w} {w}|{w} {h7} {w} {w}|{w} {h32} {w} {w}|{w} commit {h12} {w}|{w} digest sha1: {h40} {w}|{w} {h8}-{h4}-{h4}-{h4}-{h12} {w} {w}|{w} id {h8}-{h4}-{h4}-{h4}-{h12}|{w} ISBN {d3}-{d1}-{d2}-{d6}-{d1} {w}|ISBN {d13} {w} {w}|{w} {d13} {w}|{w} {d3}-{d1}-{d4}-{d4}-{d1} {w} {w}|ISBN {d1}-{d3}-{d5}-{d1} {w}|{w} {d10} {w} {w}|{w} {d12} {w}|{w} {d9} {w} {w}
{w}: {w} {w}|{w} {w}: {d2} {w}|{w}: {x}-{x} {w} {w}|{w} {x}-{x}-{x} {w} {w}|{w} {d2}:{d2}:{d2} {w}|{w} {d4}-{d2}-{d2}T{d2}:{d2}:{d2} {w}|{w} {x}:{d1} {w}|{w} {k}: {w} {w} {w}|{k}: {w} {w}|{w} {k} is {w} {w}|the {k} is {w}|{w} {C12} {w} {w}|{w} {U4} {U2} {w}|{U6} {U5} {w}|{w}: {C14} {w}|{w} https://{x}.com/{x}/{d4} {w}|{w} http://{x}.{x}.org {w}|{w} {d3} x {d3} {w}|{w} {d1}.{d1}.{d1} {w}|{w} {x4}{d4} {w} {w}|{w} {U4}{d3} {w}|{w} {U2}{d2} {w} {w}|{w} {d4} {d4} {w} {w}|{w} {d4} {w} {d4} {w}|{w} {d2} {d2} {w}|{w} ({d3}) {w} {w}|{w} {d1}:{d1} {w}|{w} {w}: {x6}{d1} {w}|IBAN {w} {w}|{w} ISBN {w} {w}|{w} key: {w} {w}|{w} {C8} {C10} {w}|{w}::{w} {w} {w}|{w} 1.{d1}.{d2} {w} {w}
""".replace("\n", "|").strip("|").split("|")
_ALPHABETS = {"d": "0123456789", "h": "0123456789abcdef", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "U": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "C": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "m": "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "z": "abcdefghijklmnopqrstuvwxyz0123456789"}


def _fill(pattern: str, r: random.Random) -> str:
    """Text outside braces stays; what is in braces is replaced by random characters of its kind."""

    def one(m: re.Match) -> str:
        kind, n = m[1], int(m[2] or 0)
        if kind == "o":
            return str(r.randint(1, 255))
        if kind == "k":
            return (lambda k: k.upper() if r.random() < 0.1 else k.capitalize() if r.random() < 0.2 else k)(r.choice(sorted(KEYWORDS)))
        out = "".join(r.choice(_ALPHABETS.get(kind, "abcdefghijklmnopqrstuvwxyz")) for _ in range(n or r.randint(2, 9)))
        return out.capitalize() if kind == "W" else out

    return re.sub(r"\{([a-zA-Z])(\d*)\}", one, pattern)


@lru_cache(maxsize=1)
def labelled_table(copies: int = 5, seed: int = 7) -> tuple[tuple[int, int, str, str], ...]:
    """(sentence, position, token, tag): the templates, each filled with random characters a few times."""
    r = random.Random(seed)
    rows, n = [], 0
    for template in TEMPLATES:
        for _ in range(copies):
            at = 0
            noise = r.choice(["", "", "", "", "%%%", "!!", "&&&", "$$$", "***", "###"])
            for part in re.findall(r"\(?\[[A-Z]+ [^\]]*\][).,]*|\S+", template):
                item = re.match(r"(\(?)\[([A-Z]+) ([^\]]*)\](.*)", part)
                tokens = item[3].split() if item else [part]
                for k, pattern in enumerate(tokens):
                    word = _fill(pattern, r)
                    word = word.capitalize() if pattern == "{w}" and r.random() < 0.2 else word
                    word = (item[1] if item and k == 0 else "") + word + (item[4] if item and k == len(tokens) - 1 else "")
                    rows.append((n, at, word + noise, f"{'I' if k else 'B'}-{item[2]}" if item else "O"))
                    at += 1
            n += 1
    items = [x for t in TEMPLATES for x in re.findall(r"\[([A-Z]+) ([^\]]*)\]", t) if x[0] != "SECRET" or re.match(r"\{k\}=|AKIA|sk-|ghp_", x[1])]
    for _ in range(40 * copies):  # several items side by side
        at = 0
        for kind, part in [("", "{w}")] * r.randint(0, 1) + r.choices(items, k=r.randint(2, 3)) + [("", "{w}")]:
            for k, pattern in enumerate(part.split()):
                rows.append((n, at, _fill(pattern, r), f"{'I' if k else 'B'}-{kind}" if kind else "O"))
                at += 1
        n += 1
    return tuple(rows)


def core(token: str) -> tuple[int, int]:
    """Where the token begins and ends without the punctuation around it."""
    a, b = 0, len(token)
    while a < b and token[a] in STRIP:
        a += 1
    while b > a and token[b - 1] in STRIP:
        b -= 1
    if b - a > 2 and "@" in token:
        while a < b and token[a] in "(":
            a += 1
        while b > a and token[b - 1] in ")":
            b -= 1
    return a, b


def _class(group: str) -> str:
    """d: digits, x: small letters, X: capitals, C: both; with digits h: a hex number, m, M or z: small, capitals, both."""
    if group.isdigit():
        return "d"
    lower, upper = any(c.islower() for c in group), any(c.isupper() for c in group)
    if not any(c.isdigit() for c in group):
        return "C" if upper and lower else "X" if upper else "x"
    return "z" if upper and lower else "M" if upper else "h" if not set(group) - set("0123456789abcdef") else "m"


def _size(n: int) -> int:
    """Lengths that are told apart."""
    return n if n <= 4 or 12 < n <= 16 else next(x for x in (64, 40, 32, 24, 20, 17, 10, 8, 5) if n >= x)


_GROUPS = re.compile(r"[^\W_]+|[\W_]")


def neighbour_class(token: str) -> str:
    """What a token says of those beside it."""
    c = token[slice(*core(token))]
    if c.rstrip(":=").lower() in KEYWORDS:
        return "assigned" if token.rstrip(STRIP.replace(":", ""))[-1:] in (":", "=") else "keyword"
    if token == "=":
        return "equals"
    groups = _GROUPS.findall(c)
    if not any(x.isdigit() for x in c):
        return f"X{len(c)}" if len(groups) == 1 and 2 <= len(c) <= 5 and c.isupper() else "plain"
    if len(c) <= 5 and len(groups) == 1:
        return f"{_class(c)}{len(c)}"
    return "".join(_class(g) + str(_size(len(g))) if g[0].isalnum() else g for g in groups) if len(groups) <= 7 and set(c) <= set("0123456789+-().") else "number" if c.isdigit() else "other"


def plain(token: str) -> bool:
    """Letters and punctuation only, and no sign of a secret: it doesn't begin a window."""
    return not (any(x.isdigit() for x in token) or "@" in token or "=" in token or ":" in token or len(token) >= 16 and not any(x.islower() or ord(x) > 127 for x in token))


def features(token: str) -> list[str]:
    """Of the shape of the token alone: the classes of its groups of letters and digits, with and without lengths, and its punctuation."""
    c = token[slice(*core(token))]
    groups = _GROUPS.findall(c)
    alnum = [g for g in groups if g[0].isalnum()]
    if plain(token):
        odd = f"capitals {min(len(c), 6)}" if len(alnum) == len(groups) == 1 and c.isupper() and len(c) > 1 else f"hyphens {min(c.count('-'), 3)}" if c.count("-") > 1 else "mixed letters" if len(c) >= 8 and _class(c) == "C" and not c[1:].islower() else ""
        return ["plain", "class=" + neighbour_class(token), *[odd] * bool(odd)]
    kinds = [_class(g) if g[0].isalnum() else g for g in groups]
    shape = "".join(kinds)
    rough = re.sub(r"(?:a([:.\-])){3,}", r"a\1..", "".join("a" if g[0].isalnum() else g for g in groups))
    longest = max(alnum, key=len, default="")
    out = ["rough=" + rough, f"length={_size(len(c) or 1)}", f"digits={_size(sum(x.isdigit() for x in c) or 1)}", f"groups={min(len(alnum), 9)}", f"longest={_class(longest) if longest else ''}{_size(len(longest) or 1)}"]
    if len(groups) <= 9:
        out += ["shape=" + shape, "sizes=" + "".join(k + str(_size(len(g))) if g[0].isalnum() else k for k, g in zip(kinds, groups))]
    if alnum:
        out += [f"first={_class(alnum[0])}{_size(len(alnum[0]))}", f"last={_class(alnum[-1])}{_size(len(alnum[-1]))}", f"marks={''.join(sorted({g for g in groups if not g[0].isalnum()}))}"]
        if all(g.isdigit() for g in alnum):
            out.append(f"bytes={all(int(g) < 256 for g in alnum if len(g) < 9)}, {max(map(len, alnum)) <= 3}, {min(len(alnum), 5)}")
        head = re.match(r"([^=:]+)[=:](.)", c)
        if head and head[1].lower() in KEYWORDS:
            out += ["assigns", f"assigns {_class(longest)}"]
        if all(set(g) <= set("0123456789abcdefABCDEF") and len(g) <= 4 for g in alnum) and ":" in c:
            out.append(f"short hex, {min(c.count(':'), 7)}, {'::' in c}")
        letters = re.match(r"[A-Z]+", alnum[0])
        out.append(f"capitals {min(len(letters[0]), 6)}" if letters and len(alnum) == 1 else "no capitals")
    if not any(x.isdigit() for x in c):
        out.append("letters only")
    return out


NEAR = (-2, -1, 1, 2)


class Crf:
    """Weights of the features, of the neighbours' classes at NEAR, and of transitions."""

    def __init__(self, table: tuple[tuple[int, int, str, str], ...], rounds: int = 150):
        sentences: dict[int, list[tuple[str, str]]] = {}
        for s, _, token, tag in sorted(table):
            sentences.setdefault(s, []).append((token, tag))
        rows = list(sentences.values())
        self.index: dict[str, int] = {}
        n, longest = len(rows), max(map(len, rows))
        ids = [[self._ids([t for t, _ in row], i, True) for i in range(len(row))] for row in rows]
        size = len(self.index)
        design = np.zeros((n, longest, size))
        tags, mask = np.zeros((n, longest), int), np.zeros((n, longest), bool)
        for i, row in enumerate(rows):
            for j, (_, tag) in enumerate(row):
                np.add.at(design[i, j], ids[i][j], 1.0)
                tags[i, j], mask[i, j] = TAGS.index(tag), True
        allowed = np.array([[b[0] != "I" or a[1:] == b[1:] for b in TAGS] for a in TAGS])
        forbid = np.where(allowed, 0.0, -1e4)
        start = np.array([0.0 if t[0] != "I" else -1e4 for t in TAGS])
        w, tr = np.zeros((size, K)), np.zeros((K, K))
        moments = [np.zeros_like(x) for x in (w, w, tr, tr)]
        one = np.eye(K)
        for k in range(1, rounds + 1):
            e = design @ w
            e = np.exp(e - e.max(2, keepdims=True))
            t = np.exp(tr + forbid)
            alpha, beta = np.empty((n, longest, K)), np.ones((n, longest, K))
            scale = np.ones((n, longest, 1))
            for j in range(longest):
                step = e[:, j] * (alpha[:, j - 1] @ t if j else np.exp(start))
                scale[:, j] = step.sum(1, keepdims=True)
                alpha[:, j] = np.where(mask[:, j, None], step / scale[:, j], alpha[:, j - 1] if j else 0)
            for j in range(longest - 2, -1, -1):
                beta[:, j] = np.where(mask[:, j + 1, None], (e[:, j + 1] * beta[:, j + 1] / scale[:, j + 1]) @ t.T, 1)
            p = alpha * beta * mask[..., None]
            gw = np.tensordot(design, one[tags] * mask[..., None] - p, ((0, 1), (0, 1)))
            gt = np.zeros_like(tr)
            for j in range(1, longest):
                m = mask[:, j]
                gt += one[tags[m, j - 1]].T @ one[tags[m, j]] - t * (alpha[m, j - 1].T @ (e[m, j] * beta[m, j] / scale[m, j]))
            for x, g, a, b in ((w, gw - 0.02 * w, 0, 1), (tr, gt - 0.02 * tr, 2, 3)):
                moments[a] = 0.9 * moments[a] + 0.1 * g
                moments[b] = 0.99 * moments[b] + 0.01 * g * g
                x += 0.1 * (moments[a] / (1 - 0.9**k)) / (np.sqrt(moments[b] / (1 - 0.99**k)) + 1e-8)
        self.w, self.transitions, self.start = w, tr + forbid, start

    def _ids(self, tokens: list[str], i: int, grow: bool = False) -> list[int]:
        names = features(tokens[i]) + [f"{d}:{neighbour_class(tokens[i + d]) if 0 <= i + d < len(tokens) else 'plain'}" for d in NEAR]
        return [self.index.setdefault(x, len(self.index)) for x in names] if grow else [self.index[x] for x in names if x in self.index]

    def emissions(self, tokens: list[str]) -> np.ndarray:
        return np.array([self.w[self._ids(tokens, i)].sum(0) for i in range(len(tokens))]).reshape(-1, K)

    def decode(self, emissions: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best tags of many windows at once, padded to one width."""
        n, width, _ = emissions.shape
        best = np.empty_like(emissions)
        back = np.zeros((n, width, K), np.int8)
        best[:, 0] = self.start + emissions[:, 0]
        for j in range(1, width):
            step = best[:, j - 1, :, None] + self.transitions
            back[:, j] = step.argmax(1)
            best[:, j] = np.take_along_axis(step, back[:, j, None, :].astype(int), 1)[:, 0] + emissions[:, j]
        tags = np.zeros((n, width), int)
        now = best[np.arange(n), length - 1].argmax(1)
        for j in range(width - 1, -1, -1):
            live = j < length
            tags[live, j] = now[live]
            if j:
                now = np.where(live, back[np.arange(n), j, now], now)
        return tags


@lru_cache(maxsize=1)
def model() -> Crf:
    return Crf(labelled_table())


_BITS = np.zeros(256, np.uint8)
_BITS[48:58] = 1
_BITS[[ord("@"), ord("="), ord(":")]] = 1
_BITS[97:123] = 2
_BITS[128:] = 2


def finder(crf: Crf):
    """A function from texts to the private spans of each: text number -> [(first byte, last byte + 1, kind)]."""
    emission: dict[str, np.ndarray] = {}
    classes: dict[str, str] = {}
    near = {d: {x[len(f"{d}:") :]: crf.w[i] for x, i in crf.index.items() if x.startswith(f"{d}:")} for d in NEAR}
    zero = np.zeros(K)

    def own(token: str) -> np.ndarray:
        if token not in emission:
            if len(emission) > 100_000:
                emission.clear()
                classes.clear()
            emission[token] = crf.w[[crf.index[x] for x in features(token) if x in crf.index]].sum(0)
        if token not in classes:
            classes[token] = neighbour_class(token)
        return emission[token]

    def find(texts: pa.Array) -> dict[int, list[tuple[int, int, str]]]:
        out: dict[int, list[tuple[int, int, str]]] = {}
        for i, _, data, off, starts, ends, first in T.blocks(texts, lower=False, table=NOT_SPACE):
            if not len(starts):
                continue
            bits = np.bitwise_or.reduceat(np.r_[_BITS[data], np.uint8(0)], np.c_[starts, ends].ravel())[::2]
            odd = np.flatnonzero(((bits & 1) > 0) | ((ends - starts >= 16) & (bits & 2 == 0)))
            if not len(odd):
                continue
            doc = np.searchsorted(first, odd, "right") - 1
            lo, hi = np.maximum(odd - MARGIN, first[doc]), np.minimum(odd + MARGIN + 1, first[doc + 1])
            head = np.r_[True, (lo[1:] > hi[:-1]) | (doc[1:] != doc[:-1])]
            lo, hi, doc = lo[head], hi[np.r_[head[1:], True]], doc[head]
            order = np.argsort(hi - lo, kind="stable")
            for k in range(0, len(order), 2048):
                chunk = order[k : k + 2048]
                tokens = [[data[starts[t] : ends[t]].tobytes().decode("utf-8", "replace") for t in range(lo[x], hi[x])] for x in chunk]
                width = max(map(len, tokens))
                e = np.zeros((len(chunk), width, K))
                for a, row in enumerate(tokens):
                    own_rows = [own(t) for t in row]
                    cls = ["plain"] * 2 + [classes[t] if t in classes else neighbour_class(t) for t in row] + ["plain"] * 2
                    for b, v in enumerate(own_rows):
                        e[a, b] = v + sum(near[d].get(cls[b + 2 + d], zero) for d in NEAR)
                tags = crf.decode(e, np.array([len(r) for r in tokens]))
                for a in np.flatnonzero(tags.any(1)):
                    x = chunk[a]
                    base = off[doc[x]]
                    spans = out.setdefault(int(i + doc[x]), [])
                    for b, token in enumerate(tokens[a]):
                        name = TAGS[tags[a, b]]
                        if name == "O":
                            continue
                        p, q = core(token)
                        begin = int(starts[lo[x] + b] - base)
                        span = (begin + len(token[:p].encode()), begin + len(token[:q].encode()), name[2:])
                        if name[0] == "I" and spans and tags[a, b - 1]:
                            spans[-1] = (spans[-1][0], span[1], span[2])
                        else:
                            spans.append(span)
        return out

    return find


def _redacted(text: str, spans: list[tuple[int, int, str]]) -> tuple[str, list[dict]]:
    """The text with each span replaced by its kind, and the spans in characters of the given text."""
    raw, out, last, chars, listed = text.encode(), [], 0, 0, []
    for a, b, kind in sorted(spans):
        chars += len(raw[last:a].decode())
        out += [raw[last:a].decode(), f"[{kind}]"]
        size = len(raw[a:b].decode())
        listed.append({"start": chars, "end": chars + size, "kind": kind})
        chars += size
        last = b
    return "".join(out) + raw[last:].decode(), listed


def private_spans(docs: DataFrame) -> DataFrame:
    """The documents that hold private data: (doc_id, n_spans, spans, text), with characters of each span and the redacted text.

    Null, empty and clean texts give no row. A null doc_id stays null, repeated rows give repeated rows. Texts of any length are
    read whole, in memory in proportion to their words; of tags that tie the first in TAGS is taken. An empty table gives no row.
    Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model())
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(shared.value)
        for b in batches:
            found = sorted(find(b.column(1)).items())
            done = [_redacted(b.column(1)[i].as_py(), s) for i, s in found]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([len(s) for _, s in done], pa.int32()), pa.array([s for _, s in done], kind), pa.array([t for t, _ in done], pa.string())], ["doc_id", "n_spans", "spans", "text"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_spans int, spans array<struct<start:int,end:int,kind:string>>, text string")


def redact(docs: DataFrame) -> DataFrame:
    """All rows and columns, private spans in text replaced by their kind; a bigint n_chars that isn't null follows the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model())
    at = docs.columns.index("text")
    count = docs.columns.index("n_chars") if dict(docs.dtypes).get("n_chars") == "bigint" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = finder(shared.value)
        for b in batches:
            found = find(b.column(at))
            if found:
                mask = np.zeros(b.num_rows, bool)
                mask[list(found)] = True
                new = [_redacted(b.column(at)[i].as_py(), found[i])[0] for i in sorted(found)]
                columns = list(b.columns)
                columns[at] = pc.replace_with_mask(b.column(at), pa.array(mask), pa.array(new, b.column(at).type))
                if count is not None:
                    columns[count] = pc.if_else(pc.and_(pa.array(mask), pc.is_valid(b.column(count))), pc.cast(pc.utf8_length(columns[at]), pa.int64()), b.column(count))
                b = pa.RecordBatch.from_arrays(columns, schema=b.schema)
            yield b

    return docs.mapInArrow(run, docs.schema)


def op6_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return private_spans(documents(spark, sf_dir))


QUERIES = {"op6_private_data": op6_private_data}
ORACLE: dict[str, str] = {}
