"""HTML extraction by equivalence classes of tokens.

The pages of a host are instances of a template. A token (a tag or a word, told apart by the path of tags it stands in) has
an occurrence vector: how often it is on each page. Tokens with equal vectors form a class; the classes of those that are once
on every page, but for a few odd ones, are the template's frame, the others are parts that repeat or that some pages have. A
word counts only if it stands next to another token of the template. A class is valid if its tokens follow each other in one
order wherever it occurs and all its occurrences on a page lie in one gap of one class, again but for a few odd pages. So
valid classes are nested in each other, and every gap of a class is a slot. What stands in the slots and is not template is
extracted. Vectors are never gathered: each is a 64-bit sum over pages of counts times a random number of the page, and
tasks add up what they have seen of any host, so pages aren't exchanged and no host is too large. Counted are the tokens that
can be on enough pages, by bounds that blocks of pages give; none that is on enough is left out. Only these words are hashed;
they go along with their numbers, so all other text is only split and looked up.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as T
from .cluster import BROADCAST_BYTES, cut, join_small, plan_bytes

#: Different pages that a host has at least if it has a template. Without one, all text is extracted.
TEMPLATED = 2
#: Pages that a class must be on: this share of the host's, and so many at least if the host has as many; tokens of a class that isn't the frame.
SUPPORT, PAGES, LEAST = 0.1, 3, 2
#: Share of pages on which a class, a word or a token of the frame may fail: error pages, truncated ones.
ODD = 0.05
#: Different tokens of a block of pages, by host, or asked for of the hosts that a task counts; characters of a block's pages;
#: tokens whose counts a task adds up before it gives them on.
BLOCK, LETTERS, HELD = 1 << 20, 1 << 27, 300_000
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(script|style)\b[^>]*>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^"'<>]++|"[^"<]*+"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][\w:-]*)([^>]*)(?:>|\Z)|<![^>]*>?""",
    re.S | re.I,
)
_CLASS = re.compile(r"\b(?:class|id)\s*=\s*[\"']?([\w-]+)", re.I)
_VOID = {"br", "hr", "img", "meta", "link", "input", "area", "base", "col", "embed", "source", "track", "wbr"}
_INLINE = {"b", "i", "em", "strong", "u", "span", "small", "sup", "sub", "a", "font"}
_BLOCK = {"p", "div", "li", "br", "tr", "h1", "h2", "h3", "h4", "h5", "h6", "ul", "ol", "table", "section", "article"}
SLOTS = "page_id bigint, host string, slot int, text string"


class Reader:
    """Splits pages into tokens. A token's number is a hash of it and its path, and a last bit: 1 for a word.

    A word's number begins with 19 bits of the path; 43 bits are of path and word together."""

    def __init__(self):
        self.paths: dict[str, int] = {}
        self.moves: dict[str, dict[str, tuple[int, str, str, int]]] = {}
        self.met = 0

    def path(self, where: str) -> int:
        v = self.paths.get(where)
        if v is None:
            v = self.paths[where] = xxhash.xxh3_64_intdigest(where) >> 45
        return v

    def move(self, where: str, m: re.Match) -> tuple[int, str, str, int]:
        """Number of a tag that is met at a path (-1: it is none), what is shown of it, and the path after it with its hash.

        A block tag closes an open paragraph; inline tags don't change the path, so one that is never closed does no harm.
        """
        script, *parts = m.groups()
        slash, name, rest = parts[:3] if parts[1] else parts[3:]
        if script:
            key, shown = f"{where}<{script.lower()}>", f"<{script.lower()}>"
        elif not name:
            return -1, "", where, self.path(where)
        else:
            name, path = name.lower(), where.split("/") if where else []
            if slash:
                if name in path and name not in _INLINE:
                    while path.pop() != name:
                        pass
                    where = "/".join(path)
                shown = f"</{name}>"
                key = where + shown
            else:
                if name in _BLOCK and path and path[-1] == "p":
                    path.pop()
                    where = "/".join(path)
                found = _CLASS.search(rest) if rest else None
                shown = f"<{name}>"
                key = f"{where}<{name}.{found[1]}>" if found else where + shown
                if name not in _VOID and name not in _INLINE and not rest.rstrip().endswith("/"):
                    where = f"{where}/{name}" if where else name
        return xxhash.xxh3_64_intdigest(key) >> 2 << 1, shown, where, self.path(where)

    def items(self, page: str) -> list[tuple[int, int, str]]:
        """(number, path, tag) of each tag and (-1, path, text) of each text between tags, entities decoded.

        Scripts, styles and comments are one token each without what is in them.
        """
        out: list[tuple[int, int, str]] = []
        if self.met > 100_000:
            self.moves.clear()
            self.paths.clear()
            self.met = 0
        where, here, last = "", self.path(""), 0
        moves = self.moves.setdefault("", {})
        for m in _TAG.finditer(page):
            begin, end = m.span()
            if begin > last:
                text = page[last:begin]
                if not text.isspace():
                    out.append((-1, here, decoded(text) if "&" in text else text))
            last = end
            raw = m[0]
            move = moves.get(raw)
            if move is None:
                move = self.move(where, m)
                if end - begin <= 64:
                    moves[raw] = move
                    self.met += 1
            v, shown, after, at = move
            if v >= 0:
                out.append((v, at, shown))
                if after != where:
                    where, here = after, at
                    moves = self.moves.setdefault(where, {})
        if last < len(page) and not page[last:].isspace():
            out.append((-1, here, decoded(page[last:])))
        return out

    def numbers(self, page: str) -> list[int]:
        """All tokens of a page in order."""
        out: list[int] = []
        for v, path, what in self.items(page):
            if v >= 0:
                out.append(v)
            else:
                out += [word_id(path, w) for w in what.split()]
        return out


def word_id(path: int, word: str) -> int:
    return path << 44 | xxhash.xxh3_64_intdigest(word, path + 1) >> 21 << 1 | 1


def decoded(text: str) -> str:
    """html.unescape, which calls back for each entity; texts whose only one is &amp; needn't."""
    return text.replace("&amp;", "&") if text.count("&") == text.count("&amp;") else html.unescape(text)


def page_random(ids: np.ndarray) -> np.ndarray:
    return T.mix(ids.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(99)) | np.uint64(1)


def vectors(pages: list[str], page_ids: np.ndarray) -> tuple[np.ndarray, ...]:
    """Token, pages, occurrences, occurrence-vector sum, sum of first places, and pages on which it is once, of all tokens."""
    reader = Reader()
    parts: list[tuple[np.ndarray, ...]] = []
    for i, p in enumerate(pages):
        u, place, c = np.unique(np.array(reader.numbers(p), np.int64), return_index=True, return_counts=True)
        parts.append((u, place, c, np.full(len(u), i)))
    t, place, c, o = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 4
    return _added(np.zeros(len(t), np.int64), t, np.ones(len(t), np.int64), c, (c.astype(np.uint64) * page_random(page_ids)[o]).view(np.int64), place, (c == 1).astype(np.int64))[1:]


def _added(host: np.ndarray, token: np.ndarray, *sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Sums for each host and token."""
    order = np.lexsort((token, host))
    host, token = host[order], token[order]
    head = np.flatnonzero(np.r_[True, (token[1:] != token[:-1]) | (host[1:] != host[:-1])]) if len(token) else np.zeros(0, np.int64)
    return host[head], token[head], *(np.add.reduceat(x[order], head) if len(token) else x for x in sums)


def out_of_order(places: list[int]) -> set[int]:
    """Which of the places aren't in a longest rising sequence of them."""
    if all(a < b for a, b in zip(places, places[1:])):
        return set()
    tails: list[int] = []
    at: list[int] = []
    before: list[int] = []
    for i, p in enumerate(places):
        k = bisect_left(tails, p)
        before.append(at[k - 1] if k else -1)
        tails[k:], at[k:] = [p, *tails[k + 1 :]], [i, *at[k + 1 :]]
    i, kept = at[-1], set()
    while i >= 0:
        kept.add(i)
        i = before[i]
    return set(range(len(places))) - kept


class Template:
    """The classes of one host: the frame's tokens in order, and of each other class its tokens in order.

    Slots are numbered: 0 before the frame, then one after each token of the frame, then of each class. Names are the sorted
    numbers of words, at least of those in the classes, and words are these words, with spaces between.
    """

    def __init__(self, frame: list[int], nested: list[list[int]], names: list[int], words: str):
        self.classes = [frame, *nested]
        self.place = {t: (c, i) for c, tokens in enumerate(self.classes) for i, t in enumerate(tokens)}
        self.base = [0]
        for tokens in self.classes:
            self.base.append(self.base[-1] + len(tokens))
        mine = [(t, w) for t, w in zip(names, words.split(" ")) if t in self.place]
        self.worded = by_path([t for t, _ in mine], [w for _, w in mine])

    def tokens(self, reader: Reader, page: str) -> list[tuple[int, str]]:
        """Numbers and what is shown of tags and words of the template; what stands between them in a text is one, numbered -1."""
        out: list[tuple[int, str]] = []
        for number, path, what in reader.items(page):
            known = self.worded.get(path) if number < 0 else None
            if known is None:
                out.append((number, what))
                continue
            words, last = what.split(), 0
            for k, t in enumerate(map(known.get, words)):
                if t is not None:
                    if k > last:
                        out.append((-1, " ".join(words[last:k])))
                    out.append((t, words[k]))
                    last = k + 1
            if last < len(words):
                out.append((-1, " ".join(words[last:]) if last else what))
        return out

    def beside(self, tokens: list[tuple[int, str]]) -> dict[int, bool]:
        """Of each word of the template on the page, whether it ever stands next to another token of the template."""
        inside = [x if x in self.place else -1 for x, _ in tokens]
        out: dict[int, bool] = {}
        for k, x in enumerate(inside):
            if x >= 0 and x & 1:
                out[x] = out.get(x, False) or k > 0 and inside[k - 1] >= 0 or k + 1 < len(inside) and inside[k + 1] >= 0
        return out

    def walk(self, tokens: list[tuple[int, str]], ignored: set[int] | frozenset[int] = frozenset()) -> tuple[list[tuple[int, str, bool]], dict[int, list], set[int]]:
        """Tags and what isn't template, with the slot they are in; of each class on the page whether its tokens, but for ignored
        ones, are in order and the least and greatest slot it is in; tokens of the frame that are out of order."""
        rest: list[tuple[int, str, bool]] = []
        seen: dict[int, list] = {}
        place, base, classes = self.place, self.base, self.classes
        if ignored:
            place = {t: m for t, m in place.items() if t not in ignored}
        frame = [k for k, (t, _) in enumerate(tokens) if t in place and place[t][0] == 0]
        wrong = {frame[k] for k in out_of_order([place[tokens[k][0]][1] for k in frame])}
        at, stack = 0, []

        def close(upto: int) -> None:
            while len(stack) > upto:
                seen[stack.pop()[0]][0] = False

        def following(c: int, i: int) -> int:
            while i < len(classes[c]) and classes[c][i] in ignored:
                i += 1
            return i

        for k, (t, shown) in enumerate(tokens):
            m = place.get(t)
            if m is not None:
                c, i = m
                if c == 0:
                    if k not in wrong:
                        close(0)
                        at = i + 1
                else:
                    slot = base[stack[-1][0]] + stack[-1][1] if stack else at
                    mine = next((x for x in range(len(stack) - 1, -1, -1) if stack[x][0] == c), -1)
                    if i == following(c, 0):
                        if mine >= 0:
                            close(mine)
                            slot = base[stack[-1][0]] + stack[-1][1] if stack else at
                        s = seen.setdefault(c, [True, slot, slot])
                        s[1], s[2] = min(s[1], slot), max(s[2], slot)
                        if following(c, i + 1) < len(classes[c]):
                            stack.append([c, following(c, i + 1)])
                    elif mine < 0:
                        seen.setdefault(c, [True, slot, slot])[0] = False
                    else:
                        close(mine + 1)
                        if stack[-1][1] != i:
                            close(mine)
                        elif following(c, i + 1) == len(classes[c]):
                            stack.pop()
                        else:
                            stack[-1][1] = following(c, i + 1)
            slot = base[stack[-1][0]] + stack[-1][1] if stack else at
            if m is None or not t & 1:
                rest.append((slot, shown, t >= 0 and not t & 1))
            if m is not None and stack:  # texts of one slot in several occurrences of a class are lines of their own
                rest.append((slot, "<br>", True))
        close(0)
        return rest, seen, {tokens[k][0] for k in wrong}


def by_path(names: list[int], words: list[str]) -> dict[int, dict[str, int]]:
    """Each path's words with their numbers, which are sorted and so begin with one path after the other."""
    paths = np.array(names, np.int64) >> 44
    edges = [*np.flatnonzero(np.diff(paths, prepend=-1)).tolist(), len(names)]
    return {int(paths[a]): dict(zip(words[a:b], names[a:b])) for a, b in zip(edges, edges[1:])}


def _template(known: dict[str, Template], row) -> Template:
    if row.host not in known:
        if len(known) > 5000:
            known.clear()
        known[row.host] = Template(row.frame, row.nested, row.names, row.words)
    return known[row.host]


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^(?:[a-zA-Z][\w+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1))
    return pages.where("page_id is not null and html is not null and html != ''").select("page_id", host.alias("host"), "html")


def _by_host(pages: DataFrame, table: DataFrame, run, schema: str) -> DataFrame:
    """run(batches, lookup) over the pages; lookup(host, row) gives the host's rows of a written table, broadcast if small."""
    if 4 * plan_bytes(table) <= BROADCAST_BYTES:
        rows = {r.host: r for r in table.collect()}
        shared = pages.sparkSession.sparkContext.broadcast(rows)
        return pages.mapInArrow(lambda batches: run(((b, [shared.value.get(h) for h in b.column(1).to_pylist()]) for b in batches)), schema)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql import Row

        return run((b, [Row(**r) if r else None for r in b.column(3).to_pylist()]) for b in batches)

    right = table.select("host", F.struct(*table.columns).alias("row"))
    return pages.join(right, "host", "left").select("page_id", "host", "html", "row").mapInArrow(joined, schema)


def _different(h: DataFrame) -> DataFrame:
    """One row for each different page of a host: copies would look like a template."""
    keyed = h.withColumn("k", F.xxhash64("html"))
    many = cut(keyed.groupBy("host", "k").agg(F.count("k").alias("n")).where("n > 1").select("host", "k"))
    if many.isEmpty():
        return h
    copies = join_small(keyed, many, ["host", "k"], "left_semi").groupBy("host", "k").agg(F.min(F.struct("page_id", "html")).alias("m")).select("m.page_id", "host", "m.html")
    return join_small(keyed, many, ["host", "k"], "left_anti").select("page_id", "host", "html").unionByName(copies)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, token, word, more): how many more pages of a block of the host's pages a token is on than the most that is too few there.

    Rows of tokens -1 and -2 have that number and the number of pages. A token is on as many pages of the host as these
    numbers come to, or fewer: in blocks that don't give it, it is on too few. Tags have no word.
    """
    reader = Reader()
    held: dict[str, tuple[Counter, dict[int, Counter]]] = {}
    size = letters = 0

    def send() -> Iterator[pa.RecordBatch]:
        for host, (tags, texts) in held.items():
            n = tags.pop(-2)
            few = max(0, int(np.ceil(SUPPORT * n - 1e-9)) - 1)
            words = ((word_id(path, w), w, c - few) for path, counts in texts.items() for w, c in counts.items() if c > few)
            rows = chain([(-1, None, few), (-2, None, n)], ((t, None, c - few) for t, c in tags.items() if c > few), words)
            while some := list(islice(rows, 50_000)):
                token, word, more = zip(*some)
                yield pa.RecordBatch.from_arrays([pa.array([host] * len(token), pa.string()), pa.array(token, pa.int64()), pa.array(word, pa.string()), pa.array(more, pa.int64())], ["host", "token", "word", "more"])

    for b in batches:
        for page, host in zip(b.column(2).to_pylist(), b.column(1).to_pylist()):
            tags, texts = held.setdefault(host, (Counter(), {}))
            met, here = {-2}, {}
            for v, path, what in reader.items(page):
                if v >= 0:
                    met.add(v)
                else:
                    here.setdefault(path, set()).update(what.split())
            size -= len(tags)
            tags.update(met)
            size += len(tags)
            for path, words in here.items():
                counts = texts.setdefault(path, Counter())
                size -= len(counts)
                counts.update(words)
                size += len(counts)
            letters += len(page)
            if size >= BLOCK or letters >= LETTERS:
                yield from send()
                held, size, letters = {}, 0, 0
                T.trim()
    yield from send()


def _enough(n):
    """Pages that a token must be on."""
    return F.least(n, F.greatest(F.lit(PAGES), F.ceil(SUPPORT * n - 1e-9)))


def _count(source) -> Iterator[pa.RecordBatch]:
    """Sums over the pages at hand, for each host and token asked for."""
    reader, names, known = Reader(), [], {}
    none, other = {}, repeat(-1)
    held: list[tuple[np.ndarray, ...]] = []
    size = asked = 0

    def send() -> Iterator[pa.RecordBatch]:
        if held:
            h, *cols = _added(*(np.concatenate(x) for x in zip(*held)))
            for a in range(0, len(h), 50_000):
                at, token = h[a : a + 50_000], cols[0][a : a + 50_000]
                spelt = {i: {t: w for x in known[names[i]][2].values() for w, t in x.items()} for i in np.unique(at).tolist()}
                word = [spelt[i].get(t) for i, t in zip(at.tolist(), token.tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(names).take(pa.array(at)), pa.array(word, pa.string()), *(pa.array(x[a : a + 50_000]) for x in cols)], ["host", "word", "token", "pages", "occ", "fp", "place", "once"])

    for b, rows in source:
        rand = page_random(b.column(0).to_numpy())
        for page, row, r in zip(b.column(2).to_pylist(), rows, rand):
            if row is None:
                continue
            if row.host not in known:
                known[row.host] = len(names), set(row.tags), by_path(row.names, row.words.split(" "))
                names.append(row.host)
                asked += len(row.tags) + len(row.names)
            host, tags, texts = known[row.host]
            tokens: list[int] = []
            for v, path, what in reader.items(page):
                if v >= 0:
                    tokens.append(v if v in tags else -1)
                else:
                    tokens += map(texts.get(path, none).get, what.split(), other)
            here = np.array(tokens, np.int64)
            at = np.flatnonzero(here >= 0)
            u, place, c = np.unique(here[at], return_index=True, return_counts=True)
            place = at[place]
            held.append((np.full(len(u), host), u, np.ones(len(u), np.int64), c, (c.astype(np.uint64) * r).view(np.int64), place, (c == 1).astype(np.int64)))
            size += len(u)
            if size >= HELD or asked >= BLOCK:
                held[:] = [_added(*(np.concatenate(x) for x in zip(*held)))]
                size = len(held[0][0])
                if size >= HELD // 2 or asked >= BLOCK:
                    yield from send()
                    held.clear()
                    names, known, size, asked = [], {}, 0, 0
                    T.trim()
    yield from send()


def templates(pages: DataFrame) -> DataFrame:
    """(host, frame, nested): tokens of the frame and of the valid classes, in order."""
    h = _different(_hosted(pages))
    bound = cut(h.mapInArrow(_blocks, "host string, token bigint, word string, more bigint").groupBy("host", "token", "word").agg(F.sum("more").alias("more")))
    per = bound.where("token < 0").groupBy("host").agg(F.sum(F.when(F.col("token") == -1, F.col("more"))).alias("few"), F.sum(F.when(F.col("token") == -2, F.col("more"))).alias("n"))
    per = cut(per.where(F.col("n") >= TEMPLATED))
    asked = join_small(bound.where("token >= 0"), per, "host").where(F.col("more") + F.col("few") >= _enough(F.col("n")))
    word = F.when(F.col("word").isNotNull(), F.struct("token", "word"))
    spelt = lambda pairs: (F.transform(pairs, lambda x: x.token).alias("names"), F.array_join(F.transform(pairs, lambda x: x.word), " ").alias("words"))
    frequent = asked.groupBy("host").agg(F.collect_list(F.when(F.col("word").isNull(), F.col("token"))).alias("tags"), F.sort_array(F.collect_list(word)).alias("pairs"))
    frequent = cut(frequent.select("host", "tags", *spelt("pairs")))
    counted = _by_host(h, frequent, _count, "host string, word string, token bigint, pages bigint, occ bigint, fp bigint, place bigint, once bigint")
    # sums wrap around: two halves are added apart and put together
    low, high = F.sum(F.col("fp").bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftrightunsigned("fp", 32))
    total = cut(counted.groupBy("host", "token", "word").agg(F.sum("pages").alias("pages"), F.sum("occ").alias("occ"), low.alias("low"), high.alias("high"), F.sum("place").alias("place"), F.sum("once").alias("once")))
    fp = F.struct(F.col("low").bitwiseAND(0xFFFFFFFF), (F.col("high") + F.shiftright("low", 32)).bitwiseAND(0xFFFFFFFF))
    supported = join_small(total, per.select("host", "n"), "host").where(F.col("pages") >= _enough(F.col("n")))
    whole = F.col("once") == F.col("n")
    is_frame = F.col("once") >= F.col("n") - F.floor(ODD * F.col("n"))
    # tokens of a class are on the same pages, so their mean first places are in the order that they have on the pages
    by_place = F.transform(F.sort_array(F.collect_list(F.struct("place", "token"))), lambda x: x.token)
    classes = supported.groupBy("host", "n", fp.alias("fp"), is_frame.alias("frame"), whole.alias("whole")).agg(by_place.alias("tokens"), F.collect_list(word).alias("pairs")).where(F.col("frame") | (F.size("tokens") >= LEAST))
    frames = F.sort_array(F.collect_list(F.when(F.col("frame"), F.col("tokens")))).alias("frames")
    nested = F.sort_array(F.collect_list(F.when(~F.col("frame"), F.col("tokens")))).alias("nested")
    found = classes.groupBy("host", "n").agg(frames, F.bool_and(~F.col("frame") | F.col("whole")).alias("plain"), nested, F.sort_array(F.flatten(F.collect_list("pairs"))).alias("pairs"))
    found = cut(found.select("host", "n", "frames", "plain", "nested", *spelt("pairs")))

    def order(source) -> Iterator[pa.RecordBatch]:
        """The orders in which the frame's tokens stand on the pages that have most of them."""
        reader, known = Reader(), {}
        for b, rows in source:
            acc: dict[tuple[str, bytes], int] = {}
            most: dict[str, int] = {}
            for page, row in zip(b.column(2).to_pylist(), rows):
                if row is None or row.plain:
                    continue
                if row.host not in known:
                    if len(known) > 5000:
                        known.clear()
                    known[row.host] = Template([t for c in row.frames for t in c], [], row.names, row.words)
                t = known[row.host]
                here = [x for x, _ in t.tokens(reader, page) if x in t.place]
                times = Counter(here)
                here = [x for x in here if times[x] == 1]
                if len(here) >= most.get(row.host, 1):
                    most[row.host] = len(here)
                    key = row.host, np.array(here, np.int64).tobytes()
                    acc[key] = acc.get(key, 0) + 1
            keys = [k for k in acc if len(k[1]) == 8 * most[k[0]]]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.string()), pa.array([acc[k] for k in keys], pa.int64()), pa.array([np.frombuffer(k[1], np.int64).tolist() for k in keys], pa.list_(pa.int64()))], ["host", "times", "seq"])

    none = F.array().cast("array<bigint>")
    ordered = found.select("host", "n", F.flatten("frames").alias("frame"), "nested", "names", "words")
    if not found.where("not plain").isEmpty():
        seen = _by_host(h, found.select("host", "plain", "frames", "names", "words"), order, "host string, times bigint, seq array<bigint>").groupBy("host", "seq").agg(F.sum("times").alias("times"))
        best = seen.groupBy("host").agg(F.max(F.struct(F.size("seq"), "times", "seq")).alias("m")).select("host", F.col("m.seq").alias("seq"))
        # a class that isn't on the page with most of the frame is one of the others
        apart = F.filter("frames", lambda c: (F.size(c) >= LEAST) & F.col("seq").isNotNull() & ~F.array_contains(F.coalesce("seq", none), c[0]))
        ordered = found.join(best, "host", "left").select("host", "n", F.coalesce("seq", F.flatten("frames")).alias("frame"), F.concat(apart, "nested").alias("nested"), "names", "words")
    ordered = cut(ordered)

    def check(source) -> Iterator[pa.RecordBatch]:
        """Counts of pages: c = -1, a frame token (at) is out of order; -2 or -3, a word (at) stands alone or not; else the class
        is in the slot at, -1 if out of order or in several."""
        reader, known = Reader(), {}
        for b, rows in source:
            acc: dict[str, tuple[Counter, Counter, Counter, Counter]] = {}
            for page, row in zip(b.column(2).to_pylist(), rows):
                if row is None:
                    continue
                t = _template(known, row)
                tokens = t.tokens(reader, page)
                beside = t.beside(tokens)
                lone = {x for x, ok in beside.items() if not ok}
                _, seen, late = t.walk(tokens, lone)
                if row.host not in acc:
                    acc[row.host] = Counter(), Counter(), Counter(), Counter()
                out, alone, near, slots = acc[row.host]
                out.update(late)
                alone.update(lone)
                near.update(beside.keys() - lone)
                slots.update([(c, lo if good and lo == hi else -1) for c, (good, lo, hi) in seen.items()])
            rows = [(h, c, x, n) for h, sums in acc.items() for c, s in zip((-1, -2, -3), sums) for x, n in s.items()]
            rows += [(h, c, x, n) for h, sums in acc.items() for (c, x), n in sums[3].items()]
            columns = list(zip(*rows)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.string(), *[pa.int64()] * 3))], ["host", "c", "at", "pages"])

    checked = cut(_by_host(h, ordered, check, "host string, c bigint, at bigint, pages bigint").groupBy("host", "c", "at").agg(F.sum("pages").alias("pages")))
    late = checked.where("c = -1").join(ordered.select("host", "n"), "host").where(F.col("pages") > F.floor(ODD * F.col("n"))).select("host", "at")
    alone = F.coalesce(F.sum(F.when(F.col("c") == -2, F.col("pages"))), F.lit(0))
    lone = checked.where("c in (-2, -3)").groupBy("host", "at").agg(alone.alias("alone"), F.sum("pages").alias("pages")).where(F.col("alone") > F.floor(ODD * F.col("pages"))).select("host", "at")
    gone = late.unionByName(lone).groupBy("host").agg(F.collect_set("at").alias("gone"))
    per = checked.where("c > 0").groupBy("host", "c").agg(F.sum("pages").alias("pages"), F.max(F.when(F.col("at") >= 0, F.col("pages"))).alias("most"))
    valid = per.where(F.col("most") >= F.col("pages") - F.floor(ODD * F.col("pages"))).groupBy("host").agg(F.sort_array(F.collect_list(F.col("c").cast("int"))).alias("valid"))
    left = lambda c: F.array_except(c, F.coalesce("gone", none))
    nested = F.transform(F.coalesce("valid", F.array().cast("array<int>")), lambda c: left(F.get("nested", c - 1)))
    return cut(ordered.join(gone, "host", "left").join(valid, "host", "left").select("host", left("frame").alias("frame"), F.filter(nested, lambda c: F.size(c) >= LEAST).alias("nested"), "names", "words"))


def extract(pages: DataFrame, template: DataFrame) -> DataFrame:
    """(page_id, host, slot, text): what stands in each slot and isn't template, block tags as line breaks."""

    def run(source) -> Iterator[pa.RecordBatch]:
        reader, known, whole = Reader(), {}, Template([], [], [], "")
        for b, rows in source:
            out: list[tuple] = []
            for page_id, host, page, row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), rows):
                t = whole if row is None else _template(known, row)
                slots: dict[int, list[str]] = {}
                for g, w, is_tag in t.walk(t.tokens(reader, page))[0]:
                    if is_tag:
                        if w.strip("</>") in _BLOCK and slots.get(g):
                            slots[g].append("\n")
                    else:
                        slots.setdefault(g, []).append(" ".join(w.split()))
                for g, words in sorted(slots.items()):
                    text = re.sub(r" ?\n[ \n]*", "\n", " ".join(words)).strip()
                    if text:
                        out.append((page_id, host, g, text))
                if len(out) > 20_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) if out else [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.string(), pa.int32(), pa.string()))], ["page_id", "host", "slot", "text"])

    return _by_host(_hosted(pages), template, run, SLOTS)


def page_slots(pages: DataFrame) -> DataFrame:
    """A row for each slot of each page that isn't empty: page_id, host, number of the slot in the host's template, text.

    Null ids, null and empty pages give no row. A null url, or one without a host, belongs to the host "". Repeated rows and
    copies of a page give rows each, but count once when the template is found. The only page of a host has no template:
    all its text is slot 0. Pages of any length are read whole, in memory in proportion to the longest one. An empty table
    gives no row. Of classes that tie for a place the least is taken. Other columns are ignored.
    """
    return extract(pages, templates(pages))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_slots(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLE: dict[str, str] = {}
