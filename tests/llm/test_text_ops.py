"""Operators over documents against brute force, and their edge cases."""

import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from weftlake.llm import decontaminate, jaccard, packing, repeats, token_counts
from weftlake.llm import text as T

from .conftest import SCHEMA, extra, prose, rows


def words(t):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", (t or "").lower())


def test_word_hashes_are_those_of_the_words():
    texts = pa.array(["Ab, c-é d", None, "", "ab C É", "x" * 3_000_000 + " ab"])
    seen = []
    for *_, data, _, s, e, first in T.blocks(texts):
        h = T.hashes(data, s, e)
        seen += [h[first[i] : first[i + 1]].tolist() for i in range(len(first) - 1)]
    assert [len(x) for x in seen] == [4, 0, 0, 3, 2]
    assert seen[0][0] == seen[3][0] == seen[4][1] and seen[0][2] == seen[3][2] and len({*seen[0]}) == 4


# token counts


def greedy(word, first, rest):
    n, i = 0, 0
    while i < len(word):
        pool = rest if i else first
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pool), None)
        if j is None:
            return 1
        n, i = n + 1, j
    return n


@pytest.mark.parametrize("first,rest", [({"a", "ab", "abcd", "b"}, {"a", "b", "c", "bc", "cde", "d", "e"}), ({"x", "é"}, {"x", "xx", "xxx", "éx"}), (set(), {"a"}), ({"a"}, set())])
def test_automaton_is_greedy_longest_match(first, rest):
    import itertools

    alphabet = sorted({c for p in first | rest for c in p})
    all_words = ["".join(w) for n in range(1, 7) for w in itertools.product(alphabet[:5], repeat=n)]
    raw = [w.encode() for w in all_words]
    ends = np.cumsum([len(x) for x in raw])
    data = np.frombuffer(b"".join(raw), np.uint8)
    got = token_counts.Automaton.build(sorted(first), sorted(rest)).lengths(data, ends - [len(x) for x in raw], ends)
    assert got.tolist() == [greedy(w, first, rest) for w in all_words]


def test_token_counts_of_the_vocabulary(docs, docs_rows, no_docs):
    first, rest = map(set, token_counts.read_vocabulary())
    pieces = lambda t: [w for w in re.findall(r"[^\W_]+|[^\w\s]|_", t or "")]
    got = sorted((str(r.doc_id), r.n_tokens) for r in token_counts.token_counts(docs).collect())
    assert got == sorted((str(r[0]), sum(greedy(w, first, rest) for w in pieces(r[1]))) for r in docs_rows)
    assert token_counts.token_counts(no_docs).count() == 0
    assert rows(token_counts.token_counts(extra(docs))) == rows(token_counts.token_counts(docs))


# packing


def test_bins_are_the_fullest_that_can_be():
    r = np.random.default_rng(3)
    for _ in range(30):
        pool = Counter(r.integers(1, 20, 9).tolist())
        got = packing.fullest(dict(pool), 25)
        items = list(pool.elements())
        items.remove(max(items))
        best = max(sum(c) for k in range(len(items) + 1) for c in combinations(items, k) if sum(c) + max(pool) <= 25)
        assert sum(got) == best + max(pool) and not Counter(got) - pool


def test_packing_keeps_every_token(spark, docs, no_docs):
    lengths = token_counts.token_counts(docs)
    out = packing.best_fit(lengths, 300, 2).collect()
    want = Counter()
    for r in lengths.collect():
        want[r.doc_id] += r.n_tokens
    got, bins = Counter(), defaultdict(int)
    for r in out:
        got[r.doc_id] += r.n_tokens
        bins[r.bin_id] += r.n_tokens
        assert r.start_token == r.piece * 300 and 0 < r.n_tokens <= 300
    first_fit: list[int] = []
    for n in sorted((r.n_tokens for r in out), reverse=True):
        k = next((k for k, b in enumerate(first_fit) if b + n <= 300), None)
        first_fit = [b + n * (i == k) for i, b in enumerate(first_fit)] + [n] * (k is None)
    assert got == +want and max(bins.values()) <= 300 and len(bins) <= len(first_fit) + 2
    assert packing.pack_documents(no_docs).count() == 0
    assert rows(packing.pack_documents(extra(docs))) == rows(packing.pack_documents(docs))


# decontamination


def test_suffix_array_order():
    words_ = T.mix(np.random.default_rng(1).integers(0, 4, 400).astype(np.uint64))
    key = decontaminate.symbols(words_)
    s = (words_ >> np.uint64(48)).tolist()
    got = [s[i : i + 16] + [0] * (16 - len(s[i : i + 16])) for i in decontaminate.suffix_array(key, 16)]
    assert got == sorted(got)


def longest(a, b):
    best = (0, 0, 0)
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            best = max(best, (n, -i, -j))
    return best[0], -best[1], -best[2]


def test_matches_are_the_longest(spark, docs, docs_rows, no_docs):
    import random

    r = random.Random(2)
    t = docs_rows[2][1].split()
    tests = [(1, " ".join(t[5:40])), (2, prose(r, 30)), (3, "one two"), (4, docs_rows[39][1]), (5, None), (6, ""), (None, "one"), (7, " ".join(["same"] * 20)), (8, prose(r, 5) + " " + " ".join(t[2:13])), (1, "one")]
    bench = spark.createDataFrame(tests, "item_id bigint, text string")
    best = {}
    for d, text, *_ in docs_rows:
        for i, item in tests:
            q = words(item)
            if d is None or i is None or not q:
                continue
            n, at, item_at = longest(words(text), q)
            if n >= min(decontaminate.LEAST, len(q)):
                best[d, i] = max(best.get((d, i), (0, 0, 0)), (n, -at, -item_at))
    got = {(m.doc_id, m.item_id): (m.match_words, -m.doc_word, -m.item_word) for m in decontaminate.matches(docs, bench).collect()}
    assert got == best and {d for d, _ in got} >= {2, 39, 41, 35, 36}
    kept = [r.doc_id for r in decontaminate.decontaminate(docs, bench).collect()]
    holds = {d for d, text, *_ in docs_rows if "one" in words(text)}  # the item without an id
    hit = {d for d, _ in best} | holds | {None}  # the row without an id holds a passage of item 4
    assert sorted(map(str, kept)) == sorted(str(r[0]) for r in docs_rows if r[0] not in hit)
    assert decontaminate.matches(no_docs, bench).count() == decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(docs_rows)
    assert rows(decontaminate.matches(extra(docs), extra(bench))) == rows(decontaminate.matches(docs, bench))


# repeats


def test_refined_buckets_are_equal_prefixes():
    w = T.mix(np.random.default_rng(0).integers(0, 2, 4000).astype(np.uint64))
    w = np.r_[w[:200], w[:200], w]
    ids = repeats.window_ids(T.grams(w, repeats.Q))
    by_id, by_words = defaultdict(set), defaultdict(set)
    for i, x in enumerate(ids.tolist()):
        by_id[x].add(i)
        by_words[w[i : i + repeats.LENGTH].tobytes()].add(i)
    assert sorted(map(sorted, by_id.values())) == sorted(map(sorted, by_words.values())) and len(ids) == len(w) - repeats.LENGTH + 1


def brute_spans(docs_rows):
    n = repeats.LENGTH
    where = defaultdict(set)
    for d, text, *_ in docs_rows:
        w = words(text)
        for i in range(len(w) - n + 1) if d is not None else ():
            where[" ".join(w[i : i + n])].add((d, i))
    covered, gone = defaultdict(set), defaultdict(set)
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                covered[d].add(i)
                if (d, i) != min(places):
                    gone[d] |= set(range(i, i + n))
    out = []
    for d, starts in covered.items():
        spans = []
        for i in sorted(starts):
            if spans and i <= spans[-1][1]:
                spans[-1][1] = i + n
            else:
                spans.append([i, i + n])
        out += [(d, a, b, b - a, len(gone[d] & set(range(a, b)))) for a, b in spans]
    return sorted(out)


def test_repeated_spans_against_brute_force(docs, docs_rows, no_docs):
    got = sorted(tuple(r) for r in repeats.repeated_spans(docs).collect())
    assert got == brute_spans(docs_rows) and {39, 40, 41} <= {r[0] for r in got}
    assert repeats.repeated_spans(no_docs).count() == 0
    assert rows(repeats.repeated_spans(extra(docs))) == rows(repeats.repeated_spans(docs))


# n-gram Jaccard


def brute_pairs(docs_rows, n=jaccard.N, threshold=jaccard.THRESHOLD):
    sets = {}
    for d, text, *_ in docs_rows:
        w = words(text)
        if d is not None and w:
            k = min(n, len(w))
            sets[d] = frozenset(" ".join(w[i : i + k]) for i in range(len(w) - k + 1))
    classes = defaultdict(list)
    for d in sorted(sets):
        classes[sets[d]].append(d)
    out = {(m[0], d): 1.0 for m in classes.values() for d in m[1:]}
    for (a, x), (b, y) in combinations([(g, m[0]) for g, m in classes.items()], 2):
        j = len(a & b) / len(a | b)
        if j >= threshold:
            out[min(x, y), max(x, y)] = j
    return out


def brute_classes(docs_rows):
    """What jaccard_classes gives, from all pairs of brute_pairs()."""
    pairs = brute_pairs(docs_rows)
    text = {b: a for (a, b), j in pairs.items() if j == 1.0}
    links = defaultdict(set)
    for (a, b), j in pairs.items():
        if j < 1.0:
            links[a].add(b)
            links[b].add(a)
    group: dict[int, int] = {}
    for start in sorted(links):
        todo = [start] if start not in group else []
        for x in todo:
            if x not in group:
                group[x] = start
                todo += links[x]
    copies = Counter(text.values())
    return sorted((d, group.get(t, t), t, len(links[t]), copies[t]) for d in {*links, *text, *text.values()} for t in [text.get(d, d)] if links[t] or copies[t])


def classes(df):
    return sorted(tuple(r) for r in jaccard.jaccard_classes(df).collect())


def test_jaccard_classes_against_brute_force(spark, docs, docs_rows, no_docs):
    got = classes(docs)
    assert got == brute_classes(docs_rows) and {0, 30, 31, 32} <= {r[0] for r in got}
    assert jaccard.jaccard_classes(no_docs).count() == 0
    assert classes(extra(docs)) == got


@pytest.fixture
def near_copies(spark):
    import random

    r = random.Random(9)
    table, n = [], 0
    for k in range(25):
        base = prose(r, r.choice([20, 60, 150, 500, 1500])).split()
        for _ in range(30 if k == 3 else 4):
            w = [prose(r, 1) if r.random() < r.choice([0.0, 0.0, 0.05, 0.1, 0.15]) else x for x in base]
            table.append((n, " ".join(w), "en", "s", 0))
            n += 1
    return table, spark.createDataFrame(table, SCHEMA).repartition(5)


def test_jaccard_loses_no_link(near_copies):
    table, df = near_copies
    assert classes(df) == brute_classes(table)


def test_jaccard_with_split_blocks_shuffled_texts_and_groups_on_executors(near_copies, monkeypatch):
    from weftlake import runtime

    table, df = near_copies
    monkeypatch.setattr(jaccard, "PART", 500)
    monkeypatch.setattr(jaccard, "FLUSH", 2000)
    monkeypatch.setattr(jaccard, "FEW", 0)
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", 0)
    assert classes(df) == brute_classes(table)


def test_copies_whose_grams_each_have_another_leader(spark):
    import random

    w = prose(random.Random(11), 40).split()
    table = [(k, " ".join([f"a{k}", f"b{k}", *w[k : k + 4], f"c{k}", f"d{k}"]), "en", "s", 0) for k in range(5)]
    table += [(d, " ".join(w[:8]), "en", "s", 0) for d in (10, 11)] + [(12, " ".join([*w[:7], "other"]), "en", "s", 0)]
    table += [(20 + k, " ".join([f"e{k}", f"f{k}", *w[10 + k : 14 + k], f"g{k}"]), "en", "s", 0) for k in range(17)]
    table += [(40, " ".join(w[30:36]), "en", "s", 0), (41, " ".join(w[10:36]), "en", "s", 0), (42, " ".join(w[10:30]), "en", "s", 0)]
    got = classes(spark.createDataFrame(table, SCHEMA).repartition(3))
    assert got == brute_classes(table) and {10, 11, 12, 41, 42} <= {r[0] for r in got}
    assert not {11, 12} & {r.doc_id for r in jaccard.keep_one(spark.createDataFrame(table, SCHEMA)).collect()}


def test_ids_that_repeat_or_are_null(spark):
    import random

    r = random.Random(12)
    t = [prose(r, 50) for _ in range(6)]
    table = [(1, t[0], "en", "a", 1), (1, t[1], "en", "a", 1), (2, t[1], "en", "a", 1), (3, t[2], "en", "a", 1), (3, t[2], "en", "a", 1), (None, t[2], "en", "a", 1), (None, t[3], "en", "a", 1), (None, t[3], "en", "b", 1), (None, "", "en", "b", 1), (4, None, "en", "b", 1)]
    df = spark.createDataFrame(table, SCHEMA).repartition(3)
    kept = Counter(x.text for x in jaccard.keep_one(df).collect())
    assert kept == Counter([t[0], t[1], t[2], t[3], "", None])
    assert {x.doc_id for x in jaccard.keep_one(df).where(f"text = '{t[1]}'").collect()} == {2}
    assert {x[:3] for x in classes(df)} == {(1, 1, 1), (2, 1, 1)}


def test_divide_skip_finds_what_merging_finds():
    r = np.random.default_rng(4)
    sets = [np.unique(r.choice(80, r.integers(1, 40)).astype(np.uint64)) for _ in range(40)]
    lists = jaccard.Lists(sets)
    for q in range(len(sets)):
        found, overlap = lists.near(q, 0.4)
        want = {d: len(np.intersect1d(sets[q], sets[d])) for d in range(q + 1, len(sets))}
        want = {d: o for d, o in want.items() if o >= 0.4 * (len(sets[q]) + len(sets[d]) - o) - 1e-9}
        assert dict(zip(found.tolist(), overlap.tolist())) == want
    assert jaccard.heap_merge([np.array([1, 2, 5]), np.array([2, 5]), np.array([5, 7])], 2) == [(2, 2), (5, 3)]
    assert jaccard.heap_merge([], 1) == []


def test_one_document_of_each_group_stays(spark, docs, docs_rows, no_docs, monkeypatch):
    kept = Counter(r.doc_id for r in jaccard.keep_one(docs).collect())
    want = Counter(r[0] for r in docs_rows if r[0] not in (30, 31, 32, 40, None))  # 39 and 40 are near the row without an id
    want[docs_rows[5][0]] = 1  # equal rows are one
    assert kept == want and jaccard.keep_one(no_docs).count() == 0
    assert jaccard.keep_one(extra(docs)).columns == extra(docs).columns
    chain = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(40, 30), (30, 35)], "doc_a bigint, doc_b bigint")
    for few in (jaccard.FEW, 0):
        monkeypatch.setattr(jaccard, "FEW", few)
        assert {r.doc_id: r.keep for r in jaccard.components(chain).collect()} == {**{i: 0 for i in range(1, 21)}, 40: 30, 35: 30}
