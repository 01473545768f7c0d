"""Token counts: word-piece lengths by a linear longest-match automaton.

The vocabulary is a trie with failure links. Each node carries how many tokens are popped when the match falls back along
its link, so a word's greedy longest-match length is found in one pass over its bytes and no piece is ever built. Words
are runs of letters, digits and bytes from 0x80 on; every other character that isn't white space is a word of its own. A
word that the vocabulary can't cover counts as one unknown token.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import text as T
from .cluster import documents

#: Where the vocabulary is if neither the argument nor the session's setting SETTING names another file.
VOCABULARY, SETTING = "/opt/tokenizers/piece_bpe_32k.model", "spark.weftlake.vocabulary"
CACHED = 300_000


def read_vocabulary(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """Pieces that begin a word, and pieces that go on with one."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [m.id_to_piece(i) for i in range(m.get_piece_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i))]
    return [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1], [p for p in pieces if "▁" not in p]


@dataclass
class Automaton:
    """Node 0 begins a word, node 1 goes on with one. edges: sorted node << 8 | byte; link -1: no way on."""

    edges: np.ndarray
    target: np.ndarray
    link: np.ndarray
    popped: np.ndarray
    closing: np.ndarray

    @classmethod
    def build(cls, first: Iterable[str], rest: Iterable[str]) -> Automaton:
        child: list[dict[int, int]] = [{}, {}]
        token = [False, False]
        for root, pieces in ((0, first), (1, rest)):
            for p in pieces:
                at = root
                for b in p.encode():
                    nxt = child[at].get(b)
                    if nxt is None:
                        nxt = child[at][b] = len(child)
                        child.append({})
                        token.append(False)
                    at = nxt
                token[at] = at > 1
        n = len(child)
        link, popped, closing = [-1] * n, [0] * n, [-1] * n
        closing[1] = 0
        queue = [0, 1]
        for at in queue:
            for b, v in child[at].items():
                queue.append(v)
                if token[v]:
                    link[v], popped[v] = 1, 1
                    continue
                z, extra = link[at], popped[at]
                while z >= 0 and b not in child[z]:
                    extra += popped[z]
                    z = link[z]
                if z >= 0:
                    link[v], popped[v] = child[z][b], extra
        for v in queue[2:]:  # a link leads to a shallower rest, which may come later in the queue: follow it whole
            at, total = v, 0
            while at > 1:
                total += popped[at]
                at = link[at]
            closing[v] = total if at == 1 else -1
        keys = np.array([at << 8 | b for at in range(n) for b in child[at]], np.int64)
        to = np.array([v for at in range(n) for v in child[at].values()], np.int32)
        order = np.argsort(keys)
        return cls(keys[order], to[order], np.array(link, np.int32), np.array(popped, np.int32), np.array(closing, np.int32))

    def lengths(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of each word; all words advance together, a byte or a failure link at a time."""
        out = np.zeros(len(starts), np.int64)
        who, pos = np.arange(len(starts)), starts.copy()
        state, total = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if not len(self.edges):
            return np.ones(len(starts), np.int64)
        while len(who):
            key = state << 8 | data[pos]
            at = np.minimum(np.searchsorted(self.edges, key), len(self.edges) - 1)
            hit = self.edges[at] == key
            pos = pos + hit
            total = np.where(hit, total, total + self.popped[state])
            state = np.where(hit, self.target[at], self.link[state])
            lost, over = state < 0, hit & (pos == ends[who])
            out[who[lost]] = 1
            last = self.closing[state[over]]
            out[who[over]] = np.where(last < 0, 1, total[over] + last)
            go = ~(lost | over)
            who, pos, state, total = who[go], pos[go], state[go], total[go]
        return out


def counter(automaton: Automaton):
    """A function from Arrow texts to the token count of each; a null text has none."""
    single = automaton.lengths(np.arange(256, dtype=np.uint8), np.arange(256), np.arange(1, 257))
    single[T.WORD | T.SPACE] = 0
    known: dict[int, int] = {}

    def count(texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        for i, j, data, off, starts, ends, first in T.blocks(texts, lower=False):
            h, at, back = np.unique(T.hashes(data, starts, ends), return_index=True, return_inverse=True)
            got = np.array([known.get(x, -1) for x in h.tolist()], np.int64)
            new = np.flatnonzero(got < 0)
            got[new] = automaton.lengths(data, starts[at[new]], ends[at[new]])
            if len(known) + len(new) > CACHED:
                known.clear()
            known.update(zip(h[new].tolist(), got[new].tolist()))
            words = np.r_[0, np.cumsum(got[back])]
            marks = np.r_[0, np.cumsum(single[data])]
            out[i:j] = np.diff(words[first]) + np.diff(marks[off])
        return out

    return count


def token_counts(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """(doc_id, n_tokens) of every row. The vocabulary is a file that the driver reads.

    A null or empty text has 0 tokens; a null doc_id stays null; repeated rows give repeated rows. Texts of any length are
    counted whole, in one pass and in memory in proportion to them; of pieces that match the longest is taken. An empty table gives no row.
    Other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Automaton.build(*read_vocabulary(vocabulary or spark.conf.get(SETTING, VOCABULARY))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(shared.value)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(count(b.column(1)))], ["doc_id", "n_tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_tokens bigint")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


QUERIES = {"op7_token_counts": op7_token_counts}
ORACLE: dict[str, str] = {}
