"""Token counts by trie-shared dynamic programming.

A text is cut into pre-tokens (a word, signs or blanks, with the blank before it). The distinct pre-tokens of
a batch form a trie of bytes, and the best unigram segmentation of every prefix is computed once, at its trie
node: the best score of a node is the best over the vocabulary's pieces that end there of the score of the
node where the piece begins plus the piece's. The node where a pre-token ends holds its token count, and a
document's count is the sum over its pre-tokens. A pre-token of many bytes shares next to nothing of its path, so
beyond ``LONG`` bytes the same scores are computed along its own path, in time that grows with its length.

The vocabulary is a file of pieces and ranks (base64 and a number a line; every single byte is a piece, so
every text has a segmentation). A piece's score is the logarithm of a Zipf probability of its rank, as such
files hold no frequencies; of equal segmentations the one with fewer tokens counts.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

PRE_TOKEN = re.compile(r" ?\w+| ?[^\w\s]+|\s+")
#: Distinct pre-tokens of a batch beyond which it is cut: bounds the trie.
TRIE_WORDS = 200_000
#: Bytes of a pre-token from which it has a path of its own; the trie has no more levels than that.
LONG = 256
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def read_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """Pieces in the order of their ranks."""
    with open(path, "rb") as f:
        ranks = [line.split() for line in f if line.strip()]
    return [base64.b64decode(p) for p, _ in sorted(ranks, key=lambda r: int(r[1]))]


def piece_scores(n: int) -> np.ndarray:
    """Log probabilities by Zipf's law: rank r (from 1) has a share of 1 / r."""
    rank = np.arange(1, n + 1)
    return -np.log(rank) - np.log((1 / rank).sum())


class Vocabulary:
    """The pieces as a trie in one table: ``step[state, byte]`` (0: none) and the score of the piece that ends there."""

    def __init__(self, pieces: list[bytes]) -> None:
        scores = piece_scores(max(len(pieces), 1))
        children: list[dict[int, int]] = [{}, {}]
        value = [-np.inf, -np.inf]
        for piece, score in zip(pieces, scores):
            node = 1
            for byte in piece:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    value.append(-np.inf)
                node = children[node][byte]
            value[node] = max(value[node], score)
        missing = [b for b in range(256) if b not in children[1] or value[children[1][b]] == -np.inf]
        if missing:
            raise ValueError(f"{len(missing)} single bytes are no pieces: such a vocabulary can't segment every text")
        self.step = np.zeros((len(children), 256), np.int32)
        for node, c in enumerate(children):
            self.step[node, list(c)] = list(c.values())
        self.value = np.array(value)
        self.longest = max(map(len, pieces))
        self.children = children
        self.scores = [None if v == -np.inf else v for v in value]

    def count_long(self, word: bytes) -> int:
        """The token count of one word: every place, once settled, pushes its score to the ends of the pieces that begin there."""
        children, scores = self.children, self.scores
        reached: dict[int, list[tuple[float, int]]] = {0: [(0.0, 0)]}  # by place ahead, at most `longest` of them
        used = 0
        for i in range(len(word) + 1):
            ways = reached.pop(i)
            best = max(ways)[0]
            used = min(n for s, n in ways if s >= best - 1e-9)
            node = 1
            for end in range(i + 1, min(i + self.longest, len(word)) + 1):
                node = children[node].get(word[end - 1])
                if node is None:
                    break
                score = scores[node]
                if score is not None:
                    reached.setdefault(end, []).append((best + score, used + 1))
        return used

    def counts(self, words: list[bytes]) -> np.ndarray:
        """The token count of each of ``words`` (distinct, not empty): forward scores over their trie, level by level."""
        order = sorted(range(len(words)), key=words.__getitem__)
        data = np.frombuffer(b"".join(words[i] for i in order), np.uint8)
        length = np.array([len(words[i]) for i in order], np.int64)
        start = np.concatenate(([0], np.cumsum(length)[:-1]))
        result = np.zeros(len(words), np.int64)
        word_node = np.zeros(len(words), np.int64)  # of the words still open: their node on the level above
        alive = np.arange(len(words))
        # per level, of the last `longest` ones: parent, best score, tokens; and the open pieces as (node, depth of their start, state)
        best, tokens = [np.zeros(1)], [np.zeros(1, np.int64)]
        parents: list[np.ndarray] = [np.zeros(1, np.int64)]
        open_node, open_level, open_anchor, open_state = (np.zeros(0, np.int64) for _ in range(4))
        depth = 0
        while len(alive):
            byte = data[start[alive] + depth].astype(np.int64)
            key = word_node[alive] * 256 + byte  # words are sorted: equal prefixes stand together
            first = np.concatenate(([True], key[1:] != key[:-1]))
            node = np.cumsum(first) - 1
            parent, symbol = key[first] // 256, key[first] % 256
            # every open piece of a parent, and one that begins at it, goes on to each child
            n_parent = len(best[depth])
            by_parent = np.argsort(open_node, kind="stable")
            o_level, o_anchor, o_state = open_level[by_parent], open_anchor[by_parent], open_state[by_parent]
            many = np.bincount(open_node, minlength=n_parent)
            base = np.concatenate(([0], np.cumsum(many)[:-1]))
            take = many[parent]
            child = np.repeat(np.arange(len(parent)), take)
            at = np.arange(len(child)) - np.repeat(np.cumsum(take) - take, take) + base[parent][child] if len(child) else np.zeros(0, np.int64)
            c_node = np.concatenate((child, np.arange(len(parent))))
            c_level = np.concatenate((o_level[at], np.full(len(parent), depth)))
            c_anchor = np.concatenate((o_anchor[at], parent))
            c_state = self.step[np.concatenate((o_state[at], np.ones(len(parent), np.int64))), symbol[c_node]].astype(np.int64)
            live = c_state > 0
            open_node, open_level, open_anchor, open_state = c_node[live], c_level[live], c_anchor[live], c_state[live]
            ends = self.value[open_state] > -np.inf
            e_node, e_state, e_level, e_anchor = open_node[ends], open_state[ends], open_level[ends], open_anchor[ends]
            low = max(0, depth + 1 - self.longest)
            offset = np.concatenate(([0], np.cumsum([len(b) for b in best[low:depth + 1]])))
            where = offset[e_level - low] + e_anchor
            total = np.concatenate(best[low:depth + 1])[where] + self.value[e_state]
            used = np.concatenate(tokens[low:depth + 1])[where] + 1
            top = np.full(len(parent), -np.inf)
            np.maximum.at(top, e_node, total)
            least = np.full(len(parent), np.iinfo(np.int64).max)
            equal = total >= top[e_node] - 1e-9
            np.minimum.at(least, e_node[equal], used[equal])
            best.append(top)
            tokens.append(least)
            parents.append(parent)
            if depth >= self.longest:
                best[depth - self.longest], tokens[depth - self.longest] = np.zeros(0), np.zeros(0, np.int64)
            depth += 1
            word_node[alive] = node
            done = length[alive] == depth
            result[np.array(order)[alive[done]]] = least[node[done]]
            alive = alive[~done]
        return result


def _batch_counts(texts: list[str], vocabulary: Vocabulary) -> list[tuple[int, int]]:
    cut = [PRE_TOKEN.findall(t) for t in texts]
    known: dict[str, int] = {}
    fresh: set[str] = set()
    out: list[tuple[int, int]] = []

    def settle() -> None:
        short: list[str] = []
        data: list[bytes] = []
        for w in fresh:
            b = w.encode("utf-8", "replace")
            if len(b) > LONG:
                known[w] = vocabulary.count_long(b)
            else:
                short.append(w), data.append(b)
        if short:
            known.update(zip(short, vocabulary.counts(data).tolist()))
        fresh.clear()
    at = 0
    for i, found in enumerate(cut):
        fresh.update(found)
        if len(fresh) >= TRIE_WORDS or i == len(cut) - 1:
            if fresh:
                settle()
            out += [(len(c), sum(map(known.__getitem__, c))) for c in cut[at:i + 1]]
            known.clear()
            at = i + 1
    return out


_LOADED: dict[str, Vocabulary] = {}


def _vocabulary(path: str) -> Vocabulary:
    """One table a Python worker."""
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = Vocabulary(read_vocabulary(path))
    return _LOADED[path]


def count_tokens(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_chars, n_pre_tokens, n_tokens`` for every row of ``docs``, over the whole text.

    Null and empty texts count 0 of each. ``vocabulary`` is a path that every worker can read. Repeated rows
    get equal counts; other columns are not read. Texts and pre-tokens may be of any length (a run of a million
    letters takes seconds). No shuffle: a batch's distinct pre-tokens share a trie.
    """
    @F.pandas_udf("n_chars bigint, n_pre_tokens bigint, n_tokens bigint")
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = _vocabulary(vocabulary)
        for t in texts:
            found = _batch_counts(list(t), v)
            yield pd.DataFrame({"n_chars": [len(x) for x in t], "n_pre_tokens": [n for n, _ in found], "n_tokens": [k for _, k in found]}, dtype="int64")

    return docs.select(F.col(id_col).alias("doc_id"), count(whole_text(text_col)).alias("c")).select("doc_id", "c.*")
