"""Byte-pair merging of many words at once, by array passes."""

from __future__ import annotations

import numpy as np

FAR = 1 << 60


class MergeTable:
    """Merges by their pair of token ids: rank (the first of equal pairs counts) and outcome."""

    def __init__(self, left: np.ndarray, right: np.ndarray, whole: np.ndarray, n_tokens: int):
        key = left.astype(np.int64) * n_tokens + right
        self.keys, first = np.unique(key, return_index=True)
        self.ranks, self.wholes, self.n = first.astype(np.int64), np.asarray(whole, np.int64)[first], n_tokens

    def of(self, left: np.ndarray, right: np.ndarray, fits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and outcome of each pair; FAR where there is no merge or ``fits`` is false."""
        if not len(self.keys):
            return np.full(len(left), FAR), np.zeros(len(left), np.int64)
        key = left * self.n + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(fits & (self.keys[at] == key), self.ranks[at], FAR), self.wholes[at]


def merge_words(token: np.ndarray, word: np.ndarray, table: MergeTable) -> tuple[np.ndarray, np.ndarray]:
    """Token ids and their words after merging, by word. token: ids; word: the number of each one's word, ascending.

    In each round every word makes its merge of least rank, the leftmost of equals; words without one are done. So a round costs
    what the words still open have, and there are as many rounds as the longest chain of merges in a word.
    """
    token, done = token.astype(np.int64), []
    if len(word):
        rank, whole = table.of(token[:-1], token[1:], word[1:] == word[:-1])
        rank, whole = np.append(rank, FAR), np.append(whole, 0)
    while len(word):
        begin = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        count = np.diff(np.append(begin, len(word)))
        least = np.minimum.reduceat(rank, begin)
        open_ = least < FAR
        if not open_.all():
            stay = np.repeat(open_, count)
            done.append((word[~stay], token[~stay]))
            word, token, rank, whole = word[stay], token[stay], rank[stay], whole[stay]
            least, count = least[open_], count[open_]
            if not len(word):
                break
        hit = np.flatnonzero(rank == np.repeat(least, count))
        hit = hit[np.append(True, word[hit][1:] != word[hit][:-1])]
        token[hit] = whole[hit]
        stay = np.ones(len(word), bool)
        stay[hit + 1] = False
        now = hit - np.arange(len(hit))  # where the merged tokens are, once the right halves are gone
        word, token, rank, whole = word[stay], token[stay], rank[stay], whole[stay]
        for at in (now, now - 1):  # the pairs that changed
            at = at[at >= 0]
            right = np.minimum(at + 1, len(word) - 1)
            rank[at], whole[at] = table.of(token[at], token[right], (word[at] == word[right]) & (right > at))
    if not done:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    words, tokens = np.concatenate([x for x, _ in done]), np.concatenate([x for _, x in done])
    order = np.argsort(words, kind="stable")
    return tokens[order], words[order]
