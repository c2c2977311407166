"""Aho-Corasick automaton over word ids, in flat arrays, scanning many lanes of text at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

from lanewise.llm.common import LOWER

#: ASCII bytes that are neither digits nor letters separate words; A-Z become a-z.
SEPARATED = bytes(
    b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in LOWER
)
#: A text is split into words in pieces of about this many bytes.
PIECE_BYTES = 1 << 20
#: Words of one lane of a scan. Lanes are read side by side, each from some words before its own.
LANE = 256
#: Stands for words that the automaton does not know, and for the end of a text.
UNKNOWN = -1


def words_of(text: bytes) -> list[bytes]:
    return text.translate(SEPARATED).split()


def word_pieces(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, some at a time."""
    start = 0
    while start < len(text):
        end = start + PIECE_BYTES
        if end < len(text):
            # A word may go on here: the piece ends with the word.
            while end < len(text) and SEPARATED[text[end]] != 0x20:
                end += 1
        yield words_of(text[start:end])
        start = end


def lower_bound(values: np.ndarray, low: np.ndarray, high: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """For each range [low, high) of `values`, sorted inside, the first place not below `wanted`."""
    low, high = low.copy(), high.copy()
    while (open_ := np.flatnonzero(low < high)).size:
        middle = (low[open_] + high[open_]) >> 1
        below = values[middle] < wanted[open_]
        low[open_] = np.where(below, middle + 1, low[open_])
        high[open_] = np.where(below, high[open_], middle)
    return low


class Automaton:
    """The trie of all runs of at most `window` words in the items, with failure links.

    Nodes are numbered level by level, children of a node side by side in the order of their
    words, so a node is its word, its first child and its failure link: 16 bytes with the
    output link. As every run that ends inside an item is in the trie, the longest proper
    suffix of a run is the run one shorter that starts one word later; failure links follow
    from the level before. Whole windows, and items shorter than a window, are outputs.
    """

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window = window
        self.names = [name for name, _ in items]
        self.vocabulary: dict[bytes, int] = {}
        ids, sizes = [], []
        for _, text in items:
            size = 0
            for words in word_pieces(text):
                ids.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int32))
                size += len(words)
            sizes.append(size)
        sizes = np.array(sizes, np.int64)
        word = np.concatenate([*ids, np.empty(0, np.int32)])
        owner = np.repeat(np.arange(len(items)), sizes)
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(word))
        short = np.flatnonzero((sizes > 0) & (sizes < window))
        heads = (np.cumsum(sizes) - sizes)[short]

        place = np.zeros(len(word), np.int32)  # the node of the run from here, one level at a time
        offsets, node_word, fail, first = [0, 1], [np.full(1, UNKNOWN, np.int32)], [np.zeros(1, np.int32)], []
        holders = []
        for depth in range(1, window + 1):
            live = np.flatnonzero(left >= depth)
            keys = place[live].astype(np.int64) << 32 | word[live + depth - 1]
            found, sample, where = np.unique(keys, return_index=True, return_inverse=True)
            parents = np.arange(offsets[-2], offsets[-1], dtype=np.int64)
            first.append((np.searchsorted(found, parents << 32) + offsets[-1]).astype(np.int32))
            node_word.append((found & 0xFFFFFFFF).astype(np.int32))
            fail.append(place[live[sample] + 1] if depth > 1 else np.zeros(len(found), np.int32))
            place[live] = offsets[-1] + where
            offsets.append(offsets[-1] + len(found))
            ended = short[sizes[short] == depth]
            holders.append(place[heads[sizes[short] == depth]].astype(np.int64) << 32 | ended)
        whole = np.flatnonzero(left >= window)
        holders.append(place[whole].astype(np.int64) << 32 | owner[whole])
        self.offsets = np.array(offsets[:-1])
        self.word, self.fail = np.concatenate(node_word), np.concatenate(fail)
        self.first = np.concatenate([*first, np.full(offsets[-1] - offsets[-2] + 1, offsets[-1], np.int32)])
        self.at_root = np.zeros(len(self.vocabulary) + 1, np.int32)  # the last one is for UNKNOWN
        top = np.arange(offsets[1], offsets[2])
        self.at_root[self.word[top]] = top

        holders = np.unique(np.concatenate(holders))
        self.outputs, runs = np.unique(holders >> 32, return_index=True)
        self.runs = np.append(runs, len(holders))
        self.holders = (holders & 0xFFFFFFFF).astype(np.int32)
        # The output link: the longest suffix that is an output, the node itself included.
        self.output = np.zeros(len(self.word), np.int32)
        self.output[self.outputs] = self.outputs
        for start, end in zip(offsets[2:], offsets[3:]):
            level = np.arange(start, end)
            none = level[self.output[start:end] == 0]
            self.output[none] = self.output[self.fail[none]]
        self.nested = len(short) > 0

    def __len__(self) -> int:
        return len(self.outputs)

    def ids(self, text: bytes) -> np.ndarray:
        get = self.vocabulary.get
        parts = [np.array([get(w, UNKNOWN) for w in words], np.int32) for words in word_pieces(text)]
        return np.concatenate([*parts, np.empty(0, np.int32)])

    def next(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The states after one more word each: down the trie, or by failure links to where it is."""
        out = self.at_root[word]
        open_ = np.flatnonzero((state > 0) & (word >= 0))
        state, word = state[open_], word[open_]
        while len(open_):
            low, high = self.first[state], self.first[state + 1]
            at = lower_bound(self.word, low, high, word)
            found = at < high
            found[found] = self.word[at[found]] == word[found]
            out[open_[found]] = at[found]
            state = self.fail[state[~found]]
            open_, word = open_[~found], word[~found]
            deeper = state > 0
            state, open_, word = state[deeper], open_[deeper], word[deeper]
        return out

    def occurrences(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """End (the last word's place) and output node of all occurrences, from one scan.

        The sequence is read in lanes side by side. A state depends on the last `window` words
        only, so a lane starts that many words less one before its own first word.
        """
        ahead = self.window - 1
        lanes = -(-len(ids) // LANE)
        if not lanes or not len(self):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        padded = np.full(ahead + lanes * LANE, UNKNOWN, np.int32)
        padded[ahead : ahead + len(ids)] = ids
        base = np.arange(lanes) * LANE
        state = np.zeros(lanes, np.int32)
        ends, nodes = [], []
        for step in range(ahead + LANE):
            state = self.next(state, padded[base + step])
            if step < ahead:
                continue
            found = self.output[state]
            hit = np.flatnonzero(found)
            while len(hit):
                ends.append(base[hit] + (step - ahead))
                nodes.append(found[hit].astype(np.int64))
                if not self.nested:
                    break
                found[hit] = self.output[self.fail[found[hit]]]
                hit = hit[found[hit] > 0]
        return np.concatenate([*ends, np.empty(0, np.int64)]), np.concatenate([*nodes, np.empty(0, np.int64)])

    def depth(self, nodes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, nodes, side="right") - 1

    def items_of(self, node: int) -> np.ndarray:
        at = int(np.searchsorted(self.outputs, node))
        return self.holders[self.runs[at] : self.runs[at + 1]]
