"""Token counts of whole texts: byte-pair merging with a heap over a linked list, without ids."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"


class PieceCounter(dict):
    """Counts the pieces into which a sentencepiece BPE model cuts a text.

    A text's symbols are its characters. The adjacent pair whose joined piece has the lowest rank (the highest score; the leftmost of
    equals) is merged until no pair is a piece. Each merge takes one symbol away; a character that is no piece ends as its UTF-8 bytes.

    No piece joins a letter with another kind of character, and a mark of a space stands only at a piece's beginning, so a text falls
    into words that never merge with each other. The dictionary keeps the counts of words already seen; it is emptied when it holds
    `keep` of them.
    """

    def __init__(self, path: str, keep: int = 1_000_000):
        from sentencepiece import SentencePieceProcessor

        super().__init__()
        self.model = SentencePieceProcessor(model_file=path)
        ids = [i for i in range(self.model.get_piece_size()) if not (self.model.is_control(i) or self.model.is_unknown(i) or self.model.is_byte(i))]
        if any(self.model.is_unused(i) for i in ids):
            raise ValueError("a model with unused pieces is not supported")
        self.rank = {self.model.id_to_piece(i): -self.model.get_score(i) for i in ids}
        other = "".join(sorted({c for piece in self.rank for c in piece if c.isalnum() and not c.isalpha()}))  # letters to \w, but no letters
        self.word = re.compile(rf"{MARK}*[^\W\d_{other}]+|{MARK}*(?:(?!{MARK})[\W\d_{other}])+|{MARK}+")
        if any(len(self.word.findall(piece)) > 1 for piece in self.rank):
            raise ValueError("a piece joins two words")
        self.single = {piece for piece in self.rank if len(piece) == 1}
        self.keep = keep

    def __missing__(self, word: str) -> int:
        n = self.merged(word)
        if len(word) <= 64:
            if len(self) >= self.keep:
                self.clear()
            self[word] = n
        return n

    def merged(self, word: str) -> int:
        """The number of pieces of one word: its symbols less its merges."""
        rank, n = self.rank, len(word)
        end = list(range(1, n + 1))  # of the symbol that begins here; 0 once it is part of another
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank.get(word[i : i + 2])) is not None]
        heapify(heap)
        merges = 0
        while heap:
            _, left, stop = heappop(heap)
            middle = end[left]
            if not middle or middle >= n or end[middle] != stop:
                continue  # one of the two has been merged meanwhile
            merges += 1
            end[left], end[middle] = stop, 0
            if stop < n:
                before[stop] = left
                if (r := rank.get(word[left : end[stop]])) is not None:
                    heappush(heap, (r, left, end[stop]))
            first = before[left]
            if first >= 0 and (r := rank.get(word[first:stop])) is not None:
                heappush(heap, (r, first, stop))
        if self.single.issuperset(word):
            return n - merges
        alone = (word[i] for i in range(n) if end[i] == i + 1)
        return n - merges + sum(len(c.encode()) - 1 for c in alone if c not in rank)

    def count(self, text: str) -> int:
        return sum(map(self.__getitem__, self.word.findall(self.model.normalize(text))))


@cache
def _counter(path: str) -> PieceCounter:
    """One for each Python worker, which serves many tasks."""
    return PieceCounter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for each row: the library's counts of whole texts, without begin or end tokens.

    `path`: a sentencepiece BPE model. Null and empty texts have 0 tokens; rows without ids and repeated rows are counted like others;
    an empty table gives no rows; further columns are ignored. Nothing is shuffled: a task holds one batch of texts at a time, the
    model and the counts of at most a million words. A word of any length is merged whole, in n log n steps.
    """

    @F.pandas_udf("long")
    def counted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        counter = _counter(path)
        for batch in texts:
            yield pd.Series([counter.count(t) if t else 0 for t in batch], dtype="int64")

    n_bytes = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    found = docs.select("doc_id", n_bytes.alias("n_bytes"), counted("text").alias("n_tokens"))
    return found.withColumn("over_limit", F.col("n_tokens") > limit)
