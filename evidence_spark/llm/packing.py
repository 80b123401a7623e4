"""Hierarchical packing of token documents into context windows of several lengths."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, pairwise, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

_CLASSES = 0x250
_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


def _latin() -> tuple[re.Pattern, np.ndarray, np.ndarray]:
    """(texts that are cut here, the lower case of each code point under U+0250, its class).

    A character that white space, Unicode's composition or a longer lower case could change is left to the tokenizer.
    """
    plain, lower, kind = [], np.arange(_CLASSES, dtype=np.uint16), np.full(_CLASSES, _OTHER, np.uint8)
    for c in range(_CLASSES):
        low = chr(c).lower()
        if chr(c) in "\t\n\r " or (c > 0x20 and unicodedata.category(chr(c)) != "Cc" and c != 0xA0 and len(low) == 1 and ord(low) < _CLASSES):
            plain.append(re.escape(chr(c)))
            lower[c] = ord(low)
        kind[c] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER)
    kind[[ord(c) for c in "\t\n\r "]] = _SPACE
    return re.compile(f"[{''.join(plain)}]*\\Z"), lower, kind


_PLAIN, _LOWER, _KIND = _latin()


def _cut(texts: list[str]) -> tuple[np.ndarray, list, np.ndarray]:
    """(places of all words in the list of words, the list of distinct words, number of words of each text).

    The listed words are bytes of Latin-1, or strings if a character is none of it.
    Words are those of the tokenizer's pattern `'s|'t|'re|'ve|'m|'ll|'d|letters|a number|others` on lowered texts.
    """
    joined = "\n".join(texts) + "\n\n\n"
    try:
        code, chars = "latin-1", np.frombuffer(joined.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        code, chars = "utf-16-le", np.frombuffer(joined.encode("utf-16-le"), np.uint16)
    chars = _LOWER.astype(chars.dtype)[chars]
    kind = _KIND[chars]
    start = np.empty(len(chars), bool)
    start[0] = True
    np.not_equal(kind[1:], kind[:-1], out=start[1:])
    start |= kind == _NUMBER
    inside = kind != _SPACE
    start &= inside
    # an apostrophe that begins a word takes the letters of a short form with it
    at = np.flatnonzero((chars == ord("'")) & start)
    one, two = chars[at + 1], chars[at + 2]
    short = (one == ord("s")) | (one == ord("t")) | (one == ord("m")) | (one == ord("d"))
    long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
    start[at[short | long] + 1] = False
    ends = np.concatenate([at[short] + 2, at[long] + 3])
    start[ends[kind[ends] == _LETTER]] = True

    limits = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.searchsorted(np.flatnonzero(start), limits), prepend=0)
    packed, begin = chars[inside], np.flatnonzero(start[inside])
    offsets = np.append(begin, len(packed)).astype(np.int32) * np.int32(chars.itemsize)
    words = pa.Array.from_buffers(pa.binary(), len(begin), [None, pa.py_buffer(offsets), pa.py_buffer(packed)]).dictionary_encode()
    _, offsets, data = words.dictionary.buffers()
    data, offsets = data.to_pybytes() if data else b"", np.frombuffer(offsets, np.int32, len(words.dictionary) + 1).tolist()
    listed = [data[i:j] for i, j in pairwise(offsets)]
    return words.indices.to_numpy(), listed if code == "latin-1" else [w.decode(code) for w in listed], counts


class WordTokens:
    """Ids of whole texts, by the tokenizer itself for each distinct word.

    Texts of plain Latin characters are lowered and cut into the words of the tokenizer's own pre-tokenizer
    pattern, about `group` characters of texts at once; each distinct word of a group goes through the tokenizer, and the
    first `keep` words are kept. Any other text, or one with `<|`, goes through whole.
    """

    def __init__(self, path: str, keep: int = 500_000, group: int = 1 << 21):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; idle threads would spin
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # ids of tokens that end a word, by which the ids of words encoded together come apart
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.keep, self.group = keep, group
        self.at: dict[bytes | str, int] = {}
        # ids of the kept words one after another, then those of a group's other words
        self.flat = np.empty(1 << 18, np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)
        self.first = np.zeros(1 << 16, np.int32)

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, ends of each word in them)."""
        parts = [words[i : i + 2000] for i in range(0, len(words), 2000)]
        made = [self.tokenizer.encode_batch_fast([" ".join(p)], add_special_tokens=False)[0].ids for p in parts]
        ids = np.fromiter(chain.from_iterable(made), self.flat.dtype)
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(words):  # no tokenizer with word ends gives this, so each word is asked for alone
            made = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            ids, ends = np.fromiter(chain.from_iterable(made), self.flat.dtype), np.cumsum([len(x) for x in made])
        return ids, ends

    def _numbers(self, words: list) -> np.ndarray:
        """Places of distinct words in `first`; the places of words that are not kept hold until the next call."""
        n = len(self.at)
        at = np.fromiter(map(self.at.get, words, repeat(-1)), np.int32, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            fresh = [words[i] for i in new]
            ids, ends = self._encode([w.decode("latin-1") if isinstance(w, bytes) else w for w in fresh])
            begin = int(self.first[n])
            self.flat = _room(self.flat, begin + len(ids))
            self.first = _room(self.first, n + len(fresh) + 1)
            self.flat[begin : begin + len(ids)] = ids
            self.first[n + 1 : n + 1 + len(fresh)] = begin + ends
            at[new] = np.arange(n, n + len(fresh))
            self.at.update(zip(fresh[: max(0, self.keep - n)], range(n, self.keep)))
        return at

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        places, words, counts = _cut(texts)
        at = self._numbers(words)
        begin = self.first[at]
        size = (self.first[at + 1] - begin)[places]
        ends = np.cumsum(size)
        out = np.repeat(begin[places] - (ends - size), size)
        out += np.arange(len(out))
        ids = self.flat[out].astype(np.uint32)
        return np.split(ids, np.append(0, ends)[np.cumsum(counts)[:-1]])

    def many(self, texts: Iterable[str]) -> Iterator[np.ndarray]:
        """The ids of each text, in order."""
        group: list[str] = []
        whole: dict[int, str] = {}
        size = 0

        def flush() -> Iterator[np.ndarray]:
            made = self._plain(group) if group else []
            rest = iter(made)
            for i in range(len(group) + len(whole)):
                yield self._whole(whole[i]) if i in whole else next(rest)
            group.clear()
            whole.clear()

        for text in texts:
            if "<|" in text or not _PLAIN.match(text):
                whole[len(group) + len(whole)] = text
            else:
                group.append(text)
            size += len(text)
            if size >= self.group:
                yield from flush()
                size = 0
        yield from flush()

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ids(self, text: str) -> np.ndarray:
        return next(self.many([text]))


@lru_cache(maxsize=1)
def _words(path: str, keep: int) -> WordTokens:
    """One for all tasks of a worker, which meet mostly the same words."""
    return WordTokens(path, keep)


def _room(values: np.ndarray, n: int) -> np.ndarray:
    """The array with room for n values."""
    return values if n <= len(values) else np.concatenate([values, np.zeros(max(n - len(values), len(values)), values.dtype)])


class Packer:
    """Packs documents of one task as they come, holding a bounded number of tokens.

    Whole windows of the largest tier are cut from long documents first. What is left is routed to the
    smallest tier (512, 1024, 2048 or 4096 by default) that holds it. When `hold` ids wait, the tiers are packed
    from the largest down: a document of the tier opens a window of the tier's length, and its gap is filled
    from shorter tiers, the longest document that fits first; the last one is cut to close the gap exactly. At a
    task's end what is left over goes into windows of falling powers of two.
    Each window goes to the step group with the fewest ids so far.
    """

    def __init__(self, largest: int, smallest: int, hold: int, groups: int, first_id: int):
        self.largest, self.hold, self.next_id = largest, hold, first_id
        self.tiers = [smallest << k for k in range((largest // smallest).bit_length())]
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}
        self.tokens = 0
        self.loads = [0] * groups
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        start = 0
        while len(ids) - start >= self.largest:
            self._window([(doc, ids, start, self.largest)], self.largest)
            start += self.largest
        if start < len(ids):
            self._wait((doc, ids, start, len(ids) - start))
        if self.tokens >= self.hold:
            self.pack()

    def _wait(self, piece: tuple) -> None:
        self.waiting[next(t for t in self.tiers if piece[3] <= t)].append(piece)
        self.tokens += piece[3]

    def _take(self, room: int) -> tuple | None:
        """The longest waiting piece of at most `room` ids, from the tiers below it, each sorted by length."""
        for tier in reversed(self.tiers):
            own = self.waiting[tier]
            if own and own[0][3] <= room:
                lo, hi = 0, len(own)
                while lo < hi:
                    mid = (lo + hi) // 2
                    lo, hi = (mid + 1, hi) if own[mid][3] <= room else (lo, mid)
                piece = own.pop(lo - 1)
                self.tokens -= piece[3]
                return piece
        return None

    def _cut(self, room: int) -> tuple | None:
        """Cuts `room` ids off the shortest waiting piece, which is longer; the rest waits on."""
        for tier in self.tiers:
            if own := self.waiting[tier]:
                doc, ids, start, n = own.pop(0)
                self.tokens -= n
                rest = (doc, ids, start + room, n - room)
                to = self.waiting[next(t for t in self.tiers if rest[3] <= t)]
                place = next((k for k, x in enumerate(to) if x[3] >= rest[3]), len(to))
                to.insert(place, rest)
                self.tokens += rest[3]
                return doc, ids, start, room
        return None

    def pack(self) -> None:
        for own in self.waiting.values():
            own.sort(key=lambda x: x[3])
        for tier in reversed(self.tiers):
            while self.waiting[tier] and self.tokens >= tier:
                piece = self.waiting[tier].pop()
                self.tokens -= piece[3]
                self._fill([piece], tier)

    def finish(self) -> None:
        self.pack()
        while self.tokens:
            self._fill([], 1 << (self.tokens.bit_length() - 1))

    def _fill(self, window: list[tuple], context: int) -> None:
        room = context - sum(x[3] for x in window)
        while room:
            piece = self._take(room) or self._cut(room)
            window.append(piece)
            room -= piece[3]
        self._window(window, context)

    def _window(self, pieces: list[tuple], context: int) -> None:
        group = self.loads.index(min(self.loads))
        self.loads[group] += context
        at = 0
        for doc, ids, start, n in pieces:
            crc = zlib.crc32(ids[start : start + n].astype("<u4").tobytes())
            self.out.append((doc, start, n, crc, len(ids), self.next_id, at, context, group))
            at += n
        self.next_id += 1


NAMES = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "context", "step_group")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    largest: int = 4096,
    smallest: int = 512,
    end_id: int = 2,
    hold: int = 1 << 20,
    step_groups: int = 8,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: int = 500_000,
) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, context, step_group.

    Each task packs the documents it reads, so nothing is shuffled; at most `hold` ids wait in it, besides
    one document. A sequence id is the task's number and a count. Every window is full but for what is left at a
    task's end, which is cut into powers of two, so no window needs padding. A null text is an empty
    document of one id (the end mark); null ids stay null; equal rows are packed each. No rows, no pieces. A worker keeps the ids
    of at most `keep` words for its tasks, which costs memory and saves time, and changes no result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _words(tokenizer, keep)
        packer = Packer(largest, smallest, hold, step_groups, TaskContext.get().partitionId() << 32)
        for batch in batches:
            made = words.many(text.as_py() or "" for text in batch.column(1))
            for doc, ids in zip(batch.column(0).to_pylist(), made, strict=True):
                packer.add(doc, np.append(ids, np.uint32(end_id)))
                if len(packer.out) > 20_000:
                    yield _rows(packer)
        packer.finish()
        yield _rows(packer)

    kinds = ["long"] * 7 + ["int"] * 2
    schema = ", ".join(f"{n} {k}" for n, k in zip(NAMES, kinds, strict=True))
    return docs.selectExpr(f"cast({id_col} as long)", f"cast({text_col} as string)").mapInArrow(run, schema)


def _rows(packer: Packer) -> pa.RecordBatch:
    rows, packer.out = packer.out, []
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(NAMES)
    kinds = [pa.int64()] * 7 + [pa.int32()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(NAMES))
