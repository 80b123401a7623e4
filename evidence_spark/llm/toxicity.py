"""Toxicity: Viterbi decoding of disguised words under a character language model, then a score of the restored text."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_classes, held_out, mix64, slices, span_hashes, word_spans
from .ftrl import labelled_sample, train

# What a disguising character may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "bg", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "*": "", "#": "", "%": "", "&": "", "€": "e", "£": "l",
}
#: Marks that hide a letter between others, up to so many in a row; longer rows are ornaments and dropped.
MASKS, MASKED = "*#%&", 3
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if chr(c).isalpha())
_SYMBOLS = 64
_TABLE = np.zeros(0x250, np.uint8)
for _i, _c in enumerate(_LETTERS):
    _TABLE[ord(_c)] = _i + 1
_TABLE[0x100:] = len(_LETTERS) + 1
_CODE = {c: i + 1 for i, c in enumerate(_LETTERS)}

_L = "a-zß-öø-ÿ"
_MARKS = "0-9@$!|+*#%&€£"
_MID = re.compile(rf"[{_MARKS}](?=[{_L}])")
_RUN = re.compile(rf"[{_L}{_MARKS}]+")
# one or two marks that end a word; longer runs and exclamation marks are no letters
_END = re.compile(rf"(?<=[{_L}])[0-9@$€£]{{1,2}}(?![{_L}{_MARKS}])")
_REPEAT = re.compile(rf"([{_L}])\1\1")
_SPACED = re.compile(rf"(?<![{_L}0-9])[{_L}0-9@$!](?:[ .\-_*][{_L}0-9@$!]){{3,}}(?![{_L}0-9])")
_KIND = byte_classes(punctuation=True)
BITS = 20
#: A word tells more by standing in a text several times; up to so many times are told apart.
TIMES = 3


def count_trigrams(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """Counts of all character trigrams of all texts, lowered; 64^3 numbers, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(_SYMBOLS**3, np.int64)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for lo, hi in slices(texts, 1 << 20):
                code = np.frombuffer("\n\n".join(t or "" for t in texts[lo:hi]).lower().encode("utf-32-le", "replace"), np.uint32)
                s = np.where(code < 0x250, _TABLE[np.minimum(code, 0x24F)], 0).astype(np.int64)
                if len(s) > 2:
                    counts += np.bincount((s[:-2] << 12) + (s[1:-1] << 6) + s[2:], minlength=len(counts))
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], names=["code", "n"])

    rows = docs.select(text_col).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(_SYMBOLS**3)
    out[rows["code"].to_numpy(int)] = rows["n"]
    return out


def language_model(counts: np.ndarray) -> np.ndarray:
    """log P(third symbol | first two), trigrams backed by bigrams and single symbols."""
    three = counts.reshape(_SYMBOLS, _SYMBOLS, _SYMBOLS)
    two = three.sum(axis=0)
    one = two.sum(axis=0)
    p1 = (one + 0.5) / (one.sum() + 0.5 * _SYMBOLS)
    p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
    p3 = (three + 4 * p2[None]) / (three.sum(axis=2, keepdims=True) + 4)
    return np.log(p3).astype(np.float32)


def _tells(c: str) -> bool:
    """Whether a character is a letter or stands for one."""
    return c in _CODE or bool(LEET.get(c))


#: What a mask may stand for: any plain letter, or, seldom, nothing.
_ANY = [(x, math.log(0.998 / 26)) for x in "abcdefghijklmnopqrstuvwxyz"] + [("", math.log(0.002))]


def _lattice(span: str, spaced: bool) -> Iterator[list[tuple[str, float]]]:
    """The choices (text, log channel probability) for each part of a span."""
    i = 0
    while i < len(span):
        c, j = span[i], i + 1
        if spaced and c in " .-_*":
            yield [("", math.log(0.7)), (" ", math.log(0.3))]
        elif c in _CODE:
            while j < len(span) and span[j] == c:
                j += 1
            n = j - i
            yield [(c, math.log(0.7)), (c + c, math.log(0.3))] if n > 2 else [(c * n, 0.0)]
        else:
            while j < len(span) and span[j] == c:
                j += 1
            if c in MASKS and j - i <= MASKED and 0 < i and j < len(span) and _tells(span[i - 1]) and _tells(span[j]):
                for _ in range(j - i):
                    yield _ANY
                i = j
                continue
            choices = [(x, math.log(0.8 / max(len(LEET.get(c, "")), 1))) for x in LEET.get(c, "")]
            if j - i > 1 and choices:
                choices += [(x * 2, p - 1) for x, p in choices]
            yield [*choices, ("", math.log(0.002 if choices else 1.0))]
        i = j


def _settled(back: list[dict], states: list) -> tuple[int, tuple[int, int] | None]:
    """How many of the steps all paths to `states` share, and the state where they meet."""
    now = set(states)
    for k in range(len(back) - 1, -1, -1):
        now = {back[k][s][0] for s in now}
        if len(now) == 1:
            return k, next(iter(now))
    return 0, None


def _walk(back: list[dict], at: tuple[int, int]) -> list[str]:
    out = []
    for step in reversed(back):
        at, text = step[at]
        out.append(text)
    return out[::-1]


def viterbi(span: str, model: np.ndarray, spaced: bool = False, window: int = 512) -> str:
    """The likeliest letters behind a disguised span; it may drop marks, keep one or two of a repeated letter, or close gaps.

    Back pointers are kept for a few windows only: every `window` parts, what all surviving paths share is put out, which
    leaves the result as it is. Should they share nothing for 16 windows, the best path is taken so far.
    """
    best: dict[tuple[int, int], float] = {(0, 0): 0.0}
    back: list[dict[tuple[int, int], tuple[tuple[int, int], str]]] = []
    out: list[str] = []
    for choices in _lattice(span, spaced):
        now: dict[tuple[int, int], float] = {}
        step: dict[tuple[int, int], tuple[tuple[int, int], str]] = {}
        for state, score in best.items():
            for text, p in choices:
                (a, b), s = state, score + p
                for ch in text:
                    c = _CODE.get(ch, 0)
                    s += float(model[a, b, c])
                    a, b = b, c
                if s > now.get((a, b), -math.inf):
                    now[a, b] = s
                    step[a, b] = (state, text)
        best = now
        back.append(step)
        if len(back) % window == 0:
            k, at = _settled(back, list(best))
            if at is None and len(back) >= 16 * window:
                top = max(best, key=lambda x: (best[x], x))
                k, at, best = len(back), top, {top: best[top]}
            if at is not None:
                out += _walk(back[:k], at)
                del back[:k]
    at = max(best, key=lambda k: (best[k] + float(model[k[0], k[1], 0]), k))
    return "".join([*out, *_walk(back, at)])


class Restorer:
    """Finds disguised spans of a text and puts the decoded ones in their place; distinct spans are decoded once."""

    def __init__(self, model: np.ndarray, keep: int = 50_000):
        self.model, self.keep = model, keep
        self.seen: dict[tuple[str, bool], str] = {}

    def _decode(self, span: str, spaced: bool) -> str:
        key = (span, spaced)
        if key not in self.seen:
            if len(self.seen) >= self.keep:
                self.seen.clear()
            self.seen[key] = viterbi(span, self.model, spaced)
        return self.seen[key]

    def _around(self, text: str, hits: Iterator[int]) -> str:
        """Decodes the runs of letters and marks around the hits."""
        out, done = [], 0
        for at in hits:
            if at < done:
                continue
            start = at
            while start > done and _RUN.match(text[start - 1]):
                start -= 1
            end = _RUN.match(text, start).end()
            out += [text[done:start], self._decode(text[start:end], False)]
            done = end
        return "".join([*out, text[done:]]) if out else text

    def restore(self, text: str | None) -> str:
        text = (text or "").lower()
        text = _SPACED.sub(lambda m: self._decode(m[0], True), text)
        text = self._around(text, (m.start() for m in _REPEAT.finditer(text)))
        text = self._around(text, (m.start() for m in _MID.finditer(text)))
        return self._around(text, (m.start() for m in _END.finditer(text)))


def _slots(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(owner, slot) of the features of restored texts, each feature once for a text.

    A word and its first 4, 5 and 6 bytes are features if they stand in a text once, twice and three times or more.
    """
    data = [t.encode("utf-8", "replace") for t in texts]
    arr = np.frombuffer(b"\n".join(data), np.uint8)
    starts, ends = word_spans(arr, _KIND)
    word = _KIND[arr[starts]] == 1
    starts, ends = starts[word], ends[word]
    owner = np.searchsorted(np.cumsum([len(d) + 1 for d in data]), starts, side="right")
    owners, slots = [owner], [span_hashes(arr, starts, ends)]
    for n in (4, 5, 6):
        long = ends - starts >= n
        owners.append(owner[long])
        slots.append(mix64(span_hashes(arr, starts[long], starts[long] + n) + np.uint64(n)))
    slot = (np.concatenate(slots) >> np.uint64(64 - bits)).astype(np.int64)
    pair, times = np.unique((np.concatenate(owners).astype(np.int64) << bits) + slot, return_counts=True)
    made = [pair]
    for k in range(2, TIMES + 1):
        often = pair[times >= k]
        again = mix64(((often & ((1 << bits) - 1)).astype(np.uint64) << np.uint64(3)) + np.uint64(k)) >> np.uint64(64 - bits)
        made.append((often >> bits << bits) + again.astype(np.int64))
    pair = np.unique(np.concatenate(made))
    return pair >> bits, pair & ((1 << bits) - 1)


def train_toxicity(docs: DataFrame, labels: DataFrame, model: np.ndarray, max_rows: int = 16_000, bits: int = BITS) -> np.ndarray:
    """Weights on words and word beginnings of restored texts, from at most about `max_rows` labelled rows."""

    def features(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        restorer, out = Restorer(model), []
        for text in texts:
            at = _slots([restorer.restore(text)], bits)[1]
            out.append((at, np.ones(len(at))))
        return out

    return train(labelled_sample(docs, labels, "toxic", max_rows), features, 1 << bits, epochs=6, alpha=0.3, l1=8.0, positive=4.0)


def score_toxicity(docs: DataFrame, weights: np.ndarray, model: np.ndarray, text_col: str = "text") -> DataFrame:
    """Adds `score` to every row: the probability that its whole text, restored, is toxic.

    Null and empty texts get the intercept's probability; a word counts three times at most. The model (64^3 numbers) and
    the non-zero weights are sent to the tasks; a column named score is replaced, others pass through.
    """
    bits = (len(weights) - 1).bit_length() - 1
    at = np.flatnonzero(weights[:-1])
    sent = docs.sparkSession.sparkContext.broadcast((at.astype(np.int32), weights[at], float(weights[-1]), model))

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        at, w, bias, lm = sent.value
        known = np.zeros(1 << bits, np.float32)
        known[at] = w
        restorer = Restorer(lm)
        for array in batches:
            texts, made = array.to_pylist(), []
            for lo, hi in slices(texts, 1 << 20):
                owner, slot = _slots([restorer.restore(t) for t in texts[lo:hi]], bits)
                total = np.bincount(owner, known[slot], minlength=hi - lo)
                made.append(1 / (1 + np.exp(-np.clip(bias + total, -35, 35))))
            yield pa.array(np.concatenate(made) if made else [], pa.float64())

    return docs.withColumn("score", F.arrow_udf(run, "double")(F.col(text_col)))


def classify_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, **options) -> DataFrame:
    """docs with held_out, score and predicted (1 where the score is at least `threshold`)."""
    model = language_model(count_trigrams(docs))
    scored = score_toxicity(docs, train_toxicity(docs, labels, model, **options), model)
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "predicted": (F.col("score") >= threshold).cast("int")})
