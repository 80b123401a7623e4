"""Personal data by weak supervision: labelers vote on candidate spans, EM weighs them, a span classifier decides."""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: The order of kinds at equal starts; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "masked_email", "local_phone", "national_id", "secret")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a run of digits can only match from its first digit, so later starts need no look
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_MORE = {
    "masked_email": re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]*+\s?[(\[{]\s?at\s?[)\]}]\s?[A-Za-z0-9-]++(?:\s?(?:\.|[(\[{]\s?dot\s?[)\]}])\s?[A-Za-z0-9-]++)++", re.ASCII),
    "local_phone": re.compile(r"(?<![\w+.(-])\(?[2-9][0-9]{2}\)?[ .-][2-9][0-9]{2}[ .-][0-9]{4}(?![\w-])", re.ASCII),
    "national_id": re.compile(r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", re.ASCII),
    "secret": re.compile(r"(?<!\w)(?:(?:AKIA|ASIA)[A-Z0-9]{16}(?!\w)|(?:password|passwd|secret|token|api_key)\s?[=:]\s?[^\s\"']{6,}+|\"[0-9a-f]{32,}+\")"),
}

# Word lists of the gazetteer and context labelers.
DOMAINS = frozenset("com org net edu gov mil int info io co uk de fr es it nl eu us ca au jp cn".split())
CONTEXT = {
    "email": ("mail", "contact", "write", "@"), "masked_email": ("mail", "contact", "write"),
    "ip": ("ip", "host", "server", "address"), "card": ("card", "visa", "payment", "credit"),
    "phone": ("call", "phone", "tel", "fax", "mobile"), "local_phone": ("call", "phone", "tel", "fax", "mobile"),
    "national_id": ("ssn", "social", "security", "tax"), "secret": ("key", "password", "secret", "token", "aws", "credential"),
}
# Cue words, and what the context labeler takes for a value after them.
CUED = {
    "local_phone": (("call ", "phone", "tel.", "tel:", "fax", "mobile"), re.compile(r"(?<!\w)(?:call|phone|tel|fax|mobile)[\s.:#]{1,3}(\(?[0-9][0-9() .-]{5,18}[0-9])(?![\w-])", re.I | re.ASCII)),
    "national_id": (("ssn", "social security", "tax id"), re.compile(r"(?<!\w)(?:ssn|social security(?: number)?|tax id)[\s.:#]{1,3}([0-9]{3}[ -]?[0-9]{2}[ -]?[0-9]{4})(?![\w-])", re.I | re.ASCII)),
    "secret": (("password", "passwd", "secret", "token", "api key", "api_key"), re.compile(r"(?<!\w)(?:password|passwd|secret|token|api[ _]key)(?: is)?[\s:=]{1,3}[\"']?([^\s\"']{8,}+)", re.I)),
}
# An e-mail address told in words, which ends in a domain of the gazetteer; beginnings of known keys.
SPOKEN = re.compile(rf"(?<![\w.+-])[A-Za-z0-9][\w.+-]*+ at [A-Za-z0-9-]++(?: dot [A-Za-z0-9-]++)* dot (?:{'|'.join(sorted(DOMAINS))})(?![\w-])", re.ASCII)
KEY_STARTS = ("ghp_", "gho_", "glpat-", "xoxb-", "sk_live_", "rk_live_")
KEYS = re.compile(rf"(?<![\w-])(?:{'|'.join(KEY_STARTS)})[A-Za-z0-9_-]{{16,}}+", re.ASCII)
#: Labelers, each of which votes 1 (personal), 0 (not) or -1 (abstains). The first, third and fourth also propose spans.
LABELERS = ("regex", "checksum", "gazetteer", "context", "shape")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """The base matches (start, end, kind): leftmost and non-overlapping per kind, failing ones dropped without retries.

    Works in time linear in the text: an e-mail's name is looked up backwards from its @ sign.
    """
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((m.start(), m.end(), "ip"))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), "card"))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append((m.start(), m.end(), "phone"))
    return out


def _proposals(text: str, base: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, kind, labeler): what the regex, gazetteer and context labelers take for personal data."""
    yield from ((s, e, k, "regex") for s, e, k in base)
    for kind, rx in _MORE.items():
        if kind != "masked_email" or re.search(r"[(\[{]\s?at\s?[)\]}]", text):
            yield from ((m.start(), m.end(), kind, "regex") for m in rx.finditer(text))
    low = text.lower()
    if " dot " in low:
        yield from ((m.start(), m.end(), "masked_email", "gazetteer") for m in SPOKEN.finditer(text))
    if any(k in text for k in KEY_STARTS):
        yield from ((m.start(), m.end(), "secret", "gazetteer") for m in KEYS.finditer(text))
    for kind, (cues, rx) in CUED.items():
        if any(c in low for c in cues):
            # a secret has letters and digits; both are looked for once in each run, so long runs take linear time
            yield from ((m.start(1), m.end(1), kind, "context") for m in rx.finditer(text) if kind != "secret" or (re.search("[0-9]", m[1]) and re.search("[A-Za-z]", m[1])))


def candidates(text: str) -> list[tuple[int, int, str, str, str]]:
    """(start, end, kind, votes, shape) of all proposed spans: the base matches, and others that overlap none of them.

    Of overlapping proposals of one kind, the one of the first labeler stands.
    """
    out: list[tuple[int, int, str, str, str]] = []
    base = base_spans(text)
    taken: dict[str, list[tuple[int, int]]] = {"": sorted((s, e) for s, e, _ in base)}
    for k, (s, e, kind, labeler) in enumerate(_proposals(text, base)):
        if k >= len(base):
            if any(_overlaps(taken.get(x, []), s, e) for x in ("", kind)):
                continue
            insort(taken.setdefault(kind, []), (s, e))
        out.append((s, e, kind, votes(text, s, e, kind, labeler), shape(text, s, e)))
    return out


def _overlaps(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether some of the spans, sorted by start, overlaps start to end; base kinds overlap each other a few deep at most."""
    k = bisect_left(spans, (end,))
    return any(e > start for _, e in spans[max(0, k - 4) : k])


def shape(text: str, start: int, end: int) -> str:
    """Five marks of a span: its length, its share of digits, how many characters differ, and the characters beside it."""
    span = text[start:end]
    digits = sum(c.isdigit() for c in span) / max(len(span), 1)
    near = ["w" if c.isalnum() else "s" if not c or c.isspace() else "p" for c in (text[start - 1 : start], text[end : end + 1])]
    return ("s" if len(span) < 12 else "m" if len(span) < 24 else "l") + ("n" if digits < 0.2 else "h" if digits < 0.7 else "d") + ("f" if len(set(span)) < 8 else "v") + "".join(near)


def votes(text: str, start: int, end: int, kind: str, labeler: str = "regex") -> str:
    """One character for each labeler: 1, 0 or - (abstains). Spans that only another labeler proposes get a 0 from the regex labeler."""
    span = text[start:end]
    digits = [c for c in span if c.isascii() and c.isdigit()]
    regex = "1" if labeler == "regex" else "0"
    if kind == "card":
        check = "1" if len(digits) in (15, 16) else "0"
    elif kind == "ip":
        parts = [int(p) for p in span.split(".")]
        check = "1" if parts[0] not in (0, 127, 255) and all(len(p) == 1 or p[0] != "0" for p in span.split(".")) else "0"
    elif kind == "national_id":
        number = "".join(digits)
        check = "0" if number[:3] in ("000", "666") or number[0] == "9" or number[3:5] == "00" or number[5:] == "0000" else "1"
    elif kind == "secret":
        check = "1" if len(set(span)) >= 8 else "0"
    else:
        check = "-"
    if kind in ("email", "masked_email"):
        gazetteer = "1" if re.split(r"[.\s)\]}]+", span.rstrip(")]} "))[-1].lower() in DOMAINS else "0"
    elif kind == "card":
        gazetteer = "1" if digits[0] in "3456" else "0"
    elif kind in ("phone", "local_phone"):
        gazetteer = "1" if kind == "phone" and digits[0] != "0" else "-"
    elif kind == "secret":
        gazetteer = "1" if labeler == "gazetteer" or re.match(r"AKIA|ASIA|password|passwd|secret|token|api_key", span) else "-"
    else:
        gazetteer = "-"
    around = (text[max(0, start - 40) : start] + " " + text[end : end + 20]).lower()
    context = "1" if labeler == "context" or any(re.search(rf"(?<![^\W_]){re.escape(w)}", around) for w in CONTEXT[kind]) else "-"
    before, after = text[start - 1 : start], text[end : end + 1]
    whole = "0" if (before.isalnum() and kind != "secret") or (after.isalnum()) else "1"
    return regex + check + gazetteer + context + whole


@dataclass
class SpanModel:
    """Reliabilities of the labelers and, for each (kind, votes, shape) seen, the classifier's probability."""

    reliability: dict[str, tuple[float, float]]
    weights: np.ndarray
    known: dict[tuple[str, str, str], float]

    def probability(self, kind: str, vote: str, form: str) -> float:
        p = self.known.get((kind, vote, form))
        return _sigmoid(_row(kind, vote, form) @ self.weights) if p is None else p


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


#: The marks of each place of a shape.
FORMS = ("sml", "nhd", "fv", "wsp", "wsp")
FEATURES = 2 * len(LABELERS) + len(KINDS) + sum(map(len, FORMS)) + 1


def _row(kind: str, vote: str, form: str) -> np.ndarray:
    """Features of a span: each labeler's vote for and against, the kind, its shape and neighbours, and an intercept."""
    marks = [c == m for c, some in zip(form, FORMS, strict=True) for m in some]
    return np.array([*(v == "1" for v in vote), *(v == "0" for v in vote), *(kind == k for k in KINDS), *marks, 1.0], float)


def fit_spans(counts: list[tuple[str, str, str, int]], rounds: int = 60) -> SpanModel:
    """Expectation-maximisation over counted votes (Dawid and Skene), then logistic regression on the posteriors.

    `counts` holds (kind, votes, shape, number of spans): at most 8 * 3^5 * 162 rows, whatever the input. The classifier
    learns the posteriors from votes, shape and neighbours of a span. Labelers start at 80 % hits and 20 % false alarms; none can pass 99.9 %.
    """
    if not counts:
        return SpanModel({}, np.zeros(FEATURES), {})
    n = np.array([c[3] for c in counts], float)
    one = np.array([[v == "1" for v in c[1]] for c in counts], float)
    nil = np.array([[v == "0" for v in c[1]] for c in counts], float)
    hit, alarm, prior = np.full(len(LABELERS), 0.8), np.full(len(LABELERS), 0.2), 0.7
    for _ in range(rounds):
        yes = one @ np.log(hit) + nil @ np.log(1 - hit) + np.log(prior)
        no = one @ np.log(alarm) + nil @ np.log(1 - alarm) + np.log(1 - prior)
        q = _sigmoid(yes - no)
        voted = one + nil
        hit = np.clip(((n * q) @ one + 1.6) / ((n * q) @ voted + 2), 1e-3, 1 - 1e-3)
        alarm = np.clip(((n * (1 - q)) @ one + 0.4) / ((n * (1 - q)) @ voted + 2), 1e-3, 1 - 1e-3)
        prior = float(np.clip(((n * q).sum() + 0.7) / (n.sum() + 1), 0.01, 0.99))
    rows = np.array([_row(*c[:3]) for c in counts])
    w, scale = np.zeros(rows.shape[1]), np.sqrt(n)  # common patterns count more, without drowning the rest
    for _ in range(200):  # Newton steps with a ridge
        p = _sigmoid(rows @ w)
        grad = rows.T @ (scale * (p - q)) + 0.01 * w
        hess = (rows * (scale * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ rows + 0.01 * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 2.0 / max(np.abs(step).max(), 1e-9))
        w -= step
        if np.abs(step).max() < 1e-7:
            break
    known = {c[:3]: float(_sigmoid(r @ w)) for c, r in zip(counts, rows, strict=True)}
    return SpanModel({name: (float(h), float(a)) for name, h, a in zip(LABELERS, hit, alarm, strict=True)}, w, known)


def learn_spans(docs: DataFrame, text_col: str = "text") -> SpanModel:
    """Gathers the votes on all spans of all texts, summed by kind and votes, and fits the model on the sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[tuple[str, str, str]] = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(c[2:] for c in candidates(text.as_py() or ""))
        columns = [pa.array([k[i] for k in seen], pa.string()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(list(seen.values()), pa.int64())], names=["kind", "votes", "shape", "n"])

    counts = docs.select(text_col).mapInArrow(run, "kind string, votes string, shape string, n long").groupBy("kind", "votes", "shape").agg(F.sum("n").alias("n"))
    return fit_spans([(r.kind, r.votes, r["shape"], r.n) for r in counts.orderBy("kind", "votes", "shape").collect()])


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("base", pa.bool_())])


def _decide(text: str, model: SpanModel, threshold: float) -> list[dict]:
    """The spans of a text: base matches always, others where the classifier says so, by start and kind."""
    found = [
        {"start": s, "end": e, "kind": k, "base": k in KINDS[:4]}
        for s, e, k, v, form in candidates(text)
        if k in KINDS[:4] or model.probability(k, v, form) >= threshold
    ]
    return sorted(found, key=lambda x: (x["start"], KINDS.index(x["kind"])))


def personal_spans(docs: DataFrame, model: SpanModel | None = None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """Adds `spans`: array of (start, end, kind, base) in code points, end exclusive, of each whole text.

    Null and empty texts have none. Base matches stay whatever the votes; spans of the wider kinds are added where the
    classifier gives `threshold` or more. A column named spans is replaced; others pass through.
    """
    model = model or learn_spans(docs, text_col)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            yield pa.array([_decide(t.as_py() or "", model, threshold) for t in array], pa.list_(SPAN))

    udf = arrow_udf(run, "array<struct<start:bigint,end:bigint,kind:string,base:boolean>>")
    return docs.withColumn("spans", udf(F.col(text_col)))


def redact(docs: DataFrame, model: SpanModel | None = None, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs with every span replaced by its kind in brackets; overlapping spans become one. Null texts stay null."""
    model = model or learn_spans(docs, text_col)

    def clean(text: str | None) -> str | None:
        if not text:
            return text
        out, done = [], 0
        for x in _decide(text, model, threshold):
            if x["start"] >= done:
                out += [text[done : x["start"]], f"[{x['kind'].upper()}]"]
            done = max(done, x["end"])
        return "".join([*out, text[done:]])

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for array in texts:
            yield pa.array([clean(t.as_py()) for t in array], pa.string())

    return docs.withColumn(text_col, arrow_udf(run, "string")(F.col(text_col)))
