"""Markdown as plain text and as blocks: patterns cut a text at fences, headings and blank lines, so no line is read by a state."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import BLANKS, clean_text

# The bullet of a list; marks that are taken out of prose, with what stays of them; characters that end a line.
BULLET = "• "
PROSE_MARKS = (
    (r"^{w}{{0,3}}#{{1,6}}{w}+", ""), (r"^{w}{{0,3}}>{w}?", ""), (r"^{w}*[-*+]{w}+", BULLET),
    (r"!\[[^\]\n]*\]\([^)\n]*\)", ""), (r"\[([^\]\n]*)\]\([^)\n]*\)", r"\1"), (r"[*_`]", ""),
)
LINE_ENDS = "\r\n|[\r\x0b\x0c\x1c-\x1e\x85  ]"

#: Stands between pieces; as a line end it is in no line.
CUT = "\x1e"
# White space inside a line, in the words of Java and of Python.
_JAVA, _PYTHON = r"[\s\x1f&&[^\n]]", r"[^\S\n]"


def _patterns(w: str) -> dict[str, str]:
    """Patterns over texts whose lines end with LF; w matches white space inside a line."""
    return {
        # a fenced block: the same mark, at least as long, closes it, else the end of the text does
        "fence": rf"^{w}{{0,3}}(?:(`{{3,}}+)|(~{{3,}}+))[^\n]*(?:\n|\z)((?s:.*?))(?:^{w}{{0,3}}(?:\1`*+|\2~*+){w}*$\n?|\z)",
        "heading": rf"^{w}{{0,3}}#{{1,6}}{w}+[^\n]+$",
        "blank": rf"^{w}*$",
        "title": rf"\A{w}{{0,3}}(#{{1,6}}){w}+([^\n]+?){w}*\z",
        "closing": rf"{w}+#+{w}*\z",
        "underline": rf"{w}{{0,3}}(?:=+|-+){w}*",
        "code_line": rf"^{w}*```[^\n]*(?:\n|\z)",
    }


_J = {name: f"(?dmU){p}" for name, p in _patterns(_JAVA).items()}
_P = {name: re.compile(p.replace(r"\z", r"\Z"), re.M) for name, p in _patterns(_PYTHON).items()}


def markdown_to_text(text: Column) -> Column:
    """Plain text of Markdown: fence lines go and code between them stays; elsewhere marks of headings, quotes, emphasis and images go.

    The text is split at fence lines, so that every second part is code.
    """
    parts = F.split(text, _J["code_line"])

    def prose(t: Column) -> Column:
        for pattern, new in PROSE_MARKS:
            t = F.regexp_replace(t, "(?dmU)" + pattern.format(w=_JAVA), new.replace("\\", "$"))
        return t

    marked = lambda t: t.rlike(r"[#>*+\[_`-]")  # noqa: E731  (each pattern needs one of these)
    joined = F.array_join(F.transform(parts, lambda t, i: F.when((i % 2 == 0) & marked(t), prose(t)).otherwise(t)), "")
    return F.when(text.rlike(rf"(?dmU)^{_JAVA}*```[^\n]*\z"), F.regexp_replace(joined, r"\n\z", "")).otherwise(joined)


def _block(kind: str, level, text: Column) -> Column:
    return F.struct(F.lit(kind).alias("kind"), F.lit(level).cast("int").alias("level"), text.alias("text"))


def markdown_blocks(text: Column) -> Column:
    """Array of blocks (block_no, kind, level, text, page) of a Markdown text: headings, paragraphs and fenced code, in order.

    `#` to `######` begin a heading, and `===` or `---` under one line that stands alone makes it one. Code stays as it is; other texts
    lose their marks and are cleaned, and what is then empty is no block, such as a heading without a title. Null has no blocks.
    Built-in functions only; nothing is shuffled, as a text is one value.
    """
    lines = F.regexp_replace(F.coalesce(text, F.lit("")), LINE_ENDS, "\n")
    code = F.regexp_extract_all(lines, F.lit(_J["fence"]), F.lit(3))

    def pieces(prose: Column) -> Column:
        """Headings and what stands between them and blank lines; headings with underlines follow each other from a piece's beginning."""
        marked = F.regexp_replace(F.regexp_replace(prose, _J["heading"], f"{CUT}$0{CUT}"), _J["blank"], CUT)
        underlined = rf"(?dU)\G\n?([^\n]+\n{_patterns(_JAVA)['underline']})(?=\n|\z)"
        return F.flatten(F.transform(F.split(marked, CUT), lambda x: F.split(F.regexp_replace(x, underlined, f"{CUT}$1{CUT}"), CUT)))

    # each step takes a piece's values from the step before, as a value that a lambda names twice is worked out twice
    def read(x: Column) -> Column:
        under = rf"(?dU)\A([^\n]+)\n{_patterns(_JAVA)['underline']}\z"
        return F.struct(x.alias("x"), F.length(F.regexp_extract(x, _J["title"], 1)).alias("marks"), F.regexp_extract(x, under, 1).alias("under"))

    def told(p: Column) -> Column:
        x, marks, under = p["x"], p["marks"], p["under"]
        title = F.regexp_replace(F.regexp_extract(x, _J["title"], 2), _J["closing"], "")
        return F.struct(
            F.when((marks > 0) | (under != ""), "heading").otherwise("paragraph").alias("kind"),
            F.when(marks > 0, marks).when(under != "", F.when(F.contains(F.substring_index(x, "\n", -1), F.lit("=")), 1).otherwise(2)).cast("int").alias("level"),
            F.when(marks > 0, title).when(under != "", under).otherwise(x).alias("text"),
        )

    def plain(p: Column) -> Column:
        return F.struct(p["kind"].alias("kind"), p["level"].alias("level"), clean_text(markdown_to_text(p["text"])).alias("text"))

    def part(z: Column) -> Column:
        blocks = F.transform(F.transform(F.transform(pieces(z["prose"]), read), told), plain)
        fenced = _block("code", None, F.regexp_replace(z["code"], r"\n\z", ""))
        return F.when(z["code"].isNotNull(), F.concat(blocks, F.array(fenced))).otherwise(blocks)

    found = F.flatten(F.transform(F.arrays_zip(F.split(lines, _J["fence"]).alias("prose"), code.alias("code")), part))
    kept = F.filter(found, lambda b: b["text"].rlike(r"(?U)[^\s\x1c-\x1f]"))
    return F.transform(kept, lambda b, i: F.struct(
        i.cast("int").alias("block_no"), b["kind"].alias("kind"), b["level"].alias("level"), b["text"].alias("text"), F.lit(None).cast("int").alias("page")
    ))


def markdown_rows(raw: str | None) -> list[dict]:
    """The blocks of one text, as `markdown_blocks` gives them for a column."""

    def plain(text: str) -> str:
        parts = _P["code_line"].split(text)
        for pattern, new in PROSE_MARKS:
            parts[::2] = [re.sub("(?m)" + pattern.format(w=_PYTHON), new, p) for p in parts[::2]]
        return re.sub(r"\n{3,}", "\n\n", re.sub(BLANKS, " ", "".join(parts))).strip()

    def prose(text: str) -> list[tuple]:
        out = []
        heads = [*_P["heading"].finditer(text), None]
        for begin, head in zip([0, *(h.end() for h in heads[:-1])], heads, strict=True):
            for run in _P["blank"].split(text[begin : head.start() if head else len(text)]):
                rest = list(filter(None, run.split("\n")))
                while len(rest) > 1 and re.fullmatch(_P["underline"], rest[1]):
                    out.append(("heading", 1 if "=" in rest[1] else 2, plain(rest[0])))
                    rest = rest[2:]
                out.append(("paragraph", None, plain("\n".join(rest))))
            if head:
                marks, title = _P["title"].match(head[0]).groups()
                out.append(("heading", len(marks), plain(_P["closing"].sub("", title))))
        return out

    lines, found, at = re.sub(LINE_ENDS, "\n", raw or ""), [], 0
    for m in _P["fence"].finditer(lines):
        found += [*prose(lines[at : m.start()]), ("code", None, m[3].removesuffix("\n"))]
        at = m.end()
    kept = [b for b in found + prose(lines[at:]) if b[2].strip()]
    return [{"block_no": i, "kind": kind, "level": level, "text": text, "page": None} for i, (kind, level, text) in enumerate(kept)]
