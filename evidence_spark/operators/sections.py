"""Blocks grouped into sections, sections cut into chunks, and chunks traced back to blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidence_spark.functions.structure import ALONE, SPACES, slices
from evidence_spark.functions.text import strip
from evidence_spark.operators.scan import running

#: Levels of headings, and characters of a bin when intervals meet.
LEVELS, BIN = 6, 4096
JOIN = 2  # characters between the texts of two blocks of a section


def section_groups(blocks: DataFrame, segment: int | None = None) -> DataFrame:
    """Blocks that are not blank, with section_path and group_no (from 0).

    `blocks`: doc_id, block_no, kind, level, text, and perhaps section_path, which counts instead of the headings above if it is not empty. A
    title stays in the path until a heading of its own or a higher level comes; that is the last heading of each level, if no higher
    one is later. A group begins at each heading, where the path changes, and around tables, formulas and code. `segment`: as in
    `running`, for documents of more blocks than one task should read. Further columns stay.
    """
    shown = blocks.filter(F.col("text").rlike(r"(?U)[^\s\x1c-\x1f]"))
    heading = F.col("kind") == "heading"
    told = F.struct(F.col("block_no").alias("at"), strip(F.col("text")).alias("title"))
    names = [f"_level_{n}" for n in range(1, LEVELS + 1)]
    last = running(shown, ["doc_id"], "block_no", {name: ("max", F.when(heading & (F.col("level") == n), told)) for n, name in enumerate(names, 1)}, segment=segment)
    titles = [
        F.when(F.col(name)["at"] > F.greatest(F.lit(-1), *[F.coalesce(F.col(higher)["at"], F.lit(-1)) for higher in names[:n]], F.lit(-1)), F.col(name)["title"])
        for n, name in enumerate(names)
    ]
    path: Column = F.array_compact(F.array(*titles))
    if "section_path" in blocks.columns:
        path = F.when(F.size("section_path") > 0, F.col("section_path")).otherwise(path)
    pathed = last.withColumn("section_path", path).drop(*names)
    alone = F.col("kind").isin(*ALONE)
    seen = F.struct(F.col("block_no").alias("at"), F.col("section_path").alias("path"), alone.alias("alone"))
    after = running(pathed, ["doc_id"], "block_no", {"_last": ("max", seen)}, before=True, segment=segment)
    begins = F.col("_last").isNull() | heading | alone | F.col("_last.alone") | (F.col("_last.path") != F.col("section_path"))
    marked = after.withColumn("_begins", F.coalesce(begins, F.lit(True)).cast("long")).drop("_last")
    numbered = running(marked, ["doc_id"], "block_no", {"group_no": ("sum", F.col("_begins"))}, segment=segment)
    return numbered.withColumn("group_no", F.col("group_no") - 1).drop("_begins")


def block_offsets(blocks: DataFrame, segment: int | None = None) -> DataFrame:
    """Adds char_start and char_end of each block in the text of its section: the texts of its blocks, two characters between them."""
    size = F.length("text").cast("long")
    placed = running(blocks, ["doc_id", "group_no"], "block_no", {"_end": ("sum", size + JOIN)}, segment=segment)
    return placed.withColumns({"char_start": F.col("_end") - JOIN - size, "char_end": F.col("_end") - JOIN}).drop("_end")


def chunk_spans(chunks: DataFrame, offsets: DataFrame, bin_size: int = BIN) -> DataFrame:
    """(chunk_id, doc_id, group_no, block_no, char_start, char_end): the parts of blocks that each chunk holds, in the characters of the block.

    `chunks`: chunk_id, doc_id, group_no, start, end in the section's text; `offsets`: what `block_offsets` gives. Both sides are
    cut into bins of characters and meet in the bins that they share, a pair in the first of these only. Sections of any length do, and
    the joins between blocks belong to none.
    """

    def bins(start: str, end: str) -> Column:
        return F.explode(F.sequence(F.floor(F.col(start) / bin_size), F.floor((F.col(end) - 1) / bin_size)))

    held = chunks.filter("end > start").select("chunk_id", "doc_id", "group_no", "start", "end", bins("start", "end").alias("_bin"))
    given = offsets.filter("char_end > char_start").select("doc_id", "group_no", "block_no", F.col("char_start").alias("_from"), F.col("char_end").alias("_to"))
    met = held.join(given.withColumn("_bin", bins("_from", "_to")), ["doc_id", "group_no", "_bin"])
    left, right = F.greatest("start", "_from"), F.least("end", "_to")
    first = F.col("_bin") == F.floor(left / bin_size)
    return met.filter((left < right) & first).select("chunk_id", "doc_id", "group_no", "block_no", (left - F.col("_from")).alias("char_start"), (right - F.col("_from")).alias("char_end"))


def _ranges(text: Column, keep_space: Column, b: Column, block: str, child: int, parent: int) -> Column:
    """(is_parent, parents, text, tokens, pages, spans) slices of a section's text, each parent followed by its children.

    parents: those up to this slice, itself included; b: the section's blocks, of the type `block`. Built-in functions only, as rows that
    have been in Python must be dealt anew. Blocks hold a character at least and stand JOIN apart, so a parent looks at so many.
    """
    near = parent // (JOIN + 1) + 5

    def pieces(whole: Column, limit: int) -> Column:
        return F.when(keep_space, slices(whole, limit, True)).otherwise(slices(whole, limit))

    def solid(x: Column) -> Column:
        return F.when(keep_space, x).otherwise(F.btrim(x, F.lit(SPACES)))

    def begin(x: Column) -> Column:
        return F.when(keep_space, 0).otherwise(F.length(x) - F.length(F.ltrim(x, F.lit(SPACES))))

    def touched(blocks: Column, lo: Column, hi: Column) -> Column:
        return F.filter(blocks, lambda x: F.greatest(x["char_start"], lo) < F.least(x["char_end"], hi))

    # each step takes its values from the step before, as a value that a lambda names twice is worked out twice
    def stepped(whole: Column, limit: int) -> Column:
        """(lo, hi, text) of each slice."""
        one = F.transform(pieces(whole, limit), lambda x: F.struct(F.length(x).alias("size"), begin(x).alias("skip"), solid(x).alias("text")))

        def add(so_far: Column, x: Column) -> Column:
            lo = so_far["at"] + x["skip"]
            return F.struct((so_far["at"] + x["size"]).alias("at"), F.concat(so_far["out"], F.array(F.struct(lo.alias("lo"), (lo + F.length(x["text"])).alias("hi"), x["text"].alias("text")))).alias("out"))

        none = F.array().cast("array<struct<lo:int,hi:int,text:string>>")
        return F.aggregate(one, F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda x: x["out"])

    def placed(slice_: Column, is_parent: bool, n: Column, blocks: Column) -> Column:
        lo, hi = slice_["lo"], slice_["hi"]
        spans = F.transform(blocks, lambda x: F.struct(
            x["block_no"].cast("int").alias("block_no"), (F.greatest(x["char_start"], lo) - x["char_start"]).cast("int").alias("char_start"), (F.least(x["char_end"], hi) - x["char_start"]).cast("int").alias("char_end")
        ))
        return F.struct(
            F.lit(is_parent).alias("is_parent"), n.alias("parents"), slice_["text"].alias("text"), (hi - lo).alias("tokens"), F.transform(blocks, lambda x: x["page"]).alias("pages"), spans.alias("spans")
        )

    def family(p: Column) -> Column:
        """A parent and its children, which touch blocks of their parent only."""
        moved = F.transform(stepped(p["slice"]["text"], child), lambda c: F.struct((c["lo"] + p["slice"]["lo"]).alias("lo"), (c["hi"] + p["slice"]["lo"]).alias("hi"), c["text"].alias("text")))
        met = F.transform(moved, lambda c: F.struct(c.alias("slice"), touched(p["own"], c["lo"], c["hi"]).alias("own")))
        return F.concat(F.array(placed(p["slice"], True, p["n"], p["own"])), F.transform(met, lambda c: placed(c["slice"], False, p["n"], c["own"])))

    def meet(so_far: Column, x: Column) -> Column:
        """The blocks of the next parent; `past` of them end before it, so none is looked at by all parents."""
        rest = F.slice(b, so_far["past"] + 1, near)
        n = F.size(so_far["out"]) + 1
        return F.struct(
            (so_far["past"] + F.size(F.filter(rest, lambda y: y["char_end"] <= x["hi"]))).alias("past"),
            F.concat(so_far["out"], F.array(F.struct(x.alias("slice"), n.alias("n"), touched(rest, x["lo"], x["hi"]).alias("own")))).alias("out"),
        )

    none = F.array().cast(f"array<struct<slice:struct<lo:int,hi:int,text:string>,n:int,own:array<{block}>>>")
    parents = F.aggregate(stepped(text, parent), F.struct(F.lit(0).alias("past"), none.alias("out")), meet, lambda x: x["out"])
    return F.flatten(F.transform(parents, family))


def structured_chunks(blocks: DataFrame, child: int = 256, parent: int = 1024) -> DataFrame:
    """Parents inside sections and children inside parents: doc_id, is_parent, chunk_index, parent_index, title, section_path, text, tokens, page_start, page_end, spans.

    `blocks`: those of `section_groups`, with page. Tokens are characters. Blocks are shuffled once, by document: sections, offsets and
    numbers of chunks are windows over the same order. One section's text is a value. Rows stay dealt by document, so windows and sums
    over documents or their parts need no other shuffle. spans: (block_no, char_start, char_end).
    """
    b = F.col("b")
    grouped = block_offsets(section_groups(blocks)).groupBy("doc_id", "group_no").agg(
        F.sort_array(F.collect_list(F.struct("block_no", "kind", "text", "page", "char_start", "char_end"))).alias("b"), F.first("section_path").alias("section_path")
    )
    whole = F.array_join(F.transform(b, lambda x: x["text"]), "\n\n")
    slim = F.transform(b, lambda x: F.struct(x["block_no"].alias("block_no"), x["page"].alias("page"), x["char_start"].cast("int").alias("char_start"), x["char_end"].cast("int").alias("char_end")))
    joined = grouped.select("doc_id", "group_no", "section_path", whole.alias("whole"), (F.get(b, F.lit(0))["kind"] == "code").alias("keep"), slim.alias("b"))
    block = joined.schema["b"].dataType.elementType.simpleString()
    cut = joined.select("doc_id", "group_no", "section_path", _ranges(F.col("whole"), F.col("keep"), b, block, child, parent).alias("ranges"))
    cut = cut.withColumn("_parents", F.coalesce(F.try_element_at("ranges", F.lit(-1))["parents"], F.lit(0)).cast("long")).withColumn("_children", F.size("ranges") - F.col("_parents"))
    cut = running(cut, ["doc_id"], "group_no", {"_earlier": ("sum", F.col("_parents")), "_older": ("sum", F.col("_children"))}, before=True)
    flat = cut.select("doc_id", "section_path", F.coalesce("_earlier", F.lit(0)).alias("_earlier"), F.coalesce("_older", F.lit(0)).alias("_older"), F.posexplode("ranges").alias("_at", "r"))
    place = (F.col("_earlier") + F.col("r.parents") - 1).cast("int")
    return flat.select(
        "doc_id", F.col("r.is_parent").alias("is_parent"),
        F.when(F.col("r.is_parent"), place).otherwise((F.col("_older") + F.col("_at") - F.col("r.parents")).cast("int")).alias("chunk_index"),
        F.when(~F.col("r.is_parent"), place).alias("parent_index"), F.try_element_at("section_path", F.lit(-1)).alias("title"), "section_path",
        F.col("r.text").alias("text"), F.col("r.tokens").alias("tokens"), F.array_min("r.pages").alias("page_start"), F.array_max("r.pages").alias("page_end"), F.col("r.spans").alias("spans"),
    )
