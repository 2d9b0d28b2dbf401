"""Text of a page-analysis block graph (layout blocks with their child text)."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCKS = "array<struct<id:string,block_type:string,text:string,children:array<string>>>"
#: In layout_texts: a child that isn't there, and a page break; blocks without text, with nothing to write, and with something; what is written besides blocks.
LOST, PAGE = -1, -1
SILENT, EMPTY, LOUD = 0, 1, 2
LINE_END, FORM_FEED, LINE_AND_FEED = -1, -2, -3
SEEN = b"1"


class LayoutError(ValueError):
    """A block that names a child which isn't there."""


def layout_text(blocks: Sequence[dict[str, Any]], include_page_breaks: bool = False) -> str:
    """Text of all LAYOUT_ blocks in order.

    A block with text of its own speaks for its direct children; every
    block is visited once, in whatever place it comes up first. Lines end with a newline,
    words with a space, and a layout block that wrote anything with a newline.
    """
    by_id = {b["id"]: b for b in blocks if b["id"] is not None}
    seen: set[str] = set()
    out: list[str] = []
    pages = 0

    def visit(start: dict[str, Any]) -> None:
        open_ = [(start, False)]
        while open_:
            block, told = open_.pop()
            if block["id"] is not None:
                if block["id"] in seen:
                    continue
                seen.add(block["id"])
            speaks = not told and block["text"] is not None
            if speaks:
                out.append(block["text"] + {"LINE": "\n", "WORD": " "}.get(block["block_type"], ""))
            kids = []
            for child in block["children"] if block["children"] is not None else ():
                if child not in by_id:
                    raise LayoutError(f"child block {child} not found")
                kids.append((by_id[child], speaks))
            open_.extend(reversed(kids))

    for block in blocks:
        kind = block["block_type"] or ""
        if include_page_breaks and kind == "PAGE":
            if pages:
                if not "".join(out).endswith("\n"):
                    out.append("\n")
                out.append("\f")
            pages += 1
        elif kind.startswith("LAYOUT_"):
            before = sum(map(len, out))
            visit(block)
            if sum(map(len, out)) > before:
                out.append("\n")
    return "".join(out)


def layout_texts(df: DataFrame, blocks: str = "blocks", include_page_breaks: bool = False) -> DataFrame:
    """Adds text and error of a column of BLOCKS, as layout_text has them, for tables: each graph is walked where its row is, by SQL functions, and nothing is shuffled or written.

    Names become places once, by halving steps over the sorted ids. Then the depth-first visit is an aggregate whose state is a stack
    (the next block first), a byte for each block that says whether it was seen, and the places that speak; texts are
    joined at the end. A step copies these bytes and the stack, so very large graphs have a small quadratic share. Null blocks have neither
    text nor error; a visited block that names a missing child gives an error and no text.
    """
    b, names, halves, kids, own, speech, tops = map(F.col, ("_b", "_names", "_halves", "_kids", "_own", "_speech", "_tops"))
    kind = lambda x: F.coalesce(x.block_type, F.lit(""))
    piece = lambda x: F.concat(x.text, F.when(kind(x) == "LINE", "\n").when(kind(x) == "WORD", " ").otherwise(""))

    def find(name: Column) -> Column:
        """The place of the last block with this id, or null."""
        hit = F.get(names, F.aggregate(halves, F.lit(0), lambda at, step: F.when(F.get(names, at + step - 1).id < name, at + step).otherwise(at)))
        return F.when(hit.id == name, -hit.at)

    def top(x: Column, i: Column) -> Column:
        layout = F.when(kind(x).startswith("LAYOUT_"), i)
        return layout.when(kind(x) == "PAGE", F.lit(PAGE)) if include_page_breaks else layout

    none = F.array().cast("array<string>")
    prepared = df.withColumn("_b", F.col(blocks).cast(BLOCKS))
    prepared = prepared.withColumn("_names", F.array_sort(F.filter(F.transform(b, lambda x, i: F.struct(x.id.alias("id"), (-i).alias("at"))), lambda x: x.id.isNotNull())))
    prepared = prepared.withColumn("_halves", F.transform(F.sequence(F.length(F.bin(F.size(names))) - 1, F.lit(0)), lambda k: F.call_function("shiftleft", F.lit(1), k)))
    prepared = prepared.withColumns({
        "_kids": F.transform(b, lambda x: F.transform(F.coalesce(x.children, none), lambda c: F.coalesce(find(c), F.lit(LOST)))),
        "_own": F.transform(b, lambda x, i: F.coalesce(find(x.id), i)),
        "_speech": F.transform(b, lambda x: F.when(x.text.isNull(), SILENT).when(piece(x) == "", EMPTY).otherwise(LOUD)),
        "_tops": F.filter(F.transform(b, top), lambda t: t.isNotNull()),
    })

    if include_page_breaks:  # the first page breaks nothing
        first = F.array_position(tops, PAGE) - 1
        prepared = prepared.withColumn("_tops", F.filter(tops, lambda _, i: i != first))

    def state(s: Column, **changed: Column) -> Column:
        return F.struct(*(changed.get(k, s[k]).alias(k) for k in ("at", "stack", "seen", "out", "bad")))

    def ended(out: Column) -> Column:
        """With the line end of a layout block that wrote something."""
        return F.when(F.try_element_at(out, F.lit(-1)) >= 0, F.concat(out, F.array(F.lit(LINE_END)))).otherwise(out)

    def begin(s: Column) -> Column:
        """The next layout block, or page break."""
        at = F.get(tops, s.at)
        broken = F.when(F.try_element_at(s.out, F.lit(-1)) >= LINE_END, FORM_FEED).otherwise(LINE_AND_FEED)
        page = state(s, at=s.at + 1, out=F.concat(ended(s.out), F.array(broken)))
        block = state(s, at=s.at + 1, out=ended(s.out), stack=F.array(at * 2))
        return F.when(at >= 0, block).when(at == PAGE, page).otherwise(s)

    def visit(s: Column) -> Column:
        """The block on top of the stack: twice its place, and one more where it was spoken for."""
        entry = F.get(s.stack, F.lit(0))
        at, rest = F.call_function("shiftright", entry, F.lit(1)), F.slice(s.stack, F.lit(2), F.size(s.stack))
        mark, said, under = F.get(own, at) + 1, F.get(speech, at), F.get(kids, at)
        speaks = (entry % 2 == 0) & (said != SILENT)
        new = state(
            s,
            stack=F.concat(F.transform(under, lambda k: k * 2 + speaks.cast("int")), rest),
            seen=F.overlay(s.seen, F.lit(SEEN), mark, 1),
            out=F.when(speaks & (said == LOUD), F.concat(s.out, F.array(at))).otherwise(s.out),
            bad=F.when(F.array_contains(under, LOST), at).otherwise(s.bad),
        )
        return F.when(F.substring(s.seen, mark, F.lit(1)) == F.lit(SEEN), state(s, stack=rest)).otherwise(new)

    def step(s: Column, _: Column) -> Column:
        return F.when(s.bad.isNotNull(), s).when(F.size(s.stack) == 0, begin(s)).otherwise(visit(s))

    ints = F.array().cast("array<int>")
    start = {"at": F.lit(0), "stack": ints, "seen": F.repeat(F.lit("0"), F.size(b)).cast("binary"), "out": ints, "bad": F.lit(None).cast("int")}
    # each layout block is taken up and then visited, and each child of a block offered once
    steps = F.sequence(F.lit(1), 2 * F.size(tops) + F.size(F.flatten(kids)) + 1)
    walked = prepared.withColumn("_walk", F.aggregate(steps, F.struct(*(c.alias(k) for k, c in start.items())), step, lambda s: F.struct(ended(s.out).alias("out"), s.bad.alias("bad"))))
    out, bad = F.col("_walk.out"), F.col("_walk.bad")
    marks = {LINE_END: "\n", FORM_FEED: "\f", LINE_AND_FEED: "\n\f"}

    def written(at: Column) -> Column:
        found = F.when(at >= 0, piece(F.get(b, at)))
        for mark, text in marks.items():
            found = found.when(at == mark, text)
        return found

    lost = F.coalesce(F.get(F.get(b, bad).children, (F.array_position(F.get(kids, bad), LOST) - 1).cast("int")), F.lit("None"))
    text = F.when(bad.isNull(), F.array_join(F.transform(out, written), ""))
    error = F.when(bad.isNotNull(), F.concat(F.lit("child block "), lost, F.lit(" not found")))
    return walked.drop("text", "error").withColumns({"text": text, "error": error}).drop("_b", "_names", "_halves", "_kids", "_own", "_speech", "_tops", "_walk")


def layout_cost(pages: Column, price: float = 0.004) -> Column:
    """Estimated price of analysing pages."""
    return pages * F.lit(price)
