"""From items of a document to chunks: packing with overlap, sections, pictures, lexicon entries, boxes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.text import heading_path, let, merged_paths

TEXT_TYPES = ("TextItem", "SectionHeaderItem", "ListItem")
TABLE_TYPE = "TableItem"


def section_ids(items: DataFrame, key: str, order: str, heading: Column, block: int = 100_000) -> DataFrame:
    """items with section: a number that grows wherever the heading path changes, by the whole-number order of a key.

    Changes are counted in blocks of the order, and only one row for each block is ordered within its key, so that a key
    with a large part of all rows is not one task's."""
    marked = items.withColumn("_heading", heading).withColumn("_block", F.floor(F.col(order) / block))
    w = Window.partitionBy(key, "_block").orderBy(order)
    changed = F.coalesce((F.lag("_heading").over(w) != F.col("_heading")).cast("int"), F.lit(0))
    marked = marked.withColumn("_changed", changed).withColumn("_within", F.sum("_changed").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ends = marked.groupBy(key, "_block").agg(F.min_by("_heading", order).alias("first"), F.max_by("_heading", order).alias("last"), F.max("_within").alias("n"))
    v = Window.partitionBy(key).orderBy("_block")
    start = F.coalesce((F.lag("last").over(v) != F.col("first")).cast("int"), F.lit(0))
    before = ends.withColumn("_start", start).withColumn("_before", F.sum(F.col("n") + F.col("_start")).over(v.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    both = marked.join(before.select(F.col(key).alias("_key"), F.col("_block").alias("_at"), "_before"), F.col(key).eqNullSafe(F.col("_key")) & F.col("_block").eqNullSafe(F.col("_at")))
    return both.withColumn("section", F.col("_before") + F.col("_within")).drop("_heading", "_block", "_changed", "_within", "_key", "_at", "_before")


class _Buffer:
    """Texts of one section that wait for their chunk."""

    def __init__(self, overlap: int):
        self.overlap = overlap
        self.parts: list[str] = []
        self.size = 0

    def take(self, carry: bool) -> str | None:
        if not self.parts:
            return None
        text = "\n".join(self.parts).strip()
        self.parts, self.size = [], 0
        if carry and text:
            self.parts = ["... " + text[-self.overlap :]]
            self.size = len(self.parts[0])
        return text


def pack_items(items: list[tuple], most: int, overlap: int) -> Iterator[tuple[str, str, int]]:
    """(text, heading, page) of the chunks of one document's items (type, headings, page, text) in order.

    Texts are packed up to `most` characters, separators not counted; a full chunk hands its last `overlap` characters
    to the next. A change of heading or a table closes the chunk without overlap; a table is a chunk of its own; an
    item longer than `most` is not divided. A chunk's page is that of the last item seen when it is closed.
    """
    buffer, heading, page = _Buffer(overlap), "", 0
    for kind, headings, number, text in items:
        path = " > ".join(headings) if headings is not None else ""
        if path != heading:
            if (done := buffer.take(False)) is not None:
                yield done, heading, page
            heading = path
        if number is not None:
            page = int(number)
        value = (text or "").strip()
        if kind == TABLE_TYPE:
            if (done := buffer.take(False)) is not None:
                yield done, heading, page
            if text:
                yield text, heading, int(number or 0)
        elif kind in TEXT_TYPES and value:
            if buffer.size + len(value) > most and (done := buffer.take(True)) is not None:
                yield done, heading, page
            buffer.parts.append(value)
            buffer.size += len(value)
    if (done := buffer.take(False)) is not None:
        yield done, heading, page


def _packed(most: int, overlap: int):
    """Rows arrive by (source, item_idx): the items of a document in a row."""

    def chunks(source: str, items: list[tuple]) -> list[tuple]:
        return [(source, i, h, p, t) for i, (t, h, p) in enumerate(pack_items(items, most, overlap))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, items = None, []
        for pdf in batches:
            out: list[tuple] = []
            pages = [None if pd.isna(p) else int(p) for p in pdf["page"]]
            for s, *item in zip(pdf["source"], pdf["item_type"], pdf["headings"], pages, pdf["text"], strict=True):
                if s != source:
                    out += chunks(source, items)
                    source, items = s, []
                items.append(tuple(item))
            yield pd.DataFrame(out, columns=["source", "chunk_index", "parent_context", "page", "text"])
        yield pd.DataFrame(chunks(source, items), columns=["source", "chunk_index", "parent_context", "page", "text"])

    return run


def chunk_documents(items: DataFrame, most: int = 1500, overlap: int = 200) -> DataFrame:
    """Chunks (source, chunk_index, parent_context, page, text) of items(source, item_idx, item_type, headings, page,
    text). Packing is sequential within a document, which is never divided; documents stream through a task one after
    the other. Items without a source belong to no document."""
    kept = items.filter(F.col("item_type").isin(*TEXT_TYPES, TABLE_TYPE) & F.col("source").isNotNull()).select("source", "item_idx", "item_type", "headings", "page", "text")
    ordered = kept.repartition("source").sortWithinPartitions("source", "item_idx")
    return ordered.mapInPandas(_packed(most, overlap), "source string, chunk_index int, parent_context string, page int, text string")


def line_items(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items from plain texts: every non-blank line is one; rows of tables are table items."""
    split = docs.select(F.col(id_col).cast("string").alias("source"), F.posexplode(F.split(F.col(text_col), "\n")).alias("item_idx", "text"))
    kind = F.when(F.col("text").startswith("|"), TABLE_TYPE).when(F.col("text").rlike(r"^\s*([-*]|\d+[.)])\s"), "ListItem").otherwise("TextItem")
    return split.filter(F.trim("text") != "").select("source", "item_idx", kind.alias("item_type"), F.array().cast("array<string>").alias("headings"), F.lit(1).alias("page"), "text")


def attach_images(chunks: DataFrame, images: DataFrame) -> DataFrame:
    """chunks(source, chunk_index, page, text, image_path) with the pictures of images(source, img_idx, page,
    anchor_text, summary, image_path) injected.

    A picture goes to the first chunk of its page that contains its anchor, else to the first of the page; one whose
    page has no chunk is dropped. Summaries follow the text, those with an anchor hit first, then by img_idx.
    """
    c = chunks.select("source", "page", "chunk_index", "text")
    i = images.select("source", "page", "img_idx", F.coalesce("anchor_text", F.lit("")).alias("anchor"), "summary", F.col("image_path").alias("img_path"))
    pairs = i.join(c, ["source", "page"]).withColumn("hit", (F.col("anchor") != "") & F.col("text").contains(F.col("anchor")))
    first = Window.partitionBy("source", "img_idx").orderBy(F.desc("hit"), "chunk_index")
    placed = pairs.withColumn("rn", F.row_number().over(first)).filter(F.col("rn") == 1)
    each = F.array_sort(F.collect_list(F.struct((~F.col("hit")).alias("late"), "img_idx", "summary", "img_path")))
    per_chunk = placed.groupBy("source", "chunk_index").agg(each.alias("added"))
    out = chunks.join(per_chunk, ["source", "chunk_index"], "left")
    more = F.array_join(F.transform("added", lambda x: x["summary"]), "\n")
    paths = F.array_join(F.transform("added", lambda x: x["img_path"]), ",")
    some = F.col("added").isNotNull()
    out = out.withColumn("text", F.when(some, F.concat("text", F.lit("\n"), more)).otherwise(F.col("text")))
    return out.withColumn("image_path", F.when(some, merged_paths(F.col("image_path"), paths)).otherwise(F.col("image_path"))).withColumn("has_visual", F.coalesce("has_visual", F.lit(False)) | some if "has_visual" in chunks.columns else some).drop("added")


def large_images(images: DataFrame, width: str, height: str, least: int = 80) -> DataFrame:
    return images.filter((F.col(width) >= least) & (F.col(height) >= least))


def visual_regions(images: DataFrame, drawings: DataFrame, blocks: DataFrame, most_drawings: int) -> DataFrame:
    """(page, x0, y0, x1, y1): what may belong to a figure, for merge_boxes. Pictures count if both sides exceed 50,
    drawings if a side exceeds 5 and the page has at most `most_drawings`, blocks of text if they are shorter than 200."""
    box = ["page", "x0", "y0", "x1", "y1"]
    wide, high = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    crowded = drawings.groupBy("page").count().filter(F.col("count") > most_drawings).select("page")
    lines = drawings.join(crowded, "page", "left_anti").filter((wide > 5) | (high > 5))
    return images.filter((wide > 50) & (high > 50)).select(box).unionByName(lines.select(box)).unionByName(blocks.filter(F.length("text") < 200).select(box))


# --- lexicon pages -------------------------------------------------------------------------------------------------

# What marks a line of a page as running matter.
RUNNING = ["SIMPLIFIED TECHNICAL ENGLISH", "ASD-STE100", "WORD APPROVED MEANING/", "(PART OF SPEECH)", "ALTERNATIVES", "APPROVED EXAMPLE", "NOT APPROVED", "BLANK PAGE"]
# The parts of speech that a dictionary marks.
POS_TAGS = ["v", "n", "adj", "adv", "prep", "conj", "pron", "art", "pn"]
POS = rf"\((?:{'|'.join(POS_TAGS)})\)"


def unwanted_line(text: Column) -> Column:
    def hit(up: Column) -> Column:
        found = up == ""
        for phrase in RUNNING:
            found = found | up.contains(phrase)
        return found | up.rlike(r"\b\d{4}-\d{2}-\d{2}\b|ISSUE \d+|PAGE [A-Z0-9-]+")

    return let(F.upper(F.trim(F.coalesce(text, F.lit("")))), hit)


def columns_of(words: DataFrame, height: Column, first: float = 140, second: float = 265, margin: float = 0.08) -> DataFrame:
    """words(page, text, x0, top) within the page's margins, with column 1 or 2 by x; the rest is dropped."""
    inside = words.filter((F.col("top") >= margin * height) & (F.col("top") <= (1 - margin) * height))
    return inside.withColumn("column", F.when(F.col("x0") < first, 1).when(F.col("x0") < second, 2)).filter(F.col("column").isNotNull())


def word_lines(words: DataFrame, gap: float = 3.0) -> DataFrame:
    """(page, line, column, text): words whose tops follow within `gap` share a line; lines by top, words by x."""
    w = Window.partitionBy("page").orderBy("top", "x0")
    new = F.coalesce((F.col("top") - F.lag("top").over(w) > gap).cast("int"), F.lit(0))
    numbered = words.withColumn("_new", new).withColumn("line", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    ordered = F.array_sort(F.collect_list(F.struct("x0", "text")))
    return numbered.groupBy("page", "line", "column").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def lexicon_entries(lines: DataFrame) -> DataFrame:
    """Entries (page, entry, c1, c2) of lines(page, line, c1, c2): a line with a part of speech in c1 opens an entry and
    the following ones continue it, also over page ends."""
    opens = F.coalesce(F.col("c1"), F.lit("")).rlike(POS).cast("int")
    kept = lines.filter(~unwanted_line(F.concat_ws(" ", "c1", "c2"))).withColumn("_opens", opens)
    # numbered within each page, pages by the entries before them: only one row for each page passes through one task
    before = Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    offsets = kept.groupBy("page").agg(F.sum("_opens").alias("n")).select("page", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("page").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    kept = kept.join(offsets, "page").withColumn("entry", F.col("_before") + F.sum("_opens").over(within)).filter("entry > 0")
    joined = lambda c: F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", F.coalesce(c, F.lit("")).alias("t")))), lambda x: x["t"]), " "))
    return kept.groupBy("entry").agg(F.min("page").alias("page"), joined("c1").alias("c1"), joined("c2").alias("c2"))


def parsed_entries(entries: DataFrame) -> DataFrame:
    """One row for each word form: keyword, word_form, pos, is_approved, alternatives, meaning, note."""
    head = rf"^([A-Za-z\s-]+?)\s*({POS})"
    word = F.trim(F.regexp_extract("c1", head, 1))
    more = F.regexp_extract_all(F.regexp_replace("c1", head, ""), F.lit(r"\b[A-Z]{2,}\b"), F.lit(0))
    note = F.nullif(F.trim(F.regexp_extract("c2", r"(?is)\bNOTE:(.*)", 1)), F.lit(""))
    main = F.trim(F.regexp_replace("c2", r"(?is)\bNOTE:.*", ""))
    approved = word == F.upper(word)
    found = F.transform(F.regexp_extract_all(main, F.lit(rf"[A-Z][A-Z\s-]+\s*{POS}"), F.lit(0)), F.trim)
    alternatives = F.when(~approved, found).otherwise(F.array().cast("array<string>"))
    rest = F.when(~approved & (F.size(found) == 0) & (main != ""), main)
    rows = entries.filter(word != "").select(
        "entry", F.lower(word).alias("keyword"), F.regexp_replace(F.regexp_extract("c1", head, 2), "[()]", "").alias("pos"), approved.alias("is_approved"), alternatives.alias("alternatives"),
        F.when(approved & (main != ""), main).alias("meaning"), F.nullif(F.concat_ws(" ", rest, note), F.lit("")).alias("note"), F.explode(F.array_distinct(F.concat(F.array(word), more))).alias("word_form"),
    )
    return rows


def lexicon(rows: DataFrame) -> DataFrame:
    """(keyword, forms, notes): the forms of each keyword in order of their entries, its notes joined by spaces."""
    ordered = F.array_sort(F.collect_list(F.struct("entry", "word_form", "pos", "is_approved", "alternatives", "meaning")))
    # a set hashes its rows, where array_distinct would compare each with all others
    notes = F.array_sort(F.collect_set(F.when(F.col("note").isNotNull(), F.struct("entry", "note"))))
    made = rows.groupBy("keyword").agg(ordered.alias("forms"), notes.alias("notes"))
    return made.withColumn("notes", F.when(F.size("notes") > 0, F.array_join(F.transform("notes", lambda x: x["note"]), " ")))


def form_entries(forms: str) -> Column:
    """The first form of each entry, of forms in order of their entries."""
    return F.filter(forms, lambda x, i: ~F.get(F.col(forms), i - 1)["entry"].eqNullSafe(x["entry"]))


def font_sections(spans: DataFrame, size: float = 11, shortest: int = 20, default: str = "General") -> DataFrame:
    """(page_order, heading, text) of spans(span, text, size, bold): big or bold ones head what follows; a section's
    content counts if it is longer than `shortest` characters."""
    w = Window.partitionBy("source").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    is_head = (F.col("size") > size) | F.col("bold")
    marked = spans.withColumn("_head", is_head).withColumn("section", F.sum(is_head.cast("int")).over(w)).withColumn("heading", F.last(F.when(is_head, F.trim("text")), ignorenulls=True).over(w))
    body = marked.filter(~F.col("_head")).groupBy("source", "section").agg(F.coalesce(F.first("heading"), F.lit(default)).alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("span", F.trim("text").alias("t")))), lambda x: x["t"]), " ").alias("text"))
    return body.filter(F.length("text") > shortest)


def merge_boxes(boxes: DataFrame, margin: float = 150.0) -> DataFrame:
    """(page, x0, y0, x1, y1): boxes of a page that lie within the margin of each other, merged until none do."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        left = [list(map(float, r)) for r in pdf[["x0", "y0", "x1", "y1"]].sort_values(["x0", "y0", "x1", "y1"]).itertuples(index=False)]
        done: list[list[float]] = []
        while left:
            box = left.pop(0)
            grown = True
            while grown:
                grown = False
                for other in left + done:
                    if box[0] - margin <= other[2] and other[0] - margin <= box[2] and box[1] - margin <= other[3] and other[1] - margin <= box[3]:
                        (left if other in left else done).remove(other)
                        box = [min(box[0], other[0]), min(box[1], other[1]), max(box[2], other[2]), max(box[3], other[3])]
                        grown = True
                        break
            done.append(box)
        return pd.DataFrame([(key[0], *b) for b in sorted(done)], columns=["page", "x0", "y0", "x1", "y1"])

    return boxes.groupBy("page").applyInPandas(run, "page long, x0 double, y0 double, x1 double, y1 double")


__all__ = ["attach_images", "chunk_documents", "columns_of", "font_sections", "heading_path", "large_images", "lexicon", "lexicon_entries", "line_items", "merge_boxes", "pack_items", "parsed_entries", "section_ids", "unwanted_line", "word_lines"]
