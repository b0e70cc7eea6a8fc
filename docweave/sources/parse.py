"""Documents to rows: HTML pages and markdown."""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEADINGS = {f"h{k}": k for k in range(1, 7)}
BLOCKS = {"p": "paragraph", "li": "item", "td": "cell", "blockquote": "quote", **{h: "heading" for h in HEADINGS}}
SKIPPED = {"script", "style", "nav", "header", "footer", "aside", "form", "noscript"}
VOID = {"br", "hr", "img", "input", "link", "meta", "area", "base", "col", "embed", "source", "track", "wbr"}


class _Blocks(HTMLParser):
    """Text blocks of a page in order, with the level of headings; what lies in navigation, scripts and advertisements is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[list] = []
        self.stack: list[tuple[str, bool]] = []
        self.title, self.open = "", None

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            if tag == "br" and self.open is not None:
                self.open[2] += "\n"
            return
        skipped = tag in SKIPPED or "ad" in (dict(attrs).get("class") or "").split()
        self.stack.append((tag, skipped or bool(self.stack and self.stack[-1][1])))
        if tag in BLOCKS and not self.stack[-1][1]:
            self.open = [BLOCKS[tag], HEADINGS.get(tag, 0), ""]
            self.rows.append(self.open)

    def handle_endtag(self, tag):
        for k in range(len(self.stack) - 1, -1, -1):
            if self.stack[k][0] == tag:
                del self.stack[k:]
                break
        if tag in BLOCKS:
            self.open = None

    def handle_data(self, data):
        if self.stack and self.stack[-1][0] == "title":
            self.title += data
        elif self.open is not None and not (self.stack and self.stack[-1][1]):
            self.open[2] += data


def html_blocks(html: str) -> list[tuple[str, int, str, int]]:
    """kind, level, text and place of the heading above (-1: none) of each block that has text."""
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    out, above = [], []
    for kind, level, text in ([["title", 0, parser.title]] if parser.title.strip() else []) + parser.rows:
        text = " ".join(text.split())
        if not text:
            continue
        if kind == "heading":
            while above and above[-1][0] >= level:
                above.pop()
        out.append((kind, level, text, above[-1][1] if above else -1))
        if kind == "heading":
            above.append((level, len(out) - 1))
    return out


def parse_pages(pages: DataFrame) -> DataFrame:
    """page_id, seq, kind, level, parent_seq, text of pages (page_id, html); a null page has no rows."""

    def run(batches):
        for b in batches:
            rows = [(i, k, *block) for i, html in zip(b.column("page_id").to_pylist(), b.column("html").to_pylist()) if html for k, block in enumerate(html_blocks(html))]
            ids, seq, kind, level, text, parent = zip(*rows) if rows else ([],) * 6
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(seq, pa.int32()), pa.array(kind, pa.string()), pa.array(level, pa.int32()), pa.array(parent, pa.int32()), pa.array(text, pa.string())], names=["page_id", "seq", "kind", "level", "parent_seq", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInArrow(run, "page_id long, seq int, kind string, level int, parent_seq int, text string")


def markdown_sections(documents: DataFrame) -> DataFrame:
    """id, section, level, title, body, parent of markdown (id, text): headings open sections; a parent is the last heading of a smaller level. Text before the first is section 0."""
    lines = documents.select("id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    heading = F.regexp_extract("line", r"^(#{1,6}) +\S", 1)
    lines = lines.withColumn("level", F.length(heading))
    w = Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.count_if(F.col("level") > 0).over(w).cast("int"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.struct("at", "line")))), lambda x: x["line"]), "\n")
    made = lines.groupBy("id", "section").agg(F.max("level").alias("level"), F.max(F.when(F.col("level") > 0, F.trim(F.regexp_replace("line", "^#+ +", "")))).alias("title"), F.trim(body).alias("body"))
    before = Window.partitionBy("id").orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.collect_list(F.when(F.col("level") > 0, F.struct("section", "level"))).over(before)
    above = F.filter(seen, lambda x: x["level"] < F.col("level"))
    return made.withColumn("parent", F.when((F.col("level") > 0) & (F.size(above) > 0), F.element_at(above, -1)["section"])).filter((F.col("section") > 0) | (F.col("body") != ""))
