"""Pages prepared as texts with TeX, and what was found in them. Small per-page parsing inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from html import escape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .documents import sliced

#: Elements without text of their own, the encoding of TeX annotations, what stands for an undescribed image.
DROPPED, TEX, UNDESCRIBED = {"script", "style", "nav", "footer"}, "application/x-tex", "not transcribed"
FOUND = "kind string, element_id string, status string, text string, target string, level int"


class Prepared(HTMLParser):
    """Pieces of a page's text in order and what was found on the way.

    The page is read once. A formula, a link's label or a heading's text is open until its end tag; what is still
    open at the end of the page ends there.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.found: list[dict] = []
        self.dropped = 0
        self.link: tuple[dict, list[str]] | None = None
        self.heading: tuple[dict, list[str]] | None = None
        self.formula: dict | None = None
        self.ranges: dict[str, list[int]] = {}  # first article and body: where their pieces begin and end
        self.inside = 0  # articles open in the first one

    def note(self, kind: str, attrs: dict, **more) -> dict:
        row = {"kind": kind, "element_id": attrs.get("id"), "status": None, "text": None, "target": None, "level": None} | more
        self.found.append(row)
        return row

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in ("img", "br", "hr", "meta", "input"):
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        given = {k: v or "" for k, v in attrs}
        if self.formula is not None:
            self.formula["markup"].append(self.get_starttag_text())
            if tag == "annotation" and given.get("encoding") == TEX and self.formula["tex"] is None:
                self.formula["tex"], self.formula["reading"] = [], True
        elif tag in DROPPED:
            self.dropped += 1
        elif self.dropped:
            return
        elif tag == "math":
            row = self.note("html_equation", given)
            self.formula = {"row": row, "markup": [self.get_starttag_text()], "tex": None, "reading": False, "alt": given.get("alttext")}
        elif tag in ("article", "body"):
            if tag not in self.ranges:
                self.ranges[tag] = [len(self.pieces)]
            self.inside += tag == "article" and len(self.ranges[tag]) == 1
        elif len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            self.close_heading()
            self.heading = (self.note("html_heading", given, level=int(tag[1])), [])
            self.put("\n" + "#" * int(tag[1]) + " ", marks=True)
        elif tag == "a" and "href" in given:
            self.close_link()
            self.link = (self.note("html_reference", given, target=given["href"]), [])
        elif tag == "img" and self.link is None:
            self.note("html_image", given, status="unresolved", text=given.get("alt", ""), target=given.get("src", ""))
            self.put(f"[Image: {given.get('alt', UNDESCRIBED)}]", marks=True)

    def handle_endtag(self, tag):
        if self.formula is not None:
            self.formula["markup"].append(f"</{tag}>")
            self.formula["reading"] &= tag != "annotation"
            if tag == "math":
                self.close_formula()
        elif tag in DROPPED:
            self.dropped = max(0, self.dropped - 1)
        elif self.dropped:
            return
        elif tag == "article" and len(self.ranges.get(tag, ())) == 1:
            self.inside -= 1
            if not self.inside:
                self.close_link(), self.ranges[tag].append(len(self.pieces))
        elif tag == "body" and len(self.ranges.get(tag, ())) == 1:
            self.close_link(), self.ranges[tag].append(len(self.pieces))
        elif tag == "a":
            self.close_link()
        elif self.heading is not None and tag == f"h{self.heading[0]['level']}":
            self.close_heading()

    def handle_data(self, data):
        if self.formula is not None:
            self.formula["markup"].append(escape(data, quote=False))
            if self.formula["reading"]:
                self.formula["tex"].append(data)
        elif not self.dropped:
            self.put(data)

    def put(self, text: str, marks: bool = False):
        """A piece of text; marks stand in the page's text but in no heading's own text."""
        if self.heading is not None and not marks:
            self.heading[1].append(text)
        (self.link[1] if self.link is not None else self.pieces).append(text)

    def close_formula(self):
        f, self.formula = self.formula, None
        if f is not None:
            tex = "".join(f["tex"]) if f["tex"] is not None else f["alt"]
            whole = "".join(f["markup"])
            f["row"] |= {"text": tex or whole, "status": "decoded" if tex else "unresolved"}
            self.put(f"\n\\[{tex}\\]\n" if tex else f"\n{whole}\n")

    def close_link(self):
        link, self.link = self.link, None
        if link is not None:
            link[0]["text"] = joined(link[1])
            self.pieces.append(f"[{link[0]['text']}]({link[0]['target']})")

    def close_heading(self):
        heading, self.heading = self.heading, None
        if heading is not None:
            heading[0]["text"] = joined(heading[1])

    def text(self) -> str:
        """The pieces of the first article, else of the body, else all, a line each."""
        self.close_formula(), self.close_link(), self.close_heading()
        for tag in ("article", "body"):
            if tag in self.ranges:
                return "\n".join(self.pieces[slice(*[*self.ranges[tag], len(self.pieces)][:2])])
        return "\n".join(self.pieces)


def joined(pieces: list[str]) -> str:
    return " ".join(p.strip() for p in pieces if p.strip())


def parse(html: str | None) -> tuple[str, list[dict]]:
    """A page's text and what was found in it; a null page has neither."""
    page = Prepared()
    page.feed(html or "")
    page.close()
    return page.text(), page.found


def prepared(pages: DataFrame) -> DataFrame:
    """page_id, text and found (equations, headings, references and images in order) of each page (page_id, html).

    Scripts, styles, navigation and footers go; a formula becomes its TeX (annotation or alternative text) between
    display marks, or stays as markup if it has none; headings get #, links [label](target), images a placeholder.
    """

    kinds = {"string": pa.string(), "int": pa.int32()}
    found_type = pa.list_(pa.struct([(name, kinds[kind]) for name, kind in map(str.split, FOUND.split(", "))]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            parsed = [parse(h) for h in b.column("html").to_pylist()]
            columns = [b.column("page_id"), pa.array([t for t, _ in parsed], pa.string()), pa.array([found for _, found in parsed], found_type)]
            yield pa.RecordBatch.from_arrays(columns, names=["page_id", "text", "found"])

    return pages.select(F.col("page_id").cast("long"), "html").mapInArrow(run, f"page_id long, text string, found array<struct<{FOUND.replace(' ', ':').replace(',:', ', ')}>>")
