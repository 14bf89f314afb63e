"""Registry form pages: a page's elements as an array, and look-ups over it as columns.

``with_elements`` takes a page apart once, in document order; everything after
is column expressions over that array, so fields of a page cost no shuffle.
An element knows its last descendant, its parent, the cell and row it is in and
the next sibling ``div``. Tags nest as they are written: no tag is closed by another
kind's, and an end tag closes up to its own start tag, or nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

from ..functions.records import form_product
from ..functions.text import bound, strip, text

# Elements without content, the labels of form fields, and the marks round attachments.
VOID = {"area", "base", "basefont", "bgsound", "br", "col", "command", "embed", "frame", "hr", "image", "img", "input", "isindex", "keygen", "link", "menuitem", "meta", "nextid", "param", "source", "spacer", "track", "wbr"}
FIELD_LABELS = {
    "ttb_id": ["TTB ID"],
    "representative_id": ["REP. ID"],
    "plant_registry_basic_permit_brewers_number": ["PLANT REGISTRY", "BASIC PERMIT"],
    "serial_number": ["SERIAL NUMBER"],
    "brand_name": ["BRAND NAME"],
    "fanciful_name": ["FANCIFUL NAME"],
    "applicant_name_address": ["NAME AND ADDRESS OF APPLICANT"],
    "mailing_address": ["MAILING ADDRESS"],
    "formula_id": ["FORMULA"],
    "net_contents": ["NET CONTENTS"],
    "alcohol_content": ["ALCOHOL CONTENT"],
    "wine_appellation": ["WINE APPELLATION"],
    "wine_vintage": ["WINE VINTAGE"],
    "date_of_application": ["DATE OF APPLICATION"],
    "applicant_or_agent_name": ["PRINT NAME OF APPLICANT"],
    "date_issued": ["DATE ISSUED"],
}
HEADINGS = {"qualifications": "QUALIFICATIONS", "class_type_description": "CLASS/TYPE DESCRIPTION", "status_text": "STATUS"}
CHOICES = {"source_of_product": "Source of Product:", "type_of_product": "Type of Product:"}
APPLICATION_TYPE = "Type of Application"
WORDING = r"(?is)APPEARING ON LABELS\.\s*(.*)"
ATTACHMENT, LARGE, FIRST_LABEL = "publicViewAttachment.do", "filetype=l", "AFFIX COMPLETE SET OF LABELS BELOW"
DIMENSIONS = r"(?i)Actual\s+Dimensions:\s*([0-9.]+)\s*inches\s*W\s*X\s*([0-9.]+)\s*inches\s*H"

#: A page's elements; ``name`` is null for text, which is ``shown`` unless it is a comment, a script or a declaration.
ELEMENT = StructType().add("name", "string").add("attrs", MapType(StringType(), StringType())).add("text", "string").add("shown", "boolean")
for _place in ("last", "parent", "cell", "row", "next"):
    ELEMENT.add(_place, "integer")
ELEMENTS = StructType().add("elements", ArrayType(ELEMENT))


class _Builder(HTMLParser):
    """Rows of ``ELEMENTS`` of one page."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.open, self.div = [], [], {}

    def _add(self, name, attrs, body, shown):
        at, parent = len(self.rows), self.open[-1] if self.open else -1
        up = self.rows[parent] if parent >= 0 else {"name": None, "cell": -1, "row": -1}
        cell, row = (parent if up["name"] == tag else up[key] for tag, key in (("td", "cell"), ("tr", "row")))
        self.rows.append({"name": name, "attrs": attrs, "text": body, "shown": shown, "last": at, "parent": parent, "cell": cell, "row": row, "next": -1})
        return at

    def handle_starttag(self, tag, attrs):
        at = self._add(tag, {k: unescape(v or "") for k, v in attrs}, None, True)
        if tag == "div":
            parent = self.rows[at]["parent"]
            if parent in self.div:
                self.rows[self.div[parent]]["next"] = at
            self.div[parent] = at
        if tag not in VOID:
            self.open.append(at)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self._close(self.open.pop())

    def _close(self, at):
        self.rows[at]["last"] = len(self.rows) - 1

    def handle_endtag(self, tag):
        if any(self.rows[i]["name"] == tag for i in self.open):
            while True:
                at = self.open.pop()
                self._close(at)
                if self.rows[at]["name"] == tag:
                    return

    def _text(self, body, shown):
        last = self.rows[-1] if self.rows else None
        body = unescape(body)
        if last and last["name"] is None and shown and last["shown"] and last["parent"] == (self.open[-1] if self.open else -1):
            last["text"] += body
        else:
            self._add(None, None, body, shown)

    def handle_data(self, data):
        self._text(data, not self.open or self.rows[self.open[-1]]["name"] not in ("script", "style", "template"))

    def handle_comment(self, data):
        self._text(data, False)

    handle_decl = unknown_decl = handle_pi = handle_comment


def elements_of(page: str) -> list[dict]:
    builder = _Builder()
    builder.feed(page)
    builder.close()
    while builder.open:
        builder._close(builder.open.pop())
    return builder.rows


#: Pages whose elements are objects of a worker at a time: as many as this many bytes of them, one at least.
PORTION = 1 << 20


def portions(batch: pa.RecordBatch, column: str, most: int = PORTION) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``most`` bytes of a text column; a longer text is a part by itself."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        if i > start and held + n > most:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < batch.num_rows:
        yield batch.slice(start)


def with_elements(pages: DataFrame, html: str) -> DataFrame:
    """``pages`` with ``elements``; a null page has none."""
    schema = StructType([f for f in pages.schema.fields if f.name != "elements"] + ELEMENTS.fields)
    arrow = to_arrow_schema(ELEMENTS).field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in portions(whole, html)):
            found = pa.array([[] if h is None else [r | {"attrs": None if r["attrs"] is None else list(r["attrs"].items())} for r in elements_of(h)] for h in batch.column(html).to_pylist()], arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns, found], [*batch.schema.names, "elements"])

    return pages.drop("elements").mapInArrow(run, schema)


# ---- text of elements


def spaced(c: Column) -> Column:
    """Blanks but line feeds collapsed, ends stripped."""
    return strip(F.regexp_replace(text(c), r"[ \t\r\f\x0B]+", " "))


def kept_lines(c: Column) -> Column:
    """Lines without blank ones, each :func:`spaced`."""
    return F.filter(F.transform(F.split(text(c), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85  ]"), spaced), lambda x: x != "")


def _named(e: Column, name: str) -> Column:
    return F.coalesce(e["name"] == name, F.lit(False))


def attribute(e: Column, name: str) -> Column:
    return text(F.try_element_at(e["attrs"], F.lit(name)))


def has_class(e: Column, part: str) -> Column:
    """A class of the element has ``part`` in its name."""
    return F.exists(F.split(attribute(e, "class"), r"\s+"), lambda c: c.contains(part))


def inner_text(elements: Column, at: Column, between: str) -> Column:
    """The shown text inside the element at ``at``."""
    inside = F.slice(elements, at + 2, F.greatest(elements[at]["last"] - at, F.lit(0)))
    return F.array_join(F.transform(F.filter(inside, lambda e: e["name"].isNull() & e["shown"]), lambda e: e["text"]), between)


def inner_lines(elements: Column, at: Column) -> Column:
    return F.array_join(kept_lines(inner_text(elements, at, "\n")), "\n")


def places(elements: Column, wanted) -> Column:
    """Where the elements are that ``wanted`` holds for."""
    every = F.transform(elements, lambda e, i: F.when(wanted(e), i))
    return F.array_compact(every)


def _data(elements: Column, first: Column, last: Column) -> Column:
    """Distinct texts of data cells between two places, joined."""
    inside = F.filter(F.sequence(first, F.greatest(first, last)), lambda i: _named(elements[i], "div") & has_class(elements[i], "data"))
    return F.array_join(F.array_distinct(F.filter(F.transform(inside, lambda i: inner_lines(elements, i)), lambda v: v != "")), "\n")


def labelled(elements: Column) -> Column:
    """(label, value) of every label: the data beside it in its cell; without a cell the next data, or all of its parent's."""

    def one(i: Column) -> Column:
        e = elements[i]
        after = e["next"]
        beside = (after >= 0) & has_class(elements[F.greatest(after, F.lit(0))], "data")
        around = F.when(e["cell"] >= 0, e["cell"]).otherwise(e["parent"])
        begin, end = F.greatest(around, F.lit(0)), F.when(around >= 0, elements[F.greatest(around, F.lit(0))]["last"]).otherwise(F.size(elements) - 1)
        value = F.when((e["cell"] < 0) & beside, inner_lines(elements, F.greatest(after, F.lit(0)))).otherwise(_data(elements, begin, end))
        return F.struct(F.lower(spaced(inner_text(elements, i, " "))).alias("label"), value.alias("value"))

    return F.transform(places(elements, lambda e: _named(e, "div") & (has_class(e, "label"))), one)


def headed(elements: Column) -> Column:
    """(label, value) of every bold label that data follows."""
    bold = places(elements, lambda e: _named(e, "div") & has_class(e, "boldlabel"))
    followed = F.filter(bold, lambda i: (elements[i]["next"] >= 0) & has_class(elements[F.greatest(elements[i]["next"], F.lit(0))], "data"))
    return F.transform(followed, lambda i: F.struct(F.lower(spaced(inner_text(elements, i, " "))).alias("label"), inner_lines(elements, elements[i]["next"]).alias("value")))


def checked(elements: Column) -> Column:
    """(alt, row) of every checked box: its alternative text, and the text of its row (null without one)."""
    boxes = places(elements, lambda e: _named(e, "input") & F.map_contains_key(e["attrs"], "checked"))
    row = lambda i: F.when(elements[i]["row"] >= 0, spaced(inner_text(elements, F.greatest(elements[i]["row"], F.lit(0)), " ")))
    return F.transform(boxes, lambda i: F.struct(spaced(attribute(elements[i], "alt")).alias("alt"), row(i).alias("row")))


def first_value(pairs: Column, *needles: str) -> Column:
    """The value of the first label with one of ``needles`` in it, else empty."""

    def wanted(p: Column) -> Column:
        hits = [p["label"].contains(n.lower()) for n in needles]
        return hits[0] if len(hits) == 1 else hits[0] | hits[1]

    return text(F.try_element_at(F.filter(pairs, wanted), F.lit(1))["value"])


def chosen(boxes: Column, prefix: str) -> Column:
    """What follows the colon of the first checked box whose text begins with ``prefix``."""
    alt = text(F.try_element_at(F.filter(boxes, lambda b: F.lower(b["alt"]).startswith(prefix.lower())), F.lit(1))["alt"])
    return spaced(F.regexp_replace(alt, "^[^:]*:", ""))


def chosen_row(boxes: Column, needle: str) -> Column:
    return text(F.try_element_at(F.filter(boxes, lambda b: F.lower(b["alt"]).contains(needle.lower()) & b["row"].isNotNull()), F.lit(1))["row"])


def wording(elements: Column) -> Column:
    """The wording that appears on labels: what follows the question in the first data cell that asks it."""
    cells = F.transform(places(elements, lambda e: _named(e, "div") & has_class(e, "data")), lambda i: inner_lines(elements, i))
    asked = text(F.try_element_at(F.filter(cells, lambda v: F.upper(v).contains("SHOW ANY WORDING") | F.upper(v).contains("SHOW ANY INFORMATION")), F.lit(1)))
    return F.when(asked.rlike(WORDING), F.array_join(kept_lines(F.regexp_extract(asked, WORDING, 1)), "\n")).otherwise(asked)


def status(c: Column) -> Column:
    named = F.regexp_extract(c, r"(?i)STATUS\s+IS\s+([A-Z ]+)\.", 1)
    return F.lower(spaced(F.when(named != "", named).otherwise(c)))


def resolved(base: Column, link: Column) -> Column:
    """A link as an absolute address, ``base`` being the page's."""
    root = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(F.regexp_replace(F.substring(base, F.length(root) + 1, 1 << 30), "[?#].*", ""), "^(.*/)", 1), F.lit("")), F.lit("/")))
    page = F.regexp_replace(base, "[?#].*$", "")
    return (
        F.when(link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:"), link).when(link.startswith("//"), F.concat(F.regexp_extract(base, "^([^:]*:)", 1), link)).when(link.startswith("/"), F.concat(root, link))
        .when(link == "", base).when(link.startswith("?"), F.concat(page, link)).when(link.startswith("#"), F.concat(F.regexp_replace(base, "#.*$", ""), link)).otherwise(F.concat(folder, link))
    )


def context_lines(elements: Column, at: Column, stop_tag: str, stop_text: str | None = None) -> Column:
    """Lines of the text before an element, back to the last ``stop_tag`` or to the text with ``stop_text``, which is the first of them."""

    def stop(e: Column, i: Column) -> Column:
        out = F.when(_named(e, stop_tag), i + 1)
        return out if stop_text is None else out.when(e["name"].isNull() & F.contains(e["text"], F.lit(stop_text)), i)

    before = F.slice(elements, 1, at)
    start = F.coalesce(F.array_max(F.transform(before, stop)), F.lit(0))
    pieces = bound(start, lambda s: F.filter(F.slice(elements, s + 1, at - s), lambda e: e["name"].isNull()))
    return F.flatten(F.transform(pieces, lambda e: kept_lines(e["text"])))


def _image_type(lines: Column) -> Column:
    """What the line ``image type`` says after its colon, else the next line but for dimensions."""
    at = F.array_position(F.transform(lines, lambda x: F.lower(x).startswith("image type")), True)
    said = F.try_element_at(lines, F.greatest(at, F.lit(1)).cast("int"))
    value = F.when(said.contains(":"), spaced(F.regexp_replace(said, "^[^:]*:", ""))).otherwise("")
    after = text(F.try_element_at(lines, (at + 1).cast("int")))
    return F.when(at == 0, "").when(value != "", value).when(F.lower(after).startswith("actual dimensions"), "").otherwise(after)


def attachments(elements: Column, address: Column) -> Column:
    """The label images of a form in their order, with name, type and size as the lines above them say."""
    images = places(elements, lambda e: _named(e, "img") & attribute(e, "src").contains(ATTACHMENT) & attribute(e, "src").contains(LARGE))

    def one(i: Column, n: Column) -> Column:
        return bound(context_lines(elements, i, "img", FIRST_LABEL), lambda said: described(elements[i], n, said))

    def described(e: Column, n: Column, said: Column) -> Column:
        src, size = attribute(e, "src"), F.array_join(said, "\n")
        width, height = (F.nullif(F.regexp_extract(size, DIMENSIONS, k), F.lit("")).try_cast("double") for k in (1, 2))
        raw = F.regexp_extract(src, r"[?&]filename=([^&#]*)", 1)
        return F.struct(
            (n + 1).alias("panel_order"), text(F.try_url_decode(F.regexp_replace(raw, "%(?![0-9A-Fa-f]{2})", "%25"))).alias("filename"), resolved(address, src).alias("source_url"), _image_type(said).alias("image_type"),
            width.alias("width_inches"), height.alias("height_inches"), spaced(attribute(e, "alt")).alias("alt_text"),
            F.try_element_at(e["attrs"], F.lit("width")).alias("html_width"), F.try_element_at(e["attrs"], F.lit("height")).alias("html_height"),
        )

    return F.transform(images, one)


def form_fields(pages: DataFrame, html: str, address: str) -> DataFrame:
    """``pages`` with a typed column for each field of the form, and ``attachments``.

    Labels, headings, checked boxes and attachments are each taken from the elements once.
    """
    e = F.col("elements")
    parts = with_elements(pages, html).withColumns({"_labels": labelled(e), "_headings": headed(e), "_boxes": checked(e), "special_wording": wording(e), "attachments": attachments(e, text(F.col(address)))})
    fields = {name: first_value(F.col("_labels"), *needles) for name, needles in FIELD_LABELS.items()}
    fields |= {name: first_value(F.col("_headings"), needle) for name, needle in HEADINGS.items()}
    fields |= {name: chosen(F.col("_boxes"), prefix) for name, prefix in CHOICES.items()}
    out = parts.withColumns(fields | {"type_of_application": chosen_row(F.col("_boxes"), APPLICATION_TYPE)})
    return out.withColumn("status", status(F.col("status_text"))).drop("elements", "_labels", "_headings", "_boxes", "status_text")


def applications(forms: DataFrame) -> DataFrame:
    """A column ``application`` of the record that a form makes."""
    first = F.try_element_at(F.col("attachments"), F.lit(1))["filename"]
    return forms.withColumn("application", F.struct(
        F.col("ttb_id").alias("fixture_id"), F.coalesce(F.nullif(first, F.lit("")), F.concat("ttb_id", F.lit(".jpg"))).alias("filename"), form_product(F.col("type_of_product")).alias("product_type"),
        "brand_name", "fanciful_name", F.col("class_type_description").alias("class_type"), "alcohol_content", "net_contents", F.lit(None).cast("string").alias("country_of_origin"),
        (F.lower("source_of_product") == "imported").alias("imported"), "formula_id", F.col("special_wording").alias("statement_of_composition"),
    ))


def links(pages: DataFrame, key: str, html: str, address: str) -> DataFrame:
    """A row for each link with an address: its place, where it leads, what it says, and the last line of text before it."""
    e = F.col("elements")
    found = places(e, lambda x: _named(x, "a") & F.map_contains_key(x["attrs"], "href"))
    each = F.transform(found, lambda i, n: F.struct((n + 1).alias("place"), attribute(e[i], "href").alias("href"), spaced(inner_text(e, i, " ")).alias("says"), F.try_element_at(context_lines(e, i, "a"), F.lit(-1)).alias("before")))
    rows = with_elements(pages.select(key, html, address), html).select(key, address, F.explode(each).alias("l"))
    return rows.select(key, "l.place", "l.href", resolved(F.col(address), F.col("l.href")).alias("leads_to"), "l.says", "l.before")
