"""Reading and writing: CSV laws, HTML pages, DOCX, JSON rows, uploads, directories, vector index."""

from __future__ import annotations

import html as entities
import io
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from ..session import spread

# Headers of the two known layouts of law tables.
LAYOUTS = {
    "code": {"part": "Qism", "section": "Bo'lim", "chapter_number": "Bob raqami", "chapter_title": "Bob nomi", "article_number": "Modda raqami", "article_title": "Modda nomi", "body": "Modda matni"},
    "constitution": {"section": "bolim", "chapter_number": "bob_raqami", "chapter_title": "bob_nomi", "article_number": "modda_raqami", "body": "matn"},
}


def layout_of(names: list[str]) -> dict[str, str] | None:
    """The layout whose number and body columns are there."""
    names = [n.strip().lstrip("﻿") for n in names]
    return next((m for m in LAYOUTS.values() if {m["article_number"], m["body"]} <= set(names)), None)


def read_law_csv(spark: SparkSession, path: str, columns: dict[str, str] | None = None) -> DataFrame:
    """The rows of a law table with the columns part, section, chapter_number, chapter_title, article_number, article_title, body.

    Headers name the layout unless ``columns`` does; a byte order mark is dropped; columns that a
    layout lacks are null.
    """
    rows = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    clean = [n.strip().lstrip("﻿") for n in rows.columns]
    rows = rows.toDF(*clean)
    layout = columns or layout_of(clean)
    if layout is None:
        raise ValueError(f"no known layout has the columns {clean}")
    every = ("part", "section", "chapter_number", "chapter_title", "article_number", "article_title", "body")
    return rows.select(*[(F.col(f"`{layout[c]}`") if c in layout else F.lit(None).cast("string")).alias(c) for c in every])


def law_articles(rows: DataFrame, order: str) -> DataFrame:
    """Consecutive rows of one article as one: article_number, body, first (the place of its first row).

    ``order`` is a column of row numbers; bodies join by a newline.
    """
    w = Window.orderBy(order)  # one file
    new = F.when(F.col("article_number") == F.lag("article_number").over(w), 0).otherwise(1)
    rows = rows.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "body"))), lambda x: x["body"]), "\n")
    return rows.groupBy("_run").agg(F.first("article_number").alias("article_number"), body.alias("body"), F.min(order).alias("first")).drop("_run")


# Page furniture, in tags, classes, ids and phrases.
DROP_TAGS = {"script", "style", "noscript", "nav", "header", "footer", "form", "svg"}
DROP_NAMES = {"breadcrumb", "navbar", "sidebar", "menu", "pagination", "no-print", "doc-tools", "share", "docNavbar", "docBody__sidebar", "COMMENT", "COMMENTLEXUZ", "CHANGES_ORIGINS", "INDEXES_ON_REF", "lx_no_select", "lx_date_link"}
DROP_IDS = {"header", "footer", "dvToc", "docBody__sidebar"}
CONTENT_NAMES = ["#divCont", "#divBody", "#mD", "#main_container1", ".docBody__container", "#doc_content", ".document-body", ".doc-text", "#content_text", ".act-content", "article", "main", ".content"]
CHROME_PHRASES = ("hujjatga taklif yuborish", "audioni tinglash", "hujjat elementidan havola olish", "предложить изменение", "прослушать аудио", "получить ссылку на элемент")
HEADING_LINE = re.compile(
    r"^\s*(\d+(?:-\d+)?\s*[-–]?\s*(?:modda|модда)|(?:modda|модда)\s*\d+|стать[яеий]\s*\d+|article\s+\d+|[IVXLC\d]+\s*[-–.]?\s*(?:bob|боб)|(?:глава|chapter|раздел)\s+[IVXLC\d]+"
    r"|[IVXLC]+\s*[-–]?\s*(?:bo[’'ʻ‘]?lim|бўлим)|[А-ЯA-ZЎҚҒҲ\s]{6,}(?:QISM|ҚИСМ)|(?:ОБЩАЯ|ОСОБЕННАЯ)\s+ЧАСТЬ)",
    re.IGNORECASE,
)
VOID = {"br", "img", "hr", "input", "meta", "link", "source", "wbr", "col", "area", "base", "embed", "param", "track"}
BLOCK = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "li", "td", "pre"}
INNER_BLOCK = BLOCK - {"td", "pre", "h5", "h6"}
_CELLS = (("td", "th"), ("tr", "table"))
_ENDS_P = (("p",), ("div", "td", "th", "li", "table", "article", "section", "body"))
#: What a start tag closes first, and what keeps it from doing so: HTML leaves these end tags out.
IMPLIED_ENDS = {
    **{t: (_ENDS_P,) for t in ("p", "div", "ul", "ol", "table", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "section", "article", "blockquote", "hr")},
    "li": (_ENDS_P, (("li",), ("ul", "ol"))),
    "td": (_ENDS_P, _CELLS),
    "th": (_ENDS_P, _CELLS),
    "tr": (_ENDS_P, _CELLS, (("tr",), ("table",))),
}


class _Node:
    __slots__ = ("tag", "attrs", "children", "parent", "holds_blocks")

    def __init__(self, tag, attrs, parent):
        self.tag, self.attrs, self.children, self.parent, self.holds_blocks = tag, attrs, [], parent, False

    def walk(self):
        """Nodes and strings below, in the order of the page, however deep."""
        waiting = self.children[::-1]
        while waiting:
            c = waiting.pop()
            yield c
            if isinstance(c, _Node):
                waiting += c.children[::-1]

    def text(self) -> str:
        return " ".join("\n" if isinstance(c, _Node) and c.tag == "br" else c for c in self.walk() if isinstance(c, str) or c.tag == "br")

    def named(self, selector: str) -> bool:
        if selector[0] == "#":
            return self.attrs.get("id") == selector[1:]
        if selector[0] == ".":
            return selector[1:] in (self.attrs.get("class") or "").split()
        return self.tag == selector


class _Tree(HTMLParser):
    """A forgiving tree of a page without its furniture."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        for closed, within in IMPLIED_ENDS.get(tag, ()):
            self._end(closed, within)
        node = _Node(tag, dict(attrs), self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def _end(self, tags, within=()):
        """Close the innermost open element of ``tags``, unless one of ``within`` stands between."""
        node = self.at
        while node.parent is not None and node.tag not in tags and node.tag not in within:
            node = node.parent
        if node.parent is not None and node.tag in tags:
            self.at = node.parent

    def handle_endtag(self, tag):
        self._end((tag,))

    def handle_data(self, data):
        self.at.children.append(data)


def _furniture(n: _Node) -> bool:
    return n.tag in DROP_TAGS or n.attrs.get("id") in DROP_IDS or bool(DROP_NAMES & set((n.attrs.get("class") or "").split()))


def _clean(root: _Node) -> None:
    """Drop the furniture below and note which nodes hold blocks."""
    nodes, waiting = [], [root]
    while waiting:
        node = waiting.pop()
        node.children = [c for c in node.children if isinstance(c, str) or not _furniture(c)]
        inner = [c for c in node.children if isinstance(c, _Node)]
        nodes += inner
        waiting += inner
    for node in reversed(nodes):
        if node.holds_blocks or node.tag in INNER_BLOCK:
            node.parent.holds_blocks = True


def _norm(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub("[ʻʼ’'`´]", "‘", text)).strip()


def html_blocks(markup: str | None) -> list[dict]:
    """Blocks (text, role, level) of a page in order: headings, body, table cells; no furniture, no repeats in a row."""
    tree = _Tree()
    tree.feed(markup or "")
    nodes = [n for n in tree.root.walk() if isinstance(n, _Node)]
    _clean(tree.root)
    root = next((n for s in CONTENT_NAMES for n in nodes if n.named(s) and len(_norm(n.text())) > 200), None)
    root = root or next((n for n in nodes if n.tag == "body"), tree.root)
    out: list[dict] = []
    for n in root.walk():
        if not isinstance(n, _Node) or n.tag not in BLOCK:
            continue
        if n.tag == "div" and n.holds_blocks:
            continue
        text = n.text()
        for phrase in CHROME_PHRASES:
            text = re.sub(re.escape(phrase), "", text, flags=re.IGNORECASE)
        text = _norm(text)
        if len(re.sub(r"[\s|/·—–-]+", "", text)) < 2 or out and out[-1]["text"] == text:
            continue
        if n.tag[0] == "h" and n.tag[1:].isdigit():
            role, level = "heading", int(n.tag[1])
        elif HEADING_LINE.match(text) and len(text) < 400:
            role, level = "heading", 4
        else:
            role, level = "table" if n.tag == "td" else "body", 0
        out.append({"text": text, "role": role, "level": level})
    return out


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes) -> list[dict]:
    """Blocks of a DOCX file: outline styles, else short bold or heading-like paragraphs are headings; table rows join cells by a bar."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    out: list[dict] = []
    text_of = lambda e: _norm("".join(t.text or "" for t in e.iter(f"{_W}t")))
    for e in body if body is not None else ():
        if e.tag == f"{_W}p" and (text := text_of(e)):
            style = e.find(f"{_W}pPr/{_W}pStyle")
            name = style.get(f"{_W}val", "") if style is not None else ""
            runs = [r for r in e.iter(f"{_W}r") if text_of(r)]
            bold = bool(runs) and all(r.find(f"{_W}rPr/{_W}b") is not None for r in runs)
            level = int(m[1]) if (m := re.match(r"(?i)heading\s*(\d)", name)) else 4 if bold and len(text) < 250 or HEADING_LINE.match(text) and len(text) < 400 else 0
            out.append({"text": text, "role": "heading" if level else "body", "level": level})
        elif e.tag == f"{_W}tbl":
            for row in e.iter(f"{_W}tr"):
                if text := " | ".join(t for c in row.iter(f"{_W}tc") if (t := text_of(c))):
                    out.append({"text": text, "role": "table", "level": 0})
    return out


def text_blocks(text: str) -> list[dict]:
    lines = [_norm(x) for x in text.splitlines()]
    return [{"text": x, "role": "heading" if HEADING_LINE.match(x) and len(x) < 400 else "body", "level": 4 if HEADING_LINE.match(x) and len(x) < 400 else 0} for x in lines if x]


# What can be parsed, by MIME type and extension.
FORMATS = {"text/html": "html", "application/xhtml+xml": "html", "text/plain": "text", "application/vnd.openxmlformats-officedocument.wordprocessingml.document": "docx", "application/pdf": "pdf"}
EXTENSIONS = {"html": "html", "htm": "html", "txt": "text", "docx": "docx", "pdf": "pdf"}


def format_of(mime, name):
    """html, text, docx or pdf by MIME type, else by extension; null if neither is known."""
    by_mime = F.coalesce(*[F.when(F.lower(F.trim(F.get(F.split(mime, ";"), F.lit(0)))) == k, F.lit(v)) for k, v in FORMATS.items()])
    extension = F.lower(F.regexp_extract(name, "\\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(by_mime, *[F.when(extension == k, F.lit(v)) for k, v in EXTENSIONS.items()])


BLOCKS = "array<struct<text string, role string, level int>>"


def parse_documents(files: DataFrame) -> DataFrame:
    """doc_id, format, block_ix, text, role, level; one row with an error for a document that can't be parsed.

    files: doc_id, content (binary), mime, name.
    """

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = []
            for r in batch.itertuples():
                try:
                    data = bytes(r.content or b"")
                    if r.format == "docx":
                        blocks = docx_blocks(data)
                    elif r.format == "html":
                        blocks = html_blocks(data.decode("utf-8", "replace"))
                    elif r.format == "text":
                        blocks = text_blocks(data.decode("utf-8", "replace"))
                    else:
                        raise ValueError(f"unsupported format: {r.format or r.name}")
                    out += [(r.doc_id, r.format, i, b["text"], b["role"], b["level"], None) for i, b in enumerate(blocks)]
                except Exception as e:  # a broken file is a row, not a failed job
                    out.append((r.doc_id, r.format, None, None, None, None, str(e)[:500]))
            frame = pd.DataFrame(out, columns=["doc_id", "format", "block_ix", "text", "role", "level", "error"])
            yield frame.astype({"block_ix": "Int32", "level": "Int32"})

    rows = files.select("doc_id", "content", "name", format_of(F.col("mime"), F.col("name")).alias("format"))
    return rows.mapInPandas(run, "doc_id long, format string, block_ix int, text string, role string, level int, error string")


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, block_ix, text, role, level of HTML pages (page_id, html)."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            out = [(p, i, b["text"], b["role"], b["level"]) for p, h in zip(batch["page_id"], batch["html"]) for i, b in enumerate(html_blocks(h))]
            yield pd.DataFrame(out, columns=["page_id", "block_ix", "text", "role", "level"])

    return spread(pages.select("page_id", "html")).mapInPandas(run, "page_id long, block_ix int, text string, role string, level int")


def page_texts(pages: DataFrame) -> DataFrame:
    """page_id, texts: the block texts of HTML pages (page_id, html), a row for each page."""

    def run(batches):
        for batch in batches:
            yield batch[["page_id"]].assign(texts=[[b["text"] for b in html_blocks(h)] for h in batch["html"]])

    return spread(pages.select("page_id", "html")).mapInPandas(run, "page_id long, texts array<string>")


def checked_uploads(files: DataFrame, most_bytes: int = 25 * 1024 * 1024, least_chars: int = 100) -> DataFrame:
    """files with ``status``: ok, unsupported, too_large, empty or too_short.

    files: name, mime, size, chars (of the text got out).
    """
    status = F.when(format_of(F.col("mime"), F.col("name")).isNull(), "unsupported").when(F.col("size") > most_bytes, "too_large").when(F.col("size") == 0, "empty").when(F.col("chars") < least_chars, "too_short")
    return files.withColumn("status", F.coalesce(status, F.lit("ok")))


def read_api_rows(spark: SparkSession, path: str, most: int = 10_000) -> DataFrame:
    """Rows (row, as JSON text) of API answers, under result.data, else result, else the whole; no list, no rows."""
    rows = spark.read.option("wholetext", True).text(path)
    lists = [F.from_json(F.get_json_object("value", p), "array<string>") for p in ("$.result.data", "$.result", "$")]
    return rows.select(F.explode(F.coalesce(*lists)).alias("row")).limit(most)


def rows_as_html(rows: DataFrame, columns: list[str]) -> DataFrame:
    """An escaped HTML table row (tr) of each row."""
    cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.replace(F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</td>"))
    return rows.select(F.concat(F.lit("<tr>"), *[cell(c) for c in columns], F.lit("</tr>")).alias("html"))


def unescaped(text: str) -> str:
    return entities.unescape(text)


def with_known_files(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (path) with what is known of each file name, and the rest to be detected."""
    name = F.element_at(F.split("path", "/"), -1)
    return files.withColumn("file_name", name).join(F.broadcast(known), "file_name", "left").withColumn("detected", F.col("act_id").isNull())


def write_vector_index(vectors: DataFrame, path: str, buckets: int = 16) -> None:
    """chunk_id and unit vectors as Parquet, one folder for each hash bucket."""
    from ..operators.dense import l2_normalised

    rows = vectors.where("embedding IS NOT NULL").select("chunk_id", l2_normalised(F.col("embedding")).alias("embedding"))
    rows.withColumn("bucket", F.pmod(F.xxhash64("chunk_id"), F.lit(buckets))).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
