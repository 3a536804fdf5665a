"""Loaders: bytes or texts of many formats to plain text, as columns and table functions."""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
import zipfile
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mnemoframe.functions import text as text_functions

# fixed values: rules of page extraction as (element, attribute test, attribute to read, all matches, joined by), in order
HTML_RULES = [
    ("title", None, None, False, " "),
    ("meta", ("name", "description"), "content", False, " "),
    ("meta", ("name", "keywords"), "content", False, " "),
    ("meta", ("property", "og:title"), "content", False, " "),
    ("meta", ("property", "og:description"), "content", False, " "),
    ("article", None, None, True, "\n\n"),
    ("main", None, None, True, "\n\n"),
    *((f"h{i}", None, None, True, "\n") for i in range(1, 7)),
    ("p", None, None, True, "\n\n"),
    ("blockquote", None, None, True, "\n\n"),
    ("pre", None, None, True, "\n\n"),
    ("ol", None, None, True, "\n"),
    ("ul", None, None, True, "\n"),
    ("li", None, None, True, "\n"),
    ("dl", None, None, True, "\n"),
    ("table", None, None, True, "\n\n"),
    ("caption", None, None, True, "\n"),
    ("code", None, None, True, "\n"),
    ("figure", None, None, True, "\n\n"),
    ("figcaption", None, None, True, "\n"),
    ("img", None, "alt", True, " "),
    ("a", None, None, True, " "),
    ("strong", None, None, True, " "),
    ("em", None, None, True, " "),
    ("mark", None, None, True, " "),
    ("time", None, None, True, " "),
    ("data", None, None, True, " "),
    ("section", None, None, True, "\n\n"),
    ("aside", None, None, True, "\n\n"),
    ("details", None, None, True, "\n"),
    ("summary", None, None, True, "\n"),
    ("nav", None, None, True, "\n"),
    ("footer", None, None, True, "\n"),
    ("div", (("role", "main"), ("role", "article"), ("class", "content"), ("id", "content")), None, True, "\n\n"),
]
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_HIDDEN = frozenset(("script", "style", "noscript"))


class _Page(HTMLParser):
    """Elements of a page in document order, with their attributes and text nodes."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.elements: list[tuple[str, dict, list[str]]] = []
        self.open: list[int] = []
        self.hidden = 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.hidden += tag in _HIDDEN
        if not self.hidden:
            self.elements.append((tag, dict(attrs), []))
            if tag not in _VOID:
                self.open.append(len(self.elements) - 1)

    def handle_endtag(self, tag: str) -> None:
        if tag in _HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        for i in range(len(self.open) - 1, -1, -1):
            if self.elements[self.open[i]][0] == tag:
                del self.open[i:]
                break

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            for i in self.open:
                self.elements[i][2].append(data)


def extract_html(page: str, rules: list[tuple] = HTML_RULES) -> str:
    """Text of a page by the extraction rules; a text without any tag comes back trimmed."""
    page = page.removeprefix("﻿")
    parser = _Page()
    parser.feed(page)
    parser.close()
    pieces = []
    for tag, test, attribute, every, joint in rules:
        tests = () if test is None else test if isinstance(test[0], tuple) else (test,)
        found = [e for e in parser.elements if e[0] == tag and (not tests or any(v in (e[1].get(k) or "").split() if k == "class" else e[1].get(k) == v for k, v in tests))]
        texts = [(e[1].get(attribute) or "" if attribute else " ".join(e[2])).strip() for e in (found if every else found[:1])]
        piece = joint.join(t for t in texts if t).strip()
        if piece:
            pieces.append(piece)
    out = " ".join(pieces).strip()
    return out if out or re.search(r"<[A-Za-z/]", page) else page.strip()


def csv_text(body: str) -> str:
    """Each record as ``name: value`` pairs, records apart by a blank line."""
    rows = list(csv.reader(io.StringIO(body)))
    return "\n\n".join(", ".join(f"{name}: {value}" for name, value in zip(rows[0], row)) for row in rows[1:]) if rows else ""


def docx_text(data: bytes) -> str:
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def eml_text(data: bytes) -> str:
    message = email.message_from_bytes(data, policy=email.policy.default)
    head = [f"{name}: {message[name]}" for name in ("From", "To", "Subject", "Date") if message[name]]
    body = message.get_body(("plain", "html"))
    content = body.get_content() if body else ""
    if body is not None and body.get_content_subtype() == "html":
        content = re.sub(r"\s+", " ", re.sub(r"<[^>]*>", " ", content)).strip()
    return "\n".join([*head, "", content]).strip()


def epub_text(data: bytes) -> str:
    book = zipfile.ZipFile(io.BytesIO(data))
    container = ElementTree.fromstring(book.read("META-INF/container.xml"))
    path = next(e.attrib["full-path"] for e in container.iter() if e.tag.endswith("rootfile"))
    package = ElementTree.fromstring(book.read(path))
    folder = path.rpartition("/")[0]
    items = {e.attrib["id"]: e.attrib["href"] for e in package.iter() if e.tag.endswith("}item")}
    spine = [items[e.attrib["idref"]] for e in package.iter() if e.tag.endswith("}itemref")]
    return "\n\n".join(extract_html(book.read(f"{folder}/{href}".lstrip("/")).decode("utf-8", "replace")) for href in spine)


#: Loader by extension: a function from bytes to text.  ``register`` adds to it.
REGISTRY: dict[str, Callable[[bytes], str]] = {
    **dict.fromkeys(("txt", "md", "json", "xml", "yaml", "yml", "log"), lambda b: b.decode("utf-8", "replace")),
    "csv": lambda b: csv_text(b.decode("utf-8", "replace")),
    "html": lambda b: extract_html(b.decode("utf-8", "replace")),
    "htm": lambda b: extract_html(b.decode("utf-8", "replace")),
    "docx": docx_text,
    "eml": eml_text,
    "epub": epub_text,
}


def register(extension: str, loader: Callable[[bytes], str]) -> None:
    """Add a loader, for instance one that calls a service for images or sound."""
    REGISTRY[extension.lower()] = loader


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Files under a path as ``(path, extension, content_hash, data_size, loader, text)``; text is null where no loader is registered or it fails."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    extension = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    return files.select("path", extension.alias("extension"), F.md5("content").alias("content_hash"), F.col("length").alias("data_size"), text_functions.loader_name(extension).alias("loader"), load(extension, F.col("content")).alias("text"))


def load(extension: Column, content: Column) -> Column:
    """Text of binary content by the registered loaders."""
    registry = dict(REGISTRY)

    @F.pandas_udf(T.StringType())
    def run(extensions: pd.Series, contents: pd.Series) -> pd.Series:
        out = []
        for e, c in zip(extensions, contents):
            try:
                out.append(registry[(e or "").lower()](bytes(c)))
            except Exception:  # noqa: BLE001 - a broken file must not end the job
                out.append(None)
        return pd.Series(out, dtype=object)

    return run(extension, content)


def html_text(html: Column) -> Column:
    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda page: None if page is None else extract_html(page))

    return run(html)


def url_kind(url: Column) -> tuple[Column, Column]:
    """Extension and MIME type that a URL's path suggests, ``html`` where it has none."""
    suffix = F.lower(F.regexp_extract(F.parse_url(url, F.lit("PATH")), r"\.([A-Za-z0-9]{1,5})$", 1))
    extension = F.when(suffix == "", F.lit("html")).otherwise(suffix)
    mime = F.when(extension.isin("html", "htm"), "text/html").when(extension.isin("txt", "log", "md"), "text/plain").when(extension == "json", "application/json").when(extension == "pdf", "application/pdf").when(extension == "csv", "text/csv")
    return extension, mime.otherwise("application/octet-stream")
