"""Any files to text: each goes to the extractor of its kind. Further extractors can be added by extension."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import files, pdf

#: path, title, text of (path, content), for a kind of file.
Extractor = Callable[[DataFrame], DataFrame]

EXTRACTORS: dict[tuple[str, ...], Extractor] = {}


def extractor(*extensions: str) -> Callable[[Extractor], Extractor]:
    """Registers a function of (path, content) to (path, title, text) for extensions; the last one registered counts."""

    def add(f: Extractor) -> Extractor:
        for key in [k for k in EXTRACTORS if set(k) & set(extensions)]:
            rest = tuple(e for e in key if e not in extensions)
            held = EXTRACTORS.pop(key)
            if rest:
                EXTRACTORS[rest] = held
        EXTRACTORS[tuple(extensions)] = f
        return f

    return add


def _decoded(rows: DataFrame) -> DataFrame:
    return rows.select("path", files.decode(F.col("content")).alias("text"))


@extractor("md", "markdown")
def markdown(rows: DataFrame) -> DataFrame:
    return files.markdown(_decoded(rows)).select("path", "title", F.col("body").alias("text"))


@extractor("html", "htm")
def html(rows: DataFrame) -> DataFrame:
    return files.html_pages(_decoded(rows), "path", "text").select("path", "title", F.col("markdown").alias("text"))


@extractor("docx")
def docx(rows: DataFrame) -> DataFrame:
    return files.docx_files(rows).select("path", "title", F.col("markdown").alias("text"))


@extractor("pdf")
def portable(rows: DataFrame) -> DataFrame:
    return pdf.pdf_documents(rows).select("path", "title", F.col("markdown").alias("text"))


def extract(rows: DataFrame, doc_rules: list[str] | None = None) -> DataFrame:
    """path, kind, language, title, text of files (path, content): documents by their extractor, code and text as it
    is. Files that are ignored, or of which an extractor makes nothing, are left out."""
    named = rows.select("path", "content", files.classify(F.col("path"), F.col("content"), doc_rules or ["*.pdf", "*.docx", "*.html", "*.htm"]).alias("kind"))
    ext = files.extension(F.col("path"))
    taken, parts = F.lit(False), []
    for extensions, make in EXTRACTORS.items():
        own = named.filter(ext.isin(*extensions) & F.col("kind").isin("markdown", "document"))
        parts.append(make(own.select("path", "content")).select("path", "title", "text"))
        taken = taken | ext.isin(*extensions)
    plain = named.filter(F.col("kind").isin("code", "text") | (F.col("kind").isin("markdown", "document") & ~taken))
    parts.append(_decoded(plain).select("path", F.lit(None).cast("string").alias("title"), "text"))
    made = parts[0]
    for p in parts[1:]:
        made = made.unionByName(p)
    return made.filter("text is not null").join(named.select("path", "kind", files.language(F.col("path")).alias("language")), "path").select("path", "kind", "language", "title", "text")
