"""Chunking: one document to many chunks, by heading, paragraph, line groups or fixed size.

Sizes are bytes, a token counting four. Splitters that keep state over a document run in Arrow batches; each
document is cut on its own, so nothing is shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.functions.batches import slices

TOKEN_BYTES = 4
SCHEMA = "path string, chunk_index int, text string, start_byte int, end_byte int, start_line int, end_line int, heading_chain string"


@dataclass(frozen=True)
class Settings:
    strategy: str = "heading"
    target_tokens: int = 512
    max_tokens: int = 1024
    min_tokens: int = 16
    overlap_tokens: int = 0

    @property
    def target(self) -> int:
        return self.target_tokens * TOKEN_BYTES

    @property
    def most(self) -> int:
        return self.max_tokens * TOKEN_BYTES

    @property
    def least(self) -> int:
        return self.min_tokens * TOKEN_BYTES


def _size(text: str) -> int:
    return len(text.encode())


_HEADING = re.compile(r"^\s*(#{1,6})(?: (.*))?$")
_SENTENCE = re.compile(r"(?<=[.!?\n])\s+")


def sections(body: str) -> list[tuple[int, str, str, int, int]]:
    """(level, title, text, start, end) in bytes; a fence hides the headings in it. Level 0 is the preamble."""
    found, at, fenced = [], 0, False
    level, title, lines, start = 0, "", [], 0
    for line in body.splitlines(keepends=True):
        bare = line.rstrip("\r\n")
        if bare.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        m = None if fenced else _HEADING.match(bare)
        if m:
            found.append((level, title, "".join(lines).strip(), start, at))
            level, title, lines, start = len(m[1]), (m[2] or "").strip(), [], at
        else:
            lines.append(line)
        at += _size(line)
    found.append((level, title, "".join(lines).strip(), start, at))
    return [s for s in found if s[0] or s[2]]


def split_sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text) if s.strip()]


def _by_characters(text: str, most: int) -> list[str]:
    """Pieces of at most ``most`` bytes, cut at the last white space if there is one."""
    out = []
    while _size(text) > most:
        head = text.encode()[:most].decode("utf-8", "ignore")
        space = max(head.rfind(" "), head.rfind("\n"))
        end = space if space > 0 else max(1, len(head))
        out.append(text[:end].strip())
        text = text[end:].lstrip()
    return [p for p in [*out, text.strip()] if p]


def _packed(parts: list[str], target: int, most: int, glue: str, finer) -> list[str]:
    """Parts joined up to the target; one beyond the most is cut by ``finer`` first."""
    out, held = [], ""
    for part in parts:
        if _size(part) > most:
            if held:
                out.append(held)
                held = ""
            out += finer(part)
        elif held and _size(held) + _size(glue) + _size(part) > target:
            out.append(held)
            held = part
        else:
            held = held + glue + part if held else part
    return out + [held] if held else out


def split_large(text: str, s: Settings) -> list[str]:
    """Paragraphs, then sentences, then characters, packed up to the target."""
    by_sentence = lambda p: _packed(split_sentences(p), s.target, s.most, " ", lambda q: _by_characters(q, s.most))
    return _packed([p.strip() for p in text.split("\n\n") if p.strip()], s.target, s.most, "\n\n", by_sentence)


def by_heading(body: str, s: Settings) -> list[tuple[str, int, int, str | None]]:
    """(text, start, end, chain): a chunk for each section; small ones are joined to those that follow, as long
    as they fit; large ones are split. The chain is that of the first section joined."""
    out: list[tuple[str, int, int, str | None]] = []
    stack: list[tuple[int, str]] = []
    held: tuple[str, int, int, str | None] | None = None
    for level, title, text, start, end in sections(body):
        if level:
            stack = [x for x in stack if x[0] < level] + [(level, title)]
        whole = "\n\n".join(x for x in ("#" * level + f" {title}" if level else "", text) if x)
        chain = " > ".join(t for _, t in stack) or None
        if held and _size(held[0]) < s.least and _size(held[0]) + _size(whole) + 2 <= s.most:
            held = (held[0] + "\n\n" + whole, held[1], end, held[3])
            continue
        if held:
            out.append(held)
        held = (whole, start, end, chain)
    if held:
        out.append(held)
    final = []
    for text, start, end, chain in out:
        final += [(text, start, end, chain)] if _size(text) <= s.most else [(p, start, end, chain) for p in split_large(text, s)]
    return final


def by_paragraph(body: str, s: Settings) -> list[tuple[str, int, int, str | None]]:
    return _located(body, split_large(body, s))


def by_lines(body: str, s: Settings) -> list[tuple[str, int, int, str | None]]:
    """A chunk closes at the end of the line that brings it to the target; what is below the least is dropped."""
    out, held, start, at = [], [], 0, 0
    for line in body.splitlines(keepends=True):
        held.append(line)
        at += _size(line)
        if at - start >= s.target:
            out.append(("".join(held).strip(), start, at, None))
            held, start = [], at
    out.append(("".join(held).strip(), start, at, None))
    return [c for c in out if c[0] and _size(c[0]) >= s.least]


def fixed(body: str, s: Settings) -> list[tuple[str, int, int, str | None]]:
    """Slices of the target size, moved on to the next character boundary."""
    raw, out, start = body.encode(), [], 0
    while start < len(raw):
        end = min(len(raw), start + s.target)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1
        text = raw[start:end].decode().strip()
        if text and _size(text) >= s.least:
            out.append((text, start, end, None))
        start = end
    return out


def _located(body: str, parts: list[str]) -> list[tuple[str, int, int, str | None]]:
    raw, at, out = body.encode(), 0, []
    for p in parts:
        found = raw.find(p.split("\n\n")[0].encode(), at)
        start = found if found >= 0 else at
        end = min(len(raw), start + _size(p))
        out.append((p, start, end, None))
        at = end
    return out


STRATEGIES = {"heading": by_heading, "paragraph": by_paragraph, "semantic": by_lines, "fixed": fixed}


def chunk(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Chunks (SCHEMA) of documents (path, text). A null or blank text has none; an unknown strategy is refused.

    Lines are counted from 1. Overlap, if any, is put before each chunk and moves no offset.
    """
    if settings.strategy not in STRATEGIES:
        raise ValueError(f"no chunking strategy {settings.strategy!r}")
    cut = STRATEGIES[settings.strategy]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not (text or "").strip():
                    continue
                raw = text.encode()
                for k, (piece, start, end, chain) in enumerate(cut(text, settings)):
                    rows.append((path, k, piece, start, end, raw.count(b"\n", 0, start) + 1, raw.count(b"\n", 0, max(start, end - 1)) + 1, chain))
            columns = list(zip(*rows, strict=True)) or [[]] * 8
            kinds = [pa.string(), pa.int32(), pa.string(), *[pa.int32()] * 4, pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in SCHEMA.split(", ")])

    made = docs.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
    return overlap(made, settings.overlap_tokens) if settings.overlap_tokens else made


def overlap(chunks: DataFrame, tokens: int) -> DataFrame:
    """Before each chunk the end of the one before it, and a blank line; offsets stay."""
    before = F.lag("text").over(Window.partitionBy("path").orderBy("chunk_index"))
    return chunks.withColumn("text", F.when(before.isNull(), F.col("text")).otherwise(F.concat(F.trim(F.right(before, F.lit(tokens * TOKEN_BYTES))), F.lit("\n\n"), "text")))


def fixed_ascii(docs: DataFrame, size: int) -> DataFrame:
    """Fixed slices by built-in functions; for ASCII texts the same as ``fixed``, without dropping small ones."""
    starts = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(size))
    each = docs.filter(F.length("text") > 0).select("path", "text", F.posexplode(starts).alias("chunk_index", "start_byte"))
    return each.select("path", "chunk_index", F.trim(F.substring("text", F.col("start_byte") + 1, F.lit(size))).alias("text"), "start_byte")


def line_windows(docs: DataFrame, size: int = 100, lap: int = 10) -> DataFrame:
    """path, chunk_index, text, start_line, end_line: windows of lines of any text, each lapping the last."""
    lines = F.split("text", "\n")
    step = size - lap
    starts = F.sequence(F.lit(0), F.greatest(F.size(lines) - 1 - lap, F.lit(0)), F.lit(step))
    each = docs.filter("text is not null").select("path", lines.alias("l"), F.posexplode(starts).alias("chunk_index", "s"))
    piece = F.slice("l", F.col("s") + 1, size)
    return each.select("path", "chunk_index", F.array_join(piece, "\n").alias("text"), (F.col("s") + 1).alias("start_line"), (F.col("s") + F.size(piece)).alias("end_line"))


def _listy(text: Column) -> Column:
    """Whether most lines that say something are list items or table rows."""
    said = F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: (s != "") & ~s.startswith("#"))
    items = F.filter(said, lambda s: s.rlike(r"^(\||[-*+] )") | (s.rlike(r"^\d") & s.contains(". ") & (F.octet_length(s) > 2)))
    return F.when(F.size(said) > 0, F.size(items) / F.size(said) > 0.6).otherwise(False)


def document_policy(chunks: DataFrame) -> DataFrame:
    """Adds embed_policy, anchor or graph_only, to (path, chunk_index, heading_level, heading_chain, first_in_section,
    template, text): the rules in order, the first that applies."""
    path = F.lower(F.replace("path", F.lit("\\"), F.lit("/")))
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    changelog = name.rlike("^(releases|changelog|changes|history)") | path.rlike("/(releases|changelog)/")
    decision = F.coalesce(F.col("template") == "adr", F.lit(False)) | path.rlike("/(adrs?|architecture)/") | name.startswith("adr-")
    said = F.lower("text").rlike("decision|context|status|consequences")
    first, level = F.col("chunk_index") == 0, F.col("heading_level")
    anchor = (
        F.when(changelog, first)
        .when(decision & (first | (level <= 2) | said), True)
        .when(first | (level <= 1), True)
        .when(level >= 3, False)
        .when(F.size(F.split(F.coalesce("heading_chain", F.lit("")), ">")) > 2, False)
        .when(~F.col("first_in_section"), False)
        .when(_listy(F.col("text")), False)
        .otherwise(level == 2)
    )
    return chunks.withColumn("embed_policy", F.when(anchor, "anchor").otherwise("graph_only"))


def code_policy(symbols: DataFrame) -> DataFrame:
    """Adds embed_policy to (path, name, symbol_type, language, signature): tests and impl blocks only in the
    graph, types anchor, functions if they are public in their language."""
    test = F.lower("path").rlike(r"(^|/)tests?/|_test\.|\.test\.|\.spec\.") | F.lower("name").rlike("^test_|_test$")
    head, language = F.coalesce("signature", F.lit("")), F.col("language")
    public = (
        F.when(language == "rust", head.rlike(r"^\s*pub\b"))
        .when(language == "go", F.col("name").rlike(r"^\p{Lu}"))
        .when(language == "python", ~F.col("name").startswith("_"))
        .when(language.isin("java", "csharp", "kotlin", "scala"), ~head.rlike(r"\b(private|protected|internal)\b"))
        .when(language.isin("typescript", "tsx", "javascript"), head.rlike(r"\bexport\b"))
        .otherwise(True)
    )
    kind = F.lower("symbol_type")
    anchor = F.when(test | (kind == "impl"), False).when(kind.isin("class", "struct", "enum", "trait", "interface", "type"), True).when(kind.isin("function", "method"), public).otherwise(False)
    return symbols.withColumn("embed_policy", F.when(anchor, "anchor").otherwise("graph_only"))
