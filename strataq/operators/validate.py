"""Templates and the validity of notes: fields, sections, edge targets, links, cycles, decision records."""

from __future__ import annotations

from dataclasses import dataclass, field

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.functions.scale import broadcast_if_small
from strataq.functions.text import headings, is_date_like

from .graph import class_matches, cycles

KINDS = ("string", "path", "date", "enum", "list", "listofpaths", "number", "boolean")


@dataclass
class Field:
    name: str
    kind: str = "string"
    required: bool = False
    values: list[str] | None = None


@dataclass
class Template:
    name: str
    fields: list[Field] = field(default_factory=list)
    sections: list[str] = field(default_factory=list)
    min_words: int = 0
    edges: list[tuple[str, str | None]] = field(default_factory=list)  # field, template its targets carry


def load_template(text: str) -> Template:
    """A template from Markdown whose frontmatter holds the schema, fields as a map or a list."""
    block = text.lstrip("﻿").split("---", 2)[1] if text.lstrip("﻿").startswith("---") else text
    raw = yaml.safe_load(block) or {}
    listed = raw.get("fields") or {}
    pairs = listed.items() if isinstance(listed, dict) else ((f["name"], f) for f in listed)
    fields = []
    for name, spec in pairs:
        spec = spec if isinstance(spec, dict) else {"type": spec}
        kind = str(spec.get("type", "string")).lower().replace("_", "")
        if kind not in KINDS:
            raise ValueError(f"field {name!r} has no type {kind!r}")
        fields.append(Field(name, kind, bool(spec.get("required")), spec.get("values")))
    edges = [(e["field"], e.get("template")) for e in raw.get("edges") or []]
    return Template(raw.get("template") or raw["name"], fields, list(raw.get("sections") or []), int(raw.get("min_words") or 0), edges)


def template_table(spark: SparkSession, templates: list[Template]) -> DataFrame:
    """template, field, kind, required, values: a row for each field."""
    rows = [(t.name, f.name, f.kind, f.required, f.values) for t in templates for f in t.fields]
    return spark.createDataFrame(rows, "template string, field string, kind string, required boolean, values array<string>")


def _fits(kind: Column, value: Column, values: Column) -> Column:
    """Whether a JSON value (as text) has the type, and an enum one of its values."""
    is_string = value.startswith('"')
    text = F.regexp_replace(value, r'^"|"$', "")
    return (
        F.when(kind.isin("string", "path"), is_string)
        .when(kind == "date", is_string & is_date_like(text))
        .when(kind == "enum", is_string & (values.isNull() | F.array_contains(values, text)))
        .when(kind.isin("list", "listofpaths"), value.startswith("["))
        .when(kind == "number", value.rlike(r"^-?\d"))
        .when(kind == "boolean", value.isin("true", "false"))
        .otherwise(F.lit(True))
    )


def issues(notes: DataFrame, templates: list[Template]) -> DataFrame:
    """path, severity, field, message of notes (path, template, frontmatter as JSON, body).

    A missing required field, a value of another type, a missing section and a text of too few words are
    errors or warnings; a template that isn't known is a warning.
    """
    spark = notes.sparkSession
    table = F.broadcast(template_table(spark, templates))  # as many rows as the templates have fields
    fields = notes.select("path", "template", F.try_parse_json("frontmatter").alias("v")).join(table, "template")
    with_value = fields.withColumn("value", F.expr("to_json(try_element_at(try_cast(v as map<string, variant>), field))"))
    bad = with_value.select(
        "path",
        F.when(F.col("value").isNull() & F.col("required"), F.struct(F.lit("error").alias("severity"), F.concat(F.lit("missing required field "), "field").alias("message")))
        .when(F.col("value").isNotNull() & ~_fits(F.col("kind"), F.col("value"), F.col("values")), F.struct(F.lit("error").alias("severity"), F.concat(F.lit("field "), "field", F.lit(" is no "), "kind").alias("message")))
        .alias("i"),
        "field",
    ).filter("i is not null")
    out = bad.select("path", "i.severity", "field", "i.message")
    known = [t.name for t in templates]
    unknown = notes.filter(F.col("template").isNotNull() & ~F.col("template").isin(*known) if known else F.col("template").isNotNull())
    none = F.lit(None).cast("string")
    out = out.unionByName(unknown.select("path", F.lit("warning").alias("severity"), none.alias("field"), F.concat(F.lit("unknown template "), "template").alias("message")))
    for t in templates:
        own = notes.filter(F.col("template") == t.name)
        titles = F.transform(headings(F.col("body")), lambda h: F.lower(h["title"]))
        for s in t.sections:
            out = out.unionByName(own.filter(~F.array_contains(titles, s.lower())).select("path", F.lit("warning").alias("severity"), none.alias("field"), F.lit(f"missing section {s}").alias("message")))
        if t.min_words:
            words = F.regexp_count("body", F.lit(r"\S+"))
            out = out.unionByName(own.filter(words < t.min_words).select("path", F.lit("warning").alias("severity"), none.alias("field"), F.lit(f"fewer than {t.min_words} words").alias("message")))
    return out


def edge_target_issues(edges: DataFrame, notes: DataFrame, symbols: DataFrame, expected: DataFrame) -> DataFrame:
    """path, severity, message: targets that don't exist or carry another template than expected.

    edges: src, dst, edge_type, target_kind; expected: edge_type, template. Symbol targets must be in the catalog.
    """
    known = notes.select(F.col("path").alias("dst"), F.col("template").alias("has"))
    rows = edges.join(known, "dst", "left").join(symbols.select(F.col("name").alias("dst"), F.lit(True).alias("symbol")).distinct(), "dst", "left").join(broadcast_if_small(expected), "edge_type", "left")
    is_symbol = F.col("target_kind") == "code_symbol"
    kind = (
        F.when(is_symbol & F.col("symbol").isNull(), F.struct(F.lit("warning").alias("severity"), F.lit("symbol not found").alias("message")))
        .when(~is_symbol & F.col("has").isNull(), F.struct(F.lit("error").alias("severity"), F.lit("target not found").alias("message")))
        .when(~is_symbol & (F.col("has") != F.col("template")), F.struct(F.lit("warning").alias("severity"), F.lit("target has another template").alias("message")))
    )
    return rows.select(F.col("src").alias("path"), "dst", "edge_type", kind.alias("i")).filter("i is not null").select("path", "dst", "edge_type", "i.severity", "i.message")


def validity(notes: DataFrame, found: DataFrame) -> DataFrame:
    """path, n_issues, valid: a note is valid without errors."""
    per = found.groupBy("path").agg(F.count("*").alias("n"), F.bool_and(F.col("severity") != "error").alias("ok"))
    return notes.select("path").join(per, "path", "left").select("path", F.coalesce("n", F.lit(0)).alias("n_issues"), F.coalesce("ok", F.lit(True)).alias("valid"))


def broken_links(edges: DataFrame, files: DataFrame) -> DataFrame:
    """src, dst, edge_type of structural edges to what no file has, with or without the note ending."""
    bare = lambda c: F.regexp_replace(c, r"\.md$", "")
    have = files.select(bare(F.col("path")).alias("bare")).distinct()
    own = edges.filter(class_matches("structural") & (F.col("class") == "structural")).select("src", "dst", "edge_type").distinct()
    return own.join(have, bare(F.col("dst")) == F.col("bare"), "left_anti")


def orphan_decisions(adrs: DataFrame, edges: DataFrame) -> DataFrame:
    """path, reason of decision records that the graph lacks, or that have no structural edges."""
    ends = lambda df: df.select(F.col("src").alias("path")).union(df.select("dst")).distinct()
    any_edge, structural = ends(edges).withColumn("a", F.lit(True)), ends(edges.filter("class = 'structural'")).withColumn("s", F.lit(True))
    rows = adrs.select("path").distinct().join(any_edge, "path", "left").join(structural, "path", "left")
    return rows.filter("s is null").select("path", F.when(F.col("a").isNull(), "not in graph").otherwise("no structural edges").alias("reason"))


def taxonomy(edges: DataFrame, files: DataFrame, adrs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """check, n: broken links, cycles and orphan decision records."""
    parts = {"broken_links": broken_links(edges, files), "cycles": cycles(edges, types), "orphan_decisions": orphan_decisions(adrs, edges)}
    counted = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n") for name, df in parts.items()]
    return counted[0].union(counted[1]).union(counted[2])
