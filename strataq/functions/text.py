"""Scalar text functions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Token limit of the lexical index, in bytes.
MAX_TOKEN_BYTES = 40

# Suffix rules in the order they are tried, as (suffix, letters dropped, ending put, the word is
# longer than). Words of four letters or fewer have no stem.
STEM_RULES = (
    ("ization", 5, "", 7),
    ("isation", 6, "z", 7),
    ("ize", 1, "", 4),
    ("ise", 2, "z", 4),
    ("ation", 5, "at", 6),
    ("ate", 3, "at", 5),
    ("ition", 5, "", 6),
    ("version", 4, "t", 5),
    ("sion", 4, "", 5),
    ("tion", 4, "t", 5),
    ("ing", 3, "", 5),
    ("ment", 4, "", 6),
    ("able", 4, "", 6),
    ("ible", 4, "", 6),
    ("ies", 3, "y", 4),
    ("es", 1, "", 4),
    ("s", 1, "", 3),
)

# Abbreviations and what they stand for; used in both directions, the first that applies.
ABBREVIATIONS = (
    ("req", "request"),
    ("resp", "response"),
    ("res", "response"),
    ("err", "error"),
    ("exc", "exception"),
    ("msg", "message"),
    ("ctx", "context"),
    ("cfg", "config"),
    ("conf", "configuration"),
    ("init", "initialize"),
    ("auth", "authentication"),
    ("tx", "transaction"),
    ("txn", "transaction"),
    ("id", "identifier"),
    ("num", "number"),
    ("str", "string"),
    ("calc", "calculate"),
    ("param", "parameter"),
    ("arg", "argument"),
    ("pkg", "package"),
    ("fn", "function"),
    ("func", "function"),
    ("cb", "callback"),
    ("db", "database"),
    ("recv", "receive"),
    ("sync", "synchronize"),
    ("desc", "description"),
    ("info", "information"),
    ("doc", "document"),
    ("proto", "protobuf"),
)

# Endings of component names that are tokens of their own, in the order they are tried.
STRUCTURAL_SUFFIXES = ("service", "server", "client", "store", "handler", "controller", "manager", "provider", "gateway", "worker", "catalog", "factory", "stream", "queue", "router", "model", "view", "repository")


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, over-long ones dropped; null gives none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.filter(parts, lambda t: (t != "") & (F.octet_length(t) <= MAX_TOKEN_BYTES))


def sanitize_query(text: Column) -> Column:
    """A query made safe: fence lines dropped, punctuation to space, operators lower-cased, spaces collapsed."""
    no_fences = F.regexp_replace(text, r"(?m)^\s*```.*$", " ")
    words = F.regexp_replace(no_fences, r"[^\p{L}\p{N}_\s]", " ")
    lowered = reduce(lambda c, op: F.regexp_replace(c, rf"\b{op}\b", op.lower()), ("AND", "OR", "NOT"), words)
    return F.trim(F.regexp_replace(lowered, r"\s+", " "))


def split_identifier(name: Column) -> Column:
    """Lower-cased parts of an identifier, cut at punctuation and at camel and acronym boundaries."""
    spaced = F.regexp_replace(name, r"[_\-:./\\\s]+", " ")
    cut = F.regexp_replace(spaced, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    return F.filter(F.split(F.lower(cut), " +"), lambda p: p != "")


def code_tokens(text: Column) -> Column:
    """Tokens of code: words of two letters or more cut at camel boundaries, numbers of six digits at most, and
    of a compound with a structural suffix its parts as well."""
    cut = F.regexp_replace(text, r"(?<=[\p{Ll}\p{N}])(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})", " ")
    found = F.regexp_extract_all(F.lower(cut), F.lit(r"(\p{L}[\p{L}\p{N}]+|\p{N}+)"), 1)
    kept = F.filter(found, lambda t: ~(t.rlike(r"^\p{N}+$") & (F.length(t) > 6)))
    compound = rf"^(.{{3,}})({'|'.join(STRUCTURAL_SUFFIXES)})$"
    parts = lambda t: F.filter(F.array(t, F.regexp_extract(t, compound, 1), F.regexp_extract(t, compound, 2)), lambda x: x != "")
    return F.flatten(F.transform(kept, parts))


def stem(token: Column) -> Column:
    """The token without the first suffix that applies; null if none does."""
    rule = F.when(F.length(token) <= 4, F.lit(None).cast("string"))
    for suffix, dropped, ending, longer_than in STEM_RULES:
        base = F.substring(token, F.lit(1), F.length(token) - dropped)
        if suffix == "ing":  # a doubled letter before it is single in the stem
            base = F.regexp_replace(base, r"^(.+)(.)\2$", "$1$2")
        cond = token.endswith(suffix) & (F.length(token) > longer_than)
        if suffix == "s":
            cond = cond & ~token.endswith("ss")
        rule = rule.when(cond, F.concat(base, F.lit(ending)))
    return rule


def expand_abbreviation(token: Column) -> Column:
    """The long form of an abbreviation or the abbreviation of a long form; null for others."""
    table: dict[str, str] = {}
    for short, long in ABBREVIATIONS:
        table.setdefault(short, long)
        table.setdefault(long, short)
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), token)


def tags(body: Column, declared: Column | None = None) -> Column:
    """``#word`` tags of a body (headings don't match) and the declared ones, sorted and distinct."""
    inline = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"(?<=^|\s)#(\p{L}[^\s#]*)"), 1)
    trimmed = F.transform(inline, lambda t: F.regexp_replace(t, r"[\p{P}]+$", ""))
    found = F.filter(trimmed, lambda t: t != "")
    if declared is not None:
        found = F.array_union(F.coalesce(declared, F.array().cast("array<string>")), found)
    return F.array_sort(F.array_distinct(found))


def title(body: Column, declared: Column | None = None) -> Column:
    """The declared title, else the first level-one heading line, else null."""
    heading = F.nullif(F.trim(F.regexp_extract(body, r"(?m)^\s*# (.*)$", 1)), F.lit(""))
    return heading if declared is None else F.coalesce(declared, heading)


def wikilinks(body: Column) -> Column:
    """``[[target|label]]`` as structs, trimmed; empty targets are skipped, a missing label is null."""
    inner = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(r"\[\[([^\]]+)\]\]"), 1)
    parts = F.transform(inner, lambda s: F.split(s, r"\|", 2))
    links = F.transform(parts, lambda p: F.struct(F.trim(p[0]).alias("target"), F.when(F.size(p) > 1, F.trim(F.get(p, F.lit(1)))).alias("label")))
    return F.filter(links, lambda s: s["target"] != "")


def headings(body: Column) -> Column:
    """ATX headings outside fences as (line, level, title)."""
    lines = F.transform(F.split(body, "\n"), lambda s, i: F.struct(i.alias("line"), s.alias("text")))

    def walk(acc: Column, x: Column) -> Column:
        fence = F.trim(x["text"]).rlike(r"^(```|~~~)")
        is_heading = ~acc["inside"] & ~fence & x["text"].rlike(r"^ {0,3}#{1,6}\s+\S")
        hashes = F.length(F.regexp_extract(x["text"], r"^ {0,3}(#{1,6})", 1))
        text = F.regexp_replace(F.regexp_extract(x["text"], r"^ {0,3}#{1,6}\s+(.*?)\s*$", 1), r"\s+#+$", "")
        found = F.when(is_heading, F.array_append(acc["found"], F.struct(x["line"].alias("line"), hashes.alias("level"), text.alias("title")))).otherwise(acc["found"])
        return F.struct((acc["inside"] != fence).alias("inside"), found.alias("found"))

    empty = F.array().cast("array<struct<line:int,level:int,title:string>>")
    return F.aggregate(lines, F.struct(F.lit(False).alias("inside"), empty.alias("found")), walk)["found"]


def content_hash(text: Column) -> Column:
    """A digest that changes when the content does."""
    return F.sha2(text.cast("binary"), 256)


def normalize_scope(scope: Column) -> Column:
    """A scope path without generics and lifetimes, up to four levels deep."""
    bare = reduce(lambda c, _: F.regexp_replace(c, r"<[^<>]*>", ""), range(4), scope)
    return F.trim(F.regexp_replace(F.regexp_replace(bare, r"'\w+\s*", ""), r"\s+", " "))


def leaf(scope: Column) -> Column:
    """What follows the last separator of a scope path."""
    return F.regexp_extract(scope, r"([^>:.\s]+)\s*$", 1)


def moniker(scheme: Column, manager: Column, package: Column, version: Column, descriptor: Column) -> Column:
    """``scheme manager package version descriptor``; what is missing is a dot."""
    dot = F.lit(".")
    return F.concat_ws(" ", *[F.coalesce(F.nullif(c, F.lit("")), dot) for c in (scheme, manager, package, version, descriptor)])


def moniker_leaf(symbol: Column) -> Column:
    """The name in a moniker's last descriptor, without its suffix marks."""
    last = F.element_at(F.split(symbol, " "), -1)
    return F.regexp_extract(F.regexp_replace(last, r"[.#/():]+$", ""), r"([^/#.:]+)$", 1)


def is_date_like(text: Column) -> Column:
    """Ten characters of the form dddd-dd-dd first; no calendar check."""
    return text.rlike(r"^\d{4}-\d{2}-\d{2}")


def directory_key(path: Column, depth: int = 3) -> Column:
    """The first directories of a path."""
    parts = F.split(path, "/")
    return F.array_join(F.slice(parts, 1, F.least(F.lit(depth), F.greatest(F.size(parts) - 1, F.lit(1)))), "/")


def fnv1a(text: Column) -> Column:
    """The 32-bit FNV-1a hash of a text's UTF-8 bytes, as a long."""
    raw = F.encode(text, "UTF-8")
    places = F.when(F.octet_length(raw) > 0, F.sequence(F.lit(1), F.octet_length(raw))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.hex(F.substring(raw, i, F.lit(1))), 16, 10).cast("long")
    return F.aggregate(places, F.lit(0x811C9DC5).cast("long"), lambda h, i: (h.bitwiseXOR(byte(i)) * 0x01000193).bitwiseAND(F.lit(0xFFFFFFFF).cast("long")))


# Colours by kind of entity, and those of communities for other kinds.
ENTITY_COLORS = (
    (("docnode", "doc", "document", "markdown"), 0x3B82F6),
    (("function", "method"), 0x10B981),
    (("struct", "class"), 0x8B5CF6),
    (("trait", "interface"), 0xEC4899),
    (("enum", "typealias", "type"), 0xF59E0B),
    (("module", "file", "package"), 0x06B6D4),
    (("constant", "macro"), 0x14B8A6),
)
COMMUNITY_COLORS = (0x3B82F6, 0x10B981, 0x8B5CF6, 0xF59E0B, 0xEC4899, 0x06B6D4, 0x14B8A6, 0x6366F1, 0xE11D48, 0x84CC16)


def entity_color(kind: Column, community: Column) -> Column:
    """The colour of an entity by its kind, else by its community, as a number 0xRRGGBB."""
    found = F.element_at(F.array(*[F.lit(c) for c in COMMUNITY_COLORS]), (F.pmod(community, F.lit(len(COMMUNITY_COLORS))) + 1).cast("int"))
    for kinds, color in reversed(ENTITY_COLORS):
        found = F.when(F.lower(kind).isin(*kinds), F.lit(color)).otherwise(found)
    return found


def embed_text(heading: Column, section: Column, text: Column) -> Column:
    """``title > section: text``, or with whichever of both is there."""
    head = F.concat_ws(" > ", F.nullif(heading, F.lit("")), F.nullif(section, F.lit("")))
    return F.when(head == "", text).otherwise(F.concat(head, F.lit(": "), text))


def normalize_import(file: Column, raw: Column) -> Column:
    """The path prefix that an import names: relative dots resolved, crate and super forms, no extension."""
    folder = F.regexp_replace(file, r"/?[^/]*$", "")
    parent = F.regexp_replace(folder, r"/?[^/]*$", "")
    clean = F.regexp_replace(F.regexp_replace(raw, r"""^['"]|['"]$""", ""), r"\.(js|jsx|ts|tsx|py|rs|go|java)$", "")
    joined = (
        F.when(clean.startswith("./"), F.concat_ws("/", F.nullif(folder, F.lit("")), F.substring(clean, F.lit(3), F.length(clean))))
        .when(clean.startswith("../"), F.concat_ws("/", F.nullif(parent, F.lit("")), F.substring(clean, F.lit(4), F.length(clean))))
        .when(clean.startswith("crate::"), F.concat(F.lit("src/"), F.replace(F.substring(clean, F.lit(8), F.length(clean)), F.lit("::"), F.lit("/"))))
        .when(clean.startswith("super::"), F.concat_ws("/", F.nullif(parent, F.lit("")), F.replace(F.substring(clean, F.lit(8), F.length(clean)), F.lit("::"), F.lit("/"))))
        .when(clean.contains("/"), clean)
    )
    return F.coalesce(joined, F.replace(F.replace(clean, F.lit("::"), F.lit("/")), F.lit("."), F.lit("/")))
