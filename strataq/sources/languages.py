"""Source of languages with braces to symbols, edges and calls, by tables of patterns.

No grammar is needed: comments and strings are blanked out in place, definitions are found by pattern, and what they
hold lies between their braces. The rows are those of ``code.parse``, so the same functions read them. Python goes to
its own parser.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from . import code
from .files import language

_NAME = r"[A-Za-z_$][\w$]*"


@dataclass(frozen=True)
class Language:
    """Patterns of a language: (kind, pattern with a group ``name``, and ``base`` where it says what is inherited),
    imports with a group ``target``, and the words that look like calls and are none."""

    definitions: tuple[tuple[str, str], ...]
    imports: tuple[str, ...]
    scopes: tuple[str, ...] = ()  # blocks that only name a scope, such as a Rust impl
    raw_quote: str = ""


_C_TYPES = rf"(?:(?:static|inline|const|unsigned|extern|virtual|public|private|protected|internal|final|abstract|override|async|synchronized|default)\s+)*[\w:<>,\[\]*&?. ]+?[\s*&]+(?P<name>{_NAME})\s*\([^;{{}}()]*(?:\([^()]*\)[^;{{}}()]*)*\)\s*(?:const|noexcept|override|throws [\w., ]+|where [^{{]+)?\s*(?=\{{)"
def _class(word: str) -> tuple[str, str]:
    """A kind of type by its keyword: its name, what it extends, and an opening brace after."""
    heir = rf"(?:\s*(?:extends|implements|:)\s*(?:public\s+|private\s+)?(?P<base>{_NAME}))?"
    return word, rf"\b{word}\s+(?P<name>{_NAME})(?:<[^>{{}}]*>)?{heir}[^;{{}}()]*(?=\{{)"


#: By the names that ``files.language`` gives.
LANGUAGES: dict[str, Language] = {
    "rust": Language(
        (("function", rf"\bfn\s+(?P<name>{_NAME})"), ("struct", rf"\bstruct\s+(?P<name>{_NAME})"), ("enum", rf"\benum\s+(?P<name>{_NAME})"), ("trait", rf"\btrait\s+(?P<name>{_NAME})(?:\s*:\s*(?P<base>{_NAME}))?")),
        (r"(?m)^\s*(?:pub\s+)?use\s+(?P<target>[\w:]+)",),
        (rf"\bimpl(?:<[^>{{}}]*>)?\s+(?:(?P<base>{_NAME})(?:<[^>{{}}]*>)?\s+for\s+)?(?P<name>{_NAME})",),
    ),
    "go": Language(
        (("method", rf"\bfunc\s+\(\s*\w*\s*\*?(?P<owner>{_NAME})\s*\)\s*(?P<name>{_NAME})"), ("function", rf"\bfunc\s+(?P<name>{_NAME})"), ("struct", rf"\btype\s+(?P<name>{_NAME})\s+struct"), ("interface", rf"\btype\s+(?P<name>{_NAME})\s+interface")),
        (r'(?m)^\s*(?:import\s+)?(?:\w+\s+)?"(?P<target>[\w./-]+)"\s*$',),
        raw_quote="`",
    ),
    "javascript": Language(
        (_class("class"), ("function", rf"\bfunction\s*\*?\s+(?P<name>{_NAME})"), ("function", rf"\b(?:const|let|var)\s+(?P<name>{_NAME})\s*=\s*(?:async\s*)?(?:\([^()]*\)|{_NAME})\s*=>\s*(?=\{{)"), ("method", rf"(?m)^\s+(?:static\s+|async\s+|get\s+|set\s+)*(?P<name>{_NAME})\s*\([^()]*\)\s*(?=\{{)")),
        (r"""\bimport\s+(?:[^;'"]*?\sfrom\s+)?['"](?P<target>[^'"]+)['"]""", r"""\brequire\(\s*['"](?P<target>[^'"]+)['"]\s*\)"""),
        raw_quote="`",
    ),
    "java": Language((_class("class"), _class("interface"), _class("enum"), ("method", _C_TYPES)), (r"(?m)^\s*import\s+(?:static\s+)?(?P<target>[\w.]+)",)),
    "csharp": Language((_class("class"), _class("interface"), _class("struct"), _class("enum"), ("method", _C_TYPES)), (r"(?m)^\s*using\s+(?P<target>[\w.]+)\s*;",), (rf"\bnamespace\s+(?P<name>[\w.]+)",)),
    "kotlin": Language((_class("class"), _class("interface"), _class("object"), ("function", rf"\bfun\s+(?:<[^>]*>\s*)?(?:{_NAME}\.)?(?P<name>{_NAME})")), (r"(?m)^\s*import\s+(?P<target>[\w.]+)",)),
    "c": Language((("struct", rf"\bstruct\s+(?P<name>{_NAME})\s*(?=\{{)"), ("enum", rf"\benum\s+(?P<name>{_NAME})\s*(?=\{{)"), ("function", _C_TYPES)), (r"""(?m)^\s*#\s*include\s+[<"](?P<target>[^>"]+)[>"]""",)),
    "cpp": Language((_class("class"), _class("struct"), ("function", _C_TYPES)), (r"""(?m)^\s*#\s*include\s+[<"](?P<target>[^>"]+)[>"]""",), (rf"\bnamespace\s+(?P<name>{_NAME})",)),
    "php": Language((_class("class"), _class("interface"), _class("trait"), ("function", rf"\bfunction\s+&?(?P<name>{_NAME})")), (r"(?m)^\s*use\s+(?P<target>[\w\\]+)\s*;", r"""\b(?:require|include)(?:_once)?\s*\(?\s*['"](?P<target>[^'"]+)['"]""")),
    "swift": Language((_class("class"), _class("struct"), _class("enum"), _class("protocol"), ("function", rf"\bfunc\s+(?P<name>{_NAME})")), (r"(?m)^\s*import\s+(?P<target>[\w.]+)",)),
}
LANGUAGES |= {"typescript": LANGUAGES["javascript"], "tsx": LANGUAGES["javascript"], "scala": LANGUAGES["kotlin"], "dart": LANGUAGES["java"]}

_CONTROL = frozenset("if else for while do switch case catch return match new throw typeof sizeof function".split())
_NO_CALLS = _CONTROL | frozenset("fn func await when using lock foreach elseif defer go select super constructor".split())
_CALL = re.compile(rf"(?:(?P<receiver>{_NAME})\s*(?:\.|::|->))?(?P<name>{_NAME})!?\s*\(")


def blanked(text: str, raw_quote: str = "") -> str:
    """The text with comments and the insides of strings as spaces, places kept."""
    quotes = "\"'" + raw_quote
    pattern = r"/\*.*?(?:\*/|\Z)|//[^\n]*|" + "|".join(rf"{q}(?:\\.|[^{q}\\{'' if q == raw_quote else chr(92) + 'n'}])*{q}" for q in quotes)

    def blank(m: re.Match) -> str:
        keep = m[0][0] in quotes
        inside = m[0][1:-1] if keep else m[0]
        spaces = re.sub(r"[^\n]", " ", inside)
        return m[0][0] + spaces + m[0][-1] if keep else spaces

    return re.sub(pattern, blank, text, flags=re.DOTALL)


def _braces(text: str) -> dict[int, int]:
    """Place of each opening brace -> place of the one that closes it."""
    stack, pairs = [], {}
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            stack.append(m.start())
        elif stack:
            pairs[stack.pop()] = m.start()
    return pairs | {at: len(text) - 1 for at in stack}


def scan(path: str, text: str, name: str) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Symbols, edges and calls of one file, as ``code`` has them."""
    own = LANGUAGES[name]
    bare, starts = blanked(text, own.raw_quote), [0, *(m.end() for m in re.finditer("\n", text))]
    pairs, lines = _braces(bare), text.split("\n")
    opens = sorted(pairs)
    line = lambda at: bisect_right(starts, at)
    found: dict[int, tuple] = {}  # by the place of the name: a definition counts once, by the first pattern
    for kind, pattern in [*own.definitions, *(("", p) for p in own.scopes)]:
        for m in re.finditer(pattern, bare):
            if m["name"] in _CONTROL or m.start("name") in found:
                continue
            k = bisect_right(opens, m.end() - 1)
            stop = re.search(r"[;{]", bare[m.end() :])
            body = opens[k] if k < len(opens) and stop and bare[m.end() + stop.start()] == "{" else None
            groups = m.groupdict()
            found[m.start("name")] = (kind, m["name"], groups.get("base"), groups.get("owner"), body, pairs[body] if body is not None else m.end())
    spans = sorted((at, *d) for at, d in found.items())
    symbols, edges, calls = [], [], []
    held: list[tuple[int, str, str]] = []  # end, name, kind of the scopes around
    scopes: list[tuple[int, int, str]] = []
    for at, kind, label, base, owner, body, end in spans:
        while held and held[-1][0] < at:
            held.pop()
        around = [n for _, n, _ in held] + ([owner] if owner else [])
        scope = " > ".join([*around, label])
        if kind:
            inside = kind == "function" and held and held[-1][2] in ("", "class", "struct", "trait", "interface", "object", "protocol", "enum")
            symbols.append((path, label, scope, "method" if inside else kind, name, line(at), line(end), lines[line(at) - 1].strip(), None))
            edges.append((" > ".join(around) or path, scope, "defines", 1.0))
        if base:
            edges.append((scope, base, "implements" if not kind else "inherits", 0.9))
        if body is not None:
            held.append((end, label, kind))
            scopes.append((body, end, scope))
    for pattern in own.imports:
        edges += [(path, m["target"], "imports", 0.6) for m in re.finditer(pattern, text) if bare[m.start() : m.end()].strip()]
    for m in _CALL.finditer(bare):
        if m["name"] in _NO_CALLS or m.start("name") in found:
            continue
        caller = max(((b, s) for b, e, s in scopes if b < m.start() < e), default=(0, None))[1]
        if caller:
            receiver = m["receiver"]
            calls.append((caller, path, receiver, f"{receiver}.{m['name']}" if receiver else m["name"], line(m.start())))
    return symbols, edges, calls


def parse(files: DataFrame) -> DataFrame:
    """As ``code.parse``, of files (path, text) in Python or any of LANGUAGES; others, nulls and files beyond
    ``code.MAX_FILE_BYTES`` give nothing."""
    schema = code.SCHEMA
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for path, text, name in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text and name in LANGUAGES and len(text.encode()) <= code.MAX_FILE_BYTES:
                    rows += code.rows_of(path, *scan(path, text, name))
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, types, strict=True)], names)

    known = files.select("path", "text", language(files["path"]).alias("language"))
    return code.parse(known.filter("language = 'python'")).unionByName(known.mapInArrow(run, schema))
