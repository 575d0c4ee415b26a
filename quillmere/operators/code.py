"""Declarations, dependencies and structural search in source files.

Patterns are matched by Spark's own functions; only what needs Python's parser runs in Python, a file at a time within
Arrow batches, and a file that can't be parsed is a row with a status, not a missing row.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmere.functions import catalogs
from quillmere.functions import columns as C


def symbols(files: DataFrame, language: str, path: str = "path", text: str = "text") -> DataFrame:
    """file, line, kind, name: the first pattern of the language that matches a line; approximate, as no parser is used."""
    patterns = catalogs.SYMBOL_PATTERNS[language]
    kept = files.where(C.extension(F.col(path)).isin(*catalogs.SYMBOL_EXTENSIONS[language]))

    def found(x: Column) -> Column:
        return F.coalesce(*(F.when(x.rlike(rx), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(x, rx, 1).alias("name"))) for kind, rx in patterns))

    rows = kept.select(F.col(path).alias("file"), F.transform(C.lines_of(F.col(text)), lambda x, i: F.struct((i + 1).alias("line"), found(x).alias("s"))).alias("found"))
    rows = rows.select("file", F.inline(F.filter("found", lambda m: m["s"].isNotNull()))).select("file", "line", "s.kind", "s.name")
    return rows.where(~F.col("name").isin(*catalogs.CONTROL_WORDS)) if language in ("c", "cpp") else rows


def symbol_counts(found: DataFrame, files: DataFrame, path: str = "path") -> DataFrame:
    """file, symbol_count of every file, 0 of those without any."""
    counts = found.groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    return files.select(F.col(path).alias("file")).join(counts, "file", "left").select("file", F.coalesce("n", F.lit(0).cast("long")).alias("symbol_count"))


def dependencies(files: DataFrame, language: str, path: str = "path", text: str = "text") -> DataFrame:
    """file, targets: distinct and sorted imports, includes, loads or project references."""
    p = catalogs.DEPENDENCY_PATTERNS
    t = F.coalesce(C.unified_newlines(F.col(text)), F.lit(""))
    every = lambda rx: F.regexp_extract_all(t, F.lit(f"(?m){rx}"), 1)
    if language == "python":
        listed = F.flatten(F.transform(every(p["python_import"]), lambda m: F.split(m, ",")))
        found = F.concat(F.transform(listed, lambda m: F.regexp_extract(m, r"([A-Za-z0-9_.]+)", 1)), every(p["python_from"]))
    elif language in ("c", "cpp"):
        found = every(p["include"])
    elif language == "gdscript":
        found = F.concat(every(p["load"]), every(p["extends"]))
    elif language == "csharp":
        found = F.transform(every(p["project_reference"]), lambda m: F.replace(m, F.lit("\\"), F.lit("/")))
    elif language == "go":
        blocks = F.regexp_extract_all(t, F.lit(r"(?s)import\s*\(([^)]*)\)"), 1)
        found = F.concat(F.flatten(F.transform(blocks, lambda b: F.regexp_extract_all(b, F.lit('"([^"]+)"'), 1))), every(r"""^\s*import\s+(?:[\w.]+\s+)?"([^"]+)""" + '"'))
    else:
        raise ValueError(f"no dependency patterns for {language}")
    return files.select(F.col(path).alias("file"), F.array_sort(F.array_distinct(found)).alias("targets"))


def _python_rows(source: str) -> tuple[str, list, list]:
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return "parse_failed", [], []
    kinds = {ast.ClassDef: "class", ast.FunctionDef: "func", ast.AsyncFunctionDef: "async_func"}
    found, imports = [], set()
    for node in ast.walk(tree):
        if type(node) in kinds:
            found.append({"kind": kinds[type(node)], "name": node.name, "line": node.lineno, "end_line": node.end_lineno})
        elif isinstance(node, ast.Import):
            imports |= {a.name for a in node.names}
        elif isinstance(node, ast.ImportFrom):
            imports.add("." * node.level + (node.module or ""))
    return "ok", sorted(found, key=lambda s: (s["line"], s["name"])), sorted(imports)


def python_ast(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """file, status, symbols array<struct<kind, name, line, end_line>>, imports: from the syntax tree; relative imports
    keep their dots."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [_python_rows(t or "") for t in batch["text"]]
            yield pd.DataFrame({"file": batch["path"], "status": [r[0] for r in rows], "symbols": [r[1] for r in rows], "imports": [r[2] for r in rows]})

    return files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, "file string, status string, symbols array<struct<kind:string,name:string,line:int,end_line:int>>, imports array<string>")


HOLE = "quillmere_hole_"


def compiled_pattern(pattern: str) -> ast.AST:
    """A Python expression or statement in which $NAME stands for any part, the same one wherever it stands."""
    if "$$$" in pattern:
        raise ValueError("a part that stands for several is not supported")
    tree = ast.parse(re.sub(r"\$([A-Z_][A-Z0-9_]*)", rf"{HOLE}\1", pattern)).body
    if len(tree) != 1:
        raise ValueError("a pattern is one expression or statement")
    return tree[0].value if isinstance(tree[0], ast.Expr) else tree[0]


def hole(pattern: object) -> str | None:
    """The name of a part that stands for any: a name, or a name that the tree holds as a string (of an attribute, function,
    argument, keyword or import)."""
    name = pattern.id if isinstance(pattern, ast.Name) else pattern
    return name.removeprefix(HOLE) if isinstance(name, str) and name.startswith(HOLE) else None


def alike(a: object, b: object) -> bool:
    return ast.dump(a) == ast.dump(b) if isinstance(a, ast.AST) and isinstance(b, ast.AST) else type(a) is type(b) and a == b


def unified(pattern: object, node: object, captures: dict[str, object]) -> bool:
    """Whether a pattern fits a part of a tree, with what its names stand for; a name stands for the same wherever it is, and for
    something, so not for what a node lacks."""
    name = hole(pattern)
    if name is not None:
        return node is not None and alike(captures.setdefault(name, node), node)
    if isinstance(pattern, ast.AST):
        if type(pattern) is not type(node):
            return False
        return all(unified(getattr(pattern, f, None), getattr(node, f, None), captures) for f in pattern._fields if f not in ("ctx", "type_comment", "kind"))
    if isinstance(pattern, list):
        return isinstance(node, list) and len(pattern) == len(node) and all(unified(p, n, captures) for p, n in zip(pattern, node, strict=True))
    return type(pattern) is type(node) and pattern == node


def required(pattern: ast.AST) -> list[str]:
    """Words that any ASCII source with a match has as they stand: the names of the pattern. Sources with other characters may
    write a name in another form, and text within strings may be escaped, so these aren't tested."""
    words = set()
    for node in ast.walk(pattern):
        for field, value in ast.iter_fields(node):
            found = value if isinstance(value, list) else [value]
            if isinstance(node, ast.Constant) or field in ("ctx", "type_comment", "kind"):
                continue
            words |= {w for v in found if isinstance(v, str) and hole(v) is None for w in v.split(".") if w.isascii() and w.isidentifier()}
    return sorted(words)


class Source:
    """A text with the starts of its lines, so a part of it is cut without going through all of it."""

    def __init__(self, text: str) -> None:
        self.lines = _LINE.findall(text)
        self.encoded: dict[int, bytes] = {}

    def line(self, i: int) -> bytes:
        if i not in self.encoded:
            self.encoded[i] = self.lines[i].encode()
        return self.encoded[i]

    def segment(self, node: object) -> str | None:
        """The text of a node that has a place; columns are in bytes."""
        if getattr(node, "end_lineno", None) is None:
            return None
        first, last = node.lineno - 1, node.end_lineno - 1
        if first == last:
            return self.line(first)[node.col_offset : node.end_col_offset].decode()
        return self.line(first)[node.col_offset :].decode() + "".join(self.lines[first + 1 : last]) + self.line(last)[: node.end_col_offset].decode()


#: A line as Python's parser counts them: form feeds and other separators end none.
_LINE = re.compile(r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+$")


MATCH = "file string, status string, line int, column int, end_line int, end_column int, matched_text string, captures map<string,string>"


def structural_search(files: DataFrame, pattern: str, path: str = "path", text: str = "text", text_width: int = 240, capture_width: int = 120, failures: bool = True) -> DataFrame:
    """A row for each part of a file's syntax tree that the pattern fits, and one with status parse_failed for a file
    without a tree. Without failures only files that have all names of the pattern are handed to the parser at all."""
    wanted = compiled_pattern(pattern)
    for word in required(wanted) if not failures else []:
        files = files.where(F.contains(F.col(text), F.lit(word)) | F.rlike(F.col(text), F.lit(r"[^\x00-\x7F]")))

    def told(value: object, source: Source) -> str:
        return str(value) if not isinstance(value, ast.AST) else source.segment(value) or ast.unparse(value)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = compiled_pattern(pattern)
        kind, words = type(wanted), required(wanted)
        for batch in batches:
            out = []
            for file, text_ in zip(batch["path"], batch["text"], strict=True):
                try:
                    tree = ast.parse(text_ or "")
                except (SyntaxError, ValueError, RecursionError):
                    if failures:
                        out.append((file, "parse_failed", None, None, None, None, None, None))
                    continue
                if (text_ or "").isascii() and not all(w in (text_ or "") for w in words):
                    continue
                source = Source(text_ or "")
                for node in ast.walk(tree):
                    captures: dict[str, object] = {}
                    if (type(node) is kind or hole(wanted) is not None) and hasattr(node, "lineno") and unified(wanted, node, captures):
                        out.append((file, "ok", node.lineno, node.col_offset + 1, node.end_lineno, node.end_col_offset + 1, (source.segment(node) or "")[:text_width], {k: told(v, source)[:capture_width] for k, v in captures.items()}))
            frame = pd.DataFrame(out, columns=[c.split()[0] for c in MATCH.split(", ")])
            yield frame.astype({c: "Int32" for c in ("line", "column", "end_line", "end_column")})

    return files.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, MATCH)


# ---- Go ---------------------------------------------------------------------------------------------------------------

#: Comments, strings, runes, names, line ends and signs, in the order in which they are tried. What isn't closed runs to the end
#: of its line, or of the text; the scanner tells it.
_GO = re.compile(r"""(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<raw>`[^`]*`)|(?P<string>"(?:[^"\\\n]|\\[^\n])*")|(?P<rune>'(?:[^'\\\n]|\\[^\n])+')|(?P<name>[^\W\d]\w*)|(?P<number>\d\w*)|(?P<open>/\*|[`"'])|(?P<end>\n)|(?P<space>[ \t\r]+)|(?P<sign>.)""", re.DOTALL)
#: Names after which, or signs after which, a line end isn't the end of a statement, are all others than these.
_ENDS = frozenset("break continue fallthrough return".split()), frozenset(")]}")
#: The keywords of Go.
GO_KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())


class _Unread(ValueError):
    """A source that isn't Go as far as the scanner goes."""


def go_tokens(source: str) -> Iterator[tuple[str, str, int]]:
    """(kind, text, line) of what isn't a comment or space. A line end that ends a statement is the sign ``;``, also one within a
    comment of several lines."""
    line, ends = 1, False
    for m in _GO.finditer(source):
        kind, text = m.lastgroup, m.group()
        if kind == "open":
            raise _Unread(f"line {line}: {text} isn't closed")
        if kind in ("end", "comment"):
            if ends and "\n" in text:
                yield "sign", ";", line
                ends = False
        elif kind != "space":
            yield kind, text, line
            ends = text in _ENDS[0] or text not in GO_KEYWORDS if kind == "name" else kind != "sign" or text in _ENDS[1]
            ends = ends or text in "+-" and kind == "sign" and source[m.start() - 1 : m.end()] in ("++", "--")
        line += text.count("\n")
    if ends:
        yield "sign", ";", line


def go_source(source: str) -> tuple[str, list[dict], list[str]]:
    """status, declarations at the top level (kind package, type or func, name, line) and imports. Braces and brackets are counted, so
    nothing within a body, comment or string is a declaration."""
    try:
        tokens = list(go_tokens(source))
        found, imports, depth = [], set(), 0
        pairs = {")": "(", "]": "[", "}": "{"}
        opened: list[str] = []
        state = ""  # what the statement is that is being read: "" at its start, else a keyword, or - for anything else
        inner = 0  # brackets open where the names of a group in brackets stand
        fresh = False  # whether a name of a group may come now
        for kind, text, line in tokens:
            if kind == "sign" and text in "([{":
                opened.append(text)
                if state in ("type", "import") and text == "(" and len(opened) == 1 and fresh:
                    inner = 1
                continue
            if kind == "sign" and text in ")]}":
                if not opened or opened.pop() != pairs[text]:
                    raise _Unread(f"line {line}: {text} closes nothing")
                if inner and not opened:
                    inner, fresh = 0, False
                continue
            depth = len(opened)
            if kind == "sign" and text == ";":
                if depth == 0:
                    state, fresh = "", False
                elif inner and depth == 1:
                    fresh = True
                continue
            if depth == 0 and not state:
                if not found and (kind, text) != ("name", "package"):
                    raise _Unread(f"line {line}: no package")
                if kind != "name" or text not in ("package", "import", "type", "func", "var", "const"):
                    raise _Unread(f"line {line}: {text} begins no declaration")
                state, fresh, at = text, True, line
            elif state == "import" and depth == inner:
                if kind in ("string", "raw") and fresh:
                    imports.add(ast.literal_eval(text) if kind == "string" else text[1:-1])
                    fresh = False
            elif state in ("package", "type", "func") and kind == "name" and fresh and depth == (inner if state == "type" else 0):
                # a type is told at its name, a function at its keyword
                found.append({"kind": state, "name": text, "line": at if state == "func" else line})
                fresh = False
        if opened:
            raise _Unread(f"{opened[-1]} isn't closed")
        if not found:
            raise _Unread("no package")
    except (ValueError, SyntaxError):
        return "parse_failed", [], []
    return "ok", found, sorted(imports - {""})


def go_syntax(files: DataFrame, path: str = "path", text: str = "text") -> DataFrame:
    """file, status, symbols array<struct<kind, name, line>>, imports of each Go source, read by a scanner that knows comments,
    strings and brackets; a source that it can't follow is parse_failed. A null text is an empty one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [go_source(t or "") for t in batch["text"]]
            yield pd.DataFrame({"file": batch["path"], "status": [r[0] for r in rows], "symbols": [r[1] for r in rows], "imports": [r[2] for r in rows]})

    kept = files.where(C.extension(F.col(path)).isin(*catalogs.SYMBOL_EXTENSIONS["go"]))
    return kept.select(F.col(path).alias("path"), F.col(text).alias("text")).mapInPandas(run, "file string, status string, symbols array<struct<kind:string,name:string,line:int>>, imports array<string>")
