"""Slimming of source code: comments stripped, function bodies elided, definitions and references found.

Python is read by its own tokenizer and parser; languages with braces by a lexer that knows strings, comments and brackets.
Code that can't be read stays as it is.
"""

from __future__ import annotations

import ast
import io
import re
import tokenize
from collections import Counter

import pandas as pd
from pyspark.sql import functions as F

from corpusmill.functions.udf import vectorized

FAMILIES = {
    **dict.fromkeys(("py", "pyi"), "python"),
    **dict.fromkeys(("rs",), "rust"),
    **dict.fromkeys(("js", "jsx", "mjs", "cjs", "ts", "mts", "cts", "tsx"), "script"),
    **dict.fromkeys(("go",), "go"),
    **dict.fromkeys(("java",), "java"),
    **dict.fromkeys(("c", "h", "cpp", "cc", "cxx", "hpp", "hh", "hxx"), "c"),
}
LONGEST_SIGNATURE, MOST_DEFINITIONS = 120, 80


def _splice(text: str, edits: list[tuple[int, int, str]]) -> str:
    """The text with non-overlapping edits; one that overlaps the last is passed over."""
    out, at = [], 0
    for a, b, new in sorted(edits):
        if a >= at:
            out += [text[at:a], new]
            at = b
    return "".join([*out, text[at:]])


def _offsets(text: str) -> list[int]:
    at = [0]
    for line in text.splitlines(keepends=True):
        at.append(at[-1] + len(line))
    return at


_CHAR = re.compile(r"'(\\.[^']*|[^'\\])'")
_REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*")
#: Words after which a slash begins a regular expression, and those that aren't names.
_OPERATORS = frozenset("return typeof case in of new delete void throw do else instanceof await yield".split())
_KEYWORDS = {
    "rust": frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()),
    "script": frozenset("as async await break case catch class const continue debugger default delete do else enum export extends false finally for from function get if implements import in instanceof interface let new null of private protected public return set static super switch this throw true try type typeof undefined var void while with yield".split()),
    "go": frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map nil package range return select struct switch type var true false".split()),
    "java": frozenset("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for if implements import instanceof int interface long native new null package private protected public record return short static super switch synchronized this throw throws try void volatile while true false".split()),
    "c": frozenset("auto bool break case catch char class const constexpr continue default delete do double else enum extern false float for friend goto if inline int long namespace new nullptr operator private protected public register return short signed sizeof static struct switch template this throw true try typedef typename union unsigned using virtual void volatile while".split()),
}


def _before_regex(text: str, i: int) -> bool:
    """Whether a slash at ``i`` can't be a division: what is before it is no value."""
    j = i - 1
    while j >= 0 and text[j] in " \t":
        j -= 1
    if j < 0 or text[j] in "(,=:[!&|?{};+-*%~^<>\n":
        return True
    k = j
    while k >= 0 and (text[k].isalnum() or text[k] in "_$"):
        k -= 1
    return text[k + 1 : j + 1] in _OPERATORS


def _lex(text: str, family: str) -> list[tuple[str, int, int]] | None:
    """(kind, start, end) of comments, strings and brackets; None if something isn't closed."""
    out: list[tuple[str, int, int]] = []
    stack: list[str] = []
    i, n = 0, len(text)
    while i < n:
        c = text[i]
        if text.startswith("//", i):
            j = text.find("\n", i)
            j = n if j < 0 else j
            out.append(("comment", i, j))
        elif text.startswith("/*", i):
            j, level = i + 2, 1
            while level:
                close, opened = text.find("*/", j), text.find("/*", j) if family == "rust" else -1
                if close < 0:
                    return None
                level, j = (level + 1, opened + 2) if 0 <= opened < close else (level - 1, close + 2)
            out.append(("comment", i, j))
        elif c in "\"`" or (c == "'" and (family != "rust" or _CHAR.match(text, i))):
            raw = family == "go" and c == "`"
            j = i + 1
            while j < n and text[j] != c:
                if text[j] == "\n" and c != "`" and family not in ("rust",):
                    return None
                j += 2 if text[j] == "\\" and not raw else 1
            if j >= n:
                return None
            j += 1
            out.append(("string", i, j))
        elif c == "/" and family == "script" and _before_regex(text, i) and (m := _REGEX.match(text, i)):
            j = m.end()
            out.append(("string", i, j))
        elif c in "([{":
            stack.append(c)
            out.append((c, i, i + 1))
            j = i + 1
        elif c in ")]}":
            if not stack or stack.pop() + c not in ("()", "[]", "{}"):
                return None
            out.append((c, i, i + 1))
            j = i + 1
        else:
            j = i + 1
        i = j
    return None if stack else out


def _drop_comment(text: str, a: int, b: int) -> tuple[int, int, str]:
    """The edit for a comment: alone on its line it takes the line, else the blanks before it."""
    start = text.rfind("\n", 0, a) + 1
    end = text.find("\n", b)
    end = len(text) if end < 0 else end
    if not text[start:a].strip() and not text[b:end].strip():
        return start, min(end + 1, len(text)), ""
    while a > start and text[a - 1] in " \t":
        a -= 1
    return a, b, ""


def strip_comments(ext: str, text: str) -> str:
    """The code without comments; as it is if it can't be read."""
    family = FAMILIES.get(ext)
    if family == "python":
        try:
            ast.parse(text)
            at = _offsets(text)
            found = [(at[t.start[0] - 1] + t.start[1], at[t.end[0] - 1] + t.end[1]) for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type == tokenize.COMMENT]
        except (SyntaxError, ValueError, tokenize.TokenError, IndexError):
            return text
    elif family:
        lexed = _lex(text, family)
        if lexed is None:
            return text
        found = [(a, b) for k, a, b in lexed if k == "comment"]
    else:
        return text
    return _splice(text, [_drop_comment(text, a, b) for a, b in found])


_HEADS = {
    "rust": re.compile(r"\bfn\s+\w+[^;{}]*$", re.S),
    "go": re.compile(r"\bfunc\b[^;{}]*$", re.S),
    "script": re.compile(r"(\bfunction\b[^;{}]*|=>\s*|(?:^|[\n;{}])\s*(?:(?:public|private|protected|static|async|override|get|set|readonly)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|with\b)[\w$#]+\s*(?:<[^;{}()]*>)?\([^;{}]*\)\s*(?::[^;{}=]+)?)$", re.S),
    "java": re.compile(r"(?:^|[\n;{}])\s*(?:@\w+(?:\([^)]*\))?\s*)*(?!if\b|for\b|while\b|switch\b|catch\b|try\b|else\b|do\b|synchronized\b|new\b)[\w<>\[\], .?]+\([^;{}]*\)\s*(?:throws\s+[\w, .]+)?$", re.S),
    "c": re.compile(r"(?:^|[\n;{}])\s*(?!if\b|for\b|while\b|switch\b|else\b|do\b)[\w<>\[\]&*:~, ]+\([^;{}]*\)\s*(?:const|noexcept|override|final|\s)*(?::[^;{}]*)?$", re.S),
}


def compress(ext: str, text: str) -> str:
    """The code with function bodies elided, outermost first; as it is if it can't be read or has none."""
    family = FAMILIES.get(ext)
    if family == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return text
        raw = text.encode().splitlines(keepends=True)
        at = _offsets(text)
        edits: list[tuple[int, int, str]] = []

        def visit(node: ast.AST) -> None:
            for child in ast.iter_child_nodes(node):
                if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                    first, last = child.body[0], child.body[-1]
                    a = at[first.lineno - 1] + len(raw[first.lineno - 1][: first.col_offset].decode())
                    b = at[last.end_lineno - 1] + len(raw[last.end_lineno - 1][: last.end_col_offset].decode())
                    edits.append((a, b, "..."))
                else:
                    visit(child)

        visit(tree)
        return _splice(text, edits)
    if family not in _HEADS:
        return text
    lexed = _lex(text, family)
    if lexed is None:
        return text
    plain = list(text)
    for k, a, b in lexed:
        if k in ("comment", "string"):
            plain[a:b] = [" " if c != "\n" else c for c in plain[a:b]]
    code = "".join(plain)
    edits, depth, end = [], 0, -1
    opened = 0
    for k, a, _ in lexed:
        if k == "{":
            if end < 0 and _HEADS[family].search(code[max(0, a - 2000) : a]):
                opened, end = a, depth
            depth += 1
        elif k == "}":
            depth -= 1
            if depth == end:
                edits.append((opened, a + 1, "{ ... }"))
                end = -1
    return _splice(text, edits)


_DEFS = {
    "rust": re.compile(r"\b(?:fn|struct|enum|trait|type|mod|union|macro_rules!|const|static)\s+(\w+)"),
    "script": re.compile(r"\b(?:function\*?|class|interface|type|enum)\s+([\w$]+)|\bconst\s+([\w$]+)\s*=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*=>|(?:^|[\n{};])\s*(?:(?:public|private|protected|static|async)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)([\w$]+)\s*\([^;{}()]*\)\s*\{"),
    "go": re.compile(r"\bfunc\s+(?:\([^)]*\)\s*)?(\w+)|\btype\s+(\w+)"),
    "java": re.compile(r"\b(?:class|interface|enum|record)\s+(\w+)|[\w>\]]\s+(?!if\b|for\b|while\b|switch\b|catch\b)(\w+)\s*\([^;{}()]*\)\s*(?:throws[^{;]*)?\{"),
    "c": re.compile(r"\b(?:struct|class|enum|union|namespace)\s+(\w+)\s*[:{]|[\w*&>]\s+[*&]?(?!if\b|for\b|while\b|switch\b)(\w+)\s*\([^;{}()]*\)\s*\{"),
}


def signature(text: str) -> str:
    """White space collapsed, the opening of the body dropped, at most LONGEST_SIGNATURE characters."""
    s = " ".join(text.split()).rstrip("{: ")
    return s if len(s) <= LONGEST_SIGNATURE else s[:LONGEST_SIGNATURE] + "…"


def tags(ext: str, text: str) -> tuple[list[tuple[str, str]], list[str]]:
    """([(name, signature)] of the definitions in their order, names referred to, with repeats); nothing if the code can't be read."""
    family = FAMILIES.get(ext)
    if family == "python":
        try:
            tree = ast.parse(text)
        except (SyntaxError, ValueError):
            return [], []
        lines = text.splitlines()
        found = []
        for node in ast.walk(tree):
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                head = "\n".join(lines[node.lineno - 1 : max(node.lineno, node.body[0].lineno - 1)])
                found.append((node.lineno, node.name, signature(head)))
        refs = [n.id for n in ast.walk(tree) if isinstance(n, ast.Name)] + [n.attr for n in ast.walk(tree) if isinstance(n, ast.Attribute)]
        return [(n, s) for _, n, s in sorted(found)][:MOST_DEFINITIONS], refs
    if family is None or (lexed := _lex(text, family)) is None:
        return [], []
    plain = list(text)
    for k, a, b in lexed:
        if k in ("comment", "string"):
            plain[a:b] = [" " if c != "\n" else c for c in plain[a:b]]
    code = "".join(plain)
    defs = []
    for m in _DEFS[family].finditer(code):
        name = next(g for g in m.groups() if g)
        start = code.rfind("\n", 0, m.start(m.lastindex)) + 1
        stop = re.compile(r"[{;]").search(code, m.end(m.lastindex))
        defs.append((name, signature(code[start : stop.start() if stop else len(code)])))
    own = Counter(n for n, _ in defs)
    refs = []
    for n in re.findall(r"[A-Za-z_$][\w$]*", code):
        # a definition's own name is no reference
        if own[n] > 0:
            own[n] -= 1
        elif n not in _KEYWORDS[family]:
            refs.append(n)
    return defs[:MOST_DEFINITIONS], refs


def slim_text(ext: str, text: str, comments: bool = True, bodies: bool = True) -> tuple[str, bool]:
    """(text, whether bodies were elided): comments go first, as elided code can't be read any more."""
    out = strip_comments(ext, text) if comments else text
    short = compress(ext, out) if bodies else out
    return short, short != out


@vectorized("struct<text:string,compressed:boolean>")
def slim(ext: pd.Series, text: pd.Series) -> pd.DataFrame:
    """``slim_text`` over columns."""
    return pd.DataFrame([(None, None) if t is None else slim_text(e or "", t) for e, t in zip(ext, text, strict=True)], columns=["text", "compressed"])


@vectorized("struct<defs:array<struct<name:string,sig:string>>,refs:array<string>>")
def tagged(ext: pd.Series, text: pd.Series) -> pd.DataFrame:
    """``tags`` over columns."""
    found = [tags(e or "", t or "") for e, t in zip(ext, text, strict=True)]
    return pd.DataFrame({"defs": [[{"name": n, "sig": s} for n, s in d] for d, _ in found], "refs": [r for _, r in found]})
