"""Parsing of source text as data: tolerant trees, node rows, constant folding. Nothing is ever compiled to code or run."""

from __future__ import annotations

import ast
import base64
import binascii
import codecs
import re
import warnings
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from causeway.runtime import ship

#: Repairs tried on a whole file that does not parse, before its blocks are repaired one by one; nesting followed; bounds of folding (fixed values).
REPAIRS, NESTING = 60, 200
FOLD_DEPTH, FOLD_BYTES, FOLD_NESTING = 8, 1 << 20, 256

KINDS = {
    ast.Module: "module", ast.FunctionDef: "function_def", ast.AsyncFunctionDef: "function_def", ast.ClassDef: "class_def", ast.Lambda: "lambda", ast.arguments: "parameters", ast.arg: "parameter",
    ast.Call: "call", ast.keyword: "keyword_argument", ast.Attribute: "attribute", ast.Subscript: "subscript", ast.Name: "identifier", ast.Assign: "assignment", ast.AnnAssign: "assignment",
    ast.AugAssign: "augmented_assignment", ast.Import: "import", ast.ImportFrom: "import_from", ast.alias: "import_alias", ast.Return: "return", ast.If: "if", ast.For: "for", ast.AsyncFor: "for", ast.comprehension: "for",
    ast.While: "while", ast.Try: "try", ast.TryStar: "try", ast.ExceptHandler: "try", ast.With: "with", ast.AsyncWith: "with", ast.BinOp: "binary_operator", ast.BoolOp: "binary_operator", ast.UnaryOp: "unary_operator",
    ast.Compare: "comparison", ast.JoinedStr: "string", ast.List: "list", ast.Tuple: "tuple", ast.Dict: "dict", ast.Set: "set", ast.ListComp: "comprehension", ast.SetComp: "comprehension", ast.DictComp: "comprehension",
    ast.GeneratorExp: "comprehension", ast.IfExp: "conditional_expression", ast.Await: "await", ast.Yield: "yield", ast.YieldFrom: "yield", ast.Global: "global", ast.Nonlocal: "nonlocal",
}


def _whole(text: str) -> ast.Module:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        return ast.parse(text)


_TOKEN = re.compile(r"""(?s)#[^\n]*|\\.|('''|\"\"\")(?:[^\\]|\\.)*?\1|'(?:[^'\\\n]|\\.)*'|"(?:[^"\\\n]|\\.)*"|[(\[{]|[)\]}]|\n""")
_STATEMENT = re.compile(r"\s*(?:(?:def|class|import|from|with|while|try|return|raise|del|pass|global|assert)\b|@)")
_CLAUSE = re.compile(r"\s*(elif|else|except|finally|if|for|while|try|with|def|class|async|match|case)\b")
#: What a clause may follow.
_AFTER = {"elif": {"if", "elif"}, "else": {"if", "elif", "for", "while", "except"}, "except": {"try", "except"}, "finally": {"try", "except", "else of try"}}
_PAIRS = {")": "(", "]": "[", "}": "{"}


def _ends(lines: list[str]) -> list[int]:
    """For each line the last line that strings, brackets and continuations begun on it reach; open ones reach no further."""
    ends, open_, line = list(range(len(lines))), [], 0
    for m in _TOKEN.finditer("\n".join(lines)):
        x = m[0]
        if x == "\n":
            line += 1
            if open_ and _STATEMENT.match(lines[line]):
                open_.clear()
        elif x in "([{":
            open_.append((x, line))
        elif x in _PAIRS:
            if open_ and open_[-1][0] == _PAIRS[x]:
                begin = open_.pop()[1]
                ends[begin] = max(ends[begin], line)
        elif n := x.count("\n"):
            ends[line] = max(ends[line], line + n)
            line += n
    return ends


def _indent(line: str) -> int:
    return len((m := re.match(r"[ \t\f]*", line)[0]).expandtabs(8)) if line else 0


def _parses(text: str) -> bool:
    try:
        _whole("if 1:\n" + text if text[:1] in (" ", "\t", "\f") else text)
        return True
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False


def _mended(lines: list[str]) -> int:
    """Repairs in place, block by block: an error costs its own statement, or the clause that heads a block but not the block.

    Every block is parsed once at each level of nesting, so the work grows with the text and not with the number of errors.
    """
    ends, errors, logical, k = _ends(lines), 0, [], 0
    while k < len(lines):
        begin = last = k
        while k <= last:
            last = max(last, ends[k])
            k += 1
        if lines[begin].strip() and not lines[begin].lstrip().startswith("#"):
            logical.append((begin, k))

    def drop(a: int, b: int) -> None:
        lines[a:b] = [re.match(r"[ \t\f]*", lines[a])[0] + "pass", *[""] * (b - a - 1)]

    todo = [(0, len(logical))]
    while todo:
        lo, hi = todo.pop()
        if _parses("\n".join(lines[logical[lo][0] : logical[hi - 1][1]]) if lo < hi else ""):
            continue
        base = re.match(r"[ \t\f]*", lines[logical[lo][0]])[0]
        width, groups = _indent(base), []
        for k in range(lo, hi):
            if not groups or _indent(lines[logical[k][0]]) <= width:
                groups.append([k, k + 1])
            else:
                groups[-1][1] = k + 1
        kind, tried = "", None
        for g, (first, end) in enumerate(groups):
            a, b = logical[first]
            if not lines[a].startswith(base) or _indent(lines[a]) != width:
                lines[a] = base + lines[a].lstrip()
                errors += 1
            head, text = "\n".join(lines[a:b]), lines[a].lstrip()
            m = _CLAUSE.match(lines[a])
            word = m[1] if m else ""
            body = end - first > 1
            if tried is not None and word not in ("except", "finally"):
                lines[tried] = base + "if 1:"
                errors += 1
            tried = None
            if not body and _parses(head) and not (word in _AFTER):
                kind = word if word in ("if", "for", "while") else ""
                continue
            if text.startswith("@"):
                after = lines[logical[groups[g + 1][0]][0]].lstrip() if g + 1 < len(groups) else ""
                if body or not re.match(r"@|(?:async\s+)?def\b|class\b", after) or not _parses(f"{head}\n{base}def f(): pass"):
                    drop(a, b)
                    errors += 1
                kind = ""
            else:
                inner = base + " "
                opens = f"{base}{ {'elif': 'if 1:', 'else': 'if 1:', 'except': 'try:', 'finally': 'try:', 'case': 'match x:'}.get(word, '') }\n"
                shell = (opens + (inner + head.lstrip() + f"\n{inner} pass" if word == "case" else (f"{inner}pass\n" if opens.strip() else "") + head + (f"\n{inner}pass" if body else ""))).lstrip("\n")
                if word == "try":
                    shell += f"\n{base}finally:\n{inner}pass"
                fits = word not in _AFTER or kind in _AFTER[word]
                if not fits or word == "case" and width == 0 or not _parses(shell):
                    errors += 1
                    drop(a, b)
                    if body:
                        lines[a] = base + "if 1:"
                    kind = "if" if body else ""
                else:
                    kind = "else of try" if word == "else" and kind == "except" else "" if word in ("else", "finally") else word
                    tried = a if word == "try" else None
            if body:
                todo.append((first + 1, end))
        if tried is not None:
            lines[tried] = base + "if 1:"
            errors += 1
    return errors


def _replaced(lines: list[str], lo: int, hi: int) -> tuple[ast.Module, int]:
    """The tree of a block, after as many repairs of a line as it takes: each ends as ``pass`` or empty."""
    errors = 0
    while True:
        try:
            return _whole("\n".join(lines[lo:hi])), errors
        except SyntaxError as e:
            at = lo + min(max((e.lineno or 1) - 1, 0), hi - lo - 1)
        except (ValueError, RecursionError, MemoryError):
            at = lo
        errors += 1
        if not lines[at].strip():
            at = next(k for k in range(lo, hi) if lines[k].strip())
        new = re.match(r"\s*", lines[at])[0] + "pass"
        lines[at] = "" if lines[at] == new else new


def parse(text: str) -> tuple[ast.Module, str, int]:
    """P-01: a tree of any text, the text it is of, and the number of places that did not parse.

    A line that fails is replaced by ``pass`` of the same indentation and the text is tried again, at most REPAIRS times. What
    does not parse then is repaired block by block from the text as it was, and what still fails as a whole is parsed a top-level block at a time.
    """
    lines = text.replace("\0", " ").encode("utf-8", "replace").decode().split("\n")
    own = list(lines)
    errors = 0
    for _ in range(REPAIRS):
        try:
            return _whole("\n".join(lines)), "\n".join(lines), errors
        except SyntaxError as e:
            errors += 1
            at = min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            old = lines[at]
            lines[at] = re.match(r"\s*", old)[0] + "pass"
            if lines[at] == old:
                lines[at] = ""
                if not old:
                    break
        except (ValueError, RecursionError, MemoryError):
            break
    errors = _mended(own)
    try:
        return _whole("\n".join(own)), "\n".join(own), errors
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    ends, starts, k = _ends(own), [0], 0
    while k < len(own):
        if k and own[k].strip() and own[k][0] not in " \t\f#" and not re.match(r"(?:elif|else|except|finally)\b", own[k]) and not own[starts[-1]].startswith("@"):
            starts.append(k)
        last = k
        while k <= last:
            last = max(last, ends[k])
            k += 1
    body: list[ast.stmt] = []
    for lo, hi in zip(starts, [*starts[1:], len(own)]):
        tree, more = _replaced(own, lo, hi)
        errors += more
        body += ast.increment_lineno(tree, lo).body
    return ast.Module(body, []), "\n".join(own), errors


def kind_of(node: ast.AST) -> str:
    """P-02."""
    if isinstance(node, ast.Constant):
        v = node.value
        return "bool" if isinstance(v, bool) else "none_literal" if v is None else "string" if isinstance(v, (str, bytes)) else "integer" if isinstance(v, int) else "float" if isinstance(v, float) else "other"
    return KINDS.get(type(node), "other")


NODES = "dist_id string, path string, node_id int, parent_id int, kind string, field string, start_line int, start_col int, end_line int, end_col int, text string"


def node_rows(text: str, dist: str, path: str) -> list[tuple]:
    """P-01, P-04..P-06: nodes in pre-order; lines and columns from 1, columns in bytes. Errors are nodes of kind ``error``."""
    tree, used, errors = parse(text)
    lines = used.split("\n")
    out: list[tuple] = []
    stack: list[tuple] = [(tree, None, None)]
    while stack:
        node, parent, field = stack.pop()
        me = len(out)
        line, col, end, stop = (getattr(node, a, None) for a in ("lineno", "col_offset", "end_lineno", "end_col_offset"))
        source = None
        if line is not None and not isinstance(node, ast.stmt):
            raw = [x.encode() for x in lines[line - 1 : end]]
            if raw:
                raw[-1] = raw[-1][:stop]
                raw[0] = raw[0][col:]
                source = b"\n".join(raw).decode("utf-8", "replace")
        out.append((dist, path, me, parent, kind_of(node), field, line, None if col is None else col + 1, end, None if stop is None else stop + 1, source))
        kids = [(k, name) for name, v in ast.iter_fields(node) for k in (v if isinstance(v, list) else [v]) if isinstance(k, ast.AST) and not isinstance(k, (ast.expr_context, ast.operator, ast.unaryop, ast.cmpop, ast.boolop))]
        stack += [(k, me, name) for k, name in reversed(kids)]
    out += [(dist, path, len(out) + k, 0, "error", None, None, None, None, None, None) for k in range(errors)]
    return out


def parse_files(files: DataFrame) -> DataFrame:
    """P-03: nodes of all files (dist_id, path, text); a file is a row's work, partitions run in parallel."""
    ship(files.sparkSession)
    names = [x.split()[0] for x in NODES.split(", ")]
    kinds = {"string": pa.string(), "int": pa.int32()}
    types = [kinds[x.split()[1]] for x in NODES.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dist, path, text in zip(*(b.column(c).to_pylist() for c in ("dist_id", "path", "text"))):
                rows = node_rows(text or "", dist, path)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return files.select("dist_id", "path", "text").mapInArrow(run, NODES)


_LITERAL = re.compile(r"""(?s)^([A-Za-z]{0,2})('''|\"\"\"|'|")(.*)\2$""")


def str_literal(raw: str) -> str | None:
    """P-07: a string literal as written, without prefix and quotes; none for an f-string or no literal."""
    m = _LITERAL.match(raw.strip())
    return None if m is None or "f" in m[1].lower() else m[3]


def fstring_template(node: ast.JoinedStr) -> str | None:
    """P-08: the fixed text with ``{}`` for each hole; none if there are only holes."""
    parts = ["{}" if isinstance(v, ast.FormattedValue) else str(v.value) for v in node.values]
    return "".join(parts) if any(p != "{}" for p in parts) else None


def _plain_bytes(v: str | bytes) -> bytes | None:
    return v if isinstance(v, bytes) else v.encode("utf-8", "surrogatepass")


def _base64(data: bytes, urlsafe: bool) -> bytes | None:
    bare = bytes(c for c in data if c not in b" \t\n\r\x0b\x0c=")
    if len(bare) % 4 == 1 or not re.fullmatch(rb"[A-Za-z0-9_-]*" if urlsafe else rb"[A-Za-z0-9+/]*", bare):
        return None
    return base64.b64decode(bare + b"=" * (-len(bare) % 4), b"-_" if urlsafe else None)


def _hex(data: bytes) -> bytes | None:
    bare = bytes(c for c in data if c not in b" \t\n\r\x0b\x0c")
    try:
        return binascii.unhexlify(bare)
    except (binascii.Error, ValueError):
        return None


_UNFOLDED = frozenset("zlib.decompress gzip.decompress bz2.decompress lzma.decompress base64.b32decode base64.b85decode base64.a85decode".split())


def fold(node: ast.AST, level: int = 0) -> tuple[bytes, int] | None:
    """P-09, P-10: the bytes of a constant expression and how many transforms it took; none if it is not one.

    Concatenation, repetition, reversal, chr, join, encode and decode, base64, hexadecimal, rot13. Decompression and the rarer bases are
    declined on purpose.
    """
    if level > FOLD_NESTING:
        return None
    got = _fold(node, level + 1)
    return None if got is None or got[1] > FOLD_DEPTH or len(got[0]) > FOLD_BYTES else got


def _each(nodes: list[ast.AST], level: int) -> tuple[list[bytes], int] | None:
    got = [fold(n, level) for n in nodes]
    return None if any(g is None for g in got) else ([g[0] for g in got], max((g[1] for g in got), default=0))


def _fold(node: ast.AST, level: int) -> tuple[bytes, int] | None:
    if isinstance(node, ast.Constant):
        return (_plain_bytes(node.value), 0) if isinstance(node.value, (str, bytes)) else None
    if isinstance(node, ast.BinOp):
        if isinstance(node.op, ast.Add):
            got = _each([node.left, node.right], level)
            return got and (b"".join(got[0]), got[1])
        if isinstance(node.op, ast.Mult):
            for a, b in ((node.left, node.right), (node.right, node.left)):
                if isinstance(b, ast.Constant) and isinstance(b.value, int) and not isinstance(b.value, bool) and (got := fold(a, level)):
                    return (got[0] * b.value, got[1] + 1) if 0 <= b.value * len(got[0]) <= FOLD_BYTES else None
        return None
    if isinstance(node, ast.Subscript):
        s = node.slice
        back = isinstance(s, ast.Slice) and s.lower is None and s.upper is None and isinstance(s.step, ast.UnaryOp) and isinstance(s.step.op, ast.USub) and isinstance(s.step.operand, ast.Constant) and s.step.operand.value == 1
        got = fold(node.value, level) if back else None
        return got and (got[0][::-1], got[1] + 1)
    return _fold_call(node, level) if isinstance(node, ast.Call) and not node.keywords else None


def _fold_call(node: ast.Call, level: int) -> tuple[bytes, int] | None:
    text = ast.unparse(node.func) if isinstance(node.func, (ast.Name, ast.Attribute)) else ""
    name, args = text if re.fullmatch(r"[\w.]+", text) else "", node.args
    if name == "chr" and len(args) == 1 and isinstance(args[0], ast.Constant) and isinstance(args[0].value, int):
        v = args[0].value
        return (chr(v).encode("utf-8", "surrogatepass"), 1) if 0 <= v < 0x110000 else None
    if name == "reversed" and len(args) == 1:
        got = fold(args[0], level)
        return got and (got[0][::-1], got[1] + 1)
    if name in _UNFOLDED or not args and not isinstance(node.func, ast.Attribute):
        return None
    if isinstance(node.func, ast.Attribute):
        method = node.func.attr
        if method == "join" and len(args) == 1:
            glue, parts = fold(node.func.value, level), None
            if isinstance(args[0], (ast.List, ast.Tuple)):
                parts = _each(args[0].elts, level)
            elif isinstance(args[0], ast.Call) and (got := fold(args[0], level)):
                parts = ([got[0][k : k + 1] for k in range(len(got[0]))], got[1])
            return (glue[0].join(parts[0]), max(glue[1], parts[1]) + 1) if glue and parts else None
        if method in ("encode", "decode") and not name.startswith(("base64.", "codecs.")):
            return fold(node.func.value, level)
    if len(args) >= 1 and (got := fold(args[0], level)):
        data, n = got
        kind = args[1].value if len(args) > 1 and isinstance(args[1], ast.Constant) else None
        if name in ("base64.b64decode", "base64.standard_b64decode", "base64.decodebytes", "binascii.a2b_base64"):
            out = _base64(data, False)
        elif name == "base64.urlsafe_b64decode":
            out = _base64(data, True)
        elif name in ("base64.b16decode", "binascii.unhexlify", "binascii.a2b_hex", "bytes.fromhex"):
            out = _hex(data)
        elif name == "codecs.decode" and kind in ("rot13", "rot_13"):
            out = codecs.encode(data.decode("utf-8", "replace"), "rot13").encode()
        elif name == "codecs.decode" and kind in ("hex", "base64"):
            out = _hex(data) if kind == "hex" else _base64(data, False)
        else:
            return None
        return None if out is None else (out, n + 1)
    return None
