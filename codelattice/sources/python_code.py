"""Symbols, imports and call sites of Python source.

The standard library's parser reads whole files. It gives nothing for a file with a syntax error; in such a
file, which is flagged, the line at fault is mended (a definition keeps its name, any other statement
becomes a pass) until the rest can be read, however many these are, and the calls of mended lines are found by
a pattern. Statements of the top level that can be read are settled, so each mend reads on from the last of them.
Only a file in which a mended line is still at fault is scanned line by line, for definitions, imports and calls.
"""

from __future__ import annotations

import ast
import inspect
import re

from .model import Found

_DEF = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+(\w+)\s*(\(.*)?")
_IMPORT = re.compile(r"^\s*import\s+(.+)$")
_FROM = re.compile(r"^\s*from\s+(\.*[\w.]*)\s+import\s+\(?(.+?)\)?\s*$")
_CALL = re.compile(r"(?:([\w.]+)\s*\.\s*)?\b(\w+)\s*\(")
#: Lines of the top level that do not begin a statement.
_GOES_ON = re.compile(r"[\s#)\]}]|(?:else|elif|except|finally|case)\b|$")
_KEYWORDS = frozenset("if elif while for return not and or in is lambda with assert del yield await print except def class import from raise".split())


def module_of(path: str, packages: set[str]) -> tuple[str, bool]:
    """(dotted module, whether the file is a package's own) of a path; packages: directories with __init__.py, or below one."""
    parts = path.removesuffix(".py").split("/")
    is_package = parts[-1] == "__init__"
    names = [] if is_package else [parts[-1]]
    folders = parts[:-1]
    if is_package and not folders:
        return "__init__", True
    while folders and "/".join(folders) in packages:
        names.insert(0, folders.pop())
    return ".".join(names), is_package


def package_dirs(paths: list[str]) -> set[str]:
    """Directories with an __init__.py, and directories below one of these."""
    own = {p.rpartition("/")[0] for p in paths if p == "__init__.py" or p.endswith("/__init__.py")} - {""}
    out = set(own)
    for p in paths:
        folder = p.rpartition("/")[0]
        above = folder
        while above:
            if above in own:
                while folder != above:
                    out.add(folder)
                    folder = folder.rpartition("/")[0]
                break
            above = above.rpartition("/")[0]
    return out


def resolve_relative(dotted: str, module: str, is_package: bool) -> str:
    """`..x` seen from module; as written if it climbs too far."""
    level = len(dotted) - len(dotted.lstrip("."))
    if not level:
        return dotted
    base = module.split(".") if module else []
    up = level - 1 if is_package else level
    if up > len(base) or (up == len(base) and not dotted[level:]):
        return dotted
    return ".".join([*base[: len(base) - up], *([dotted[level:]] if dotted[level:] else [])])


def _header(lines: list[str], start: int, col: int, last: int) -> str:
    """The text of a definition from its first word to the colon outside brackets, strings and comments; line last has it at the latest."""
    text = "\n".join([lines[start - 1].encode()[col:].decode(errors="replace"), *lines[start:last]])
    depth, i, quote = 0, 0, ""
    while i < len(text):
        c = text[i]
        if quote:
            if c == "\\":
                i += 1
            elif text.startswith(quote, i):
                i += len(quote) - 1
                quote = ""
        elif c in "\"'":
            quote = c * 3 if text.startswith(c * 3, i) else c
            i += len(quote) - 1
        elif c == "#":
            end = text.find("\n", i)
            text = text[:i] + (text[end:] if end >= 0 else "")
            continue
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c == ":" and depth == 0:
            return text[:i]
        i += 1
    return text.split("\n")[0]


class _Walker:
    def __init__(self, source: str, module: str, is_package: bool):
        self.lines = source.split("\n")
        self.raw = source.encode()
        starts = [0]
        for i, b in enumerate(self.raw):
            if b == 10:
                starts.append(i + 1)
        self.starts = starts
        self.out = Found(module)
        self.is_package = is_package

    def text(self, node: ast.expr) -> str:
        a, b = self.starts[node.lineno - 1] + node.col_offset, self.starts[node.end_lineno - 1] + node.end_col_offset
        return self.raw[a:b].decode(errors="replace")

    def walk(self, tree: ast.Module) -> Found:
        stack = [(node, None, False) for node in reversed(tree.body)]
        while stack:
            node, scope, typing = stack.pop()
            more: list[tuple] = []
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                own = self._function(node, scope)
                a = node.args
                outside = [*node.decorator_list, *a.defaults, *[d for d in a.kw_defaults if d], *[x.annotation for x in [*a.posonlyargs, *a.args, *a.kwonlyargs, a.vararg, a.kwarg] if x and x.annotation], *([node.returns] if node.returns else [])]
                more = [(x, scope, typing) for x in outside] + [(x, own, typing) for x in node.body]
            elif isinstance(node, ast.ClassDef):
                own = self._class(node, scope)
                more = [(x, scope, typing) for x in [*node.decorator_list, *node.bases, *[k.value for k in node.keywords]]] + [(x, own, typing) for x in node.body]
            elif isinstance(node, ast.If) and _type_checking(node.test):
                more = [(x, scope, True) for x in node.body] + [(x, scope, typing) for x in node.orelse]
            elif isinstance(node, (ast.Import, ast.ImportFrom)):
                self._import(node, typing)
            else:
                if isinstance(node, ast.Call):
                    self._call(node, scope)
                more = [(x, scope, typing) for x in ast.iter_child_nodes(node)]
            stack.extend(reversed(more))
        return self.out

    def _doc(self, node) -> str | None:
        doc = ast.get_docstring(node, clean=False)
        return inspect.cleandoc(doc) if doc else None

    def _add(self, node, scope, kind, **more) -> int:
        first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
        names = [self.text(d) for d in node.decorator_list]
        signature = _header(self.lines, node.lineno, node.col_offset, node.body[0].lineno)
        return self.out.symbol(scope, kind, node.name, signature, (first, node.end_lineno), decorators=names, doc=self._doc(node), **more)

    def _function(self, node, scope) -> int:
        a = node.args
        n = len(a.posonlyargs) + len(a.args) + len(a.kwonlyargs) + bool(a.vararg) + bool(a.kwarg)
        method = scope is not None and self.out["symbols"][scope]["kind"] == "class"
        return self._add(node, scope, "method" if method else "function", param_count=n, is_varargs=bool(a.vararg or a.kwarg))

    def _class(self, node, scope) -> int:
        return self._add(node, scope, "class", bases=[self.text(b) for b in node.bases])

    def _import(self, node, typing: bool) -> None:
        whole = isinstance(node, ast.Import)
        source = None if whole else resolve_relative("." * node.level + (node.module or ""), self.out["module"], self.is_package)
        for a in node.names:
            self.out.put("imports", module=a.name if whole else source, name=None if whole else a.name, alias=a.asname, is_type_only=typing, line=node.lineno)

    def _call(self, node: ast.Call, scope: int | None) -> None:
        f = node.func
        splat = any(isinstance(a, ast.Starred) for a in node.args) or any(k.arg is None for k in node.keywords)
        n = None if splat else len(node.args) + len(node.keywords)
        if isinstance(f, ast.Name):
            self.out.call(scope, "call", f.id, None, n, (f.lineno, f.col_offset + 1))
        elif isinstance(f, ast.Attribute):
            self.out.call(scope, "call", f.attr, self.text(f.value), n, (f.end_lineno, f.end_col_offset - len(f.attr.encode()) + 1))


def _type_checking(test: ast.expr) -> bool:
    return (isinstance(test, ast.Name) and test.id == "TYPE_CHECKING") or (isinstance(test, ast.Attribute) and test.attr == "TYPE_CHECKING")


def _mended(source: str) -> tuple[ast.Module, str, dict[int, str]] | None:
    """(tree, source with mended lines, what stood in them) of a source with syntax errors; None if mending a line twice leaves it at fault."""
    lines, was, turns = source.split("\n"), {}, {}
    done, settles = 0, True  # lines before done are whole statements of the top level
    while True:
        try:
            tree = ast.parse("\n".join(lines[done:]))
            if not done:
                return tree, "\n".join(lines), was
            done, settles = 0, False  # statements that can be read one by one are read together, or mended as one
        except SyntaxError as e:
            at = min(max((e.lineno or 1) + done, 1), len(lines))
            while at > 1 and (not lines[at - 1].strip() or at in was):  # an error at the end of a block is that of a line before
                at -= 1
            line = lines[at - 1]
            m = _DEF.match(line)
            turns[at] = turns.get(at, 0) + 1
            if turns[at] > 3 or (at in was and not (m and line.rstrip().endswith(": pass")) and (m is None or line.strip() == "pass")):
                return None
            indent = line[: len(line) - len(line.lstrip())]
            was.setdefault(at, line)
            if m:
                head = f"{indent}{m[2]} {m[3]}" + ("():" if m[2] == "def" else ":")
                lines[at - 1] = head if line != head else f"{head} pass"
            else:
                lines[at - 1] = f"{indent}if 1:" if line.rstrip().endswith(":") and line != f"{indent}if 1:" else f"{indent}pass"
            done = 0 if at <= done else _settled(lines, done, at) if settles else done
        except (ValueError, RecursionError, MemoryError):
            return None


def _settled(lines: list[str], done: int, at: int) -> int:
    """The place, after done, of the last statement of the top level that begins before line `at`, if what stands before it can be read; else done."""
    start = at - 2
    while start > done and _GOES_ON.match(lines[start]):
        start -= 1
    try:
        if start > done:
            ast.parse("\n".join(lines[done:start]))
            return start
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        pass
    return done


def _read_mended(source: str, module: str, is_package: bool) -> Found | None:
    got = _mended(source)
    if got is None:
        return None
    tree, mended, was = got
    out = _Walker(mended, module, is_package).walk(tree)
    out["has_errors"] = True
    for s in out["symbols"]:
        for at in range(s["start_line"], s["end_line"] + 1):
            m = _DEF.match(was.get(at, ""))
            if m and m[3] == s["name"]:
                s["signature"], inner = was[at].strip().rstrip(":"), [p.strip() for p in (m[4] or "").strip("(): ").split(",") if p.strip()]
                if s["kind"] != "class":
                    s["param_count"], s["is_varargs"] = len(inner), any(p.startswith("*") for p in inner)
                break
    for at, line in was.items():
        scope = max((s for s in out["symbols"] if s["start_line"] <= at <= s["end_line"]), key=lambda s: s["start_line"], default=None)
        if not _DEF.match(line):
            _calls(out, line.split("#", 1)[0], at, scope["ordinal"] if scope else None)
    return out


def _calls(out: Found, code: str, no: int, scope: int | None) -> None:
    for m in _CALL.finditer(code):
        if m[2] not in _KEYWORDS:
            out.call(scope, "call", m[2], m[1], None, (no, len(code[: m.start(2)].encode()) + 1))


def _scan(source: str, module: str, is_package: bool) -> Found:
    out = Found(module)
    out["has_errors"] = True
    open_: list[tuple[int, int]] = []
    lines = source.split("\n")
    for no, line in enumerate(lines, 1):
        code = line.split("#", 1)[0]
        if not code.strip():
            continue
        indent = len(code) - len(code.lstrip())
        while open_ and indent <= open_[-1][0]:
            open_.pop()
        for _, i in open_:
            out["symbols"][i]["end_line"] = no
        scope = open_[-1][1] if open_ else None
        if m := _DEF.match(code):
            kind = "class" if m[2] == "class" else "method" if scope is not None and out["symbols"][scope]["kind"] == "class" else "function"
            inner = (m[4] or "").strip("(): ")
            names = [p.strip() for p in inner.split(",") if p.strip()]
            more = {"bases": [p for p in names if "=" not in p]} if kind == "class" else {"param_count": len(names), "is_varargs": any(p.startswith("*") for p in names)}
            open_.append((indent, out.symbol(scope, kind, m[3], code.strip().rstrip(":"), (no, no), **more)))
        elif m := _FROM.match(code):
            target = resolve_relative(m[1], module, is_package)
            for part in m[2].split(","):
                name, _, alias = part.strip().partition(" as ")
                if name:
                    out.put("imports", module=target, name=name.strip(), alias=alias.strip() or None, line=no)
        elif m := _IMPORT.match(code):
            for part in m[1].split(","):
                name, _, alias = part.strip().partition(" as ")
                out.put("imports", module=name.strip(), alias=alias.strip() or None, line=no)
        else:
            _calls(out, code, no, scope)
    return out


def extract_python(source: bytes, module: str, is_package: bool) -> Found:
    text = source.decode("utf-8", errors="replace").removeprefix("\ufeff")
    try:
        return _Walker(text, module, is_package).walk(ast.parse(text)).closed()
    except SyntaxError:
        return (_read_mended(text, module, is_package) or _scan(text, module, is_package)).closed()
    except (ValueError, RecursionError, MemoryError):
        return _scan(text, module, is_package).closed()
