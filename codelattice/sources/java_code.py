"""Symbols, imports and call sites of Java source, by a tolerant scanner.

The text is cut into tokens and brackets are matched once; declarations are read at the level of type
bodies, calls in whatever lies between. A bracket that has no partner flags the file, and scanning goes on.
"""

from __future__ import annotations

import re
from bisect import bisect_right

from .model import Found

_TOKEN = re.compile(
    r'(?P<doc>/\*\*(?:[^*]|\*(?!/))*\*/)|(?P<comment>//[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)|(?P<text>"""(?:\\.|(?!""").)*"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\')'
    r"|(?P<number>\d[\w.]*)|(?P<word>[^\W\d][\w$]*)|(?P<mark>->|::|\.\.\.|[^\s\w])",
    re.S,
)
_OPEN = {"(": ")", "[": "]", "{": "}"}
_MODIFIERS = frozenset("public protected private static final abstract native synchronized transient volatile strictfp default sealed".split())
_TYPES = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}
#: Words that stand before a bracket without being called.
_NO_CALL = frozenset("if for while switch catch synchronized return throw new else do try assert case super this instanceof yield when".split())


class _Tokens:
    def __init__(self, source: str):
        self.source = source
        self.text: list[str] = []
        self.at: list[int] = []
        self.kind: list[str] = []
        self.docs: dict[int, str] = {}  # by the token that follows
        self.partner: dict[int, int] = {}
        self.broken = False
        for m in _TOKEN.finditer(source):
            if m.lastgroup == "doc":
                self.docs[len(self.text)] = m[0]
            elif m.lastgroup != "comment":
                self.text.append(m[0])
                self.at.append(m.start())
                self.kind.append(m.lastgroup)
        open_: list[int] = []
        for i, t in enumerate(self.text):
            if self.kind[i] != "mark":
                continue
            if t in _OPEN:
                open_.append(i)
            elif t in ")]}":
                while open_ and _OPEN[self.text[open_[-1]]] != t and t == "}":
                    self.broken = True
                    self.partner[open_.pop()] = i
                if open_ and _OPEN[self.text[open_[-1]]] == t:
                    self.partner[open_[-1]] = i
                    self.partner[i] = open_.pop()
                else:
                    self.broken = True
        for i in open_:
            self.broken = True
            self.partner[i] = len(self.text)
        self.breaks = [-1] + [i for i, c in enumerate(source) if c == "\n"]

    def line(self, i: int) -> int:
        return bisect_right(self.breaks, self.at[min(i, len(self.at) - 1)] - 1) if self.at else 1

    def col(self, i: int) -> int:
        start = self.breaks[self.line(i) - 1] + 1
        return len(self.source[start : self.at[i]].encode()) + 1

    def span(self, a: int, b: int) -> str:
        """The text of tokens a to b - 1."""
        if a >= b:
            return ""
        return self.source[self.at[a] : self.at[b - 1] + len(self.text[b - 1])]

    def angle(self, i: int, end: int) -> int:
        """The token after a type argument list that opens at i, or i if it isn't one."""
        depth, j = 0, i
        while j < end:
            t = self.text[j]
            if t == "<":
                depth += 1
            elif t == ">":
                depth -= 1
                if depth == 0:
                    return j + 1
            elif t == "[":
                j = self.partner.get(j, j)
            elif t == "@" or self.kind[j] == "word" or t in ",.?&]":
                pass
            else:
                return i
            j += 1
        return i


def _doc_text(doc: str | None) -> str | None:
    if doc is None:
        return None
    lines = [re.sub(r"^\s*\*? ?", "", x).rstrip() for x in doc[3:-2].split("\n")]
    return "\n".join(lines).strip() or None


class _Scanner:
    def __init__(self, source: str):
        self.t = _Tokens(source)
        self.out = Found("")

    def run(self) -> Found:
        t, i, n = self.t, 0, len(self.t.text)
        while i < n:
            if t.text[i] == "package" and t.kind[i] == "word":
                end = self._find(";", i, n)
                self.out["module"] = "".join(t.text[i + 1 : end])
                i = end + 1
            elif t.text[i] == "import" and t.kind[i] == "word":
                end = self._find(";", i, n)
                self._import(i, end)
                i = end + 1
            elif t.text[i] == "@" and t.text[i + 1 : i + 2] != ["interface"] and self._peek_package(i, n):
                i = self._peek_package(i, n)
            else:
                i = self._member(i, n, None, None)
        self.out["has_errors"] = t.broken
        return self.out.closed()

    def _peek_package(self, i: int, n: int) -> int:
        j = self._annotations(i, n)[0]
        return j if j < n and self.t.text[j] == "package" else 0

    def _find(self, mark: str, i: int, end: int) -> int:
        """The next such token outside brackets; end if there is none."""
        while i < end and self.t.text[i] != mark:
            i = self.t.partner.get(i, i) + 1 if self.t.text[i] in _OPEN and self.t.kind[i] == "mark" else i + 1
        return min(i, end)

    def _import(self, i: int, end: int) -> None:
        words = self.t.text[i + 1 : end]
        static = words[:1] == ["static"]
        path = "".join(words[static:])
        module, _, name = path.rpartition(".")
        if path:
            self.out.put("imports", module=module, name=name, is_static=static, line=self.t.line(i))

    def _annotations(self, i: int, end: int) -> tuple[int, list[str]]:
        names, t = [], self.t
        while i < end and t.text[i] == "@" and t.text[i + 1 : i + 2] != ["interface"]:
            j = i + 2
            while j + 1 < end and t.text[j] == ".":
                j += 2
            if j < end and t.text[j] == "(":
                j = t.partner.get(j, j) + 1
            names.append(t.span(i + 1, min(j, end)))
            i = j
        return i, names

    def _member(self, i: int, end: int, scope: int | None, owner: int | None) -> int:
        """Read one declaration (or what can't be read) from i; the token after it. scope None and owner -1: an anonymous body."""
        t, start, doc = self.t, i, self.t.docs.get(i)
        names: list[str] = []
        mods: list[str] = []
        while i < end:
            if t.text[i] == "@" and t.text[i + 1 : i + 2] != ["interface"]:
                i, more = self._annotations(i, end)
                names += more
            elif t.text[i] in _MODIFIERS and t.kind[i] == "word":
                mods.append(t.text[i])
                i += 1
            elif t.text[i] == "non" and t.text[i + 1 : i + 3] == ["-", "sealed"]:
                i += 3
            else:
                break
        if i >= end:
            return end
        word = t.text[i]
        head = (names, mods, doc, start)
        if word == "@":
            return self._type(i + 1, end, scope, "annotation", head)
        if word in _TYPES and i + 1 < end and t.kind[i + 1] == "word" and (word != "record" or t.text[i + 2 : i + 3] in (["("], ["<"])):
            return self._type(i, end, scope, _TYPES[word], head)
        if word == "{":
            close = min(t.partner.get(i, end), end)
            self._code(i + 1, close, scope, mute=False)
            return close + 1
        if word in (";", "}", ")", "]", ",") or owner is None:
            return i + 1
        return self._callable_or_field(i, end, scope, owner, head)

    def _lines(self, first: int, last: int) -> tuple[int, int]:
        return self.t.line(first), self.t.line(min(last, len(self.t.at) - 1))

    def _place(self, i: int) -> tuple[int, int]:
        return self.t.line(i), self.t.col(i)

    def _signature(self, mods: list[str], i: int, end: int) -> str:
        return " ".join([*mods, self.t.span(i, end)])

    def _type(self, i: int, end: int, scope: int | None, kind: str, head) -> int:
        names, mods, doc, start = head
        t = self.t
        if i + 1 >= end:
            return end
        name = t.text[i + 1]
        j, bases, components = i + 2, [], None
        if j < end and t.text[j] == "<":
            j = max(t.angle(j, end), j + 1)
        if kind == "record" and j < end and t.text[j] == "(":
            components = (j + 1, min(t.partner.get(j, end), end))
            j = components[1] + 1
        body = self._find("{", j, end)
        part = None
        while j < body:
            if t.text[j] in ("extends", "implements", "permits"):
                part = t.text[j]
                j += 1
            elif t.kind[j] == "word" and part in ("extends", "implements"):
                k = j + 1
                while k + 1 < body and t.text[k] == ".":
                    k += 2
                bases.append("".join(t.text[j:k]))
                j = max(t.angle(k, body), k) if k < body and t.text[k] == "<" else k
            elif t.text[j] == "@":
                j = max(self._annotations(j, body)[0], j + 1)
            else:
                j += 1
        close = min(t.partner.get(body, end), end)
        own = self.out.symbol(scope, kind, name, self._signature(mods, i - (kind == "annotation"), body), self._lines(start, close), decorators=names, bases=bases, doc=_doc_text(doc))
        arity = None
        if components:
            arity = self._parameters(*components)
            for a, b in self._split(*components):
                self._component(a, b, own)
        k = body + 1
        if kind == "enum":
            k = self._constants(k, close, own)
        while k < close:
            k = max(self._member(k, close, own, own), k + 1)
        for x in self.out["symbols"][own:]:
            if arity is not None and x["parent_ordinal"] == own and x["kind"] == "constructor" and x["param_count"] == -1:
                x["param_count"], x["is_varargs"] = arity
        return close + 1

    def _component(self, a: int, b: int, own: int) -> None:
        a, names = self._annotations(a, b)
        if a < b:
            name = self.t.text[b - 1]
            self.out.symbol(own, "field", name, self.t.span(a, b), self._lines(a, b - 1), decorators=names)

    def _constants(self, i: int, close: int, own: int) -> int:
        t, out = self.t, self.out
        while i < close and t.text[i] != ";":
            start = i
            i, names = self._annotations(i, close)
            if i >= close or t.kind[i] != "word":
                i += 1
                continue
            name, at = t.text[i], i
            i += 1
            has = i < close and t.text[i] == "("
            args = (i + 1, min(t.partner.get(i, close), close)) if has else None
            i = args[1] + 1 if args else i
            body = (i + 1, min(t.partner.get(i, close), close)) if i < close and t.text[i] == "{" else None
            last = body[1] if body else i - 1
            field = out.symbol(own, "field", name, t.span(at, args[1] + 1 if args else at + 1), self._lines(start, last), decorators=names, doc=_doc_text(t.docs.get(start)))
            if args:
                out.call(own, "new", out["symbols"][own]["name"], None, self._count(*args), self._place(at))
                self._code(*args, own, mute=False)
            if body:
                self._body_members(*body, field, mute=True)
                i = body[1] + 1
            if i < close and t.text[i] == ",":
                i += 1
        return i + 1

    def _types_at(self, i: int, b: int) -> bool:
        """Whether `<` at i of an argument list opens type arguments: `.<`, `X<..>::`, or a name after new or instanceof; else it compares."""
        t, after = self.t, self.t.angle(i, b)
        if after == i:
            return False
        name = i - 1
        while name > 1 and t.text[name - 1] == ".":
            name -= 2
        return t.text[i - 1] == "." or t.text[after : after + 1] == ["::"] or t.text[max(name - 1, 0)] in ("new", "instanceof")

    def _split(self, a: int, b: int, declared: bool = True) -> list[tuple[int, int]]:
        """The parts of a list between commas: of declared parameters, or of arguments."""
        out, start, i, t = [], a, a, self.t
        while i < b:
            if t.text[i] in _OPEN and t.kind[i] == "mark":
                i = min(t.partner.get(i, b), b)
            elif t.text[i] == "<" and i > a and (t.kind[i - 1] == "word" if declared else self._types_at(i, b)):
                i = max(t.angle(i, b) - 1, i)
            elif t.text[i] == ",":
                out.append((start, i))
                start = i + 1
            i += 1
        return out + [(start, b)] if start < b else out

    def _count(self, a: int, b: int) -> int:
        return len(self._split(a, b, declared=False))

    def _parameters(self, a: int, b: int) -> tuple[int, bool]:
        parts = [p for p in self._split(a, b) if self.t.text[p[1] - 1] != "this"]
        return len(parts), any("..." in self.t.text[x:y] for x, y in parts)

    def _callable_or_field(self, i: int, end: int, scope: int | None, owner: int, head) -> int:
        names, mods, doc, start = head
        t, first = self.t, i
        if t.text[i] == "<":
            i = max(t.angle(i, end), i + 1)
        j = i
        while j < end and t.text[j] not in ("(", "{", ";", "=", ","):
            if t.text[j] == "<":
                j = max(t.angle(j, end), j + 1)
            elif t.text[j] == "@":
                j = max(self._annotations(j, end)[0], j + 1)
            elif t.text[j] in _OPEN and t.kind[j] == "mark":
                j = t.partner.get(j, j) + 1
            else:
                j += 1
        if j >= end:
            return end
        if t.kind[j - 1] != "word" and t.text[j - 1] != "]":
            if t.text[j] == "{" or t.text[j] == "(":
                return t.partner.get(j, j) + 1
            return j + 1
        name, mark = t.text[j - 1], t.text[j]
        class_name = self.out["symbols"][owner]["name"] if owner >= 0 else None
        compact = mark == "{" and name == class_name and j - 1 == i
        if mark == "(" or compact:
            close = min(t.partner.get(j, end), end) if mark == "(" else j - 1
            body = self._find_body(close + 1, end)
            block = (body + 1, min(t.partner.get(body, end), end)) if body < end and t.text[body] == "{" else None
            last = block[1] if block else body
            own = scope
            kind = "constructor" if j - 1 == i else "method"
            if owner >= 0 and not (kind == "constructor" and name != class_name):
                n, varargs = (-1, False) if compact else self._parameters(j + 1, close)
                head_end = next((k for k in range(close + 1, body) if t.text[k] == "default"), body)
                own = self.out.symbol(scope, kind, name, self._signature(mods, first, head_end), self._lines(start, last), param_count=n, is_varargs=varargs, decorators=names, doc=_doc_text(doc))
            if block:
                self._code(*block, own, mute=owner < 0)
            return last + 1
        stop = self._find(";", j, end)
        if mark == "{":
            return min(t.partner.get(j, end), end) + 1
        declared = self._declarators(j - 1, stop)
        for at, a, b in declared:
            own = scope
            if owner >= 0:
                label = t.text[at]
                own = self.out.symbol(scope, "field", label, self._signature(mods, first, declared[0][0]) + " " + label, self._lines(start, stop), decorators=names, doc=_doc_text(doc))
            if a < b:
                self._code(a, b, own, mute=owner < 0)
        return stop + 1

    def _find_body(self, i: int, end: int) -> int:
        while i < end and self.t.text[i] not in ("{", ";"):
            i = self.t.partner.get(i, i) + 1 if self.t.text[i] in "([" else i + 1
        return min(i, end)

    def _declarators(self, i: int, stop: int) -> list[tuple[int, int, int]]:
        """(name, start of the initial value, its end) of `a = 1, b[], c`."""
        while i > 0 and self.t.text[i] in "[]":
            i -= 1
        out = []
        for k, (a, b) in enumerate(self._split(i, stop)):
            eq = self._find("=", a, b)
            if a < b and self.t.kind[a] == "word":
                out.append((a, min(eq + 1, b), b))
        return out

    def _body_members(self, a: int, b: int, scope: int | None, mute: bool) -> None:
        """Members of a body that has no symbols of its own: only their calls count, for the scope around."""
        i = a
        while i < b:
            i = max(self._member(i, b, scope, -1), i + 1)

    def _code(self, a: int, b: int, scope: int | None, mute: bool) -> None:
        """Calls, creations, references to methods, and local types between two tokens."""
        t, i = self.t, a
        b = min(b, len(t.text))
        while i < b:
            word, kind = t.text[i], t.kind[i]
            if kind == "word":
                follows = t.text[i + 1] if i + 1 < b else ""
                before = t.text[i - 1] if i > 0 else ""
                if word in ("class", "interface", "enum", "record") and before != "." and i + 2 < b and t.kind[i + 1] == "word" and t.text[i + 2] in ("{", "<", "(", "extends", "implements"):
                    if word != "record" or t.text[i + 2] in "(<":
                        i = self._type(i, b, scope, _TYPES[word], ([], [], None, i)) if not mute else self._skip_type(i, b, scope)
                        continue
                if word == "new" and before != "::":
                    i = self._creation(i, b, scope, mute)
                    continue
                if word in ("this", "super") and follows == "(" and before != ".":
                    self._ref(scope, "constructor_call", i, None, i + 1)
                elif word == "super" and follows == "(" and before == ".":
                    self._ref(scope, "constructor_call", i, self._receiver(i - 1, a), i + 1)
                elif follows == "(" and word not in _NO_CALL:
                    self._ref(scope, "call", i, self._receiver(i - 1, a) if before == "." else None, i + 1)
            elif word == "::" and i + 1 < b:
                j = i + 1
                if t.text[j] == "<":
                    j = max(t.angle(j, b), j)
                receiver = self._receiver(i, a)
                if t.text[j] == "new":
                    base = re.sub(r"<.*>|\[\]|\s", "", receiver or "")
                    owner, _, name = base.rpartition(".")
                    if name:
                        self.out.call(scope, "new", name, owner or None, None, self._place(j))
                elif t.kind[j] == "word":
                    self.out.call(scope, "method_ref", t.text[j], receiver, None, self._place(j))
                i = j
            i += 1

    def _skip_type(self, i: int, b: int, scope: int | None) -> int:
        body = self._find("{", i, b)
        close = min(self.t.partner.get(body, b), b)
        self._body_members(body + 1, close, scope, True)
        return close + 1

    def _ref(self, scope, kind: str, at: int, receiver: str | None, bracket: int) -> None:
        t = self.t
        close = min(t.partner.get(bracket, bracket + 1), len(t.text))
        self.out.call(scope, kind, t.text[at], receiver, self._count(bracket + 1, close), self._place(at))

    def _creation(self, i: int, b: int, scope, mute: bool) -> int:
        """`new a.b.C<T>(...) { ... }` from the word new; where scanning goes on."""
        t = self.t
        outer = self._receiver(i - 1, 0) if i > 0 and t.text[i - 1] == "." else None
        j = self._annotations(i + 1, b)[0]
        first = j
        while j + 2 < b and t.kind[j] == "word" and t.text[j + 1] == ".":
            j += 2
        if j >= b or t.kind[j] != "word":
            return i + 1
        name_at = j
        k = j + 1
        if k < b and t.text[k] == "<":
            k = max(t.angle(k, b), k)
        if k >= b or t.text[k] != "(":
            return k
        receiver = outer or ("".join(t.text[first : name_at - 1]) or None)
        self._ref(scope, "new", name_at, receiver, k)
        close = min(t.partner.get(k, b), b)
        if close + 1 < b and t.text[close + 1] == "{":
            self._code(k + 1, close, scope, mute)
            end = min(t.partner.get(close + 1, b), b)
            self._body_members(close + 2, end, scope, True)
            return end + 1
        return k + 1

    def _receiver(self, dot: int, least: int) -> str | None:
        """The text of the expression that ends before the token dot."""
        t, i = self.t, dot - 1
        while i >= 0:
            if t.text[i] in (")", "]") and t.kind[i] == "mark":
                i = t.partner.get(i, i) - 1
                while i >= 0 and t.text[i] in (")", "]") and t.kind[i] == "mark":
                    i = t.partner.get(i, i) - 1
                if i < 0 or t.kind[i] != "word" or t.text[i] in ("return", "throw", "case", "else", "if", "while"):
                    i += 1
                    break
            elif t.text[i] == ">":
                depth = 0
                while i >= 0:
                    depth += (t.text[i] == ">") - (t.text[i] == "<")
                    if depth == 0:
                        break
                    i -= 1
                i -= 1
            if i > 0 and t.text[i - 1] == ".":
                i -= 2
                continue
            if i > 0 and t.text[i - 1] == "new":
                i -= 1
            break
        text = t.span(max(i, 0), dot)
        return text or None


def extract_java(source: bytes) -> Found:
    return _Scanner(source.decode("utf-8", errors="replace").removeprefix("﻿")).run()
