"""Structural scanners for source code: declarations by pattern, spans by matching brackets or indentation.

No grammar is at hand, so a scanner first masks strings and comments (same length, line breaks kept), matches brackets
on what is left, and then looks for declarations where statements begin. It is tolerant: what it cannot read it skips.
"""

from __future__ import annotations

import re
from bisect import bisect_right

COLUMNS = ["rec", "ordinal", "name", "kind", "signature", "start_line", "end_line", "exported", "async", "parent_class", "source", "identifiers", "line"]
_ID = r"[A-Za-z_$][\w$]*"
_WORD = re.compile(r"[A-Za-z_$][\w$]*|-?\d[\w.]*")
#: Marks that may stand between < and > of type arguments, and words that a type follows.
_IN_TYPES = ".,?:=|&@#'\"`-*+"
_BEFORE_TYPES = {"typeof", "keyof", "readonly", "unique", "infer", "asserts", "new", "abstract"}


class Source:
    """A text with strings and comments masked, its line starts and its bracket pairs."""

    def __init__(self, text: str, lang: str):
        self.text = text
        self.mask = mask(text, lang)
        self.starts = [0] + [m.end() for m in re.finditer("\n", text)]
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for m in re.finditer(r"[(){}\[\]]", self.mask):
            if m[0] in "({[":
                stack.append(m.start())
                continue
            opener = {")": "(", "]": "[", "}": "{"}[m[0]]
            kept = len(stack) - 1
            while kept >= 0 and self.mask[stack[kept]] != opener:  # what stands open inside has no closer
                kept -= 1
            if kept >= 0:
                self.close[stack[kept]] = m.start()
                del stack[kept:]

    def line(self, pos: int) -> int:
        return bisect_right(self.starts, pos)

    def whole_line(self, pos: int) -> str:
        """The line on which pos lies, without white space around it."""
        k = self.line(pos) - 1
        return self.text[self.starts[k] : self.starts[k + 1] if k + 1 < len(self.starts) else len(self.text)].strip()

    def blank(self, pos: int, limit: int) -> int:
        """The next place from pos that is no white space."""
        while pos < limit and self.mask[pos].isspace():
            pos += 1
        return pos

    def angle(self, pos: int, limit: int) -> int:
        """One past the > that closes the type arguments which < opens at pos, or -1 if it is an operator there.

        What stands between has to read as types: names, marks of types, and brackets with their partners. Anything else
        takes the reading back.
        """
        i, depth = pos, 0
        while i < limit:
            ch = self.mask[i]
            if ch == "<":
                depth += 1
            elif ch == ">":
                if self.mask[i - 1] not in "=-":  # else an arrow
                    depth -= 1
                    if not depth:
                        return i + 1
            elif ch in "([{":
                i = self.close.get(i, limit)
            elif ch not in _IN_TYPES and not (ch.isspace() or ch.isalnum() or ch in "_$") or self.mask[i : i + 2] in ("&&", "||", "==", "??"):
                return -1
            i += 1
        return -1

    def skip_angle(self, pos: int, limit: int) -> int:
        """Past white space and type arguments, if there are any."""
        i = self.blank(pos, limit)
        if i < limit and self.mask[i] == "<":
            e = self.angle(i, limit)
            return self.blank(e, limit) if e > 0 else i
        return i

    def type_end(self, pos: int, limit: int) -> int:
        """One past the type expression of a script that stands at pos: operands, what follows them, and what joins them."""
        i, waiting = pos, 0  # waiting: conditional types whose : is still to come
        while i < limit:
            i = self.blank(i, limit)
            while i < limit and self.mask[i] in "|&":
                i = self.blank(i + 1, limit)
            word = _WORD.match(self.mask, i, limit)
            arrow = False
            if word:
                i = word.end()
                if word[0] in _BEFORE_TYPES and re.compile(r"\s*[\w$({\['\"]").match(self.mask, i, limit):
                    continue
            elif i < limit and self.mask[i] in "([{" and i in self.close:
                arrow = self.mask[i] == "("
                i = self.close[i] + 1
            elif i < limit and self.mask[i] in "'\"`":
                e = self.mask.find(self.mask[i], i + 1, limit)
                i = e + 1 if e > 0 else limit
            elif i < limit and self.mask[i] == "<" and self.angle(i, limit) > 0:  # a generic function's type
                i = self.angle(i, limit)
                continue
            else:
                return i
            while i < limit:  # what follows an operand
                e = self.blank(i, limit)
                if self.mask[e : e + 1] == "<" and self.angle(e, limit) > 0:
                    i = self.angle(e, limit)
                elif self.mask[i : i + 1] == "[" and i in self.close:
                    i = self.close[i] + 1
                elif self.mask[e : e + 1] == "." and _WORD.match(self.mask, e + 1, limit):
                    i = _WORD.match(self.mask, e + 1, limit).end()
                else:
                    break
            e = self.blank(i, limit)
            joined = re.compile(r"(?:is|extends)\b").match(self.mask, e, limit)
            if arrow and self.mask.startswith("=>", e):
                i = e + 2
            elif self.mask[e : e + 1] in ("|", "&") and self.mask[e : e + 2] not in ("||", "&&"):
                i = e + 1
            elif joined:
                i = joined.end()
            elif self.mask[e : e + 1] == "?" and self.mask[e + 1 : e + 2] not in ("?", "."):
                i, waiting = e + 1, waiting + 1
            elif self.mask[e : e + 1] == ":" and waiting:
                i, waiting = e + 1, waiting - 1
            else:
                return i
        return min(i, limit)

    def body(self, pos: int, limit: int) -> int:
        """The { that opens the body behind a head that may hold type arguments, or -1 if ; comes first."""
        i = pos
        while i < limit:
            ch = self.mask[i]
            if ch == "{":
                return i
            if ch == ";":
                return -1
            if ch in "([":
                i = self.close.get(i, limit)
            elif ch == "<" and self.angle(i, limit) > 0:
                i = self.angle(i, limit) - 1
            i += 1
        return -1

    def end_of(self, pos: int, limit: int) -> int:
        """One past the statement's end: its block's closing brace, or ; or the line's end outside brackets."""
        i = pos
        while i < limit:
            ch = self.mask[i]
            if ch in "([":
                i = self.close.get(i, limit - 1)
            elif ch == "{":
                return self.close.get(i, limit - 1) + 1
            elif ch == ";":
                return i + 1
            i += 1
        return limit

    def brace(self, pos: int, limit: int) -> int:
        """The { that opens the body of what starts at pos, or -1 if ; comes first."""
        i = pos
        while i < limit:
            ch = self.mask[i]
            if ch == "{":
                return i
            if ch == ";":
                return -1
            if ch in "([":
                i = self.close.get(i, limit)
            i += 1
        return -1


_COMMENT = r"/\*[\s\S]*?\*/|//[^\n]*"
#: Comments and strings by language; the first that matches counts.
_MASKED = {
    "python": r"'''[\s\S]*?'''|\"\"\"[\s\S]*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|#[^\n]*",
    "go": _COMMENT + r"|\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.[^']*|[^'\\\n])'",
    "rust": _COMMENT + r"|\br(?P<hashes>#*)\"[\s\S]*?\"(?P=hashes)|\"(?:\\.|[^\"\\])*\"|'(?:\\.[^']*|[^'\\\n])'",
    "java": _COMMENT + r"|\"\"\"[\s\S]*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "csharp": _COMMENT + r"|\"\"\"[\s\S]*?\"\"\"|\$?@\$?\"(?:[^\"]|\"\")*\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
}


def _blank(s: str) -> str:
    return re.sub(r"[^\n]", " ", s)


def mask(text: str, lang: str) -> str:
    """Comments and the insides of strings as spaces."""
    if lang not in _MASKED:
        return _mask_script(text)

    def blank(m: re.Match) -> str:
        s, inner = m[0], _blank(m[0])
        return s[0] + inner[1:-1] + s[-1] if s[0] in "\"'`" and len(s) > 1 else inner

    return re.sub(_MASKED[lang], blank, text)


#: Words after which a slash begins a pattern, as it does where no value stands before it.
_BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await"}
_SCRIPT = re.compile(_COMMENT + r"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|[`/{}]")
_PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|\$(?!\{)|[^`\\$])*")


def _mask_script(text: str) -> str:
    """JavaScript and TypeScript: patterns too; what stands in ${ } of a template is code, between round brackets."""
    out, i, depth, inside = [], 0, 0, []  # inside: depths of braces at which templates go on

    def template(at: int) -> int:
        """After the template's text from ``at``; its end, or the place after ${."""
        end = _TEMPLATE.match(text, at).end()
        out.append(_blank(text[at:end]))
        if text.startswith("${", end):
            out.append(" (")
            inside.append(depth)
            return end + 2
        out.append(text[end : end + 1])
        return end + 1

    while m := _SCRIPT.search(text, i):
        out.append(text[i : m.start()])
        i, s = m.end(), m[0]
        if s == "`":
            out.append(s)
            i = template(i)
        elif s == "{":
            depth += 1
            out.append(s)
        elif s == "}":
            if inside and inside[-1] == depth:
                inside.pop()
                out.append(")")
                i = template(i)
            else:
                depth -= 1
                out.append(s)
        elif s == "/":
            before = re.search(r"([\w$]+|[^\s])\s*$", "".join(out[-3:])[-80:])
            word = before[1] if before else ""
            if word == ")" and _head_of("".join(out)) in ("if", "while", "for", "with"):
                word = ""
            value = bool(word) and (word in (")", "]", "}", '"', "'", "`") or re.match(r"[\w$]", word) and word not in _BEFORE_PATTERN)
            p = None if value else _PATTERN.match(text, m.start())
            if p:
                i = p.end()
                out.append(s + _blank(p[0][1:-1]) + "/")
            else:
                out.append(s)
        elif s[0] in "\"'":
            out.append(s[0] + _blank(s[1:-1]) + s[-1])
        else:
            out.append(_blank(s))
    out.append(text[i:])
    return "".join(out)


def _head_of(code: str) -> str:
    """The word before the bracket whose partner ends code."""
    depth = 0
    for m in re.finditer(r"[()]", code[::-1]):
        depth += 1 if m[0] == ")" else -1
        if not depth:
            word = re.search(r"([\w$]+)\s*$", code[: len(code) - m.end()])
            return word[1] if word else ""
    return ""


def _strip(q: str) -> str:
    return re.sub(r"^['\"`]|['\"`]$", "", q)


class Out:
    """Symbols and imports found so far."""

    def __init__(self, src: Source):
        self.src, self.symbols, self.imports = src, [], []

    def add(self, name: str, kind: str, signature: str, a: int, b: int, parent: str | None = None, exported: bool = False, asynchronous: bool = False) -> None:
        self.symbols.append((name, kind, signature, self.src.line(a), self.src.line(max(a, b - 1)), int(exported), int(asynchronous), parent))

    def use(self, source: str, identifiers: list[str], pos: int) -> None:
        self.imports.append((source, identifiers, self.src.line(pos)))


def _statements(src: Source, a: int, b: int):
    """Places in [a, b) where a statement may begin."""
    begins = True
    i = a
    while i < b:
        ch = src.mask[i]
        if ch in ";{}\n":
            begins = True
        elif not ch.isspace():
            if begins:
                skip = yield i
                begins = False
                if skip:
                    i, begins = skip, True
                    continue
        i += 1


def _params(src: Source, pos: int, limit: int) -> tuple[str, int]:
    """(text inside the next parentheses, place after them)."""
    i = src.mask.find("(", pos, limit)
    if i < 0 or i not in src.close:
        return "", pos
    return src.text[i + 1 : src.close[i]], src.close[i] + 1


# --- JavaScript and TypeScript ---

_JS_DECL = re.compile(rf"(?:(?:export|default|declare|abstract)\s+)*(?:(?P<async>async)\s+)?(?:function\s+(?P<function>{_ID})|(?P<klass>class\b)(?:\s+(?!(?:extends|implements)\b)(?P<cls>{_ID}))?|interface\s+(?P<interface>{_ID})|(?:const\s+)?enum\s+(?P<enum>{_ID})|type\s+(?P<type>{_ID})\s*(?=[<=])|(?:const|let|var)\s+(?P<var>{_ID}|\{{[^}}]*\}})\s*(?=[!:=]))")
_JS_IMPORT = re.compile(r"import\b(?P<what>[^;'\"`]*?)(?:\bfrom\s*)?(?P<q>['\"`])")
_JS_ROUTE = re.compile(rf"(?P<obj>{_ID}(?:\s*\.\s*{_ID})*)\s*\.\s*(?P<verb>get|post|put|delete|patch)\s*\(")
_JS_METHOD = re.compile(rf"(?:@{_ID}\s+)*(?:(?:public|private|protected|static|readonly|override|abstract|accessor|get|set)\s+)*(?P<async>async\s+)?\*?\s*(?P<name>#?{_ID}|\[[^\]\n]*\]|'[^'\n]*'|\"[^\"\n]*\")\s*\??\s*(?=[<(])")
_FN = re.compile(rf"(?P<async>async\b\s*)?(?:(?P<fn>function\b\s*\*?\s*(?:{_ID})?\s*)|(?P<one>{_ID})\s*=>)?")


def _js_value(src: Source, pos: int, limit: int) -> int:
    """Where the value begins of a variable whose name ends at pos, past its type; -1 without a value."""
    i = src.blank(pos, limit)
    if src.mask[i : i + 1] == "!":
        i = src.blank(i + 1, limit)
    if src.mask[i : i + 1] == ":":
        i = src.blank(src.type_end(i + 1, limit), limit)
    return src.blank(i + 1, limit) if src.mask[i : i + 1] == "=" and src.mask[i + 1 : i + 2] not in ("=", ">") else -1


def _js_head(src: Source, pos: int, limit: int) -> tuple[str, int] | None:
    """(parameters, place after them and the type of the result) of a function whose type parameters or ( stand at pos."""
    i = src.skip_angle(pos, limit)
    if src.mask[i : i + 1] != "(" or i not in src.close:
        return None
    after = src.blank(src.close[i] + 1, limit)
    if src.mask[after : after + 1] == ":":
        after = src.blank(src.type_end(after + 1, limit), limit)
    return src.text[i + 1 : src.close[i]], after


def _js_function_value(src: Source, pos: int, limit: int) -> tuple[bool, str, int, int, int] | None:
    """(async, parameters, start, end, its body's { or -1) if an arrow function or function expression stands at pos."""
    m = _FN.match(src.mask, pos, limit)
    if m["one"] and m["one"] != "async":
        params, body = "", src.blank(m.end(), limit)
    else:
        head = _js_head(src, m.end() if m["fn"] or m["async"] else pos, limit)
        if not head:
            return None
        params, body = head
        if not m["fn"]:
            if not src.mask.startswith("=>", body):
                return None
            body = src.blank(body + 2, limit)
        elif src.mask[body : body + 1] != "{":
            return None
    if body < limit and src.mask[body] == "{":
        return bool(m["async"]), params, pos, src.close.get(body, limit - 1) + 1, body
    end = body
    while end < limit and src.mask[end] not in ",;)\n}":
        end = src.close.get(end, end) + 1 if src.mask[end] in "([{" else end + 1
    return bool(m["async"]), params, pos, end, -1


def _javascript(out: Out, a: int, b: int, scope: str | None, typed: bool) -> None:
    src = out.src
    walk = _statements(src, a, b)
    skip = None
    while True:
        try:
            pos = walk.send(skip)
        except StopIteration:
            return
        skip = None
        m = _JS_IMPORT.match(src.mask, pos, b)
        if m and "(" not in m["what"]:
            q = m.end() - 1
            end = src.mask.find(m["q"], q + 1)
            what = re.sub(r"\btype\b", " ", m["what"])
            names = [x for x in re.findall(rf"^\s*({_ID})", re.sub(r"\{[^}]*\}|\*\s*as\s+\w+", " ", what)) if x != "from"]
            inner = re.search(r"\{([^}]*)\}", what)
            names += [x.split()[0] for x in inner[1].split(",") if x.strip()] if inner else []
            out.use(src.text[q + 1 : end], names, pos)
            skip = end + 1
            continue
        m = _JS_DECL.match(src.mask, pos, b)
        if m:
            start = pos + len(re.match(r"(?:(?:export|default|declare)\s+)*", m[0])[0])
            if m["function"]:
                head = _js_head(src, m.end(), b)
                if head and src.mask[head[1] : head[1] + 1] == "{":  # else a signature without a body
                    o = head[1]
                    end = src.close.get(o, b - 1) + 1
                    out.add(m["function"], "function", src.whole_line(start), start, end, scope, asynchronous=bool(m["async"]))
                    _javascript(out, o + 1, end - 1, m["function"], typed)
                    skip = end
                elif head:
                    skip = max(head[1], m.end())
            elif m["klass"]:
                o = src.body(m.end(), b)
                if o >= 0:
                    end = src.close.get(o, b - 1) + 1
                    told = m["cls"] and "abstract" not in m[0].split("class")[0]
                    if told:
                        out.add(m["cls"], "class", f"class {m['cls']}", start, end, scope)
                    _js_members(out, o + 1, end - 1, m["cls"] if told else None, typed)
                    skip = end
            elif m["interface"] or m["enum"]:
                name, kind = m["interface"] or m["enum"], "interface" if m["interface"] else "enum"
                o = src.body(m.end(), b)
                if o >= 0:
                    end = src.close.get(o, b - 1) + 1
                    out.add(name, kind, f"{kind} {name}", start, end, scope)
                    _ts_members(out, o + 1, end - 1, name, kind)
                    skip = end
            elif m["type"]:
                i = src.skip_angle(m.end(), b)
                if src.mask[i : i + 1] == "=":
                    end = src.type_end(i + 1, b)
                    end = end + 1 if src.mask[end : end + 1] == ";" else end
                    out.add(m["type"], "type", src.whole_line(start), start, end, scope)
                    skip = end
            else:
                value = _js_value(src, m.end(), b)
                if value < 0:
                    continue
                require = re.compile(r"require\s*\(\s*(['\"])").match(src.mask, value, b)
                fn = _js_function_value(src, value, b)
                if require:
                    q = require.end()
                    e = src.mask.find(require[1], q)
                    target = m["var"]
                    names = [target] if target[0] != "{" else [x.split(":")[-1].strip() for x in target[1:-1].split(",") if x.strip() and "=" not in x and "..." not in x]
                    out.use(src.text[q:e], names, pos)
                    skip = e + 1
                elif fn and m["var"][0] != "{":
                    asynchronous, params, _, end, o = fn
                    out.add(m["var"], "function", f"{m['var']}({params})", start, end, scope, asynchronous=asynchronous)
                    if o >= 0:
                        _javascript(out, o + 1, end - 1, m["var"], typed)
                    skip = end
            continue
        m = _JS_ROUTE.match(src.mask, pos, b)
        if m and m.end() - 1 in src.close:
            o, end = m.end() - 1, src.close[m.end() - 1]
            args = _arguments(src, o + 1, end)
            if args and src.mask[args[0][0]] in "'\"`":
                handlers = [f for f in (_js_function_value(src, x, y) for x, y in args[1:]) if f]
                if handlers:
                    asynchronous, _, fa, fb, inner = handlers[-1]
                    name = f"{m['verb'].upper()} {_strip(src.text[args[0][0] : args[0][1]].strip())}"
                    out.add(name, "route", name, fa, fb, scope, asynchronous=asynchronous)
                    if inner >= 0:
                        _javascript(out, inner + 1, fb - 1, scope, typed)
                    skip = end + 1


def _arguments(src: Source, a: int, b: int) -> list[tuple[int, int]]:
    """Spans of the arguments in [a, b), white space before them left out."""
    out, at, i = [], a, a
    while i <= b:
        if i == b or src.mask[i] == ",":
            x = at + len(src.mask[at:i]) - len(src.mask[at:i].lstrip())
            if x < i:
                out.append((x, i))
            at = i + 1
        elif src.mask[i] in "([{":
            i = src.close.get(i, b)
        i += 1
    return out


def _js_members(out: Out, a: int, b: int, cls: str | None, typed: bool) -> None:
    """A class's methods, and what stands in them; without a name the methods themselves are not told."""
    src = out.src
    walk, skip = _statements(src, a, b), None
    while True:
        try:
            pos = walk.send(skip)
        except StopIteration:
            return
        skip = None
        m = _JS_METHOD.match(src.mask, pos, b)
        head = _js_head(src, m.end(), b) if m and m["name"] not in ("if", "for", "while", "switch", "return") else None
        if head and src.mask[head[1] : head[1] + 1] == "{":
            params, o = head
            end = src.close.get(o, b - 1) + 1
            name = src.text[m.start("name") : m.end("name")]
            if cls is not None:
                out.add(name, "method", f"{name}({params})", pos, end, cls, asynchronous=bool(m["async"]))
            _javascript(out, o + 1, end - 1, name, typed)
            skip = end
            continue
        end = src.end_of(pos, b)
        skip = end if end > pos and "\n" not in src.mask[pos:end] else None


_TS_MEMBER = re.compile(rf"(?:readonly\s+)?(?P<name>{_ID}|'[^'\n]*'|\"[^\"\n]*\")\s*\??\s*(?=[<(:;,\n}}])")


def _ts_members(out: Out, a: int, b: int, owner: str, kind: str) -> None:
    src = out.src
    if kind == "enum":
        for x, y in _arguments(src, a, b):
            m = re.match(r"['\"]?([\w$]+)", src.text[x:y])
            if m:
                text = src.text[x:y].rstrip()
                out.add(m[1], "enum_member", text, x, x + len(text), owner)
        return
    i = a
    while (i := src.blank(i, b)) < b:
        m = _TS_MEMBER.match(src.mask, i, b)
        if not m:  # a call or index signature, or a mark between members
            i = src.close[i] + 1 if i in src.close else i + 1
            if src.mask[i - 1] in ")]" and src.mask[src.blank(i, b) : src.blank(i, b) + 1] == ":":
                i = src.type_end(src.blank(i, b) + 1, b)
            continue
        head = _js_head(src, m.end(), b) if src.mask[m.end() : m.end() + 1] in ("<", "(") else None
        end = head[1] if head else m.end()
        if not head and src.mask[end : end + 1] == ":":
            end = src.type_end(end + 1, b)
        text = src.text[i:end].rstrip()
        out.add(src.text[m.start("name") : m.end("name")], "method" if head else "property", text, i, i + len(text), owner)
        i = max(end, m.end())


# --- Python ---

_PY_DEF = re.compile(r"(?P<indent>[ \t]*)(?P<async>async[ \t]+)?(?P<what>def|class)[ \t]+(?P<name>\w+)", re.A)
_PY_FROM = re.compile(r"[ \t]*from[ \t]+(?P<source>[.\w]+)[ \t]+import[ \t]+(?P<names>\([^)]*\)|[^\n#;]*)", re.A)
_PY_IMPORT = re.compile(r"[ \t]*import[ \t]+(?P<names>[^\n#;]+)", re.A)


class _Block:
    """A def or class whose lines are being read: its indent, its name and that of its body's lines, once one is seen."""

    def __init__(self, indent: int, what: str, name: str, closed: bool):
        self.indent, self.what, self.name, self.closed, self.body = indent, what, name, closed, None


def _python(out: Out) -> None:
    """Functions in functions are told, with the outer one as parent; of a class its methods only, and nothing of what stands
    in them or in decorated functions."""
    src = out.src
    rows = src.mask.split("\n")
    depth = [len(r) - len(r.lstrip()) if r.strip() else None for r in rows]
    inside = [False] * len(rows)  # a line that goes on inside brackets
    for o, c in src.close.items():
        for k in range(src.line(o), src.line(c)):
            inside[k] = True
    blocks: list[_Block] = []
    decorators: list[str] = []
    for k, row in enumerate(rows):
        if depth[k] is None or inside[k]:
            continue
        pos = src.starts[k]
        while blocks and depth[k] <= blocks[-1].indent:
            blocks.pop()
        if blocks and blocks[-1].body is None:
            blocks[-1].body = depth[k]
        if row.lstrip().startswith("@"):
            decorators.append(src.text[pos : pos + len(row)].strip())
            continue
        closed = any(x.closed for x in blocks)
        m = _PY_DEF.match(src.mask, pos, pos + len(row))
        if m:
            last = k
            for j in range(k + 1, len(rows)):
                if depth[j] is None or inside[j]:
                    last = j if inside[j] else last
                    continue
                if depth[j] <= depth[k]:
                    break
                last = j
            end = src.starts[last] + len(rows[last])
            parent = blocks[-1].name if blocks else None
            head = "".join(d + "\n" for d in decorators)
            start = src.starts[k] + depth[k]
            method = m["what"] == "def" and blocks and blocks[-1].what == "class" and depth[k] == blocks[-1].body and not any(x.closed for x in blocks[:-1])
            if m["what"] == "class" and not closed:
                out.add(m["name"], "class", head + f"class {m['name']}", start, end, parent)
            elif m["what"] == "def" and (method or not closed):
                params, _ = _params(src, m.end(), end)
                out.add(m["name"], "method" if parent else "function", head + f"def {m['name']}({params})", start, end, parent, asynchronous=bool(m["async"]))
            blocks.append(_Block(depth[k], m["what"], m["name"], m["what"] == "class" or bool(decorators)))
        elif not closed:
            m = _PY_FROM.match(src.mask, pos)
            if m:
                names = [x.split()[0] for x in m["names"].strip("()").split(",") if x.strip() and x.strip() != "*"]
                out.use(m["source"], names, pos)
            elif m := _PY_IMPORT.match(src.mask, pos):
                names = [x.strip() for x in m["names"].split(",") if x.strip()]
                out.use(names[0], [names[0], *(x for x in names[1:] if len(x.split()) == 1)], pos)
        decorators = []


# --- Go, Rust, Java, C# ---


def _go(out: Out) -> None:
    """Symbols in the order of the text; an interface's methods stand before it. What stands in a function names it as parent."""
    src, n = out.src, len(out.src.mask)
    found: list[tuple] = []
    bodies: list[tuple[int, int, str]] = []
    for m in re.finditer(r"^func\s+(?P<recv>\([^)]*\)\s*)?(?P<name>\w+)\s*(?:\[[^\]]*\])?\(", src.mask, re.M):
        params, after = _params(src, m.end() - 1, n)
        o = src.brace(after, min(n, _line_end(src, after)))
        end = src.close.get(o, n - 1) + 1 if o >= 0 else _line_end(src, after)
        if o >= 0:
            bodies.append((o, end, m["name"]))
        if m["recv"]:
            recv = m["recv"].strip()
            result = src.text[after:o].strip() if o >= 0 else ""
            owner = re.sub(r"^(?:\w+\s+)?\*?", "", recv[1:-1].strip()) or None
            sig = f"func {recv} {m['name']}({params})" + (f" {result}" if result else "")
            found.append((m.start(), (m["name"], "method", sig, m.start(), end, owner)))
        else:
            found.append((m.start(), (m["name"], "function", src.whole_line(m.start()), m.start(), end)))

    def parent(pos: int) -> str | None:
        return next((name for a, b, name in bodies if a < pos < b), None)

    def specs(m: re.Match):
        """Spans of what stands in the brackets, or on the line."""
        a, b = (m.end(), src.close.get(m.end() - 1, n)) if m["group"] else (m.end(), _line_end(src, m.end()))
        i = a
        while i < b:
            k = re.compile(r"\s*(\w+)").match(src.mask, i, b)
            if not k:
                nxt = src.mask.find("\n", i, b)
                i = b if nxt < 0 else nxt + 1
                continue
            e = k.end()
            while e < b and src.mask[e] not in "\n;":
                e = src.close.get(e, e) + 1 if src.mask[e] in "([{" else e + 1
            yield k.start(1), e, k[1]
            i = e + 1

    for m in re.finditer(r"^[ \t]*type\s+(?P<group>\()?", src.mask, re.M):
        for a, e, name in specs(m):
            if src.mask[src.blank(a + len(name), e) : e][:1] == "=":  # an alias is no type of its own
                continue
            what = re.compile(r"\s*(?:\[[^\]]*\]\s*)?(struct|interface)\b").match(src.mask, a + len(name), e)
            e = a + len(src.text[a:e].rstrip())
            if what and what[1] == "interface":
                o = src.mask.find("{", a, e)
                for k in re.finditer(r"^[ \t]*(\w+)\(", src.mask[o + 1 : e - 1], re.M) if o >= 0 else []:
                    p = o + 1 + k.start(1)
                    stop = min(_line_end(src, p), e - 1)
                    text = src.text[p:stop].strip()
                    found.append((a, (k[1], "method", text, p, p + len(text), name)))
            kind = {"struct": "class", "interface": "interface"}.get(what[1] if what else "", "type")
            other = re.sub(r"^\s*\[[^\]]*\](?=\s)", "", src.text[a + len(name) : e])
            found.append((a, (name, kind, f"type {name} {what[1] if what else other.strip()}", a, e, parent(a))))
    for m in re.finditer(r"^[ \t]*(?P<what>const|var)\s+(?P<group>\()?", src.mask, re.M):
        for a, e, name in specs(m):
            found.append((a, (name, "constant" if m["what"] == "const" else "variable", src.whole_line(a), a, a + len(src.text[a:e].rstrip()), parent(a))))
    for _, args in sorted(found, key=lambda f: f[0]):
        out.add(*args)
    for m in re.finditer(r"^import\s+(?P<group>\()?", src.mask, re.M):
        a, b = (m.end(), src.close.get(m.end() - 1, n)) if m["group"] else (m.end(), _line_end(src, m.end()))
        for k in re.finditer(r'"[^"\n]*"', src.mask[a:b]):
            out.use(src.text[a + k.start() + 1 : a + k.end() - 1], [], a + k.start())


def _line_end(src: Source, pos: int) -> int:
    e = src.mask.find("\n", pos)
    return len(src.mask) if e < 0 else e


def _rust(out: Out, a: int, b: int, scope: str | None, members: bool = False) -> None:
    """members: of an impl, whose functions are told and nothing else, nor what stands in them."""
    src = out.src
    decl = re.compile(r"(?P<pub>pub(?:\([^)]*\))?\s+)?(?:(?P<async>async\s+)|(?:unsafe|const(?=\s+fn)|extern)\s+)*(?:fn\s+(?P<fn>\w+)|struct\s+(?P<struct>\w+)|enum\s+(?P<enum>\w+)|trait\s+(?P<trait>\w+)|impl(?P<impl>\b[^{;]*)|type\s+(?P<type>\w+)|(?P<cs>const|static)\s+(?:mut\s+)?(?P<item>\w+)|mod\s+(?P<mod>\w+)|(?P<use>use\b))|macro_rules!\s*(?P<macro>\w+)")
    walk, skip = _statements(src, a, b), None
    while True:
        try:
            pos = walk.send(skip)
        except StopIteration:
            return
        skip = None
        m = decl.match(src.mask, pos, b)
        if not m:
            continue
        pub = bool(m["pub"])
        if members and not m["fn"]:
            skip = src.end_of(m.end(), b)
            continue
        if m["use"]:
            end = src.mask.find(";", pos, b)
            end = b if end < 0 else end
            out.use(re.sub(r"^use\s+", "", src.text[pos:end].strip()), [], pos)
            skip = end + 1
            continue
        o = src.brace(m.end(), b)
        end = src.close.get(o, b - 1) + 1 if o >= 0 else src.end_of(m.end(), b)
        if m["fn"]:
            params, after = _params(src, src.skip_angle(m.end(), b), b)
            ret = re.match(r"\s*->\s*([^{;]+?)\s*(?:where\b|$)", src.text[after : o if o >= 0 else end - 1])
            sig = f"fn {m['fn']}({params})" + (f" -> {ret[1]}" if ret else "")
            out.add(m["fn"], "method" if scope else "function", sig, pos, end, scope, pub, bool(m["async"]))
            if o >= 0 and not members:
                _rust(out, o + 1, end - 1, m["fn"])
        elif m["struct"]:
            out.add(m["struct"], "class", f"struct {m['struct']}", pos, end, scope, pub)
        elif m["enum"]:
            out.add(m["enum"], "enum", f"enum {m['enum']}", pos, end, scope, pub)
            for x, y in _arguments(src, o + 1, end - 1) if o >= 0 else []:
                text = src.text[x:y].strip()
                out.add(re.match(r"\w*", text)[0], "enum_member", text, x, x + len(text), m["enum"])
        elif m["trait"]:
            out.add(m["trait"], "trait", f"trait {m['trait']}", pos, end, scope, pub)
            p = o + 1
            while o >= 0 and p < end - 1:
                k = re.compile(r"\bfn\s+(\w+)").search(src.mask, p, end - 1)
                block = src.mask.find("{", p, k.start() if k else end - 1)
                if not k or block >= 0 and src.close.get(block, block) > block:  # what stands in a body is passed over
                    if block < 0:
                        break
                    p = src.close.get(block, block) + 1
                    continue
                params, after = _params(src, src.skip_angle(k.end(), end), end)
                stop = src.end_of(after, end - 1)
                ret = re.match(r"\s*->\s*([^{;]+?)\s*(?:where\b|[{;])", src.text[after:stop])
                out.add(k[1], "method", f"fn {k[1]}({params})" + (f" -> {ret[1]}" if ret else ""), k.start(), stop, m["trait"])
                p = stop
        elif m["impl"] is not None and o >= 0:
            i = src.skip_angle(m.start("impl"), o)
            head = re.split(r"\bwhere\b", src.text[i:o])[0].strip()
            trait, _, target = head.rpartition(" for ")
            target = target.strip()
            out.add(target, "impl", f"impl {trait.strip()} for {target}" if trait else f"impl {target}", pos, end)
            _rust(out, o + 1, end - 1, target, True)
        elif m["type"]:
            out.add(m["type"], "type", src.whole_line(pos), pos, end, scope, pub)
        elif m["item"]:
            out.add(m["item"], "constant" if m["cs"] == "const" else "variable", src.whole_line(pos), pos, src.end_of(m.end(), b), scope, pub)
        elif m["macro"]:
            out.add(m["macro"], "macro", f"macro_rules! {m['macro']}", pos, end, scope)
        elif m["mod"] and o >= 0:
            _rust(out, o + 1, end - 1, scope)
        skip = end


_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|partial|virtual|override|readonly|async|synchronized|native|default|strictfp|unsafe|extern|new|const|volatile|transient|required|ref|file|non-sealed)\s+)*"
_HEAD = re.compile(_MODS)
_NAME = re.compile(r"[A-Za-z_]\w*(?:\s*(?:\.|::)\s*[A-Za-z_]\w*)*")
_TYPE_WORDS = ("class", "struct", "interface", "enum", "record", "delegate", "event", "operator", "implicit", "explicit")


def _notes_end(src: Source, pos: int, limit: int) -> int:
    """Past the annotations of Java or the attributes of C# at pos."""
    while pos < limit:
        if src.mask[pos] == "[" and pos in src.close:
            pos = src.blank(src.close[pos] + 1, limit)
            continue
        m = re.compile(r"@(?!interface\b)[\w.]+\s*").match(src.mask, pos, limit)
        if not m:
            break
        pos = m.end()
        if src.mask[pos : pos + 1] == "(" and pos in src.close:
            pos = src.blank(src.close[pos] + 1, limit)
    return pos


def _type_at(src: Source, pos: int, limit: int) -> int:
    """One past the type of Java or C# at pos, with its arguments and brackets, or -1."""
    if src.mask[pos : pos + 1] == "(" and pos in src.close:  # a tuple
        i = src.close[pos] + 1
    else:
        m = _NAME.match(src.mask, pos, limit)
        if not m:
            return -1
        i = m.end()
    while i < limit:
        e = src.blank(i, limit)
        ch = src.mask[e : e + 1]
        if ch == "<" and src.angle(e, limit) > 0:
            i = src.angle(e, limit)
            more = re.compile(r"\.[A-Za-z_]\w*").match(src.mask, i, limit)
            i = more.end() if more else i
        elif ch == "[" and e in src.close and not src.mask[e + 1 : src.close[e]].strip(", "):
            i = src.close[e] + 1
        elif ch in ("?", "*"):
            i = e + 1
        else:
            break
    return i


def _classy(out: Out, a: int, b: int, scope: str | None, lang: str) -> None:
    """Java and C#: types at this level, with their members."""
    src = out.src
    decl = re.compile(rf"(?P<head>{_MODS}(?:(?P<what>class|interface|enum|struct|@interface|record|namespace)\s+(?P<name>[\w.]+)))")
    walk, skip = _statements(src, a, b), None
    while True:
        try:
            pos = walk.send(skip)
        except StopIteration:
            return
        skip = None
        m = re.compile(r"(?:global\s+)?(?:import|using)\s+(?:static\s+)?(?:unsafe\s+)?(?P<t>[\w.]+)(?P<star>\.\*)?\s*(?:;|(?P<alias>=)[^;]*;)").match(src.mask, pos, b)
        if m and (lang == "java") == src.mask.startswith("import", pos) and not (lang == "java" and m["alias"]):
            # Of ``using X = Y.Z;`` the first name is told, which is X.
            source = m["t"].rstrip(".")
            out.use(source, [source.split(".")[-1]], pos)
            skip = m.end()
            continue
        m = decl.match(src.mask, _notes_end(src, pos, b), b)
        if not m:
            continue
        o = src.body(m.end(), b)
        what, name = m["what"], m["name"]
        if o < 0:  # a namespace for the whole file is no symbol
            continue
        end = src.close.get(o, b - 1) + 1
        if what == "namespace":
            out.add(name, "namespace", f"namespace {name}", pos, end, scope)
            kept = len(out.imports)
            _classy(out, o + 1, end - 1, name, lang)
            del out.imports[kept:]
        elif what == "enum":
            out.add(name, "enum", f"enum {name}", pos, end, scope)
            stop = src.mask.find(";", o, end)
            for x, y in _arguments(src, o + 1, stop if stop > 0 else end - 1):
                word = re.match(r"\w+", src.text[x:y])
                if word:
                    out.add(word[0], "enum_member", word[0], x, x + len(src.text[x:y].rstrip()), name)
        elif what == "@interface":
            out.add(name, "annotation", f"@interface {name}", pos, end, scope)
        elif what == "record":  # no symbol, but its members are those of what it stands in
            _class_members(out, o + 1, end - 1, name, lang, what, scope)
        else:
            kind = "interface" if what == "interface" else "class"
            out.add(name, kind, f"{what} {name}", pos, end, scope)
            _class_members(out, o + 1, end - 1, name, lang, what, name)
        skip = end


def _class_members(out: Out, a: int, b: int, cls: str, lang: str, what: str, parent: str | None) -> None:
    """Methods, constructors, properties (C#) and fields (Java) of a type; of an interface its methods only."""
    src = out.src
    walk, skip = _statements(src, a, b), None
    while True:
        try:
            pos = walk.send(skip)
        except StopIteration:
            return
        end = src.end_of(pos, b)
        skip = end if end > pos + 1 else None
        i = _HEAD.match(src.mask, _notes_end(src, pos, b), b).end()
        i = src.skip_angle(i, b)  # type parameters that come first
        i = _HEAD.match(src.mask, _notes_end(src, i, b), b).end()
        first = _NAME.match(src.mask, i, b)
        if first and first[0] in _TYPE_WORDS:
            continue
        if first and src.mask[src.blank(first.end(), b) : src.blank(first.end(), b) + 1] == "(":
            params, after = _params(src, first.end(), b)
            end = src.end_of(after, b)
            if first[0] == cls and what not in ("struct", "interface"):
                out.add(cls, "constructor", f"{cls}({params})", pos, end, parent)
            skip = end
            continue
        j = _type_at(src, i, b)
        name = _NAME.match(src.mask, src.blank(j, b), b) if j > 0 else None
        if not name or name[0] in _TYPE_WORDS:
            continue
        kind, word = src.text[i:j].strip(), name[0].rsplit(".", 1)[-1].strip()
        at = src.skip_angle(name.end(), b)
        ch = src.mask[at : at + 1]
        if ch == "(" and at in src.close:
            params, after = _params(src, at, b)
            end = src.end_of(after, b)
            # Of an interface in C# no type of a result is told.
            out.add(word, "method", f"{'void' if lang == 'csharp' and what == 'interface' else kind} {word}({params})", pos, end, parent)
            skip = end
        elif lang == "csharp" and (ch == "{" or src.mask.startswith("=>", at)):
            end = src.close.get(at, b - 1) + 1 if ch == "{" else src.end_of(at, b)
            rest = src.blank(end, b)
            if ch == "{" and src.mask[rest : rest + 1] == "=":  # a first value
                end = src.end_of(rest, b)
            if what != "interface":
                out.add(word, "property", f"{kind} {word}", pos, end, parent)
            skip = end
        elif ch in ("=", ";", ",") or ch == "[":
            end = src.mask.find(";", at, b) + 1 or b
            for word, stop in _declared(src, name.start(), b):
                end = stop
                if lang == "java" and what != "interface":
                    out.add(word, "property", src.whole_line(pos), pos, end, parent)
            skip = end


def _declared(src: Source, pos: int, limit: int):
    """(name, one past the statement's ;) of each variable in a list of them."""
    names, i, begins = [], pos, True
    while i < limit and src.mask[i] != ";":
        m = _NAME.match(src.mask, i, limit)
        if m:
            if begins:
                names.append(m[0])
            begins, i = False, src.skip_angle(m.end(), limit) if src.mask[m.end() : m.end() + 1] == "<" else m.end()
            continue
        begins = src.mask[i] == "," or begins and src.mask[i].isspace()
        i = src.close.get(i, i) + 1
    return [(n, min(i + 1, limit)) for n in names]


def scan(content: str, lang: str) -> tuple[list[tuple], list[tuple]]:
    """(symbols, imports) of a file; empty for other languages and for what cannot be read."""
    if not content:
        return [], []
    src = Source(content, lang)
    out = Out(src)
    if lang in ("javascript", "typescript", "tsx"):
        _javascript(out, 0, len(content), None, lang != "javascript")
    elif lang == "python":
        _python(out)
    elif lang == "go":
        _go(out)
    elif lang == "rust":
        _rust(out, 0, len(content), None)
    elif lang in ("java", "csharp"):
        _classy(out, 0, len(content), None, lang)
    return out.symbols, out.imports


def link_children(symbols: list[tuple]) -> dict[int, list[int]]:
    """Number of a parent to its children's: by name, a top-level parent first, one that is no impl first."""
    best: dict[str, int] = {}
    for i, s in enumerate(symbols):
        rank = lambda k: (symbols[k][7] is not None, symbols[k][1] == "impl", k)
        if s[0] not in best or rank(i) < rank(best[s[0]]):
            best[s[0]] = i
    out: dict[int, list[int]] = {}
    seen = set()
    for i, s in enumerate(symbols):
        p = best.get(s[7]) if s[7] else None
        if p is not None and p != i and (p, s[0], s[3]) not in seen:
            seen.add((p, s[0], s[3]))
            out.setdefault(p, []).append(i)
    return out
