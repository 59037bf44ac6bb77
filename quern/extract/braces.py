"""Entities of one file of a language with braces: a lexer, matched brackets, then one pass by declarations.

Works on broken files too: what a declaration lacks is null, an unclosed block ends with the file.
"""

from __future__ import annotations

import re
from bisect import bisect_right

_TOKEN = re.compile(
    r"(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))"
    r"|(?P<string>r\"\"\".*?\"\"\"|\"\"\".*?\"\"\"|r?'''.*?'''|r(?P<h>#+)\".*?\"(?P=h)|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')"
    r"|(?P<directive>^[ \t]*\#[ \t]*\w+[^\n]*)"
    r"|(?P<name>[#@]?[A-Za-z_$][\w$]*|@)|(?P<number>\d[\w.]*)"
    r"|(?P<op>=>|->|::|\?\.|\.\.\.?|:=|[-+*/%&|^!=<>]=|&&|\|\||[^\w\s])", re.S | re.M)
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")": "(", "]": "[", "}": "{"}
#: Words that look like calls or declarations but are none.
_CONTROL = frozenset("if for while switch catch return sizeof match loop else do try throw await yield when with assert in case typeof delete void super this func fn function new".split())
_CONTROL_GO = frozenset("select defer go chan range make struct interface".split())
_MODIFIERS = frozenset("public private protected internal static final abstract async override readonly declare export default synchronized native const constexpr inline virtual explicit extern unsafe pub external late covariant get set transient volatile strictfp sealed open friend".split())
_CLASS_WORDS = {
    "typescript": {"class"}, "javascript": {"class"}, "java": {"class", "interface", "enum", "record"}, "c": {"struct"}, "cpp": {"class", "struct"},
    "dart": {"class", "mixin", "extension", "enum"}, "rust": {"struct", "impl"}, "go": set()}


class Source:
    """Tokens ``(kind, text, start, end)`` without comments, the comments, and the partner of every bracket."""

    def __init__(self, text: str, language: str):
        self.text, self.language = text, language
        self.lines = [0, *[m.end() for m in re.finditer("\n", text)]]
        self.tokens: list[tuple[str, str, int, int]] = []
        self.comments: list[tuple[int, int]] = []
        self.directives: list[str] = []
        at = 0
        while m := _TOKEN.search(text, at):
            at, kind = m.end(), m.lastgroup
            if kind == "h":
                kind = "string"
            s = m.group()
            if kind == "string" and language == "rust" and s[0] == "'" and not re.fullmatch(r"'(?:\\.[^']*|[^\\'])'", s, re.S):
                at = m.start() + 1  # a lifetime
                continue
            if kind == "comment":
                self.comments.append((m.start(), m.end()))
            elif kind == "directive":
                if language in ("c", "cpp"):
                    self.directives.append(s)
                else:
                    at = m.start() + s.index("#") + 1
                    if language == "javascript" or language == "typescript":
                        n = re.compile(r"#[A-Za-z_$][\w$]*").match(text, at - 1)
                        if n:
                            self.tokens.append(("name", n.group(), n.start(), n.end()))
                            at = n.end()
            else:
                self.tokens.append((kind, s, m.start(), m.end()))
        self.partner: dict[int, int] = {}
        #: The innermost bracket that is open at a token; -1 outside of all.
        self.outer: list[int] = []
        stack: list[int] = []
        for i, (kind, s, _, _) in enumerate(self.tokens):
            self.outer.append(stack[-1] if stack else -1)
            if kind == "op" and s in _OPEN:
                stack.append(i)
            elif kind == "op" and s in _CLOSE:
                while stack and self.tokens[stack[-1]][1] != _CLOSE[s]:
                    stack.pop()
                if stack:
                    j = stack.pop()
                    self.partner[i], self.partner[j] = j, i

    def word(self, i: int) -> str:
        return self.tokens[i][1] if 0 <= i < len(self.tokens) else ""

    def is_name(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i][0] == "name"

    def close(self, i: int) -> int:
        return self.partner.get(i, len(self.tokens) - 1)

    def line(self, position: int) -> int:
        return bisect_right(self.lines, position)

    def slice(self, i: int, j: int) -> str:
        return self.text[self.tokens[i][2]: self.tokens[min(j, len(self.tokens) - 1)][3]] if i <= j and i < len(self.tokens) else ""

    def generics_end(self, i: int) -> int:
        """The place after ``<...>`` that starts at ``i``; ``i`` if none does."""
        if self.word(i) != "<":
            return i
        depth, j = 0, i
        while j < len(self.tokens):
            w = self.word(j)
            depth += (w == "<") - (w == ">")
            if w in ("(", "["):
                j = self.close(j)
            elif w in (";", "{", "}"):
                return i
            if depth == 0:
                return j + 1
            j += 1
        return i

    def doc_before(self, start: int) -> str | None:
        """The comment that ends right before a place, as the language's documentation."""
        at = bisect_right(self.comments, (start, start)) - 1
        if at < 0:
            return None
        a, b = self.comments[at]
        if self.text[b:start].strip():
            return None
        body = self.text[a:b]
        if self.language in ("typescript", "javascript") and body.startswith("/**"):
            return "\n".join(re.sub(r"^\s*\*\s?", "", x) for x in body[3:-2].split("\n")).strip()
        if self.language == "go" and body.startswith("//"):
            return body.lstrip("/").strip()
        return None


def _type_parameters(src: Source, i: int, j: int) -> list[dict]:
    out, depth, part = [], 0, []
    for k in range(i + 1, j):
        w = src.word(k)
        if w == "," and depth == 0 or k == j - 1:
            text = src.text[src.tokens[part[0]][2]: src.tokens[part[-1]][3]] if part else ""
            m = re.match(r"(?:const\s+)?('?\w+)\s*(?:(?:extends|:)\s*(.+?))?\s*(?:=\s*(.+))?$", text, re.S)
            if m:
                out.append({"name": m.group(1), "constraint": m.group(2), "default": m.group(3), "variance": None})
            part = []
            continue
        depth += (w in "<([") - (w in ">)]")
        part.append(k)
    return out


def calls_of(src: Source, i: int, j: int) -> tuple[list[str], list[dict]]:
    """The calls between two tokens: names (plain ones first), and details."""
    lang, plain, methods, seen = src.language, [], [], set()
    for k in range(i, j):
        dotted = src.word(k - 1) in (".", "?.", "->", "..")
        if not src.is_name(k) or src.word(k).startswith("@") or not dotted and (src.word(k) in _CONTROL or lang == "go" and src.word(k) in _CONTROL_GO):
            continue
        after = k + 1
        if src.word(after) == "::" and src.word(after + 1) == "<":
            after += 1
        if src.word(after) == "<":
            after = src.generics_end(after)
        if src.word(after) != "(" or src.word(k - 1) in ("function", "fn", "func", "@"):
            continue
        before, name = src.word(k - 1), src.word(k)
        line = src.line(src.tokens[k][2])
        flags = {"is_nested": False, "is_chained": src.word(src.close(after) + 1) in (".", "?.", "->"), "line": line}
        around = src.outer[k]
        while around > i and src.word(around) != "{":
            if src.word(around) == "(" and src.is_name(around - 1) and src.word(around - 1) not in _CONTROL:
                flags["is_nested"] = True
                break
            around = src.outer[around]
        if before in (".", "?.", "->", "..") or before == "::" and lang == "cpp":
            r = k - 2
            receiver = None
            if before == "..":  # a cascade: the object before the first one
                while r >= i and src.word(r) != ";":
                    if src.word(r) == ")":
                        r = src.partner.get(r, r) - 1
                        continue
                    if src.is_name(r) and src.word(r - 1) != "..":
                        receiver = src.word(r)
                        break
                    r -= 1
            while before != ".." and r >= i:
                if src.word(r) in (")", "]"):
                    r = src.partner.get(r, r) - 1
                    continue
                if src.is_name(r):
                    receiver = src.word(r)
                    if src.word(r - 1) in (".", "?.", "->", "::"):
                        r -= 2
                        continue
                break
            methods.append({"name": name.lstrip("#"), "call_type": "static" if receiver and receiver[0].isupper() else "method", "receiver": receiver, **flags})
            continue
        if before == "::" or before == "new" and lang in ("typescript", "java"):
            continue
        # A declaration of a method or local function, not a call of it.
        tail = src.close(after) + 1
        if lang in ("java", "c", "cpp", "dart") and src.is_name(k - 1) and src.word(k - 1) not in _CONTROL | {"new", "return", "await", "const"} and src.word(tail) in ("{", "=>", "async"):
            continue
        if name in seen:
            continue
        seen.add(name)
        made = lang == "go" and re.match(r"(New|Make)[A-Z]?", name) or lang == "rust" and (name == "new" or name.startswith("new_")) or lang in ("java", "dart") and name[0].isupper()
        plain.append({"name": name, "call_type": "constructor" if made else "function", "receiver": None, **flags})
    details = plain + methods
    return list(dict.fromkeys(c["name"] for c in details)), details


def _imports(src: Source) -> list[str]:
    text, lang, out = src.text, src.language, []
    toks = src.tokens
    if lang in ("c", "cpp"):
        out = [m.group(1) for d in src.directives if (m := re.match(r"\s*#\s*include\s*([<\"][^>\"]+[>\"])", d))]
        return sorted({x.strip("<>\"") if x[0] == '"' else x for x in out})
    for i, (kind, w, start, _) in enumerate(toks):
        if kind != "name":
            continue
        if lang in ("typescript", "javascript"):
            if w in ("import", "export") and src.word(i - 1) != ".":
                j = i + 1
                if src.word(j) == "(":
                    j += 1
                names, braced = [], False
                while j < len(toks) and toks[j][0] != "string" and src.word(j) not in (";", "=", "class", "function", "const", "interface", "type") and src.line(toks[j][2]) <= src.line(start) + 40:
                    braced = braced and src.word(j) != "}" or src.word(j) == "{"
                    if braced and toks[j][0] == "name" and src.word(j) not in ("as", "default", "type") and src.word(j - 1) != "as":
                        names.append(src.word(j))
                    j += 1
                if j < len(toks) and toks[j][0] == "string" and (src.word(j - 1) in ("from", "import", "(")):
                    out.append(toks[j][1].strip("'\"`"))
                    if lang == "typescript" and w == "import":
                        out += names
            elif w == "require" and src.word(i + 1) == "(" and i + 2 < len(toks) and toks[i + 2][0] == "string":
                out.append(toks[i + 2][1].strip("'\"`"))
        elif lang == "go" and w == "import":
            end = src.close(i + 1) if src.word(i + 1) == "(" else i + 3
            out += [t[1].strip('"`') for t in toks[i + 1: end + 1] if t[0] == "string"]
        elif lang == "rust" and w == "use" and (i == 0 or src.word(i - 1) in (";", "}", "{", "pub", ")", "]")):
            j = next((k for k in range(i, len(toks)) if src.word(k) == ";"), len(toks) - 1)
            out.append(text[toks[i + 1][2]: toks[j][2]].strip() if i + 1 < len(toks) else "")
        elif lang == "java" and w == "import":
            j = next((k for k in range(i, len(toks)) if src.word(k) == ";"), len(toks) - 1)
            out.append(re.sub(r"^static\s+", "", text[toks[i + 1][2]: toks[j][2]].strip()) if i + 1 < len(toks) else "")
        elif lang == "dart" and w in ("import", "export", "part") and i + 1 < len(toks) and toks[i + 1][0] == "string":
            out.append(toks[i + 1][1].strip("'\""))
    return sorted({x for x in out if x})


def _head(src: Source, i: int) -> int:
    """The first token of a declaration whose name or keyword is at ``i``: modifiers and the type before it belong to it."""
    while i > 0 and (src.tokens[i - 1][0] == "name" and src.word(i - 1) not in ("return", "new", "else") and not src.word(i - 1).startswith("@") or src.word(i - 1) in (">", "*", "&", "]", "<", ",", "?", "::") and src.language in ("java", "dart", "c", "cpp")):
        if src.word(i - 1) == "," and src.language in ("c", "cpp"):
            break
        if src.word(i - 1) == "]" and src.partner.get(i - 1, 0) > 0 and not src.is_name(src.partner[i - 1] - 1):
            break
        i -= 1
    return i


def brace_entities(text: str, language: str) -> tuple[list[dict], list[dict], list[dict], list[str]]:
    """Functions, classes, types and imports."""
    src = Source(text, language)
    functions, classes, types = [], [], []
    scopes: list[tuple[str, int, int]] = []  # name, body start, body end
    bodies: list[tuple[dict, int, int]] = []  # class, body start, body end
    places: list[int] = []  # where each function is named
    n = len(src.tokens)

    class_names: set[str] = set()

    def around(i: int) -> list[tuple[str, int, int]]:
        """The classes around a token, the outermost first; tokens are asked for in order, so those that ended are dropped."""
        while scopes and scopes[-1][2] <= i:
            scopes.pop()
        return [s for s in scopes if s[1] < i < s[2]]

    def inside(i: int) -> str | None:
        return ".".join(s[0] for s in around(i)) or None

    def words_before(i: int) -> set[str]:
        return {src.word(k) for k in range(_head(src, i), i)}

    def span(first: int, last: int) -> dict:
        head = src.tokens[first]
        while language in ("typescript", "javascript") and src.word(first) in ("export", "default", "declare") and first < last:
            first += 1  # the statement around a declaration is no part of it
        a, b = src.tokens[first], src.tokens[min(last, n - 1)]
        return {"start_line": src.line(a[2]), "end_line": src.line(b[3] - 1), "code": text[a[2]: b[3]], "docstring": src.doc_before(head[2]), "_end": b[3]}

    def annotated(first: int) -> bool:
        k = first - 1
        if src.word(k) == ")":
            k = src.partner.get(k, 0) - 1
        while src.is_name(k) and src.word(k - 1) == ".":
            k -= 2
        return src.is_name(k) and src.word(k).startswith("@")

    def access(words: set[str], name: str, first: int) -> str | None:
        if language in ("typescript", "javascript", "java"):
            if name.startswith("#"):
                return "private"
            return next((w for w in ("public", "private", "protected") if w in words), "package" if language == "java" and (words & _MODIFIERS or annotated(first)) else None)
        if language == "rust":
            return "public" if "pub" in words else "private"
        return None

    def decorators(first: int) -> list[str]:
        out, k = [], first - 1
        while k >= 0:
            e = k
            if src.word(k) == ")":
                k = src.partner.get(k, k) - 1
            dotted = []
            while src.is_name(k):
                dotted.insert(0, src.word(k).lstrip("@"))
                if src.word(k).startswith("@"):
                    out.append(".".join(dotted))
                    k -= 1
                    break
                if src.word(k - 1) != ".":
                    return out
                k -= 2
            else:
                return out
            if k == e:
                return out
        return out

    def add_function(at: int, name: str, params: int, body: int | None, end: int, **more) -> None:
        first = more.pop("first", None)
        first = _head(src, at) if first is None else first
        words = {src.word(k) for k in range(first, at)}
        stop = src.close(params)
        owner = more.pop("owner", inside(at))
        type_start = next((k for k in range(at + 1, params) if src.word(k) == "<"), None)
        if language == "java" and type_start is None and "<" in words:
            k = next(k for k in range(first, at) if src.word(k) == "<")
            type_start = k if src.word(k - 1) in _MODIFIERS or k == first else None
        calls, details = calls_of(src, body if body is not None else stop + 1, end)
        cls = owner.rsplit(".", 1)[-1] if owner else None
        made = {
            "typescript": name == "constructor", "javascript": name == "constructor", "java": name == cls, "c": name == cls, "cpp": name == cls,
            "go": owner is None and re.match(r"New([A-Z]|$)", name) is not None, "rust": name == "new" or name.startswith("new_"), "dart": more.pop("made", False)}[language]
        more.pop("made", None)
        places.append(at)
        functions.append({
            "name": name, **span(first, end), "signature": name + src.slice(params, stop), "class_name": owner, "decorators": decorators(first) if language in ("typescript", "javascript") else [],
            "calls": calls, "call_details": details, "is_async": "async" in words or more.pop("is_async", False), "is_constructor": bool(made), "access_modifier": access(words, name, first),
            "is_static": "static" in words and language in ("typescript", "javascript", "java"), "is_abstract": "abstract" in words,
            "type_parameters": _type_parameters(src, type_start, src.generics_end(type_start)) if type_start is not None and language in ("typescript", "javascript", "java", "rust") else [],
            "return_type": more.pop("return_type", None)})

    def result_text(a: int, b: int) -> str | None:
        return src.slice(a, b - 1).strip() or None if b > a else None

    i = 0
    while i < n:
        kind, w, start, _ = src.tokens[i]
        before = src.word(i - 1)
        if kind != "name" or before in (".", "?."):
            i += 1
            continue
        # -- classes --------------------------------------------------------------------------
        is_type_word = w in _CLASS_WORDS[language] and (src.is_name(i + 1) or w == "impl") and not (w == "struct" and language == "c" and src.word(i + 2) != "{")
        if is_type_word:
            j = src.generics_end(i + 1) if w == "impl" else i + 1
            if language == "cpp" and before == "enum":
                i += 1
                continue
            body = j
            while body < n and src.word(body) not in ("{", ";"):
                body = src.close(body) + 1 if src.word(body) in ("(", "[") else body + 1
            header = [src.word(k) for k in range(j, min(body, n))]
            name = src.word(j)
            if w == "impl" and "for" in header:
                name = header[header.index("for") + 1] if header.index("for") + 1 < len(header) else name
            has_body = src.word(body) == "{"
            if not has_body and language in ("c", "cpp", "java", "dart") or not name:
                i += 1
                continue
            end = src.close(body) if has_body else min(body, n - 1)
            first = _head(src, i)
            words = {src.word(k) for k in range(first, i)}

            def listed(after: str, stops: tuple[str, ...]) -> list[str]:
                if after not in header:
                    return []
                part, out, depth = [], [], 0
                for x in header[header.index(after) + 1:] + [","]:
                    if x in stops and depth == 0:
                        x = "{"
                    if x in (",", "{") and depth == 0:
                        if part:
                            out.append("".join(part))
                        part = []
                        if x == "{":
                            break
                        continue
                    depth += (x == "<") - (x == ">")
                    if depth == 0 and x != ">":
                        part.append(x)
                return out

            if language in ("typescript", "javascript", "dart"):
                bases = listed("extends", ("implements", "with", "on"))
            elif language == "java":
                bases = listed("extends", ("implements", "permits"))
            elif language == "cpp":
                bases = [re.sub(r"^(?:public|private|protected|virtual)+", "", b) for b in listed(":", ())]
            else:
                bases = []
            type_start = j + 1 if src.word(j + 1) == "<" else None
            classes.append({
                "name": name, **span(first, end), "bases": bases, "decorators": decorators(first) if language in ("typescript", "javascript") else [], "methods": [],
                "access_modifier": access(words, name, first), "is_abstract": "abstract" in words, "is_interface": w == "interface",
                "implements": listed("implements", ("{",)) if language == "java" else [],
                "type_parameters": _type_parameters(src, type_start, src.generics_end(type_start)) if type_start and language in ("typescript", "javascript", "java", "rust") else []})
            if has_body:
                around(i)
                scopes.append((name, body, end))
                class_names.add(name)
                bodies.append((classes[-1], body, end))
            i = body + 1
            continue
        # -- types ----------------------------------------------------------------------------
        if language == "typescript" and w in ("interface", "type") and src.is_name(i + 1) and before not in (".", "import"):
            body = src.generics_end(i + 2)
            while w == "interface" and body < n and src.word(body) != "{":
                body += 1
            if w == "interface" or src.word(body) == "=":
                end = src.close(body) if w == "interface" else next((k for k in range(body, n) if src.word(k) == ";" or k > body + 1 and src.line(src.tokens[k][2]) > src.line(src.tokens[k - 1][3]) and src.word(k) not in ("|", "&", "}", ")") and src.word(k - 1) not in ("|", "&", "=", "{", "(", ",")), n)
                if w == "type":
                    depth_end = body + 1
                    while depth_end < n and src.word(depth_end) != ";" and depth_end < end:
                        depth_end = src.close(depth_end) + 1 if src.word(depth_end) in _OPEN else depth_end + 1
                    end = min(max(depth_end - (src.word(depth_end) != ";"), body), n - 1)
                types.append({"name": src.word(i + 1), **span(_head(src, i), end), "kind": w})
                i = (body if w == "interface" else end) + 1
                continue
        if language == "go" and w == "type" and src.is_name(i + 1) or language == "go" and before == "(" and src.word(i - 2) == "type" and src.is_name(i):
            at = i + 1 if w == "type" else i
            what = at + 1
            if src.word(what) == "[":
                what = src.close(what) + 1
            if src.word(what) in ("struct", "interface") and src.word(what + 1) == "{":
                end = src.close(what + 1)
                item = {"name": src.word(at), **span(i, end)}
                if src.word(what) == "struct":
                    classes.append(item | {"bases": [], "decorators": [], "methods": [], "access_modifier": None, "is_abstract": False, "is_interface": False, "implements": []})
                else:
                    types.append(item | {"kind": "interface"})
                i = end + 1
                continue
        if language == "rust" and w in ("enum", "type") and src.is_name(i + 1):
            body = next((k for k in range(i, n) if src.word(k) in ("{", ";")), n - 1)
            end = src.close(body) if src.word(body) == "{" else body
            types.append({"name": src.word(i + 1), **span(_head(src, i), end), "kind": w})
            i = end + 1
            continue
        # -- functions ------------------------------------------------------------------------
        if language in ("typescript", "javascript") and w == "function" or language == "rust" and w == "fn" or language == "go" and w == "func":
            j = i + 1
            owner = inside(i)
            if src.word(j) == "*":
                j += 1
            if language == "go" and src.word(j) == "(":
                receiver = [t for t in (src.word(k) for k in range(j + 1, src.close(j))) if re.match(r"[A-Za-z_]", t)]
                # The receiver's type is the class of the method.
                owner = receiver[-1] if len(receiver) == 1 else receiver[1] if receiver else None
                j = src.close(j) + 1
            if src.is_name(j):
                name, params = src.word(j), j + 1
                if src.word(params) == "<":
                    params = src.generics_end(params)
                elif src.word(params) == "[" and language == "go":
                    params = src.close(params) + 1
                if src.word(params) == "(":
                    stop = src.close(params) + 1
                    body = stop
                    while body < n and src.word(body) not in ("{", ";", "}"):
                        body = src.close(body) + 1 if src.word(body) in ("(", "[") else body + 1
                        if language == "go" and src.word(body - 1) in ("interface", "struct") and src.word(body) == "{":
                            body = src.close(body) + 1
                    if src.word(body) == "{":
                        where = next((k for k in range(stop, body) if src.word(k) == "where"), body)
                        a = stop + 1 if src.word(stop) in (":", "->") else stop if language == "go" else where
                        add_function(j, name, params, body, src.close(body), owner=owner, first=i if language == "go" else _head(src, i), return_type=result_text(a, where))
                        i = body + 1
                        continue
            i += 1
            continue
        if language in ("typescript", "javascript") and w in ("const", "let", "var") and src.is_name(i + 1):
            eq = i + 2
            while eq < n and src.word(eq) not in ("=", ";", ",", "}") and src.line(src.tokens[eq][2]) == src.line(start):
                eq = src.close(eq) + 1 if src.word(eq) in _OPEN else eq + 1
            if src.word(eq) == "=":
                j = eq + 1
                is_async = src.word(j) == "async"
                j += is_async
                params = None
                if src.word(j) == "function":
                    params = j + 1 + (src.word(j + 1) == "*")
                    params += src.is_name(params)
                else:
                    p = src.generics_end(j)
                    if src.word(p) == "(":
                        arrow = src.close(p) + 1
                        if src.word(arrow) == ":":
                            while arrow < n and src.word(arrow) not in ("=>", ";", "{"):
                                arrow = src.close(arrow) + 1 if src.word(arrow) in ("(", "[", "{") else arrow + 1
                        params = p if src.word(arrow) == "=>" else None
                    elif src.is_name(j) and src.word(j + 1) == "=>":
                        params = j
                if params is not None and params < n:
                    stop = src.close(params) if src.word(params) == "(" else params
                    body = next((k for k in range(stop, n) if src.word(k) in ("=>", "{")), n - 1)
                    if src.word(body) == "=>":
                        body += 1
                    if src.word(body) == "{":
                        end = src.close(body)
                    else:
                        end = body
                        while end + 1 < n and src.word(end) != ";" and src.line(src.tokens[end + 1][2]) == src.line(src.tokens[end][3] - 1):
                            end = src.close(end) if src.word(end) in _OPEN else end
                            end += 1
                        end = min(end, n - 1)
                    colon = stop + 1
                    returns = result_text(colon + 1, body - 1) if src.word(colon) == ":" else None
                    if src.word(params) == "(":
                        add_function(i + 1, src.word(i + 1), params, body, end, is_async=is_async, return_type=returns, first=i)
                    else:
                        calls, details = calls_of(src, body, end)
                        places.append(i + 1)
                        functions.append({"name": src.word(i + 1), **span(i, end), "signature": f"{src.word(i + 1)}({src.word(params)})", "class_name": inside(i), "decorators": [], "calls": calls,
                                          "call_details": details, "is_async": is_async, "is_constructor": False, "access_modifier": None, "is_static": False, "is_abstract": False, "type_parameters": [], "return_type": None})
                    i = body + 1
                    continue
        # Methods, constructors and C-like functions: a name, parameters and a body.
        params = i + 1
        name, made = w, False
        if language == "dart" and src.word(params) == "." and src.is_name(params + 1) and src.word(params + 2) == "(" and w in class_names:
            name, params, made = src.word(params + 1), params + 2, True
        if src.word(params) == "<":
            params = src.generics_end(params)
        direct = around(i)
        # Names at the level of a class body or of the file.
        open_at = direct[-1][1] if direct else -1
        at_level = _depth(src, i) == (_depth(src, open_at) + 1 if open_at >= 0 else 0) or language in ("c", "cpp") and not _in_function(src, i, functions)
        getter = language == "dart" and before == "get" and src.word(i + 1) in ("{", "=>", "async") and at_level
        if (src.word(params) == "(" or getter) and w not in _CONTROL and at_level and before not in ("new", "=", "return", "(", ",", "@") and not w.startswith("@"):
            stop = src.close(params) if not getter else i
            k = stop + 1
            while k < n and src.word(k) not in ("{", ";", "=>", "}", "=") :
                if src.word(k) == ":" and language in ("cpp", "dart") and src.word(k + 1) != ":":
                    k = next((x for x in range(k, n) if src.word(x) in ("{", ";") and src.partner.get(x) is not None or src.word(x) == ";"), n)
                    break
                k = src.close(k) + 1 if src.word(k) in ("(", "[") else k + 1
            made = made or language == "dart" and bool(direct) and (name == direct[-1][0] or "factory" in words_before(i))
            script = language in ("typescript", "javascript")
            ok = bool(direct) if script else language == "java" and bool(direct) or language in ("c", "cpp", "dart")
            if language in ("c", "cpp") and not direct and before in ("", ";", "}") and src.word(k) == "{":
                ok = False
            if language == "dart" and not direct and before in (";", "}", ""):
                ok = ok and src.word(k) in ("{", "=>")
            body_mark = src.word(k)
            abstract = script and body_mark == ";" and "abstract" in words_before(i)
            if ok and (body_mark in ("{",) or language == "dart" and (body_mark == "=>" or made and body_mark == ";") or abstract):
                if body_mark == "{":
                    body, end = k, src.close(k)
                else:
                    body = k
                    end = next((x for x in range(k, n) if src.word(x) == ";"), n - 1)
                first = _head(src, i)
                between = {src.word(x) for x in range(stop + 1, k)}
                if script and src.word(stop + 1) == ":":
                    returns = result_text(stop + 2, k)
                elif language == "java":
                    a = first
                    while a < i and src.word(a) in _MODIFIERS:
                        a += 1
                    if src.word(a) == "<":
                        a = src.generics_end(a)
                    returns = result_text(a, i)
                else:
                    returns = None
                owner = inside(i)
                if language == "cpp" and before == "::":
                    owner = src.word(i - 2)
                p = params if not getter else i
                if getter:
                    calls, details = calls_of(src, body, end)
                    places.append(i)
                    functions.append({"name": name, **span(first, end), "signature": f"{name}()", "class_name": owner, "decorators": [], "calls": calls, "call_details": details, "is_async": "async" in between,
                                      "is_constructor": False, "access_modifier": None, "is_static": False, "is_abstract": False, "type_parameters": [], "return_type": None})
                else:
                    add_function(i, name, p, body, end, owner=owner, first=first, made=made, is_async="async" in between, return_type=returns)
                i = body + 1 if body_mark == "{" else end + 1
                continue
        i += 1
    _name_methods(src, functions, places, bodies)
    return functions, classes, types, _imports(src)


def _name_methods(src: Source, functions: list[dict], places: list[int], bodies: list[tuple[dict, int, int]]) -> None:
    """Give every class the names of the functions in its body, in the order of the text; for Java those without a body too, constructors not."""
    named = list(zip(places, (f["name"] for f in functions), (f["is_constructor"] for f in functions), strict=True))
    if src.language == "java":
        named = [x for x in named if not x[2]]
        for k in range(len(src.tokens)):
            if src.word(k) == "(" and src.is_name(k - 1) and src.word(src.close(k) + 1) == ";" and src.word(src.outer[k]) == "{" and (src.is_name(k - 2) or src.word(k - 2) in (">", "]")) and src.word(k - 2) not in _CONTROL:
                named.append((k - 1, src.word(k - 1), False))
        named.sort()
    if src.language in ("typescript", "javascript"):
        level = {i: src.outer[i] for i, _, _ in named if i < len(src.outer)}
        named = [x for x in named if src.word(x[0] - 1) != "function"]
    else:
        level = None
    at = [x[0] for x in named]
    for item, start, end in bodies:
        inside = named[bisect_right(at, start): bisect_right(at, end)]
        item["methods"] = [name for i, name, _ in inside if level is None or level.get(i) == start]


def _depth(src: Source, i: int) -> int:
    """How many braces are open at a token; kept for all tokens after the first call."""
    table = src.__dict__.get("_depths")
    if table is None:
        table, depth = [], 0
        for k, (kind, w, _, _) in enumerate(src.tokens):
            if kind == "op" and w == "}" and k in src.partner:
                depth -= 1
            table.append(depth)
            if kind == "op" and w == "{" and k in src.partner:
                depth += 1
        src.__dict__["_depths"] = table
    return table[i]


def _in_function(src: Source, i: int, functions: list[dict]) -> bool:
    """Whether a token lies in the last function found."""
    return bool(functions) and _depth(src, i) > 0 and src.tokens[i][2] < functions[-1]["_end"]
