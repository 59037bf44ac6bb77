"""Problem 5: functions and classes paired with their documentation.

The comments of an entity's code (string literals that open a body, and comment blocks) are
matched with the declarations of that code: each comment is offered to every declaration within some lines of it, each pair is scored by
distance, by the tags that name parameters, and by names it mentions, and a bipartite assignment of greatest weight decides
which comment goes where. Implausible links are refused, then descriptions that say nothing. What is a plausible link is a parameter: by
default only a comment that stands directly above its declaration or opens its body.

An entity's documentation is its ``docstring`` if that isn't blank, otherwise the comment assigned to
its declaration. It is a description if it has at least four different words, without lists of parameters
and results, other than articles, words of the entity's own name (inflected too) and to-do marks,
and is no licence or generator notice, tool directive or pointer to an inherited text.

Defined cases: null code and null docstring give no pair; repeated rows of an entity give one pair, by
the current row; very long comments are read whole; text is returned without comment marks.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import current_classes, current_functions

#: Articles of the corpus' languages.
ARTICLES = frozenset("a an the der die das den dem des ein eine einer eines einem einen le la les l un une du des el los las lo una unos unas".split())
#: To-do marks.
MARKS = frozenset("todo fixme xxx hack tbd wip".split())
_WORD = re.compile(r"[^\W_]+")
_MARK = re.compile(r"\b(?:TODO|FIXME|XXX|HACK|TBD|WIP)\b(?:\s*\([^)]*\))?", re.I)
_HTML = re.compile(r"</?(?:p|b|i|em|strong|code|pre|br|ul|ol|li|a|tt|h[1-6])\b[^<>]*/?>", re.I)
_REFUSED = re.compile(
    r"copyright\b|©|all rights reserved|licen[sc]ed under|spdx-license|permission is hereby granted|"
    r"auto-?\s?generated|generated (?:by|automatically|from|code)|automatically generated|do not edit|machine generated", re.I)
_DIRECTIVE = re.compile(
    r"^\W*(?:noqa\b|type:\s*ignore|pylint:|eslint-|nolint\b|flake8:|mypy:|pragma:|ts-(?:ignore|expect-error|nocheck)|@ts-|prettier-ignore|istanbul ignore|"
    r"go:(?:generate|build|embed|linkname|noinspection)|\+build|clang-format|rustfmt|isort:|fmt:|coding[:=]|@formatter|yapf:|nosec\b|@suppresswarnings|sonar|nosonar|checkstyle|jshint|jslint|tslint:|region\b|endregion\b)", re.I)
_INHERITED = re.compile(r"^\W*(?:\{?@inheritdoc\}?|inherit(?:ed|s)?(?:\s+(?:doc|docs|documentation|from)\b.*)?|see\s+(?:the\s+)?(?:base|super|parent)\b.*|@see\s+\S+|@override|\(non-javadoc\).*)\W*$", re.I | re.S)
_TAG = re.compile(r"^\s*(?::(?:param|arg|argument|key|type|return|returns|rtype|raises?|except|yields?)\b[^:\n]*:?|@(?:param|arg|argument|return|returns|throws|exception|raises|yields?|typeparam)\b|\\(?:param|returns?)\b)")
_SECTION = re.compile(r"^\s*(?:args|arguments|parameters|params|keyword arg(?:ument)?s|other parameters|returns?|yields?|raises|throws|attributes|# ?(?:arguments|returns|parameters|errors|panics))\s*:?\s*$", re.I)
_INLINE_SECTION = re.compile(r"^\s*(?:returns?|yields?)\s*:\s*\S", re.I)
_NAMED = re.compile(r"[@\\](?:param|arg|argument)\s+(?:\{[^}]*\}\s*)?\[?(\w+)|:(?:param|arg|argument|type)\s+(?:[\w<>\[\], ]+\s+)?(\w+)\s*:|^\s+\*{0,2}(\w+)\s*(?:\([^)]*\))?\s*:", re.M)


# -- text -------------------------------------------------------------------------------------
def without_marks(comment: str) -> str:
    """A comment's text without comment signs, quotes, stars, HTML tags and common indentation."""
    s = comment.replace("\r\n", "\n").replace("\r", "\n").strip()
    m = re.match(r"(?i)[rbuf]{0,2}('''|\"\"\"|'|\")", s)
    if m and s.endswith(m.group(1)) and len(s) >= m.end() + len(m.group(1)):
        s = s[m.end(): -len(m.group(1))]
    out = []
    for line in s.strip().split("\n"):
        line = re.sub(r"^\s*(?:/\*[*!]*|\*+/|\*(?!\*)(?=\s|$|/)|//[/!]*|#+!?(?=\s|$)|--(?=\s))", "", line)
        line = re.sub(r"\s*\*+/\s*$", "", line)
        out.append(line.rstrip())
    s = _HTML.sub("", "\n".join(out))
    return s.strip()


def main_text(text: str) -> str:
    """The text without lists of parameters and results."""
    out, listing = [], False
    for line in text.split("\n"):
        if _SECTION.match(line) or _INLINE_SECTION.match(line):
            listing = True
            continue
        if _TAG.match(line):
            listing = True
            continue
        if not line.strip():
            listing = False
        elif listing and not line[0].isspace() and not re.match(r"\s*[-*]?\s*[\w*`]+\s*(?:\([^)]*\))?\s*(?::|--?)\s", line + " "):
            listing = False
        if not listing:
            out.append(line)
    return "\n".join(out).strip()


def name_words(name: str) -> list[str]:
    """The words of an identifier, in lower case."""
    return [w.lower() for w in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[^\W\dA-Za-z_]+", name or "")]


def _stems(word: str) -> set[str]:
    """What ``word`` may be an inflected form of, itself included."""
    out = {word}
    for end in ("s", "es", "ed", "d", "ing", "er", "ers", "or", "ors", "ion", "ions", "ings"):
        if word.endswith(end) and len(word) - len(end) >= 2:
            stem = word[: -len(end)]
            out |= {stem, stem + "e"}
            if len(stem) > 2 and stem[-1] == stem[-2]:
                out.add(stem[:-1])
    for end, put in (("ies", "y"), ("ied", "y"), ("ves", "f"), ("ves", "fe"), ("ier", "y")):
        if word.endswith(end):
            out.add(word[: -len(end)] + put)
    return out


def telling_words(text: str, name: str) -> set[str]:
    """The different words that say something beyond the entity's name."""
    own = set()
    for w in name_words(name):
        own |= {w} | _stems(w)
    found = set()
    for w in _WORD.findall(_MARK.sub(" ", text)):
        w = w.lower()
        if w.isdigit() or w in ARTICLES or w in MARKS or w in own or not own.isdisjoint(_stems(w)):
            continue
        found.add(w)
    found -= {"".join(name_words(name))}
    return found


def is_description(text: str, name: str) -> bool:
    """Whether ``text``, free of comment marks, describes the entity."""
    body = main_text(text)
    if not body or _REFUSED.search(body) or _DIRECTIVE.match(body) or _INHERITED.match(body):
        return False
    return len(telling_words(body, name)) >= 4


# -- comments and declarations ----------------------------------------------------------------
_STRING = re.compile(r"(?i)[rbuf]{0,2}(?:'''.*?'''|\"\"\".*?\"\"\"|'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")", re.S)
_PY_DECLARATION = re.compile(r"^([ \t]*)(?:async\s+)?(?:def|class)\s+(\w+)", re.M)
_DECLARATION = re.compile(
    r"^[ \t]*(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|override|synchronized|native|declare|readonly|open|sealed|unsafe|extern|const|pub(?:\([^)]*\))?|get|set)\s+)*"
    r"(?:(?:function\*?|func|fn|class|struct|interface|trait|enum|type|record|impl|object|mixin|extension)\s+(?:\([^)]*\)\s*)?#?(\w+)|(?:const|let|var)\s+(\w+)\s*=|(?:[\w<>\[\],.?&*:]+\s+)*?#?(\w+)\s*(?:<[^>\n]*>)?\s*\()", re.M)
_KEYWORDS = frozenset("if for while switch catch return new else do try throw await yield match loop when super this assert print".split())
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)|(?:^[ \t]*//[^\n]*(?:\n|\Z))+", re.S | re.M)
_HASH_BLOCK = re.compile(r"(?:^[ \t]*#(?!\[)[^\n]*(?:\n|\Z))+", re.M)
_BETWEEN = re.compile(r"(?:[ \t]*(?:@[\w.]+(?:\([^\n]*\))?|#\[[^\n]*\])?[ \t]*\n)*[ \t]*\Z")


def _after_signature(code: str, at: int) -> int:
    """The place after the colon that ends a Python signature which starts at ``at``; -1 if there is none."""
    depth, i, n = 0, at, len(code)
    while i < n:
        c = code[i]
        if c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        elif c in "'\"":
            m = _STRING.match(code, i)
            if m:
                i = m.end()
                continue
        elif c == "#":
            i = code.find("\n", i)
            if i < 0:
                return -1
            continue
        elif c == ":" and depth <= 0:
            return i + 1
        i += 1
    return -1


def _body_string(code: str, at: int) -> re.Match | None:
    """The string literal that opens the body after ``at``; comment lines may precede it."""
    i = at
    while True:
        m = re.compile(r"\s*(?:#[^\n]*)?").match(code, i)
        if m.end() == i:
            break
        i = m.end()
    m = _STRING.match(code, i)
    if m and re.compile(r"[ \t]*(?:;|#|\r|\n|\Z)").match(code, m.end()):
        return m
    return None


def candidates(code: str, python: bool, every: bool = False) -> tuple[list[tuple], list[tuple]]:
    """Declarations ``(name, start, params)`` and comments ``(text, start, end, declaration it opens or None)``."""
    declared, comments = [], []
    if python:
        for m in _PY_DECLARATION.finditer(code):
            stop = _after_signature(code, m.end())
            head = code[m.end(): stop if stop > 0 else m.end()]
            declared.append((m.group(2), m.start(), frozenset(re.findall(r"\w+", head))))
            if stop > 0 and (s := _body_string(code, stop)):
                comments.append((s.group(), s.start(), s.end(), len(declared) - 1))
        pattern = _HASH_BLOCK
    else:
        pattern = _COMMENT
    spans = []
    for m in pattern.finditer(code):
        comments.append((m.group(), m.start(), m.end(), None))
        spans.append((m.start(), m.end()))
    if not python:
        k = 0
        for m in _DECLARATION.finditer(code):
            while k < len(spans) and spans[k][1] <= m.end():
                k += 1
            name = m.group(1) or m.group(2) or m.group(3)
            if k < len(spans) and spans[k][0] <= m.end() - 1 or name in _KEYWORDS:
                continue
            end = code.find(")", m.end())
            declared.append((name, m.start(), frozenset(re.findall(r"\w+", code[m.end(): end if end > 0 else m.end()]))))
            if not every and len(declared) == 1 and not comments_follow(spans, m.start()):
                break  # no later declaration has a comment in its place
    return declared, comments


def comments_follow(spans: list[tuple[int, int]], at: int) -> bool:
    return bool(spans) and spans[-1][0] > at


#: Lines that may lie between a comment and a declaration it is offered to, and the declarations after and before a comment.
REACH, AFTER, BEFORE = 40, 3, 1
#: The score of a link that stands in its place, and what a line of distance costs one that doesn't.
OPENS, ABOVE, APART, LINE = 4.0, 3.0, 1.5, 0.05


def in_place(code: str, declaration: tuple, place: int, comment: tuple) -> bool:
    """Whether a comment opens the declaration's body or stands directly above it."""
    _, start, _ = declaration
    _, _, end, opens = comment
    if opens is not None:
        return opens == place
    return end <= start and _BETWEEN.match(code, end, start + len(code[start: start + 200]) - len(code[start: start + 200].lstrip(" \t"))) is not None


def link_score(code: str, declaration: tuple, place: int, comment: tuple, lead: float = 0.0) -> float:
    """How well a comment fits a declaration; not above zero if it can't belong to it. ``lead`` is what a link in its place has ahead."""
    name, start, params = declaration
    text, begin, end, opens = comment
    if in_place(code, declaration, place, comment):
        score = lead + (OPENS if opens is not None else ABOVE - 0.25 * code.count("\n", end, start))
    elif opens is not None:
        return 0.0
    else:
        score = APART - LINE * (code.count("\n", end, start) if end <= start else code.count("\n", start, begin) + 10)
    tags = {"".join(x) for x in _NAMED.findall(text)}
    if tags:
        score += 1.0 if tags & params else -0.5
    if name and re.search(rf"\b{re.escape(name)}\b", text):
        score += 0.5
    return score


def assign(scores: dict[tuple[int, int], float], n: int) -> dict[int, int]:
    """Declaration -> comment with the greatest total score: augmenting paths over the sparse links."""
    taken: dict[int, int] = {}
    by: dict[int, list[tuple[int, float]]] = {}
    for (d, c), s in scores.items():
        if s > 0:
            by.setdefault(d, []).append((c, s))
    mine: dict[int, int] = {}
    for d in sorted(by):
        # Best alternating path by Bellman-Ford: gain of giving d a comment, moving others along.
        best: dict[int, tuple[float, int]] = {}
        queue = [(d, 0.0)]
        while queue:
            x, gain = queue.pop(0)
            for c, s in by[x]:
                g = gain + s
                if c not in best or g > best[c][0] + 1e-12:
                    if mine.get(x) == c:
                        continue
                    best[c] = (g, x)
                    if c in taken:
                        y = taken[c]
                        queue.append((y, g - scores[y, c]))
        free = [(g, c) for c, (g, _) in best.items() if c not in taken]
        # Or another declaration gives its comment up.
        swaps = [(g - scores[taken[c], c], c) for c, (g, _) in best.items() if c in taken]
        for g, c in sorted(free + swaps, reverse=True)[:1]:
            if g <= 0:
                break
            if c in taken:
                mine.pop(taken[c])
            while True:
                x = best[c][1]
                old = mine.get(x)
                mine[x], taken[c] = c, x
                if x == d or old is None:
                    break
                c = old
    return mine


def links(code: str, python: bool, least: float | None = None) -> tuple[list[tuple], list[tuple], dict[int, int]]:
    """Declarations, comments, and which comment each declaration gets.

    The assignment is over all offers; of its links those stay that are in their place or, with ``least``, score that much.
    Without ``least`` a link in its place has a lead that no tags or names of another declaration outweigh.
    """
    declared, comments = candidates(code, python, least is not None)
    lead = 2.0 if least is None else 0.0
    scores = {}
    for j, c in enumerate(comments):
        for i in _near(code, declared, c):
            s = link_score(code, declared[i], i, c, lead)
            if s > 0:
                scores[i, j] = s
    chosen = assign(scores, len(declared))
    kept = {i: j for i, j in chosen.items() if in_place(code, declared[i], i, comments[j]) or least is not None and scores[i, j] >= least}
    return declared, comments, kept


def documentation(name: str, docstring: str | None, code: str | None, python: bool, least: float | None = None) -> str | None:
    """The entity's documentation, free of comment marks; None if there is none."""
    if docstring is not None and docstring.strip():
        return without_marks(docstring)
    if not code or not code.strip():
        return None
    code = code.replace("\r\n", "\n").replace("\r", "\n")
    declared, comments, chosen = links(code, python, least)
    if not declared or not comments:
        return None
    own = next((i for i, d in enumerate(declared) if d[0] == name), 0)
    j = chosen.get(own)
    return without_marks(comments[j][0]) if j is not None else None


def _near(code: str, declared: list[tuple], comment: tuple) -> list[int]:
    """The declarations that a comment is offered to: the one it opens, or the next and previous ones within reach."""
    _, begin, end, opens = comment
    if opens is not None:
        return [opens]
    first = bisect_left(declared, end - 1, key=lambda d: d[1])
    near = [*range(max(0, first - BEFORE), first), *range(first, min(len(declared), first + AFTER))]
    return [i for i in near if code.count("\n", min(end, declared[i][1]), max(begin, declared[i][1])) <= REACH]


_SCHEMA = "seq long, name string, code string, description string"


def described(functions: DataFrame, classes: DataFrame) -> DataFrame:
    """``seq, name, code, description`` of every current function and class that has one."""
    def payload(df: DataFrame, current) -> DataFrame:
        doc = F.col("docstring")
        rows = current(df, code=F.col("code"), docstring=doc, path=F.col("file_path"))
        return rows.select("seq", "name", "docstring", "code", F.lower(F.regexp_extract("path", r"\.(\w+)\s*$", 1)).isin("py", "pyw", "pyi").alias("python"))

    rows = payload(functions, current_functions).unionByName(payload(classes, current_classes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for seq, name, doc, code, python in zip(*(c.to_pylist() for c in b.columns)):
                text = documentation(name, doc, code, bool(python))
                if text and is_description(text, name):
                    out.append((seq, name, code, main_text(text)))
            cols = list(zip(*out)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.string(), pa.string()))], names=["seq", "name", "code", "description"])

    return rows.mapInArrow(run, _SCHEMA)
