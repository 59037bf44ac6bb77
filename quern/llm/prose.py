"""Prose of a document as sentences: code, tables, traces, headings, quotes and lists of arguments go."""

from __future__ import annotations

import re

_FENCE = re.compile(r"^\s*(```|~~~)")
_LETTER = re.compile(r"[^\W\d_]")
WORD = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*")
#: What is no word: encoded data, links, inline code, numbers.
_URL = re.compile(r"(?<!\S)(?=\S{48})(?=\S*\d)\S+|\[([^\]]*)\]\([^)]*\)|https?://\S+|`[^`]*`|\(#\d+\)|#\d+|\(v?\d+(?:\.\d+)+\)|\bv?\d+(?:\.\d+)+\S*|\d+(?:[.,]\d+)*(?:[eE][-+]?\d+)?")
#: Abbreviations whose dot ends no sentence.
ABBREVIATIONS = (
    "cf", "approx", "etc", "vs", "resp", "incl", "fig", "vol", "dr", "mr", "mrs", "prof", "al", "ca", "bzw", "usw", "vgl", "evtl", "ggf", "inkl", "nr",
    "c.-à-d", "ex", "env", "ej", "aprox", "sr", "sra", "pág", "núm", "máx", "mín", "max", "min",
)

#: Kinds of documents that hold no prose.
NO_PROSE_KINDS = ("source_file", "changelog")
#: What makes a document without a fence around its code a source file.
CODE_SHARE, CODE_LINES = 0.3, 2
_BREAK = re.compile("\r\n|[\n\r\x0b\x0c\x85\u2028\u2029]")
_HEADING = re.compile(r"\s{0,3}#{1,6}(\s|$)")
_ITEM = re.compile(r"\s*(?:[-*+•]|\d{1,3}[.)])\s+")
_RULE = re.compile(r"\s*([-=*_])(?:\s*\1){2,}\s*$")
_LINK_ONLY = re.compile(r"\s*!?\[[^\]]*\]\([^)]*\)\s*$|\s*<?https?://\S+>?\s*$")
_ARGS = re.compile(r"\s*\**(args|arguments|parameters|params|returns?|raises|yields|attributes|keyword args|other parameters|argumente|parameter|rückgabe|paramètres|retour|parámetros|devuelve)\**\s*:\s*$", re.I)
_TAG = re.compile(r"\s*(?::(?:param|return|returns|rtype|type|raises?|arg)\b[^:]*:|@(?:param|return|returns|throws|type|arg|raises)\b)")
_ARG_LINE = re.compile(r"\s+[\w*]+(?:\s*\([^)]*\))?\s*:(?:\s|$)|\s*[\w*]+\s*:\s*[\w\[\]<>, ]*$")
_TRACE = re.compile(r"\s*(?:Traceback \(most recent call last\)|File \".*\", line \d+|at [\w$.<>/]+\(.*\)\s*$|Caused by: |goroutine \d+|thread '.*' panicked at|[\w.]*(?:Error|Exception|Panic|Warning)\b(?::\s|$)|\.\.\. \d+ more)")
_CODE = re.compile(
    r"\s*(?:"
    r"(?:async\s+)?def\s+\w+\s*\(|class\s+\w+.*[:{]\s*$|(?:export\s+|async\s+|default\s+)*function\b.*\(|func\s+(?:\([^)]*\)\s*)?\w+\s*\(|(?:pub(?:\([^)]*\))?\s+)?(?:async\s+)?fn\s+\w+|"
    r"(?:public|private|protected|static|final)\s+.*[({;]|(?:const|let|var|val)\s+[\w{\[].*=|import\s+[\w{\"'*.]+(?:\s+(?:from|as)\s.*)?;?\s*$|from\s+[\w.]+\s+import\b|package\s+[\w.]+;?\s*$|use\s+[\w:]+.*;\s*$|"
    r"#include\b|return\b(?:\s+[\w.\[\]()\"']+)?;?\s*$|raise\s+\w+\s*(?:\(.*)?$|(?:if|for|while|elif|else|try|except|switch|match|with)\b.*[:{]\s*$|"
    r"[}\])]+[;,)]*\s*$|.*[;{]\s*$|@[\w.]+(?:\(.*\))?\s*$|//|/\*|\*/|\*\s*@|\*\s*$|#\s?\w.*$|'''|\"\"\"|pass\s*$|[\w.\[\]]+\s*(?:[-+*/|:]?=)\s*\S.*$|[\w.]+\([^()]*(?:\([^()]*\))*[^()]*\)\s*$|\$\s+\w+|<\?|</?\w+[^>]*>\s*$"
    r")")
_RELEASE = re.compile(r"\s*#{1,4}\s*\[?v?\d+\.\d+(?:\.\d+)?\]?(?:\s*[-(–—].*)?\s*$|\s*#\s*(?:change ?log|release notes)\s*$", re.I)


#: A line that is plain prose at a glance; whatever else it may be goes through the rules one by one.
_PLAIN = re.compile(
    r"(?!(?:return|import|from|raise|pass|use|package|let|const|var|val|func|fn|def|class|pub|async|export|public|private|protected|static|final|if|for|while|with|try|else|at|File|Traceback|Caused|thread|goroutine)\b)"
    r"[^\W\d_][^=|;{}<>@:\\]*[\w.,?!]\s?$")


def _is_code(line: str) -> bool:
    return bool(_CODE.match(line)) and not _HEADING.match(line)


def prose_blocks(text: str, kind: str | None) -> list[str]:
    """The paragraphs and list items of prose, each as one line of text.

    A document is a source file, and has no prose, if more than ``CODE_SHARE`` of its lines outside of fences, lists of arguments and blanks are code,
    and more than ``CODE_LINES``; one of no known kind is a changelog if it has a heading of a release.
    """
    if kind is not None and kind.strip().lower() in NO_PROSE_KINDS:
        return []
    lines = _BREAK.split(text.lstrip("﻿"))
    out: list[str] = []
    block: list[str] = []
    fence = args = False
    code = seen = releases = 0

    def close() -> None:
        if block:
            out.append(" ".join(block))
            block.clear()

    for line in lines:
        if not fence and not args and _PLAIN.match(line):
            seen += 1
            block.append(line.strip())
            continue
        if "```" in line or "~~~" in line:
            if _FENCE.match(line):
                close()
                fence = not fence
                args = False
                continue
        if fence:
            continue
        bare = line.strip()
        if not bare:
            close()
            args = False
            continue
        seen += 1
        first = bare[0]
        if args:
            if _ARG_LINE.match(line) or line[0] in " \t":
                continue
            args = False
        if first == "|" or bare.count("|") >= 2 or first == ">":
            close()
            continue
        if first == "#" and _HEADING.match(line):
            close()
            releases += bool(_RELEASE.match(line))
            continue
        if _RULE.match(line):
            if first in "=-" and len(block) == 1:  # an underlined heading
                block.clear()
            close()
            continue
        if bare[-1] == ":" and _ARGS.match(line):
            close()
            args = True
            continue
        if (first in ":@" and _TAG.match(line)) or _LINK_ONLY.match(line) or _TRACE.match(line):
            close()
            continue
        if first in "-*+•" or first.isdigit():
            m = _ITEM.match(line)
            if m:
                close()
                block.append(line[m.end():].strip())
                continue
        if _is_code(line):
            close()
            code += 1
            continue
        block.append(bare)
    close()
    if releases >= 1 and kind is None or code > CODE_SHARE * seen and code > CODE_LINES:
        return []
    return out


def _inline(m: re.Match) -> str:
    return m.group(1) or ""


_MARKED = re.compile(r"[`#\d]|://|\]\(")


#: A word, the end of a sentence, or (a line feed) the end of a block.
_PART = re.compile(r"[^\W\d_]+(?:['’\-][^\W\d_]+)*|[.!?…]+(?=[\s\"'”’»)\]]|$)|[。！？]+|\n")
END = "\n"
_TAILS = frozenset(ABBREVIATIONS)


def abbreviated(word: str) -> bool:
    """Whether a dot after ``word`` ends no sentence: an abbreviation's last part or a single letter."""
    return len(word) == 1 and word.isalpha() or word.lower() in _TAILS


def prose_parts(text: str | None, kind: str | None) -> list[str]:
    """The words of a document's prose in order, the marks that may end a sentence, and :data:`END` after every block.

    A dot counts as an end unless the word before is :func:`abbreviated`, nor does a block's end right after
    a single letter with a dot (an abbreviation taken apart, as ``z.`` and ``B.`` in two items); dots within numbers, links and
    inline code are gone with them, and those are no words. Null and blank texts have no parts.
    """
    if not text:
        return []
    prose = "\n".join(prose_blocks(text, kind))
    if not prose:
        return []
    if _MARKED.search(prose):
        prose = _URL.sub(_inline, prose)
    out = _PART.findall(prose)
    out.append(END)
    return out


def is_word(part: str) -> bool:
    return part[0].isalpha()


def prose_sentences(text: str | None, kind: str | None) -> list[list[str]]:
    """The words of every sentence of a document's prose."""
    out: list[list[str]] = [[]]
    before, broken = "", False
    for part in prose_parts(text, kind):
        if is_word(part):
            out[-1].append(part)
        elif out[-1] and not (part == "." and abbreviated(before)) and not (part == END and broken):
            out.append([])
        broken = part == "." and len(before) == 1 and before.isalpha()
        before = part
    return out if out[-1] else out[:-1]
