"""The running prose that a typeset source prints: no comments, switched-off passages, headings, formulas, tables or references."""

from __future__ import annotations

import re
import unicodedata

_BODY = r"\{(?:[^{}]|\{(?:[^{}]|\{(?:[^{}]|\{[^{}]*\})*\})*\})*\}"
_COMMENT = re.compile(r"(?<!\\)%[^\n]*")
_OFF = re.compile(r"\\iffalse\b.*?(?:\\fi\b|\Z)|\\begin\{comment\}.*?(?:\\end\{comment\}|\Z)", re.S)
_AFTER = re.compile(r"\\end\{document\}|\\bye\b")
# Environments that hold no prose.
_NO_PROSE = "thebibliography|equation|align|eqnarray|tabular|table|figure|displaymath|math|gather|multline|verbatim|lstlisting|tikzpicture|array"
_ENVIRONMENT = re.compile(rf"\\begin\{{({_NO_PROSE})(\*?)\}}.*?(?:\\end\{{\1\2\}}|\Z)", re.S)
_DISPLAY = re.compile(r"\$\$.*?(?:\$\$|\Z)|\\\[.*?(?:\\\]|\n\s*\n|\Z)", re.S)
_INLINE = re.compile(r"(?<!\\)\$[^$]*?(?:(?<!\\)\$|\n\s*\n|\Z)|\\\((?:.|\n)*?\\\)")
_WORD_MACRO = re.compile(r"\\(?:(?:re)?newcommand\*?\s*\{?\\([A-Za-z]+)\}?|def\s*\\([A-Za-z]+))\s*\{([^{}\\$#]*)\}")
_DEFINITION = re.compile(rf"\\(?:(?:re|provide)?newcommand\*?\s*(?:\{{\\[A-Za-z]+\}}|\\[A-Za-z]+)\s*(?:\[[^\]]*\])*\s*{_BODY}|def\s*\\[A-Za-z]+[#\d]*\s*{_BODY}|let\s*\\[A-Za-z]+\s*=?\s*\\?[A-Za-z]+|DeclareMathOperator\*?\s*{_BODY}\s*{_BODY})")
# Commands whose argument is no prose.
_HIDDEN = re.compile(
    r"\\(?:documentclass|usepackage|title|author|date|cite[a-z]*|[a-z]*ref|label|input|include|subfile|includegraphics|bibliography|bibliographystyle|(?:sub)*section|chapter|paragraph|vspace|hspace|begin|end|centerline|caption|footnotemark|pagestyle|thispagestyle)"
    rf"\*?\s*(?:\[[^\]\n]*\]\s*)*(?:{_BODY}|\{{[^{{}}\n]*)|\\beginsection[^\n]*|\\magnification[^\n]*|\\input[ \t]+\S+"
)
_MARKS = {"'": "\u0301", "`": "\u0300", "^": "\u0302", '"': "\u0308", "~": "\u0303", "c": "\u0327", "v": "\u030c", "=": "\u0304", ".": "\u0307", "r": "\u030a"}
_ACCENT = re.compile(r"\\(?:(['`^\"~=.])\s*|([cvr])(?:\s+|(?=\{)))(?:\{\s*(\\?[A-Za-z])\s*\}|(\\?[A-Za-z]))(?:(?<=\\[ij])[ ]?)?")
# Letters that are written as commands.
_LETTERS = {"ss": "ß", "i": "ı", "j": "ȷ", "o": "ø", "O": "Ø", "l": "ł", "L": "Ł", "ae": "æ", "AE": "Æ", "oe": "œ", "OE": "Œ", "aa": "å", "AA": "Å"}
_LETTER = re.compile(r"\\(ss|i|j|oe|OE|ae|AE|aa|AA|o|O|l|L)(?![A-Za-z])(?:\{\}|[ ](?=[a-z]))?")
_COMMAND = re.compile(r"\\[A-Za-z@]+\*?|\\.|[{}~]")
_SPLIT = re.compile(r"(?<=[.!?])[\s\")\]»”]+|\n\s*\n")
_WORDS = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_JOINT = re.compile(r"[\u0300-\u036f\u00ad\u200b-\u200f\u2060\ufeff]")
#: Words that a stretch of text must have to be a sentence, unless it ends as one.
LEAST_WORDS = 3
_ENDED = re.compile(r"[^\W\d_][\"'’)\]»”]*[.!?][\s\"'’)\]»”]*\Z")


def _accent(m: re.Match) -> str:
    letter = (m[3] or m[4]).lstrip("\\")
    return unicodedata.normalize("NFC", letter + _MARKS[m[1] or m[2]])


def prose(text: str | None) -> str:
    """The prose of one source; empty for NULL, empty and blank texts and where none prints."""
    if not text or text.isspace():
        return ""
    t = text.replace("\r", "") if "\r" in text else text
    if "%" in t:
        t = _COMMENT.sub("", t)
    if "\\" in t or "$" in t:
        if "\\iffalse" in t or "{comment}" in t:
            t = _OFF.sub(" ", t)
        if m := _AFTER.search(t):
            t = t[: m.start()]
        words = {a or b: w for a, b, w in _WORD_MACRO.findall(t)}
        at = t.find("\\begin{document}")
        if at >= 0:
            t = t[at + 16 :]
        t = _ENVIRONMENT.sub(" ", t)
        t = _DEFINITION.sub(" ", t)
        if "$$" in t or "\\[" in t:
            t = _DISPLAY.sub(" ", t)
        if "$" in t or "\\(" in t:
            t = _INLINE.sub(" ", t)
        t = _HIDDEN.sub(" ", t)
        t = _ACCENT.sub(_accent, t)
        t = _LETTER.sub(lambda m: _LETTERS[m[1]], t)
        t = _COMMAND.sub(lambda m: words.get(m[0][1:], " " if m[0] == "~" else ""), t) if words else _COMMAND.sub(lambda m: " " if m[0] in ("~", "\\,", "\\ ", "\\\\") else "", t)
    return t


def sentences(text: str | None) -> list[list[str]]:
    """The lower-case words of each printed sentence.

    A stretch of fewer words than ``LEAST_WORDS`` is one if a word and a full stop, question or exclamation mark end it; else it is a rest of markup.
    """
    p = prose(text).lower()
    if not p:
        return []
    if not p.isascii() and _JOINT.search(p):
        p = re.sub(r"[\u00ad\u200b-\u200f\u2060\ufeff]", "", unicodedata.normalize("NFC", p))
    out = []
    for s in _SPLIT.split(p):
        w = _WORDS.findall(s)
        if len(w) >= LEAST_WORDS or w and _ENDED.search(s):
            out.append(w)
    return out
