"""A lossless lexer for Rust source: every character of a text is in one token."""

from __future__ import annotations

import re
from typing import NamedTuple

WHITESPACE, COMMENT, IDENT, LIFETIME, LITERAL, PUNCT = range(6)


class Token(NamedTuple):
    kind: int
    text: str
    start: int
    doc: bool = False


#: Punctuation of several characters, the longest first.
JOINED = ("<<=", ">>=", "...", "..=", "::", "->", "=>", "==", "!=", "<=", ">=", "&&", "||", "+=", "-=", "*=", "/=", "%=", "^=", "&=", "|=", "<<", ">>", "..")
_SPACE = re.compile(r"[\t\n\x0b\x0c\r \x85‎‏  ]+")
_RAW_STRING = r'(?:br|cr|r)(?P<hashes>#*)"'
_STRING = r'[bc]?"(?:[^"\\]|\\.)*"?'
_CHAR = r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{1,2}|u\{[^}']*\}|.))'"
_LIFETIME = r"'(?:(?:r#)?[^\W\d]\w*)?"
_IDENT = r"(?:r#)?[^\W\d]\w*"
_NUMBER = r"0[xob][0-9a-fA-F_]+\w*|[0-9][0-9_]*(?:\.(?![.\w])|\.[0-9][0-9_]*)?(?:[eE][+-]?[0-9_]+)?\w*"
_FORMS = (("space", _SPACE.pattern), ("line", r"//[^\n]*"), ("block", r"/\*"), ("raw", _RAW_STRING), ("string", f"{_STRING}|{_CHAR}"), ("lifetime", _LIFETIME), ("ident", _IDENT), ("number", _NUMBER), ("punct", f"{'|'.join(map(re.escape, JOINED))}|."))
#: All forms in the order in which they are tried; of block comments and raw strings only how they begin.
_TOKEN = re.compile("|".join(f"(?P<{name}>{form})" for name, form in _FORMS), re.S)
#: The same without groups, for texts that have neither of those two, and a first line that may be taken for no token.
_WHOLE = re.compile("|".join(f"(?:{form})" for name, form in _FORMS if name not in ("block", "raw")), re.S)
_PARTLY = re.compile(r'/\*|(?:br|cr|r)#*"|\A#!')
#: Strings, characters and line comments of texts that ``_WHOLE`` can take: nothing else in them holds a quote or //.
_SAID = re.compile(r'''"(?:[^"\\]|\\.)*"?|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{1,2}|u\{[^}']*\}|.))'|(//(?:!|/(?!/))?)[^\n]*''', re.S)
#: Line comments where no quote is in the text.
_LINE = re.compile(r"(//(?:!|/(?!/))?)[^\n]*")
_KINDS = {"space": WHITESPACE, "line": COMMENT, "block": COMMENT, "raw": LITERAL, "string": LITERAL, "lifetime": LIFETIME, "ident": IDENT, "number": LITERAL, "punct": PUNCT}


def _block_comment(s: str, at: int) -> int:
    depth, i = 0, at
    mark = re.compile(r"/\*|\*/")
    while m := mark.search(s, i):
        depth += 1 if m[0] == "/*" else -1
        i = m.end()
        if not depth:
            return i
    return len(s)


def is_doc(comment: str) -> bool:
    """/// and //! lines, /** and /*! blocks; not //// nor /*** nor /**/."""
    if comment.startswith("///"):
        return not comment.startswith("////")
    if comment.startswith("/**"):
        return not comment.startswith("/***") and comment != "/**/"
    return comment.startswith(("//!", "/*!"))


def said(s: str) -> str | None:
    """The source without what its line comments say: only their marks count.  None
    where ``plain`` gives none."""
    if _partly(s):
        return None
    return _SAID.sub(lambda m: m[1] or m[0], s) if '"' in s or "'" in s else "".join(_LINE.split(s))


def _partly(s: str) -> bool:
    # Without a quote there is no raw string.
    return "/*" in s or s.startswith("#!") or '"' in s and _PARTLY.search(s) is not None


def plain(s: str) -> list[str] | None:
    """The tokens' texts, where no form reaches over a mark that ends it elsewhere: no
    block comment, raw string or first line of a script is in the text; else None."""
    return None if _partly(s) else _WHOLE.findall(s)


#: Kind and doc of short texts: a token's own text tells its form.
_known: dict[str, tuple[int, bool]] = {}


def _kind(text: str) -> tuple[int, bool]:
    form = _TOKEN.match(text).lastgroup
    found = _KINDS[form], form == "line" and is_doc(text)
    if len(text) <= 16 and len(_known) < 20_000:
        _known[text] = found
    return found


def lex(s: str, texts: list[str] | None = None) -> list[Token]:
    """``texts``: what ``plain`` gave for ``s``, where it did."""
    if texts is not None:
        new, known, at, out = tuple.__new__, _known.get, 0, []
        for text in texts:
            kind, doc = known(text) or _kind(text)
            out.append(new(Token, (kind, text, at, doc)))
            at += len(text)
        return out
    out: list[Token] = []
    at, n = 0, len(s)
    if s.startswith("#!") and not re.match(r"#!\s*\[", s):
        at = s.find("\n") if "\n" in s else n
        out.append(Token(COMMENT, s[:at], 0))
    match, new, add = _TOKEN.match, tuple.__new__, out.append
    while at < n:
        m = match(s, at)
        form, end, doc = m.lastgroup, m.end(), False
        if form == "line":
            doc = is_doc(m[0])
        elif form == "block":
            end = _block_comment(s, at)
            doc = is_doc(s[at:end])
        elif form == "raw":
            close = '"' + m["hashes"]
            end = s.find(close, end)
            end = n if end < 0 else end + len(close)
        add(new(Token, (_KINDS[form], s[at:end], at, doc)))
        at = end
    return out
