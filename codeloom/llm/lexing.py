"""Lexers of five languages: source text to one class letter a token.

A file becomes a short string over a small alphabet, in which pairs and productions are cheap to test.
Comments and blanks vanish; ``N`` is a line end.  Letters of token classes:

    i identifier   n number   s string   t template   r regex literal   E no token of the language
    d .   z ?.   , ; : @ = &   A other assignment   o :=   w -> or =>   e ...   x ::   y <-
    u ! ~   p + -   c ++ --   m *   v |   l <   g >   q ?   b other operators   M modifier (Java)

Keywords get letters of the private use area, one each.
"""

from __future__ import annotations

import re

EXTENSIONS = {"py": "python", "java": "java", "js": "javascript", "ts": "typescript", "go": "go"}

# Keywords of the languages' published grammars.
_JS = "const let var function return if else for while do switch case default break continue throw try catch finally new class extends import export this super typeof void delete in instanceof yield await async static get set of as from"
KEYWORDS = {
    "java": "package import class interface enum record extends implements permits throws throw return if else for while do switch case default break continue try catch finally new this super instanceof assert yield",
    "javascript": _JS,
    "typescript": _JS + " interface type enum namespace module declare abstract implements readonly public private protected keyof is asserts satisfies override infer",
    "go": "package import func return if else for range switch select case default break continue goto fallthrough go defer var const type struct interface map chan",
    "python": "def class return if elif else for while try except finally with as import from pass break continue raise assert del global nonlocal lambda not and or in is await async yield match case type",
}
MODIFIERS = "public private protected static final abstract native synchronized transient volatile strictfp sealed"
#: Words that are keywords in some places and names in others.
CONTEXTUAL = {
    "java": "record permits yield",
    "javascript": "async static get set of as from await yield",
    "typescript": "async static get set of as from await yield type namespace module declare abstract readonly public private protected keyof is asserts satisfies override infer",
    "go": "",
    "python": "match case type",
}
_OPERATORS = {".": "d", "?.": "z", ",": ",", ";": ";", ":": ":", "@": "@", "=": "=", "&": "&", ":=": "o", "->": "w", "=>": "w", "...": "e", "::": "x", "<-": "y", "!": "u", "~": "u", "+": "p", "-": "p", "++": "c", "--": "c", "*": "m", "|": "v", "<": "l", ">": "g", "?": "q"}
for _op in "/ % ^ == != === !== <= >= && || << >> ** ?? // <> &^".split():
    _OPERATORS[_op] = "b"
for _op in "+= -= *= /= %= &= |= ^= <<= >>= >>>= **= //= &&= ||= ??= &^= @=".split():
    _OPERATORS[_op] = "A"
for _br in "()[]{}":
    _OPERATORS[_br] = _br


def letters(lang: str) -> dict[str, str]:
    """Keyword to letter."""
    return {w: chr(0xE000 + k) for k, w in enumerate(KEYWORDS[lang].split())}


_MARKER = r"(?m:^(?:<{7}|>{7}|={7}|\|{7})(?=[ \r\n]|\Z)[^\n]*)"
_BLOCK = r"/\*(?:[\s\S]*?\*/|[\s\S]*)"
_QUOTED = r'"(?:[^"\\\n]|\\.)*"|\'(?:[^\'\\\n]|\\.)*\''
_NUMBER = r"0[xXbBoO][\da-fA-F_]+[lLn]?|(?:\d[\d_]*(?:\.(?![.\w])|\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdDnij]?"
# plain letters first, as their sets are fast; other letters may follow or begin a name
_NAME = r"[A-Za-z_][A-Za-z0-9_$]*(?:[^\W\x00-\x7f][\w$]*)?|[^\W\d\x00-\x7f][\w$]*"
_JS_NAME = r"[#$]?[A-Za-z_][A-Za-z0-9_$]*(?:[^\W\x00-\x7f][\w$]*)?|\$[\w$]*|#?[^\W\d\x00-\x7f][\w$]*"
_TEMPLATE = r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`]|\{[^{}]*\}|`[^`]*`)*\})*`"
_REGEX = r"(?:(?<=[(,=:\[!&|?{};+\n])|(?<=[(,=:\[!&|?{};+>] )|(?<=return )|(?<=return)|\A)/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*"
_PY_STRING = r"[rRbBuUfFtT]{0,2}(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?!\"\")(?:[^\"\\\n]|\\[\s\S])*\"|'(?!'')(?:[^'\\\n]|\\[\s\S])*')"


def _ops(text: str) -> str:
    return "|".join(re.escape(x) for x in sorted(text.split(), key=lambda x: -len(x)))


_SINGLE = r"[(){}\[\],;]"
# the commonest tokens come first; no later alternative could begin where one of them does
_LEXERS = {
    "java": [_NAME, _SINGLE, r"\n", r'"""[\s\S]*?"""', _QUOTED, _NUMBER, _MARKER, r"//[^\n]*", _BLOCK, _ops(">>>= <<= >>= ... -> :: ++ -- += -= *= /= %= &= |= ^= == != <= >= && || <<"), r"\S"],
    "javascript": [_JS_NAME, _SINGLE, r"\n", _QUOTED, _TEMPLATE, _NUMBER, _MARKER, r"//[^\n]*", _BLOCK, _REGEX, _ops(">>>= <<= >>= **= &&= ||= ??= === !== ... => ?. ?? ** ++ -- += -= *= /= %= &= |= ^= == != <= >= && || <<"), r"\S"],
    "go": [_NAME, _SINGLE, r"\n", r"`[^`]*`", _QUOTED, _NUMBER, _MARKER, r"//[^\n]*", _BLOCK, _ops("<<= >>= &^= ... := <- ++ -- += -= *= /= %= &= |= ^= == != <= >= && || << >> &^"), r"\S"],
    "python": [_PY_STRING, _NAME, _SINGLE, _MARKER, r"(?:[ \t\f]*(?:\#[^\n]*)?\r?\n)+[ \t]*", _NUMBER, r"\#[^\n]*", r"\\\r?\n", _ops("**= //= <<= >>= ... := -> ** // += -= *= /= %= &= |= ^= @= == != <= >= << >>"), r"\S"],
}
_LEXERS["typescript"] = _LEXERS["javascript"]
#: Blanks before a token are taken along outside the group, so that the alternatives aren't tried at each of them.
_COMPILED = {lang: re.compile(f"[ \\t]*({'|'.join(parts)})") for lang, parts in _LEXERS.items()}
#: The same with line ends among the blanks, where they are tokens of their own.
_UNLINED = {lang: re.compile(f"\\s*({'|'.join(p for p in parts if p != chr(92) + 'n')}|\\Z)") for lang, parts in _LEXERS.items() if lang != "python"}
#: The class letters of tokens seen are kept up to so many, then forgotten.
KEPT = 200_000


class _Classes(dict):
    """Token text to class letter, filled as tokens turn up."""

    def __init__(self, lang: str):
        super().__init__()
        self.lang = lang
        self.fixed = ({op: c for op, c in _OPERATORS.items() if op != "//"} if lang != "python" else _OPERATORS) | letters(lang) | ({w: "M" for w in MODIFIERS.split()} if lang == "java" else {}) | {"\n": "N"}

    def __missing__(self, token: str) -> str:
        if len(self) > KEPT:
            self.clear()
        head = token[0]
        if (head.isalpha() or head == "_") and token[-1] not in "\"'":  # most that is new is a name or a number
            found = self.fixed.get(token, "i")
        elif head.isdigit():
            found = "n"
        else:
            found = self.fixed.get(token) or self._class(token)
        self[token] = found
        return found

    def _class(self, token: str) -> str:
        head = token[0]
        if self.lang != "python" and token.startswith("//") and token != "//=":
            return ""
        if token.startswith("/*"):
            return ("N" if "\n" in token else "") if token.endswith("*/") and len(token) > 3 else "E"
        if self.lang == "python":
            if head == "#" or head == "\\":
                return ""
            if token.endswith(('"', "'")):
                return "s"
            if head.isspace():
                return "N"
        if head in "\"'" and len(token) > 1:
            return "s"
        if head == "`" and len(token) > 1:
            return "s" if self.lang == "go" else "t"
        if head == "/" and len(token) > 1:
            return "r"
        if len(token) >= 7 and head in "<>=|":
            return "E"
        if head.isdigit() or (head == "." and len(token) > 1):
            return "n"
        if head.isalpha() or head in "_$#" and len(token) > 1 or head in "_$":
            return "i"
        return "E"


_CLASSES: dict[str, _Classes] = {}


def tokens(lang: str, text: str) -> list[str]:
    return _COMPILED[lang].findall(text)


def without_line_ends(lang: str, text: str) -> list[str]:
    """``tokens`` without those that are a line end; in Python these hold comments, and stay."""
    if lang not in _UNLINED:
        return tokens(lang, text)
    found = _UNLINED[lang].findall(text)
    while found and not found[-1]:  # blanks at the end
        found.pop()
    return found


def classes(lang: str, found: list[str]) -> list[str]:
    of = _CLASSES.get(lang)
    if of is None:
        of = _CLASSES[lang] = _Classes(lang)
    return list(map(of.__getitem__, found))
