"""Statement productions of five languages over the class letters of ``lexing``.

Brackets are reduced from the inside out: a checked ``(...)`` becomes P, ``[...]`` Q, ``{...}`` B, and type arguments
``<...>`` G.  What is
left inside any bracket is free of nesting, so each production is a regular expression.  ``<word>`` names
another rule or a keyword's letter.  From the same productions follow the permissible adjacent pairs of tokens.
The rules accept a superset of each language in a few places (they don't tell a block from an initialiser by
its place), never less than its common forms.
"""

from __future__ import annotations

import re
import re._constants as k
import re._parser as parser
from collections.abc import Callable
from functools import cache

from codeloom.llm.lexing import CONTEXTUAL, KEYWORDS, letters

_LIST = "{0}(?:,{0})*"


def _list(rule: str) -> str:
    return f"(?:{_LIST.format(rule)})"


_JS_PAREN = "(?:|<exps>,?|<decl>?;<exps>?;<exps>?|<exps>;<exps>?;<exps>?|(?:<const>|<let>|<var>)?<opd>(?:<of>|<in>)<exp>)"

_JAVA = {
    "id": "(?:i|<record>|<permits>|<yield>)",
    "name": "<id>(?:d<id>)*+",
    "ann": "@<name>P?",
    "mods": "(?:M|<default>|<ann>)*+",
    "T": "(?:<ann>*+<name>G?(?:d<name>G?)*Q*|q(?:(?:<extends>|<super>)<name>G?Q*)?)",
    "Ts": _list("<T>"),
    "head": "(?:u|p|c|P(?=[insPu<this><super><new>]|<id>w)|(?:<id>|P)w)",
    "prim": "(?:<name>G?xi?(?:<new>)?|<id>|n|s|P|<this>|<super>|<new><T>(?:PB?|B)|<new><name>Q+B?|<switch>PB|<id>Q*d<class>|B)",
    "post": "(?:dG?(?:<id>|<this>|<super>|<class>|<new><T>PB?)|P|Q|c|x(?:<id>|<new>))",
    "opd": "<head>*+<prim><post>*+",
    "bin": "(?:[bpmlv&]|g{1,3})",
    "bexp": "<opd>(?:<bin><opd>|<instanceof>M?<T><id>?P?)*+",
    "aexp": "<bexp>(?:[=A]<bexp>)*+",
    "exp": "<aexp>(?:q<aexp>:<aexp>)*+",
    "exps": _list("<exp>"),
    "binding": "<id>Q*(?:=<exp>)?",
    "decl": "<mods><T>" + _list("<binding>"),
    "simple": "(?:<exp>|<return><exp>?|<throw><exp>|<break><id>?|<continue><id>?|<assert><exp>(?::<exp>)?|<yield><exp>|<decl>|);",
    "tryst": "<try>(?:B(?:(?:<catch>PB)+(?:<finally>B)?|<finally>B)|PB(?:<catch>PB)*(?:<finally>B)?)",
    "h": "(?:<if>P|<for>P|<while>P|<id>:)",
    "body": "<h>*+(?:B|<simple>|<tryst>|<do>(?:B|<simple>)<while>P;|<switch>PB|MPB)",
    "typedecl": "<mods>(?:<class>|<interface>|<enum>|<record>|@<interface>)<id>G?P?(?:<extends><Ts>)?(?:<implements><Ts>)?(?:<permits><Ts>)?B;?",
    "method": "<mods>G?(?:<T>)?<id>PQ*(?:<throws><Ts>)?(?:B|;|<default><exp>;)",
    "label": "(?:<case><exps>(?::|w)|<default>(?::|w))",
    "enums": _list("(?:<ann>*<id>P?B?)") + ",?;?",
    "statement": "(?:<label>*(?:<body>(?:<else><body>)*|<typedecl>)|<label>+|<method>|<mods>B|<enums>)",
    "top": "(?:<ann>*<package><name>;|<import>M?<name>(?:dm)?;|<typedecl>|;)",
    "param": "<mods><T>(?:<ann>*e)?<id>Q*",
    "in(": "(?:|<exps>|(?:<param>|<mods><T><this>)(?:,<param>)*|<mods><T><id>:<exp>|(?:<decl>|<exps>)?;<exp>?;<exps>?|<mods><T>(?:v<T>)*<id>|(?:<mods><T><id>=<exp>|<name>)(?:;(?:<mods><T><id>=<exp>|<name>))*;?|<T>(?:&<T>)*)",
    "in[": "<exp>?",
    "in{": "<exps>?,?",
    "in<": "(?:(?:<T>|<id>(?:<extends><T>(?:&<T>)*))(?:,(?:<T>|<id>(?:<extends><T>(?:&<T>)*)))*)?",
}

_JS = {
    "id": "(?:i|<ctx>)",
    "key": "(?:<id>|s|n|Q|<any>)",
    "un": "(?:u|p|c|<typeof>|<void>|<delete>|<await>|<yield>m?|<new>|e|<async>)",
    "lam": "(?:<id>|P)w",
    "fun": "<function>m?<id>?PB",
    "lhs": "<id>(?:d<id>|P)*+",
    "cls": "<class><id>?(?:<extends><lhs>)?B",
    "prim": "(?:<id>|n|s|t|r|P|Q|B|<this>|<super>|<fun>|<cls>|<import>|<new>d<id>)",
    "post": "(?:d(?:<id>|<any>)|z(?:<id>|<any>|Q|P)|P|Q|c|t)",
    "opd": "(?:<lam>|<un>)*<prim><post>*+",
    "bin": "(?:[bpmlv&]|g{1,3}|<in>|<instanceof>)",
    "bexp": "<opd>(?:<bin><opd>)*+",
    "aexp": "<bexp>(?:[=A]<bexp>)*+",
    "exp": "<aexp>(?:q<aexp>:<aexp>)*+",
    "exps": _list("<exp>"),
    "bind": "(?:<id>|B|Q)",
    "binding": "<bind>(?:=<exp>)?",
    "decl": "(?:<const>|<let>|<var>)" + _list("<binding>"),
    "simple": "(?:(?:<exps>|<return><exps>?|<throw><exps>|<break><id>?|<continue><id>?|<decl>);?|;|<fun>|<async><fun>|<cls>)",
    "tryst": "<try>B(?:<catch>P?B(?:<finally>B)?|<finally>B)",
    "h": "(?:<if>P|<for><await>?P|<while>P|<id>:)",
    "body": "<h>*+(?:B|<simple>|<tryst>|<do>(?:B|<simple>)<while>P;?|<switch>PB)",
    "source": "<from>s",
    "importst": "<import>(?:s|(?:<id>|(?:<id>,)?(?:B|m<as><id>))<source>);?",
    "exportst": "<export>(?:<default>(?:<exp>;?|<async>?<fun>|<cls>)|<decl>;?|<async>?<fun>|<cls>|B<source>?;?|m(?:<as><id>)?<source>;?)",
    "member": "(?:(?:<static>|<async>|<get>|<set>|m)*<key>PB|<static>?<key>(?:=<exp>)?;?|<static>B)",
    "label": "(?:<case><exps>:|<default>:)",
    "statement": "(?:<label>*<body>(?:<else><body>)*|<label>+|<member>)",
    "top": "(?:<importst>|<exportst>|<body>(?:<else><body>)*)",
    "entry": "(?:e<exp>|<key>:<exp>|<id>(?:=<exp>)?|(?:<async>|<get>|<set>|m)*<key>PB|(?:<id>|<default>|s)<as>(?:<id>|<default>))",
    "in(": _JS_PAREN,
    "in[": "(?:<exp>?(?:,<exp>?)*+)",
    "in{": "(?:<entry>(?:,<entry>)*+,?)?",
}
_TS = _JS | {
    "T0": "(?:<typeof>|<keyof>|<readonly>|<infer>|<new>|G(?=P)|P(?=w)w(?:<id><is>)?)*+(?:<id>(?:d<id>)*+G?|s|n|pn|t|B|Q|P|<this>|<void>|<import>P(?:d<id>)*G?)Q*",
    "T": "(?:[v&]?<T0>(?:[v&]<T0>)*+(?:<extends><T0>q<T0>:<T0>)?)",
    "Ts": _list("<T>"),
    "ann": "(?::<T>)",
    "lam": "(?:<id>|G?P(?::(?:<asserts>|<id><is>)?<T>)?)w",
    "result": "(?::(?:<asserts>?(?:<id>|<this>)<is><T>|<asserts><id>|<T>))",
    "fun": "<function>m?<id>?G?P<result>?B",
    "lhs": "<id>(?:d<id>|P)*+G?P?",
    "deco": "@<lhs>",
    "cls": "<deco>*+<abstract>?<class><id>?G?(?:<extends><lhs>)?(?:<implements><Ts>)?B",
    "post": "(?:d(?:<id>|<any>)|z(?:<id>|<any>|Q|P)|G(?=[Pt])|P|Q|c|t|u)",
    "bexp": "<opd>(?:<bin><opd>|(?:<as>|<satisfies>)(?:<T>|<const>))*+",
    "binding": "<bind>u?<ann>?(?:=<exp>)?",
    "mod": "(?:<static>|<async>|<get>|<set>|m|<public>|<private>|<protected>|<readonly>|<abstract>|<declare>|<override>|<deco>)",
    "member": "(?:<mod>*<key>[qu]?G?P<result>?(?:B|[;,])?|<mod>*<key>[qu]?<ann>?(?:=<exp>)?[;,]?|<static>B|G?P<ann>[;,]?|<new>P<ann>[;,]?)",
    "tdecl": "(?:<declare>?(?:<interface><id>G?(?:<extends><Ts>)?B|<type><id>G?=<T>;?|<const>?<enum><id>B|(?:<namespace>|<module>)(?:<lhs>|s)B)|<declare>(?:<decl>;?|<function><id>G?P<result>?;?|<cls>)|<abstract><cls>|<function><id>G?P<result>;?)",
    "importst": "<import><type>?(?:s|(?:<id>|(?:<id>,)?(?:B|m<as><id>))<source>|<id>=<exp>);?",
    "exportst": "<deco>*<export>(?:<default>(?:<exp>;?|<async>?<fun>|<cls>|<tdecl>)|<decl>;?|<async>?<fun>|<cls>|<tdecl>|<type>?B<source>?;?|m(?:<as><id>)?<source>;?|=<exp>;?)",
    "statement": "(?:<label>*<body>(?:<else><body>)*|<label>+|<member>|<tdecl>|<exportst>)",
    "top": "(?:<importst>|<exportst>|<tdecl>|<body>(?:<else><body>)*)",
    "entry": "(?:e<exp>|<key>:<exp>|<id>(?:=<exp>)?|(?:<async>|<get>|<set>|m)*<key>G?P<result>?B|<type>?(?:<id>|<default>|s)<as>(?:<id>|<default>)|<type><id>|<mod>*<key>q?<ann>|<key>=<exp>)",
    "param": "<mod>*e?(?:<bind>|<this>)q?<ann>?(?:=<exp>)?",
    "in(": _JS_PAREN[:-1] + "|" + _list("<param>") + ",?|<T>)",
    "in[": "(?:<exp>?(?:,<exp>?)*|<id>:<T>|<id><in><T>|(?:<id>q?:)?e?<T>q?(?:,(?:<id>q?:)?e?<T>q?)*)",
    "in<": "(?:(?:<const>?<id>(?:<extends><T>)?(?:=<T>)?|<T>)(?:,(?:<const>?<id>(?:<extends><T>)?(?:=<T>)?|<T>))*,?)?",
}

_GO = {
    "name": "i(?:di)?",
    "res": "(?:P|<T>)",
    "tpre": "(?:m|Q|<map>Q|y?<chan>y?)",
    "T": "<tpre>*(?:<name>Q?|<struct>B|<interface>B|<func>P(?:P|<tpre>*(?:<name>Q?|<interface>B|<struct>B))?|P)",
    "prim": "(?:n|s|i|P|<func>P<res>?B|<tpre>*<name>Q?B|<tpre>+<name>Q?P|(?:<tpre>*<struct>B)B|<tpre>+<interface>B(?:B|P)|<map>Q<T>B|<interface>B|<tpre>+<name>)",
    "post": "(?:di|dP|P|Q)",
    "opd": "[upm&y]*(?:<chan>)?<prim><post>*|[upmb&]*<func>P<res>?B",
    "bexp": "(?:<opd>)(?:(?:[bpmlg&v]|b)(?:<opd>))*",
    "exps": _list("<bexp>"),
    "simple": "(?:<exps>(?:[=Ao]<exps>)?|<bexp>c|<bexp>y<bexp>)",
    "header": "(?:(?:<simple>?;)?<simple>)",
    "ifst": "<if><header>B(?:<else><if><header>B)*(?:<else>B)?",
    "forst": "<for>(?:<simple>?;<bexp>?;<simple>?|(?:<exps>[=o])?<range><bexp>|<bexp>)?B",
    "switchst": "<switch>(?:<simple>?;)?(?:<simple>)?B",
    "spec": "(?:i(?:,i)*<T>?(?:=<exps>)?)",
    "decl": "(?:(?:<var>|<const>)(?:P|<spec>)|<type>(?:P|iQ?=?<T>))",
    "plain": "(?:<simple>|<return><exps>?|<break>i?|<continue>i?|<goto>i|<fallthrough>|(?:<go>|<defer>)<bexp>|<decl>|<ifst>|<forst>|<switchst>|<select>B|B|)",
    "label": "(?:<case>(?:<exps>(?:[=o]<bexp>)?|<T>(?:,<T>)*|<bexp>y<bexp>):|<default>:)",
    "statement": "(?:<label>*(?:i:)?<plain>;?|<label>+;?|i(?:,i)*<T>s?;?|m?<name>Q?s?;?|iP<res>?;?|(?:b?<T>)(?:v(?:b?<T>))*;?)",
    "top": "(?:<package>i;?|<import>(?:[id]?s|P);?|<func>P?iQ?P<res>?B?;?|<decl>;?|;)",
    "elem": "(?:(?:<bexp>|B)(?::(?:<bexp>|B))?)",
    "in{": "(?:" + _list("<elem>") + ",?)?;?",
    "in[": "(?:|<bexp>|<bexp>?:<bexp>?(?::<bexp>)?|<T>(?:,<T>)*|i(?:,i)*(?:b?<T>)(?:,i(?:,i)*<T>)*|e)",
    "in(": "(?:|<exps>e?,?|<T>(?:,<exps>)?|(?:(?:i(?:,i)*)?e?<T>)(?:,(?:i(?:,i)*)?e?<T>)*,?|(?:[id]?s;)*(?:[id]?s;?)?|(?:<spec>;)*(?:<spec>;?)?|(?:iQ?=?<T>;?)*|<type>)",
}

_PYTHON = {
    "id": "(?:i|<match>|<case>|<type>)",
    "un": "(?:p|u|<not>|<await>|m|b|<lambda>(?:[bm]?<id>(?:=<opd0>)?(?:,[bm]?<id>(?:=<opd0>)?)*)?:)",
    "opd0": "p?(?:<id>|n|s+|P|Q|B|e)",
    "opd": "<un>*(?:<id>|n|s+|P|Q|B|e)(?:d<id>|P|Q)*",
    "bin": "(?:[bpmlg&v@o]|u=|<and>|<or>|<not>?<in>|<is><not>?|<if>|<else>)",
    "exp": "<opd>(?:<bin><opd>)*",
    "exps": "(?:" + _list("<exp>") + ",?)",
    "name": "<id>(?:d<id>)*",
    "alias": "<name>(?:<as><id>)?",
    "simple": "(?:<exps>(?:=<exps>|=<yield><exps>)*|<exps>A<exps>|<exp>:<exp>(?:=<exps>)?|<return><exps>?|<raise>(?:<exp>(?:<from><exp>)?)?|<pass>|<break>|<continue>|<yield>(?:<from>?<exps>)?|(?:<global>|<nonlocal>)<id>(?:,<id>)*|<del><exps>|<assert><exp>(?:,<exp>)?|<import><alias>(?:,<alias>)*|<from>(?:d|e)*(?:<name>)?<import>(?:m|P|<id>(?:<as><id>)?(?:,<id>(?:<as><id>)?)*)|@<exp>|<type><id>Q?=<exp>)",
    "simples": "<simple>(?:;<simple>)*;?",
    "headed": "(?:<async>?<def><id>Q?P(?:w<exp>)?|<class><id>Q?P?|<if><exp>|<elif><exp>|<else>|<try>|<finally>|<except>m?(?:<exps>(?:<as><id>)?)?|<while><exp>|<async>?<for><exps0><in><exps>|<async>?<with>(?:<exp>(?:<as><opd>)?)(?:,<exp>(?:<as><opd>)?)*|<match><exps>|<case><exps>(?:<if><exp>)?)",
    "exps0": "(?:m?<opd>(?:,m?<opd>)*,?)",
    "statement": "(?:|<simples>|<headed>:<simples>)",
    "block": "<headed>:",
    "comp": "(?:<exp>|<exp>:<exp>)(?:<async>?<for><exps0><in><exp>(?:<if><exp>)*)+",
    "arg": "(?:(?:m|b)?<exp>(?:=<exp>|:<exp>(?:=<exp>)?)?|<id>:<exp>(?:=<exp>)?|m|b)",
    "in(": "(?:|" + _list("<arg>") + ",?|<comp>|<yield>(?:<from>?<exps>)?|<alias>(?:,<alias>)*,?)",
    "in[": "(?:|" + _list("(?:<exp>?(?::<exp>?)*)") + ",?|<comp>)",
    "in{": "(?:|" + _list("(?:(?:m|b)?<exp>(?::<exp>)?)") + ",?|<comp>)",
    "top": "(?:<statement>|<block>)",
}

_RULES = {"java": _JAVA, "javascript": _JS, "typescript": _TS, "go": _GO, "python": _PYTHON}
_REF = re.compile(r"<(\w+)>")
#: Letters from here on stand for rules.
_RULE_BASE = 0xF000

Ends = frozenset[int]
Step = Callable[[str, int, dict], Ends]
_NONE: Ends = frozenset()


class Grammar:
    """The rules of one language, each parsed once; a rule may refer to others, so none is written out twice."""

    def __init__(self, lang: str):
        self.lang, self.words, rules = lang, letters(lang), _RULES[lang]
        self.names = list(rules)
        self.letter = {n: chr(_RULE_BASE + k) for k, n in enumerate(self.names)}
        self.trees = {n: parser.parse(_REF.sub(self._reference, text)) for n, text in rules.items()}
        self._summaries: dict[str, tuple] = {}
        self.steps = {n: self._sequence(tree) for n, tree in self.trees.items()}

    def _reference(self, found: re.Match) -> str:
        word = found[1]
        if word in self.letter:
            return self.letter[word]
        if word == "ctx":
            return "[" + "".join(self.words[w] for w in CONTEXTUAL[self.lang].split()) + "]"
        if word == "any":
            return "[" + "".join(self.words.values()) + "]"
        return self.words[word]

    # recognition: a step gives all places where a match from a place can end

    def _sequence(self, tree) -> Step:
        steps = [self._step(op, arg) for op, arg in tree]
        if len(steps) == 1:
            return steps[0]

        def run(text: str, at: int, memo: dict) -> Ends:
            places = frozenset((at,))
            for step in steps:
                if not places:
                    return _NONE
                places = step(text, next(iter(places)), memo) if len(places) == 1 else frozenset().union(*(step(text, p, memo) for p in places))
            return places

        return run

    def _step(self, op, arg) -> Step:
        if op is k.LITERAL and arg >= _RULE_BASE:
            name = self.names[arg - _RULE_BASE]
            firsts, _, _, empty = self.summary(name)

            def rule(text: str, at: int, memo: dict) -> Ends:
                if not empty and (at >= len(text) or text[at] not in firsts):
                    return _NONE
                key = (name, at)
                known = memo.get(key)
                if known is None:
                    known = memo[key] = self.steps[name](text, at, memo)
                return known

            return rule
        if op is k.IN and any(c >= _RULE_BASE for _, c in arg):  # the parser makes a set of single-letter branches
            steps = [self._step(*x) for x in arg]
            return lambda text, at, memo: frozenset().union(*(s(text, at, memo) for s in steps))
        if op is k.LITERAL or op is k.IN:
            letters_ = {chr(arg)} if op is k.LITERAL else {chr(c) for kind, c in arg if kind is k.LITERAL}
            return lambda text, at, memo: frozenset((at + 1,)) if at < len(text) and text[at] in letters_ else _NONE
        if op is k.BRANCH:
            ways = [(self._summary(x), self._sequence(x)) for x in arg[1]]
            anywhere = tuple(step for (_, _, _, empty), step in ways if empty)
            by_first: dict[str, tuple[Step, ...]] = {}
            for (firsts, _, _, empty), step in ways:
                for letter in firsts if not empty else ():
                    by_first[letter] = (*by_first.get(letter, ()), step)

            def branch(text: str, at: int, memo: dict) -> Ends:
                steps = by_first.get(text[at], ()) + anywhere if at < len(text) else anywhere
                if len(steps) == 1:
                    return steps[0](text, at, memo)
                return frozenset().union(*(s(text, at, memo) for s in steps)) if steps else _NONE

            return branch
        if op is k.SUBPATTERN:
            return self._sequence(arg[3])
        if op is k.ATOMIC_GROUP:
            return self._sequence(arg)
        if op is k.ASSERT:
            inner = self._sequence(arg[1])
            return lambda text, at, memo: frozenset((at,)) if inner(text, at, memo) else _NONE
        if op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT):
            least, most, inner = arg[0], arg[1], self._sequence(arg[2])

            def repeat(text: str, at: int, memo: dict) -> Ends:
                found, edge, n = ({at} if least == 0 else set()), {at}, 0
                seen = {at}
                while edge and n < most:
                    n += 1
                    edge = set().union(*(inner(text, p, memo) for p in edge))
                    if n >= least:
                        edge -= found
                        found |= edge
                    elif edge <= seen and n > len(text):
                        break
                return frozenset(found)

            return repeat
        raise ValueError(f"a production uses {op}")

    def matches(self, name: str, text: str) -> bool:
        """Whether the whole text is derived from the rule."""
        return len(text) in self.steps[name](text, 0, {})

    # adjacency: first letters, last letters, adjacent pairs, and whether it may be empty

    def summary(self, name: str) -> tuple[set[str], set[str], set[tuple[str, str]], bool]:
        if name not in self._summaries:
            self._summaries[name] = self._summary(self.trees[name])
        return self._summaries[name]

    def _summary(self, tree) -> tuple[set[str], set[str], set[tuple[str, str]], bool]:
        firsts: set[str] = set()
        lasts: set[str] = set()
        pairs: set[tuple[str, str]] = set()
        empty = True
        for op, arg in tree:
            if op is k.LITERAL and arg >= _RULE_BASE:
                f, l, p, e = self.summary(self.names[arg - _RULE_BASE])
            elif op is k.LITERAL:
                f, l, p, e = {chr(arg)}, {chr(arg)}, set(), False
            elif op is k.IN or op is k.BRANCH:
                parts = [self._summary([x]) for x in arg] if op is k.IN else [self._summary(x) for x in arg[1]]
                f, l, p, e = set().union(*(x[0] for x in parts)), set().union(*(x[1] for x in parts)), set().union(*(x[2] for x in parts)), any(x[3] for x in parts)
            elif op is k.SUBPATTERN:
                f, l, p, e = self._summary(arg[3])
            elif op is k.ATOMIC_GROUP:
                f, l, p, e = self._summary(arg)
            elif op in (k.MAX_REPEAT, k.MIN_REPEAT, k.POSSESSIVE_REPEAT):
                f, l, p, e = self._summary(arg[2])
                p = p | ({(a, b) for a in l for b in f} if arg[1] > 1 else set())
                e = e or arg[0] == 0
            else:  # a look ahead takes no letter
                continue
            pairs |= p | {(a, b) for a in lasts for b in f}
            firsts |= f if empty else set()
            lasts = l | (lasts if e else set())
            empty = empty and e
        return firsts, lasts, pairs, empty


@cache
def grammar(lang: str) -> Grammar:
    return Grammar(lang)


_OPEN, _CLOSE, _GROUP = "([{l", ")]}g", "PQBG"


@cache
def permissible_pairs(lang: str) -> frozenset[str]:
    """All pairs of adjacent class letters that the productions allow, brackets included."""
    own = grammar(lang)
    inside = {"(": ["in("], "[": ["in["], "{": ["in{", *(["statement"] if lang != "python" else [])], "l": ["in<"] if "in<" in _RULES[lang] else []}
    outer = [own.summary(n) for n in ("top", "statement", *(["block"] if lang == "python" else []))]
    starts, ends = set().union(*(x[0] for x in outer)), set().union(*(x[1] for x in outer))
    raw = set().union(*(x[2] for x in outer))
    raw |= {(a, b) for a in ends for b in starts}
    for j, opening in enumerate(_OPEN):
        for n in inside[opening]:
            f, l, p, e = own.summary(n)
            raw |= p | {(opening, x) for x in f} | {(x, _CLOSE[j]) for x in l} | ({(opening, _CLOSE[j])} if e else set())
    left = lambda x: _CLOSE[_GROUP.index(x)] if x in _GROUP else x
    right = lambda x: _OPEN[_GROUP.index(x)] if x in _GROUP else x
    return frozenset(left(a) + right(b) for a, b in raw)


def languages() -> list[str]:
    return list(KEYWORDS)
