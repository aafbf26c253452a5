"""Source files that do not parse.

A text is cut into tokens and its brackets are folded from the inside out: the content of each is judged by the
language's grammar with a generalised LL parser (``gll``), and the bracket becomes one token that stands for all that
it can be (a block, an object, arguments ...). Equal contents are judged once per task. The dialects of a language
are alternatives of one start symbol, so they run together on one graph-structured stack, and a file counts as invalid
if every dialect of its extension rejects it. Nesting is only bounded by memory.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm import grammars
from quarryline.llm.gll import Grammar, Tokens

# Reserved words of the languages, and words that are reserved only in some places.
JS_WORDS = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in "
    "instanceof new null return super switch this throw true try typeof var void while with"
).split()
JS_SOFT = (
    "abstract accessor as async asserts await declare from get global implements infer interface is keyof let module namespace of override "
    "package private protected public readonly satisfies set static target type undefined unique yield"
).split()
PY_WORDS = (
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is "
    "lambda nonlocal not or pass raise return try while with yield"
).split()


#: Folded groups that a task remembers for each language; beyond that it starts anew (a bound on memory, not on work).
KEPT = 80_000


class Rejected(Exception):
    """The text is invalid in every dialect."""


class Folder:
    """Folds bracketed groups of one language into tokens. Subclasses say what a group can be."""

    rules = ""
    words: tuple[str, ...] = ()
    soft: tuple[str, ...] = ()

    def __init__(self) -> None:
        self.tokens = Tokens()
        self.grammar = Grammar(self.rules, self.tokens)
        self.folded: dict[tuple[str, str], str] = {}
        self.comma = self.one(",")
        self.semi = self.one(";")
        self.word = {w: self.one(w, "NAME") if self.words_are_names else self.one(w) for w in self.words}
        self.word |= {w: self.one(w, "NAME", "ID") for w in self.soft}
        self.name = self.one("NAME", "ID")

    words_are_names = False

    def one(self, *terminals: str) -> str:
        return self.tokens.code(frozenset(terminals))

    def items(self, content: str) -> list[str]:
        """The parts between commas, without an empty last one."""
        parts = content.split(self.comma)
        return parts[:-1] if not parts[-1] else parts

    def each(self, rule: str, content: str, hollow: bool = False) -> bool:
        """Whether all parts between commas are as the rule says; ``hollow``: they may be empty."""
        ok = self.grammar.accepts
        return all(hollow if not x else ok(rule, x) for x in self.items(content))

    def fold(self, kind: str, content: str) -> str:
        """The token of a group; raises if it can be nothing."""
        key = (kind, content)
        got = self.folded.get(key)
        if got is None:
            if len(self.folded) > KEPT:
                self.folded.clear()
            can = self.roles(kind, content)
            got = self.folded[key] = self.tokens.code(frozenset(can)) if can else ""
        if not got:
            raise Rejected(kind)
        return got

    def roles(self, kind: str, content: str) -> set[str]:
        raise NotImplementedError


_JS_TOKEN = re.compile(
    r"""[ \t\v\f\u00a0\ufeff]*(?:(?P<nl>\r\n?|[\n\u2028\u2029])|(?P<comment>//[^\n\r]*)|(?P<block>/\*[\s\S]*?\*/)|"""
    r"""(?P<id>[A-Za-z_$\u00aa-\u1fff\u2c00-\udfff\uf900-\ufdff\U00010000-\U0003ffff][\w$]*)|"""
    r"""(?P<num>0[xX][\da-fA-F_]+n?|0[oO][0-7_]+n?|0[bB][01_]+n?|(?:0|[1-9][\d_]*)n(?![\w$])|(?:(?:0|[1-9][\d_]*)(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?(?![\w$]))|"""
    r"""(?P<oct>0\d+(?![\w$.]))|(?P<str>"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')|(?P<tick>`)|"""
    r"""(?P<private>\#[A-Za-z_$][\w$]*)|"""
    r"""(?P<op>>=|===|!==|\*\*=|<<=|\?\?=|&&=|\|\|=|=>|==|!=|<=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|\*\*|\.\.\.|[-+*/%&|^!~?:=.,;@<>])|"""
    r"""(?P<open>[({\[])|(?P<close>[)}\]])|(?P<end>$(?!\n)))"""
)
#: Python's own limit on nested calls is lifted for nested JSX elements and templates (their frames lie on the heap).
_DEPTH = 1 << 30
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[A-Za-z]*")
_JS_TEMPLATE = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{)")
_JS_BINARY = {"===", "!==", "==", "!=", "<=", ">=", "<<", "%", "/", "^"}
_JS_ASSIGN = {"**=", "<<=", "??=", "&&=", "||=", "+=", "-=", "*=", "/=", "%=", "&=", "|=", "^="}
_PAIRS = {")": "(", "]": "[", "}": "{"}
_JSX_TAG = re.compile(r"\s*(?:([A-Za-z_$][\w$-]*)|(\"[^\"]*\"|'[^']*')|([.:=/>{<])|$)")
_JSX_START, _JSX_CLOSE, _JSX_END = re.compile(r"<\s*[A-Za-z_$>]"), re.compile(r"<\s*/"), re.compile(r"<\s*/\s*([\w$.:-]*)\s*>")
_JSX_TEXT = re.compile(r"[^<{>}]+")


@lru_cache(maxsize=4096)
def _regex_ok(body: str, flags: str) -> bool:
    """Whether a regular expression has matched brackets, something before each quantifier, and flags that exist, each once."""
    if len(set(flags)) < len(flags) or set(flags) - set("dgimsuvy"):
        return False
    depth, can_repeat = 0, False
    for m in re.finditer(r"\\.|\[(?:[^\]\\]|\\.)*\]|\(\?(?:<?[=!]|:|<[\w$]+>)|[\s\S]", body):
        t = m.group()
        if t[0] == "(" :
            depth += 1
            can_repeat = False
        elif t == ")":
            depth -= 1
            if depth < 0:
                return False
            can_repeat = True
        elif t in "*+?" :
            if not can_repeat and body[m.start() - 1 : m.start()] not in ("*", "+", "?", "}"):
                return False
            can_repeat = False
        else:
            can_repeat = t not in "|^"
    return depth == 0


class Script(Folder):
    """JavaScript; ``jsx`` and ``typed`` add JSX and TypeScript."""

    words, soft, words_are_names = tuple(JS_WORDS), tuple(JS_SOFT), True

    def __init__(self, typed: bool, jsx: bool) -> None:
        self.rules = grammars.TYPESCRIPT if typed else grammars.JAVASCRIPT
        self.typed, self.jsx = typed, jsx
        super().__init__()
        self.op = {o: self.one("BINOP") for o in _JS_BINARY} | {o: self.one("BINASSIGN") for o in _JS_ASSIGN}
        self.op |= {"&&": self.one("LOGIC"), "||": self.one("LOGIC"), "??": self.one("COALESCE"), "**": self.one("POW")}
        self.op |= {o: self.one(o) for o in "- + * & | ! ~ ? ?. : = . , ; @ < > => ...".split()} | {"++": self.one("INC"), "--": self.one("INC")}
        self.op[">="] = self.tokens.code(frozenset((">=", "BINOP")))
        self.op["/"] = self.tokens.code(frozenset(("/", "BINOP")))
        self.atom = {k: self.one(k) for k in ("NUM", "OCT", "STR", "TEMPLATE", "REGEX", "PRIVATE", "JSX", "TEXT")}
        #: a new line before else and while ends a statement where one is open; what stands first says which dialects there are
        self.line_end = self.one(";", "NL")
        self.dialects = {False: self.one("SCRIPT", "MODULE"), True: self.one("SCRIPT")}
        w = self.word
        #: after these an operand may not follow on the same statement; these can begin a statement on a new line
        self.enders = {self.name, *self.atom.values(), self.op["++"], *(w[x] for x in ("this", "null", "true", "false", "super", "break", "continue", "return", "debugger"))}
        self.enders |= {w[x] for x in JS_SOFT}
        no_start = {"of", "as", "is", "satisfies", "implements", "from"}
        self.starters = {self.name, self.atom["NUM"], self.atom["STR"], self.atom["PRIVATE"], self.op["@"], self.op["++"], *(w[x] for x in JS_SOFT if x not in no_start)}
        self.starters |= {w[x] for x in JS_WORDS if x not in ("in", "instanceof", "extends", "else", "catch", "finally", "while")}
        self.operands = (self.enders - {w[x] for x in ("return", "yield", "await", "of", "as", "is", "satisfies", "keyof")}) - {self.op["++"]}
        self.heads = {w[x] for x in ("if", "for", "while", "with", "await")}

    def roles(self, kind: str, content: str) -> set[str]:
        ok = self.grammar.accepts
        can: set[str] = set()
        angled = self.typed and self.op["<"] in content

        def listed(rule: str, role: str, hollow: bool = False) -> None:
            if self.each(rule, content, hollow) or (angled and self._pieces(rule, content)):
                can.add(role)

        if kind == "(":
            listed("Arg", "Args")
            listed("Param", "Params")
            if content and ok("Expr", content):
                can.add("Cond")
                if ok("Target", content) or self.typed:
                    can.add("PTarget")
            if self.semi in content or self.word["of"] in content or self.word["in"] in content:
                can |= {"ForHead"} if ok("ForHeadIn", content) else set()
            if ok("CatchIn", content):
                can.add("CatchParam")
            if self.typed and ok("Type", content):
                can.add("TyParen")
        elif kind == "[":
            listed("Arg", "Arr", True)
            if content and ok("Expr", content):
                can.add("Idx")
            if self.typed:
                can |= {"ArrEmpty"} if not content else set()
                listed("TyItem", "TyTuple")
                can |= {role for rule, role in (("Type", "TyIdx"), ("IdxSigIn", "IdxSig"), ("MapSigIn", "MapSig")) if content and ok(rule, content)}
        elif kind == "{":
            can = self._brace(content, listed)
            if can:
                can.add("Brace")
        elif ok("JsxElement", content):
            can = {"JSX"}
        return can

    def _brace(self, content: str, listed: Callable) -> set[str]:
        ok = self.grammar.accepts
        can: set[str] = set()
        if self.semi not in content:
            if not content or self.items(content)[0]:
                before = set()
                for rule, role in (("Prop", "Obj"), ("Spec", "Specs"), *((("EnumItem", "EnumBody"),) if self.typed else ())):
                    if self.each(rule, content) or (self.typed and self.op["<"] in content and self._pieces(rule, content)):
                        before.add(role)
                can |= before
            if ok("JsxInner", content):
                can.add("JsxExpr")
                if content and self.op["..."] == content[0]:
                    can.add("JsxSpread")
        if self.sequence("Stmts", content):
            can.add("Block")
        if self.sequence("Members", content):
            can.add("ClassBody")
        if self.word["case"] in content or self.word["default"] in content or not content:
            can |= {"Cases"} if ok("CaseBody", content) else set()
        if self.typed:
            if "Block" in can or self.sequence("Module", content):
                can.add("NsBlock")
            items = [y for x in content.split(self.semi) for y in x.split(self.comma) if y]
            if all(ok("IfaceItem", x) for x in items) or self._iface(content):
                can.add("Iface")
        return can

    def _pieces(self, rule: str, content: str) -> bool:
        """Like ``each``, but parts may hold commas in angle brackets."""
        part, ok = "", self.grammar.accepts
        for x in self.items(content):
            part = f"{part}{self.comma}{x}" if part else x
            if ok(rule, part):
                part = ""
        return not part

    def _iface(self, content: str) -> bool:
        return self.op["<"] in content and all(self._pieces("IfaceItem", x) for x in content.split(self.semi) if x)

    def sequence(self, rule: str, content: str, before: str = "") -> bool:
        """Whether the content is a sequence of statements or members, judged statement by statement.

        A statement ends with its semicolon, unless else or while go on with it. ``before`` is put in front of each.
        """
        ok, go_on = self.grammar.accepts, (self.word["else"], self.word["while"])
        part = ""
        for x in content.split(self.semi):
            if part and not x.startswith(go_on):
                if not ok(rule, before + part):
                    return False
                part = ""
            part += x + self.semi
        return ok(rule, before + part[:-1])

    def scan(self, text: str, at: int, closer: str) -> tuple[str, int]:
        """Tokens from ``at`` up to the closing bracket ("" for the text's end), groups folded; and where they end."""
        stack: list[tuple[str, list[str], str]] = []
        out: list[str] = []
        prev, newline, head = "", False, ""
        match, n = _JS_TOKEN.match, len(text)
        enders, starters, operands = self.enders, self.starters, self.operands
        braces, ends_group = True, False  # in a block or at the top; the last token is a folded group
        while at < n:
            m = match(text, at)
            if m is None:
                raise Rejected("character")
            kind = m.lastgroup
            w, start, at = m.group(kind), m.start(kind), m.end()
            if kind == "nl":
                newline = True
                continue
            if kind == "comment":
                continue
            if kind == "block":
                newline = newline or "\n" in w
                continue
            if kind == "end":
                break
            if kind == "oct":
                self.sloppy = True  # scripts only
            if kind == "id":
                code = self.word.get(w, self.name) if prev != self.op["."] and prev != self.op["?."] else self.name
            elif kind == "op":
                if w[0] == "/" and not (prev in operands or ends_group):
                    r = _JS_REGEX.match(text, start)
                    if not r or not _regex_ok(*r.group()[1:].rsplit("/", 1)):
                        raise Rejected("regex")
                    at, code = r.end(), self.atom["REGEX"]
                elif w == "<" and self.jsx and not (prev in operands or ends_group) and _JSX_START.match(text, start):
                    code, at = self.element(text, start)
                else:
                    code = self.op.get(w)
                    if code is None:
                        raise Rejected(w)
            elif kind == "open":
                stack.append((w, out, prev))
                out = []
                braces = w == "{"
                prev, newline, ends_group = "", False, False
                continue
            elif kind == "close":
                shut, w = w, _PAIRS[w]
                if not stack:
                    if shut == closer:
                        return "".join(out), at
                    raise Rejected("bracket")
                opened, outer, before = stack.pop()
                if opened != w:
                    raise Rejected("bracket")
                code = self.fold(w, "".join(out))
                out = outer
                braces = not stack or stack[-1][0] == "{"
                out.append(code)
                prev = code
                ends_group = not (w == "(" and before in self.heads)
                if not ends_group:
                    prev = ""
                newline = False
                continue
            elif kind == "tick":
                while True:
                    t = _JS_TEMPLATE.match(text, at)
                    if not t:
                        raise Rejected("template")
                    at = t.end()
                    if t.group(1) == "`":
                        break
                    inner, at = self.scan(text, at, "}")
                    if not self.grammar.accepts("Expr", inner):
                        raise Rejected("template")
                code = self.atom["TEMPLATE"]
            else:
                code = self.atom[kind.upper()]
            if newline:
                newline = False
                if kind == "id" and w in ("else", "while") and prev != self.op["."] and (ends_group or prev in enders):
                    out.append(self.line_end)
                elif braces and code in starters and (ends_group or prev in enders):
                    out.append(self.semi)
            out.append(code)
            prev, ends_group = code, False
        if stack or closer:
            raise Rejected("end")
        return "".join(out), at

    def element(self, text: str, at: int) -> tuple[str, int]:
        """The token of a JSX element that begins at ``at``, and where it ends."""
        out = [self.op["<"]]
        at += 1
        name: list[str] = []
        closing = False
        while True:
            m = _JSX_TAG.match(text, at)
            if m is None or m.lastindex is None:
                raise Rejected("tag")
            at = m.end()
            if m.group(1):
                parts = m.group(1).split("-")
                for k, _ in enumerate(parts):
                    out += [self.op["-"], self.name] if k else [self.name]
                if len(out) < 3:
                    name.append(m.group(1))
            elif m.group(2):
                out.append(self.atom["STR"])
            elif m.group(3) == "{":
                inner, at = self.scan(text, at, "}")
                out.append(self.fold("{", inner))
            elif m.group(3) == "<":
                code, at = self.element(text, m.end() - 1)
                out.append(code)
            else:
                out.append(self.op[m.group(3)])
                if m.group(3) == "/":
                    closing = True
                elif m.group(3) == ">":
                    break
        if closing:
            return self.fold("<", "".join(out)), at
        while True:
            t = _JSX_TEXT.match(text, at)
            if t:
                out.append(self.atom["TEXT"])
                at = t.end()
            c = text[at : at + 1]
            if c == "{":
                inner, at = self.scan(text, at + 1, "}")
                out.append(self.fold("{", inner))
            elif c == "<" and _JSX_CLOSE.match(text, at):
                m = _JSX_END.match(text, at)
                if not m or m.group(1).split(".")[0].split(":")[0] != (name[0] if name else ""):
                    raise Rejected("tag")
                out += [self.op["<"], self.op["/"]]
                for k, part in enumerate(re.split(r"([.:-])", m.group(1))):
                    if part:
                        out.append(self.op[part] if k % 2 else self.name)
                out.append(self.op[">"])
                return self.fold("<", "".join(out)), m.end()
            elif c == "<":
                code, at = self.element(text, at)
                out.append(code)
            else:
                raise Rejected("text")

    def valid(self, text: str) -> bool:
        """Whether the text is a module or a script."""
        if text.startswith("#!"):
            text = text[text.find("\n") :] if "\n" in text else ""
        self.sloppy = False
        try:
            content, _ = self.scan(text, 0, "")
        except Rejected:
            return False
        return self.sequence("Source", content, self.dialects[self.sloppy])


_PY_STRING = r"""(?:[rRbBfFuU]|[bB][rR]|[rR][bB]|[fF][rR]|[rR][fF])?(?:\"\"\"(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|'''(?:[^'\\]|\\[\s\S]|'(?!''))*'''|"(?:[^"\\\n]|\\[\s\S])*"(?!")|'(?:[^'\\\n]|\\[\s\S])*'(?!')|""(?!")|''(?!'))"""
_PY_TOKEN = re.compile(
    r"(?:[ \t\f]|\\\r?\n)*(?:(?P<comment>\#[^\n]*)|(?P<nl>\r?\n|\r)|"
    rf"(?P<str>{_PY_STRING})|"
    r"(?P<num>(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*)?\.\d(?:_?\d)*(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?|\d(?:_?\d)*\.?(?:[eE][+-]?\d(?:_?\d)*)[jJ]?|\d(?:_?\d)*\.[jJ]?|"
    r"\d(?:_?\d)*[jJ]|[1-9](?:_?\d)*|0(?:_?0)*)(?![\w]))|"
    r"(?P<id>[^\W\d]\w*)|"
    r"(?P<op>\*\*=|//=|>>=|<<=|\.\.\.|:=|->|==|!=|<=|>=|\+=|-=|\*=|/=|%=|@=|&=|\|=|\^=|\*\*|//|<<|>>|[-+*/%@&|^~<>.,;:=])|"
    r"(?P<open>[({\[])|(?P<close>[)}\]])|(?P<end>$(?!\n)))"
)
_PY_BINARY = {"==", "!=", "<=", ">=", "//", "<<", ">>", "%", "&", "^", "<", ">"}
#: What a logical line can be, and the label that the grammar of blocks knows it by.
_PY_LINES = (
    ("Simple", "L_Simple"), ("If", "L_If"), ("Elif", "L_Elif"), ("Else", "L_Else"), ("TryHead", "L_Try"), ("Except", "L_Except"),
    ("Finally", "L_Finally"), ("While", "L_While"), ("For", "L_For"), ("With", "L_With"), ("Def", "L_Def"), ("ClassHead", "L_Class"),
    ("Match", "L_Match"), ("Case", "L_Case"), ("Decorator", "L_Decorator"), ("If1", "L_If1"), ("Elif1", "L_Elif1"), ("Else1", "L_Else1"),
    ("Try1", "L_Try1"), ("Except1", "L_Except1"), ("Finally1", "L_Finally1"), ("Loop1", "L_Loop1"), ("Head1", "L_Head1"),
)
_GO_ON = {"L_Elif", "L_Else", "L_Except", "L_Finally", "L_Elif1", "L_Else1", "L_Except1", "L_Finally1", "B"}


class Python(Folder):
    """Python 3: brackets are folded within logical lines, lines within blocks."""

    rules, words = grammars.PYTHON, tuple(PY_WORDS)

    def __init__(self) -> None:
        super().__init__()
        self.word |= {w: self.one(w, "NAME") for w in ("match", "case", "type")}
        self.op = {o: self.one("OP") for o in _PY_BINARY} | {o: self.one(o) for o in "- + * ** | / ~ := -> ... . , ; : =".split()}
        self.op |= {o: self.one("AUG") for o in "**= //= >>= <<= += -= *= /= %= @= &= |= ^=".split()} | {"@": self.one("@", "OP")}
        self.str, self.num = self.one("STR"), self.one("NUM")

    def roles(self, kind: str, content: str) -> set[str]:
        ok, can = self.grammar.accepts, set()
        lone = content and content[-1] != self.comma
        if kind == "(":
            listed = {"Arg": "Args", "Param": "Params", "ImportName": "Imports", "WithItem": "WithItems", "Star": "Paren", "Target": "TTuple"}
            can |= {role for rule, role in listed.items() if self._each(rule, content)}
            if "Args" in can and not self._ordered(content):
                can.discard("Args")
            if "Params" in can and not self._declared(content):
                can.discard("Params")
            if lone and self.comma not in content and "Paren" in can and content[0] == self.op["*"]:
                can.discard("Paren")
            if lone and ok("ParenOne", content):
                can |= {"Paren", "Args"}
            if lone and ok("Alone", content):
                can.add("TOne")
        elif kind == "[":
            can |= {role for rule, role in (("Star", "List"), ("Slice", "Sub"), ("TypeParam", "List"), ("Target", "TList")) if self._each(rule, content)}
            if lone and ok("ParenOne", content):
                can.add("List")
            if not content:
                can.discard("Sub")
        elif kind == "{":
            if self._each("DictItem", content) or self._each("Star", content) or ok("DictOne", content) or (lone and ok("ParenOne", content)):
                can.add("Dict")
        elif kind == "line":
            can = {label for rule, label in _PY_LINES if ok(rule, content)}
        elif kind == "block":
            can = ({"B"} if self.suite(content) else set()) | ({"Cases"} if ok("CaseBody", content) else set())
        return can

    def _each(self, rule: str, content: str) -> bool:
        if content == self.comma:
            return False
        if self.each(rule, content):
            return True
        if self.word["lambda"] not in content:
            return False
        part = ""  # commas of a lambda's parameters
        for x in self.items(content):
            part = f"{part}{self.comma}{x}" if part else x
            if self.grammar.accepts(rule, part):
                part = ""
        return not part

    def _ordered(self, content: str) -> bool:
        """Arguments: none by place after one by name, none of these after **; a generator without brackets is alone."""
        if self.word["lambda"] in content:
            return True
        items, named, keys = self.items(content), False, False
        for x in items:
            if x[0] == self.op["**"]:
                keys = True
            elif x[0] == self.op["*"]:
                if keys:
                    return False
            elif x[1:2] == self.op["="]:
                named = True
            elif named or keys or len(items) > 1 and self.word["for"] in x:
                return False
        return True

    def _declared(self, content: str) -> bool:
        """Parameters: none without default after one with, until a star; a bare star has one after it; ** is the last."""
        if self.word["lambda"] in content:
            return True
        default = star = bare = slash = False
        items = self.items(content)
        for k, x in enumerate(items):
            if x[0] == self.op["**"]:
                return k == len(items) - 1 and not bare
            if x[0] == self.op["*"]:
                if star:
                    return False
                star, bare = True, len(x) == 1
            elif x[0] == self.op["/"]:
                if slash or star or not k:
                    return False
                slash = True
            else:
                bare = False
                if self.op["="] in x:
                    default = True
                elif default and not star:
                    return False
        return not bare

    def suite(self, lines: str) -> bool:
        """Whether lines and blocks are statements: judged one statement at a time."""
        ok, of = self.grammar.accepts, self.tokens.of
        start = 0
        for k in range(1, len(lines) + 1):
            if k == len(lines) or (of(lines[k]).isdisjoint(_GO_ON) and "L_Decorator" not in of(lines[k - 1])):
                if not ok("Suite", lines[start:k]):
                    return False
                start = k
        return True

    def valid(self, text: str) -> bool:
        try:
            return self._scan(text.removeprefix("\ufeff"))
        except Rejected:
            return False

    def _scan(self, text: str) -> bool:
        match, word, name, op = _PY_TOKEN.match, self.word, self.name, self.op
        stack: list[tuple[str, list[str]]] = []
        line: list[str] = []
        depth, blocks, column = [0], [[]], 0
        at, n, fresh = 0, len(text), True
        while at < n:
            m = match(text, at)
            if m is None:
                raise Rejected("character")
            kind = m.lastgroup
            w, before, at = m.group(kind), at, m.end()
            if kind == "comment":
                continue
            if kind == "nl":
                if not stack:
                    if line:
                        self._line(line, column, depth, blocks)
                        line = []
                    fresh = True
                continue
            if kind == "end":
                break
            if fresh:
                column = len(text[before : m.start(kind)].expandtabs(8))
            fresh = False
            if kind == "id":
                line.append(word.get(w, name))
            elif kind == "op":
                line.append(op[w])
            elif kind == "str":
                line.append(self.str)
            elif kind == "num":
                line.append(self.num)
            elif kind == "open":
                stack.append((w, line))
                line = []
            else:
                if not stack or stack[-1][0] != _PAIRS[w]:
                    raise Rejected("bracket")
                opened, outer = stack.pop()
                outer.append(self.fold(opened, "".join(line)))
                line = outer
        if stack:
            raise Rejected("end")
        if line:
            self._line(line, column, depth, blocks)
        self._dedent(0, depth, blocks)
        return self.suite("".join(blocks[0]))

    def _line(self, line: list[str], column: int, depth: list[int], blocks: list[list[str]]) -> None:
        if column > depth[-1]:
            depth.append(column)
            blocks.append([])
        elif column < depth[-1]:
            self._dedent(column, depth, blocks)
            if depth[-1] != column:
                raise Rejected("indent")
        blocks[-1].append(self.fold("line", "".join(line)))

    def _dedent(self, column: int, depth: list[int], blocks: list[list[str]]) -> None:
        while depth[-1] > column:
            depth.pop()
            code = self.fold("block", "".join(blocks.pop()))
            blocks[-1].append(code)


_JSON_TOKEN = re.compile(
    r'(?P<ws>[ \t\r\n]+)|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[\da-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|'
    r"(?P<word>true|false|null)(?!\w)|(?P<op>[:,])|(?P<open>[{\[])|(?P<close>[}\]])"
)


class Json(Folder):
    """JSON, strictly."""

    rules, words = grammars.JSON, ("true", "false", "null")

    def roles(self, kind: str, content: str) -> set[str]:
        if content and content[-1] == self.comma:
            return set()
        return {"Arr"} if kind == "[" and self.each("Item", content) else {"Obj"} if kind == "{" and self.each("Pair", content) else set()

    def valid(self, text: str) -> bool:
        if not text.strip(" \t\r\n"):
            return not text
        stack: list[tuple[str, list[str]]] = []
        out: list[str] = []
        codes = {"str": self.one("STR"), "num": self.one("NUM")}
        at = 0
        try:
            while at < len(text):
                m = _JSON_TOKEN.match(text, at)
                if m is None:
                    return False
                kind, at = m.lastgroup, m.end()
                if kind == "open":
                    stack.append((m.group(), out))
                    out = []
                elif kind == "close":
                    if not stack or stack[-1][0] != _PAIRS[m.group()]:
                        return False
                    opened, outer = stack.pop()
                    outer.append(self.fold(opened, "".join(out)))
                    out = outer
                elif kind != "ws":
                    out.append(codes.get(kind) or self.one(m.group()))
        except Rejected:
            return False
        return not stack and self.grammar.accepts("Value", "".join(out))


_TOML_TOKEN = re.compile(
    r"(?P<ws>[ \t]+)|(?P<comment>\#[^\n]*)|(?P<nl>\r?\n)|"
    r'''(?P<long>"""(?:[^\\"]|\\(?:[btnfr"\\e]|u[\da-fA-F]{4}|U[\da-fA-F]{8}|x[\da-fA-F]{2}|[ \t]*\r?\n)|"{1,2}(?!"))*"{3,5}|\'\'\'(?:[^']|'{1,2}(?!'))*'{3,5})|(?P<str>"(?:[^"\\\n\x00-\x08\x0a-\x1f]|\\(?:[btnfr"\\e]|u[\da-fA-F]{4}|U[\da-fA-F]{8}|x[\da-fA-F]{2}))*"|'[^'\n]*')|'''
    r"(?P<word>[A-Za-z0-9_+:-]+(?:\.[A-Za-z0-9_+:-]+)*(?: \d\d:[\d:.Zz+-]+)?)|(?P<op>[=,.])|(?P<open>[{\[])|(?P<close>[}\]])"
)
_TOML_NUMBER = re.compile(r"[+-]?(?:0|[1-9](?:_?\d)*)(?:\.\d(?:_?\d)*)?(?:[eE][+-]?\d(?:_?\d)*)?|0x[\da-fA-F](?:_?[\da-fA-F])*|0o[0-7](?:_?[0-7])*|0b[01](?:_?[01])*|[+-]?(?:inf|nan)")
_TOML_DATE = re.compile(r"\d{4}-\d\d-\d\d(?:[Tt ]\d\d:\d\d(?::\d\d(?:\.\d+)?)?(?:[Zz]|[+-]\d\d:\d\d)?)?|\d\d:\d\d(?::\d\d(?:\.\d+)?)?")
_TOML_BARE = re.compile(r"[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+)*")


class _Keys:
    """The keys of a TOML text: each value and table may be defined once."""

    def __init__(self) -> None:
        self.seen: list[tuple[str, str]] = []
        self.top: dict = {}
        self.at = self.top
        #: tables by identity: of a header, of a dotted key, or closed (inline)
        self.headed: set[int] = set()
        self.dotted: set[int] = set()
        self.closed: set[int] = set()
        self.kept: list[dict] = []

    def line(self) -> bool:
        """Takes in the line that was read; False if it defines what is there."""
        line, self.seen = self.seen, []
        if not line:
            return True
        if line[0][1] == "[":
            many = len(line) > 1 and line[1][1] == "["
            return self._header(_key(line[2 if many else 1 : -2 if many else -1]), many)
        return self._pair(self.at, line)

    def _down(self, into: dict, name: str) -> dict | None:
        got = into.setdefault(name, self._table())
        if isinstance(got, list):
            got = got[-1] if got else None
        return None if not isinstance(got, dict) or id(got) in self.closed else got

    def _table(self) -> dict:
        self.kept.append({})
        return self.kept[-1]

    def _header(self, path: list[str], many: bool) -> bool:
        into: dict | None = self.top
        for name in path[:-1]:
            into = self._down(into, name)
            if into is None:
                return False
        last = path[-1]
        if many:
            got = into.setdefault(last, [])
            if not isinstance(got, list):
                return False
            got.append(self._table())
            self.at = got[-1]
            return True
        got = into.setdefault(last, self._table())
        if not isinstance(got, dict) or id(got) in self.headed | self.dotted | self.closed:
            return False
        self.headed.add(id(got))
        self.at = got
        return True

    def _pair(self, into: dict | None, line: list[tuple[str, str]]) -> bool:
        eq = next((k for k, x in enumerate(line) if x == ("op", "=")), None)
        if eq is None:
            return True
        path = _key(line[:eq])
        for name in path[:-1]:
            fresh = name not in into
            into = self._down(into, name)
            if into is None or not fresh and id(into) in self.headed:
                return False
            self.dotted.add(id(into))
        if path[-1] in into:
            return False
        into[path[-1]] = self._value(line[eq + 1 :])
        return into[path[-1]] is not None

    def _value(self, tokens: list[tuple[str, str]]) -> object:
        """True for a plain value, a closed table for an inline one; None if that has a key twice."""
        if tokens[:1] and tokens[0][1] in ("{", "["):
            table, part, depth = self._table(), [], 0
            for t in [*tokens[1:-1], ("op", ",")]:
                depth += (t[0] == "open") - (t[0] == "close")
                if t == ("op", ",") and not depth:
                    if part and (not self._pair(table, part) if tokens[0][1] == "{" else self._value(part) is None):
                        return None
                    part = []
                else:
                    part.append(t)
            self.closed.add(id(table))
            return table if tokens[0][1] == "{" else True
        return True


def _key(tokens: list[tuple[str, str]]) -> list[str]:
    """The names of a dotted key."""
    out: list[str] = []
    for kind, t in tokens:
        if kind == "word":
            out += [x for x in t.split(".") if x]
        elif kind == "str":
            out.append(re.sub(r"\\u([\da-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), t[1:-1]) if t[0] == '"' else t[1:-1])
    return out or [""]


class Toml(Folder):
    """TOML: one key or table header a line."""

    rules, words = grammars.TOML, ()

    def roles(self, kind: str, content: str) -> set[str]:
        if kind == "[":
            can = {"Arr"} if not content or self.items(content)[0:1] != [""] and self.each("Item", content) else set()
            if self.grammar.accepts("Key", content):
                can.add("Header1")
            if len(content) == 1 and "Header1" in self.tokens.of(content):
                can.add("Header2")
            return can
        if content and content[-1] == self.comma:
            return set()
        return {"Table"} if self.each("Pair", content) else set()

    def valid(self, text: str) -> bool:
        stack: list[tuple[str, list[str]]] = []
        out: list[str] = []
        keys = _Keys()
        at = 0
        try:
            while at <= len(text):
                m = _TOML_TOKEN.match(text, at) if at < len(text) else None
                if m is None and at < len(text):
                    return False
                kind = m.lastgroup if m else "nl"
                at = m.end() if m else at + 1
                if m and kind not in ("ws", "comment", "nl"):
                    keys.seen.append((kind, m.group()))
                if kind == "nl":
                    if stack and stack[-1][0] == "[":
                        continue
                    if stack or not self._statement("".join(out)) or not keys.line():
                        return False
                    out = []
                elif kind == "open":
                    stack.append((m.group(), out))
                    out = []
                elif kind == "close":
                    if not stack or stack[-1][0] != _PAIRS[m.group()]:
                        return False
                    opened, outer = stack.pop()
                    outer.append(self.fold(opened, "".join(out)))
                    out = outer
                elif kind in ("str", "long"):
                    out.append(self.one(kind.upper()))
                elif kind == "op":
                    out.append(self.one(m.group()))
                elif kind == "word":
                    w = m.group()
                    can = {"BOOL"} if w in ("true", "false") else set()
                    can |= {"NUM"} if _TOML_NUMBER.fullmatch(w) else {"DATE"} if _TOML_DATE.fullmatch(w) else set()
                    if not can and not _TOML_BARE.fullmatch(w.strip(".")):
                        return False
                    out.append(self.one("BARE", *can) if _TOML_BARE.fullmatch(w.strip(".")) else self.one(*can))
        except Rejected:
            return False
        return not stack

    def _statement(self, line: str) -> bool:
        if not line:
            return True
        if len(line) == 1 and not {"Header1", "Header2"}.isdisjoint(self.tokens.of(line)):
            return True
        return self.grammar.accepts("Pair", line)


#: Extensions that are judged, the language that is reported for them, and their dialects.
LANGUAGES = {
    "py": "python", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript", "ts": "typescript", "tsx": "typescript",
    "json": "json", "toml": "toml",
}


@lru_cache(maxsize=None)
def parser(ext: str):  # noqa: ANN201
    """The parser of an extension, made once in a Python worker (dialects of scripts and modules run in one)."""
    if ext in ("js", "mjs", "cjs"):
        return _script(False, False)
    if ext in ("jsx", "ts", "tsx"):
        return _script(ext[:2] == "ts", ext.endswith("x"))
    return {"py": Python, "json": Json, "toml": Toml}[ext]()


@lru_cache(maxsize=None)
def _script(typed: bool, jsx: bool) -> Script:
    return Script(typed, jsx)


def invalid(ext: str, text: str) -> bool:
    """Whether the text is not valid in the language of its extension. Empty text is valid code (but no JSON)."""
    if not text and ext != "json":
        return False
    limit = sys.getrecursionlimit()
    try:
        sys.setrecursionlimit(_DEPTH)
        return not parser(ext).valid(text)
    finally:
        sys.setrecursionlimit(limit)


def judged(files: DataFrame, file_text: DataFrame) -> DataFrame:
    """(file_id, repo, language, ok): every file of a judged extension with text.

    Null texts, other extensions and files without a path are left out; a file that is listed twice is judged once.
    Texts are shuffled once, to meet their paths, and parsed whole where they lie.
    """
    ext = F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1))
    known = files.groupBy("file_id").agg(F.min(F.struct("path", "repo")).alias("f")).select("file_id", "f.path", "f.repo")
    known = known.select("file_id", "repo", ext.alias("ext")).where(F.col("ext").isin(list(LANGUAGES)))
    texts = file_text.select("file_id", "content").where("file_id is not null and content is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [not invalid(e, t) for e, t in zip(b.column("ext").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("repo"), b.column("ext"), pa.array(ok, pa.bool_())], names=["file_id", "repo", "ext", "ok"])

    got = texts.join(known, "file_id").select("file_id", "repo", "ext", "content").mapInArrow(run, "file_id long, repo string, ext string, ok boolean")
    language = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[F.col("ext")]
    return got.select("file_id", "repo", language.alias("language"), "ok")


def rates(judged_files: DataFrame) -> DataFrame:
    """Per repository and language: files, invalid ones, and their share."""
    return judged_files.groupBy("repo", "language").agg(
        F.count(F.lit(1)).alias("files"), F.count_if(~F.col("ok")).alias("invalid"), F.avg((~F.col("ok")).cast("double")).alias("rate")
    )
