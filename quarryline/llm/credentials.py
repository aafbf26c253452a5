"""Credentials embedded in source code, configuration and prose: finding them and masking them in place.

Configuration formats are parsed into key paths with the byte offsets of their values; code and prose are searched for
assignments, defaults, headers and calls. A value counts by the names on its path and by its shape; well-known token
forms, logins in URLs and private key blocks count under any name. Masks are spliced into the original bytes, so
everything around them stays as it was.

Texts are handled as their UTF-8 bytes, one character for each byte, so that offsets are those of the original.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]
MASK = "[REDACTED]"

# Forms of issued tokens.
ISSUED = (
    r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20}|xox[abeprs]-[A-Za-z0-9-]{12,}|"
    r"sk-(?:or-v1-|proj-|ant-)?[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|"
    r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"
)
# Words of names that hold secrets, as written without separators.
NAMES = (
    r"password|passwort|passwd|passphrase|pwd|secret|apikey|accesskey|deploykey|privatekey|signingkey|encryptionkey|accountkey|"
    r"authtoken|accesstoken|servicetoken|refreshtoken|sessiontoken|bearertoken|bottoken|apitoken|deploytoken|credential|"
    r"adminpass|dbpass|userpass|smtppass|rootpass"
)
# What stands in place of a secret.
STAND_IN = (
    r"^<.*>$|\$\{|\$\(|^\$[A-Za-z_]|^%[A-Za-z_(]|\{\{|^[xX]+$|^[*.•_-]+$|^\[.*\]$|EXAMPLE|"
    r"(?<![A-Za-z])(?i:change-?_?me|your[-_ ]\w+|example|placeholder|redacted|dummy|set-me|replace|todo|fixme|goes-here)(?![A-Za-z])|"
    r"^(?i:vault|env|ssm|kms|op|secret|ref|file|keyring)[:/]|^(?i:none|null|nil|true|false|undefined|unset|empty)$|"
    r"process\.env|os\.environ|getenv|^(?i:password|passwd|pass|pwd|pw|secret|token)$"
)
_ISSUED = re.compile(rf"(?<![A-Za-z0-9_])(?:{ISSUED})")
_NAME = re.compile(NAMES)
_ENDS_SECRET = re.compile(rf"(?:{NAMES})(?:dev|prod|old|new|test|v)?$")
_STAND_IN = re.compile(STAND_IN)
_WORDY = re.compile(r"[a-z]+(?:_[a-z]+)+|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)+|[A-Za-z]?[a-z]{2,}(?:[A-Z][a-z]{2,})+|[A-Za-z]+\([^)]*\)")
_PEM = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----((?:\s|\\n|\\r|[\"'+#/*>]|[A-Za-z0-9=-]+: .*\n)*[A-Za-z0-9+/=\s\\]{40,})")
_URL = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s:/@'\"`<>]*:([^\s/@'\"`]+)@[\w\[]")
_HOOK = re.compile(r"https?://[^\s'\"`]*?/(?:hooks?|services|webhooks?)/((?:[A-Za-z0-9_-]{6,}/)+[A-Za-z0-9_-]{16,})")
_HEADER = re.compile(r"\b(?:Bearer|Basic|Token)\s+([A-Za-z0-9+/=_.~-]{10,})")
_QUOTED = r"""(?:"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)"""
#: A name, as it stands before an assignment; what leads from it to a literal; a further piece of the same value.
_LEFT = re.compile(r"""(?P<q>["'`]?)(?P<name>[A-Za-z_$][\w$.-]*)(?P=q)\]?\s*(?=[:=])""")
_ASSIGN = re.compile(
    rf"""(?::\s*(?:str|string|String|bytes)\s*=|:=|=>|=|:)\s*"""
    rf"""(?:(?:os\.environ\.get|os\.getenv|getenv|env|process\.env\.get|config|get)\(\s*{_QUOTED}\s*,\s*|(?:[\w.$]+\s*(?:\|\||\?\?|\bor\b)|(?:[\w$]+\.)*(?:b64decode|atob|fromhex|from)\()\s*|[({{\[]\s*)?"""
    rf"""[bru]?(?P<value>{_QUOTED})"""
)
_MORE = re.compile(rf"\s*\+?\s*(?:\\\n\s*)?[bru]?({_QUOTED})")
_CALL = re.compile(rf"\b(?:connect|login|log_in|authenticate|auth|sign_in|signIn)\(\s*{_QUOTED}\s*,\s*{_QUOTED}\s*,\s*(?P<value>{_QUOTED})")
_SAID = re.compile(
    r"(?<![\w.$-])(?P<name>[\w-]*(?:pass|pwd|pw|secret|key|token|credential)[\w-]*)\s*(?:(?:->|=>|:=|=|:)\s*|\s+is\s+|\s+)"
    r"(?P<value>[^\s'\"`,;()]{6,})", re.I
)
_LOGIN_OPTION = re.compile(r"(?:\s-u|--user)[ =]['\"]?[\w.@-]+:([^\s'\"]+)")
# Parts of names (every name that holds a secret has one), and other marks at which a find may begin.
STEMS = ("passw", "passphrase", "pwd", "secret", "key", "token", "pass", "credential", "pw", "dsn")
MARKS = (
    "akia", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "xoxa", "xoxb", "xoxe", "xoxp", "xoxr", "xoxs", "sk-", "aiza", "npm_", "eyj",
    " -u ", " -u=", "--user", "bearer", "basic", "token ", "://", "connect(", "login(", "log_in(", "authenticate(", "auth(", "sign_in(", "signin(",
)
#: Bare names that hold a secret only where something else speaks for it.
BARE = ("pw", "pass", "key", "token")
# Names that stand for their parent's value; names that describe a secret without being one; the two of a named pair.
NEUTRAL = ("", "value", "val", "data", "default", "current", "plain", "plaintext", "text", "raw", "literal", "string")
DESCRIBING = re.compile(r"name|id|type|kind|path|file|url|uri|host|ref|algorithm|alg|digest|hash|sha|version|region|user|owner|description|policy|scope|at$|date|time|ttl|age|length|size|count|limit|public")
_HOLDS = re.compile(rf"(?:{NAMES}|token|key)s$")
_NAME_CHARS = frozenset("abcdefghijklmnopqrstuvwxyz0123456789_$-")
_AUTOMATON: list = []


def _anchors(raw: str) -> Iterator[int]:
    """Offsets at which a find may begin: at a mark, or in a name that may hold a secret. One pass over the text."""
    if not _AUTOMATON:
        made = ahocorasick.Automaton()
        for n in MARKS:
            made.add_word(n, 0)
        for n in STEMS:
            made.add_word(n, len(n))
        made.make_automaton()
        _AUTOMATON.append(made)
    low = raw.lower()
    end = -1
    for at, size in _AUTOMATON[0].iter(low):
        if not size:
            yield at
        elif at > end:
            start, end = at - size + 1, at
            while start and low[start - 1] in _NAME_CHARS:
                start -= 1
            while end + 1 < len(low) and low[end + 1] in _NAME_CHARS:
                end += 1
            bare = plain(low[start : end + 1])
            if bare in BARE or bare.endswith("dsn") or _NAME.search(bare):
                yield at


_COMMENT = re.compile(r"(?:^|\s)(?:#|//|\*|--|;)\s", re.M)


def plain(name: str) -> str:
    """A name as its bare letters: no separators, digits or case."""
    return re.sub(r"[^a-z]", "", name.lower())


def stands_in(value: str) -> bool:
    """True for placeholders and references to the environment or a vault."""
    return bool(_STAND_IN.search(value))


def strong(value: str) -> bool:
    """Shape of a made-up value: letters with digits, or mixed case with marks; not a word, path or number."""
    if len(value) < 8 or " " in value or _WORDY.fullmatch(value):
        return False
    kinds = sum(bool(re.search(k, value)) for k in (r"[a-z]", r"[A-Z]", r"[0-9]", r"[^A-Za-z0-9]"))
    if kinds >= 3:
        return True
    if re.search(r"[0-9]", value):
        return kinds == 2 and not re.fullmatch(r"[\d.,:T Z+-]+", value)
    return len(re.findall(r"[a-z][A-Z]|[A-Z]{2}[a-z]", value)) >= 3


def encoded(value: str) -> bool:
    """Base64 of printable text."""
    try:
        got = base64.b64decode(value, validate=True) if len(value) >= 12 and not len(value) % 4 else b""
    except ValueError:
        return False
    return len(got) >= 8 and all(32 <= c < 127 for c in got)


def weak(value: str) -> bool:
    """Whether a value may be a password, be it a poor one."""
    return len(value) >= 4 and not re.search(r"\s", value) and not _WORDY.fullmatch(value) and not re.fullmatch(r"-?\d{1,5}", value)


def held(name: str, value: str) -> bool:
    """Whether ``value`` under ``name`` is a credential."""
    if stands_in(value) or not value.strip():
        return False
    bare = plain(name.rsplit(".", 1)[-1])
    if bare.endswith("dsn") and encoded(value):
        return True
    if bare in ("pw", "pass"):
        return strong(value)
    if not _NAME.search(bare):
        return False
    return weak(value) if _ENDS_SECRET.search(bare) else strong(value)  # the secret word ends the name: weak values too


def held_path(path: tuple, value: str) -> bool:
    """Whether ``value`` at the end of a key path is a credential.

    The last name decides. One that only says "value", and an item of a list, take the nearest name above; below a
    name for several secrets ("credentials") any strong value counts, but for those that describe one.
    """
    names = [k for k in path if k is not None]
    while names and plain(names[-1]) in NEUTRAL:
        names.pop()
    if not names:
        return False
    if held(names[-1], value) or (len(names) < len([k for k in path if k is not None]) and held(re.sub(r"s$", "", names[-1]), value)):
        return True
    last = plain(names[-1])
    if len(names) > 1 and not DESCRIBING.search(last) and not stands_in(value) and strong(value):
        return any(_HOLDS.search(plain(k)) or _ENDS_SECRET.search(plain(k)) for k in names[:-1])
    return bool(_HOLDS.search(last)) and len(path) > len(names) and not stands_in(value) and strong(value)


Value = tuple[tuple, int, int]


def _named(values: list[Value], pairs: dict[tuple, str]) -> Iterator[Value]:
    """Values, those of a named pair ({name: X, value: Y}) under their name."""
    for path, a, b in values:
        if path and path[-1] in ("value", "Value", "VALUE") and path[:-1] in pairs:
            path = (*path[:-1], pairs[path[:-1]])
        yield path, a, b


def json_values(text: str) -> Iterator[Value]:
    """(key path, start, end) of the string values of a JSON text, tolerating errors. Items of lists are numbered by tuples."""
    return _flow(text, 0, len(text), ())


_FLOW = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|[{}\[\]:,=]|//[^\n]*|#[^\n]*|[^\s"'{}\[\]:,=#/][^\n{}\[\]:,="']*|/""")


def _flow(text: str, start: int, end: int, top: tuple) -> Iterator[Value]:
    """(key path, start, end) of the scalars of objects and lists in brackets (JSON, YAML flow, TOML inline)."""
    stack: list[list] = []  # [bracket, path, number of the item, key]
    values: list[Value] = []
    pairs: dict[tuple, str] = {}
    key: str | None = None
    for m in _FLOW.finditer(text, start, end):
        t = m.group()
        if t in "{[":
            above = (*stack[-1][1], stack[-1][3]) if stack else top
            if stack and stack[-1][0] == "[":
                above = (*stack[-1][1], (stack[-1][2],))
            stack.append([t, above, 0, None])
        elif t in "}]":
            if stack:
                stack.pop()
        elif t == ",":
            if stack:
                stack[-1][2] += 1
                stack[-1][3] = None
            key = None
        elif t in ":=":
            if stack and stack[-1][0] == "{" and stack[-1][3] is None:
                stack[-1][3] = key
        elif t[0] == "#" or t[:2] == "//":
            continue
        else:
            a, b = (m.start() + 1, m.end() - 1) if t[0] in "\"'" else (m.start(), m.start() + len(t.rstrip()))
            if stack and stack[-1][0] == "{" and stack[-1][3] is None:
                key = text[a:b]
            else:
                path = (*stack[-1][1], stack[-1][3] if stack[-1][0] == "{" else (stack[-1][2],)) if stack else top
                values.append((path, a, b))
                if path and path[-1] in ("name", "key", "Name", "Key"):
                    pairs[path[:-1]] = text[a:b]
    for path, a, b in _named(values, pairs):
        yield tuple("" if isinstance(k, tuple) else k for k in path), a, b


_SCALAR = re.compile(r"""\s*(?:"((?:[^"\\\n]|\\.)*)"|'([^'\n]*)'|([^\n]*?))(?:\s+#[^\n]*)?\s*$""")


def _scalar(text: str, start: int, end: int) -> Span:
    """The span of a plain or quoted scalar without its comment."""
    m = _SCALAR.match(text[start:end])
    if not m:
        return start, end
    k = m.lastindex or 3
    return start + m.start(k), start + m.end(k)


_YAML = re.compile(r"^([ \t]*(?:- +)*)(?:([\"']?)([\w./ -]+?)\2[ \t]*:(?:[ \t]+([^\n]*)|[ \t]*)|([^\s#-][^\n]*))$", re.M)
_LONG = re.compile(r"([|>])[+-]?\d?\s*(?:#.*)?$")


def yaml_values(text: str) -> Iterator[Value]:
    """(key path, start, end) of the scalars of a YAML text, by indentation: plain, quoted, in block and in flow form, and list items."""
    stack: list[tuple[int, object]] = []
    values: list[Value] = []
    pairs: dict[tuple, str] = {}
    items = skip = 0
    for m in _YAML.finditer(text):
        if m.start() < skip:
            continue
        depth = len(m.group(1))
        lead = m.group(1).find("-")
        while stack and stack[-1][0] >= (depth if lead < 0 else lead + (m.group(3) is None)):
            stack.pop()
        if lead >= 0:
            items += 1
            stack.append((lead, (items,)))
        if m.group(3) is None:
            if lead >= 0:
                values.append((tuple(k for _, k in stack), *_scalar(text, m.start(5), m.end(5))))
            continue
        stack.append((depth, m.group(3)))
        path = tuple(k for _, k in stack)
        said = (m.group(4) or "").strip()
        if not said or said[0] in "&*#":
            continue
        if _LONG.match(said):
            # the lines of a block are one value; it ends where the indentation does
            block = re.compile(rf"\n(?:[ \t]*(?=\n)|[ \t]{{{depth + 1},}}[^\n]*)").match
            at = m.end()
            while got := block(text, at):
                a = got.start() + len(got.group()) - len(got.group().lstrip())
                if a < got.end():
                    values.append((path, a, got.start() + len(got.group().rstrip())))
                at = got.end()
            skip = at
        elif said[0] in "{[":
            yield from _flow(text, m.start(4), m.end(4), tuple("" if isinstance(k, tuple) else k for k in path))
        else:
            a, b = _scalar(text, m.start(4), m.end(4))
            values.append((path, a, b))
            if path[-1] in ("name", "key"):
                pairs[path[:-1]] = text[a:b]
    for path, a, b in _named(values, pairs):
        yield tuple("" if isinstance(k, tuple) else k for k in path), a, b


_TOML = re.compile(r"^[ \t]*(?:\[+([^\]\n]+)\]+|([\"']?)([\w.-]+)\2[ \t]*[=:][ \t]*(\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|[^\n]*))", re.M)


def toml_values(text: str) -> Iterator[Value]:
    """(key path, start, end) of the values of a TOML or INI text, with their sections, inline tables, lists and long strings."""
    section: tuple = ()
    for m in _TOML.finditer(text):
        if m.group(1):
            section = tuple(m.group(1).split("."))
            continue
        path = (*section, *m.group(3).split("."))
        if m.group(4)[:1] in ("{", "["):
            yield from _flow(text, m.start(4), m.end(4), path)
        elif m.group(4)[:3] in ('"""', "'''"):
            yield path, m.start(4) + 3, m.end(4) - 3
        else:
            yield path, *_scalar(text, m.start(4), m.end(4))


def env_values(text: str) -> Iterator[Value]:
    """(name, start, end) of the values of a dotenv text."""
    for m in re.finditer(r"^[ \t]*(?:export[ \t]+)?([A-Za-z_][\w.]*)[ \t]*=[ \t]*([^\n]*)", text, re.M):
        yield (m.group(1),), *_scalar(text, m.start(2), m.end(2))


PARSERS = {
    "json": json_values, "yaml": yaml_values, "yml": yaml_values, "toml": toml_values, "ini": toml_values, "cfg": toml_values, "conf": toml_values,
    "properties": env_values, "env": env_values,
}


def _pieces(text: str, m: re.Match) -> tuple[str, list[Span]]:
    """A string put together from literals, however many: its value and the spans of its parts."""
    spans, end = [(m.start("value") + 1, m.end("value") - 1)], m.end("value")
    while more := _MORE.match(text, end):
        spans.append((more.start(1) + 1, more.end(1) - 1))
        end = more.end()
    return "".join(text[a:b] for a, b in spans), [s for s in spans if s[0] < s[1]]


def _in_line(text: str, start: int, end: int, kind: str, parsed: bool) -> list[tuple[int, list[Span]]]:
    """Finds that begin in one line; strings put together may go on beyond it."""
    got = [(m.start(), [m.span(1)]) for p in (_URL, _HOOK, _LOGIN_OPTION) for m in p.finditer(text, start, end) if not stands_in(m.group(1))]
    got += [(m.start(1), [m.span(1)]) for m in _HEADER.finditer(text, start, end) if not stands_in(m.group(1)) and strong(m.group(1))]
    got += [(m.start(), [m.span()]) for m in _ISSUED.finditer(text, start, end) if not stands_in(m.group())]
    if not parsed:
        for left in _LEFT.finditer(text, start, end):
            m = _ASSIGN.match(text, left.end())
            if m:
                value, spans = _pieces(text, m)
                issued = len(spans) > 1 and _ISSUED.fullmatch(value) and not stands_in(value)
                if spans and not value.startswith("-----") and (issued or held(left.group("name"), value)):
                    got.append((spans[0][0], spans))
        for m in _CALL.finditer(text, start, end):
            value, spans = _pieces(text, m)
            if spans and not stands_in(value) and len(value) >= 6:
                got.append((spans[0][0], spans))
    if kind == "" or _COMMENT.search(text, start, end):
        for m in _SAID.finditer(text, start, end):
            value = m.group("value").rstrip(".,;:)")
            name = plain(m.group("name"))
            if (name in BARE or _NAME.search(name)) and not stands_in(value) and strong(value) and (name not in ("key", "token") or re.search("[0-9]", value)):
                got.append((m.start("value"), [(m.start("value"), m.start("value") + len(value))]))
    return got


def _bytes(text: str) -> str:
    """The text's UTF-8 bytes, one character for each."""
    return text if text.isascii() else text.encode("utf-8", "surrogatepass").decode("latin-1")


def find(raw: str, kind: str = "") -> list[tuple[int, list[Span]]]:
    """The credentials of a text given as its bytes, in order: where each begins, and the spans of its parts.

    ``kind`` is the file's extension ("" for prose). A private key block begins at its first line. Of finds that
    overlap the first and longest counts.
    """
    blocks = [(m.start(), [m.span(1)]) for m in _PEM.finditer(raw)] if "PRIVATE KEY" in raw else []
    got: list[tuple[int, list[Span]]] = []
    parser = PARSERS.get(kind)
    if parser:
        for path, a, b in parser(raw):
            if a < b and held_path(path, raw[a:b]) and not raw.startswith("-----", a):
                got.append((a, [(a, b)]))
    end = -1
    for at in _anchors(raw):
        if at <= end:
            continue
        start = raw.rfind("\n", 0, at) + 1
        end = raw.find("\n", at)
        end = len(raw) if end < 0 else end
        got += _in_line(raw, start, end, kind, bool(parser))
    # a strange value within a key block is a part of that block
    got = [x for x in got if not any(a <= x[0] < spans[0][1] for a, spans in blocks)] + blocks
    got.sort(key=lambda x: (x[1][0][0], -x[1][-1][1]))
    out: list[tuple[int, list[Span]]] = []
    end = -1
    for at, spans in got:
        if spans[0][0] >= end:
            out.append((at, spans))
            end = spans[-1][1]
    return out


def lines_of(text: str, kind: str = "") -> list[int]:
    """Numbers of the lines in which a credential begins."""
    raw = _bytes(text)
    line, last, out = 1, 0, []
    for at in sorted(at for at, _ in find(raw, kind)):
        line += raw.count("\n", last, at)
        last = at
        if not out or out[-1] != line:
            out.append(line)
    return out


def masked(text: str, kind: str = "") -> str:
    """The text with every credential masked; all other bytes are as before."""
    raw = _bytes(text)
    spans = sorted(s for _, parts in find(raw, kind) for s in parts)
    if not spans:
        return text
    out, at = [], 0
    for a, b in spans:
        out += [raw[at:a], MASK]
        at = b
    return "".join([*out, raw[at:]]).encode("latin-1").decode("utf-8", "surrogatepass") if raw is not text else "".join([*out, raw[at:]])


def texts(files: DataFrame, file_text: DataFrame, memory: DataFrame) -> DataFrame:
    """(src, row_key, kind, content) of all texts.

    Null texts and null keys fall away; a file without a path is taken as prose.
    """
    code = file_text.select("file_id", "content").where("content is not null and file_id is not null")
    dotenv = F.regexp_like("path", F.lit(r"(?i)(?:^|/)\.env(?:\.[^/]*)?$"))
    ext = F.when(dotenv, "env").otherwise(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    kinds = files.groupBy("file_id").agg(F.min("path").alias("path")).select("file_id", F.coalesce(ext, F.lit("")).alias("kind"))
    code = code.join(kinds, "file_id", "left").select(
        F.lit("file_text").alias("src"), F.col("file_id").cast("string").alias("row_key"), F.coalesce("kind", F.lit("")).alias("kind"), "content"
    )
    notes = memory.select("feed_seq", "content").where("content is not null and feed_seq is not null")
    return code.unionByName(
        notes.select(F.lit("memory_rev").alias("src"), F.col("feed_seq").cast("string").alias("row_key"), F.lit("").alias("kind"), "content")
    )


def _mapped(df: DataFrame, make: Callable[[str, str], list], column: str, kind: str, arrow: pa.DataType) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            src, key, out = [], [], []
            for s, k, ext, text in zip(*(b.column(c).to_pylist() for c in ("src", "row_key", "kind", "content")), strict=True):
                for x in make(text, ext):
                    src.append(s)
                    key.append(k)
                    out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(src, pa.string()), pa.array(key, pa.string()), pa.array(out, arrow)], names=["src", "row_key", column])

    return df.mapInArrow(run, f"src string, row_key string, {column} {kind}")


def credential_lines(df: DataFrame) -> DataFrame:
    """(src, row_key, line_no): each line in which a credential begins once. Repeated texts give no repeated rows."""
    return _mapped(df, lines_of, "line_no", "int", pa.int32()).distinct()


def redacted(df: DataFrame) -> DataFrame:
    """(src, row_key, content): the texts that hold credentials, masked. Very long texts are read whole."""
    return _mapped(df, lambda t, k: [m] if (m := masked(t, k)) != t else [], "content", "string", pa.string()).distinct()
