"""Column expressions over text and paths; all of them stay in the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Forms of secrets, in the order in which they are replaced.
REDACTIONS = (
    r"sk-or-v1-[A-Za-z0-9]{16,}",
    r"sk-[A-Za-z0-9]{16,}",
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{20,}",
    r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"(?s)-----BEGIN [A-Z ]*PRIVATE KEY-----.*?-----END [A-Z ]*PRIVATE KEY-----",
    r"(?i)\b(api[_-]?key|secret|token|password|bearer)\b\s*[:=]\s*['\"]?[A-Za-z0-9_\-/+=]{8,}['\"]?",
)
MASK = "[REDACTED]"
# Languages by extension.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(c: Column | str) -> Column:
    """Words of a text in lower case: letters and digits of any script; marks, underscores and white space separate."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def phrase_text(c: Column | str) -> Column:
    """The words with single spaces between and around them, for ``has_phrase``."""
    return F.concat(F.lit(" "), F.array_join(tokens(c), " "), F.lit(" "))


def has_phrase(c: Column | str, phrase: str) -> Column:
    """Whether the text holds the words of the phrase side by side; a phrase without words is in no text."""
    ws = re.findall(r"[^\W_]+", phrase.lower())
    return F.contains(phrase_text(c), F.lit(f" {' '.join(ws)} ")) if ws else F.lit(False)


def token_estimate(c: Column | str) -> Column:
    """Tokens by length: a quarter of the characters, rounded up."""
    return F.floor((F.length(_col(c)) + 3) / 4)


def redacted(c: Column | str) -> Column:
    """The text with everything that looks like a secret masked."""
    out = _col(c)
    for pattern in REDACTIONS:
        out = F.regexp_replace(out, pattern, MASK)
    return out


def scope_id(c: Column | str) -> Column:
    """Identifier of a scope from a path: lower case, other characters than letters and digits as single marks."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}-]", "-"), F.lit("-"))


def title_name(c: Column | str) -> Column:
    """Every run of letters with a capital first (also after digits and marks), the rest in lower case."""
    parts = F.regexp_extract_all(_col(c), F.lit(r"\p{L}+|[^\p{L}]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def content_hash(c: Column | str) -> Column:
    """``sha256:`` and the digest of bytes or text."""
    return F.concat(F.lit("sha256:"), F.sha2(_col(c), 256))


def symbol_id(path: Column | str, qualified: Column | str, kind: Column | str) -> Column:
    """Identifier of a symbol: the first 16 digits of the digest of path, qualified name and kind."""
    return F.substring(F.sha1(F.concat_ws(":", _col(path), _col(qualified), _col(kind))), 1, 16)


def language_of(path: Column | str) -> Column:
    """Language by extension, null for others."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    return table[F.lower(F.regexp_extract(_col(path), r"(\.[^./]+)$", 1))]


def glob_pattern(glob: str) -> str:
    """Regular expression of a path glob: ``**/`` any folders, ``**`` anything, ``*`` and ``?`` within a name."""
    out, at = "", 0
    for m in re.finditer(r"\*\*/|\*\*|\*|\?", glob):
        out += re.escape(glob[at : m.start()]) + {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}[m.group()]
        at = m.end()
    return f"^{out}{re.escape(glob[at:])}$"


def matches_globs(path: Column | str, include: list[str], exclude: list[str]) -> Column:
    """Whether a path is under an included glob and no excluded one."""
    any_of = lambda globs: _col(path).rlike("|".join(map(glob_pattern, globs))) if globs else F.lit(False)
    return any_of(include) & ~any_of(exclude)


def snippet(content: Column | str, first: Column | str, last: Column | str, most: int = 200) -> Column:
    """Lines of a text from the first to the last, no more than ``most``; a cut one says so in a line of its own."""
    n = _col(last) - _col(first) + 1
    lines = F.slice(F.split(_col(content), "\n"), F.greatest(_col(first), F.lit(1)), F.greatest(F.least(n, F.lit(most)), F.lit(0)))
    return F.concat(F.array_join(lines, "\n"), F.when(n > most, F.lit("\n... (truncated)")).otherwise(""))


def holds(c: Column | str, part: str) -> Column:
    """Whether the text holds ``part``, with the letters A to Z alike in both cases and all others as they are."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.contains(F.translate(_col(c), upper, lower), F.lit(part.translate(str.maketrans(upper, lower))))


def patch_paths(c: Column | str) -> Column:
    """Distinct paths that a patch text names (added, updated, deleted, moved to, or of a unified diff)."""
    named = F.regexp_extract_all(_col(c), F.lit(r"(?m)^\*\*\* (?:(?:Add|Update|Delete) File|Move to): (.+?)\s*$"), F.lit(1))
    old = F.regexp_extract_all(_col(c), F.lit(r"(?m)^diff --git a/(\S+) b/\S+"), F.lit(1))
    new = F.regexp_extract_all(_col(c), F.lit(r"(?m)^diff --git a/\S+ b/(\S+)"), F.lit(1))
    return F.array_distinct(F.concat(named, old, new))


def tool_path(args: Column | str) -> Column:
    """The path among a tool's JSON arguments: the first of filePath, file_path and path."""
    return F.coalesce(*[F.get_json_object(_col(args), f"$.{k}") for k in ("filePath", "file_path", "path")])


def embedded_json(c: Column | str) -> Column:
    """The JSON object in a text: the text itself, else from its first to its last brace; null if that is none."""
    inner = F.regexp_extract(_col(c), r"(?s)(\{.*\})", 1)
    return F.when(F.get_json_object(inner, "$").isNotNull(), inner)


def status_paths(porcelain: Column | str) -> Column:
    """Changed paths of a NUL-separated status listing; of a rename the new path counts, the old one is skipped."""
    parts = F.filter(F.split(_col(porcelain), "\\x00"), lambda x: x != "")
    is_entry = lambda x: x.rlike(r"^[ MADRCU?!]{2} ")
    after_rename = lambda x, i: (i > 0) & F.get(parts, i - 1).rlike(r"^(?:R.|.R|C.|.C) ")
    kept = F.filter(parts, lambda x, i: is_entry(x) & ~F.coalesce(after_rename(x, i), F.lit(False)))
    return F.transform(kept, lambda x: F.substr(x, F.lit(4)))


def utc_stamp(c: Column | str) -> Column:
    """Time of an ISO-8601 text in UTC; null where it has no or another zone."""
    return F.when(_col(c).rlike(r"(?:Z|\+00:00)$"), F.try_to_timestamp(_col(c)))
