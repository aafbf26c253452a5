"""Files that nobody wrote by hand in their repository: tool-made files, minified scripts, third-party copies, data.

Third-party copies are found with Merkle hashes over each repository's tree: definitions are the leaves below a file,
files the nodes below their folders, folders the nodes above. What hashes alike in unrelated repositories was copied;
a local change alters one leaf only. Tool-made files, minified scripts and data are told by their headers and layout.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.common import lookup_join, materialize, norm_path

#: Least size of a file that counts, of a leaf (in characters), and the share of a file that must lie in shared leaves.
LEAST_BYTES, LEAF_CHARS, SHARED = 200, 60, 0.5
CODE = ("py", "js", "mjs", "cjs", "jsx", "ts", "tsx")
# How tools and third parties sign, at the start of a comment line in a file's first or last lines.
TOOL = re.compile(
    r"^\W*(?:@generated\b|<auto-?generated\b|code generated by\b.*\bdo not (?:edit|modify)|(?:this file was |this file is )?(?:produced|generated|created|written) "
    r"automatically\b|auto-?generated (?:file|by|from)\b|machine-(?:written|generated) by\b|this file (?:is|was) (?:auto-?)?generated\b|"
    r"do not (?:modify|edit) by hand\b|(?:created|generated|built|compiled) from \S+ (?:on each build|by)\b|generated by the protocol buffer compiler|[#@] ?sourceMappingURL=)",
    re.I,
)
THIRD = re.compile(
    r"^\W*(?:@?[\w./-]+ v\d+\.\d+(?:\.\d+)?\S* \| \(c\)|[\w.-]+ v?\d+\.\d+(?:\.\d+)?\S*,? upstream release|this is [\w.-]+ v?\d+\.\d+\S*,? copied from|"
    r"licen[cs]ed under the terms in the licen[cs]e file of [\w.-]+ v?\d+\.\d+|vendored from\b|[\w.-]+ v\d+\.\d+\.\d+ \(https?://)",
    re.I,
)
# Folders that hold other people's packages, each in a folder of its own.
HOLDERS = ("vendor", "_vendor", "third_party", "third-party", "thirdparty", "3p", "external", "extern", "deps", "node_modules", "bower_components", "site-packages")
LOCKS = re.compile(r"(?:^|[-_./])(?:package-lock|npm-shrinkwrap|yarn|poetry|Pipfile|composer|Cargo|pnpm-lock|[\w-]+-lock|[\w-]+\.lock)(?:\.(?:json|lock|ya?ml))?$", re.I)
_COMMENT = re.compile(r"^\s*(?:#|//|/?\*|<!--|;|--)")
_STRING = re.compile(r""""(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\[\s\S])*`""")
_START = re.compile(r"^(?:@|(?:export |default |async |abstract |public |private |static )*(?:def|class|function|interface|type|enum|const|let|var)\b|(?:async )?[\w$]+\s*\([^;]*\{$)")
_TRANSPILED = re.compile(r"^Object\.defineProperty\(exports, ['\"]__esModule['\"]|^/\*{6}/ |__webpack_require__")
_NUMBER = re.compile(r"\d+")
_LITERALS = re.compile(r"[\d.,\s\[\](){}\"+;-]+|[A-Za-z0-9+/=]{50,}|\bb(?=\")")
_WORD = re.compile(r"[A-Za-z_$][\w$]*")


def leaves(text: str, least: int = LEAF_CHARS) -> list[tuple[int, int]]:
    """(hash, length) of the definitions of a source text, without comments, blank lines and indentation.

    A definition begins at a line of its own that names one, at the outer two levels of indentation. Those under
    ``least`` characters are left out.
    """
    out: list[tuple[int, int]] = []
    part: list[str] = []

    def close() -> None:
        n = sum(map(len, part))
        if n >= least:
            h = xxhash.xxh64_intdigest("\n".join(part))
            out.append((h - (1 << 64) if h >> 63 else h, n))
        part.clear()

    for line in text.replace("\r", "\n").split("\n"):
        s = line.strip()
        if not s or _COMMENT.match(s) and not s.startswith("#private"):
            continue
        if part and len(line) - len(line.lstrip()) <= 4 and _START.match(s):
            close()
        part.append(s)
    close()
    return out


def _signed(lines: list[str], pattern: re.Pattern) -> bool:
    """Whether a comment line at the top, in the leading comment block however long, or in the last lines has the signature."""
    top = max(12, next((k for k, x in enumerate(lines) if not _COMMENT.match(x)), len(lines)))
    return any(_COMMENT.match(x) and pattern.search(x) for x in (*lines[:top], *lines[-4:]))


def _stepping(lines: list[str]) -> bool:
    """A layout that only a tool writes: most lines are numbered, one after another."""
    steps = numbered = 0
    last = None
    for x in lines:
        m = _NUMBER.search(x)
        if not m:
            continue
        n = int(m.group()[:9])
        if last is not None and n - last in (0, 1):
            numbered += 1
            steps += n != last
        last = n
    return steps >= 5 and numbered >= 0.5 * len(lines)


def _uniform(lines: list[str]) -> bool:
    """Nearly all lines have one of a few shapes."""
    if len(lines) < 8:
        return False
    shapes = Counter(_WORD.sub("x", re.sub(r"\d+", "0", _STRING.sub("s", x))) for x in lines)
    return sum(n for _, n in shapes.most_common(4) if n > 2) >= 0.85 * len(lines)


def layout(ext: str, text: str) -> str | None:
    """minified, data or generated, by the layout of a source text; null for a normal one."""
    lines = [x for x in text.replace("\r", "\n").split("\n") if x.strip()]
    code = [x for x in lines if not _COMMENT.match(x)]
    if not code:
        return None
    size = sum(map(len, code))
    masked = _STRING.sub('""', "\n".join(code))
    bare = masked.split("\n")
    long_ = sum(len(x) for x in bare if len(x) > 250)
    if ext != "py" and long_ > 0.5 * len(masked) or (long_ > 0.8 * len(masked) and len(masked) > 600):
        blanks = masked.count(" ") + masked.count("\n")
        words = sum(map(len, _WORD.findall(masked)))
        if blanks < 0.12 * len(masked) and words > 0.25 * len(masked):
            return "minified"
    # data: little but literals (numbers, strings, brackets) or rows of values
    words = sum(len(w) for w in _WORD.findall(masked))
    quoted = size - len(masked) + 2 * masked.count('""')
    digits = sum(map(len, re.findall(r"[-+]?\d[\d.eE_-]*", masked)))
    if size >= LEAST_BYTES and text.lstrip()[:1] != "<":
        if words <= 0.08 * size or (words <= 0.12 * size and digits + quoted > 0.6 * size and len(code) < 6):
            return "data"
        if text.lstrip()[:1] in "[{" and quoted + digits > 0.3 * size and not re.search(r"[;=(]", masked):
            return "data"
        marks = Counter(x.count(",") for x in lines)
        commas, n = marks.most_common(1)[0]
        if commas >= 2 and n >= 0.9 * len(lines) and len(lines) >= 5 and not any(c in masked for c in "(){};=") :
            return "data"
        if len(code) >= 4 and sum(not _LITERALS.sub("", x) for x in bare) >= 0.75 * len(bare):
            return "data"
    if _stepping(code) and (digits + quoted > 0.5 * size or _uniform(code)):
        return "generated"
    return "generated" if ext != "py" and any(_TRANSPILED.search(x) for x in code[:5]) else None


def told(ext: str, path: str, text: str) -> str | None:
    """Why a file is not hand-written as far as it tells itself: lock, generated, third-party, minified, data; or null."""
    if len(text.encode("utf-8", "replace")) < LEAST_BYTES:
        return None
    name = path.rsplit("/", 1)[-1]
    if ext in ("json", "yaml", "yml", "toml", "lock"):
        keys = text.count('"integrity"') + text.count("checksum") + text.count('"resolved"')
        return "lock" if keys >= 3 and (LOCKS.search(name) or re.search(r'"lock(?:file)?Version"', text)) else None
    if ext not in CODE:
        return None
    lines = [x for x in text.replace("\r", "\n").split("\n") if x.strip()]
    if _signed(lines, TOOL):
        return "generated"
    if _signed(lines, THIRD):
        return "third-party"
    return layout(ext, text)


def files_read(files: DataFrame, file_text: DataFrame) -> DataFrame:
    """(file_id, repo, path, why, size, leaves, node, judged): what each file tells about itself, its leaves, and its hash.

    The hash is made of all definitions, however short; null for files without any. Files of LEAST_BYTES are judged.

    A file that is listed twice is read once; files without text, id or path are left out. Texts meet their paths in
    one shuffle and are read whole.
    """
    listed = files.where("file_id is not null").groupBy("file_id").agg(F.min(F.struct(norm_path("path").alias("path"), "repo")).alias("f"))
    listed = listed.select("file_id", "f.repo", "f.path").where("path is not null and repo is not null")
    texts = file_text.select("file_id", "content").where("file_id is not null and content is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            why, size, found, node, judged = [], [], [], [], []
            for path, text in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                ext = path.rsplit(".", 1)[-1].lower()
                why.append(told(ext, path, text))
                every = leaves(text, 1) if ext in CODE else []
                got = [x for x in every if x[1] >= LEAF_CHARS] if len(text) >= LEAST_BYTES else []
                h = xxhash.xxh64_intdigest(repr(sorted(h for h, _ in every)))
                node.append((h - (1 << 64) if h >> 63 else h) if every else None)
                found.append([{"h": h, "n": n} for h, n in got])
                size.append(sum(n for _, n in got))
                judged.append(len(text.encode("utf-8", "replace")) >= LEAST_BYTES)
            kinds = (pa.string(), pa.int64(), pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int32())])), pa.int64(), pa.bool_())
            made = [pa.array(x, t) for x, t in zip((why, size, found, node, judged), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("repo"), b.column("path"), *made], names=["file_id", "repo", "path", "why", "size", "leaves", "node", "judged"])

    schema = "file_id long, repo string, path string, why string, size long, leaves array<struct<h:long,n:int>>, node long, judged boolean"
    return texts.join(listed, "file_id").select("file_id", "repo", "path", "content").mapInArrow(run, schema)


def shared_share(read: DataFrame) -> DataFrame:
    """(file_id, shared): length of each file's leaves that also occur in another repository.

    A leaf is reduced to the least and greatest repository map side, so one that all files have is one row of each task.
    """
    leaf = read.select("file_id", "repo", F.explode("leaves").alias("leaf")).select("file_id", "repo", "leaf.h", "leaf.n")
    many = leaf.groupBy("h").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a != b").select("h")
    return lookup_join(leaf.drop("repo"), many, ["h"], "left_semi").groupBy("file_id").agg(F.sum("n").alias("shared"))


def packages(read: DataFrame, proven: DataFrame) -> DataFrame:
    """(package): folder names below a holder folder of which most files, in several repositories, are proven (file_id) copies."""
    held = _held(read.where("size > 0")).join(proven.select("file_id").distinct().withColumn("proof", F.lit(True)), "file_id", "left")
    home = F.when(F.col("proof"), F.col("repo"))
    least = F.count("proof") * 2 >= F.count(F.lit(1))
    return held.groupBy("package").agg(F.min(home).alias("a"), F.max(home).alias("b"), least.alias("most")).where("most and a != b").select("package")


def _held(read: DataFrame) -> DataFrame:
    name = F.regexp_extract("path", rf"(?:^|/)(?:{'|'.join(map(re.escape, HOLDERS))})/([^/]+)/", 1)
    return read.withColumn("package", name).where("package != ''")


def not_hand_written(files: DataFrame, file_text: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """(file_id, why): the files that nobody wrote by hand in their repository.

    Repositories count as unrelated, but for those that ``families`` (repo, family) puts together, as forks are: what
    only they share is no copy.

    Files and folders whose nodes hash alike in several repositories, with all below them, are third-party, and so are
    files of which shared leaves make up at least half, and the files of a package that is proven so in several
    repositories. Files under LEAST_BYTES, hand-written configuration, and text of another language are not judged.
    Empty tables give no rows.
    """
    read = files_read(files, file_text).withColumn("home", F.col("repo"))
    if families is not None:
        kin = families.groupBy("repo").agg(F.min("family").alias("family"))
        read = read.join(kin, "repo", "left").withColumn("repo", F.coalesce("family", "repo")).drop("family")
    read = materialize(read, "read")
    shared = shared_share(read.where("size > 0"))
    copied = read.select("file_id", "size").join(shared, "file_id").where(F.col("shared") >= SHARED * F.col("size"))
    copied = materialize(copied.select("file_id").unionByName(below_shared(read)).distinct(), "copied")
    own = read.where("why is not null").select("file_id", "why")
    known = packages(read, copied.unionByName(own.where("why = 'third-party'").select("file_id")))
    held = _held(read).where("size > 0").join(known, "package", "left_semi")
    third = copied.unionByName(held.select("file_id")).withColumn("why", F.lit("third-party"))
    return own.unionByName(third).groupBy("file_id").agg(F.min("why").alias("why"))


def folder_nodes(read: DataFrame) -> DataFrame:
    """(home, repo, path, hash, n): the folders of each repository ``home`` with their hashes and numbers of files.

    Hashes go bottom-up, one level of folders per round: a folder's hash is made of its children's hashes in no order,
    added up map side. Names are left out, so a renamed copy is alike too.
    """
    node = file_nodes(read)
    deepest = node.agg(F.max("depth")).first()[0] or 0
    folders, below = None, None
    for depth in range(deepest, 0, -1):
        level = node.where(F.col("depth") == depth).drop("depth")
        level = level if below is None else level.unionByName(below)
        child = F.xxhash64("hash")
        sums = [F.bit_xor(child).alias("x"), F.try_sum(F.shiftright(child, 20)).alias("s"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")]
        up = level.groupBy("home", "repo", F.regexp_replace("path", r"(?:^|/)[^/]+$", "").alias("path")).agg(*sums).where("path != ''")
        below = materialize(up.select("home", "repo", "path", F.xxhash64("x", "s", "k").alias("hash"), "n"), f"level{depth}")
        folders = below if folders is None else folders.unionByName(below)
    return node.drop("depth").limit(0) if folders is None else folders


def file_nodes(read: DataFrame) -> DataFrame:
    """(home, repo, path, hash, n, depth): the files that have definitions, as nodes above these."""
    node = read.where("node is not null").groupBy("home", "path").agg(F.min("repo").alias("repo"), F.min("node").alias("hash"))
    node = node.select("home", "repo", "path", "hash", F.lit(1).cast("long").alias("n"), (F.size(F.split("path", "/")) - 1).alias("depth"))
    return materialize(node, "nodes")


def alike(nodes: DataFrame) -> DataFrame:
    """(hash): nodes that hash alike in unrelated repositories. Each task sends one row per hash."""
    return nodes.groupBy("hash").agg(F.min("repo").alias("a"), F.max("repo").alias("b")).where("a != b").select("hash")


def below_shared(read: DataFrame) -> DataFrame:
    """(file_id): files of LEAST_BYTES and more that hash alike in unrelated repositories, or lie below a folder of several files that does."""
    judged = read.where("judged and node is not null")
    files = judged.select("file_id", "repo", F.col("node").alias("hash"))
    same = lookup_join(files, alike(files), ["hash"], "left_semi").select("file_id")
    folders = folder_nodes(read).where("n > 1")
    whole = lookup_join(folders.select("home", "path", "hash"), alike(folders), ["hash"], "left_semi").select("home", F.col("path").alias("folder"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    inside = judged.where("path like '%/%'").select("file_id", "home", F.explode(above).alias("folder"))
    return same.unionByName(lookup_join(inside, whole, ["home", "folder"], "left_semi").select("file_id")).distinct()


def shared_subtrees(files: DataFrame, file_text: DataFrame) -> DataFrame:
    """(hash, level, nodes, repositories, files, example): subtrees that hash alike in several repositories.

    A file of LEAST_BYTES and more is a subtree of definitions; folders of two files and more count.
    """
    read = materialize(files_read(files, file_text).withColumn("home", F.col("repo")), "read")
    single = read.where("judged and node is not null").select("repo", "path", F.col("node").alias("hash"), F.lit(1).cast("long").alias("n"), F.lit("file").alias("level"))
    nodes = single.unionByName(folder_nodes(read).where("n > 1").select("repo", "path", "hash", "n", F.lit("folder").alias("level")))
    found = nodes.groupBy("level", "hash").agg(
        F.count(F.lit(1)).alias("nodes"), F.min("repo").alias("a"), F.max("repo").alias("b"), F.count_distinct("repo").alias("repositories"), F.max("n").alias("files"), F.min("path").alias("example")
    )
    return found.where("a != b").drop("a", "b")
