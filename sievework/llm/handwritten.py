"""Problem 2: generated, minified, vendored source files and data saved as code.

Two kinds of evidence. Rules on a file's header (its full-line comments) weigh what it says about how the file was
made and where it is from; rules on its layout measure how much of it is long dense lines, literals, or lines that are the
same but for names and values. And Merkle hashes, computed bottom-up over each repository's directory tree, find
whole directories that unrelated repositories share. All texts are read once, where they lie; per chunk only a few
numbers are shuffled, and they are added up per file.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize

#: Share of a file's characters in dense lines and literals that decides alone; and with repeated lines, each character of prose outweighing PROSE of theirs.
BLOCK, UNIFORM, PROSE = 0.42, 0.45, 4
#: Characters of a dense line; times that a line's shape must recur.
LONG_LINE, TIMES = 150, 5
# What a header line may say, as regular expressions over one lower-cased comment line without its marks. No phrase is
# listed whole: a file is judged by how many kinds of statement stand together.
_FILE = r"(?<![\w-])[\w-]++\.(?!com\b|org\b|net\b|io\b)[a-z]\w{0,9}(?:\.\w{1,9})?\b"
_VERSION = r"\bv?\d+\.\d+(?:\.\d+)*(?:[-+]\w+)?\b"
_HASH = r"\b(?=[0-9a-f]*\d)[0-9a-f]{7,40}\b"
#: Statements about how a file came to be.
MAKING = {
    "made": r"generat(?:ed|or)|autogen|g[ée]n[ée]r[ée]|generad|gerad[oa]|erzeugt|generiert|生成|\b(?:machine|tool|computer)[- ]?(?:made|built|written|produced)"
    r"|\b(?:produced|emitted|compiled|transpiled|rendered) (?:by|from)\b|\boutput of\b",
    "stated": r"^@?(?:(?:this|the) )?(?:(?:file|code|source|module|script|header|document) )?(?:(?:was|is|has been) )?(?:automatically |auto-?|machine-?)?(?:generated|produced|emitted) (?:automatically )?(?:by|from|with|using)\b",
    "automatic": r"\bauto|\bautomat|自动|\bmachine[- ]",
    "source": rf"{_FILE}|{_VERSION}|\b\d{{4}}-\d{{1,2}}-\d{{1,2}}\b|\b(?:compiler|code ?gen\w*|generator|schema tool|preprocessor)\b",
    "hands_off": r"(?:do not|don't|never|must not|please no|nicht|ne pas|n[ãa]o|请勿|勿|不要)\W*(?:be )?(?:edit\w*|modif\w*|change\w*|alter\w*|touch\w*|von hand|手工|手动|修改|编辑)"
    r"(?:\W*(?:by hand|manually|this file|it|directly|à la main|ändern|修改))*\W*(?:$|[.;,:!—-])",
    "lost": r"(?:change|edit|modification)s?\b.{0,30}\b(?:lost|overwritten|discarded|undone|clobbered)|\boverwritten\b|überschrieben|écras|覆盖",
    "again": r"\bre-?generate\b|\bre-?run\b|\bedit (?:that|the) (?:file|template|source|schema)\b.{0,20}instead|\bneu erzeugen|重新生成",
}
#: Statements about where a file is from.
ORIGIN = {
    "taken": r"\bsync(?:ed|hroni[sz]ed)\b|\bmirror(?:ed)?\b|\bvendored\b|\bcop(?:y|ied)\b|\bimported\b|\btaken from\b|\bpulled from\b|\bported\b|\bback-?ported\b|\bfork(?:ed)?\b|\bsnapshot\b|\bbundled?\b"
    r"|\bamalgamat\w+|\bsingle[- ]file\b|\bshipped\b|\bdistributed with\b|\bborrowed from\b|\badapted from\b|\brelease\b",
    "revision": rf"{_VERSION}|{_HASH}",
    "others": r"\bupstream\b|\bthe [\w-]+ (?:authors|maintainers|contributors|developers)\b|\b(?:original )?authors?:|\bauthors of\b|\bcontributors\b|\band others\b|\bits authors\b",
    "licence": r"\blicen[cs]ed? (?:under|[\w.+-]+$|[\w.+-]+ style)|^@?licen[cs]e\b|\breleased under\b|\bspdx-|^@preserve\b|licen[cs]e:",
    "place": r"\b(?:third[-_ ]?party|vendor|external|node_modules|deps|extern)/",
    "state": r"\bunchanged\b|\bverbatim\b|\bunmodified\b|\bas (?:shipped|is|released)\b|\bpatches\b.{0,20}(?:applied|here|none|local)|\blocal (?:changes|modifications|patches|copy)\b|\bin (?:step|sync) with\b|\bhow to (?:update|upgrade)\b|\breport bugs to\b|\bdo not patch\b",
    "banner": rf"^!?\s*@?[a-z][\w.-]*(?: js| lib)?,? (?:version )?{_VERSION}\W*$",
}
#: A line that tells of something past, or of generated or copied things other than this file, says nothing about it.
ELSEWHERE = re.compile(
    r"\bremoved\b|\brewritten\b|\bfrom scratch\b|\breplac|\bno longer\b|\bskipped\b|\bignored?\b|\bold\b|\bused to\b|\binstead of\b|\bunlike\b|\bnot (?:generated|copied|vendored)\b|\b(?:is|are|were) checked\b"
    r"|\b(?:the|a|an|these|those|our|any|all|some) (?:\S+ )?(?:auto-?\s?)?generated\b(?! (?:by|from|with|using|on|file|code|automatically)\b)"
)
_MAKING, _ORIGIN = ({k: re.compile(v) for k, v in t.items()} for t in (MAKING, ORIGIN))
#: Names that only compilers and bundlers write into code.
TOOL_MARKS = re.compile(r"_interopRequire(?:Default|Wildcard)|__webpack_require__|__pyx_\w|\b_regeneratorRuntime\b|\byy(?:table|translate|defact)\b|\bSWIGTYPE_|_descriptor\.FileDescriptor\b")
#: Lines that are judged together.
TOGETHER = 4
#: What a text must hold anywhere for its comments to be read.
ANY = re.compile(
    r"gener|génér|gerad|erzeugt|生成|machine|autogen|tool[- ]|produced|emitted|compiled|transpiled|rendered|created|built|derived|output of|edit|modif|hand|touch|overwrit|lost|ändern|手|覆盖"
    r"|sync|mirror|vendor|cop(?:y|ied)|import|taken|pulled|port|fork|snapshot|bundle|amalgam|single|shipped|distribut|borrow|adapted|release|upstream|author|maintain|contribut|licen|preserve|spdx|third|patches|verbatim|unchanged|unmodified|v?\d\.\d"
)
SOURCE_MAP = re.compile(r"^\s*//[#@]\s*sourceMappingURL=", re.M)

_COMMENT = re.compile(r"^\s*(?://+!?|#+!?|/\*+!?|\*+/?|--+|;+|\"\"\"|''')\s?(.*)$")
_TAIL = re.compile(r"\s*(?:\*/|\"\"\"|''')\s*$")
_TRAILING = re.compile(r"(?:\s//|\s#)\s[^'\"]*$")
_NAMES = re.compile(r"'[^']*'|\"[^\"]*\"|[^\W\d]\w*|-?\d[\w.]*")
_LISTS = re.compile(r"a(?:\s*,\s*-?a)+")
_LITERAL = re.compile(r"\\x[0-9a-fA-F]{2}|0x[0-9a-fA-F]+|-?\b\d[\d.]*|'[A-Za-z0-9+/=_-]{24,}'|\"[A-Za-z0-9+/=_-]{24,}\"|^[A-Za-z0-9+/=]{40,}\\?$")
_PROSE = re.compile(r"(?<!\w)[^\W\d_]+'?,?(?: [^\W_]+[',]?){5,}|[\u4e00-\u9fff\uff00-\uffef\u3000-\u303f]{6,}")
_BLANK = re.compile(r"\s+")


def header(text: str) -> list[str]:
    """A file's full-line comments, lower-cased and without marks; edits may have moved a header from its place."""
    out, inside = [], ""
    for line in text.split("\n"):
        line = line.strip()
        if inside:
            if inside in line:
                line, inside = line.split(inside)[0], ""
            out.append(line.strip("* \t").lower())
            continue
        m = _COMMENT.match(line)
        if m:
            for mark, end in (("/*", "*/"), ('"""', '"""'), ("'''", "'''")):
                if line.startswith(mark) and end not in line[len(mark) :]:
                    inside = end
            out.append(_TAIL.sub("", m.group(1)).strip().lower())
    return out


def header_kind(text: str) -> str | None:
    """'generated' or 'vendored' if the comments say so.

    Statements of up to TOGETHER comment lines in a row are counted by kind. A file is generated if they forbid edits to
    it or say that edits get lost, or make two statements on its making, one of which is that it was made or is to be
    made again; it is vendored if they make two statements on its origin.
    """
    low = text.lower()
    if not ANY.search(low):
        return None
    said: list[tuple[set[str], set[str]]] = []
    for line in header(text):
        if not line or ELSEWHERE.search(line):
            said.append((set(), set()))
        else:
            said.append(({k for k, p in _MAKING.items() if p.search(line)}, {k for k, p in _ORIGIN.items() if p.search(line)}))
    kind = None
    for k in range(len(said)):
        near = said[k : k + TOGETHER]
        making, origin = set().union(*(m for m, _ in near)), set().union(*(o for _, o in near))
        if making & {"hands_off", "lost"} or making & {"made", "again"} and len(making) > 1:
            return "generated"
        if len(origin) > 1:
            kind = "vendored"
    return kind


def layout(text: str) -> tuple[int, int, int, int, int]:
    """Characters in all lines, in dense lines, in lines of literals, in other lines whose shape recurs, and in prose.

    A comment at the margin above an indented line is an insertion and counts for nothing.
    """
    raw = [x for x in text.split("\n") if x.strip()]
    total = dense = data = prose = 0
    shapes = []
    for i, line in enumerate(raw):
        if line[0] in "/#" and i + 1 < len(raw) and raw[i + 1][0] in " \t" and line.startswith(("//", "# ")):
            continue
        line = line.strip()
        n = len(line)
        total += n
        words = sum(map(len, _PROSE.findall(line)))
        if n >= LONG_LINE and len(_BLANK.findall(line)) < 0.12 * n and words < 0.3 * n:
            dense += n
            continue
        prose += words
        literal = sum(map(len, _LITERAL.findall(line)))
        if n >= 4 and literal >= 0.55 * (n - line.count(" ") - line.count(",")):
            data += n
        elif n < 400:
            code = _TRAILING.sub("", line)
            shapes.append((len(code), _LISTS.sub("a", _NAMES.sub("a", code))))
    counts = Counter(s for _, s in shapes)
    return total, dense, data, sum(n for n, s in shapes if n > 3 and counts[s] >= TIMES), prose


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        texts = [(t or "").replace("\r\n", "\n").replace("\r", "\n") for t in rows["text"]]
        sizes = pd.DataFrame([layout(t) for t in texts], columns=["total", "dense", "data", "repeated", "prose"], dtype="int64")
        yield pd.DataFrame(
            {
                "doc_id": rows["doc_id"].to_numpy(),
                "chunk_idx": rows["chunk_idx"].to_numpy(),
                "kind": [header_kind(t) for t in texts],
                "mapped": [bool(SOURCE_MAP.search(t) or TOOL_MARKS.search(t)) for t in texts],
                "leaf": [xxhash.xxh3_64_intdigest(_BLANK.sub(" ", t).strip().encode("utf-8", "surrogatepass")) - (1 << 63) for t in texts],
            }
        ).join(sizes)


def files(records: DataFrame) -> DataFrame:
    """One row per code document: doc_id, kind (by header), mapped, total, dense, data, repeated, prose, leaf.

    A record delivered twice counts once (of different texts under one key the one with the larger numbers). The
    header is that of the first chunk; leaf hashes the chunks in order, white space aside. Null texts are empty.
    """
    code = records.where("lower(trim(rubric_kind)) = 'code' and doc_id is not null").select("doc_id", F.coalesce("chunk_idx", F.lit(0)).cast("int").alias("chunk_idx"), "text")
    seen = code.mapInPandas(_features, "doc_id string, chunk_idx int, kind string, mapped boolean, leaf long, total long, dense long, data long, repeated long, prose long")
    once = seen.groupBy("doc_id", "chunk_idx").agg(F.max(F.struct("total", "dense", "data", "repeated", "prose", "leaf", "mapped", F.coalesce("kind", F.lit("")).alias("kind"))).alias("f")).select("doc_id", "chunk_idx", "f.*")
    sums = [F.sum(c).alias(c) for c in ("total", "dense", "data", "repeated", "prose")]
    return once.groupBy("doc_id").agg(
        F.coalesce(F.min_by("kind", F.when(F.col("kind") != "", F.col("chunk_idx"))), F.lit("")).alias("kind"), F.max("mapped").alias("mapped"), *sums, F.bit_xor(F.xxhash64("chunk_idx", "leaf")).alias("leaf")
    )


def shared_directories(tree: DataFrame, least_files: int = 2, least_repos: int = 2) -> DataFrame:
    """doc_id of the files below a directory that unrelated repositories share.

    tree: doc_id, repo, path, leaf. A directory's Merkle hash is made of its entries' names and hashes, level by level
    from the deepest up, so equal hashes mean equal subtrees, whatever the directory itself is called. Files without
    repo or path are in no tree. Directories of fewer than least_files files prove nothing. Every level is written before
    the next one is computed, so the plan doesn't grow with the depth.
    """
    entries = materialize(
        tree.where("repo is not null and path is not null").withColumn("steps", F.split("path", "/"))
        .select("repo", F.expr("array_join(slice(steps, 1, size(steps) - 1), '/')").alias("dir"), F.element_at("steps", -1).alias("name"), F.expr("size(steps) - 1").alias("depth"), F.col("leaf").alias("hash"), F.lit(1).cast("long").alias("files"))
        .groupBy("repo", "dir", "name", "depth").agg(F.min("hash").alias("hash"), F.first("files").alias("files")),
        "entries",
    )
    deepest = entries.agg(F.max("depth").alias("d")).first()["d"] or 0
    level, nodes = None, None
    for depth in range(deepest, -1, -1):
        here = entries.where(F.col("depth") == depth).drop("depth")
        if level is not None:
            up = level.withColumn("steps", F.split("dir", "/")).select(
                "repo", F.expr("array_join(slice(steps, 1, size(steps) - 1), '/')").alias("dir"), F.concat(F.element_at("steps", -1), F.lit("/")).alias("name"), "hash", "files"
            )
            here = here.unionByName(up)
        level = materialize(here.groupBy("repo", "dir").agg(F.bit_xor(F.xxhash64("name", "hash")).alias("hash"), F.sum("files").alias("files")), "level")
        nodes = level if nodes is None else nodes.unionByName(level)
    large = nodes.where(F.col("files") >= least_files)
    shared = large.groupBy("hash").agg(F.count_distinct("repo").alias("repos")).where(F.col("repos") >= least_repos)
    marked = large.join(shared, "hash").select("repo", "dir").distinct()
    below = (
        tree.where("repo is not null and path is not null").withColumn("steps", F.split("path", "/"))
        .select("doc_id", "repo", F.explode(F.expr("transform(sequence(0, size(steps) - 1), k -> array_join(slice(steps, 1, k), '/'))")).alias("dir"))
    )
    return below.join(marked, ["repo", "dir"]).select("doc_id").distinct()


def not_handwritten(records: DataFrame, pool: DataFrame) -> DataFrame:
    """doc_id and reason of each code document that is not hand-written: generated, vendored, minified or data.

    The header decides first, then a shared directory, a source map, and the layout: mostly dense lines and literals,
    or, with little prose beside them, these and lines whose shape recurs; the largest of the three names the reason.
    """
    found = materialize(files(records), "files")  # read three times
    at = pool.where("parent_doc_id is not null and url is not null").groupBy(F.col("parent_doc_id").alias("doc_id")).agg(F.min("url").alias("url"))
    tree = found.join(at, "doc_id").select("doc_id", F.expr("try_parse_url(url, 'HOST')").alias("repo"), F.expr("ltrim('/', try_parse_url(url, 'PATH'))").alias("path"), "leaf")
    shared = shared_directories(tree).withColumn("shared", F.lit(True))
    share = lambda *c: sum((F.col(x) for x in c[1:]), F.col(c[0])) / F.greatest(F.col("total"), F.lit(1))
    odd = (share("dense", "data") > BLOCK) | (share("dense", "data", "repeated") - PROSE * share("prose") > UNIFORM)
    most = F.greatest("dense", "data", "repeated")
    reason = (
        F.when(F.col("kind") != "", F.col("kind"))
        .when(F.col("shared"), "vendored")
        .when(F.col("mapped"), "minified")
        .when(odd, F.when(F.col("dense") == most, "minified").when(F.col("data") == most, "data").otherwise("generated"))
    )
    return found.join(shared, "doc_id", "left").withColumn("reason", reason).where("reason is not null").select("doc_id", "reason")
