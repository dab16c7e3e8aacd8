"""Generated, minified, vendored and data files among source records (problem 2).

One pass over the whole texts.  A multi-pattern automaton (Aho-Corasick) finds the words of generation and
vendoring notices anywhere in a text; a hit counts when its line is a notice by form and stands where a file speaks
about itself: in the header (comments, however long, and declarations of package, imports and type before the first
line of other code) or after the last line of code.  A file that only talks about such things stays.  Path rules cover vendored
and generated folders, lock files and the suffixes of generated and minified files.

Strong signs decide alone: notices, unambiguous paths, dense long lines, opaque data.  Weak signs decide only with a
second one: stamped lines with a table of numbers or a folder like ``gen``; an ambiguous folder like ``external`` with a banner of
name and version, with a declared package of the project it is named after, or with the name of a project that some record of the
collection has in an unambiguous place (``node_modules``, ``vendor``, ..., a notice of a copy).  For the last, the few candidates are joined with the names found by the same pass.  Lines of one
form alone - constants, accessors, assertions - are no evidence.

``kind`` is the first that applies of: generated, third_party (by notice), generated, minified, third_party (by path), minified,
data, generated (by form).

Defined results: a null path or language is no evidence; null and empty texts are judged by path alone; repeated
rows are judged each; a null id is left out; extra columns are ignored; empty tables give empty results.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gneiss import runtime

_VERB = r"(?:generated|produced|emitted|created|written|compiled|translated|transpiled)"
_HOW = r"(?:auto(?:matically)?|mechanically|machine|programmatically)"
_FILE = r"(?:file|code|class|module|source|header|document)"
#: (words looked for by the automaton, form of the line without its comment marks, kind), all lower case.
NOTICES = [
    (["@generated"], r"@(?:[\w.]+\.)?generated\b", "generated"),
    (["generated", "written", "produced", "created"], rf"<?{_HOW}[- ]?{_VERB}\b", "generated"),
    (["generated", "emitted"], rf"(?:this )?(?:{_FILE} )?(?:generated|emitted) (?:{_HOW} )?(?:by|from|with|using|on)\b", "generated"),
    (["mechanically", "automatically"], rf"{_VERB} (?:mechanically|automatically)\b", "generated"),
    (["generated", "produced", "emitted"], rf"(?:this|the following) {_FILE} (?:is|was|has been) (?:{_HOW} )?(?:generated|produced|emitted)\b", "generated"),
    (["automatically", "mechanically", "machine"], rf"(?:this|the following) {_FILE} (?:is|was|has been) (?:{_HOW}[- ]{_VERB}|{_VERB} {_HOW})\b", "generated"),
    (["this file from", "this code from"], rf"\S+ (?:generated|produced|emitted|created|wrote) this {_FILE} from\b", "generated"),
    (["overwritten", "be lost", "discarded"], r"(?:any |all |local )?(?:(?:manual |hand |local )?(?:changes|edits|modifications)\b.*) (?:lost|overwritten|discarded)\b", "generated"),
    (["do not edit", "do not modify"], r"do not (?:edit|modify)(?: this file| by hand| manually| directly)*\s*(?:[.!;:,*-]|$)", "generated"),
    (["regenerate"], r"(?:source: \S+[;,.] *)?re-?generate (?:with|using|by running|from)\b", "generated"),
    (["line "], r"line \d+ \"[^\"]+\"$", "generated"),
    (["end of "], r"end of (?:auto-?generated\b|generated\b|\S+ output\b)", "generated"),
    (["vendored", "bundled", "embedded", "third-party", "third party"], r"(?:vendored|bundled|embedded|third[- ]party) (?:third[- ]party )?(?:copy|code|source|version|library|component|notice)\b", "third_party"),
    (["taken", "copied", "imported", "extracted"], r"(?:taken|copied|imported|extracted)(?: verbatim| unchanged| unmodified| as is)* from (?:the )?\S+.*\b(?:project|release|tag|version|upstream|v?\d+\.\d+)", "third_party"),
    (["upstream:"], r"upstream: \S+@v?\d", "third_party"),
    (["third-party", "third party"], r"(?:\(c\)|copyright|©).*\bthird[- ]party\b", "third_party"),
]
#: What may stand before a notice: a byte-order mark, white space, comment marks.
COMMENT = r"[﻿\s]*(?:/\*+!?|\*+|//+!?|#+!?|--+|;+|<!--|\"\"\"|''')?[\s*]*"
#: Lines that name the place in a source from which a tool made what follows.
LINE_MARK = re.compile(r"^[ \t]*(?:#|//)[ \t]?line[ \t]+\d+[ \t]+\"[^\"\n]+\"", re.M)

VENDORED_PATH = re.compile(r"(^|/)(vendor|vendored|third_party|thirdparty|third-party|3rdparty|node_modules|bower_components|jspm_packages|godeps/_workspace|pods|carthage|site-packages|dist-packages)/(?P<name>[^/]*)", re.I)
#: Folders that hold third-party copies in some projects and own code in others.
MAYBE_VENDORED_PATH = re.compile(r"(?:.*/|^)(?:external|externals|extern|ext|deps|contrib|imported)/(?P<name>[^/]+)/", re.I)
#: A hand-written project may have its own package of such a name below its source root.
SOURCE_ROOT = re.compile(r"(^|/)(src|packages|crates|internal|lib|docs)/", re.I)
#: Version at the end of a folder name.
VERSION = re.compile(r"-v?\d+\.\d+[\w.]*$")
GENERATED_PATH = re.compile(r"(^|/)(generated-sources|generated-src|build/generated|__generated__)/|[._](pb|pb2|pb2_grpc|g|designer|generated)\.\w+$", re.I)
MAYBE_GENERATED_PATH = re.compile(r"(^|/)(gen|generated|autogen)/|[._-](gen|autogen)\.\w+$", re.I)
LOCK_FILE = re.compile(r"(^|/)(package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.yaml|go\.sum)$|\.lock$", re.I)
MINIFIED_PATH = re.compile(r"[.-]min\.(js|mjs|cjs|css|ts)$", re.I)
BUNDLE_PATH = re.compile(r"[.-]bundle\.(js|mjs|cjs|css|ts)$", re.I)
PROSE_PATH = re.compile(r"\.(md|markdown|rst|txt)$", re.I)

#: Lines that a header may hold besides comments.
_DECLARATION = re.compile(r"\s*(?:package|import|from|use|using|namespace|module|extern crate|#!|#\s*(?:include|pragma|define|ifndef)|<\?|@\w|['\"]use strict|(?:(?:export|default|public|private|protected|internal|final|abstract|static|sealed|open|pub|data)\s+)*(?:class|interface|struct|object|enum|trait|impl|record|type)\b|$)")
_LINE_COMMENT = re.compile(r"\s*(?://|#(?!\s*(?:include|define|pragma|if))|--|;|\*|%)")
_BANNER = re.compile(r"[\W_]*([a-z][\w.-]+)[ @]v?\d+\.\d+(?:\.\d+)*\b", re.I)

#: The project that a notice of a copy names.
_ORIGIN = re.compile(r"(?:\b(?:copy of|from)(?: the)?|upstream:|\(c\) \d+)\s+([\w-]+)")
_PACKAGE = re.compile(r"^\s*(?:package|namespace)\s+([\w.]+)", re.M)

_IDENT = re.compile(r"[^\W\d][\w$]*")
_NUMBER = re.compile(r"-?\b(0x[0-9a-fA-F]+|\d[\d_.]*\w*)")
_SEPARATE = re.compile(r"[^\s\w$]")
_DENSE = re.compile(r"[A-Za-z0-9+/=_\-:;|,]{40,}")
#: A literal without meaning to a reader - a number, or a string of 12 or more characters with digits - or any quoted string.
_OPAQUE = r"(?:-?(?:0x[0-9a-f]+|\d[\d_.]*(?:e[-+]?\d+)?)|[\"'](?=[a-z+/=]*\d)[a-z0-9+/=]{12,}[\"'])"
_LITERAL = rf"(?:{_OPAQUE}|[\"'][^\"']*[\"']|true|false|null|none|nil)"
#: A line of literals with at least one opaque one.
DATA_LINE = re.compile(rf"(?=.*{_OPAQUE})[\[({{]*\s*{_LITERAL}(?:\s*[:,=]>?\s*{_LITERAL})*\s*[\])}}]*[,;]?", re.I)
#: A line that only opens or closes a literal, with the name it is assigned to.
BRACKET_LINE = re.compile(r"(?:[\w\s.:$*&<>]+:?=\s*)?[\[\](){};,\s]+")
KEYWORDS = frozenset("public private static final return int void def self class override object set get import from if else for while this const let var string long byte function fun val case goto".split())


@lru_cache(maxsize=1)
def _automaton() -> tuple[ahocorasick.Automaton, list[re.Pattern]]:
    words: dict[str, list[int]] = {}
    for i, (own, _, _) in enumerate(NOTICES):
        for word in own:
            words.setdefault(word, []).append(i)
    found = ahocorasick.Automaton()
    for word, numbers in words.items():
        found.add_word(word, (len(word), numbers))
    found.make_automaton()
    return found, [re.compile(COMMENT + form) for _, form, _ in NOTICES]


def edges(text: str) -> tuple[int, int]:
    """End of the header and start of the trailer: where the first line of code begins and the last one ends."""
    at, inside = 0, ""
    header = trailer = len(text)
    first = True
    while at < len(text):
        stop = text.find("\n", at)
        stop = len(text) if stop < 0 else stop
        line = text[at:stop].strip("﻿ \t\r")
        if inside:
            if inside in line:
                inside = ""
        elif line.startswith("/*") or line.startswith("<!--") or (first and line.startswith(('"""', "'''"))):
            close = "*/" if line[0] == "/" else "-->" if line[0] == "<" else line[:3]
            if close not in line[2:]:
                inside = close
            elif line.split(close, 1)[1].strip() and close != line[:3]:
                header = at + (stop - at)  # code follows on the line of the comment
                break
        elif not (_LINE_COMMENT.match(line) or _DECLARATION.match(line)):
            header = at
            break
        if line:
            first = False
        at = stop + 1
    end = len(text.rstrip())
    while end > header:
        begin = text.rfind("\n", 0, end) + 1
        line = text[begin:end].strip()
        if line and not _LINE_COMMENT.match(line) and not line.startswith(("/*", "<!--")):
            break
        trailer = begin
        end = begin - 1 if begin else 0
    return header, trailer


def notice(text: str) -> tuple[str | None, str | None]:
    """The kind of the first notice by form and the project that it names, if any."""
    automaton, forms = _automaton()
    low = text.lower()
    if len(low) != len(text):  # a few letters change their length
        text = low
    limits: tuple[int, int] | None = None
    for end, (length, numbers) in automaton.iter(low):
        if limits is None:
            limits = edges(text)
        if limits[0] <= end < limits[1]:
            continue
        begin = low.rfind("\n", 0, end + 1 - length) + 1
        stop = low.find("\n", end)
        line = low[begin : stop if stop >= 0 else len(low)].rstrip()
        for i in numbers:
            if forms[i].match(line):
                named = _ORIGIN.search(line) if NOTICES[i][2] == "third_party" else None
                return NOTICES[i][2], named[1] if named else None
    marks = LINE_MARK.finditer(low)
    return ("generated" if next(marks, None) and next(marks, None) else None), None


def line_form(line: str) -> str:
    """A line with identifiers and numbers blanked, keywords kept: equal for lines stamped from one template."""
    return _NUMBER.sub("0", _IDENT.sub(lambda m: m[0].lower() if m[0].lower() in KEYWORDS else "a", line)).strip()


def stamped(lines: list[str]) -> float:
    """Share of the code lines that have one of the three commonest forms (of four lines or more)."""
    forms = Counter(line_form(x) for x in lines)
    body = sum(n for f, n in forms.items() if f and f.strip("(){}[];,") and f != "end")
    top = [(f, n) for f, n in forms.most_common(8) if f.strip("(){}[];,") and len(f) > 3][:3]
    repeated = sum(n for _, n in top if n >= 4)
    return repeated / body if body else 0.0


def code_lines(text: str) -> list[str]:
    lines = [x.strip() for x in text.splitlines() if x.strip()]
    return [x for x in lines if not x.startswith(("//", "#", "*", "/*", "<!--", "package ", "import ", "from ", "use "))]


def dense(text: str) -> str | None:
    """minified, or data, for texts of long dense lines and encoded blobs."""
    lines = [x for x in text.splitlines() if x.strip()]
    if not lines:
        return None
    size = sum(map(len, lines))
    code = [x for x in lines if not x.lstrip().startswith(("//", "#", "*", "/*", "<!--"))] or lines
    long_lines = [x for x in code if len(x) > 200]
    if sum(len(m[0]) for m in _DENSE.finditer(text)) > 0.7 * size:
        return "data"
    if sum(map(len, long_lines)) > 0.6 * max(1, sum(map(len, code))) and max(map(len, code)) > 250:
        joined = "".join(long_lines)
        if joined.count(" ") < 0.12 * len(joined) and len(_SEPARATE.findall(joined)) > 0.12 * len(joined):
            return "minified"
        if sum(map(str.isdigit, joined)) > 0.3 * len(joined):
            return "data"
    return None


def formed(text: str) -> str | None:
    """data for texts whose lines are opaque literals for the most part, generated for tables of numbers with stamped lines."""
    code = [x for x in code_lines(text) if not BRACKET_LINE.fullmatch(x)]
    data = [x for x in code if DATA_LINE.fullmatch(x)]
    if len(data) >= 3 and len(data) > 0.75 * len(code):
        return "data"
    if len(data) >= 3 and stamped([x for x in code if not DATA_LINE.fullmatch(x)]) > 0.6:
        return "generated"
    return None


def banner(text: str) -> str | None:
    """The name in a comment of the header that begins with a name and a version."""
    end = edges(text)[0]
    whole = re.match(r"[﻿\s]*/\*+!?\s*" + _BANNER.pattern, text[: end + 200], re.I)
    if whole:
        return whole[1].lower()
    lines = (x.lstrip("﻿") for x in text[:end].splitlines())
    return next((m[1].lower() for x in lines if _LINE_COMMENT.match(x) and (m := _BANNER.match(x))), None)


def project_of(folder: str) -> str | None:
    """The project that a folder of third-party copies is named after; None for a file, or a folder of any sources."""
    name = VERSION.sub("", folder).lower()
    return None if not name or SOURCE_ROOT.search(name + "/") or re.search(r"\.\w{1,4}$", name) else name


def own_package(path: str, folder: re.Match, text: str) -> bool:
    """Whether a file outside of any source root declares a package of the project that its folder is named after."""
    name = project_of(folder["name"])
    found = _PACKAGE.search(text)
    return bool(name and found and name in found[1].lower().split(".") and not SOURCE_ROOT.search(path[: folder.start("name")]))


def path_kind(path: str | None) -> str | None:
    """What an unambiguous path alone shows."""
    path = path or ""
    if GENERATED_PATH.search(path) or LOCK_FILE.search(path):
        return "generated"
    if MINIFIED_PATH.search(path):
        return "minified"
    folder = VENDORED_PATH.search(path)
    return "third_party" if folder and not SOURCE_ROOT.search(path[: folder.start() + 1]) else None


def judge(path: str | None, text: str | None, language: str | None = None) -> tuple[str | None, str | None, str | None]:
    """(kind, name of an outside project that the path shows, name that would make it third_party if it is one)."""
    path, text = path or "", text or ""
    folder = VENDORED_PATH.search(path)
    sure = folder is not None and not SOURCE_ROOT.search(path[: folder.start() + 1])
    maybe = MAYBE_VENDORED_PATH.match(path)
    kind, named = notice(text)
    kind = kind or path_kind(path)
    if kind is None and maybe and (VERSION.search(maybe["name"]) or banner(text) or own_package(path, maybe, text)):
        kind = "third_party"
    if kind is None and not ((language or "").strip().lower() in ("markdown", "md") or PROSE_PATH.search(path)):
        kind = dense(text) or formed(text)
        if kind is None and MAYBE_GENERATED_PATH.search(path) and stamped(code_lines(text)) > 0.5:
            kind = "generated"
        if kind is None and BUNDLE_PATH.search(path) and len(text) > 150 * (text.count("\n") + 1):
            kind = "minified"
    outside = project_of(folder["name"]) if sure else named or (banner(text) if kind in ("minified", "third_party") else None)
    return kind, outside, project_of(maybe["name"]) if kind is None and maybe else None


def classify(path: str | None, text: str | None, language: str | None = None, outside: frozenset[str] = frozenset()) -> str | None:
    """generated, minified, third_party, data, or None for hand-written; ``outside`` names known outside projects."""
    kind, _, name = judge(path, text, language)
    return kind or ("third_party" if name in outside else None)


def not_handwritten(docs: DataFrame, id_col: str = "doc_id", path_col: str = "relative_path", text_col: str = "content", language_col: str = "language") -> DataFrame:
    """(doc_id, kind) of every record that is, as a whole, not hand-written here."""
    runtime.text_batches(docs.sparkSession)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, path, text, language = (batch.column(k).to_pylist() for k in range(4))
            rows = [(i, *judge(*x)) for i, *x in zip(ids, path, text, language, strict=True)]
            columns = list(zip(*(r for r in rows if any(r[1:])), strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.string()) for c in columns[1:])], names=["doc_id", "kind", "outside", "maybe"])

    chosen = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(path_col).cast("string"), F.col(text_col).cast("string"), F.col(language_col).cast("string"))
    found = runtime.materialise(chosen.mapInArrow(find, "doc_id long, kind string, outside string, maybe string"), "kinds")
    names = found.filter("outside <> ''").select(F.col("outside").alias("maybe")).distinct()
    named = runtime.join_salted(found.filter("maybe is not null").select("doc_id", "maybe"), names, ["maybe"], ["doc_id"], "left_semi").select("doc_id", F.lit("third_party").alias("kind"))
    return found.filter("kind is not null").select("doc_id", "kind").unionByName(named).distinct()


def shown_by_path(docs: DataFrame, id_col: str = "doc_id", path_col: str = "relative_path") -> DataFrame:
    """(doc_id, kind) of every record whose path alone shows what it is."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.array(map(path_kind, batch.column(1).to_pylist()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), kinds], names=["doc_id", "kind"]).filter(kinds.is_valid())

    chosen = docs.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long"), F.col(path_col).cast("string"))
    return chosen.mapInArrow(find, "doc_id long, kind string").distinct()
