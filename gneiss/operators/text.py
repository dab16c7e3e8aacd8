"""Text operators: tokens, full-text ranking, hash vectors, path and kind predicates."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gneiss import runtime

K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6


def _c(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def heuristic_tokens(column: Column | str) -> Column:
    """Tokens by line: matches of word runs and single other visible characters, one at least per line; '' and null have 0."""
    text = F.coalesce(_c(column), F.lit(""))
    per_line = F.transform(F.split(text, "\n", -1), lambda line: F.greatest(F.lit(1), F.size(F.regexp_extract_all(line, F.lit(r"((?U)\w+|[^\w\s])"), F.lit(0)))))
    return F.when(text == "", F.lit(0)).otherwise(F.aggregate(per_line, F.lit(0), lambda a, x: a + x))


_LETTER = r"[\p{L}\p{N}]"


def index_text(column: Column | str) -> Column:
    """Text as the full-text index sees it: lower-cased, accents folded for Latin-1 letters."""
    return F.translate(F.lower(F.coalesce(_c(column), F.lit(""))), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def index_terms(column: Column | str) -> Column:
    """Terms of the full-text index: runs of letters and digits of ``index_text``; '_' separates."""
    return F.filter(F.split(index_text(column), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def query_phrases(text: str) -> list[list[str]]:
    """Phrases of a query: split at all but letters, digits and '_'; a phrase's words are split at '_' as the index does.  Repeats stay."""
    words = [w for w in re.split(r"[^A-Za-z0-9_]+", text) if w]
    return [p for p in ([t for t in w.lower().split("_") if t] for w in words) if p]


def bm25(docs: DataFrame, id_col: str, text_cols: list[str], query: str) -> DataFrame:
    """(id, score): BM25 of the query's phrases, OR-ed; records without any hit are left out.

    One pass counts the terms of a record and the occurrences of each phrase by patterns, without building arrays; the counts
    are written once, since the corpus statistics and the scores both need them.
    """
    phrases = query_phrases(query)
    # A phrase starts where its first word stands alone and the others follow, which also counts overlapping ones.
    words = [[f"{re.escape(w)}(?!{_LETTER})" for w in p] for p in phrases]
    gap = r"[^\p{L}\p{N}]+"
    patterns = [f"(?<!{_LETTER})" + w[0] + (f"(?={gap}{gap.join(w[1:])})" if len(w) > 1 else "") for w in words]
    folded = docs.select(F.col(id_col).alias("id"), F.concat_ws(" ", *(index_text(c) for c in text_cols)).alias("t"))
    counted = folded.select("id", F.regexp_count("t", F.lit(f"{_LETTER}+")).alias("dl"), *(F.regexp_count("t", F.lit(p)).alias(f"f{i}") for i, p in enumerate(patterns)))
    counted = runtime.materialise(counted, "counts")
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *(F.sum((F.col(f"f{i}") > 0).cast("long")).alias(f"n{i}") for i in range(len(phrases))))
    hit = F.lit(False)
    score = F.lit(0.0)
    for i in range(len(phrases)):
        f = F.col(f"f{i}")
        hit = hit | (f > 0)
        idf = F.greatest(F.log((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5)), F.lit(IDF_FLOOR))
        score = score + idf * (f * (K1 + 1)) / (f + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return counted.filter(hit).crossJoin(F.broadcast(stats)).select("id", score.alias("score"))


def hash_vector(docs: DataFrame, id_col: str, text_col: str, dim: int = 128) -> DataFrame:
    """(id, idx, v): sparse deterministic hash embedding, one row per non-zero place, of unit length per record.

    A white-space token adds +1 or -1 at the place given by the first four bytes of its digest, the sign by the fifth byte.
    """
    tokens = docs.select(F.col(id_col).alias("id"), F.explode(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?U)\s+"), lambda t: t != "")).alias("t"))
    digest = tokens.select("id", F.sha1("t").alias("h"))
    place = F.pmod(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint"), F.lit(dim)).cast("int")
    sign = F.when(F.conv(F.substring("h", 9, 2), 16, 10).cast("int") % 2 == 0, 1.0).otherwise(-1.0)
    sums = digest.select("id", place.alias("idx"), sign.alias("s")).groupBy("id", "idx").agg(F.sum("s").alias("v")).filter("v <> 0")
    length = sums.groupBy("id").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("len"))
    return sums.join(length, "id").select("id", "idx", (F.col("v") / F.col("len")).alias("v"))


# File suffixes and languages that count as code.
CODE_SUFFIXES = ["c", "cc", "cpp", "cs", "cxx", "go", "h", "hh", "hpp", "java", "js", "jsx", "kt", "kts", "m", "mm", "php", "py", "rb", "rs", "scala", "swift", "ts", "tsx"]
CODE_LANGUAGES = ["c", "cpp", "csharp", "go", "java", "javascript", "js", "kotlin", "objective-c", "php", "python", "ruby", "rust", "scala", "swift", "ts", "tsx", "typescript"]
# Folders of test sources, and marks of test files in symbol ids.
TEST_FOLDERS = ["/src/test/", "/test/java/", "/test/kotlin/", "/test/scala/", "/test/resources/", "/tests/", "/__tests__/", "/it/java/", "/integration-test/", "/integration_tests/"]
TEST_SYMBOL_FOLDERS = ["/src/test/", "/test/java/", "/test/kotlin/", "/tests/", "/__tests__/", "/it/java/"]
# Words by which a query asks for tests, annotations after '@', and words of languages without blanks.
TEST_WORDS = ["junit", "testng", "mockito", "hamcrest", "assertj", "easymock", "powermock", "spock", "unit test", "unit tests", "test case", "test cases", "test suite", "test suites", "integration test", "integration tests", "mock", "stub", "fixture"]
TEST_ANNOTATIONS = ["before", "after", "beforeeach", "aftereach", "pytest"]
TEST_WORDS_CJK = ["单元测试", "单测", "测试用例", "测试类"]
_ASKS = re.compile(
    "|".join(
        [r"\b(?:" + "|".join(re.escape(w).replace(r"\ ", r"\s+") for w in TEST_WORDS) + r")\b", r"\b@(?:" + "|".join(TEST_ANNOTATIONS) + r")\b", *TEST_WORDS_CJK, r"(?<![a-z])tests?(?![a-z])"]
    ),
    re.I,
)


def is_code(path: Column | str, language: Column | str) -> Column:
    suffix = F.lower(F.regexp_extract(F.coalesce(_c(path), F.lit("")), r"\.([^./]+)$", 1))
    return suffix.isin(CODE_SUFFIXES) | F.lower(F.coalesce(_c(language), F.lit(""))).isin(CODE_LANGUAGES)


def is_test_path(path: Column | str) -> Column:
    raw = F.trim(F.coalesce(_c(path), F.lit("")))
    p = F.lower(F.regexp_replace(raw, r"\\", "/"))
    folder = F.lit(False)
    for part in TEST_FOLDERS:
        folder = folder | p.contains(part)
    base, own = F.substring_index(p, "/", -1), F.substring_index(raw, "/", -1)
    jvm = base.rlike(r"\.(java|kt)$")
    stem = F.regexp_replace(base, r"\.(java|kt)$", "")
    named = own.rlike(r"(IT|ITCase)\.java$") | stem.rlike(r"^.+tests$") | (stem.rlike(r"^.+test$") & ~stem.endswith("latest")) | stem.rlike(r"^test.+$")
    files = base.endswith("_test.go") | (base.startswith("test_") & base.endswith(".py")) | base.endswith("_test.py")
    return (p != "") & (folder | (p.startswith("test/") & ~p.contains("/src/")) | files | (jvm & named))


def is_test_symbol(symbol: Column | str) -> Column:
    sid = F.lower(F.regexp_replace(F.coalesce(_c(symbol), F.lit("")), r"\\", "/"))
    folder = F.lit(False)
    for part in TEST_SYMBOL_FOLDERS:
        folder = folder | sid.contains(part)
    tail = F.substring_index(F.substring_index(sid, "/", -1), "#", 1)
    stem = F.regexp_replace(tail, r"\.[^.]*$", "")
    return (sid != "") & (folder | ((F.length(stem) >= 5) & stem.rlike(r"(tests?$)|(^test.)")))


def asks_for_tests(query: str) -> bool:
    return bool(query.strip()) and bool(_ASKS.search(query))


def node_type(kind: Column | str) -> Column:
    """Coarse node type of a symbol kind; the order of the tests matters."""
    k = F.lower(F.coalesce(_c(kind), F.lit("")))
    return (
        F.when(k.contains("package") | (k == "module"), "package")
        .when(k.contains("annotation") | k.contains("interface"), "interface")
        .when(k.rlike("constructor|method|function"), "method")
        .when(k.rlike("field|property|constant"), "field")
        .when(k.rlike("class|enum|struct|object|type"), "class")
        .otherwise("symbol")
    )


def node_id(symbol: Column | str, kind: Column) -> Column:
    s = _c(symbol)
    prefix = F.when(kind == "package", "pkg").when(kind.isin("class", "interface"), "type").when(kind.isin("method", "field"), kind).otherwise("sym")
    return F.when((kind == "package") & s.startswith("pkg:"), s).otherwise(F.concat(prefix, F.lit(":"), s))


def is_function_kind(kind: Column | str) -> Column:
    k = F.lower(F.coalesce(_c(kind), F.lit("")))
    return k.rlike("constructor|method") | (k.contains("function") & ~k.contains("interface"))


def is_declared_kind(kind: Column | str) -> Column:
    return F.lower(F.coalesce(_c(kind), F.lit(""))).rlike("constructor|method|function|class|interface|annotation|enum|record|type|field|property|constant")


def is_container_kind(kind: Column | str) -> Column:
    return F.lower(F.coalesce(_c(kind), F.lit(""))).rlike("class|interface|enum|record|annotation")


def language_of(path: Column | str, language: Column | str) -> Column:
    """The stated language, or the one of the suffix when blank."""
    p = F.lower(F.coalesce(_c(path), F.lit("")))
    guess = F.when(p.endswith(".java"), "java").when(p.rlike(r"\.kts?$"), "kotlin").when(p.endswith(".scala"), "scala").when(p.rlike(r"\.(cc|cpp|cxx|hpp|hh|h)$"), "cpp").otherwise("")
    return F.when(F.trim(F.coalesce(_c(language), F.lit(""))) != "", _c(language)).otherwise(guess)


def path_prior(a: Column | str, b: Column | str) -> Column:
    """Leading path segments in common, a quarter each, 1 at most."""
    x, y = F.split(_c(a), "/"), F.split(_c(b), "/")
    same = F.zip_with(x, y, lambda p, q: p.eqNullSafe(q) & p.isNotNull())
    first_off = F.array_position(same, False)
    common = F.when(first_off == 0, F.least(F.size(x), F.size(y))).otherwise(first_off - 1)
    return F.least(F.lit(1.0), common / 4.0)


def intent_score(text: Column | str, query: str) -> Column:
    """2 for the whole query, 1 for each of its terms that the text contains."""
    low = F.lower(F.coalesce(_c(text), F.lit("")))
    score = F.when(low.contains(query.lower()), 2.0).otherwise(0.0)
    for term in (t for t in re.split(r"[^A-Za-z0-9_]+", query.lower()) if t):
        score = score + low.contains(term).cast("double")
    return score


def snippet(content: Column | str, line: Column | str, around: int = 8) -> Column:
    """The lines around a 0-based line, ``around`` of them to each side."""
    lines = F.split(F.coalesce(_c(content), F.lit("")), "\n", -1)
    first = F.greatest(F.lit(0), _c(line) - around)
    return F.array_join(F.slice(lines, first + 1, F.greatest(F.lit(0), _c(line) + around + 1 - first)), "\n")


def projected(content: Column | str, most: int) -> tuple[Column, Column]:
    """(code, truncated): the first ``most`` characters, and whether there are more."""
    return F.substring(_c(content), 1, most), F.length(_c(content)) > most


def intent_tags(role: Column | str, path: Column | str) -> Column:
    """The role and the first segment of the path, without blanks."""
    first = F.split(F.coalesce(_c(path), F.lit("")), "/")[0]
    return F.filter(F.array(_c(role), first), lambda t: F.trim(F.coalesce(t, F.lit(""))) != "")


def intent_quality(intent: Column | str) -> Column:
    """0.65 for a text from the template, known by 'acts as', 0.85 for any other."""
    return F.when(F.coalesce(_c(intent), F.lit("")).contains("acts as"), 0.65).otherwise(0.85)


def package_glob(package: Column | str) -> Column:
    """Glob of the sources of a package: its folders anywhere in a path."""
    return F.concat(F.lit("**/"), F.translate(F.trim(_c(package)), ".", "/"), F.lit("/**/*.java"))


def entity_pattern(kind: str, name: str) -> str:
    """Regular expression of a declaration: types by their keyword, methods by the parenthesis, anything else as a word."""
    word = re.escape(name)
    if kind in ("class", "interface", "enum", "record", "annotation"):
        return rf"\b(?:class|interface|enum|record|@interface)\s+{word}\b"
    return rf"\b{word}\s*\(" if kind in ("method", "function", "constructor") else rf"\b{word}\b"
