"""Evidence mined from source code of many repositories: (repo_id, path, content), whole files."""

from __future__ import annotations

import re
from bisect import bisect_left
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from factloom.sources.corpus import in_directory

FILE = ["repo_id", "path"]
# Language of each file extension.
LANGUAGES = {
    "ts": "typescript", "tsx": "typescript", "js": "typescript", "jsx": "typescript", "java": "java", "kt": "kotlin", "kts": "kotlin",
    "py": "python", "rb": "ruby", "go": "go", "cs": "csharp", "php": "php",
}
# Directories left out of the language census.
SKIPPED = ("node_modules", ".git", "dist", "build", "out", "target", ".gradle", ".idea", ".vscode", "__pycache__", ".mypy_cache", ".pytest_cache",
           "vendor", "bin", "obj", ".next", ".nuxt", "coverage")
# Headers of definitions that open a block.
ENUM = r"(?m)^\s*(?:export\s+|public\s+|private\s+|protected\s+|internal\s+)*enum\s+(?:class\s+)?(\w+)\s*(?:\([^)]*\)\s*)?\{([^}]*)\}"
INTERFACE = r"(?m)^\s*(?:export\s+|public\s+|private\s+|protected\s+|internal\s+|sealed\s+)*interface\s+(\w+)(?:\s+(?:extends|:)\s+[\w,\s<>]+)?\s*\{"
TYPE_ALIAS = r"(?m)^\s*(?:export\s+)?type\s+(\w+)\s*=\s*(.+?);"
CLASS = (r"(?m)^\s*(?:export\s+|public\s+|private\s+|protected\s+|internal\s+|abstract\s+|final\s+|open\s+|data\s+|sealed\s+)*class\s+(\w+)"
         r"(?:\s*(?:\(|extends|implements|:)[\w,\s<>()@]*?)?\s*\{")
MEMBERS = (r"(?m)^\s*(?:readonly\s+|val\s+|var\s+)?(\w+)\s*[?:]",
           r"(?m)^\s*(?:private|protected|public|final|static|transient|volatile)\s+(?:\w+(?:<[^>]*>)?)\s+(\w+)\s*[;=]")
FUNCTIONS = (r"(?m)^\s*(?:export\s+)?(?:async\s+)?function\s+(\w+)\s*(?:<[^>]*>)?\s*\(([^)]*)\)\s*(?::\s*[^{]+)?\s*\{",
             r"(?m)^\s*(?:export\s+)?(?:const|let)\s+(\w+)\s*=\s*(?:async\s+)?(?:\([^)]*\)|(\w+))\s*(?::\s*[^=]+)?\s*=>\s*\{",
             r"(?m)^\s*(?:(?:public|private|protected)\s+)?(?:static\s+)?(?:async\s+)?(\w+)\s*\(([^)]*)\)\s*(?::\s*[^{]+)?\s*\{")
# What the names of checks look like, in the order they are tried.
VALIDATION_NAMES = (
    r"(?i)^validate\w*", r"(?i)^check\w*", r"^is[A-Z]\w*", r"(?i)^assert\w*", r"(?i)^ensure\w*", r"(?i)^verify\w*", r"(?i)^must\w*",
    r"(?i)^require\w*", r"(?i)^canBe\w*", r"(?i)^should\w*",
)
# Words in the name of a field that holds a state, in the order they are tried.
STATE_WORDS = (
    r"(?i)\bstatus\b", r"(?i)\bstate\b", r"(?i)\bphase\b", r"(?i)\bstage\b", r"(?i)\bstep\b", r"(?i)\bmode\b", r"(?i)\btype\b", r"(?i)\bkind\b",
    r"(?i)\bcategory\b",
)
SWITCH = r"\bswitch\s*\(([^)]+)\)\s*\{"
# Annotations that state constraints or mappings.
ANNOTATIONS = ("NotNull", "NotBlank", "NotEmpty", "Size", "Min", "Max", "Pattern", "Email", "Positive", "PositiveOrZero", "Negative", "NegativeOrZero", "Past", "PastOrPresent",
               "Future", "FutureOrPresent", "DecimalMin", "DecimalMax", "Digits", "Valid", "Entity", "Table", "Column", "Id", "GeneratedValue", "Enumerated", "ManyToOne",
               "OneToMany", "ManyToMany", "OneToOne", "JoinColumn", "JoinTable", "Embeddable", "Embedded")
# Build files by priority.
BUILD_FILES = (
    ("build.gradle.kts", "Gradle (Kotlin)", 10), ("build.gradle", "Gradle (Groovy)", 9), ("pom.xml", "Maven", 8), ("package.json", "npm", 7), ("pyproject.toml", "pyproject", 6),
    ("Cargo.toml", "Cargo", 5), ("go.mod", "Go modules", 5), ("Gemfile", "Bundler", 4), ("composer.json", "Composer", 4), ("requirements.txt", "pip", 3),
)
# Score of a signal by weight, and the scores needed for each confidence.
SIGNAL_SCORES = {"strong": 3, "moderate": 2, "weak": 1}
CONFIDENCE = (("high", 5), ("medium", 3), ("low", 2))


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [text.rlike(p) for p in patterns])


def _file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def _language(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    name = _file_name(path)
    return F.when(F.contains(name, F.lit(".")), table[F.lower(F.substring_index(name, ".", -1))])


def _hidden(path: Column) -> Column:
    return path.rlike(r"(^|/)\.")


def language_census(files: DataFrame) -> DataFrame:
    """(repo_id, language, files); hidden and generated directories do not count."""
    kept = files.filter(~in_directory(F.concat(F.lit("/"), "path"), SKIPPED) & ~_hidden(F.col("path")))
    return kept.withColumn("language", _language(F.col("path"))).filter("language IS NOT NULL").groupBy("repo_id", "language").agg(F.count("*").alias("files"))


def majority_language(files: DataFrame) -> DataFrame:
    """Most frequent language per repository (equal counts: first by name), ``unknown`` where there is none."""
    top = language_census(files).groupBy("repo_id").agg(F.min_by("language", F.struct(-F.col("files"), "language")).alias("language"))
    return files.select("repo_id").distinct().join(top, "repo_id", "left").withColumn("language", F.coalesce("language", F.lit("unknown")))


def source_file_count(files: DataFrame, domain_paths: tuple[str, ...], exclude: tuple[str, ...]) -> DataFrame:
    """Source files below the domain paths, outside excluded directories (repo_id, files)."""
    below = F.lit(False)
    for p in domain_paths:
        below = below | (F.lit(True) if p == "." else F.startswith("path", F.lit(p.rstrip("/") + "/")))
    ok = below & ~in_directory(F.concat(F.lit("/"), "path"), exclude) & ~_hidden(F.col("path")) & _language(F.col("path")).isNotNull()
    return files.groupBy("repo_id").agg(F.count_if(ok).alias("files"))


def blocks(**patterns: str):
    """Arrow UDF: every match of the named headers, each ending in ``{``, with its balanced block.

    Balanced braces are beyond regular expressions, so this one step is Python; everything done with a block is column
    expressions again. A text is read once for all headers: one walk over its braces pairs them with a stack, one over
    its line ends numbers them. An unclosed block reaches to the end.
    """
    headers = {kind: re.compile(pattern, re.ASCII) for kind, pattern in patterns.items()}
    brace, line_end = re.compile(r"[{}]"), re.compile("\n")

    def one(text: str | None) -> list[dict]:
        found = [(kind, m) for kind, header in headers.items() for m in header.finditer(text or "")]
        if not found:
            return []
        closed, opened = {}, []
        for b in brace.finditer(text):
            if b.group() == "{":
                opened.append(b.start())
            elif opened:
                closed[opened.pop()] = b.start()
        ends = [m.start() for m in line_end.finditer(text)]
        rows = []
        for kind, m in found:
            end = closed.get(m.end() - 1, len(text))
            rows.append({"kind": kind, "name": m.group(1), "params": m.group(2) if m.re.groups > 1 else None, "start_line": 1 + bisect_left(ends, m.start()),
                         "end_line": 1 + bisect_left(ends, end), "body": text[m.end():end]})
        return rows

    @F.pandas_udf("array<struct<kind:string,name:string,params:string,start_line:int,end_line:int,body:string>>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return read


def _member_names(body: Column) -> Column:
    return F.array_distinct(F.concat(*[F.regexp_extract_all(body, F.lit(p), 1) for p in MEMBERS]))


def _clean_items(text: Column) -> Column:
    items = F.transform(F.split(text, ","), lambda m: F.trim(F.regexp_replace(F.substring_index(m, "=", 1), r"\s+", " ")))
    return F.filter(items, lambda m: m != "")


def type_definitions(files: DataFrame) -> DataFrame:
    """Enums, interfaces, aliases and classes with their members (repo_id, path, kind, name, members), from one reading of each file."""
    c = F.col("content")

    def plain(pattern: str, kind: str, members) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), 1).alias("name"), F.regexp_extract_all(c, F.lit(pattern), 2).alias("text"))
        return F.transform(pairs, lambda p: F.struct(F.lit(kind).alias("kind"), p["name"].alias("name"), members(p["text"]).alias("members")))

    nested = F.transform("blocks", lambda b: F.struct(b["kind"].alias("kind"), b["name"].alias("name"), _member_names(b["body"]).alias("members")))
    read = files.select(*FILE, "content", blocks(**{"interface": INTERFACE, "class": CLASS})(c).alias("blocks"))
    found = F.concat(plain(ENUM, "enum", _clean_items), nested, plain(TYPE_ALIAS, "type_alias", lambda v: F.regexp_extract_all(v, F.lit("['\"]([^'\"]+)['\"]"), 1)))
    return read.select(*FILE, F.inline(found))


# An annotation with its parameters, the header of a type, and lines that are not what an annotation stands on.
ANNOTATION = r"@(\w+)(?:\(([^)]*)\))?"
TYPE_HEADER = r"(?:class|interface|enum)\s+(\w+)"
NOT_A_TARGET = r"^(?:@|//|\*)"
NEAR = 4  # lines in which an annotation's target is looked for


def _annotated(names: tuple[str, ...]):
    """Arrow UDF: annotations of the given names in a text, each with its line, the type opened last and the next line that
    may be its target. One walk over the lines with two states (the open type, annotations still without a target), so
    nothing leaves the file's row."""
    mark, header, skipped = (re.compile(p, re.ASCII) for p in (ANNOTATION, TYPE_HEADER, NOT_A_TARGET))

    def one(text: str | None) -> list[dict]:
        rows, open_type, waiting = [], None, []
        for i, line in enumerate(text.split("\n") if text else ()):
            trimmed = line.strip(" ")
            if trimmed and not skipped.search(trimmed):
                for row in waiting:
                    row["next"] = trimmed if i - row["line"] < NEAR else None
                waiting = []
            opened = header.search(line)
            open_type = opened.group(1) if opened else open_type
            for m in mark.finditer(line):
                if m.group(1) in names:
                    rows.append({"line": i + 1, "annotation": m.group(1), "params": m.group(2) or "", "class_name": open_type, "next": None})
                    waiting.append(rows[-1])
        return rows

    @F.pandas_udf("array<struct<line:int,annotation:string,params:string,class_name:string,next:string>>")
    def read(texts: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in texts], dtype=object)

    return read


def annotations(files: DataFrame) -> DataFrame:
    """Constraint annotations with the element they stand on: (repo_id, path, line, annotation, class_name, target, target_kind, parameters)."""
    rows = files.select(*FILE, F.inline(_annotated(ANNOTATIONS)(F.col("content"))))

    def group(pattern: str) -> Column:
        found = F.regexp_extract("next", pattern, 1)
        return F.when(found != "", found)

    type_ = group(r"(?:class|interface|enum)\s+(\w+)")
    method = F.when(~F.contains("next", F.lit(";")) & ~F.contains("next", F.lit("=")), group(r"(?:fun\s+|(?:\w+\s+)+)(\w+)\s*\("))
    field = group(r"(?:val|var|private|protected|public|internal|final)\s+(?:\w+\s+)*(\w+)\s*[:;=]")
    target = F.coalesce(type_, method, field, group(r"(\w+)"), F.lit("unknown"))
    kind = F.when(type_.isNotNull(), "class").when(method.isNotNull(), "method").otherwise("field")
    pairs = F.arrays_zip(*[F.regexp_extract_all("params", F.lit(r"(\w+)\s*=\s*(\"[^\"]*\"|\d+(?:\.\d+)?|true|false|\{[^}]*\}|\w+)"), g).alias(n) for g, n in ((1, "k"), (2, "v"))])
    value = F.trim("params")
    single = value.rlike(r'^(\d+|"[^"]*"|true|false)$')
    entries = F.when(value == "", F.array().cast("array<struct<k:string,v:string>>")).when(single, F.array(F.struct(F.lit("value").alias("k"), value.alias("v")))).otherwise(pairs)
    parameters = F.transform(entries, lambda e: F.concat(e["k"], F.lit("="), F.regexp_replace(e["v"], '^"(.*)"$', "$1")))
    return rows.select(*FILE, "line", "annotation", F.coalesce("class_name", target).alias("class_name"), target.alias("target"), kind.alias("target_kind"), parameters.alias("parameters"))


def validations(files: DataFrame) -> DataFrame:
    """Functions whose names announce a check (repo_id, path, name, start_line, end_line, target_type)."""
    found = files.select(*FILE, F.inline(blocks(**{f"form{k}": p for k, p in enumerate(FUNCTIONS)})(F.col("content"))))
    target = F.regexp_extract(F.coalesce("params", F.lit("")), r"(\w+)\s*:\s*(\w+)", 2)
    return found.filter(_any(F.col("name"), VALIDATION_NAMES)).select(*FILE, "name", "start_line", "end_line", F.when(target != "", target).alias("target_type"))


def state_transitions(files: DataFrame) -> DataFrame:
    """Consecutive cases of switches on state-like fields (repo_id, path, start_line, state_field, step, from, to)."""
    field = F.regexp_extract(F.trim("name"), r"(?:\w+\.)?(\w+)(?:\(\))?$", 1)
    switches = files.select(*FILE, F.inline(blocks(switch=SWITCH)(F.col("content")))).withColumn("state_field", field).filter(_any(F.col("state_field"), STATE_WORDS))
    quoted = F.regexp_extract_all("body", F.lit(r"\bcase\s+['\"]([^'\"]+)['\"]\s*:"), 1)
    named = F.filter(F.regexp_extract_all("body", F.lit(r"\bcase\s+(?:\w+\.)?(\w+)\s*:"), 1), lambda v: v != "default")
    cases = F.when(F.size(quoted) > 0, quoted).otherwise(named)
    pairs = F.filter(F.transform("cases", lambda v, i: F.struct(v.alias("from"), F.get(F.col("cases"), i + 1).alias("to"))), lambda p: p["to"].isNotNull())
    return switches.withColumn("cases", cases).select(*FILE, "start_line", "state_field", F.posexplode(pairs).alias("step", "p")).select(*FILE, "start_line", "state_field", "step", "p.from", "p.to")


def framework_scores(files: DataFrame, languages: DataFrame, detectors: list[dict]) -> DataFrame:
    """Best-scoring framework per repository (repo_id, framework, score, confidence).

    ``detectors``: name, languages, and signals (kind path | content | dependency, pattern, weight). All signals are
    flags of one aggregate over the files; no file is paired with a signal.
    Equal scores go to the earlier detector.
    """
    build = F.col("path").isin(*[f for f, _, _ in BUILD_FILES])

    def hit(signal: dict) -> Column:
        if signal["kind"] == "path":
            return F.col("path").rlike(signal["pattern"])
        if signal["kind"] == "content":
            return F.col("content").rlike(signal["pattern"])
        return build & F.contains("content", F.lit(signal["pattern"]))

    flags, scores = [], []
    for d, detector in enumerate(detectors):
        names = [f"d{d}_{s}" for s in range(len(detector["signals"]))]
        flags += [F.max(hit(signal)).alias(n) for n, signal in zip(names, detector["signals"])]
        total = sum((F.when(F.col(n), SIGNAL_SCORES[s["weight"]]).otherwise(0) for n, s in zip(names, detector["signals"])), F.lit(0))
        scores.append(F.struct(F.lit(detector["name"]).alias("framework"), total.alias("score"), F.lit(-d).alias("order"), F.array(*[F.lit(x) for x in detector["languages"]]).alias("languages")))
    per_repo = files.groupBy("repo_id").agg(*flags).join(languages, "repo_id").select("repo_id", "language", F.inline(F.array(*scores)))
    fitting = per_repo.filter(F.array_contains("languages", F.col("language")) & (F.col("score") >= CONFIDENCE[-1][1]))
    best = fitting.groupBy("repo_id").agg(F.max_by(F.struct("framework", "score"), F.struct("score", "order")).alias("b")).select("repo_id", "b.*")
    confidence = reduce(lambda acc, c: F.when(F.col("score") >= c[1], c[0]).otherwise(acc), reversed(CONFIDENCE), F.lit(None).cast("string"))
    return best.withColumn("confidence", confidence)


# Frameworks in the order they are tried, with their languages.
FRAMEWORKS = (
    ("Spring Boot", ("java", "kotlin")), ("NestJS", ("typescript",)), ("Express", ("typescript",)), ("Django", ("python",)), ("FastAPI", ("python",)), ("Rails", ("ruby",)),
)
# Signals of each framework: kind, what is looked for, weight.
SIGNALS = (
    ("Spring Boot", "dependency", "spring-boot", "strong"),
    ("Spring Boot", "glob", "**/application.yml", "strong"),
    ("Spring Boot", "glob", "**/application.properties", "strong"),
    ("Spring Boot", "source", r"@SpringBootApplication", "moderate"),
    ("Spring Boot", "source", r"@Entity", "moderate"),
    ("Spring Boot", "source", r"@RestController", "moderate"),
    ("Spring Boot", "file", "*Controller.java", "weak"),
    ("Spring Boot", "file", "*Repository.java", "weak"),
    ("Spring Boot", "file", "*Controller.kt", "weak"),
    ("NestJS", "dependency", "@nestjs/core", "strong"),
    ("NestJS", "glob", "**/nest-cli.json", "strong"),
    ("NestJS", "source", r"@Module\s*\(", "moderate"),
    ("NestJS", "source", r"@Injectable\s*\(", "moderate"),
    ("NestJS", "source", r"@Controller\s*\(", "moderate"),
    ("NestJS", "file", "*.module.ts", "weak"),
    ("NestJS", "file", "*.service.ts", "weak"),
    ("NestJS", "file", "*.controller.ts", "weak"),
    ("Express", "dependency", '"express"', "strong"),
    ("Express", "source", r"""require\(['"]express['"]\)|from\s+['"]express['"]""", "moderate"),
    ("Express", "source", r"app\.(get|post|put|delete|patch|use)\s*\(", "moderate"),
    ("Express", "file", "*routes*", "weak"),
    ("Express", "file", "*middleware*", "weak"),
    ("Django", "glob", "manage.py", "strong"),
    ("Django", "dependency", "django", "strong"),
    ("Django", "source", r"from django\.db import models", "moderate"),
    ("Django", "glob", "**/settings.py", "moderate"),
    ("Django", "source", r"class\s+\w+\(models\.Model\)", "moderate"),
    ("Django", "file", "models.py", "weak"),
    ("Django", "file", "views.py", "weak"),
    ("Django", "file", "urls.py", "weak"),
    ("FastAPI", "dependency", "fastapi", "strong"),
    ("FastAPI", "source", r"from fastapi import", "moderate"),
    ("FastAPI", "source", r"@app\.(get|post|put|delete|patch)\s*\(", "moderate"),
    ("FastAPI", "source", r"class\s+\w+\(BaseModel\)", "moderate"),
    ("FastAPI", "dependency", "pydantic", "weak"),
    ("FastAPI", "dependency", "uvicorn", "weak"),
    ("Rails", "dependency", "rails", "strong"),
    ("Rails", "glob", "config/routes.rb", "strong"),
    ("Rails", "glob", "app/models", "moderate"),
    ("Rails", "glob", "app/controllers", "moderate"),
    ("Rails", "source", r"class\s+\w+\s*<\s*ApplicationRecord", "moderate"),
    ("Rails", "glob", "db/migrate", "weak"),
    ("Rails", "file", "Rakefile", "weak"),
)
# Directories in which sources and files are not looked for; ".venv" and ".git" are hidden anyway.
NOT_SEARCHED = ("node_modules", ".git", "dist", "build", "target", ".gradle", "vendor", "__pycache__", ".venv")
MOST_BYTES = 500_000  # larger sources are not read for signals
DEEPEST = 10


def path_pattern(kind: str, pattern: str) -> str:
    """Regular expression over a file's path: a glob may end at a directory above the file, a file name stands in any directory."""
    part = lambda p: "[^/]*".join(re.sub(r"([^\w/-])", r"[\1]", x) for x in p.split("*"))
    if kind == "file":
        return f"^(?:[^/]+/){{0,{DEEPEST}}}{part(pattern)}$"
    return "^" + "".join("(?:[^./][^/]*/)*" if p == "**" else part(p) + "/" for p in pattern.split("/"))[:-1] + "(?:/.*)?$"


def needed_literal(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern must hold; empty where it has alternatives outside brackets."""
    flat = re.sub(r"\(.*?\)[*?]?", "\0", re.sub(r"\\[()]", "\1", pattern))
    if "|" in flat:
        return ""
    flat = re.sub(r"\[[^\]]*\][*+?]?|\\[a-zA-Z][*+?]?|.[*?]", "\0", flat).replace("\\", "")
    return max(re.split("[\0\1^$+]", flat), key=len)


def signal_table(spark: SparkSession, signals=SIGNALS) -> DataFrame:
    """signal, framework, kind, pattern, literal, weight: a row per signal. literal is what the index finds: part of the source,
    of the build file, or of the path."""
    rows = []
    for k, (framework, kind, pattern, weight) in enumerate(signals):
        shown = pattern if kind in ("source", "dependency") else path_pattern(kind, pattern)
        literal = pattern if kind == "dependency" else needed_literal(pattern) if kind == "source" else max(re.split(r"[*/]", pattern), key=len)
        rows.append((k, framework, kind, re.escape(shown) if kind == "dependency" else shown, literal, SIGNAL_SCORES[weight]))
    return spark.createDataFrame(rows, "signal int, framework string, kind string, pattern string, literal string, weight int")


def signal_hits(files: DataFrame, signals: DataFrame) -> DataFrame:
    """The distinct (repo_id, signal, framework, weight) with a file that shows the signal.

    Each text is read once for the literals of all signals together; a literal found fetches its signals, and only
    those run their pattern. Signals are a short declared list (``signal_table``), so they are sent to every task and no
    text is shuffled.
    """
    searched = ~in_directory(F.concat(F.lit("/"), "path"), NOT_SEARCHED) & ~_hidden(F.col("path"))
    build = F.col("path").isin(*[f for f, _, _ in BUILD_FILES])
    depth = F.size(F.split("path", "/")) - 1
    def subject(of: str, walked: Column) -> Column:
        return F.struct(F.lit(of).alias("of"), F.col(of).alias("subject"), walked.alias("walked"), build.alias("build"))

    walked = searched & (depth <= DEEPEST)
    both = F.array(subject("path", walked), subject("content", walked & (F.octet_length("content") < MOST_BYTES)))
    subjects = files.select("repo_id", F.explode(both).alias("s")).select("repo_id", "s.*")
    literals = sorted({r.literal for r in signals.select("literal").collect() if r.literal}, key=lambda x: (-len(x), x))
    # a literal inside a longer one is found by looking ahead at every place
    index = "(?=(" + "|".join(map(re.escape, literals)) + "))" if literals else "(?!)"
    shorter = F.create_map(*[x for l in literals for x in (F.lit(l), F.array(*[F.lit(m) for m in literals if m in l]))]) if literals else F.create_map().cast("map<string,array<string>>")
    at = F.array_distinct(F.regexp_extract_all("subject", F.lit(index), 1))
    fetched = subjects.filter("walked OR build OR of = 'path'").withColumn("literal", F.explode(F.concat(F.array(F.lit("")), F.array_distinct(F.flatten(F.transform(at, lambda l: F.element_at(shorter, l)))))))
    rows = fetched.join(F.broadcast(signals), "literal")
    fits = (
        ((F.col("kind") == "source") & (F.col("of") == "content") & F.col("walked")) | ((F.col("kind") == "dependency") & (F.col("of") == "content") & F.col("build"))
        | ((F.col("kind") == "file") & (F.col("of") == "path") & F.col("walked")) | ((F.col("kind") == "glob") & (F.col("of") == "path")))
    return rows.filter(fits).filter(F.expr("subject RLIKE pattern")).select("repo_id", "signal", "framework", "weight").distinct()


def framework_signals(files: DataFrame, languages: DataFrame, signals: DataFrame, frameworks=FRAMEWORKS) -> DataFrame:
    """Scores of the frameworks that fit a repository's language and show enough (repo_id, framework, score, confidence, best).

    best marks the one to choose: the highest score, equal scores by the order of the frameworks."""
    spark = files.sparkSession
    listed = spark.createDataFrame([(k, name, list(spoken)) for k, (name, spoken) in enumerate(frameworks)], "place int, framework string, spoken array<string>")
    scores = signal_hits(files, signals).groupBy("repo_id", "framework").agg(F.sum("weight").alias("score"))
    fitting = scores.filter(F.col("score") >= CONFIDENCE[-1][1]).join(F.broadcast(listed), "framework").join(languages.select("repo_id", "language"), "repo_id").filter(F.array_contains("spoken", F.col("language")))
    confidence = reduce(lambda acc, c: F.when(F.col("score") >= c[1], c[0]).otherwise(acc), reversed(CONFIDENCE), F.lit(None).cast("string"))
    first = Window.partitionBy("repo_id").orderBy(F.desc("score"), "place")  # a repository has a row per framework at most
    return fitting.select("repo_id", "framework", "score", confidence.alias("confidence"), (F.row_number().over(first) == 1).alias("best"))


def build_system(files: DataFrame) -> DataFrame:
    """Build system of each repository by the most telling file at its root (repo_id, build_system, build_file)."""
    table = F.create_map(*[x for i, (f, name, priority) in enumerate(BUILD_FILES) for x in (F.lit(f), F.struct(F.lit(priority).alias("priority"), F.lit(-i).alias("order"), F.lit(name).alias("build_system")))])
    known = files.withColumn("b", table[F.col("path")]).filter("b IS NOT NULL")
    return known.groupBy("repo_id").agg(F.max_by(F.struct(F.col("b.build_system"), F.col("path").alias("build_file")), F.struct("b.priority", "b.order")).alias("x")).select("repo_id", "x.*")
