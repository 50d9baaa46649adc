"""Quality rules: a table of thresholds compiled into one projection of counts and ratios, without user functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLANK = r"\x20\x09-\x0D"
SYMBOLS = "#*$%&|<>"
WINDOW = 8  # words of a window, a power of two
LEAST_WORDS = 20
MOST_REPEATED = 30  # per cent of the words

# Frequent words of the languages served, counted as here, with a capital and in capitals.
STOP_WORDS = (
    "a", "and", "as", "at", "for", "in", "is", "it", "of", "on", "that", "the", "this", "to", "was", "with",
    "das", "den", "der", "des", "die", "ein", "ist", "mit", "nicht", "und", "von", "zu",
    "dans", "de", "des", "est", "et", "la", "le", "les", "pour", "que", "un", "une",
    "con", "del", "el", "en", "las", "los", "por", "se", "y",
)


@dataclass(frozen=True)
class Threshold:
    """A text fails when `least` * `per` > 1000 * `count` or 1000 * `count` > `most` * `per`; nothing is divided, so 0 of 0 passes."""

    name: str
    count: str
    per: str
    least: int | None = None
    most: int | None = None

    def fails(self) -> str:
        parts = [f"1000 * {self.count} < {self.least} * {self.per}"] * (self.least is not None) + [f"1000 * {self.count} > {self.most} * {self.per}"] * (self.most is not None)
        return " OR ".join(parts)


# Counts per 1000 of the other count.
THRESHOLDS = (
    Threshold("mean word length", "word_chars", "n_words", 2500, 12000),
    Threshold("symbols per word", "n_symbols", "n_words", most=100),
    Threshold("words with a letter", "n_letter_words", "n_words", least=700),
    Threshold("stop words", "n_stop_words", "n_words", least=30),
    Threshold("repeated lines", "n_dup_lines", "n_lines", most=300),
    Threshold("bullet lines", "n_bullet_lines", "n_lines", most=900),
    Threshold("lines ending in dots", "n_dotted_lines", "n_lines", most=300),
)


def _let(value: Column, use) -> Column:
    """use(value), evaluating value once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def window_hashes(words: Column, window: int = WINDOW) -> Column:
    """A hash per run of `window` words: hashes of words, then of two neighbouring hashes of half the length."""
    def doubled(hashes: Column, step: int) -> Column:
        return _let(hashes, lambda h: F.transform(h, lambda x, k: F.xxhash64(x, F.get(h, k + step))))

    hashes, step = F.transform(words, lambda w: F.xxhash64(w)), 1
    while step < window:
        hashes, step = doubled(hashes, step), 2 * step
    return F.slice(hashes, F.lit(1), F.greatest(F.size(words) - window + 1, F.lit(0)))


def repeated_words(hashes: Column, window: int = WINDOW) -> Column:
    """Words covered by windows whose hash comes twice or more; hashes has an entry per window start. Most texts have no
    such window, which distinct hashes tell; in others the starts are sorted by hash, and each start that has an equal
    neighbour covers its window up to the next such start."""
    def covered(starts: Column) -> Column:
        step = lambda start, k: F.when(k + 1 < F.size(starts), F.least(F.lit(window), F.get(starts, k + 1) - start)).otherwise(window)
        return F.aggregate(F.transform(starts, step), F.lit(0).cast("long"), lambda total, n: total + n)

    def twice(ordered: Column) -> Column:
        same = lambda x, k: (x["h"] == F.get(ordered, k - 1)["h"]) | (x["h"] == F.get(ordered, k + 1)["h"])
        return F.sort_array(F.transform(F.filter(ordered, lambda x, k: F.coalesce(same(x, k), F.lit(False))), lambda x: x["k"]))

    placed = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))
    none = F.size(F.array_distinct(hashes)) == F.size(hashes)
    return F.when(none, F.lit(0).cast("long")).otherwise(_let(placed, lambda o: _let(twice(o), covered)))


def judge_quality(docs: DataFrame, text: str = "text", thresholds: tuple[Threshold, ...] = THRESHOLDS, stop_words: tuple[str, ...] = STOP_WORDS) -> DataFrame:
    """docs with a struct __rules: counts (long) word by word and line by line, base_failed, failed (names of the thresholds
    not held, in their order) and kept.

    Words are what lies between white space, lines what lies between line feeds and has a word. A null text is an empty one: all
    counts 0, base_failed. Repeated rows are judged each for itself, columns of docs are kept whatever their names (one
    named __rules is replaced); an empty table gives an empty result. Windows are told apart by 64-bit hashes."""
    inside = "__quality_rules"
    spelt = [form for word in stop_words for form in (word, word.capitalize(), word.upper())]
    body = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(body, f"[{BLANK}]+"), lambda w: w != "")
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike(f"[^{BLANK}]"))
    parts = F.struct(body.alias("body"), words.alias("words"), lines.alias("lines"))
    c = lambda name: F.col(f"{inside}.{name}")
    size = lambda array: F.size(array).cast("long")
    counts = F.struct(
        size(c("words")).alias("n_words"),
        F.length(F.array_join(c("words"), "")).cast("long").alias("word_chars"),
        (F.length(c("body")) - F.length(F.translate(c("body"), SYMBOLS, ""))).cast("long").alias("n_symbols"),
        size(c("lines")).alias("n_lines"),
        (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long").alias("n_dup_lines"),
        size(F.filter(c("words"), lambda w: w.isin(*spelt))).alias("n_stop_words"),
        size(F.filter(c("words"), lambda w: w.rlike(r"\p{L}"))).alias("n_letter_words"),
        size(F.filter(c("lines"), lambda line: line.rlike(f"^[{BLANK}]*[-*•]"))).alias("n_bullet_lines"),
        size(F.filter(c("lines"), lambda line: line.rlike(f"(\\.\\.\\.|…)[{BLANK}]*$"))).alias("n_dotted_lines"),
        window_hashes(c("words")).alias("hashes"))
    counted = docs.withColumn(inside, parts).withColumn(inside, counts)
    names = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_stop_words", "n_letter_words", "n_bullet_lines", "n_dotted_lines"]
    counted = counted.withColumn(inside, F.struct(*[c(n).alias(n) for n in names], repeated_words(c("hashes")).alias("n_repeat_words")))
    base = (c("n_words") < LEAST_WORDS) | (c("n_repeat_words") * 100 > c("n_words") * MOST_REPEATED)
    here = {n: f"{inside}.{n}" for n in [*names, "n_repeat_words"]}
    failing = [F.when(F.expr(Threshold(t.name, here[t.count], here[t.per], t.least, t.most).fails()), t.name) for t in thresholds]
    failed = F.array_compact(F.array(*failing)) if failing else F.array().cast("array<string>")
    judged = counted.withColumn(inside, F.struct(f"{inside}.*", base.alias("base_failed"), failed.alias("failed")))
    kept = ~c("base_failed") & (F.size(c("failed")) == 0)
    return judged.withColumn("__rules", F.struct(f"{inside}.*", kept.alias("kept"))).drop(inside)
