"""Quality rules: divergence of a document's histograms from those of languages.

Two histograms describe a text: its characters by class, and its words by
common word (one place each, and one for all other words). Summed over all
documents of a language they are that language's reference. A document is kept if
the Jensen-Shannon distances to the nearest reference stay within limits; texts
too short for a histogram to mean anything are not judged by it.

Everything is a projection over the text but for one sum per language, which is
combined before it is shuffled and comes to a handful of rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import free_name, stored, whole_text

SYMBOLS = "#*$%&|<>"

#: Function words, by language. They count as they stand, in lower case and without a mark.
COMMON_WORDS = {
    "en": "the of and to a in is that".split(),
    "de": "der die und in den von zu das".split(),
    "fr": "de la le et les des en un".split(),
    "es": "de la que el en y los se".split(),
}
#: Character classes besides lower-case letters, white space and the rest.
CLASSES = {"upper": r"\p{Lu}+", "letters": r"\p{L}+", "digits": r"\p{Nd}+", "points": r"""[.,;:!?'"()\-]+"""}

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: From this size on a text's characters, or its words, are compared.
GUARD_CHARS, GUARD_WORDS = 300, 60
#: Limits of the distance (0: equal, 1: nothing in common).
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.17, 0.45
#: Documents that a language needs to serve as a reference.
REFERENCE_DOCS = 20


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+``, in order."""
    return F.array_remove(_pieces(text), "")


def _pieces(text: Column) -> Column:
    """What lies between single characters of white space; one more than there are of them."""
    return F.split(F.regexp_replace(text, r"[\x09-\x0D]", " "), " ")


def _repeat_words(hashes: str) -> Column:
    """Words inside a window that occurs twice or more in the text.

    Windows are compared by 64-bit hash; a text without a repeated one, which is
    the usual case, needs no sort.
    """
    h = F.col(hashes)
    ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def places(o: Column) -> Column:
        same = F.filter(
            o,
            lambda x, k: (F.get(o, k - 1)["h"] == x["h"]) | (F.get(o, k + 1)["h"] == x["h"]),
        )
        return F.array_sort(F.transform(same, lambda x: x["i"]))

    def covered(p: Column) -> Column:
        return F.aggregate(
            p,
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")),
            lambda a: a["n"],
        )

    # A one-element array binds the sorted windows to a name, so that they are sorted once.
    bound = F.transform(F.array(ordered), lambda o: covered(places(o)))
    return F.when(F.size(F.array_distinct(h)) < F.size(h), bound[0]).otherwise(0)


def _common_counts(words: Column) -> Column:
    """Occurrences of each common word, in the order of ``vocabulary()``."""
    # One expression for all words: an expression for each would be too long a method to be compiled.
    listed = F.split(F.lit(" ".join(vocabulary())), " ")
    return F.transform(listed, lambda w: F.size(words) - F.size(F.array_remove(words, w)))


def vocabulary() -> list[str]:
    return sorted({w for ws in COMMON_WORDS.values() for w in ws})


def measured(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a struct of what the rules look at. A null text counts as empty: all measures are zero."""
    names = "_body _pieces _words _one _two _four _windows _common".split()
    text, pieces, plain, one, two, four, windows, common = (free_name(docs, n) for n in names)
    rows = docs.withColumn(text, whole_text()).withColumn(pieces, _pieces(F.col(text)))
    rows = rows.withColumn(plain, F.array_remove(F.col(pieces), ""))
    words = F.col(plain)
    # Hashes of 1, 2, 4 and 8 words; the last 7 places lack a word and are cut off.
    rows = rows.withColumn(one, F.transform(words, lambda w: F.xxhash64(w)))
    for of, into, step in ((one, two, 1), (two, four, 2), (four, windows, 4)):
        later = F.slice(F.col(of), F.lit(step + 1), F.size(of))
        rows = rows.withColumn(into, F.zip_with(F.col(of), later, lambda x, y: F.xxhash64(x, y)))
    full = F.slice(F.col(windows), F.lit(1), F.greatest(F.size(words) - (WINDOW - 1), F.lit(0)))
    rows = rows.withColumn(windows, full)
    rows = rows.withColumn(common, F.filter(words, lambda w: w.isin(vocabulary())))
    lines = F.filter(F.split(F.col(text), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    length = F.length(text)
    without = {k: length - F.length(F.regexp_replace(text, p, "")) for k, p in CLASSES.items()}
    n_lines = free_name(docs, "_lines")
    rows = rows.withColumn(n_lines, lines)
    parts = {
        "n_words": F.size(words),
        "word_chars": length - F.size(pieces) + 1,
        "n_symbols": length - F.length(F.regexp_replace(text, rf"[{SYMBOLS}]+", "")),
        **without,
        "n_chars": length,
        "common": _common_counts(F.col(common)),
        "n_dup_lines": F.size(n_lines) - F.size(F.array_distinct(n_lines)),
        "n_repeat_words": _repeat_words(windows),
    }
    rows = rows.withColumn(name, F.struct(*[c.cast("array<bigint>" if k == "common" else "bigint").alias(k) for k, c in parts.items()]))
    return rows.drop(text, pieces, plain, one, two, four, windows, common, n_lines)


def _histograms(m: Column) -> tuple[Column, Column]:
    """Counts by character class, and by common word with all others at the end."""
    rest = m["word_chars"] - m["letters"] - m["digits"] - m["points"]
    spaces = m["n_chars"] - m["word_chars"]
    # Digits are as good as small letters: numbers in a text are no fault.
    chars = F.array(m["letters"] - m["upper"] + m["digits"], m["upper"], spaces, m["points"], rest)
    known = F.aggregate(m["common"], F.lit(0).cast("bigint"), lambda a, x: a + x)
    return chars, F.concat(m["common"], F.array(F.greatest(m["n_words"] - known, F.lit(0))))


def references(rows: DataFrame, name: str) -> list[tuple[list[int], list[int]]]:
    """Summed histograms of each language of ``COMMON_WORDS`` found in the rows, a stored table of measures.

    Short texts, and those full of symbols or capitals, are not in a reference. At most one row for each
    such language reaches the driver.
    """
    chars, words = _histograms(F.col(name))
    m = F.col(name)
    fit = (m["n_words"] >= MIN_WORDS) & (100 * m["n_symbols"] <= m["n_chars"]) & (5 * m["upper"] <= m["letters"])
    counted = rows.where(F.col("lang").isin(list(COMMON_WORDS)) & fit)
    n_chars, n_words = len(CLASSES) + 1, len(vocabulary()) + 1
    summed = (
        counted.select(F.col("lang").alias("lang"), chars.alias("c"), words.alias("w"))
        .groupBy("lang")
        .agg(
            F.count("*").alias("n"),
            *[F.sum(F.col("c")[i]).alias(f"c{i}") for i in range(n_chars)],
            *[F.sum(F.col("w")[i]).alias(f"w{i}") for i in range(n_words)],
        )
        .where(F.col("n") >= REFERENCE_DOCS)
        .orderBy("lang")
        .collect()
    )
    return [([r[f"c{i}"] for i in range(n_chars)], [r[f"w{i}"] for i in range(n_words)]) for r in summed]


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once: as the element of an array it has a name."""
    return F.transform(F.array(value), use)[0]


def _total(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)


def _distance(shares: Column, reference: list[int]) -> Column:
    """Jensen-Shannon distance: the root of the divergence in bits, 0 to 1."""
    q = F.array(*[F.lit(x / max(sum(reference), 1)) for x in reference])

    def term(p: Column, q: Column) -> Column:
        of = lambda x: F.when(x > 0, x * F.log2(2 * x / (p + q))).otherwise(0.0)
        return (of(p) + of(q)) / 2

    return F.sqrt(F.greatest(_total(F.zip_with(shares, q, term)), F.lit(0.0)))


def _nearest(counts: Column, references: list[list[int]]) -> Column:
    """The distance to the nearest reference. Counts, their total and the shares are computed once for all."""

    def of_shares(shares: Column) -> Column:
        return F.array_min(F.array(*[_distance(shares, r) for r in references]))

    def of_counts(c: Column) -> Column:
        return _bound(_bound(_total(c), lambda total: F.transform(c, lambda x: x / total)), of_shares)

    return _bound(counts, of_counts)


def verdicts(rows: DataFrame, name: str, known: list[tuple[list[int], list[int]]]) -> tuple[Column, Column]:
    """(base_failed, kept) as columns of ``measured`` rows.

    Without any reference the histograms decide nothing. A text at a limit is kept: only
    a distance above it rejects. Null texts were measured as empty ones, which fail the base rules.
    """
    m = F.col(name)
    base_failed = (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > MAX_REPEAT_PERCENT * m["n_words"])
    if not known:
        return base_failed, ~base_failed
    chars, words = _histograms(m)
    far = (m["n_chars"] >= GUARD_CHARS) & (_nearest(chars, [c for c, _ in known]) > MAX_CHAR_DISTANCE)
    far |= (m["n_words"] >= GUARD_WORDS) & (_nearest(words, [w for _, w in known]) > MAX_WORD_DISTANCE)
    return base_failed, F.when(base_failed, False).otherwise(~far)


def accepted(docs: DataFrame) -> DataFrame:
    """The documents that the rules keep, with the columns they came with.

    Null text counts as empty and is rejected (no words). A null or unknown
    language is compared like any other: with every reference. Repeated rows get
    the same verdict each. No documents give none.

    Texts are measured once, and kept with their measures in the shared folder: the
    references read the measures alone, the verdicts both.
    """
    name = free_name(docs, "_measured")
    rows = stored(measured(docs, name), "measured")
    _, kept = verdicts(rows, name, references(rows, name))
    return rows.where(kept).drop(name)


def distance_in(counts: list[int], reference: list[int]) -> float:
    """The distance of two histograms in plain Python, for tests."""
    p, q = ([x / max(sum(h), 1) for x in h] for h in (counts, reference))
    of = lambda x, a, b: x * math.log2(2 * x / (a + b)) if x else 0.0
    return math.sqrt(max(0.0, sum(of(a, a, b) + of(b, a, b) for a, b in zip(p, q, strict=True)) / 2))
