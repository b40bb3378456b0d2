"""Quality rules: distribution divergence from language references.

A document's histograms of character classes and of common words are compared, by Jensen-Shannon
distance, with those of its language. The references are means over all documents of the language
that pass the base rules, so none of them weighs more for being long. A histogram of too few
characters or words says little: below a minimum length it is not held against the document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, id_and_text, written

#: Common words by language (fixed values).
COMMON = {
    "en": "the of and to in is that for it with as on was be by are from or an this".split(),
    "de": "der die das und in zu den von ist mit sich auf für nicht ein eine im dem des es".split(),
    "fr": "le la les de des et un une à est que qui dans pour sur par avec du au pas".split(),
    "es": "el la los las de y que en un una es se por con su para del lo al como".split(),
}
#: Classes of bytes in UTF-8 text; what is in none of them is "other".
CLASSES = {
    "lower": bytes(range(97, 123)), "upper": bytes(range(65, 91)), "digit": b"0123456789", "space": b" \t\n\x0b\x0c\r",
    "point": b".,;:?'\"()-", "mark": b"!", "symbol": b"#*$%&|<>", "high": bytes(range(128, 256)),
}
SYMBOLS = b"#*$%&|<>"
#: Base rules.
MIN_WORDS, WINDOW, MAX_REPEAT = 20, 8, 0.30
#: Distances (0 to 1) above which a document fails, and the characters and words that it must have to be judged.
#: A text without any common word is about 0.39 from a reference, so MAX_WORD is well below that.
MAX_CLASS, MAX_WORD, MIN_CHARS, MIN_COMMON = 0.20, 0.12, 200, 50
#: A histogram of n characters or words is off by chance by about 1 / sqrt(n); so many times that is allowed on top.
#: Texts of one language are off by 2 to 2.5 times that in common words as a rule and by 3.5 times at most.
SLACK_CLASS, SLACK_WORD = 2.0, 3.0

_VOCAB = sorted({w for words in COMMON.values() for w in words})
_SLOT = {w.encode(): i for i, w in enumerate(_VOCAB)}


def base_counts(text: bytes) -> tuple[int, int, int, int, int, list[bytes]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and the words."""
    words = text.split()
    n = len(words)
    joined = b"".join(words)
    word_chars = len(joined) if joined.isascii() else len(joined.decode("utf-8", "replace"))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return n, word_chars, symbols, len(lines) - len(set(lines)), _repeated(words), words


def _repeated(words: list[bytes]) -> int:
    """Words that stand in a window of WINDOW words found twice or more."""
    n = len(words)
    if n <= WINDOW:
        return 0
    ids: dict[bytes, int] = {}
    first = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if len(ids) > n - 1:
        return 0
    # Windows of 2, 4 and 8 words get a number each from those of half the length.
    for half in (1, 2, 4):
        pair = first[:-half] * (n + 1) + first[half:]
        first = np.unique(pair, return_inverse=True)[1]
    count = np.bincount(first)
    if count.max() < 2:
        return 0
    at = np.flatnonzero(count[first] > 1)
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + WINDOW, -1)
    return int((np.cumsum(edge)[:n] > 0).sum())


def class_counts(text: bytes) -> list[int]:
    """How many characters each class has, then the others: 'high' counts characters, not bytes."""
    n = len(text)
    out = [n - len(text.translate(None, drop)) for drop in CLASSES.values()]
    high = len(text) - len(text.translate(None, bytes(range(192, 256))))  # leading bytes: one a character
    out.append(n - sum(out))
    out[list(CLASSES).index("high")] = high
    return out


def word_counts(words: list[bytes]) -> list[int]:
    """How often each word of the vocabulary stands among the words, then the others. A-Z counts as a-z, marks at the ends don't count."""
    out = [0] * (len(_VOCAB) + 1)
    for w in words:
        out[_SLOT.get(w.strip(b".,;:?!'\"()-#*$%&|<>").translate(LOWER), -1)] += 1
    return out


def _shares(counts: list[int]) -> list[float]:
    total = max(sum(counts), 1)
    return [n / total for n in counts]


MEASURED = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, classes array<double>, common array<double>"


def _measure(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        rows = []
        for text in b.column(1).to_pylist():
            *base, words = base_counts(text)
            rows.append((*base, _shares(class_counts(text)), _shares(word_counts(words))))
        columns = list(zip(*rows, strict=True)) if rows else [()] * 7
        kinds = [pa.int64()] * 5 + [pa.list_(pa.float64())] * 2
        names = [x.split()[0] for x in MEASURED.split(", ")]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)


def jensen_shannon(p: Column, q: Column) -> Column:
    """The distance of two histograms of shares: the root of the divergence in bits, 0 to 1."""
    part = lambda x, m: F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)
    terms = F.zip_with(p, q, lambda x, y: part(x, (x + y) / 2) + part(y, (x + y) / 2))
    return F.sqrt(F.greatest(F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2, F.lit(0.0)))


def references(measured: DataFrame) -> DataFrame:
    """(lang, class_ref, common_ref) for the languages of COMMON.

    A first reference is the mean of shares over all documents of the language that pass the base
    rules and are long enough. What is unlike the language blurs it, so the second and last one is
    the mean over the half of these documents that is nearest to the first.
    """
    good = measured.where((F.col("n_words") >= MIN_COMMON) & (100 * F.col("n_repeat_words") <= round(100 * MAX_REPEAT) * F.col("n_words")) & F.col("lang").isin(*COMMON))
    shares = good.select("lang", F.col("classes").alias("p"), F.col("common").alias("q"))
    first = _means(shares)
    far = shares.join(F.broadcast(first), "lang").withColumn("far", jensen_shannon(F.col("p"), F.col("class_ref")) + jensen_shannon(F.col("q"), F.col("common_ref")))
    limit = far.groupBy("lang").agg(F.percentile_approx("far", 0.5, 10_000).alias("limit"))
    return _means(far.join(F.broadcast(limit), "lang").where("far <= limit"))


def _means(shares: DataFrame) -> DataFrame:
    mean = lambda c, n: F.array(*(F.round(F.avg(F.col(c)[i]), 9) for i in range(n)))
    return shares.groupBy("lang").agg(mean("p", len(CLASSES) + 1).alias("class_ref"), mean("q", len(_VOCAB) + 1).alias("common_ref"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """One row per row of docs (columns doc_id, text, lang).

    Columns: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    kept, class_distance, word_distance. A null or empty text has no words and fails. The
    reference is that of the document's language; without one (lang null, or none of COMMON, or
    no document of it is fit to be a reference) the nearest one counts. Distances are null where
    there is no reference at all, and then hold nothing against the document. Repeated rows are
    judged each alike. An empty table gives no rows.
    """
    measured = written(id_and_text(docs, "lang").select("doc_id", "text", F.col("lang").cast("string").alias("lang")).mapInArrow(_measure, MEASURED))
    refs = references(measured)  # a row per language of COMMON at most
    every = F.broadcast(refs.groupBy().agg(F.collect_list(F.struct("lang", "class_ref", "common_ref")).alias("refs")))
    own = F.filter("refs", lambda r: r["lang"] == F.col("lang"))
    near = lambda kind, c: F.array_min(F.transform(F.when(F.size(own) > 0, own).otherwise(F.col("refs")), lambda r: jensen_shannon(F.col(c), r[kind])))
    failed = (F.col("n_words") < MIN_WORDS) | (F.lit(100) * F.col("n_repeat_words") > F.lit(round(100 * MAX_REPEAT)) * F.col("n_words"))
    strange = ((F.col("word_chars") >= MIN_CHARS) & (F.col("class_distance") > MAX_CLASS + SLACK_CLASS / F.sqrt("word_chars"))) | ((F.col("n_words") >= MIN_COMMON) & (F.col("word_distance") > MAX_WORD + SLACK_WORD / F.sqrt("n_words")))
    return measured.crossJoin(every).withColumns({"class_distance": near("class_ref", "classes"), "word_distance": near("common_ref", "common"), "base_failed": failed}).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.coalesce(strange, F.lit(False))).alias("kept"), "class_distance", "word_distance",
    )
