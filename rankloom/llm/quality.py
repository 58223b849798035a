"""Quality rules whose thresholds adapt to each language and source.

Method: every document gets counts of its words, symbols and repetitions. For each (language, source) group and each
ratio of these a mergeable quantile sketch is built: a histogram over logarithmic buckets, whose counts simply add up,
so that it is the same however the rows are dealt. Fences come from the sketch alone. The upper fence of a ratio is its
group's median plus SPREAD times the distance to an upper quantile: the first of UPPER that lies above the median, as
many ratios are zero for most documents; where none does, the median is the fence. The lower fence mirrors it with the
lower quartile, for ratios that have one. The fences are joined back to the documents, and one beyond a fence is rejected.

Defined results: a null or empty text has no words and fails the base rules; null languages and sources are groups of
their own; a group with under min_docs documents takes the fences of its language, or else those of all documents;
repeated rows are judged alike; columns of clashing names are replaced; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut, join_small, table
from ._text import mix, parts, per_doc

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: ratio -> (numerator, denominator, whether it has a lower fence)
RATIOS = {
    "word_length": ("word_chars", "n_words", True),
    "symbols_per_word": ("n_symbols", "n_words", False),
    "dup_lines_per_word": ("n_dup_lines", "n_words", False),
    "repeat_share": ("n_repeat_words", "n_words", False),
}
SPREAD = 6.0
#: Quantiles of which the first above the median tells how far a ratio spreads.
UPPER = {"q75": 0.75, "q90": 0.9, "q95": 0.95, "q98": 0.98, "q99": 0.99}
QUANTILES = {"q25": 0.25, "q50": 0.5, **UPPER}
#: Relative width of a sketch's bucket; ratios under LEAST share the lowest.
GAMMA, LEAST = 1.01, 1e-4


def count_words(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text of a string column."""
    out: dict[str, list[np.ndarray]] = {k: [] for k in COUNTS}
    for _, _, w in parts(column, lower=False):
        prefix = w.prefix()
        n = w.n_docs
        word = np.zeros(len(w.data) + 1, np.int8)
        np.add.at(word, w.starts, 1) if len(w.starts) else None
        word[w.ends] -= 1
        inside = np.cumsum(word[:-1], dtype=np.int8).astype(bool)
        out["n_words"].append(w.counts())
        out["word_chars"].append(per_doc(inside & ((w.data & 0xC0) != 0x80), w.offsets))
        out["n_symbols"].append(per_doc(SYMBOLS[w.data], w.offsets))
        out["n_dup_lines"].append(_dup_lines(w, inside, prefix, n))
        out["n_repeat_words"].append(_repeat_words(w, prefix, n))
    return {k: np.concatenate(v).astype(np.int64) if v else np.zeros(0, np.int64) for k, v in out.items()}


def _dup_lines(w, inside: np.ndarray, prefix: np.ndarray, n: int) -> np.ndarray:
    breaks = np.flatnonzero(w.data == 10)
    starts = np.unique(np.concatenate([w.offsets[:-1], breaks + 1]))
    starts = starts[starts < len(w.data)]
    ends = np.concatenate([starts[1:], [len(w.data)]])
    ends = ends - ((ends > starts) & (w.data[np.maximum(ends - 1, 0)] == 10)) if len(starts) else ends[:0]
    has = np.concatenate([[0], np.cumsum(inside)])
    full = has[ends] > has[starts] if len(starts) else np.zeros(0, bool)
    starts, ends = starts[full], ends[full]
    doc = np.searchsorted(w.offsets, starts, "right") - 1
    key = mix(w.hashes(starts, ends, prefix) + (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
    _, first = np.unique(key, return_index=True)
    return np.bincount(doc, minlength=n) - np.bincount(doc[first], minlength=n)


def _repeat_words(w, prefix: np.ndarray, n: int, size: int = 3) -> np.ndarray:
    if len(w.starts) < size:
        return np.zeros(n, np.int64)
    h = w.hashes(prefix=prefix)
    whole = w.doc[:-2] == w.doc[2:]
    at = np.flatnonzero(whole)
    key = mix(mix(h[at] * np.uint64(3) + h[at + 1]) * np.uint64(5) + h[at + 2] + (w.doc[at].astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25))
    order = np.argsort(key)
    key = key[order]
    same = key[1:] == key[:-1]
    twice = np.zeros(len(key), bool)
    twice[1:] |= same
    twice[:-1] |= same
    found = at[order[twice]]
    mark = np.zeros(len(h), bool)
    for i in range(size):
        mark[found + i] = True
    return np.bincount(w.doc[mark], minlength=n)


def with_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the columns COUNTS and base_failed."""
    rest = docs.drop(*COUNTS, "base_failed")
    schema = T.StructType([*rest.schema.fields, *[T.StructField(c, T.LongType()) for c in COUNTS]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = count_words(b.column(b.schema.get_field_index(text)))
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array(counts[c]) for c in COUNTS]], [*b.schema.names, *COUNTS])

    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rest.mapInArrow(run, schema).withColumn("base_failed", failed)


def _ratio(name: str):
    over, under, _ = RATIOS[name]
    return F.coalesce(F.col(over) / F.nullif(F.col(under), F.lit(0)), F.lit(0.0))


def _bucket(x):
    return F.ceil(F.log(F.greatest(x, F.lit(LEAST)) / LEAST) / F.log(F.lit(GAMMA))).cast("int")


def _middle(bucket):
    return F.when(bucket <= 0, F.lit(0.0)).otherwise(LEAST * F.pow(F.lit(GAMMA), bucket - 0.5))


def sketch(counts: DataFrame, groups: list[str]) -> DataFrame:
    """(groups, ratio, bucket, n): a quantile sketch of each ratio in each group. Sketches are merged by adding n."""
    ratios = F.explode(F.array(*[F.struct(F.lit(r).alias("ratio"), _ratio(r).alias("x")) for r in RATIOS])).alias("r")
    return counts.select(*groups, ratios).select(*groups, "r.ratio", _bucket(F.col("r.x")).alias("bucket")).groupBy(*groups, "ratio", "bucket").agg(F.count("*").alias("n"))


def quantiles(sketches: DataFrame, groups: list[str], shares: dict[str, float]) -> DataFrame:
    """(groups, ratio, docs, one column for each share): quantiles read from the sketches."""
    w = Window.partitionBy(*groups, "ratio")
    run = sketches.withColumn("below", F.sum("n").over(w.orderBy("bucket"))).withColumn("docs", F.sum("n").over(w))
    value = _middle(F.col("bucket"))
    return run.groupBy(*groups, "ratio").agg(F.max("docs").alias("docs"), *[F.min(F.when(F.col("below") >= F.col("docs") * q, value)).alias(name) for name, q in shares.items()])


def fences(counts: DataFrame, lang: str = "lang", source: str = "source", spread: float = SPREAD, min_docs: int = 30) -> DataFrame:
    """(lang, source, one pair lo_<ratio>, hi_<ratio> for each ratio) for every group of counts."""
    own = cut(sketch(counts, [lang, source]))
    shares = QUANTILES
    level = quantiles(own, [lang, source], shares)
    by_lang = quantiles(own.groupBy(lang, "ratio", "bucket").agg(F.sum("n").alias("n")), [lang], shares)
    overall = quantiles(own.groupBy("ratio", "bucket").agg(F.sum("n").alias("n")), [], shares)
    a, b, c = level.alias("a"), by_lang.alias("b"), overall.alias("c")
    both = a.join(b, F.col(f"a.{lang}").eqNullSafe(F.col(f"b.{lang}")) & (F.col("a.ratio") == F.col("b.ratio"))).join(F.broadcast(c), F.col("a.ratio") == F.col("c.ratio"))
    pick = lambda q: F.when(F.col("a.docs") >= min_docs, F.col(f"a.{q}")).when(F.col("b.docs") >= min_docs, F.col(f"b.{q}")).otherwise(F.col(f"c.{q}"))
    rows = both.select(F.col(f"a.{lang}").alias(lang), F.col(f"a.{source}").alias(source), F.col("a.ratio").alias("ratio"), *[pick(q).alias(q) for q in shares])
    tail = F.coalesce(*[F.when(F.col(q) > F.col("q50"), F.col(q)) for q in UPPER], "q50")
    cols = []
    for r, (_, _, lower) in RATIOS.items():
        mine = F.col("ratio") == r
        cols.append(F.max(F.when(mine, F.col("q50") + spread * (tail - F.col("q50")))).alias(f"hi_{r}"))
        low = F.col("q50") - spread * (F.col("q50") - F.col("q25")) if lower else F.lit(-1.0)
        cols.append(F.max(F.when(mine, low)).alias(f"lo_{r}"))
    return rows.groupBy(lang, source).agg(*cols)


def judged(counts: DataFrame, limits: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """counts with the column kept: false if base_failed or beyond a fence.

    A ratio is compared as the middle of its bucket, as the fences are made of such."""
    names = counts.columns
    limits = cut(limits.withColumnsRenamed({lang: "__lang", source: "__source"}))
    within = ~F.col("base_failed")
    for r in RATIOS:
        x = _middle(_bucket(_ratio(r)))
        within = within & (x <= F.col(f"hi_{r}")) & (x >= F.col(f"lo_{r}"))
    joined = join_small(counts, limits, counts[lang].eqNullSafe(limits["__lang"]) & counts[source].eqNullSafe(limits["__source"]), "left")
    return joined.select(*names, F.coalesce(within, F.lit(False)).alias("kept"))


def filtered(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The documents that pass, with the columns of docs."""
    counts = with_counts(docs.select(text, lang, source), text).where(~F.col("base_failed"))
    limits = fences(counts, lang, source)
    full = docs.select(F.struct(*[c for c in docs.columns if c != text]).alias("__row"), text, lang, source)
    kept = judged(with_counts(full, text), limits, lang, source).where("kept")
    return kept.select(*[text if c == text else F.col("__row")[c].alias(c) for c in docs.columns])


def op10_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    counts = cut(with_counts(docs).drop("text"))
    kept = judged(counts, fences(counts.where(~F.col("base_failed"))))
    return kept.select("doc_id", *COUNTS, "base_failed", "kept")
