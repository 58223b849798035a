"""Language identification by a linear-chain conditional random field over the words of a text.

Method: a word's features are its byte n-grams of one to four, those at its edges (its affixes) being told apart by the
space beside them, and the word itself (a learned lexicon), all hashed into one weight table. Transitions between the
labels of neighbouring words are learned with them, by gradient ascent on the conditional likelihood, whose gradient is
counts less forward-backward marginals. Training sequences are spans of labelled documents, half of them spliced from two
languages, so that the transitions are those of code-switched text. Every word of every whole text is labelled, each
text being one chain; a document's language is the label with the most marginal mass, its score that label's share.

The model is fitted on at most DOCS_PER_LANG labelled rows of each language: WORDS_PER_DOC neighbouring words from
anywhere in a text. It is a table of fixed size, whatever the input.

Defined results: a null text or one without a letter is `und` with score 0; words without letters are skipped; a null
identifier is never learned from and not held out; repeated rows are judged alike; other columns are left alone; without
any labelled document every text is `und`; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import cut, join_small, table
from ._text import Words, mix, parts

DOCS_PER_LANG, WORDS_PER_DOC = 400, 96
TABLE_BITS = 17
#: Words of a text that are computed step by step, side by side with its other pieces.
PIECE = 1024
EPOCHS, RATE, DECAY = 30, 0.15, 1e-6

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True


@dataclass
class Vocabulary:
    """Distinct words of some texts and the features of each."""

    inverse: np.ndarray  # the distinct word of each word
    feature: np.ndarray  # weight rows, word by word
    begins: np.ndarray  # where each distinct word's features begin


def vocabulary(w: Words, keep: np.ndarray) -> Vocabulary:
    """Of the words where keep holds."""
    starts, ends = w.starts[keep], w.ends[keep]
    hashes = w.hashes(starts, ends)
    _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    starts, ends, hashes = starts[first], ends[first], hashes[first]
    sizes = ends - starts + 2  # a space on either side
    begins = np.concatenate([[0], np.cumsum(sizes)])
    word = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(begins[-1]) - begins[:-1][word]
    edge = (place == 0) | (place == sizes[word] - 1)
    own = np.where(edge, 32, w.data[np.where(edge, 0, starts[word] + place - 1)] if len(w.data) else 32).astype(np.uint64)
    feats, words_ = [(hashes ^ np.uint64(0xA5)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - TABLE_BITS)], [np.arange(len(starts))]
    gram = own.copy()
    for n in range(1, 5):
        if n > 1:
            gram = gram[:-1] | own[n - 1 :] << np.uint64(8 * (n - 1))
        if len(gram) <= 0:
            break
        at = np.flatnonzero(place[: len(gram)] + n <= sizes[word[: len(gram)]])
        if n == 1:
            at = at[~edge[at]]
        feats.append(mix(gram[at] + np.uint64(n << 40)) >> np.uint64(64 - TABLE_BITS))
        words_.append(word[at])
    feature, of = np.concatenate(feats).astype(np.int64), np.concatenate(words_)
    order = np.argsort(of, kind="stable")
    counts = np.bincount(of, minlength=len(starts))
    return Vocabulary(inverse, feature[order], np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64))


def emissions(v: Vocabulary, weights: np.ndarray) -> np.ndarray:
    """(distinct words, labels)"""
    if not len(v.begins):
        return np.zeros((0, weights.shape[1]), np.float32)
    return np.add.reduceat(weights[v.feature], v.begins, axis=0)


@dataclass
class Chains:
    """Words in chains, laid out by step: step t has the first active[t] chains, longest first."""

    at: np.ndarray  # (steps, chains): index of the word, or -1
    active: np.ndarray

    @classmethod
    def of(cls, doc: np.ndarray, most: int) -> Chains:
        """doc: the document of each word, ascending."""
        n = len(doc)
        new = np.ones(n, bool)
        new[1:] = doc[1:] != doc[:-1]
        begin = np.flatnonzero(new)
        since = np.arange(n) - np.repeat(begin, np.diff(np.concatenate([begin, [n]])))
        begin = np.flatnonzero(since % most == 0)
        size = np.diff(np.concatenate([begin, [n]]))
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        steps = np.arange(size.max(initial=0))
        at = np.where(steps[:, None] < size[None, :], begin[None, :] + steps[:, None], -1)
        return cls(at, (at >= 0).sum(axis=1))


def marginals(chains: Chains, score: np.ndarray, start: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward-backward: each word's label probabilities, and the expected transitions summed over all words."""
    steps, n = chains.at.shape
    labels = score.shape[1]
    seen = np.exp(score - score.max(axis=1, keepdims=True, initial=-np.inf)) if len(score) else score
    move = np.exp(trans - trans.max())
    fore = np.zeros((steps, n, labels), np.float32)
    for t in range(steps):
        k = chains.active[t]
        x = seen[chains.at[t, :k]] * (np.exp(start - start.max()) if t == 0 else fore[t - 1, :k] @ move)
        fore[t, :k] = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-30)
    out = np.zeros((len(score), labels), np.float32)
    pairs = np.zeros((labels, labels))
    back = np.ones((n, labels), np.float32)
    for t in range(steps - 1, -1, -1):
        k = chains.active[t]
        m = fore[t, :k] * back[:k]
        out[chains.at[t, :k]] = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-30)
        if t:
            x = seen[chains.at[t, :k]] * back[:k]
            both = fore[t - 1, :k, :, None] * move[None] * x[:, None, :]
            pairs += (both / np.maximum(both.sum(axis=(1, 2), keepdims=True), 1e-30)).sum(axis=0)
            x = x @ move.T
            back[:k] = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-30)
    return out, pairs


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray
    start: np.ndarray
    trans: np.ndarray


def fit(texts: list[str], langs: list[str], seed: int = 7) -> Model | None:
    """A field fitted to labelled texts."""
    labels = sorted(set(langs))
    if not labels:
        return None
    rng = np.random.default_rng(seed)
    spans = [(t.lower().split()[:WORDS_PER_DOC], labels.index(g)) for t, g in zip(texts, langs)]
    sequences, truth = [], []
    for words, y in spans:
        if not words:
            continue
        if len(labels) > 1 and rng.random() < 0.5:
            more, z = spans[rng.integers(len(spans))]
            a, b = rng.integers(1, len(words) + 1), rng.integers(0, len(more) + 1)
            sequences.append(" ".join(words[:a] + more[b:]))
            truth += [y] * a + [z] * (len(more) - b)
        else:
            sequences.append(" ".join(words))
            truth += [y] * len(words)
    if not sequences:
        return None
    y = np.array(truth)
    w = next(parts(pa.array(sequences), lower=False, most=1 << 40))[2]
    keep = np.ones(len(w.starts), bool)
    v, chains = vocabulary(w, keep), Chains.of(w.doc, 1 << 30)
    size, k = 1 << TABLE_BITS, len(labels)
    weights, start, trans = np.zeros((size, k), np.float32), np.zeros(k), np.zeros((k, k))
    first = w.doc[1:] != w.doc[:-1]
    seen_pairs = np.zeros((k, k))
    np.add.at(seen_pairs, (y[:-1][~first], y[1:][~first]), 1)
    seen_first = np.bincount(y[np.concatenate([[True], first])], minlength=k)
    hot = np.eye(k, dtype=np.float32)[y]
    squares, pair_squares, first_squares = np.full((size, k), 1e-8, np.float32), np.full((k, k), 1e-8), np.full(k, 1e-8)
    n = len(y)
    lengths = np.diff(np.concatenate([v.begins, [len(v.feature)]]))
    for _ in range(EPOCHS):  # full-batch AdaGrad
        p, pairs = marginals(chains, emissions(v, weights)[v.inverse], start, trans)
        rest = np.stack([np.bincount(v.inverse, (hot - p)[:, j], minlength=len(v.begins)) for j in range(k)], axis=1)
        each = np.repeat(rest, lengths, axis=0)
        grad = np.stack([np.bincount(v.feature, each[:, j], minlength=size) for j in range(k)], axis=1).astype(np.float32) / n - DECAY * weights
        squares += grad * grad
        weights += RATE * grad / np.sqrt(squares)
        g = (seen_pairs - pairs) / n
        pair_squares += g * g
        trans += RATE * g / np.sqrt(pair_squares)
        g = (seen_first - p[np.concatenate([[True], first])].sum(axis=0)) / n
        first_squares += g * g
        start += RATE * g / np.sqrt(first_squares)
    return Model(labels, weights, start, trans)


def predict(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    n = len(texts)
    if model is None:
        return ["und"] * n, [0.0] * n
    low = [t.lower() if t else "" for t in texts]
    out, scores = [], []
    for i, j, w in parts(pa.array(low, pa.large_string()), lower=False):
        letters = np.concatenate([[0], np.cumsum(_LETTER[w.data])])
        keep = letters[w.ends] > letters[w.starts]
        doc = w.doc[keep]
        mass = np.zeros((j - i, len(model.labels)))
        if len(doc):
            v = vocabulary(w, keep)
            p, _ = _marginals_only(Chains.of(doc, PIECE), emissions(v, model.weights)[v.inverse], model.start, model.trans, doc)
            mass = np.stack([np.bincount(doc, p[:, k], minlength=j - i) for k in range(len(model.labels))], axis=1)
        best, total = mass.argmax(axis=1), mass.sum(axis=1)
        ascii_ = np.diff(np.concatenate([[0], np.cumsum(_LETTER[w.data] & (w.data < 128))])[w.offsets]) > 0
        for d in range(j - i):
            if total[d] > 0 and (ascii_[d] or any(map(str.isalpha, low[i + d]))):
                out.append(model.labels[best[d]])
                scores.append(min(1.0, float(mass[d, best[d]] / total[d])))
            else:
                out.append("und")
                scores.append(0.0)
    return out, scores


def _messages(chains: Chains, doc: np.ndarray, seen: np.ndarray, move: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each chain gets from the words of its document before it and after it. A chain's paths, summed for each label
    of its first and of its last word, are one matrix, made for those documents only that have several chains."""
    labels = len(first)
    heads = chains.at[0]
    before, after = np.tile(first, (len(heads), 1)), np.ones((len(heads), labels))
    follows = (heads > 0) & (doc[heads - 1] == doc[heads])
    order = np.argsort(heads)
    followed = np.zeros(len(heads), bool)
    followed[order[:-1]] = follows[order[1:]]
    many = np.flatnonzero(follows | followed)
    if not len(many):
        return before, after
    paths = np.eye(labels) * seen[heads[many]][:, None, :].astype(float)
    at = chains.at[:, many]
    for t in range(1, len(at)):
        k = int((at[t] >= 0).sum())
        x = (paths[:k] @ move) * seen[at[t, :k]][:, None, :]
        paths[:k] = x / np.maximum(x.sum(axis=(1, 2), keepdims=True), 1e-300)
    row = np.full(len(heads), -1)
    row[many] = np.arange(len(many))
    line = [c for c in order.tolist() if row[c] >= 0]
    for last, c in zip([None, *line], line):
        if follows[c]:
            x = before[last] @ paths[row[last]] @ move
            before[c] = x / max(x.sum(), 1e-300)
    for c, following in zip(line[-2::-1], line[:0:-1]):
        if followed[c]:
            x = move @ (paths[row[following]] @ after[following])
            after[c] = x / max(x.sum(), 1e-300)
    return before, after


def _marginals_only(chains: Chains, score: np.ndarray, start: np.ndarray, trans: np.ndarray, doc: np.ndarray | None = None) -> tuple[np.ndarray, None]:
    """As marginals(), without the expected transitions. With the document of each word, chains of one document are
    pieces of one chain."""
    steps, n = chains.at.shape
    seen = np.exp(score - score.max(axis=1, keepdims=True)).astype(np.float32)
    move, first = np.exp(trans - trans.max()), np.exp(start - start.max())
    doc = np.arange(len(score)) if doc is None else doc  # no two chains of one document
    before, back = (x.astype(np.float32) for x in _messages(chains, doc, seen, move, first))
    move = move.astype(np.float32)
    fore = np.zeros((steps, n, score.shape[1]), np.float32)
    for t in range(steps):
        k = chains.active[t]
        x = seen[chains.at[t, :k]] * (before if t == 0 else fore[t - 1, :k] @ move)
        fore[t, :k] = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-30)
    out = np.zeros_like(seen)
    for t in range(steps - 1, -1, -1):
        k = chains.active[t]
        m = fore[t, :k] * back[:k]
        out[chains.at[t, :k]] = m / np.maximum(m.sum(axis=1, keepdims=True), 1e-30)
        x = (seen[chains.at[t, :k]] * back[:k]) @ move.T
        back[:k] = x / np.maximum(x.sum(axis=1, keepdims=True), 1e-30)
    return out, None


def labelled_sample(docs: DataFrame, key: str, text: str, lang: str, docs_per_lang: int) -> tuple[list[str], list[str]]:
    """Labelled texts of at most docs_per_lang identifiers of each language, those with the least hash, and of each text
    WORDS_PER_DOC neighbouring words, beginning anywhere in the whole text."""
    ids = docs.where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull()).select(key, lang, F.xxhash64(F.lit(3), key).alias("h")).distinct()
    few = ids.withColumn("r", F.row_number().over(Window.partitionBy(lang).orderBy("h", key))).where(F.col("r") <= docs_per_lang).select(key).distinct()
    few = cut(few)
    words = F.split(F.col(text), r"[\x20\x09-\x0D]+")
    begin = F.pmod(F.xxhash64(F.lit(5), key), F.greatest(F.size(words) - WORDS_PER_DOC, F.lit(0)).cast("long") + 1) + 1
    rows = join_small(docs, few, key, "left_semi").where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = rows.select(F.array_join(F.slice(words, begin.cast("int"), WORDS_PER_DOC), " ").alias("t"), F.col(lang).alias("g"), F.xxhash64(F.lit(3), key).alias("h"))
    rows = rows.groupBy("h", "g").agg(F.min("t").alias("t")).collect()  # one of the rows that share an identifier
    rows.sort(key=lambda r: (r.h, r.g, r.t))
    return [r.t for r in rows], [r.g for r in rows]


def with_language(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs (less its text) with lang_pred and score."""
    rest = docs.drop("lang_pred", "score")
    kept = [f for f in rest.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = predict(model, b.column(b.schema.get_field_index(text)).to_pylist())
            cols = [b.column(b.schema.get_field_index(f.name)) for f in kept]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema.names)

    return rest.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    texts, langs = labelled_sample(docs.where(~held_out), "doc_id", "text", "lang", DOCS_PER_LANG)
    out = with_language(docs.select("doc_id", "text", held_out.alias("held_out")), fit(texts, langs))
    return out.select("doc_id", "held_out", "lang_pred", "score")
