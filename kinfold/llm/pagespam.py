"""Keyword-stuffed and link-list pages, told by how neighbouring words go together.

Counts of words and of neighbouring word pairs over the whole corpus give each pair its pointwise
mutual information (PMI). A text is read in windows of `WINDOW` pairs. Windows of word salad have
low or erratic PMI; stuffed windows and link lists repeat the same collocations far more often than
text does. A logistic model over these window measures, fitted on a bounded reviewed sample, says how
likely a window is spam; the page is spam by the share and strength of such windows over its whole
length, beside how many sentences and links it has, so that a ruling which carries a little spam is not.

Two passes over the texts, no shuffle of texts. Pass 1 counts per partition before anything is
shuffled. Pass 2 reads PMI from a broadcast table while the corpus has at most `MAX_BROADCAST` pairs,
and beyond that from a shuffled join on the pair; both give the same figures.

Words are runs of letters, digits counting as one symbol each; letters outside ASCII stay as they
are, case is folded for ASCII. Defined results: a missing, empty or very short text (fewer than
`MIN_WORDS` words) is not spam; a doc_id in several rows is spam if one of its texts is; without
reviewed pages of both kinds (10 in all, 3 of each) the distance from the corpus's median page decides:
erratic PMI and recurring collocations for, frequent words against (`_unusual`).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.llm.fitting import logistic, sigmoid
from kinfold.session import Scratch

WINDOW = 24
MIN_WORDS = 12
#: Without reviewed pages: the distance from the median page, in quartile ranges, that makes spam.
UNUSUAL = 9.0
#: Reviewed samples hold far more spam than a crawl, so a page needs more than even odds.
THRESHOLD = 0.8
#: Distinct word pairs up to which PMI is broadcast (some 120 bytes each in a worker).
MAX_BROADCAST = 600_000
#: Reviewed pages used to fit, chosen by hash, and windows taken of each.
MAX_LABELS = 5_000
MAX_LABEL_WINDOWS = 300
FREQUENT = 80
_SLICE = 1_500_000  # characters handled at a time
_FLUSH = 400_000  # distinct pairs a worker holds before it passes its counts on

# lower case, digits as 0, everything else in ASCII as a gap; bytes of other letters stay
_FOLD = bytes(
    (c | 32) if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 48 if 48 <= c <= 57 else 32 for c in range(256)
)
_MASK = "█".encode()
_ENDS = (". ", ".\n", "? ", "?\n")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_FOLD).split() if text else []


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > _SLICE:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


class _Read:
    """Word ids of several texts in one array, and which neighbours belong together."""

    def __init__(self, texts: list[str | None]):
        tokens = [words(t) for t in texts]
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.ends = np.array([sum(map(t.count, _ENDS)) + t.endswith((".", "?")) if t else 0 for t in texts], float)
        self.links = np.array([t.count("://") + t.count("#") if t else 0 for t in texts], float)
        flat = [w for t in tokens for w in t]
        ids: dict[bytes, int] = {}
        put = ids.setdefault
        self.word = np.fromiter((put(w, len(ids)) for w in flat), np.int64, len(flat))
        self.vocabulary = list(ids)
        self.text = np.repeat(np.arange(len(texts)), self.length)
        inside = self.text[1:] == self.text[:-1]
        self.left, self.right = self.word[:-1][inside], self.word[1:][inside]
        self.of_pair = self.text[:-1][inside]
        self.pair, self.pair_id = np.unique(self.left * max(1, len(ids)) + self.right, return_inverse=True)

    def pair_names(self) -> list[bytes]:
        v, n = self.vocabulary, max(1, len(self.vocabulary))
        return [v[p // n] + b" " + v[p % n] for p in self.pair.tolist()]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[bytes] = Counter()

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["term", "n"])

    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in _slices(texts):
            read = _Read(texts[a:b])
            for names, of in ((read.vocabulary, read.word), (read.pair_names(), read.pair_id)):
                for name, n in zip(names, np.bincount(of, minlength=len(names)).tolist()):
                    counts[name] += n
            if len(counts) > _FLUSH:
                yield out()
                counts.clear()
    if counts:
        yield out()


def corpus_counts(documents: DataFrame) -> DataFrame:
    """Occurrences of every word and pair of neighbouring words (with a blank between): term, n."""
    return documents.select("text").mapInArrow(_count, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def pair_information(counts: DataFrame) -> DataFrame:
    """PMI of every pair that occurs: term, pmi = ln(p(a, b) / (p(a) p(b)))."""
    blank = F.instr(F.col("term").cast("string"), " ")
    kinds = counts.withColumn("is_pair", blank > 0)
    single = kinds.where(~F.col("is_pair")).select("term", "n")
    pairs = kinds.where("is_pair").select(
        "term",
        "n",
        F.split_part(F.col("term").cast("string"), F.lit(" "), F.lit(1)).cast("binary").alias("a"),
        F.split_part(F.col("term").cast("string"), F.lit(" "), F.lit(2)).cast("binary").alias("b"),
    )
    total = kinds.agg(
        F.sum(F.when(F.col("is_pair"), F.col("n"))).alias("all_pairs"), F.sum(F.when(~F.col("is_pair"), F.col("n"))).alias("all_words")
    )
    joined = pairs.join(single.select(F.col("term").alias("a"), F.col("n").alias("na")), "a").join(
        single.select(F.col("term").alias("b"), F.col("n").alias("nb")), "b"
    )
    return joined.crossJoin(F.broadcast(total)).select(  # one row
        "term",
        (F.log("n") - F.log("all_pairs") - F.log("na") - F.log("nb") + 2 * F.log("all_words")).alias("pmi"),
    )


def _measures(read: _Read, pmi: np.ndarray, frequent: frozenset[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The text each window belongs to, and ten measures of it."""
    starts = np.concatenate([[0], np.cumsum(np.maximum(read.length - 1, 0))])[:-1]
    at = np.arange(len(read.of_pair)) - starts[read.of_pair]
    windows_before = np.concatenate([[0], np.cumsum(-(-np.maximum(read.length - 1, 0) // WINDOW))])[:-1]
    win = windows_before[read.of_pair] + at // WINDOW
    n_win = int(win[-1]) + 1 if len(win) else 0
    if not n_win:
        return np.zeros(0, np.int64), np.zeros((0, 10))
    size = np.bincount(win, minlength=n_win).astype(float)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(win, x, minlength=n_win) / size

    def distinct(x: np.ndarray, upper: int) -> np.ndarray:
        return np.bincount(np.unique(win * max(1, upper) + x) // max(1, upper), minlength=n_win)

    average = mean(pmi)
    is_frequent = np.array([w in frequent for w in read.vocabulary], float)
    is_digit = np.array([w[:1] == b"0" for w in read.vocabulary], float)
    is_mask = np.array([_MASK in w or w in (b"redacted", b"____") for w in read.vocabulary], float)
    _, in_text, often = np.unique(read.of_pair * max(1, len(read.pair)) + read.pair_id, return_inverse=True, return_counts=True)
    text_of = np.zeros(n_win, np.int64)
    text_of[win] = read.of_pair
    x = np.column_stack(
        [
            average,
            mean((pmi < 0.5).astype(float)),
            mean((pmi < 2.0).astype(float)),
            distinct(read.left, len(read.vocabulary)) / size,
            1.0 - distinct(read.pair_id, len(read.pair)) / size,
            mean(is_frequent[read.left]),
            np.sqrt(np.maximum(mean(pmi * pmi) - average * average, 0.0)),
            mean(often[in_text].astype(float)) / read.length[text_of] * 10.0,
            mean(is_digit[read.left]),
            mean(is_mask[read.left]),
        ]
    )
    keep = (size >= WINDOW / 3) | (np.concatenate([[True], text_of[1:] != text_of[:-1]]))
    return text_of[keep], x[keep]


def _expand(z: np.ndarray) -> np.ndarray:
    """Measures, their squares and products, and a constant."""
    products = [z[:, [i]] * z[:, i:] for i in range(z.shape[1])]
    return np.hstack([z, *products, np.ones((len(z), 1))])


class Model:
    """Window and page models; `score` gives the probability that each text is spam."""

    def __init__(self, window=None, page=None):
        self.window, self.page = window, page

    @staticmethod
    def _scaled(x: np.ndarray, of: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        return np.clip((x - of[0]) / of[1], -4.0, 4.0)

    def _windows(self, x: np.ndarray) -> np.ndarray:
        scale, w = self.window
        return sigmoid(_expand(self._scaled(x, scale)) @ w)

    @staticmethod
    def _page(text_of: np.ndarray, q: np.ndarray, page: np.ndarray) -> np.ndarray:
        n, length = len(page), np.maximum(page[:, 0], 1)
        size = np.maximum(np.bincount(text_of, minlength=n), 1).astype(float)
        high, low = np.zeros(n), np.ones(n)
        np.maximum.at(high, text_of, q)
        np.minimum.at(low, text_of, q)
        return np.column_stack(
            [np.bincount(text_of, q, minlength=n) / size, np.bincount(text_of, q > 0.5, minlength=n) / size, high, low, np.log(length), page[:, 1] / length, np.minimum(page[:, 2] / length, 0.3)]
        )

    def fit(self, text_of: np.ndarray, x: np.ndarray, page: np.ndarray, y: np.ndarray) -> Model:
        size = np.maximum(np.bincount(text_of, minlength=len(y)), 1)
        scale = (x.mean(0), x.std(0) + 1e-9)
        self.window = (scale, logistic(_expand(self._scaled(x, scale)), y[text_of], 1.0 / np.sqrt(size[text_of]), 3.0))
        page = self._page(text_of, self._windows(x), page)
        scale = (page.mean(0), page.std(0) + 1e-9)
        z = np.hstack([self._scaled(page, scale), np.ones((len(page), 1))])
        self.page = (scale, logistic(z, y, np.ones(len(y)), 1.0))
        return self

    def score(self, text_of: np.ndarray, x: np.ndarray, page: np.ndarray) -> np.ndarray:
        page = self._page(text_of, self._windows(x), page)
        scale, w = self.page
        return sigmoid(np.hstack([self._scaled(page, scale), np.ones((len(page), 1))]) @ w)


def _reader(lookup, frequent):
    """Rows (doc_id, text[, pmis]) in batches -> (doc_ids, words, sentence ends and
    links of each text, mean PMI, text of window, measures)."""

    def each(batches: Iterator[pa.RecordBatch]):
        table = None if lookup is None else lookup.value
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            given = batch.column(2).to_pylist() if table is None else None
            for a, b in _slices(texts):
                read = _Read(texts[a:b])
                if table is not None:
                    pmi = np.array([table.get(p, 0.0) for p in read.pair_names()], float)[read.pair_id] if len(read.pair) else np.zeros(0)
                else:
                    pmi = np.array([v for row in given[a:b] for v in (row or ())], float)
                of, x = _measures(read, pmi, frequent)
                n = b - a
                average = np.bincount(read.of_pair, pmi, minlength=n) / np.maximum(read.length - 1, 1)
                yield ids[a:b], np.column_stack([read.length, read.ends, read.links]).astype(float), average, of, x

    return each


def _with_pmi(documents: DataFrame, information: DataFrame) -> DataFrame:
    """doc_id, text and the PMI of its neighbouring words in order, by a join on the pair."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in _slices(texts):
                read = _Read(texts[a:b])
                starts = np.concatenate([[0], np.cumsum(np.maximum(read.length - 1, 0))])[:-1]
                names = pa.array(read.pair_names(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[a:b], pa.string()).take(pa.array(read.of_pair)),
                        pa.array(np.arange(len(read.of_pair)) - starts[read.of_pair]),
                        names.take(pa.array(read.pair_id)) if len(names) else names,
                    ],
                    ["k", "at", "term"],
                )

    keyed = documents.withColumn("k", F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256))
    once = keyed.dropDuplicates(["k"])  # a repeated row has the same words
    pairs = once.select("k", "text").mapInArrow(explode, "k string, at bigint, term binary").join(information, "term")
    lists = pairs.groupBy("k").agg(F.array_sort(F.collect_list(F.struct("at", "pmi"))).alias("p"))
    return once.join(lists, "k", "left").select("doc_id", "text", F.col("p.pmi").alias("pmis"))


_PAGES = "doc_id bigint, n_words bigint, mean_pmi double, erratic double, repeated double, plain double"


def _pages(read):
    """Per page the spread of PMI within its windows, how often its collocations recur and its share of
    the corpus's most frequent words, each as the mean over its windows; NULL without any window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, page, average, of, x in read(batches):
            n = np.bincount(of, minlength=len(ids))
            means = [np.bincount(of, x[:, i], minlength=len(ids)) / np.maximum(n, 1) for i in (6, 7, 5)]
            columns = [pa.array(m, mask=n == 0) for m in means]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(page[:, 0].astype(np.int64)), pa.array(average), *columns], _PAGES.replace(" bigint", "").replace(" double", "").split(", "))

    return run


def _unusual(pages: DataFrame) -> DataFrame:
    """The rule without reviewed pages: how far a page lies from the corpus's median page, in units of
    the quartile range: erratic PMI and recurring collocations for spam, frequent words against it."""
    quartiles = pages.where(F.col("n_words") >= MIN_WORDS).agg(*[F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000).alias(c) for c in ("erratic", "repeated", "plain")]).first()

    def apart(c: str) -> Column:
        low, middle, high = quartiles[c] or (0.0, 0.0, 0.0)
        return F.greatest(F.lit(-8.0), F.least(F.lit(8.0), (F.col(c) - middle) / ((high - low) / 1.349 + 1e-6)))

    far = apart("erratic") + 0.3 * apart("repeated") - apart("plain")
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), THRESHOLD * far / UNUSUAL))
    return pages.select("doc_id", "n_words", "mean_pmi", F.coalesce(F.when(F.col("n_words") >= MIN_WORDS, p), F.lit(0.0)).alias("spam_probability"))


def scored(documents: DataFrame, labels: DataFrame | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """A row per document: doc_id, n_words, mean_pmi, spam_probability."""
    spark = documents.sparkSession
    scratch = Scratch(spark, "pagespam")
    docs = documents.select("doc_id", "text")
    counts = scratch.write(corpus_counts(docs), "counts")
    is_word = F.instr(F.col("term").cast("string"), " ") == 0
    frequent = frozenset(bytes(r[0]) for r in counts.where(is_word).orderBy(F.desc("n"), "term").limit(FREQUENT).collect())
    information = scratch.write(pair_information(counts), "information")
    lookup = None
    if information.count() <= max_broadcast:
        held = information.toPandas()
        lookup = spark.sparkContext.broadcast({bytes(t): p for t, p in zip(held["term"], held["pmi"])})
    read = _reader(lookup, frequent)

    def source(d: DataFrame) -> DataFrame:
        return d if lookup is not None else _with_pmi(d, information)

    model = Model()
    if labels is not None:
        used = labels.where("doc_id IS NOT NULL AND is_spam IS NOT NULL").groupBy("doc_id").agg(F.max("is_spam").alias("y"))
        used = used.orderBy(F.xxhash64("doc_id")).limit(MAX_LABELS)
        known = docs.join(F.broadcast(used), "doc_id")  # at most MAX_LABELS rows

        def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, page, _, of, x in read(batches):
                for i, doc in enumerate(ids):
                    mine = x[of == i]
                    if page[i, 0] >= MIN_WORDS and len(mine):
                        step = -(-len(mine) // MAX_LABEL_WINDOWS)
                        yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([page[i].tolist()]), pa.array([mine[::step].ravel().tolist()])], ["doc_id", "page", "x"])

        seen = source(known.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")).mapInArrow(measure, "doc_id bigint, page array<double>, x array<double>")
        rows = seen.join(used, "doc_id").orderBy("doc_id", "page").collect()
        y = np.array([float(r.y) for r in rows])
        if 10 <= len(y) and 3 <= y.sum() <= len(y) - 3:
            x = [np.array(r.x).reshape(-1, 10) for r in rows]
            of = np.repeat(np.arange(len(rows)), [len(v) for v in x])
            model = model.fit(of, np.vstack(x), np.array([r.page for r in rows]), y)

    typed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    if model.page is None:
        return _unusual(scratch.write(source(typed).mapInArrow(_pages(read), _PAGES), "pages"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, page, average, of, x in read(batches):
            p = np.where(page[:, 0] < MIN_WORDS, 0.0, model.score(of, x, page))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(page[:, 0].astype(np.int64)), pa.array(average), pa.array(p)], ["doc_id", "n_words", "mean_pmi", "spam_probability"])

    return source(typed).mapInArrow(
        score, "doc_id bigint, n_words bigint, mean_pmi double, spam_probability double"
    )


def spam_pages(documents: DataFrame, labels: DataFrame | None = None, threshold: float = THRESHOLD, **options) -> DataFrame:
    """The doc_ids of spam pages, each once."""
    found = scored(documents, labels, **options)
    return found.where((F.col("spam_probability") >= threshold) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
