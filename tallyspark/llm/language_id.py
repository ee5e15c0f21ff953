"""Language ID: unigram pieces per language, summed over all segmentations.

Pieces come from a fixed public vocabulary.  For each language their
probabilities are fitted by expectation-maximisation over word types: a
forward-backward pass gives each piece's expected count over every way to cut
the word.  A text's score is the sum over its words of the log probability
that the forward algorithm gives, all segmentations together.

Fitting takes about MAX_FIT_DOCS documents of each language, chosen by a hash
of the id (all of them where there are no more); scoring takes every word of
every text.

Defined results: null text and text without a letter are `und` with score 0,
as is every text when nothing could be learned; equal scores go to the first
language by name; rows with equal ids are scored each on their own; a null id
counts as the empty string where ids are hashed; an empty table gives an empty
result.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held, small_batches

MAX_FIT_DOCS = 2000
ROUNDS = 3
#: Expected count that every piece of the vocabulary is given besides its own.
SMOOTHING = 0.05
#: Probability of a character that no piece holds.
UNKNOWN = 1e-7
#: Words whose scores a worker keeps; the table starts anew when full.
MAX_WORDS = 300_000


def id_hash(key: Column) -> Column:
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))


def load_pieces(path: str) -> list[str]:
    """The vocabulary's pieces of letters in lower case, with or without the mark of a word's start."""
    import regex
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    letters = regex.compile(r"▁?\p{L}*").fullmatch
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()))
    return [p for p in dict.fromkeys(pieces) if p and letters(p) and p == p.lower()]


def split_letters(word: str) -> list[str]:
    """The runs of letters of a word, in lower case, marked at the start."""
    low = word.lower()
    if low.isalpha():
        return ["▁" + low]
    import regex

    return ["▁" + x for x in regex.findall(r"\p{L}+", low)]


def word_types(docs: DataFrame) -> DataFrame:
    """(lang, word, n) over docs (lang, text)."""

    def run(batches):
        from collections import Counter

        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                counts.setdefault(lang, Counter()).update(words_in(text))
            rows: Counter = Counter()
            for lang, found in counts.items():
                for word, n in found.items():
                    for piece in split_letters(word):
                        rows[lang, piece] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in rows], pa.string()), pa.array([k[1] for k in rows], pa.string()), pa.array(list(rows.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    return docs.select("lang", "text").mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def expected_counts(word: str, n: float, probs: dict, longest: int, into: dict) -> None:
    """Adds n times each piece's expected count over the segmentations of word.

    Forward values are known up to a factor that is dealt anew where they get
    small; only a piece's share among those that end at one position is used.
    """
    size = len(word)
    arcs = []
    forward, totals = [1.0] + [0.0] * size, [0.0] * (size + 1)
    for j in range(1, size + 1):
        total = 0.0
        for i in range(max(0, j - longest), j):
            p = probs.get(word[i:j])
            if p is not None:
                part = forward[i] * p
                arcs.append((i, j, part))
                total += part
        if not total:  # no piece ends here
            total = forward[j - 1] * UNKNOWN
            arcs.append((j - 1, j, total))
        forward[j] = totals[j] = total
        if total < 1e-120:  # rescale all that a later piece can start from
            for i in range(max(0, j - longest + 1), j + 1):
                forward[i] /= total
    reached = [0.0] * (size + 1)  # n times the share of segmentations that cut here
    reached[size] = n
    for i, j, part in reversed(arcs):
        share = reached[j] * (part / totals[j])
        if share:
            reached[i] += share
            piece = word[i:j]
            into[piece] = into.get(piece, 0.0) + share


def word_logs(word: str, probs: dict, longest: int, n_langs: int) -> np.ndarray:
    """Log probability of a word in each language, summed over all segmentations."""
    size = len(word)
    one, logs = [1.0] * n_langs, [0.0] * n_langs
    recent = [one]  # forward values of the last positions
    unknown = [UNKNOWN] * n_langs
    for j in range(1, size + 1):
        total = [0.0] * n_langs
        base = j - len(recent)
        found = False
        for i in range(base, j):
            p = probs.get(word[i:j])
            if p is not None:
                found = True
                total = [t + a * q for t, a, q in zip(total, recent[i - base], p)]
        if not found:
            total = [a * q for a, q in zip(recent[-1], unknown)]
        recent.append(total)
        if len(recent) > longest:
            recent.pop(0)
        if max(total) < 1e-120 or min(total) < 1e-200:  # rescale each language on its own
            scale = [1 / t if t > 0 else 1.0 for t in total]
            logs = [x - math.log(s) for x, s in zip(logs, scale)]
            recent = [[a * s for a, s in zip(r, scale)] for r in recent]
    return np.array([x + math.log(t) if t > 0 else -1e9 for x, t in zip(logs, recent[-1])])


def fit(docs: DataFrame, vocabulary: str, max_docs: int = MAX_FIT_DOCS, rounds: int = ROUNDS) -> tuple[list[str], dict, int]:
    """Learns from docs (doc_id, lang, text): languages by name, piece -> probabilities in each, and the longest piece's length."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row for each language
    langs = sorted(sizes)
    if not langs:
        return [], {}, 1
    share = F.element_at(F.create_map(*(x for k in langs for x in (F.lit(k), F.lit(min(1.0, max_docs / sizes[k]))))), F.col("lang"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
    types = word_types(known.where(place < share)).persist()
    pieces = load_pieces(vocabulary)
    longest = max(map(len, pieces))
    model = {lang: dict.fromkeys(pieces, 1.0 / len(pieces)) for lang in langs}
    for _ in range(rounds):
        shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary times languages

        def run(batches, shared=shared):
            into: dict[str, dict] = {}
            for batch in batches:
                for lang, word, n in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    expected_counts(word, float(n), shared.value[lang], longest, into.setdefault(lang, {}))
            rows = [(lang, piece, c) for lang, counts in into.items() for piece, c in counts.items()]
            kinds = (pa.string(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["lang", "piece", "c"])

        summed = types.mapInArrow(run, "lang string, piece string, c double").groupBy("lang", "piece").agg(F.sum("c").alias("c"))
        counts: dict[str, dict] = {lang: {} for lang in langs}
        for r in summed.collect():  # vocabulary times languages at most
            counts[r["lang"]][r["piece"]] = r["c"]
        for lang in langs:
            total = sum(counts[lang].get(p, 0.0) for p in pieces) + SMOOTHING * len(pieces)
            model[lang] = {p: (counts[lang].get(p, 0.0) + SMOOTHING) / total for p in pieces}
    types.unpersist()
    return langs, {p: tuple(model[lang][p] for lang in langs) for p in pieces}, longest


#: Longest run of letters that is scored in a batch; longer ones are scored one by one, with rescaling.
BATCH_LENGTH = 40

#: ASCII characters that are no letters, taken for spaces.
_APART = {i: " " for i in range(128) if not chr(i).isalpha()}


def words_in(text: str | None) -> list[str]:
    """A text's words in lower case, cut at ASCII characters that are no letters."""
    return (text or "").lower().translate(_APART).split()


class Scorer:
    """A worker's scores of words."""

    def __init__(self, langs, probs, longest):
        self.langs, self.probs, self.longest = langs, probs, longest
        self.number = {p: k + 1 for k, p in enumerate(probs)}
        self.table = np.array([[0.0] * len(langs), *probs.values()])
        self._clear()

    def _clear(self):
        self.at: dict[str, int] = {}
        self.rows = np.zeros((1024, len(self.langs) + 1))

    def _run_logs(self, runs: list[str]) -> np.ndarray:
        """Log probabilities of runs of one length, all forward passes side by side."""
        size, get = len(runs[0]), self.number.get
        arcs = [(i, j) for j in range(1, size + 1) for i in range(max(0, j - self.longest), j)]
        found = np.array([[get(run[i:j], 0) for i, j in arcs] for run in runs])
        forward = [np.ones((len(runs), len(self.langs)))]
        k = 0
        for j in range(1, size + 1):
            total = np.zeros_like(forward[0])
            n = min(j, self.longest)
            for i in range(j - n, j):
                total += forward[i] * self.table[found[:, k + i - (j - n)]]
            missed = ~found[:, k : k + n].any(axis=1)
            total[missed] = forward[j - 1][missed] * UNKNOWN
            k += n
            forward.append(total)
        return np.log(np.maximum(forward[size], 1e-300))

    def add(self, words: list[str]) -> None:
        """Scores the words that have no score yet."""
        new = [w for w in dict.fromkeys(words) if w not in self.at]
        if not new:
            return
        if len(self.at) + len(new) > MAX_WORDS:
            self._clear()
            new = list(dict.fromkeys(words))
        n, start = len(self.langs), len(self.at)
        while start + len(new) > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        by_length: dict[int, tuple[list, list]] = {}
        for k, word in enumerate(new, start):
            self.at[word] = k
            for run in split_letters(word):
                at, runs = by_length.setdefault(len(run), ([], []))
                at.append(k)
                runs.append(run)
        for size, (at, runs) in by_length.items():
            if size <= BATCH_LENGTH:
                logs = self._run_logs(runs)
            else:
                logs = np.array([word_logs(run, self.probs, self.longest, n) for run in runs])
            np.add.at(self.rows, at, np.concatenate([logs, np.ones((len(at), 1))], axis=1))

    def __call__(self, words: list[str]) -> tuple[str, float]:
        """Language and score of a text's words."""
        if not words or not self.langs:
            return "und", 0.0
        total = self.rows[np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))].sum(axis=0)
        if not total[-1]:
            return "und", 0.0
        logs = total[:-1] - total[:-1].max()
        best = int(logs.argmax())
        return self.langs[best], float(1.0 / np.exp(logs).sum())


def _scored(name: str, shared, texts: list) -> list[tuple[str, float]]:
    """Language and score of each text, by the worker's scorer for a broadcast model."""
    score = held(("scorer", name), lambda: Scorer(*shared.value))
    texts = [words_in(s) for s in texts]
    if score.langs:
        score.add([w for words in texts for w in words])
    return [score(words) for words in texts]


def predict(docs: DataFrame, model: tuple[list[str], dict, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred and score, the language's share of the likelihoods."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    name = uuid.uuid4().hex

    def run(batches):
        for batch in batches:
            found = _scored(name, shared, batch.column(1).to_pylist())
            cols = [batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def keep(docs: DataFrame, model: tuple[list[str], dict, int], least: float = 0.5) -> DataFrame:
    """The rows, with all their columns, whose text is in a learned language with a score of at least `least`."""
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            found = _scored(name, shared, batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != "und" and p >= least for lang, p in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
