"""Language identification by unigram pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary. A language is a probability for each piece; a word's probability under
it is the sum, over all ways to cut the word into pieces, of the products of their probabilities, by the forward algorithm. A
text's score is the posterior of its best language, over all words of the whole text, with equal priors.

Piece probabilities are learnt by expectation maximisation (forward-backward) over the counted words of a sample of
`SAMPLE_DOCUMENTS` documents per language, drawn by a hash of the id; counting and expectations are Spark jobs whose
sums per (language, piece) are all that reaches the driver, so the model is bounded by languages times vocabulary.

White space, ASCII digits and ASCII punctuation part words; words are lower-cased. A run of more than `CUT_WORD` characters without
any of these is scored as several words.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE_DOCUMENTS = 2000
ROUNDS = 3
SMOOTHING = 0.05
UNKNOWN = 1e-7
UNDETERMINED = "und"
MAX_LANGUAGES = 1000
CACHE_WORDS = 400_000
LONG_WORD = LEARNT_BLOCK = 48
CUT_WORD = 1000
_MARK = "▁"
_PARTING = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_GROUP_CHARS = 1 << 20


def words_of(text: str) -> list[bytes]:
    return text.lower().encode("utf-8", "replace").translate(_PARTING).split()


def vocabulary_pieces(path: str) -> list[str]:
    """The ordinary pieces of a SentencePiece vocabulary file, lower-case ones and those without case."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    special = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    pieces = (model.id_to_piece(i) for i in range(model.get_piece_size()) if not any(f(i) for f in special))
    return [p for p in pieces if p == p.lower()]


class Lattice:
    """All segmentations of many words at once: words of one length share their forward steps."""

    def __init__(self, pieces: list[str]):
        self.index = {p: i for i, p in enumerate(pieces)}
        self.longest = max(map(len, pieces), default=1)
        self.unknown = len(pieces)  # a single character that is no piece
        self.none = len(pieces) + 1  # no piece: probability 0
        self.steps = {p[:k]: -1 for p in pieces for k in range(1, len(p))} | self.index  # -1: only the start of a piece

    def table(self, probabilities: np.ndarray) -> np.ndarray:
        """Rows of `probabilities` (pieces, languages) with those of the two further indices."""
        n = probabilities.shape[1]
        return np.vstack([probabilities, np.full((1, n), UNKNOWN), np.zeros((1, n))])

    def arcs(self, marked: list[str]) -> dict[tuple[int, int], np.ndarray]:
        """For words of one length: the piece index of each span (i, j) of every word, where any word has one."""
        n, many, longest, get = len(marked[0]), len(marked), self.longest, self.steps.get
        places, values = [], []
        for k, w in enumerate(marked):
            for i in range(n):
                place = i * longest * many + k
                for j in range(i + 1, min(n, i + longest) + 1):
                    piece = get(w[i:j])
                    if piece is None:
                        break
                    if piece >= 0:
                        places.append(place)
                        values.append(piece)
                    place += many
        spans = np.full(n * longest * many, self.none)
        spans.reshape(n, longest, many)[:, 0] = self.unknown
        spans[places] = values
        spans = spans.reshape(n, longest, many)
        used = (spans != self.none).any(axis=2)
        return {(int(i), int(i + d + 1)): spans[i, d] for i, d in zip(*np.nonzero(used), strict=True) if i + d < n}

    def forward(self, arcs: dict, n: int, at) -> tuple[np.ndarray, np.ndarray]:
        """Forward sums of every position and the logarithm of what they were scaled by; `at` gives an arc's probabilities."""
        first = at(arcs[0, 1])
        alpha = np.zeros((n + 1, *first.shape))
        alpha[0] = 1.0
        scale = np.zeros(len(first))
        by_end: dict[int, list[int]] = {}
        for i, j in arcs:
            by_end.setdefault(j, []).append(i)
        for j in range(1, n + 1):
            for i in by_end[j]:
                alpha[j] += alpha[i] * at(arcs[i, j])
            if n > LONG_WORD:
                largest = alpha[j].reshape(len(first), -1).max(axis=1)
                small = largest < 1e-100
                if small.any():
                    factor = np.where(small, 1e100, 1.0)
                    alpha[max(0, j - self.longest) : j + 1] *= factor.reshape(-1, *[1] * (first.ndim - 1))
                    scale -= np.log(factor)
        return alpha, scale

    def log_likelihoods(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """(words, languages): the logarithm of each word's probability, summed over its segmentations."""
        out = np.empty((len(words), table.shape[1]))
        by_length: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            if len(w) > CUT_WORD:
                out[k] = self.log_likelihoods([w[i : i + CUT_WORD] for i in range(0, len(w), CUT_WORD)], table).sum(axis=0)
            else:
                by_length.setdefault(len(w), []).append(k)
        for n, rows in by_length.items():
            block = max(1, min(2048, (1 << 20) // ((n + 2) * max(table.shape[1], self.longest))))
            for low in range(0, len(rows), block):
                some = rows[low : low + block]
                alpha, scale = self.forward(self.arcs([_MARK + words[k] for k in some]), n + 1, lambda a: table[a])
                with np.errstate(divide="ignore"):
                    out[some] = np.log(np.maximum(alpha[n + 1], 1e-300)) + scale[:, None]
        return out

    def expectations(self, words: list[str], counts: np.ndarray, languages: np.ndarray, table: np.ndarray) -> np.ndarray:
        """(pieces, languages): expected uses of each piece, over all segmentations of the counted words.

        Longer words, such as sentences of scripts without spaces, go in blocks of `LEARNT_BLOCK` characters, so that sums need no scaling:
        every character is learnt from, only pieces across the borders of blocks are not.
        """
        total = np.zeros_like(table)
        by_length: dict[int, list[tuple[str, int]]] = {}
        for k, w in enumerate(words):
            marked = _MARK + w
            for low in range(0, len(marked), LEARNT_BLOCK):
                block = marked[low : low + LEARNT_BLOCK]
                by_length.setdefault(len(block), []).append((block, k))
        for n, rows in by_length.items():
            for low in range(0, len(rows), 1024):
                some = np.array([k for _, k in rows[low : low + 1024]])
                own = languages[some]
                arcs = self.arcs([block for block, _ in rows[low : low + 1024]])
                p = {span: table[a, own] for span, a in arcs.items()}
                alpha, _ = self.forward(p, n, lambda x: x)
                beta = np.zeros_like(alpha)
                beta[n] = 1.0
                for i, j in sorted(arcs, key=lambda s: -s[0]):
                    beta[i] += beta[j] * p[i, j]
                weight = counts[some] / np.maximum(alpha[n], 1e-300)
                for (i, j), a in arcs.items():
                    np.add.at(total, (a, own), weight * alpha[i] * p[i, j] * beta[j])
        return total[: len(self.index)]


def _counted_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: dict[tuple[str, bytes], int] = {}
        for language, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for w in words_of(text or ""):
                counts[language, w] = counts.get((language, w), 0) + 1
        keys = list(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1].decode() for k in keys], pa.string()), pa.array(counts.values(), pa.int64())],
            ["lang", "word", "n"],
        )


def _expected(pieces: list[str], languages: list[str], probabilities: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(pieces)
        table = lattice.table(probabilities)
        number = {x: i for i, x in enumerate(languages)}
        total = np.zeros((len(pieces), len(languages)))
        for batch in batches:
            own = np.array([number[x] for x in batch.column(0).to_pylist()], dtype=np.int64)
            total += lattice.expectations(batch.column(1).to_pylist(), batch.column(2).to_numpy(), own, table)
        piece, language = np.nonzero(total)
        columns = [pa.array(piece, pa.int32()), pa.array(language, pa.int32()), pa.array(total[piece, language])]
        yield pa.RecordBatch.from_arrays(columns, ["piece", "language", "n"])

    return run


def learn(labelled: DataFrame, vocabulary: str, sample: int = SAMPLE_DOCUMENTS, rounds: int = ROUNDS) -> tuple[list[str], list[str], np.ndarray]:
    """Languages, pieces and their probabilities (pieces, languages), from `labelled` (id, lang, text).

    Rows with a null lang are left out. The sample takes every document of a language with at most `sample`.
    """
    labelled = labelled.where("lang is not null")
    counts = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    languages, pieces = sorted(counts), vocabulary_pieces(vocabulary)
    if not languages:
        return [], pieces, np.zeros((len(pieces), 0))
    share = F.create_map(*(F.lit(x) for k in languages for x in (k, min(1.0, sample / counts[k]))))
    drawn = F.pmod(F.xxhash64("id", F.lit("language sample")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000
    words = labelled.where(drawn).select("lang", "text").mapInArrow(_counted_words, "lang string, word string, n long")
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).persist()
    probabilities = np.full((len(pieces), len(languages)), 1.0 / len(pieces))
    try:
        for _ in range(rounds):
            expected = words.mapInArrow(_expected(pieces, languages, probabilities), "piece int, language int, n double")
            rows = expected.groupBy("piece", "language").agg(F.sum("n").alias("n")).toPandas()
            uses = np.full(probabilities.shape, SMOOTHING)
            uses[rows["piece"], rows["language"]] += rows["n"]
            probabilities = uses / uses.sum(axis=0)
    finally:
        words.unpersist()
    return languages, pieces, probabilities


class Scorer:
    """A model with the words it has scored, kept by a Python worker for all its tasks; bounded in size."""

    def __init__(self, languages: list[str], pieces: list[str], probabilities: np.ndarray):
        self.languages = languages
        self.lattice = Lattice(pieces)
        self.table = self.lattice.table(probabilities)
        self.known: dict[bytes, int] = {}
        self.values = np.zeros((CACHE_WORDS, len(languages)))
        self.lettered: np.ndarray = np.zeros(CACHE_WORDS, dtype=bool)

    def _learn(self, words: set[bytes]) -> None:
        new = words.difference(self.known)
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known.clear()
            new = words
        if new:
            listed = sorted(new)
            texts = [w.decode() for w in listed]
            low, high = len(self.known), len(self.known) + len(listed)
            self.values[low:high] = self.lattice.log_likelihoods(texts, self.table)
            self.lettered[low:high] = [w.isalpha() or any(map(str.isalpha, w)) for w in texts]
            self.known.update(zip(listed, range(low, high), strict=True))

    def score(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.languages:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        split = [words_of(t) for t in texts]
        totals, letters = np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), dtype=bool)
        block = CACHE_WORDS // 4
        self._learn({w for words in split if len(words) <= block for w in words})
        known = self.known
        for i, words in enumerate(split):
            for low in range(0, len(words), block):
                some = words[low : low + block]
                if len(words) > block:
                    self._learn(set(some))
                rows = [known[w] for w in some]
                totals[i] += self.values[rows].sum(axis=0)
                letters[i] |= self.lettered[rows].any()
            if len(words) > block:  # what a very long text has pushed out comes back
                self._learn({w for other in split[i + 1 :] if len(other) <= block for w in other})
        best = totals.argmax(axis=1)
        score = 1.0 / np.exp(totals - totals.max(axis=1, keepdims=True)).sum(axis=1)
        found = [self.languages[b] if lettered else UNDETERMINED for b, lettered in zip(best, letters, strict=True)]
        return found, np.where(letters, score, 0.0).tolist()


_SCORERS: dict[str, Scorer] = {}


def _predict(token: str, *model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[token] = Scorer(*model)
        scorer = _SCORERS[token]
        for batch in batches:
            found, score, group, size = [], [], [], 0
            for i, text in enumerate(batch.column(0)):
                group.append(text.as_py() or "")
                size += len(group[-1])
                if size > _GROUP_CHARS or i == batch.num_rows - 1:
                    languages, scores = scorer.score(group)
                    found += languages
                    score += scores
                    group, size = [], 0
            columns = [pa.array(found, pa.string()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], *columns], [*batch.schema.names[1:], "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: tuple[list[str], list[str], np.ndarray], text: str = "text") -> DataFrame:
    """The other columns of `docs` with lang_pred and score, from the whole text; one narrow stage.

    Null texts and texts without letters, and all texts if nothing was learnt, are `und` with score 0. Equal scores go to
    the language first in order. Columns named lang_pred or score are replaced.
    """
    others = [c for c in docs.columns if c not in (text, "lang_pred", "score")]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others), "lang_pred string", "score double"])
    return docs.select(text, *others).mapInArrow(_predict(uuid.uuid4().hex, *model), schema)
