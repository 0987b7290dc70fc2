"""Toxicity: a support vector machine over a subsequence string kernel with Nyström landmarks, trained on labelled sentences.

A text is cut into sentences and these into pieces: lower-case words without punctuation inside ("id-i_ot"),
three single letters or more in a row taken together ("i d i o t"). The kernel of two pieces counts the
subsequences of three characters that they share, ends of pieces included, spanning five at most, each weighted by ``decay`` for each
character of a gap; it is 1 for equal pieces. So characters that are inserted or left out weaken a likeness and don't
end it. The kernel of two sentences is the sum over their pieces of its third power, in which weak likenesses vanish.

Landmarks are pieces: those that stand out in toxic texts, each unlike the ones before it, and common pieces of other texts that are most
like them. By Nyström's method a sentence is its kernels with the landmarks times the inverse root of the
landmarks' own kernel matrix; on these vectors a linear machine with squared hinge loss is fitted by Newton's method.

Labels are those of whole texts, and most sentences of a toxic text are clean. So the sentence that counts of a toxic text is the one that
the machine so far finds worst (at first: the likest to a toxic landmark), once as it is and once with a character inserted into its
worst pieces; a clean text gives its worst sentence and one at random. Fitting and choosing take turns ``rounds`` times.
A text's score is a logistic function of its worst sentence, the number and the share of pieces held to be toxic.

Fitting takes at most ``labelled`` labelled rows, those with the least hash of their id among rows whose crc32(id) mod ``folds`` isn't 0.
Counting pieces and choosing sentences are Spark jobs over these; the driver gets a bounded number of pieces and vectors. Every
row is scored, on its whole text; a piece is worked out once for as long as a task's worker holds it.

Defined results: null and empty texts have no sentences and are scored too. Without toxic or without clean labels the score is
the labels' share of toxic (0 without labels). Null ids and contradictory labels of an id don't count as labels; null ids count as
held out. Repeated rows are scored alike. Empty tables give no rows. Extra columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.llm.common import Store, list_array, staged, tidied

SENTENCE_END = re.compile(r"[.!?]+\s+|\n+")
INSIDE = re.compile(r"[^\w\s]+|_+")
#: Places of the second and third character of a subsequence after its first.
PLACES = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4)]
#: The power of a likeness, and the pieces whose subsequences are laid out at once.
POWER, TOGETHER = 3, 4096
#: What a piece must add to a sentence to be held to be toxic.
NOTICED = 0.3
#: Pieces a worker remembers, in each of two halves; texts (characters) looked at at once.
MEMORY, PIECE = 1 << 17, 1 << 19
FEATURES = 3


def cut_sentences(text: str) -> list[list[str]]:
    """The pieces of each sentence that has any."""
    out = []
    for sentence in SENTENCE_END.split(text.lower()):
        words = INSIDE.sub("", sentence).split()
        if words:
            out.append(words if min(map(len, words)) > 1 else _joined(words))
    return out


def _joined(words: list[str]) -> list[str]:
    out = []
    for single, run in itertools.groupby(words, lambda w: len(w) == 1):
        run = list(run)
        out += ["".join(run)] if single and len(run) > 2 else run
    return out


def subsequences(pieces: list[str], decay: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(piece, subsequence, weight) by piece and subsequence, and the norm of each piece."""
    text = np.frombuffer("".join(f"\x02{p}\x03" for p in pieces).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) + 2
    ends = np.repeat(np.cumsum(lengths), lengths)
    owner = np.repeat(np.arange(len(pieces)), lengths)
    parts = []
    for second, third in PLACES:
        at = np.flatnonzero(np.arange(len(text)) + third < ends)
        parts.append((owner[at], text[at] << 42 | text[at + second] << 21 | text[at + third], np.full(len(at), decay ** (third - 2))))
    owner, code, weight = map(np.concatenate, zip(*parts, strict=True))
    order = np.lexsort((code, owner))
    owner, code, weight = owner[order], code[order], weight[order]
    new = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (code[1:] != code[:-1]))[: len(owner)])
    weight = np.add.reduceat(weight, new) if len(new) else weight
    owner, code = owner[new], code[new]
    return owner, code, weight, np.sqrt(np.bincount(owner, weight**2, len(pieces)))


class Landmarks:
    """Pieces as an index: for each subsequence the landmarks that hold it."""

    def __init__(self, pieces: list[str], decay: float):
        self.pieces, self.decay = pieces, decay
        owner, code, weight, norm = subsequences(pieces, decay)
        order = np.argsort(code, kind="stable")
        self.codes, first = np.unique(code[order], return_index=True)
        self.begins = np.append(first, len(code))
        self.owner, self.weight = owner[order], (weight / norm[owner])[order]

    def likeness(self, pieces: list[str]) -> np.ndarray:
        """The kernel of each piece with each landmark."""
        many = len(self.pieces)
        out = np.zeros((len(pieces), many))
        for x in range(0, len(pieces), TOGETHER):
            some = pieces[x : x + TOGETHER]
            owner, code, weight, norm = subsequences(some, self.decay)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            hit = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
            owner, at, weight = owner[hit], at[hit], (weight / norm[owner])[hit]
            reps = self.begins[at + 1] - self.begins[at]
            place = np.repeat(self.begins[at] - (np.cumsum(reps) - reps), reps) + np.arange(int(reps.sum()))
            np.add.at(out[x : x + len(some)].reshape(-1), np.repeat(owner * many, reps) + self.owner[place], np.repeat(weight, reps) * self.weight[place])
        return out

    def powers(self, pieces: list[str]) -> np.ndarray:
        return self.likeness(pieces) ** POWER


class Scorer:
    """What each piece adds to the value of its sentence; pieces are remembered."""

    def __init__(self, landmarks: Landmarks, weights: np.ndarray, bias: float):
        self.landmarks, self.weights, self.bias = landmarks, weights, bias
        self.store = Store(lambda some: (landmarks.powers(some) @ weights).tolist(), MEMORY)

    def values(self, sentences: list[list[str]]) -> np.ndarray:
        """The value of each piece."""
        pieces = list(itertools.chain.from_iterable(sentences))
        known = self.store.learned(set(pieces))
        return np.fromiter(map(known.__getitem__, pieces), np.float64, len(pieces))


@functools.lru_cache(maxsize=2)
def _scorer(model: tuple) -> Scorer:
    pieces, decay, weights, bias = model
    return Scorer(Landmarks(list(pieces), decay), np.array(weights), bias)


def sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each stretch of values; no size is 0."""
    return np.add.reduceat(values, np.cumsum(sizes) - sizes) if len(sizes) else np.zeros(0)


def _batches(batches, scorer):
    """(rows, sentences, the number of each row's sentences, piece values, sentence values) of stretches of some texts; the first column is text."""
    for b in batches:
        texts = b.column(0).to_pylist()
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j] or "") <= PIECE):
                size += len(texts[j] or "")
                j += 1
            cut = [cut_sentences(t or "") for t in texts[i:j]]
            sentences = list(itertools.chain.from_iterable(cut))
            values = scorer.values(sentences)
            sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
            yield b.slice(i, j - i), sentences, np.fromiter(map(len, cut), np.int64, len(cut)), values, sums(values, sizes) + scorer.bias
            i = j


def text_features(sentences: list[list[str]], counts: np.ndarray, values: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """(value of the worst sentence, amount of toxic pieces, their share) of each text, each on a bounded or log scale."""
    out = np.tile([-3.0, 0.0, np.log(1 / 20)], (len(counts), 1))
    sizes = np.fromiter(map(len, sentences), np.int64, len(sentences))
    some = np.flatnonzero(counts)
    if len(some):
        begin = (np.cumsum(counts) - counts)[some]
        toxic = values > NOTICED
        per_text = lambda x: np.add.reduceat(sums(x, sizes), begin)
        out[some, 0] = np.clip(np.maximum.reduceat(totals, begin), -3, 3)
        out[some, 1] = np.log1p(per_text(np.where(toxic, values, 0.0)))
        out[some, 2] = np.log((1 + per_text(toxic.astype(np.float64))) / (20 + per_text(np.ones(len(values)))))
    return out


def training_rows(docs: DataFrame, labels: DataFrame, labelled: int, folds: int, id_col: str, text_col: str) -> DataFrame:
    """(text, toxic) of the rows to fit on."""
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    known = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & (fold != 0))
    known = known.groupBy(id_col).agg(F.min("toxic").alias("__toxic"), F.max("toxic").alias("__most")).where("__toxic = __most")
    known = staged(known.orderBy(F.xxhash64(id_col), id_col).limit(labelled).select(id_col, (F.col("__toxic") == 1).alias("toxic")), "labels")
    return staged(docs.select(id_col, text_col).join(F.broadcast(known), id_col).select(F.col(text_col).alias("text"), "toxic"), "training")


def piece_counts(training: DataFrame) -> DataFrame:
    """(piece, toxic, clean): in how many texts of either kind a piece stands."""

    def run(batches):
        for b in batches:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found[toxic].update(set(itertools.chain.from_iterable(cut_sentences(text or ""))))
            pieces = list(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays([pa.array(pieces, pa.string()), *(pa.array([found[k][p] for p in pieces], pa.int64()) for k in (1, 0))], ["piece", "toxic", "clean"])

    return training.mapInArrow(tidied(run), "piece string, toxic long, clean long").groupBy("piece").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_landmarks(counts: DataFrame, share: float, toxic: int, clean: int, decay: float) -> tuple[list[str], int]:
    """(landmarks, how many of them are toxic ones). share: of toxic texts among all."""
    expected = (F.col("toxic") + F.col("clean")) * share
    scored = staged(counts.withColumn("excess", (F.col("toxic") - expected) / F.sqrt(expected + 1)), "pieces")
    outstanding = [r.piece for r in scored.where("excess > 2").orderBy(F.desc("excess"), "piece").select("piece").limit(8 * toxic).collect()]
    chosen: list[str] = []
    if outstanding:
        alike = Landmarks(outstanding, decay).likeness(outstanding)
        left = np.ones(len(outstanding), bool)
        for k in range(len(outstanding)):
            if left[k] and len(chosen) < toxic:
                chosen.append(outstanding[k])
                left &= alike[k] < 0.95
    common = [r.piece for r in scored.where("excess < 1").orderBy(F.desc("clean"), "piece").select("piece").limit(20_000).collect()]
    if chosen and common:
        near = np.concatenate([Landmarks(chosen, decay).likeness(common[x : x + TOGETHER]).max(axis=1) for x in range(0, len(common), TOGETHER)])
        order = np.argsort(-near, kind="stable")[:clean]
        return chosen + [common[k] for k in order], len(chosen)
    return chosen, len(chosen)


def altered(piece: str) -> str:
    """The piece with a character inserted, which and where as its hash says."""
    h = zlib.crc32(piece.encode("utf-8", "surrogatepass"))
    at = 1 + h % max(1, len(piece) - 1)
    return piece[:at] + "aeiouxz1"[h // 64 % 8] + piece[at:]


def sentence_vectors(training: DataFrame, model: tuple) -> tuple[np.ndarray, np.ndarray]:
    """(kernels with the landmarks, whether toxic) of the sentences that count, a row each."""

    def run(batches):
        scorer = _scorer(model)
        for rows, sentences, counts, values, totals in _batches(batches, scorer):
            toxic = rows.column(1).to_pylist()
            begin = np.cumsum(counts) - counts
            at = np.append(0, np.cumsum(np.fromiter(map(len, sentences), np.int64, len(sentences))))
            chosen, kinds = [], []
            for d in np.flatnonzero(counts).tolist():
                worst = begin[d] + int(np.argmax(totals[begin[d] : begin[d] + counts[d]]))
                chosen.append(sentences[worst])
                if toxic[d]:
                    own = values[at[worst] : at[worst + 1]]
                    chosen.append([altered(p) if v > 0 and v > own.max() / 2 else p for p, v in zip(sentences[worst], own, strict=True)])
                else:
                    chosen.append(sentences[begin[d] + zlib.crc32(" ".join(sentences[begin[d]]).encode("utf-8", "surrogatepass")) % counts[d]])
                kinds += [toxic[d]] * 2
            for x in range(0, len(chosen), 64):
                some = chosen[x : x + 64]
                pieces = sorted(set(itertools.chain.from_iterable(some)))
                number = {p: k for k, p in enumerate(pieces)}
                powers = scorer.landmarks.powers(pieces)
                vectors = np.stack([powers[[number[p] for p in s]].sum(axis=0) for s in some]).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array(kinds[x : x + 64]), list_array(vectors.reshape(-1), np.full(len(some), vectors.shape[1]))], ["toxic", "vector"])

    # Two rows of as many floats as there are landmarks for each training row.
    out = training.mapInArrow(tidied(run), "toxic boolean, vector array<float>").toArrow()
    vectors = out.column(1).combine_chunks().flatten().to_numpy().reshape(out.num_rows, -1)
    return vectors, out.column(0).to_numpy().astype(bool)


def fit_machine(vectors: np.ndarray, toxic: np.ndarray, root: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """(weights of the landmarks' kernels, bias): squared hinge loss, either kind of sentence with half of the weight."""
    x = np.hstack([vectors @ root.astype(np.float32), np.ones((len(vectors), 1), np.float32)])
    y = np.where(toxic, 1.0, -1.0)
    cost = penalty * np.where(toxic, len(y) / (2 * toxic.sum()), len(y) / (2 * (~toxic).sum()))
    ridge = np.eye(x.shape[1])
    ridge[-1, -1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(30):
        active = y * (x @ w) < 1
        own, c = x[active], cost[active].astype(np.float32)
        new = np.linalg.solve(ridge + (own.T * c) @ own, (own.T * c) @ y[active])
        done = np.allclose(new, w, atol=1e-5)
        w = new
        if done:
            break
    return root @ w[:-1], float(w[-1])


def fit_logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, bias) of a logistic regression, by Newton's method with a slight ridge."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    a = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w = np.zeros(a.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a.T * (p * (1 - p) + 1e-6)) @ a + 1e-2 * np.eye(len(w)), a.T @ (p - y) + 1e-2 * w)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    weights = w[:-1] / scale
    return weights, float(w[-1] - mean @ weights)


class Model:
    """The fitted machine and logistic function; without a machine the score is a constant."""

    def __init__(self, machine: tuple | None, weights: np.ndarray, bias: float, constant: float):
        self.machine, self.weights, self.bias, self.constant = machine, weights, bias, constant

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(id, score) of each row."""
        if self.machine is None:
            return docs.select(id_col, F.lit(float(self.constant)).alias("score"))
        kind = docs.schema[id_col].dataType.simpleString()
        sent = docs.sparkSession.sparkContext.broadcast((self.machine, self.weights, self.bias))

        def run(batches):
            machine, weights, bias = sent.value
            for rows, *found in _batches(batches, _scorer(machine)):
                value = text_features(*found) @ weights + bias
                yield pa.RecordBatch.from_arrays([rows.column(1), pa.array(1 / (1 + np.exp(-np.clip(value, -30, 30))))], ["id", "score"])

        return docs.select(text_col, id_col).mapInArrow(tidied(run), f"id {kind}, score double").withColumnRenamed("id", id_col)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = 20_000, folds: int = 5, toxic: int = 192, clean: int = 64, decay: float = 0.8, penalty: float = 1.0, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text") -> Model:
    """The model fitted on labelled rows outside fold 0; toxic, clean: numbers of landmarks of either kind."""
    training = training_rows(docs, labels, labelled, folds, id_col, text_col)
    rows, bad = training.agg(F.count("*"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0))).first()
    constant = Model(None, np.zeros(FEATURES), 0.0, bad / rows if rows else 0.0)
    if bad in (0, rows):
        return constant
    pieces, first = choose_landmarks(piece_counts(training), bad / rows, toxic, clean, decay)
    if not pieces:
        return constant
    landmarks = Landmarks(pieces, decay)
    values, vectors = np.linalg.eigh(landmarks.powers(pieces))
    some = values > 1e-6 * values[-1]
    root = (vectors[:, some] / np.sqrt(values[some])) @ vectors[:, some].T
    weights, bias = np.where(np.arange(len(pieces)) < first, 1.0, -0.5), 0.0
    for _ in range(rounds):
        found, kinds = sentence_vectors(training, (tuple(pieces), decay, tuple(weights.tolist()), bias))
        if not kinds.any() or kinds.all():
            return constant
        weights, bias = fit_machine(found, kinds, root, penalty)
    machine = (tuple(pieces), decay, tuple(weights.tolist()), bias)

    def run(batches):
        for rows, *found in _batches(batches, _scorer(machine)):
            yield pa.RecordBatch.from_arrays([rows.column(1), *(pa.array(c) for c in text_features(*found).T)], ["toxic", "a", "b", "c"])

    out = training.mapInArrow(tidied(run), "toxic boolean, a double, b double, c double").toArrow()
    x = np.stack([out.column(k).to_numpy() for k in (1, 2, 3)], axis=1)
    return Model(machine, *fit_logistic(x, out.column(0).to_numpy().astype(np.float64)), constant.constant)


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, held_out, score, predicted) of each row, by a model fitted on the rows that aren't held out."""
    scored = fit(docs, labels, folds=folds, id_col=id_col, text_col=text_col, **options).score(docs, id_col, text_col)
    fold = F.crc32(F.col(id_col).cast("string").cast("binary")) % folds
    return scored.select(id_col, (F.coalesce(fold, F.lit(0)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
